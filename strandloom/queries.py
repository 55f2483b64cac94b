"""The queries on the stored tables: training-data problems of the core."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators.heavykeys import key_profile
from strandloom.operators.hierarchy import descendants, hierarchy
from strandloom.operators.packed import split_packed
from strandloom.operators.periods import periods_and_gaps
from strandloom.operators.rejects import parse_axt_lines, split_rejects
from strandloom.plans.registry import Registry
from strandloom.session import materialize
from strandloom.tables import load, percent_decoded, with_reported_chrom

core = Registry()

_PERIODS = """
WITH s AS (SELECT DISTINCT chain_id, coalesce(a.chrom, s.chrom) AS chrom, coalesce(strand, '.') AS strand, seg_start, seg_end
  FROM segments s LEFT JOIN chrom_aliases a ON s.chrom = a.chrom_alias WHERE seg_end > seg_start),
m AS (SELECT *, max(seg_end) OVER (PARTITION BY chain_id, chrom, strand ORDER BY seg_start, seg_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR seg_start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, chrom, strand ORDER BY seg_start, seg_end ROWS UNBOUNDED PRECEDING) AS isle FROM m),
p AS (SELECT chain_id, chrom, strand, min(seg_start) AS seg_start, max(seg_end) AS seg_end, count(*) AS n FROM i GROUP BY chain_id, chrom, strand, isle),
g AS (SELECT *, lead(seg_start) OVER (PARTITION BY chain_id, chrom, strand ORDER BY seg_start) AS nx FROM p)
"""


def _periods(spark, d):
    s = with_reported_chrom(load(spark, d, "segments"), load(spark, d, "chrom_aliases")).withColumn("strand", F.coalesce("strand", F.lit(".")))
    return periods_and_gaps(s, ["chain_id", "chrom", "strand"], "seg_start", "seg_end")


@core.add("p2_found", _PERIODS + """SELECT chain_id, chrom, strand, 'period' AS found_kind, seg_start, seg_end FROM p WHERE n > 1
UNION ALL SELECT chain_id, chrom, strand, 'gap', seg_end, nx FROM g WHERE nx IS NOT NULL""")
def p2_found(spark, d):
    return _periods(spark, d).filter("found_kind = 'gap' or differing").select("chain_id", "chrom", "strand", "found_kind", "seg_start", "seg_end")


@core.add("p2_coverage", _PERIODS + """, k AS (SELECT chain_id, chrom, strand, seg_end - seg_start AS covered, NULL::BIGINT AS gap FROM p
UNION ALL SELECT chain_id, chrom, strand, NULL, nx - seg_end FROM g WHERE nx IS NOT NULL)
SELECT chain_id, chrom, strand, count(covered) AS n_periods, count(gap) AS n_gaps, CAST(sum(covered) AS BIGINT) AS covered_nt, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gap_nt
FROM k GROUP BY chain_id, chrom, strand""")
def p2_coverage(spark, d):
    """Per chain, chrom and strand: number of periods and gaps, nucleotides in each."""
    n = F.col("seg_end") - F.col("seg_start")
    gap = F.col("found_kind") == "gap"
    return _periods(spark, d).groupBy("chain_id", "chrom", "strand").agg(F.count(F.when(~gap, 1)).alias("n_periods"), F.count(F.when(gap, 1)).alias("n_gaps"), F.coalesce(F.sum(F.when(~gap, n)), F.lit(0)).alias("covered_nt"), F.coalesce(F.sum(F.when(gap, n)), F.lit(0)).alias("gap_nt"))


_AXT = r"""
WITH l AS (SELECT DISTINCT raw_id, regexp_replace(raw_line, '\r$', '') AS l FROM axt_lines),
k AS (SELECT raw_id, l, regexp_full_match(l, '(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|))*') AS q FROM l WHERE regexp_matches(l, '\S') AND NOT starts_with(l, '#')),
f AS (SELECT *, list_transform(CASE WHEN q THEN regexp_extract_all(chr(9) || l, '\t("(?:[^"]|"")*"|[^"\t][^\t]*|)', 1) END, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM k),
v AS (SELECT *, regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[3], '[0-9]+') AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[6], '[0-9]+') AND regexp_full_match(f[7], '[0-9]+') AND regexp_full_match(f[10], '[0-9]+')
  AND regexp_matches(f[2], '\S') AND regexp_matches(f[5], '\S') AND f[8] IN ('+', '-') AND regexp_full_match(f[9], '(-?[0-9]+)?') AND regexp_full_match(f[11], '[ACGTNacgtn-]*') AND regexp_full_match(f[12], '[ACGTNacgtn-]*') AS form FROM f),
r AS (SELECT raw_id, f, CASE WHEN NOT q THEN 'quoting' WHEN len(f) <> 12 THEN 'columns' WHEN NOT form THEN 'value'
  WHEN NOT (TRY_CAST(f[3] AS HUGEINT) BETWEEN 1 AND TRY_CAST(f[4] AS HUGEINT) AND TRY_CAST(f[6] AS HUGEINT) BETWEEN 1 AND TRY_CAST(f[7] AS HUGEINT) AND TRY_CAST(f[10] AS HUGEINT) >= 1
   AND length(f[11]) = TRY_CAST(f[10] AS HUGEINT) AND length(f[12]) = TRY_CAST(f[10] AS HUGEINT)
   AND length(replace(f[11], '-', '')) = TRY_CAST(f[4] AS HUGEINT) - TRY_CAST(f[3] AS HUGEINT) + 1 AND length(replace(f[12], '-', '')) = TRY_CAST(f[7] AS HUGEINT) - TRY_CAST(f[6] AS HUGEINT) + 1) THEN 'value' END AS fail_reason FROM v)
"""


def _axt(spark, d):
    return parse_axt_lines(load(spark, d, "axt_lines").select("raw_id", "raw_line"))


@core.add("p5_found", _AXT + "SELECT raw_id, fail_reason FROM r WHERE fail_reason IS NOT NULL")
def p5_found(spark, d):
    return split_rejects(_axt(spark, d))[1].select("raw_id", "fail_reason").distinct()


@core.add("p5_valid", _AXT + """SELECT raw_id, TRY_CAST(f[1] AS BIGINT) AS aln_no, f[2] AS tName, TRY_CAST(f[3] AS BIGINT) AS tStart, TRY_CAST(f[4] AS BIGINT) AS tEnd, f[5] AS qName, TRY_CAST(f[6] AS BIGINT) AS qStart, TRY_CAST(f[7] AS BIGINT) AS qEnd,
 f[8] AS qStrand, TRY_CAST(f[9] AS BIGINT) AS score, TRY_CAST(f[10] AS BIGINT) AS symCount, f[11] AS tSym, f[12] AS qSym,
 nullif(concat_ws(';', CASE WHEN TRY_CAST(f[1] AS BIGINT) IS NULL THEN 'aln_no=' || f[1] END, CASE WHEN TRY_CAST(f[3] AS BIGINT) IS NULL THEN 'tStart=' || f[3] END, CASE WHEN TRY_CAST(f[4] AS BIGINT) IS NULL THEN 'tEnd=' || f[4] END, CASE WHEN TRY_CAST(f[6] AS BIGINT) IS NULL THEN 'qStart=' || f[6] END, CASE WHEN TRY_CAST(f[7] AS BIGINT) IS NULL THEN 'qEnd=' || f[7] END, CASE WHEN f[9] <> '' AND TRY_CAST(f[9] AS BIGINT) IS NULL THEN 'score=' || f[9] END), '') AS wide FROM r WHERE fail_reason IS NULL""")
def p5_valid(spark, d):
    """The lines that parse, as typed rows, one per raw_id."""
    return split_rejects(_axt(spark, d))[0].drop("raw_line").dropDuplicates(["raw_id"])


_KEYS = """
WITH a AS (SELECT read_id, count(*) AS n, any_value(coalesce(c.chrom, a.chrom)) AS chrom, any_value(region) AS region, any_value(seg_start) AS s, any_value(seg_end) AS e
  FROM alignments a LEFT JOIN chrom_aliases c ON a.chrom = c.chrom_alias GROUP BY read_id),
k AS (SELECT 'chrom' AS key_field, chrom AS key_name, n, s, e FROM a UNION ALL SELECT 'region', region, n, s, e FROM a),
t AS (SELECT key_field, key_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_reads, CAST(sum(CASE WHEN e >= s THEN e - s END) AS DOUBLE) / count(CASE WHEN e >= s THEN 1 END) AS mean_length,
  min(CASE WHEN e >= s THEN s END) AS span_start, max(CASE WHEN e >= s THEN e END) AS span_end FROM k WHERE key_name IS NOT NULL GROUP BY key_field, key_name)
"""


@core.add("p7_found", _KEYS + "SELECT key_field, key_name FROM t WHERE n_rows * 20 >= (SELECT count(*) FROM alignments)")
def p7_found(spark, d):
    # The whole profile is made and written, as it is what the heavy keys are named from.
    return materialize(p7_profile(spark, d), "profile").filter("heavy").select("key_field", "key_name")


@core.add("p7_profile", _KEYS + "SELECT *, n_rows * 20 >= (SELECT count(*) FROM alignments) AS heavy FROM t")
def p7_profile(spark, d):
    """Reads, mean length and span per chrom and region, each read once."""
    return key_profile(load(spark, d, "alignments"), load(spark, d, "chrom_aliases"))


def _packed(spark, d, scores=False):
    """Values of both packed fields, one row each; a repeated row counts once."""
    parents = split_packed(load(spark, d, "gff3").select("record_id", "parent").distinct(), "parent", "id", scores=scores)
    arrays = split_packed(load(spark, d, "autosql_records").select("rec_id", "float_array", "a_field_size").distinct(), "float_array", "number", "a_field_size", scores)
    cols = ["item_pos", "item_text", "n_values", "dialect", *(["n_parses", "lead_bits"] if scores else [])]
    return parents.select(F.lit("gff3").alias("record_kind"), "record_id", *cols).unionByName(arrays.select(F.lit("autosql").alias("record_kind"), F.col("rec_id").alias("record_id"), *cols))


_PACKED = r"""
WITH p AS (SELECT DISTINCT record_id, trim(parent, E' \t') AS p FROM gff3 WHERE trim(parent, E' \t') NOT IN ('', '.')),
pb AS (SELECT record_id, regexp_replace(CASE WHEN starts_with(p, '[') THEN trim(p[2:-2]) ELSE p END, '(\s*[,;|]\s*|\s+)+$', '') AS b FROM p),
pl AS (SELECT 'gff3' AS k, record_id AS id, list_transform(regexp_extract_all(',' || b, '(?:\s*[^A-Za-z0-9:._%"\s-]\s*|\s+)("(?:[^"]|"")*"|[A-Za-z0-9:._%-]*)', 1), lambda x: url_decode(trim(CASE WHEN starts_with(x, '"') THEN x[2:-2] ELSE x END))) AS l FROM pb),
a AS (SELECT DISTINCT rec_id, trim(float_array, E' \t') AS p, a_field_size AS n FROM autosql_records WHERE trim(float_array, E' \t') <> ''),
ab AS (SELECT rec_id, n, regexp_replace(CASE WHEN regexp_matches(p, '^[\[({]') THEN trim(p[2:-2]) ELSE p END, '[,;|\s]+$', '') AS b FROM a),
ac AS (SELECT rec_id, n, b, i, list_transform(CASE i WHEN 0 THEN [b] ELSE regexp_split_to_array(b, ['', ',', ';', '\|', '\t', '\s+', ',\s', '[,;|\t]', '\s*[,;|]\s*|\s+'][i + 1]) END, lambda x: trim(x)) AS l FROM ab, range(9) t(i) WHERE NOT contains(b, '"')),
ad AS (SELECT rec_id, i, l FROM ac WHERE CASE WHEN n IS NULL THEN i = 8 ELSE len(l) = n AND len(list_filter(l, lambda x: NOT regexp_full_match(x, '(?i)([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(nan|inf(inity)?)|[+-]?[0-9]+,[0-9]+|[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|)'))) = 0 END),
al AS (SELECT 'autosql' AS k, rec_id AS id, arg_min(l, i) AS l FROM ad GROUP BY rec_id UNION ALL SELECT 'autosql', rec_id, regexp_extract_all(b, '"([^"]*)"', 1) FROM ab WHERE contains(b, '"')),
u AS (SELECT * FROM pl UNION ALL SELECT * FROM al),
v AS (SELECT k, id, unnest(l) AS t, generate_subscripts(l, 1) AS i, len(list_filter(l, lambda x: x <> '')) AS m FROM u)
SELECT k AS record_kind, id AS record_id, CAST(i AS INTEGER) AS item_pos, t AS item_text FROM v WHERE t <> '' AND m >= 2"""


@core.add("p4_found", _PACKED)
def p4_found(spark, d):
    return _packed(spark, d).filter("n_values >= 2").select("record_kind", "record_id", "item_pos", "item_text")


@core.add("p4_dialects")
def p4_dialects(spark, d):
    """How often each dialect was the cheapest, how many differing parses were scored for it, and the least and mean lead over the next one in bits."""
    per = _packed(spark, d, True).groupBy("record_kind", "record_id", "dialect", "n_parses", "lead_bits").agg(F.count(F.lit(1)).alias("n_items"))
    return per.groupBy("record_kind", "dialect").agg(F.count(F.lit(1)).alias("n_fields"), F.sum("n_items").alias("n_items"), F.count("lead_bits").alias("n_decided_by_bits"), F.sum("n_parses").alias("n_parses"), F.round(F.min("lead_bits"), 3).alias("least_lead_bits"), F.round(F.avg("lead_bits"), 3).alias("mean_lead_bits"))


@core.add("p4_sizes", _PACKED.replace("SELECT k AS record_kind, id AS record_id, CAST(i AS INTEGER) AS item_pos, t AS item_text FROM v WHERE t <> '' AND m >= 2", "SELECT k AS record_kind, CAST(m AS INTEGER) AS n_values, count(DISTINCT id) AS n_fields, CAST(max(i) AS INTEGER) AS most_places FROM v WHERE t <> '' GROUP BY k, m"))
def p4_sizes(spark, d):
    """How many fields hold how many values, and the last place that has one."""
    return _packed(spark, d).groupBy("record_kind", "n_values").agg(F.count_distinct("record_id").alias("n_fields"), F.max("item_pos").alias("most_places"))


_TREE = r"""
WITH RECURSIVE r AS (SELECT DISTINCT nullif(nullif(url_decode(trim(gff_id)), ''), '.') AS id, trim(parent, E' \t') AS p FROM gff3),
n AS (SELECT DISTINCT id FROM r WHERE id IS NOT NULL),
i AS (SELECT id, unnest(regexp_extract_all(p, '"[^"]*"|[A-Za-z0-9:._%-]+')) AS v FROM r WHERE id IS NOT NULL AND p NOT IN ('', '.')),
e AS (SELECT DISTINCT i.id AS child, n.id AS parent FROM i JOIN n ON n.id = url_decode(trim(trim(v, '"')))),
up AS (SELECT child AS a, parent AS b FROM e UNION SELECT up.a, e.parent FROM up JOIN e ON up.b = e.child),
cyc AS (SELECT DISTINCT a AS id FROM up WHERE a = b),
ok AS (SELECT * FROM e WHERE child NOT IN (SELECT id FROM cyc) AND parent NOT IN (SELECT id FROM cyc)),
root AS (SELECT id FROM n WHERE id NOT IN (SELECT child FROM e)),
t AS (SELECT id, id AS root_id, 0 AS node_depth, [id] AS path FROM root UNION SELECT ok.child, t.root_id, t.node_depth + 1, list_append(t.path, ok.child) FROM t JOIN ok ON ok.parent = t.id)
"""


def _gff3_graph(spark, d):
    """(nodes, edges) of the gff3 IDs and Parents."""
    rows = load(spark, d, "gff3").select("gff_id", "parent").distinct()
    node = percent_decoded(F.btrim("gff_id", F.lit(" \t\r\n\f\v")))
    rows = rows.withColumn("node", F.when(~node.isin("", "."), node)).filter("node is not null")
    return rows.select("node"), split_packed(rows, "parent", "id").select(F.col("node").alias("child"), F.col("item_text").alias("parent"))


@core.add("p6_found", _TREE + "SELECT DISTINCT id AS gff_id, root_id, node_depth FROM t UNION ALL SELECT id, '(cycle)', -1 FROM cyc")
def p6_found(spark, d):
    tree, cyc = hierarchy(*_gff3_graph(spark, d))
    return tree.select(F.col("node").alias("gff_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth")).unionByName(cyc.select(F.col("node").alias("gff_id"), F.lit("(cycle)").alias("root_id"), F.lit(-1).alias("node_depth")))


@core.add("p6_paths", _TREE + "SELECT id AS gff_id, root_id, node_depth, array_to_string(path, ' > ') AS node_path FROM t")
def p6_paths(spark, d):
    """Every full path from a root to a node."""
    tree, _ = hierarchy(*_gff3_graph(spark, d), with_path=True)
    return tree.select(F.col("node").alias("gff_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"), F.concat_ws(" > ", "path").alias("node_path"))


@core.add("p6_descendants", _TREE + """, x AS (SELECT path, unnest(range(1, len(path))) AS i FROM t), y AS (SELECT path, i, unnest(range(i + 1, len(path) + 1)) AS j FROM x)
SELECT DISTINCT path[i] AS gff_id, path[j] AS descendant_id, CAST(j - i AS INTEGER) AS distance FROM y""")
def p6_descendants(spark, d):
    """Each node with each of its descendants and the distances between them."""
    tree, _ = hierarchy(*_gff3_graph(spark, d), with_path=True)
    return descendants(tree).select(F.col("node").alias("gff_id"), F.col("descendant").alias("descendant_id"), "distance")
