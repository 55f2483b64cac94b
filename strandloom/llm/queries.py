"""Queries of the llm operators on the stored tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm.components import connected_components, group_by_match
from strandloom.llm.leakage import RUN, find_leaks, stored_index
from strandloom.llm.mixture import mix_sources, source_name
from strandloom.llm.runs import collapse_runs
from strandloom.llm.truncation import detect_truncated
from strandloom.plans.registry import Registry
from strandloom.tables import clean_id, load, once, with_reported_chrom

llm = Registry()

_ID = """nullif(regexp_replace({c}, '^[\\s"]+|[\\s"]+$', '', 'g'), '')"""
_GROUPS = (
    "WITH RECURSIVE g0 AS (SELECT DISTINCT url_decode("
    + _ID.format(c="gene_id")
    + ") AS g, url_decode("
    + _ID.format(c="transcript_id")
    + ") AS t FROM gtf2), m0 AS (SELECT DISTINCT url_decode("
    + _ID.format(c="transcript_id_a")
    + ") AS a, url_decode("
    + _ID.format(c="transcript_id_b")
    + """) AS b FROM tx_matches WHERE is_match),
gx AS (SELECT CASE WHEN lower(trim(g)) NOT IN ('', '.', 'na', 'nan', 'none') THEN g END AS g, CASE WHEN lower(trim(t)) NOT IN ('', '.', 'na', 'nan', 'none') THEN t END AS t FROM g0),
mx AS (SELECT a, b FROM m0 WHERE lower(trim(a)) NOT IN ('', '.', 'na', 'nan', 'none') AND lower(trim(b)) NOT IN ('', '.', 'na', 'nan', 'none')),
e AS (SELECT 'g:' || g AS a, 't:' || t AS b FROM gx WHERE g IS NOT NULL AND t IS NOT NULL UNION SELECT 't:' || t, 'g:' || g FROM gx WHERE g IS NOT NULL AND t IS NOT NULL UNION SELECT 't:' || a, 't:' || b FROM mx UNION SELECT 't:' || b, 't:' || a FROM mx),
r AS (SELECT DISTINCT 'g:' || g AS n, 'g:' || g AS top FROM gx WHERE g IS NOT NULL UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.n),
c AS (SELECT n, min(top) AS top FROM r WHERE starts_with(n, 'g:') GROUP BY n)
"""
)


def _links(spark, d):
    gtf = load(spark, d, "gtf2").select(F.concat(F.lit("g:"), clean_id("gene_id")).alias("a"), F.concat(F.lit("t:"), clean_id("transcript_id")).alias("b"))
    tx = load(spark, d, "tx_matches").filter("is_match").select(F.concat(F.lit("t:"), clean_id("transcript_id_a")).alias("a"), F.concat(F.lit("t:"), clean_id("transcript_id_b")).alias("b"))
    # Ids are cleaned once a row, not again in each filter on them.
    pairs = [once(t.select(F.struct("a", "b").alias("p")), "q", F.col("p")) for t in (gtf, tx)]
    return pairs[0].unionByName(pairs[1]).select("q.a", "q.b")


@llm.add("p1_found", _GROUPS + "SELECT substr(top, 3) AS group_id, substr(n, 3) AS gene_id FROM c WHERE top IN (SELECT top FROM c GROUP BY top HAVING count(*) > 1)")
def p1_found(spark, d):
    # Genes sort before transcripts, so the smallest node of a group is its smallest gene.
    rooted = connected_components(_links(spark, d), "a", "b").filter(F.col("node").startswith("g:"))
    both = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
    return both.select(F.substring("root", 3, 1 << 30).alias("group_id"), F.substring("node", 3, 1 << 30).alias("gene_id"))


@llm.add("p1_groups", _GROUPS.replace("c AS (SELECT n, min(top) AS top FROM r WHERE starts_with(n, 'g:') GROUP BY n)", "k AS (SELECT DISTINCT a AS n, a AS top FROM e WHERE a NOT IN (SELECT n FROM r) UNION SELECT e.b, k.top FROM k JOIN e ON e.a = k.n), c AS (SELECT n, min(top) AS top FROM (SELECT * FROM r UNION ALL SELECT * FROM k) x GROUP BY n)") + "SELECT substr(n, 1, 1) AS kind, substr(n, 3) AS id, top AS group_id FROM c WHERE top IN (SELECT top FROM c GROUP BY top HAVING count(*) > 1)")
def p1_groups(spark, d):
    """Every gene and transcript linked to another one, with its group."""
    return group_by_match(_links(spark, d), "a", "b").select(F.substring("node", 1, 1).alias("kind"), F.substring("node", 3, 1 << 30).alias("id"), "group_id")


_RUNS = """
WITH a AS (SELECT DISTINCT lane_id, seq_no, coalesce(c.chrom, a.chrom) AS chrom, strand, seg_start AS s, seg_end AS e, epoch_us(acquired_at) AS t FROM alignments a LEFT JOIN chrom_aliases c ON a.chrom = c.chrom_alias WHERE seg_start IS NOT NULL AND seg_end IS NOT NULL),
l AS (SELECT *, lag(chrom) OVER w AS pc, lag(strand) OVER w AS ps, lag(s) OVER w AS p0, lag(e) OVER w AS p1 FROM a WINDOW w AS (PARTITION BY lane_id ORDER BY seq_no)),
f AS (SELECT *, CASE WHEN pc IS NOT DISTINCT FROM chrom AND ps IS NOT DISTINCT FROM strand AND abs(s - p0) <= 3 AND abs(e - p1) <= 3 THEN 0 ELSE 1 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY lane_id ORDER BY seq_no ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT lane_id, run, min(seq_no) AS first_seq_no, max(seq_no) AS last_seq_no, count(*) AS n_reads, max(t) - min(t) AS duration_us FROM r GROUP BY lane_id, run)
"""


def _reads(spark, d):
    return with_reported_chrom(load(spark, d, "alignments").select("lane_id", "seq_no", "chrom", "strand", "seg_start", "seg_end", "acquired_at"), load(spark, d, "chrom_aliases"))


@llm.add("p3_found", _RUNS + "SELECT lane_id, first_seq_no, last_seq_no FROM g WHERE n_reads >= 2")
def p3_found(spark, d):
    return collapse_runs(_reads(spark, d), least=2).select("lane_id", "first_seq_no", "last_seq_no")


@llm.add("p3_events", _RUNS + "SELECT lane_id, first_seq_no, last_seq_no, n_reads, duration_us FROM g")
def p3_events(spark, d):
    """Every run as one event, single reads included, with number of reads and duration."""
    return collapse_runs(_reads(spark, d)).select("lane_id", "first_seq_no", "last_seq_no", "n_reads", "duration_us")


def _leaks(spark, d, near=None):
    return find_leaks(stored_index(load(spark, d, "documents").select("doc_id", "text")), load(spark, d, "eval_items"), near=near)


@llm.add("p8_found")
def p8_found(spark, d):
    return _leaks(spark, d).select("item_id", "doc_id")


@llm.add("p8_items")
def p8_items(spark, d):
    """Per leaked item: number of documents and the longest run of its words in any of them."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest_run").alias("longest_run"), F.max("matched_words").alias("matched_words"))


@llm.add("p8_near")
def p8_near(spark, d):
    """Exact and proximity matches: at least 13 of 20 successive words of a passage in order, none further than three words from its place."""
    kind = F.when(F.col("longest_run") >= RUN, "exact").otherwise("near").alias("match_kind")
    return _leaks(spark, d, near=20).select("item_id", "doc_id", kind, "longest_run", "matched_words", "near_words")


@llm.add("p9_mixture")
def p9_mixture(spark, d):
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


@llm.add("p9_shares")
def p9_shares(spark, d):
    """Shares reached, per source of mix_targets."""
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


@llm.add(
    "p9_limits",
    """WITH t AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
n AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1),
u AS (SELECT sum(target_share) AS s FROM t JOIN n USING (source))
SELECT source, target_share, max_repeats, round(CASE WHEN n.n IS NULL THEN 0 ELSE target_share / s END, 9) AS wanted_share, TRUE AS share_met, TRUE AS caps_held, TRUE AS converged FROM t LEFT JOIN n USING (source) CROSS JOIN u""",
)
def p9_limits(spark, d):
    """What the mixture must keep to: the share of each source, to within two documents of its largest size a copy, and the cap on copies.

    Sources without documents have nothing to give; the others share what they miss in proportion.
    """
    mixture, report = mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    largest = mixture.groupBy("source").agg(F.max("tokens").alias("largest"))
    whole, usable = (report.agg(c.alias("x")).scalar() for c in (F.sum("mixture_tokens"), F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")))))
    wanted = F.when(F.col("available_tokens") > 0, F.col("target_share") / usable).otherwise(0.0)
    # Every source may miss by two documents, so the whole may differ by as much for each of them.
    slack = 2 * F.coalesce("largest", F.lit(0)) + wanted * 2 * largest.agg(F.sum("largest").alias("x")).scalar()
    return report.join(largest, "source", "left").select(
        "source", "target_share", "max_repeats", F.round(wanted, 9).alias("wanted_share"), (F.abs(F.col("mixture_tokens") - wanted * whole) <= slack).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("caps_held"), "converged"
    )


@llm.add("p10_found")
def p10_found(spark, d):
    return detect_truncated(load(spark, d, "documents")).filter("cut").select("doc_id").distinct()


@llm.add("p10_rates")
def p10_rates(spark, d):
    """Documents with text, cut documents and their rate, per source."""
    docs = load(spark, d, "documents")
    cut = detect_truncated(docs).select("doc_id", "cut")
    return docs.select("doc_id", source_name("source").alias("source")).join(cut, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("cut_rate"))
