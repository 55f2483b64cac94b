"""Further queries of the genomic operators, with their SQL: relations, legacy rules, junction classes, profiles and the numbers behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.functions import text as TX
from strandloom.operators import arrays as A
from strandloom.operators import genes as G
from strandloom.operators import junctions as J
from strandloom.operators import kmers as K
from strandloom.operators import mapping as M
from strandloom.operators import metagene as MG
from strandloom.operators import overlap as O
from strandloom.operators import regions as R
from strandloom.operators import sequence as S
from strandloom.operators import stats as T
from strandloom.plans.genome import _CDS_BY, _RL, _SITES, _TR, _TX, _VALUES, _WIN, TILE, _by_length, _pairs, exons, masks, sites, track, transcripts
from strandloom.plans.registry import Registry
from strandloom.plans.views import ctes, view
from strandloom.tables import load

more = Registry()


# Relations and edits of segments and chains.
_EXON_PAIRS = "p AS (SELECT a.tx_id AS tx_a, a.exon_no AS ex_a, b.tx_id AS tx_b, b.exon_no AS ex_b, a.strand = b.strand AND b.seg_start >= a.seg_start AND b.seg_end <= a.seg_end AS inside, a.strand = b.strand AS meets FROM seg a JOIN seg b ON a.chrom = b.chrom AND a.seg_start < b.seg_end AND b.seg_start < a.seg_end WHERE a.tx_id < b.tx_id)"


@more.add("segment_relations", ctes("seg") + f", {_EXON_PAIRS} SELECT tx_a, ex_a, tx_b, ex_b, inside AS contains, meets AS overlaps, NOT meets AS overlaps_flipped FROM p")
def segment_relations(spark, d):
    """Containment and overlap of single segments, also with the second one's strand turned."""
    s = view(spark, d, "seg").select("tx_id", "exon_no", "chrom", "strand", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    p = O.overlap_join(s, s, stranded=False).filter("tx_id < tx_id_r")
    one = lambda x, strand=None: F.struct(F.col(f"chrom{x}").alias("chrom"), (strand if strand is not None else F.col(f"strand{x}")).alias("strand"), F.col(f"start{x}").alias("start"), F.col(f"end{x}").alias("end"))
    p = p.select("tx_id", "exon_no", "tx_id_r", "exon_no_r", one("").alias("a"), one("_r").alias("b"), one("_r", C.flip_strand("strand_r")).alias("f"))
    return p.select(F.col("tx_id").alias("tx_a"), F.col("exon_no").alias("ex_a"), F.col("tx_id_r").alias("tx_b"), F.col("exon_no_r").alias("ex_b"), C.segment_contains(F.col("a"), F.col("b")).alias("contains"), C.segment_overlaps(F.col("a"), F.col("b")).alias("overlaps"), C.segment_overlaps(F.col("a"), F.col("f")).alias("overlaps_flipped"))


_WIDE = "w AS (SELECT tx_id, min(chrom) AS chrom, min(strand) AS strand, min(cds_start) AS cs, min(cds_end) AS ce, " + ", ".join(f"max(CASE WHEN exon_no = {i} THEN seg_{e} END) AS {e[0]}{i}" for i in range(3) for e in ("start", "end")) + " FROM seg GROUP BY tx_id)"


@more.add("chain_containment", ctes("seg") + f", {_WIDE}, p AS (SELECT a.tx_id AS tx_a, b.tx_id AS tx_b, a.strand = b.strand AND a.e0 = b.e0 AND a.s1 = b.s1 AND a.e1 = b.e1 AND a.s2 = b.s2 AND b.s0 >= a.s0 AND b.e2 <= a.e2 AS contains, a.strand = b.strand AND a.s0 = b.s0 AND a.e0 = b.e0 AND a.s1 = b.s1 AND a.e1 = b.e1 AND a.s2 = b.s2 AND a.e2 = b.e2 AND a.cs = b.cs AND a.ce = b.ce AS same FROM w a JOIN w b ON a.chrom = b.chrom AND a.tx_id <> b.tx_id AND a.s0 < b.e2 AND b.s0 < a.e2) SELECT tx_a, tx_b, contains, same FROM p")
def chain_containment(spark, d):
    """Which transcripts are part of another one, and which are equal with their coding regions."""
    c = view(spark, d, "seg").groupBy("tx_id").agg(F.min("cds_start").alias("cs"), F.min("cds_end").alias("ce"))
    p = _pairs(spark, d)
    for x in "ab":
        p = p.join(c.select(F.col("tx_id").alias(f"t{x}"), F.struct("cs", "ce").alias(f"c{x}")), F.col(f"{x}.tx_id") == F.col(f"t{x}"))
        p = p.withColumn(x, F.col(x).withField("cds_genome_start", F.col(f"c{x}.cs")).withField("cds_genome_end", F.col(f"c{x}.ce")))
    return p.select(F.col("a.tx_id").alias("tx_a"), F.col("b.tx_id").alias("tx_b"), C.contains(F.col("a"), F.col("b")).alias("contains"), C.transcripts_equal(F.col("a"), F.col("b")).alias("same"))


@more.add("chain_parts", ctes("seg") + f", {_WIDE}, x AS (SELECT tx_id, s0, e0, s1, e1, s2, e2, greatest(e0, s0 + 210) AS g0 FROM w) SELECT tx_id, CAST(s0 AS VARCHAR) || '-' || CAST(g0 AS VARCHAR) || '^' || CAST(s1 AS VARCHAR) || '-' || CAST(e1 AS VARCHAR) || '^' || CAST(s2 AS VARCHAR) || '-' || CAST(e2 AS VARCHAR) AS grown, CAST((e0 - s0) + (e2 - s2) AS BIGINT) AS without_middle, CAST(e1 - s1 AS BIGINT) AS middle FROM x")
def chain_parts(spark, d):
    """Segments added to chains, and chains without their second exon, through positions and back."""
    t = transcripts(spark, d).withColumn("more", F.array(C.segment(C.span_start("segments"), C.span_start("segments") + 210)))
    t = t.withColumn("grown", C.add_segments("segments", "more")).withColumn("mid", F.slice("segments", 2, 1))
    rest = C.from_positions(C.positions(C.subtract("segments", "mid")))
    text = F.array_join(F.transform("grown", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), "^")
    return t.select("tx_id", text.alias("grown"), C.length(rest).alias("without_middle"), C.length(C.intersect("segments", "mid")).alias("middle"))


@more.add("spliced_stop_codons", ctes("seg") + f", {_WIDE} SELECT tx_id, CASE WHEN strand = '-' THEN e0 - 2 ELSE cs END AS cds_genome_start, CASE WHEN strand = '-' THEN ce ELSE s2 + 2 END AS cds_genome_end FROM w")
def spliced_stop_codons(spark, d):
    """Coding regions that end one nucleotide before an intron, with the stop codon behind it."""
    t = transcripts(spark, d)
    lo = F.when(F.col("strand") == "-", F.element_at("segments", 2)["start"] + 1).otherwise(F.col("cds_genome_start"))
    hi = F.when(F.col("strand") == "-", F.col("cds_genome_end")).otherwise(F.element_at("segments", 2)["end"] - 1)
    return t.withColumn("lo", lo).withColumn("hi", hi).select("tx_id", C.add_three_for_stop("segments", "strand", "lo", "hi").alias("x")).select("tx_id", "x.cds_genome_start", "x.cds_genome_end")


@more.add("terminal_stop_codons", ctes("seg") + f", {_WIDE} SELECT tx_id, CASE WHEN strand = '-' THEN s0 - 2 ELSE s0 END AS span_start, CASE WHEN strand = '-' THEN e2 ELSE e2 + 2 END AS span_end, CASE WHEN strand = '-' THEN s0 - 2 ELSE cs END AS cds_genome_start, CASE WHEN strand = '-' THEN ce ELSE e2 + 2 END AS cds_genome_end FROM w")
def terminal_stop_codons(spark, d):
    """Coding regions that end one nucleotide before their transcript, whose terminal exon grows for the stop codon."""
    t = transcripts(spark, d)
    minus = F.col("strand") == "-"
    lo = F.when(minus, C.span_start("segments") + 1).otherwise(F.col("cds_genome_start"))
    hi = F.when(minus, F.col("cds_genome_end")).otherwise(C.span_end("segments") - 1)
    x = t.withColumn("lo", lo).withColumn("hi", hi).select("tx_id", C.add_three_for_stop("segments", "strand", "lo", "hi").alias("x"))
    return x.select("tx_id", C.span_start("x.segments").alias("span_start"), C.span_end("x.segments").alias("span_end"), "x.cds_genome_start", "x.cds_genome_end")


@more.add("chain_texts", ctes("seg") + f", {_WIDE} SELECT tx_id, chrom, strand, CAST(e0 - s0 + e1 - s1 + e2 - s2 AS BIGINT) AS length, chrom || ':' || CAST(s0 + 1 AS VARCHAR) || '-' || CAST(e0 + 1 AS VARCHAR) AS igv, s0 AS igv_start, 'gene_' || tx_id AS gene FROM w")
def chain_texts(spark, d):
    """Chains from their text form, an exon through the browser form, names from attributes."""
    t = transcripts(spark, d).select("tx_id", "chrom", "strand", F.col("segments")[0].alias("s"), C.from_text(C.to_text("chrom", "segments", "strand")).alias("c"), F.create_map(F.lit("Name"), "tx_id").alias("attr"))
    igv = C.to_igv("chrom", "s.start", "s.end")
    return t.select("tx_id", "c.chrom", "c.strand", C.length("c.segments").alias("length"), igv.alias("igv"), C.from_igv(igv, "strand")["start"].alias("igv_start"), C.get_gene("attr", C.get_name("attr", F.lit("?"))).alias("gene"))


@more.add("chain_ranks", ctes("seg") + f", {_WIDE}, o AS (SELECT tx_id, chrom, row_number() OVER (PARTITION BY chrom ORDER BY s0, e2, CASE strand WHEN '+' THEN 1 ELSE 2 END, e0 - s0 + e1 - s1 + e2 - s2, tx_id) AS r FROM w) SELECT tx_id, r AS place FROM o")
def chain_ranks(spark, d):
    """Place of each transcript in the order of chains on its chrom."""
    from pyspark.sql import Window

    t = transcripts(spark, d)
    return t.select("tx_id", F.row_number().over(Window.partitionBy("chrom").orderBy(*C.chain_order("chrom", "segments", "strand", "tx_id")[1:])).cast("bigint").alias("place"))


# Legacy mapping rules, in which the span counts.
@more.add("map_span_center", ctes("reads") + ", m AS (SELECT chrom, strand, rlen, start + unnest(range(12, rlen - 12)) + CASE WHEN strand = '-' THEN -3 ELSE 3 END AS pos FROM reads WHERE rlen > 24) SELECT chrom, strand, pos, round(sum(1.0::DOUBLE / (rlen - 24)), 6) AS value FROM m GROUP BY chrom, strand, pos")
def map_span_center(spark, d):
    return sites(spark, d, M.span_center(12, 3)).withColumn("value", F.round("value", 6))


@more.add("map_span_ends", ctes("reads") + ", m AS (SELECT 'five' AS rule, chrom, strand, CASE WHEN strand = '-' THEN start + rlen - 13 ELSE start + 12 END AS pos FROM reads UNION ALL SELECT 'three', chrom, strand, CASE WHEN strand = '-' THEN start + 15 ELSE start + rlen - 16 END FROM reads UNION ALL SELECT 'variable', chrom, strand, CASE WHEN strand = '-' THEN start + rlen - 1 - o ELSE start + o END FROM (SELECT *, CASE rlen WHEN 28 THEN 12 WHEN 30 THEN 14 ELSE 40 END AS o FROM reads) v) SELECT rule, chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY ALL")
def map_span_ends(spark, d):
    out = None
    for name, rule in (("five", M.span_five_prime(12)), ("three", M.span_three_prime(15)), ("variable", M.span_variable_five_prime({28: 12, 30: 14}, 40))):
        one = sites(spark, d, rule).select(F.lit(name).alias("rule"), "chrom", "strand", "pos", "value")
        out = one if out is None else out.unionByName(one)
    return out


@more.add("map_registered_rule", ctes("reads") + " SELECT chrom, strand, start AS pos, CAST(sum(rlen) AS DOUBLE) AS value FROM reads GROUP BY ALL")
def map_registered_rule(spark, d):
    """A user's rule: leftmost nucleotide, weighted by length."""
    M.register_rule("leftmost", lambda: lambda reads: reads.withColumn("pos", F.col("start")).withColumn("weight", F.col("rlen").cast("double")))
    return sites(spark, d, M.RULES["leftmost"]())


# Arrays.
@more.add("array_assign", f"{ctes('reads', 'track', 'masks')}, {_SITES}, {_TR}, x AS (SELECT DISTINCT chrom, strand, unnest(range(start, end_)) AS pos FROM masks) SELECT chrom, strand, pos, value FROM c ANTI JOIN x USING (chrom, strand, pos) UNION ALL SELECT chrom, strand, pos, value FROM t SEMI JOIN x USING (chrom, strand, pos)")
def array_assign(spark, d):
    """The sites of masked positions replaced by those of the track."""
    region = masks(spark, d).filter("end > start").select("chrom", "strand", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    return A.assign(sites(spark, d), track(spark, d), region)


@more.add("array_equality", f"{ctes('reads')}, {_SITES} SELECT TRUE AS same, (SELECT count(*) = 0 FROM c) AS other, (SELECT sum(value) FROM c) AS total, (SELECT sum(value) * 2 FROM c) AS doubled")
def array_equality(spark, d):
    """An array equals itself within the tolerance, and not its double; sums of both."""
    s = sites(spark, d)
    twice = A.scale(s, 2.0)
    near = s.withColumn("value", F.col("value") + 1e-12)
    row = A.arrays_equal(s, near).select(F.col("equal").alias("same")).crossJoin(A.arrays_equal(s, twice).select(F.col("equal").alias("other")))
    return row.crossJoin(A.array_sum(s)).crossJoin(A.array_sum(twice).withColumnRenamed("total", "doubled"))


@more.add("array_same_sites", f"{ctes('reads', 'track')}, {_SITES}, {_TR} SELECT chrom, strand, pos, c.value + t.value AS value FROM c JOIN t USING (chrom, strand, pos)")
def array_same_sites(spark, d):
    return A.add(sites(spark, d), track(spark, d), "same")


@more.add("track_to_array", f"{ctes('track')}, {_TR} SELECT chrom, strand, count(*) AS n, sum(value) AS total FROM t WHERE value <> 0 GROUP BY chrom, strand")
def track_to_array(spark, d):
    """Runs of the track expanded to sites again."""
    return A.from_runs(A.runs(track(spark, d))).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# Regions and sets.
@more.add("reads_in_regions", ctes("reads", "masks") + ", r AS (SELECT chrom, strand, start AS pos, rlen FROM reads) SELECT mask_id, count(*) AS n, CAST(sum(rlen) AS BIGINT) AS nt FROM masks m JOIN r ON r.chrom = m.chrom AND r.strand = m.strand AND r.pos >= m.start AND r.pos < m.end_ GROUP BY mask_id")
def reads_in_regions(spark, d):
    r = view(spark, d, "reads").select("chrom", "strand", F.col("start").alias("pos"), "rlen")
    return R.reads_in_regions(r, masks(spark, d), "mask_id").groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rlen").alias("nt"))


@more.add("nearby_features", ctes("gene") + ", x AS (SELECT g, chrom, base AS s, base + 1180 AS e FROM gene) SELECT a.g AS g, b.g AS g_r FROM x a JOIN x b ON a.chrom = b.chrom AND a.s // 20000 <= greatest(b.s // 20000, (b.e - 1) // 20000) AND b.s // 20000 <= greatest(a.s // 20000, (a.e - 1) // 20000) WHERE a.g < b.g")
def nearby_features(spark, d):
    """Genes that share a bin: what overlaps is looked for among them."""
    g = view(spark, d, "gene").select("g", "chrom", F.col("base").alias("start"), (F.col("base") + 1180).alias("end"))
    return O.candidates(g, g).filter("g < g_r").select("g", "g_r")


@more.add("unstranded_masks", ctes("seg", "masks") + ", m AS (SELECT mask_id, chrom, CASE WHEN CAST(substr(mask_id, 2) AS BIGINT) % 2 = 0 THEN '.' ELSE strand END AS strand, start, end_ FROM masks), t AS (SELECT tx_id, exon_no, chrom, CASE WHEN exon_no = 2 AND length(tx_id) % 2 = 0 THEN '.' ELSE strand END AS strand, seg_start, seg_end FROM seg) SELECT tx_id, exon_no, mask_id FROM t JOIN m ON t.chrom = m.chrom AND (t.strand = m.strand OR t.strand = '.' OR m.strand = '.') AND m.start < seg_end AND seg_start < m.end_")
def unstranded_masks(spark, d):
    """Overlaps in which either side, or both, may be without strand; every pair once."""
    m = masks(spark, d).withColumn("strand", F.when(F.substring("mask_id", 2, 20).cast("bigint") % 2 == 0, ".").otherwise(F.col("strand")))
    t = view(spark, d, "seg").select("tx_id", "exon_no", "chrom", F.when((F.col("exon_no") == 2) & (F.length("tx_id") % 2 == 0), ".").otherwise(F.col("strand")).alias("strand"), F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    return O.overlap_join(t, m).select("tx_id", "exon_no", F.col("mask_id_r").alias("mask_id"))


@more.add("merged_sets", "WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey % 4000 AS k, l_suppkey + 1000 * (l_orderkey % 97) AS i FROM lineitem), e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM s a JOIN s b ON a.i = b.i), r AS (SELECT a AS n, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.n WHERE e.b > r.top), c AS (SELECT n AS k, min(top) AS top FROM r GROUP BY n) SELECT top, n_items, CAST(count(*) AS BIGINT) AS n FROM (SELECT top, count(DISTINCT i) AS n_items FROM s JOIN c USING (k) GROUP BY top) x GROUP BY ALL".replace("SELECT top, n_items, CAST(count(*) AS BIGINT) AS n FROM", "SELECT n_items, CAST(count(*) AS BIGINT) AS n FROM"))
def merged_sets(spark, d):
    """Sets of suppliers that share one, united: how many united sets of which size."""
    li = load(spark, d, "lineitem").select((F.col("l_orderkey") % 4000).alias("k"), (F.col("l_suppkey") + 1000 * (F.col("l_orderkey") % 97)).alias("i")).distinct()
    u = G.merge_sets(li.groupBy("k").agg(F.collect_set("i").alias("items")), "k", "items")
    return u.groupBy(F.size("items").cast("bigint").alias("n_items")).agg(F.count(F.lit(1)).alias("n"))


# Profiles.
_STOP = _WIN.replace(
    "max(CASE WHEN strand = '-' THEN CASE WHEN cds_end - 1 >= seg_start AND cds_end - 1 < seg_end THEN n - 1 - (off + cds_end - 1 - seg_start) END ELSE CASE WHEN cds_start >= seg_start AND cds_start < seg_end THEN off + cds_start - seg_start END END) AS lm",
    "max(CASE WHEN strand = '-' THEN CASE WHEN cds_start >= seg_start AND cds_start < seg_end THEN n - 1 - (off + cds_start - seg_start) - 2 END ELSE CASE WHEN cds_end - 1 >= seg_start AND cds_end - 1 < seg_end THEN off + cds_end - 1 - seg_start - 2 END END) AS lm",
)


@more.add("metagene_stop_windows", ctes("seg") + f", {_STOP} SELECT gene_id, chrom, strand, x, pos FROM wi")
def metagene_stop_windows(spark, d):
    """Windows around the first nucleotide of the stop codon."""
    return MG.landmark_windows(transcripts(spark, d), "gene_id", "cds_stop")


_BY = f"{_RL}, ls AS (SELECT DISTINCT rlen FROM cr), vb AS (SELECT rlen, gene_id, x, coalesce(value, 0) AS value FROM wi CROSS JOIN ls LEFT JOIN cr USING (rlen, chrom, strand, pos)), db AS (SELECT rlen, gene_id, sum(value) AS dd, count(*) AS dn FROM vb WHERE x >= -30 AND x < 20 GROUP BY rlen, gene_id HAVING sum(value) >= 1), pb AS (SELECT rlen, x, quantile_cont(value / (dd / dn), 0.5) AS md, avg(value / (dd / dn)) AS mn, count(*) AS n FROM vb JOIN db USING (rlen, gene_id) GROUP BY rlen, x)"


def _profiles(spark, d, mean=False):
    v = MG.window_values(MG.landmark_windows(transcripts(spark, d), "gene_id"), _by_length(spark, d), "gene_id", by=["rlen"])
    return MG.profile(v, "gene_id", MG.normalization_window(50, (-30, 20)), 1, ["rlen"], mean)


@more.add("metagene_by_length", ctes("seg", "reads") + f", {_WIN}, {_BY} SELECT rlen, x, round(md, 9) AS metagene_average, n AS regions_counted FROM pb")
def metagene_by_length(spark, d):
    """Median profiles by read length."""
    return _profiles(spark, d).withColumn("metagene_average", F.round("metagene_average", 9))


@more.add("psite_offsets_median", ctes("seg", "reads") + f", {_WIN}, {_BY}, m AS (SELECT rlen, max(md) AS top FROM pb WHERE x < 0 GROUP BY rlen), bt AS (SELECT pb.rlen, -min(x) AS o FROM pb JOIN m ON m.rlen = pb.rlen AND pb.md = m.top WHERE x < 0 AND md > 0 GROUP BY pb.rlen) SELECT CAST(l AS INTEGER) AS length, CAST(coalesce(o, 13) AS INTEGER) AS p_offset FROM (SELECT unnest(range(25, 36)) AS l) q LEFT JOIN bt ON bt.rlen = l")
def psite_offsets_median(spark, d):
    """Offsets from the median of normalised windows of each read length, peaks before the landmark only."""
    return MG.psite_offsets(_profiles(spark, d), list(range(25, 36)), require_upstream=True)


@more.add("metagene_mean_masked", ctes("seg", "reads", "masks") + f", {_SITES}, {_WIN}, wm AS (SELECT * FROM wi WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.chrom = wi.chrom AND m.strand = wi.strand AND wi.pos >= m.start AND wi.pos < m.end_)), {_VALUES.replace('FROM wi', 'FROM wm').replace('x >= -30 AND x < 20', 'x >= -30 AND x < 0')} SELECT x, round(avg(value / (dd / dn)), 9) AS metagene_average, count(*) AS regions_counted FROM va JOIN de USING (gene_id) GROUP BY x")
def metagene_mean_masked(spark, d):
    """Mean profile without masked positions, normalised over the default part of the window before the landmark."""
    v = MG.window_values(MG.landmark_windows(transcripts(spark, d), "gene_id"), sites(spark, d), "gene_id", masks(spark, d))
    return MG.profile(v, "gene_id", MG.normalization_window(50), 1, mean=True).withColumn("metagene_average", F.round("metagene_average", 9))


@more.add("phase_by_size_windows", ctes("seg", "reads") + f", {_WIN}, {_CDS_BY}")
def phase_by_size_windows(spark, d):
    """Phasing over the coding parts of windows around coding starts, of which only the last codon is left out."""
    g = MG.roi_table(MG.landmark_windows(transcripts(spark, d), "gene_id"), "gene_id")
    r = g.select("region_id", C.from_text("region").alias("c"), "alignment_offset", "zero_point").select("region_id", "c.chrom", "c.strand", MG.roi_coding_part("c.segments", "c.strand", "alignment_offset", "zero_point").alias("segments"))
    return MG.phase_by_size(_by_length(spark, d), r, "region_id", 5, 1)


# Junctions.
_SLIDES = f"""z AS (SELECT DISTINCT chrom, strand, seg_end AS l, ns AS r FROM (SELECT *, lead(seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) AS ns FROM seg) y WHERE ns IS NOT NULL),
b AS (SELECT chrom, tile_no * {TILE} + i AS pos, substr(seq, i + 1, 1) AS b FROM (SELECT *, unnest(range({TILE})) AS i FROM genome) g),
k AS (SELECT chrom, strand, l, r, d FROM z CROSS JOIN (SELECT unnest(range(10)) AS d) q),
p AS (SELECT k.chrom, strand, l, r, min(d) FILTER (NOT coalesce(x.b = y.b, FALSE)) AS plus FROM k LEFT JOIN b x ON x.chrom = k.chrom AND x.pos = l + d LEFT JOIN b y ON y.chrom = k.chrom AND y.pos = r + d GROUP BY ALL),
m AS (SELECT k.chrom, strand, l, r, min(d) FILTER (NOT coalesce(x.b = y.b, FALSE)) AS minus FROM k LEFT JOIN b x ON x.chrom = k.chrom AND x.pos = l - 1 - d LEFT JOIN b y ON y.chrom = k.chrom AND y.pos = r - 1 - d GROUP BY ALL),
s AS (SELECT p.chrom, p.strand, p.l, p.r, -coalesce(minus, 10) AS minus, coalesce(plus, 10) AS plus FROM p JOIN m USING (chrom, strand, l, r))"""


@more.add("junction_classes", ctes("genome", "seg", "masks") + f""", {_SLIDES},
kn AS (SELECT chrom, strand, l + CASE WHEN l % 3 = 0 THEN 1 ELSE 0 END AS l, r + CASE WHEN l % 3 = 0 THEN 1 ELSE 0 END AS r FROM z WHERE l % 5 < 2),
rep AS (SELECT s.chrom, s.strand, s.l, s.r FROM s WHERE EXISTS (SELECT 1 FROM masks x WHERE x.chrom = s.chrom AND x.strand = s.strand AND ((x.start < s.l + plus + 1 AND s.l + minus - 1 < x.end_) OR (x.start < s.r + plus + 1 AND s.r + minus - 1 < x.end_)))),
hit AS (SELECT s.chrom, s.strand, s.l, s.r, arg_min(kn.l - s.l, abs(kn.l - s.l) * 1000 + kn.l - s.l) AS slide FROM s JOIN kn ON kn.chrom = s.chrom AND kn.strand = s.strand AND kn.r - kn.l = s.r - s.l AND kn.l - s.l BETWEEN minus AND plus GROUP BY ALL),
sl AS (SELECT *, unnest(range(minus, plus + 1)) AS d FROM s),
en AS (SELECT sl.*, a.b || c.b AS lead2, e.b || f.b AS tail2 FROM sl JOIN b a ON a.chrom = sl.chrom AND a.pos = l + d JOIN b c ON c.chrom = sl.chrom AND c.pos = l + d + 1 JOIN b e ON e.chrom = sl.chrom AND e.pos = r + d - 2 JOIN b f ON f.chrom = sl.chrom AND f.pos = r + d - 1),
ca AS (SELECT chrom, strand, l, r, arg_min(d, abs(d) * 2 + CASE WHEN d > 0 THEN 1 ELSE 0 END) AS slide FROM en WHERE (strand = '+' AND lead2 IN ('GT', 'GC') AND tail2 = 'AG') OR (strand = '-' AND lead2 = 'CT' AND tail2 IN ('AC', 'GC')) GROUP BY ALL)
SELECT s.chrom, s.strand, s.l AS "left", s.r AS "right", CASE WHEN rep.l IS NOT NULL THEN 'repetitive' WHEN hit.l IS NOT NULL THEN 'known' WHEN ca.l IS NOT NULL THEN 'canonical' ELSE 'untouched' END AS kind, CAST(CASE WHEN rep.l IS NOT NULL THEN 0 WHEN hit.l IS NOT NULL THEN hit.slide ELSE coalesce(ca.slide, 0) END AS BIGINT) AS slide
FROM s LEFT JOIN rep USING (chrom, strand, l, r) LEFT JOIN hit USING (chrom, strand, l, r) LEFT JOIN ca USING (chrom, strand, l, r)""")
def junction_classes(spark, d):
    """Every junction as repetitive, known, canonical or untouched, with the slide to the place chosen."""
    n = 10
    j = J.find_junctions(transcripts(spark, d), "tx_id").select("chrom", "strand", "left", "right")
    side = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("at")), F.struct(F.lit("r").alias("side"), F.col("right").alias("at"))))
    ends = j.select(F.struct("chrom", "strand", "left", "right").alias("key"), "chrom", side.alias("x")).select(F.struct("key", "x.side").alias("k"), "chrom", F.lit("+").alias("strand"), (F.col("x.at") - n - 2).alias("start"), (F.col("x.at") + n + 2).alias("end"))
    two = S.segment_sequences(view(spark, d, "genome"), ends, TILE, "k").select("k.key", "k.side", "seq").groupBy("key").agg(*[F.max(F.when(F.col("side") == s, F.col("seq"))).alias(s) for s in "lr"])
    right = F.translate("r", "N", "n")
    span = J.match_range(F.substring("l", 3, n), F.substring("l", n + 3, n), F.substring(right, 3, n), F.substring(right, n + 3, n), n)
    q = two.select("key.*", "l", "r", span.alias("span")).withColumn("canonical", J.canonical_slides(F.col("l"), F.concat(F.lit("NN"), F.col("r")), F.col("strand"), F.col("span"), n + 2))
    by = F.when(F.col("left") % 3 == 0, 1).otherwise(0)
    known = j.filter("left % 5 < 2").select("chrom", "strand", (F.col("left") + by).alias("left"), (F.col("right") + by).alias("right"))
    return J.classify(q, known, masks(spark, d)).select("chrom", "strand", "left", "right", "kind", "slide")


@more.add("junction_names", ctes("seg") + ", y AS (SELECT *, lead(seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) AS ns FROM seg) SELECT DISTINCT chrom || '@' || CAST(seg_end AS VARCHAR) || '^' || CAST(ns AS VARCHAR) || '(' || strand || ')' AS name, chrom, seg_end AS \"left\", ns AS \"right\", strand FROM y WHERE ns IS NOT NULL")
def junction_names(spark, d):
    """Names of junctions, and what is read from them."""
    j = J.find_junctions(transcripts(spark, d), "tx_id").select(J.junction_name().alias("name"))
    return j.select("name", J.parse_junction_name("name").alias("j")).select("name", "j.chrom", "j.left", "j.right", "j.strand")


# Sequence.
@more.add("kmer_repeats_mismatch", ctes("genome") + f""", t AS (SELECT chrom, tile_no, seq || coalesce(lead(seq) OVER (PARTITION BY chrom ORDER BY tile_no), '') AS long FROM genome), k AS (SELECT chrom, tile_no * {TILE} + i AS pos, substr(long, i + 1, 20) AS kmer FROM (SELECT *, unnest(range({TILE})) AS i FROM t) z WHERE length(substr(long, i + 1, 20)) = 20),
o AS (SELECT chrom, pos, kmer, kmer AS w FROM k UNION ALL SELECT chrom, -1 - pos, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM k),
h AS (SELECT chrom, pos, w, substr(w, 1, 10) AS a, substr(w, 11, 10) AS z FROM o),
n AS (SELECT x.chrom, x.pos FROM h x JOIN h y ON x.a = y.a AND hamming(x.w, y.w) <= 1 AND (x.chrom <> y.chrom OR x.pos <> y.pos) WHERE x.pos >= 0 UNION SELECT x.chrom, x.pos FROM h x JOIN h y ON x.z = y.z AND hamming(x.w, y.w) <= 1 AND (x.chrom <> y.chrom OR x.pos <> y.pos) WHERE x.pos >= 0)
SELECT chrom, count(*) AS n_repeated, CAST(sum(pos) AS BIGINT) AS pos_sum FROM n GROUP BY chrom""")
def kmer_repeats_mismatch(spark, d):
    """Positions whose 20-mer occurs elsewhere on either strand with at most one mismatch."""
    return K.repeat_sums(K.repeat_runs(view(spark, d, "genome"), 20, TILE, 1))


@more.add("mutated_sequences", ctes("genome") + ", s AS (SELECT DISTINCT substr(seq, 1, 6) AS q FROM genome), m AS (SELECT q AS v FROM s UNION SELECT substr(q, 1, CAST(i - 1 AS INTEGER)) || n || substr(q, CAST(i + 1 AS INTEGER)) FROM s CROSS JOIN (SELECT unnest(range(1, 7)) AS i) a CROSS JOIN (SELECT unnest(['N', 'A', 'C', 'T', 'G']) AS n) b) SELECT substr(v, 1, 1) AS first, count(*) AS n, count(*) FILTER (contains(v, 'N')) AS n_unknown FROM m GROUP BY 1")
def mutated_sequences(spark, d):
    """All sequences within one substitution of the first six nucleotides of the tiles."""
    s = view(spark, d, "genome").select(F.substring("seq", 1, 6).alias("seq"))
    return S.mutate_seqs(s).groupBy(F.substring("seq", 1, 1).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("seq").contains("N"), 1)).alias("n_unknown"))


@more.add("motif_hits", ctes("genome") + " SELECT chrom, count(*) AS n FROM genome WHERE regexp_matches(seq, '[AG][CT][AC][TU]G[ACGT]A') GROUP BY chrom")
def motif_hits(spark, d):
    """Tiles that hold a motif of ambiguous nucleotides."""
    return view(spark, d, "genome").filter(F.col("seq").rlike(S.seq_to_regex("RYMTGNA").replace("N", "[ACGT]"))).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


# The numbers behind plots.
@more.add("heatmap_peaks", f"{ctes('reads', 'seg')}, {_SITES}, {_WIN}, {_VALUES.split(', de AS')[0]}, m AS (SELECT gene_id, max(value) AS top FROM va GROUP BY gene_id), k AS (SELECT va.gene_id, min(x) AS peak FROM va JOIN m ON m.gene_id = va.gene_id AND va.value = m.top GROUP BY va.gene_id) SELECT gene_id, peak, CAST(dense_rank() OVER (ORDER BY peak) - 1 AS INTEGER) AS \"order\" FROM k")
def heatmap_peaks(spark, d):
    """Genes by the place of their highest value."""
    v = MG.window_values(MG.landmark_windows(transcripts(spark, d), "gene_id"), sites(spark, d), "gene_id")
    return T.heatmap_order(v, "gene_id", "x", "value")


@more.add("value_histograms", "WITH b AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem), e AS (SELECT CAST(i AS INTEGER) AS bin FROM (SELECT unnest(range(10)) AS i) r), h AS (SELECT 'x' AS axis, CAST(least(floor((l_quantity - xl) / ((xh - xl) / 10.0)), 9) AS INTEGER) AS bin FROM lineitem, b UNION ALL SELECT 'y', CAST(least(floor((l_extendedprice - yl) / ((yh - yl) / 10.0)), 9) AS INTEGER) FROM lineitem, b), n AS (SELECT axis, bin, count(*) AS n FROM h GROUP BY ALL) SELECT axis, e.bin, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(['x', 'y']) AS axis) a LEFT JOIN n USING (axis, bin)")
def value_histograms(spark, d):
    """Marginal histograms of two columns."""
    li = load(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return T.scatter_histograms(li, "q", "p", 10).select("axis", "bin", "n")


@more.add("phase_bars", ctes("reads") + ", p AS (SELECT rlen, count(*) FILTER (start % 3 = 0) AS a, count(*) FILTER (start % 3 = 1) AS b, count(*) FILTER (start % 3 = 2) AS c FROM reads GROUP BY rlen), f AS (SELECT rlen, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM p) SELECT rlen, 'a' AS part, 0.0::DOUBLE AS bottom, round(a, 9) AS height, round(b + c / 2, 9) AS tri_x, round(c * sqrt(3.0) / 2, 9) AS tri_y FROM f UNION ALL SELECT rlen, 'b', round(a, 9), round(b, 9), round(b + c / 2, 9), round(c * sqrt(3.0) / 2, 9) FROM f UNION ALL SELECT rlen, 'c', round(a + b, 9), round(c, 9), round(b + c / 2, 9), round(c * sqrt(3.0) / 2, 9) FROM f")
def phase_bars(spark, d):
    """Phases by read length as fractions, stacked bars and points of a triangle."""
    n = [F.count(F.when(F.col("start") % 3 == i, 1)).alias(c) for i, c in enumerate("abc")]
    f = T.phase_fractions(view(spark, d, "reads").groupBy("rlen").agg(*n), ["a", "b", "c"])
    tri = f.select("rlen", T.triangle(F.col("a"), F.col("b"), F.col("c")).alias("t"))
    return T.stacked_bars(f, "rlen", ["a", "b", "c"]).join(tri, "rlen").select("rlen", "part", F.round("bottom", 9).alias("bottom"), F.round("height", 9).alias("height"), F.round("t.x", 9).alias("tri_x"), F.round("t.y", 9).alias("tri_y"))


@more.add("ma_points", "WITH s AS (SELECT l_partkey AS k, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS a, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS b FROM lineitem GROUP BY 1) SELECT k, (a + b) / 2 AS mean, round(log2(b / a), 9) AS log2_ratio FROM s WHERE a > 0 AND b > 0")
def ma_points(spark, d):
    q = F.col("l_quantity").cast("bigint")
    s = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(*[F.sum(F.when(F.col("l_returnflag") == f, q)).cast("double").alias(n) for f, n in (("R", "a"), ("A", "b"))])
    return T.ma_values(s).select("k", "mean", F.round("log2_ratio", 9).alias("log2_ratio"))


@more.add("density_curve", "WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM v), h AS (SELECT v, count(*) AS m FROM v GROUP BY v), g AS (SELECT lo + (hi - lo) * i / 20 AS x, n, sd * pow(n, -0.2) AS h FROM s, (SELECT unnest(range(21)) AS i) r) SELECT round(x, 6) AS x, round(sum(m * exp(-pow((x - v) / h, 2) / 2) / (h * sqrt(2 * pi()))) / any_value(n), 9) AS density FROM g, h GROUP BY x".replace("any_value(n)", "min(n)").replace("FROM g, h GROUP BY x", "FROM g CROSS JOIN h AS hh GROUP BY x").replace("sum(m * exp(-pow((x - v) / h, 2) / 2) / (h *", "sum(m * exp(-pow((x - v) / g.h, 2) / 2) / (g.h *"))
def density_curve(spark, d):
    """Kernel density of a column on a fixed grid."""
    k = T.kernel_density(load(spark, d, "lineitem"), "l_quantity", 21)
    return k.select(F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@more.add("colours", "WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 256 AS BIGINT) AS r, CAST(s_suppkey * 7 % 256 AS BIGINT) AS g, CAST(s_suppkey * 31 % 256 AS BIGINT) AS b FROM supplier) SELECT s_suppkey, '#' || lower(lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0')) AS hex, CAST(least(255, round(r + 25.5)) AS INTEGER) AS lighter, CAST(greatest(0, round(g - 25.5)) AS INTEGER) AS darker, CAST(b AS INTEGER) AS back FROM s")
def colours(spark, d):
    """Colours as text, lighter and darker."""
    s = load(spark, d, "supplier").select("s_suppkey", F.array(*[((F.col("s_suppkey") * k) % 256).cast("int") for k in (1, 7, 31)]).alias("rgb"))
    return s.select("s_suppkey", T.rgb_to_hex("rgb").alias("hex"), T.lighten("rgb")[0].alias("lighter"), T.darken("rgb")[1].alias("darker"), T.hex_to_rgb(T.rgb_to_hex("rgb"))[2].alias("back"))


@more.add("text_values", "WITH r AS (SELECT DISTINCT rec_id, coalesce(float_array, '') AS t FROM autosql_records) SELECT rec_id, CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN TRY_CAST(trim(t) AS BIGINT) END AS whole FROM r")
def text_values(spark, d):
    """Texts that are whole numbers, as numbers."""
    r = load(spark, d, "autosql_records").select("rec_id", F.coalesce("float_array", F.lit("")).alias("t")).distinct()
    return r.select("rec_id", TX.number(F.col("t"))["i"].alias("whole"))
