"""Queries of the genomic operators on the views of :mod:`strandloom.plans.views`, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators import annotation as N
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
from strandloom.plans.registry import Registry
from strandloom.plans.views import ctes, view
from strandloom.tables import clean_id, load, percent_decoded, with_reported_chrom

genome = Registry()

OFFSETS = {25: 10, 26: 11, 27: 11, 28: 12, 29: 12, 30: 13}
TILE = 32


def exons(spark, d) -> DataFrame:
    return view(spark, d, "seg").select("tx_id", "gene_id", "chrom", "strand", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "cds_start", "cds_end")


def transcripts(spark, d) -> DataFrame:
    g = exons(spark, d).groupBy("tx_id", "gene_id", "chrom", "strand", F.col("cds_start").alias("cds_genome_start"), F.col("cds_end").alias("cds_genome_end"))
    return g.agg(F.array_sort(F.collect_list(C.segment("start", "end"))).alias("segments"))


def masks(spark, d) -> DataFrame:
    return view(spark, d, "masks").select("mask_id", "chrom", "strand", "start", F.col("end_").alias("end"))


def sites(spark, d, rule=None) -> DataFrame:
    return A.count_positions((rule or M.five_prime(12))(view(spark, d, "reads")))


def track(spark, d) -> DataFrame:
    return view(spark, d, "track").select("chrom", "strand", "pos", F.col("value").cast("double").alias("value"))


def _at(q: str) -> str:
    return f"start + ({q}) + CASE WHEN k > 0 AND ({q}) >= k THEN gap ELSE 0 END"


_P5 = f"SELECT *, {_at('''CASE WHEN strand = '-' THEN rlen - 1 - 12 ELSE 12 END''')} AS pos FROM reads"
_SITES = f"c AS (SELECT chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM ({_P5}) m GROUP BY chrom, strand, pos)"
_IN = "c.chrom = s.chrom AND c.strand = s.strand AND c.pos >= seg_start AND c.pos < seg_end"


# Mapping rules.
@genome.add("map_five_prime", f"{ctes('reads')}, {_SITES} SELECT * FROM c")
def map_five_prime(spark, d):
    return sites(spark, d)


@genome.add("map_three_prime", f"{ctes('reads')} SELECT chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM (SELECT *, {_at('''CASE WHEN strand = '-' THEN 15 ELSE rlen - 1 - 15 END''')} AS pos FROM reads) m GROUP BY chrom, strand, pos")
def map_three_prime(spark, d):
    return sites(spark, d, M.three_prime(15))


@genome.add("map_center", f"{ctes('reads')}, m AS (SELECT chrom, strand, rlen, k, gap, start, unnest(range(12, rlen - 12)) AS q FROM reads WHERE rlen > 24) SELECT chrom, strand, {_at('q')} AS pos, round(sum(1.0::DOUBLE / (rlen - 24)), 6) AS value FROM m GROUP BY chrom, strand, pos")
def map_center(spark, d):
    return sites(spark, d, M.center(12)).withColumn("value", F.round("value", 6))


_VAR = "CASE rlen " + " ".join(f"WHEN {n} THEN {o}" for n, o in OFFSETS.items()) + " ELSE 13 END"


@genome.add("map_variable", f"{ctes('reads')}, o AS (SELECT *, {_VAR} AS o FROM reads) SELECT chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM (SELECT *, {_at('''CASE WHEN strand = '-' THEN rlen - 1 - o ELSE o END''')} AS pos FROM o) m GROUP BY chrom, strand, pos")
def map_variable(spark, d):
    return sites(spark, d, M.variable_five_prime(OFFSETS, 13))


@genome.add("map_stratified", f"{ctes('reads')}, o AS (SELECT *, {_VAR} AS o FROM reads WHERE rlen BETWEEN 27 AND 32) SELECT rlen, chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM (SELECT *, {_at('''CASE WHEN strand = '-' THEN rlen - 1 - o ELSE o END''')} AS pos FROM o) m GROUP BY rlen, chrom, strand, pos")
def map_stratified(spark, d):
    return A.count_positions(M.stratified_variable_five_prime(OFFSETS, 13, 27, 32)(view(spark, d, "reads")), ["rlen"])


@genome.add("filter_reads", ctes("reads") + " SELECT strand, rlen, count(*) AS n FROM reads WHERE rlen BETWEEN 28 AND 30 AND strand = '+' GROUP BY strand, rlen")
def filter_reads(spark, d):
    """Named filters: sizes and strand."""
    return M.apply_filters(view(spark, d, "reads"), {"size": M.size_filter(28, 30), "strand": M.strand_filter("+")}).groupBy("strand", "rlen").agg(F.count(F.lit(1)).alias("n"))


# Genome arrays.
@genome.add("normalize_rpm", f"{ctes('reads')}, {_SITES.replace('c AS (', 'c AS MATERIALIZED (', 1)}, n AS MATERIALIZED (SELECT sum(value) AS total FROM c) SELECT chrom, strand, pos, value * 1e6 / total AS value FROM c CROSS JOIN n")
def normalize_rpm(spark, d):
    return A.normalize(sites(spark, d))


_TR = "t AS (SELECT chrom, strand, pos, CAST(value AS DOUBLE) AS value FROM track)"


@genome.add("array_add", f"{ctes('reads', 'track')}, {_SITES}, {_TR} SELECT chrom, strand, pos, sum(value) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM t) u GROUP BY chrom, strand, pos")
def array_add(spark, d):
    return A.add(sites(spark, d), track(spark, d))


@genome.add("array_multiply", f"{ctes('reads', 'track')}, {_SITES}, {_TR} SELECT chrom, strand, pos, c.value * t.value AS value FROM c JOIN t USING (chrom, strand, pos)")
def array_multiply(spark, d):
    return A.multiply(sites(spark, d), track(spark, d))


@genome.add("array_subtract_truncated", f"{ctes('reads', 'track')}, {_SITES}, {_TR}, ec AS (SELECT chrom, strand, max(pos) AS m FROM c GROUP BY chrom, strand), et AS (SELECT chrom, strand, max(pos) AS m FROM t GROUP BY chrom, strand), e AS (SELECT chrom, strand, least(ec.m, et.m) AS e FROM ec JOIN et USING (chrom, strand)) SELECT chrom, strand, pos, coalesce(c.value, 0) - coalesce(t.value, 0) AS value FROM c FULL JOIN t USING (chrom, strand, pos) JOIN e USING (chrom, strand) WHERE pos <= e")
def array_subtract_truncated(spark, d):
    return A.subtract(sites(spark, d), track(spark, d), "truncate")


@genome.add("array_shift", f"{ctes('track')}, {_TR}, s AS (SELECT chrom, max(pos) + 1 AS n FROM t GROUP BY chrom), x AS (SELECT chrom, unnest(range(n)) AS pos FROM s), y AS (SELECT x.chrom, strand, pos FROM x CROSS JOIN (SELECT DISTINCT strand FROM t) z) SELECT chrom, strand, count(*) AS n, sum(coalesce(value, 0) + 2.5) AS total FROM y LEFT JOIN t USING (chrom, strand, pos) GROUP BY chrom, strand")
def array_shift(spark, d):
    """A constant added to every position, summed up per chrom and strand."""
    t = track(spark, d)
    return A.shift(t, A.chrom_lengths(t).select("chrom", "length"), 2.5).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_RLE = "f AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, strand, value{w} ORDER BY pos) AS g{s} FROM {a} WHERE value <> 0)"


@genome.add("track_runs", f"{ctes('track')}, {_TR}, {_RLE.format(w='', s='', a='t')} SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS \"end\", value FROM f GROUP BY chrom, strand, value, g")
def track_runs(spark, d):
    return A.runs(track(spark, d))


@genome.add("track_runs_windowed", f"{ctes('reads')}, {_SITES}, x AS (SELECT *, CAST((pos - pos % 100000) / 100000 AS BIGINT) AS w FROM c), {_RLE.format(w=', w', s='', a='x')} SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS \"end\", value FROM f GROUP BY chrom, strand, w, value, g")
def track_runs_windowed(spark, d):
    return A.runs(sites(spark, d), window=100_000)


@genome.add("bedgraph_zeros", f"{ctes('track')}, {_TR}, s AS (SELECT chrom, strand, max(pos) + 1 AS n FROM t GROUP BY chrom, strand), y AS (SELECT chrom, strand, unnest(range(n)) AS pos FROM s), z AS (SELECT chrom, strand, pos, coalesce(value, 0) AS value FROM y LEFT JOIN t USING (chrom, strand, pos)), f AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, strand, value ORDER BY pos) AS g FROM z) SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS \"end\", value FROM f GROUP BY chrom, strand, value, g")
def bedgraph_zeros(spark, d):
    return A.bedgraph_with_zeros(track(spark, d))


@genome.add("variable_step", f"{ctes('reads')}, {_SITES} SELECT chrom, strand, pos + 1 AS pos1, value FROM c WHERE value <> 0")
def variable_step(spark, d):
    return A.variable_step(sites(spark, d))


@genome.add("track_summary", f"{ctes('track')}, {_TR} SELECT chrom, strand, count(*) AS covered, sum(value) AS total, min(value) AS least, max(value) AS greatest, avg(value) AS mean, round(stddev_pop(value), 6) AS deviation FROM t WHERE value <> 0 GROUP BY chrom, strand")
def track_summary(spark, d):
    return A.summarize_runs(A.runs(track(spark, d))).withColumn("deviation", F.round("deviation", 6))


@genome.add("array_lengths", f"{ctes('track')} SELECT chrom, max(pos) + 1 AS length, string_agg(DISTINCT strand, '' ORDER BY strand) AS strands FROM track GROUP BY chrom")
def array_lengths(spark, d):
    return A.chrom_lengths(track(spark, d))


# Regions.
@genome.add("counts_in_region", f"{ctes('reads', 'seg')}, {_SITES}, n AS (SELECT tx_id, CAST(sum(seg_end - seg_start) AS BIGINT) AS length FROM seg GROUP BY tx_id), h AS (SELECT tx_id, sum(value) AS v FROM c JOIN seg s ON {_IN} GROUP BY tx_id) SELECT tx_id, coalesce(v, 0) AS counts, coalesce(v, 0) / length AS counts_per_nucleotide, coalesce(v, 0) / length * 1000 * 1e6 / (SELECT sum(value) FROM c) AS rpkm, length FROM n LEFT JOIN h USING (tx_id)")
def counts_in_region(spark, d):
    return R.counts_in_region(sites(spark, d), exons(spark, d), "tx_id")


@genome.add("counts_in_region_masked", f"{ctes('reads', 'seg', 'masks')}, {_SITES}, p AS (SELECT DISTINCT tx_id, s.chrom, s.strand, unnest(range(seg_start, seg_end)) AS pos FROM seg s), u AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.chrom = p.chrom AND m.strand = p.strand AND p.pos >= m.start AND p.pos < m.end_)) SELECT tx_id, sum(coalesce(value, 0)) AS counts, sum(coalesce(value, 0)) / count(*) AS counts_per_nucleotide, sum(coalesce(value, 0)) / count(*) * 1000 * 1e6 / (SELECT sum(value) FROM c) AS rpkm, count(*) AS length FROM u LEFT JOIN c USING (chrom, strand, pos) GROUP BY tx_id")
def counts_in_region_masked(spark, d):
    return R.counts_in_region(sites(spark, d), exons(spark, d), "tx_id", masks(spark, d))


@genome.add("count_vectors", f"{ctes('reads', 'seg')}, {_SITES}, p AS (SELECT tx_id, s.chrom, s.strand, unnest(range(seg_start, seg_end)) AS pos FROM seg s) SELECT tx_id, string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY CASE WHEN p.strand = '-' THEN -pos ELSE pos END) AS vector FROM p LEFT JOIN c USING (chrom, strand, pos) GROUP BY tx_id")
def count_vectors(spark, d):
    v = R.count_vectors(sites(spark, d), transcripts(spark, d), "tx_id")
    return v.select("tx_id", F.array_join(F.transform("vector", lambda x: x.cast("bigint").cast("string")), ",").alias("vector"))


# Interval joins.
@genome.add("overlapping_genes", ctes("gene") + ", g2 AS (SELECT *, base AS s, base + 1180 AS e FROM gene) SELECT a.g AS g, b.g AS g_r FROM g2 a JOIN g2 b ON a.chrom = b.chrom AND a.strand = b.strand AND a.s < b.e AND b.s < a.e WHERE a.g < b.g")
def overlapping_genes(spark, d):
    g = view(spark, d, "gene").select("g", "chrom", "strand", F.col("base").alias("start"), (F.col("base") + 1180).alias("end"))
    return O.overlap_join(g, g).filter("g < g_r").select("g", "g_r")


@genome.add("antisense_reads", ctes("reads", "gene") + " SELECT g, count(*) AS n FROM gene JOIN reads r ON gene.chrom = r.chrom AND gene.strand <> r.strand AND r.start < base + 1180 AND base < r.start + r.rlen GROUP BY g")
def antisense_reads(spark, d):
    g = view(spark, d, "gene").select("g", "chrom", "strand", F.col("base").alias("start"), (F.col("base") + 1180).alias("end"))
    r = view(spark, d, "reads").select("chrom", "strand", "start", (F.col("start") + F.col("rlen")).alias("end"))
    return O.overlap_join(r, g, stranded=False).filter("strand <> strand_r").groupBy(F.col("g_r").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@genome.add("exons_in_masks", ctes("seg", "masks") + " SELECT tx_id, exon_no FROM seg s WHERE EXISTS (SELECT 1 FROM masks m WHERE m.chrom = s.chrom AND m.strand = s.strand AND m.start < seg_end AND seg_start < m.end_)")
def exons_in_masks(spark, d):
    s = view(spark, d, "seg").select("tx_id", "exon_no", "chrom", "strand", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    return O.overlap_join(s, masks(spark, d), how="left_semi").select("tx_id", "exon_no")


@genome.add("exons_without_masks", ctes("seg", "masks") + " SELECT tx_id, exon_no FROM seg s WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.chrom = s.chrom AND m.strand = s.strand AND m.start < seg_end AND seg_start < m.end_)")
def exons_without_masks(spark, d):
    s = view(spark, d, "seg").select("tx_id", "exon_no", "chrom", "strand", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    return O.overlap_join(s, masks(spark, d), how="left_anti").select("tx_id", "exon_no")


# Chains: coordinates, parts, relations.
_TX = "x AS (SELECT tx_id, gene_id, chrom, strand, exon_no, seg_start, seg_end, cds_start, cds_end, sum(seg_end - seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) - (seg_end - seg_start) AS off, sum(seg_end - seg_start) OVER (PARTITION BY tx_id) AS n FROM seg)"


@genome.add("chain_lengths", ctes("seg") + " SELECT tx_id, CAST(sum(seg_end - seg_start) AS BIGINT) AS length, min(seg_start) AS span_start, max(seg_end) AS span_end, concat(min(chrom), ':', string_agg(concat(seg_start, '-', seg_end), '^' ORDER BY seg_start), '(', min(strand), ')') AS region FROM seg GROUP BY tx_id")
def chain_lengths(spark, d):
    return transcripts(spark, d).select("tx_id", C.length("segments").alias("length"), C.span_start("segments").alias("span_start"), C.span_end("segments").alias("span_end"), C.to_text("chrom", "segments", "strand").alias("region"))


@genome.add("cds_coordinates", ctes("seg") + f", {_TX}, a AS (SELECT tx_id, strand, n, max(CASE WHEN cds_start >= seg_start AND cds_start < seg_end THEN off + cds_start - seg_start END) AS lo, max(CASE WHEN cds_end - 1 >= seg_start AND cds_end - 1 < seg_end THEN off + cds_end - 1 - seg_start END) AS hi FROM x GROUP BY tx_id, strand, n) SELECT tx_id, CAST(CASE WHEN strand = '-' THEN n - 1 - hi ELSE lo END AS BIGINT) AS cds_start, CAST(CASE WHEN strand = '-' THEN n - lo ELSE hi + 1 END AS BIGINT) AS cds_end FROM a")
def cds_coordinates(spark, d):
    b = C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end")
    return transcripts(spark, d).select("tx_id", b.alias("b")).select("tx_id", F.col("b.start").alias("cds_start"), F.col("b.end").alias("cds_end"))


_PARTS = "y AS (SELECT tx_id, strand, sum(greatest(0, least(seg_end, cds_start) - seg_start)) AS l, sum(greatest(0, least(seg_end, cds_end) - greatest(seg_start, cds_start))) AS c, sum(greatest(0, seg_end - greatest(seg_start, cds_end))) AS r FROM seg GROUP BY tx_id, strand)"


@genome.add("utr_lengths", ctes("seg") + f", {_PARTS} SELECT tx_id, CAST(CASE WHEN strand = '-' THEN r ELSE l END AS BIGINT) AS utr5, CAST(c AS BIGINT) AS cds, CAST(CASE WHEN strand = '-' THEN l ELSE r END AS BIGINT) AS utr3 FROM y")
def utr_lengths(spark, d):
    t = transcripts(spark, d).withColumn("b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    return t.select("tx_id", C.length(C.get_utr5("segments", "strand", "b")).alias("utr5"), C.length(C.get_cds("segments", "strand", "b")).alias("cds"), C.length(C.get_utr3("segments", "strand", "b")).alias("utr3"))


@genome.add("junction_list", ctes("seg") + " SELECT tx_id, seg_end AS left_end, nx AS right_start FROM (SELECT tx_id, seg_end, lead(seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) AS nx FROM seg) z WHERE nx IS NOT NULL")
def junction_list(spark, d):
    return transcripts(spark, d).select("tx_id", F.explode(C.junctions("segments")).alias("j")).select("tx_id", F.col("j.start").alias("left_end"), F.col("j.end").alias("right_start"))


@genome.add("subchain", ctes("seg") + f", {_TX}, z AS (SELECT *, CASE WHEN strand = '-' THEN n - 300 ELSE 100 END AS a, CASE WHEN strand = '-' THEN n - 100 ELSE 300 END AS b FROM x) SELECT tx_id, CAST(seg_start + greatest(a - off, 0) AS BIGINT) AS part_start, CAST(least(seg_end, seg_start + b - off) AS BIGINT) AS part_end FROM z WHERE least(seg_end, seg_start + b - off) > seg_start + greatest(a - off, 0)")
def subchain(spark, d):
    part = C.subchain("segments", "strand", F.lit(100), F.lit(300))
    return transcripts(spark, d).select("tx_id", F.explode(part).alias("s")).select("tx_id", F.col("s.start").alias("part_start"), F.col("s.end").alias("part_end"))


@genome.add("genomic_coordinates", ctes("seg") + f", {_TX} SELECT tx_id, q.q AS x, CAST(seg_start + (CASE WHEN strand = '-' THEN n - 1 - q.q ELSE q.q END) - off AS BIGINT) AS pos FROM x JOIN (SELECT unnest([0, 50, 222, 401]) AS q) q ON (CASE WHEN strand = '-' THEN n - 1 - q.q ELSE q.q END) >= off AND (CASE WHEN strand = '-' THEN n - 1 - q.q ELSE q.q END) < off + seg_end - seg_start")
def genomic_coordinates(spark, d):
    x = transcripts(spark, d).withColumn("x", F.explode(F.array(*[F.lit(v) for v in (0, 50, 222, 401)])))
    return x.select("tx_id", "x", C.genomic_coordinate("segments", "strand", "x").alias("pos"))


def _pairs(spark, d) -> DataFrame:
    """Pairs of transcripts with overlapping spans on one chrom, as structs a and b."""
    t = transcripts(spark, d)
    span = t.select("tx_id", "chrom", "strand", C.span_start("segments").alias("start"), C.span_end("segments").alias("end"), "segments")
    p = O.overlap_join(span, span, stranded=False).filter("tx_id <> tx_id_r")
    one = lambda s: F.struct(F.col(f"tx_id{s}").alias("tx_id"), F.col(f"chrom{s}").alias("chrom"), F.col(f"strand{s}").alias("strand"), F.col(f"segments{s}").alias("segments"))
    return p.select(one("").alias("a"), one("_r").alias("b"))


_OV = "p AS (SELECT a.tx_id AS a, b.tx_id AS b, min(a.strand) AS sa, min(b.strand) AS sb, count(*) FILTER (a.seg_start = b.seg_start AND a.seg_end = b.seg_end) AS shared, count(DISTINCT CASE WHEN b.seg_start >= a.seg_start AND b.seg_end <= a.seg_end THEN b.exon_no END) AS inside FROM seg a JOIN seg b ON a.chrom = b.chrom AND a.tx_id <> b.tx_id AND a.seg_start < b.seg_end AND b.seg_start < a.seg_end GROUP BY a.tx_id, b.tx_id)"


@genome.add("chain_relations", ctes("seg") + f", {_OV} SELECT a AS tx_a, b AS tx_b, sa = sb AS overlaps, sa <> sb AS antisense, CASE WHEN sa = sb THEN CAST(shared AS INTEGER) ELSE 0 END AS n_shared, sa = sb AND inside = 3 AS covers, sa = sb AND shared = 3 AS equal FROM p")
def chain_relations(spark, d):
    a, b = F.col("a"), F.col("b")
    p = _pairs(spark, d).filter(C.unstranded_overlaps(a, b))
    return p.select(F.col("a.tx_id").alias("tx_a"), F.col("b.tx_id").alias("tx_b"), C.overlaps(a, b).alias("overlaps"), C.antisense_overlaps(a, b).alias("antisense"), F.size(C.shared_segments(a, b)).alias("n_shared"), C.covers(a, b).alias("covers"), C.chains_equal(a, b).alias("equal"))


@genome.add("merged_segments", ctes("seg") + ", m AS (SELECT gene_id, seg_start, seg_end, max(seg_end) OVER (PARTITION BY gene_id ORDER BY seg_start, seg_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR seg_start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id ORDER BY seg_start, seg_end ROWS UNBOUNDED PRECEDING) AS z FROM m) SELECT gene_id, min(seg_start) AS seg_start, max(seg_end) AS seg_end FROM i GROUP BY gene_id, z")
def merged_segments(spark, d):
    g = exons(spark, d).groupBy("gene_id").agg(C.merge_segments(F.collect_list(C.segment("start", "end"))).alias("s"))
    return g.select("gene_id", F.explode("s").alias("s")).select("gene_id", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"))


@genome.add("stop_codons", ctes("seg") + " SELECT tx_id, CAST(CASE WHEN min(strand) = '-' THEN min(cds_start) - 3 ELSE min(cds_start) END AS BIGINT) AS cds_genome_start, CAST(CASE WHEN min(strand) = '-' THEN min(cds_end) ELSE min(cds_end) + 3 END AS BIGINT) AS cds_genome_end FROM seg GROUP BY tx_id")
def stop_codons(spark, d):
    """Coding bounds with the stop codon; here it never meets an intron."""
    x = transcripts(spark, d).select("tx_id", C.add_three_for_stop("segments", "strand", "cds_genome_start", "cds_genome_end").alias("x"))
    return x.select("tx_id", "x.cds_genome_start", "x.cds_genome_end")


@genome.add("masked_lengths", ctes("seg", "masks") + ", p AS (SELECT DISTINCT tx_id, s.chrom, s.strand, unnest(range(seg_start, seg_end)) AS pos FROM seg s) SELECT tx_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM masks m WHERE m.chrom = p.chrom AND m.strand = p.strand AND p.pos >= m.start AND p.pos < m.end_)) AS masked_length FROM p GROUP BY tx_id")
def masked_lengths(spark, d):
    """Length of each chain without its masks, by the row-local functions."""
    near = O.overlap_join(exons(spark, d), masks(spark, d).select("chrom", "strand", "start", "end")).groupBy("tx_id").agg(F.collect_set(C.segment("start_r", "end_r")).alias("m"))
    t = transcripts(spark, d).join(near, "tx_id", "left").withColumn("masks", C.add_masks("segments", C.no_segments(), F.coalesce("m", C.no_segments())))
    return t.select("tx_id", C.masked_length("segments", "masks").alias("masked_length"))


# Genes.
_MERGE = "e AS (SELECT DISTINCT a.gene_id AS a, b.gene_id AS b FROM seg a JOIN seg b ON a.chrom = b.chrom AND a.strand = b.strand AND a.seg_start = b.seg_start AND a.seg_end = b.seg_end), r AS (SELECT a AS n, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.n), k AS (SELECT n AS gene_id, min(top) AS top FROM r GROUP BY n), mg AS (SELECT gene_id, string_agg(gene_id, ',') OVER (PARTITION BY top ORDER BY gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS merged_gene FROM k)"


@genome.add("merge_genes", ctes("seg").replace("WITH", "WITH RECURSIVE", 1) + f", {_MERGE} SELECT gene_id, merged_gene FROM mg")
def merge_genes(spark, d):
    return G.merge_genes(exons(spark, d))


_MODELS = (
    _MERGE
    + """, sp AS (SELECT merged_gene, s.chrom, s.strand, s.tx_id, cds_start, cds_end, unnest(range(seg_start, seg_end)) AS pos FROM seg s JOIN mg USING (gene_id)),
lab AS (SELECT merged_gene, chrom, strand, pos, bool_or(pos >= cds_start AND pos < cds_end) AS c, bool_or(CASE WHEN strand = '-' THEN pos >= cds_end ELSE pos < cds_start END) AS u5, bool_or(CASE WHEN strand = '-' THEN pos < cds_start ELSE pos >= cds_end END) AS u3 FROM sp GROUP BY merged_gene, chrom, strand, pos),
sh AS (SELECT chrom, strand, pos FROM lab GROUP BY chrom, strand, pos HAVING count(*) > 1),
fl AS (SELECT lab.*, sh.pos IS NOT NULL OR EXISTS (SELECT 1 FROM masks m WHERE m.chrom = lab.chrom AND m.strand = lab.strand AND lab.pos >= m.start AND lab.pos < m.end_) AS off FROM lab LEFT JOIN sh ON sh.chrom = lab.chrom AND sh.strand = lab.strand AND sh.pos = lab.pos)"""
)


def _models(spark, d) -> DataFrame:
    return G.gene_models(transcripts(spark, d), G.merge_genes(exons(spark, d)), masks(spark, d))


@genome.add("gene_models", ctes("seg", "masks").replace("WITH", "WITH RECURSIVE", 1) + f", {_MODELS} SELECT merged_gene, count(*) FILTER (NOT off) AS exon_nt, count(*) FILTER (NOT off AND u5 AND NOT c AND NOT u3) AS utr5_nt, count(*) FILTER (NOT off AND c AND NOT u5 AND NOT u3) AS cds_nt, count(*) FILTER (NOT off AND u3 AND NOT c AND NOT u5) AS utr3_nt, count(*) FILTER (off) AS masked_nt, CAST(coalesce(sum(pos) FILTER (NOT off), 0) AS BIGINT) AS exon_sum FROM fl GROUP BY merged_gene")
def gene_models(spark, d):
    m = _models(spark, d)
    pos_sum = F.aggregate("exon", F.lit(0).cast("bigint"), lambda a, s: a + F.expr("0") + ((s["end"] - s["start"]) * (s["start"] + s["end"] - 1) / 2).cast("bigint"))
    return m.select("merged_gene", *[C.length(p).alias(f"{p}_nt") for p in ("exon", "utr5", "cds", "utr3", "masked")], pos_sum.alias("exon_sum"))


@genome.add("gene_counts", ctes("seg", "masks", "reads").replace("WITH", "WITH RECURSIVE", 1) + f", {_SITES}, {_MODELS}, v AS (SELECT fl.*, coalesce(value, 0) AS value FROM fl LEFT JOIN c USING (chrom, strand, pos)), w AS (SELECT merged_gene, " + ", ".join(f"coalesce(sum(value) FILTER ({f}), 0) AS {p}_reads, count(*) FILTER ({f}) AS {p}_length" for p, f in (("exon", "NOT off"), ("utr5", "NOT off AND u5 AND NOT c AND NOT u3"), ("cds", "NOT off AND c AND NOT u5 AND NOT u3"), ("utr3", "NOT off AND u3 AND NOT c AND NOT u5"))) + " FROM v GROUP BY merged_gene) SELECT merged_gene, " + ", ".join(f"{p}_reads, {p}_length, CASE WHEN {p}_length > 0 THEN {p}_reads / {p}_length * 1000 * 1e6 / (SELECT sum(value) FROM c) END AS {p}_rpkm" for p in ("exon", "utr5", "cds", "utr3")) + " FROM w")
def gene_counts(spark, d):
    g = G.gene_counts(sites(spark, d), _models(spark, d))
    return g.select("merged_gene", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c.endswith("rpkm") else F.col(c) for c in g.columns if c != "merged_gene"])


# Metagene profiles.
_WIN = f"""{_TX}, cb AS (SELECT tx_id, gene_id, chrom, strand, n, max(CASE WHEN strand = '-' THEN CASE WHEN cds_end - 1 >= seg_start AND cds_end - 1 < seg_end THEN n - 1 - (off + cds_end - 1 - seg_start) END ELSE CASE WHEN cds_start >= seg_start AND cds_start < seg_end THEN off + cds_start - seg_start END END) AS lm FROM x GROUP BY tx_id, gene_id, chrom, strand, n),
ix AS (SELECT *, unnest(range(-50, 50)) AS i FROM cb), po AS (SELECT ix.tx_id, ix.gene_id, ix.chrom, ix.strand, i, x.seg_start + (CASE WHEN ix.strand = '-' THEN ix.n - 1 - lm - i ELSE lm + i END) - off AS pos FROM ix JOIN x ON x.tx_id = ix.tx_id AND (CASE WHEN ix.strand = '-' THEN ix.n - 1 - lm - i ELSE lm + i END) >= off AND (CASE WHEN ix.strand = '-' THEN ix.n - 1 - lm - i ELSE lm + i END) < off + seg_end - seg_start),
wi AS (SELECT gene_id, chrom, strand, i AS x, CAST(min(pos) AS BIGINT) AS pos FROM po GROUP BY gene_id, chrom, strand, i HAVING count(*) = 2 AND min(pos) = max(pos))"""


@genome.add("metagene_windows", ctes("seg") + f", {_WIN} SELECT gene_id, chrom, strand, x, pos FROM wi")
def metagene_windows(spark, d):
    return MG.landmark_windows(transcripts(spark, d), "gene_id")


_VALUES = "va AS (SELECT gene_id, x, coalesce(value, 0) AS value FROM wi LEFT JOIN c USING (chrom, strand, pos)), de AS (SELECT gene_id, sum(value) AS dd, count(*) AS dn FROM va WHERE x >= -30 AND x < 20 GROUP BY gene_id HAVING sum(value) >= 1)"


@genome.add("metagene_profile", ctes("seg", "reads") + f", {_SITES}, {_WIN}, {_VALUES} SELECT x, round(quantile_cont(value / (dd / dn), 0.5), 9) AS metagene_average, count(*) AS regions_counted FROM va JOIN de USING (gene_id) GROUP BY x")
def metagene_profile(spark, d):
    return MG.profile(MG.window_values(MG.landmark_windows(transcripts(spark, d), "gene_id"), sites(spark, d), "gene_id"), "gene_id", min_counts=1).withColumn("metagene_average", F.round("metagene_average", 9))


@genome.add("metagene_rois", ctes("seg") + f", {_WIN} SELECT gene_id AS region_id, CAST(min(x) + 50 AS BIGINT) AS alignment_offset, 50 AS zero_point, 100 AS window_size, count(*) AS region_length, CAST(49 - max(x) AS BIGINT) AS threeprime_offset FROM wi GROUP BY gene_id")
def metagene_rois(spark, d):
    return MG.roi_table(MG.landmark_windows(transcripts(spark, d), "gene_id"), "gene_id").drop("region")


_RL = f"rl AS (SELECT rlen, chrom, strand, {_at('''CASE WHEN strand = '-' THEN rlen - 1 ELSE 0 END''')} AS pos FROM reads), cr AS (SELECT rlen, chrom, strand, pos, CAST(count(*) AS DOUBLE) AS value FROM rl GROUP BY rlen, chrom, strand, pos)"


def _by_length(spark, d) -> DataFrame:
    return A.count_positions(M.five_prime(0)(view(spark, d, "reads")), ["rlen"])


@genome.add("psite_offsets", ctes("seg", "reads") + f", {_WIN}, {_RL}, ag AS (SELECT rlen, x, sum(value) AS y FROM cr JOIN wi USING (chrom, strand, pos) GROUP BY rlen, x), bt AS (SELECT rlen, -arg_max(x, y * 1000 - x) AS o FROM ag GROUP BY rlen) SELECT CAST(l AS INTEGER) AS length, CAST(coalesce(o, 13) AS INTEGER) AS p_offset FROM (SELECT unnest(range(25, 36)) AS l) q LEFT JOIN bt ON bt.rlen = l")
def psite_offsets(spark, d):
    """Offsets from the summed profile of each read length."""
    w = MG.landmark_windows(transcripts(spark, d), "gene_id")
    p = _by_length(spark, d).join(w, ["chrom", "strand", "pos"]).groupBy("rlen", "x").agg(F.sum("value").alias("metagene_average"))
    return MG.psite_offsets(p, list(range(25, 36)))


@genome.add("phase_by_size", ctes("seg", "reads") + f", {_RL}, cd AS (SELECT tx_id, chrom, strand, greatest(seg_start, cds_start) AS a, least(seg_end, cds_end) AS b FROM seg WHERE greatest(seg_start, cds_start) < least(seg_end, cds_end)), co AS (SELECT *, sum(b - a) OVER (PARTITION BY tx_id ORDER BY a) - (b - a) AS off, sum(b - a) OVER (PARTITION BY tx_id) AS n FROM cd), hi AS (SELECT rlen, value, n, CASE WHEN co.strand = '-' THEN n - 1 - (off + pos - a) ELSE off + pos - a END AS o FROM cr JOIN co ON cr.chrom = co.chrom AND cr.strand = co.strand AND pos >= a AND pos < b), ok AS (SELECT * FROM hi WHERE o >= 15 AND o < 3 * (floor(n / 3) - 5)) SELECT rlen AS read_length, sum(value) AS reads_counted, sum(value) / (SELECT sum(value) FROM ok) AS fraction_reads_counted, " + ", ".join(f"coalesce(sum(value) FILTER (o % 3 = {p}), 0) / sum(value) AS phase{p}" for p in range(3)) + " FROM ok GROUP BY rlen")
def phase_by_size(spark, d):
    t = transcripts(spark, d).withColumn("b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    return MG.phase_by_size(_by_length(spark, d), t.select("tx_id", "chrom", "strand", C.get_cds("segments", "strand", "b").alias("segments")), "tx_id")


# Coding parts of windows around coding starts: from the landmark on, the last codon left out.
_CDS_BY = f"{_RL}, le AS (SELECT gene_id, max(x) + 1 AS n FROM wi GROUP BY gene_id), hi AS (SELECT rlen, value, n, x AS o FROM cr JOIN wi USING (chrom, strand, pos) JOIN le USING (gene_id) WHERE x >= 0), ok AS (SELECT * FROM hi WHERE o >= 15 AND o < 3 * (floor(n / 3) - 1)) SELECT rlen AS read_length, sum(value) AS reads_counted, sum(value) / (SELECT sum(value) FROM ok) AS fraction_reads_counted, " + ", ".join(f"coalesce(sum(value) FILTER (o % 3 = {p}), 0) / sum(value) AS phase{p}" for p in range(3)) + " FROM ok GROUP BY rlen"


# Junctions and sequence.
@genome.add("find_junctions", ctes("seg") + ", z AS (SELECT tx_id, chrom, strand, seg_start, seg_end, lead(seg_start) OVER w AS ns, lead(seg_end) OVER w AS ne FROM seg WINDOW w AS (PARTITION BY tx_id ORDER BY seg_start)), y AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, seg_end, ns ORDER BY tx_id) AS r FROM z WHERE ns IS NOT NULL) SELECT chrom, seg_end AS \"left\", ns AS \"right\", strand, seg_start AS exon_start, ne AS exon_end FROM y WHERE r = 1")
def find_junctions(spark, d):
    return J.find_junctions(transcripts(spark, d), "tx_id")


@genome.add("kmer_repeats", ctes("genome") + f", t AS (SELECT chrom, tile_no, seq || coalesce(lead(seq) OVER (PARTITION BY chrom ORDER BY tile_no), '') AS long FROM genome), k AS (SELECT chrom, tile_no * {TILE} + i AS pos, substr(long, i + 1, 10) AS kmer FROM (SELECT *, unnest(range({TILE})) AS i FROM t) z WHERE length(substr(long, i + 1, 10)) = 10), c AS (SELECT *, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS c, kmer = reverse(translate(kmer, 'ACGT', 'TGCA')) AS own FROM k), n AS (SELECT c, sum(CASE WHEN own THEN 2 ELSE 1 END) AS n FROM c GROUP BY c HAVING sum(CASE WHEN own THEN 2 ELSE 1 END) > 1) SELECT chrom, count(*) AS n_repeated, CAST(sum(pos) AS BIGINT) AS pos_sum FROM c JOIN n USING (c) GROUP BY chrom")
def kmer_repeats(spark, d):
    """Positions whose 10-mer occurs elsewhere on either strand, summed up per chrom."""
    return K.repeat_sums(K.repeat_runs(view(spark, d, "genome"), 10, TILE))


@genome.add("crossmap_masks", ctes("genome") + f", t AS (SELECT chrom, tile_no, seq || coalesce(lead(seq) OVER (PARTITION BY chrom ORDER BY tile_no), '') AS long FROM genome), k AS (SELECT chrom, tile_no * {TILE} + i AS pos, substr(long, i + 1, 10) AS kmer FROM (SELECT *, unnest(range({TILE})) AS i FROM t) z WHERE length(substr(long, i + 1, 10)) = 10), c AS (SELECT *, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS c, kmer = reverse(translate(kmer, 'ACGT', 'TGCA')) AS own FROM k), n AS (SELECT c, sum(CASE WHEN own THEN 2 ELSE 1 END) AS n FROM c GROUP BY c HAVING sum(CASE WHEN own THEN 2 ELSE 1 END) > 1), u AS (SELECT DISTINCT chrom, pos FROM c JOIN n USING (c)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM u), m AS (SELECT chrom, min(pos) AS s, max(pos) + 1 AS e FROM g GROUP BY chrom, g) SELECT chrom, '+' AS strand, s + 4 AS start, e + 4 AS \"end\" FROM m UNION ALL SELECT chrom, '-', s + 5, e + 5 FROM m")
def crossmap_masks(spark, d):
    return K.repeat_masks(K.repeat_runs(view(spark, d, "genome"), 10, TILE), 10, 4)


@genome.add("chain_sequences", ctes("genome", "seg") + f", p AS (SELECT tx_id, strand, chrom, unnest(range(seg_start, seg_end)) AS pos FROM seg), b AS (SELECT tx_id, p.strand, pos, coalesce(substr(seq, CAST(pos % {TILE} + 1 AS INTEGER), 1), 'N') AS b FROM p LEFT JOIN genome g ON g.chrom = p.chrom AND g.tile_no = CAST((pos - pos % {TILE}) / {TILE} AS BIGINT)) SELECT tx_id, md5(string_agg(CASE WHEN strand = '-' THEN translate(b, 'ACGT', 'TGCA') ELSE b END, '' ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END)) AS digest FROM b GROUP BY tx_id")
def chain_sequences(spark, d):
    return S.segment_sequences(view(spark, d, "genome"), exons(spark, d), TILE, "tx_id").select("tx_id", F.md5("seq").alias("digest"))


@genome.add("junction_slides", ctes("genome", "seg") + f""", z AS (SELECT DISTINCT chrom, strand, seg_end AS l, ns AS r FROM (SELECT *, lead(seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) AS ns FROM seg) y WHERE ns IS NOT NULL),
b AS (SELECT chrom, tile_no * {TILE} + i AS pos, substr(seq, i + 1, 1) AS b FROM (SELECT *, unnest(range({TILE})) AS i FROM genome) g),
k AS (SELECT chrom, strand, l, r, d FROM z CROSS JOIN (SELECT unnest(range(10)) AS d) q),
p AS (SELECT k.*, coalesce(x.b = y.b, FALSE) AS up FROM k LEFT JOIN b x ON x.chrom = k.chrom AND x.pos = l + d LEFT JOIN b y ON y.chrom = k.chrom AND y.pos = r + d),
m AS (SELECT k.*, coalesce(x.b = y.b, FALSE) AS dn FROM k LEFT JOIN b x ON x.chrom = k.chrom AND x.pos = l - 1 - d LEFT JOIN b y ON y.chrom = k.chrom AND y.pos = r - 1 - d)
SELECT chrom, strand, l AS "left", r AS "right", CAST(-(SELECT coalesce(min(m.d), 10) FROM m WHERE m.chrom = z.chrom AND m.strand = z.strand AND m.l = z.l AND m.r = z.r AND NOT dn) AS INTEGER) AS minus, CAST((SELECT coalesce(min(p.d), 10) FROM p WHERE p.chrom = z.chrom AND p.strand = z.strand AND p.l = z.l AND p.r = z.r AND NOT up) AS INTEGER) AS plus FROM z""")
def junction_slides(spark, d):
    """How far each junction slides without a change of sequence."""
    j = J.find_junctions(transcripts(spark, d), "tx_id").withColumn("key", F.struct("chrom", "left", "right", "strand"))
    around = j.select("key", "chrom", F.lit("+").alias("strand"), F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("at")), F.struct(F.lit("r").alias("side"), F.col("right").alias("at")))).alias("x"))
    ends = around.select(F.struct("key", "x.side").alias("k"), "chrom", "strand", (F.col("x.at") - 10).alias("start"), (F.col("x.at") + 10).alias("end"))
    seqs = S.segment_sequences(view(spark, d, "genome"), ends, TILE, "k").select("k.key", "k.side", "seq")
    two = seqs.groupBy("key").agg(F.max(F.when(F.col("side") == "l", F.col("seq"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("seq"))).alias("r"))
    half = lambda c, first: F.substring(c, 1, 10) if first else F.substring(c, 11, 10)
    # Unknown nucleotides match nothing: on one side they are read as another letter.
    x = F.translate(F.col("r"), "N", "n")
    span = J.match_range(half(F.col("l"), True), half(F.col("l"), False), half(x, True), half(x, False), 10)
    return two.select("key.*", span.alias("s")).select("chrom", "strand", "left", "right", "s.minus", "s.plus")


# Statistics between samples: return flags of the line items stand for libraries.
_SAMPLES = "sc AS (SELECT l_returnflag AS sample, concat('g', CAST(CAST((l_partkey - l_partkey % 2) / 2 AS BIGINT) AS VARCHAR)) AS region, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2), pr AS (SELECT x.sample AS sample_a, y.sample AS sample_b, x.region, x.v AS a, y.v AS b FROM sc x JOIN sc y ON x.region = y.region AND x.sample < y.sample)"


def _samples(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    g = F.concat(F.lit("g"), F.expr("CAST((l_partkey - l_partkey % 2) / 2 AS BIGINT)").cast("string"))
    s = li.groupBy(F.col("l_returnflag").alias("sample"), g.alias("region")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))
    return T.sample_pairs(s, "region", "sample", "v")


def _compare(by: str, where: str) -> str:
    keys = "sample_a, sample_b" + by
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    return f"rk AS (SELECT *, {rank('a')} AS ra, {rank('b')} AS rb, CASE WHEN a > 0 AND b > 0 THEN log2(b / a) END AS lr FROM bn WHERE {where}), st AS (SELECT {keys}, count(*) AS n, corr(a, b) AS p, corr(ra, rb) AS s, avg(lr) AS m, stddev_pop(lr) AS d FROM rk GROUP BY {keys})"


@genome.add("compare_samples", f"WITH {_SAMPLES}, bn AS (SELECT * FROM pr), {_compare('', 'a + b >= 128')} SELECT sample_a, sample_b, n, round(p, 8) AS pearsonr, round(s, 8) AS spearmanr, round(m, 8) AS log2_mean, round(d, 8) AS log2_std, round(pow(2, 3 * d), 6) AS three_sigma FROM st")
def compare_samples(spark, d):
    c = T.compare_samples(_samples(spark, d))
    return c.select("sample_a", "sample_b", "n", *[F.round(x, 8).alias(x) for x in ("pearsonr", "spearmanr", "log2_mean", "log2_std")], F.round("three_sigma", 6).alias("three_sigma"))


@genome.add("binned_statistics", f"WITH {_SAMPLES}, bn AS (SELECT *, CASE " + " ".join(f"WHEN a + b >= {b} THEN {b}" for b in reversed(T.BINS)) + f" END AS bin FROM pr), {_compare(', bin', 'TRUE')} SELECT sample_a, sample_b, bin, n, CASE WHEN n > 2 THEN round(p, 8) END AS pearsonr, CASE WHEN n > 2 THEN round(s, 8) END AS spearmanr, round(m, 8) AS log2_mean, round(d, 8) AS log2_std FROM st")
def binned_statistics(spark, d):
    c = T.binned_statistics(_samples(spark, d))
    return c.select("sample_a", "sample_b", "bin", "n", *[F.round(x, 8).alias(x) for x in ("pearsonr", "spearmanr", "log2_mean", "log2_std")])


@genome.add("table_differences", ctes("reads", "seg") + f", {_SITES} SELECT chrom, strand, pos, 'value' AS differing FROM c WHERE value > 1")
def table_differences(spark, d):
    """Sites at which a table and a changed copy of it differ."""
    s = sites(spark, d)
    return T.table_differences(s, s.withColumn("value", F.when(F.col("value") > 1, F.col("value") + 0.5).otherwise(F.col("value") + 1e-10)), ["chrom", "strand", "pos"]).withColumn("differing", F.array_join("differing", ","))


# Annotation tables.
_GTF = """i AS (SELECT *, url_decode(regexp_replace(transcript_id, '^[\\s"]+|[\\s"]+$', '', 'g')) AS t FROM gtf2),
f AS (SELECT DISTINCT gtf_id, coalesce(a.chrom, seqname) AS chrom, feature_type, seg_start - 1 AS s, seg_end AS e, strand, t FROM i LEFT JOIN chrom_aliases a ON seqname = chrom_alias WHERE lower(trim(t)) NOT IN ('', '.', 'na', 'nan', 'none') AND seg_end >= seg_start AND feature_type IN ('exon', '5UTR', '3UTR', 'CDS', 'start_codon', 'stop_codon'))"""


@genome.add("assemble_transcripts", f"WITH {_GTF}, u AS (SELECT t FROM f GROUP BY t HAVING min(chrom) = max(chrom) AND coalesce(min(strand) = max(strand), TRUE)), p AS (SELECT DISTINCT t, unnest(range(s, e)) AS pos FROM f WHERE t IN (SELECT t FROM u)), n AS (SELECT t, count(*) AS length FROM p GROUP BY t), c AS (SELECT t, min(s) AS lo, max(e) AS hi FROM f WHERE feature_type IN ('CDS', 'start_codon', 'stop_codon') GROUP BY t) SELECT t AS transcript_id, length, lo AS cds_genome_start, hi AS cds_genome_end FROM n LEFT JOIN c USING (t)")
def assemble_transcripts(spark, d):
    g = load(spark, d, "gtf2").withColumn("transcript_id", clean_id("transcript_id"))
    g = with_reported_chrom(g.withColumnRenamed("seqname", "chrom"), load(spark, d, "chrom_aliases"))
    ok, _ = N.assemble_transcripts(g.select("transcript_id", "gene_id", "chrom", "strand", "feature_type", (F.col("seg_start") - 1).alias("start"), F.col("seg_end").alias("end")))
    return ok.select("transcript_id", C.length("segments").alias("length"), "cds_genome_start", "cds_genome_end")


@genome.add("gff_parent_types", r"""WITH r AS (SELECT DISTINCT record_id, feature_type, nullif(url_decode(trim(gff_id)), '') AS id, trim(parent, E' \t') AS p FROM gff3), i AS (SELECT record_id, feature_type, id, CASE WHEN p IS NULL OR p IN ('', '.') THEN [] ELSE list_transform(regexp_extract_all(p, '"[^"]*"|[A-Za-z0-9:._%-]+'), lambda x: url_decode(trim(trim(x, '"')))) END AS ps FROM r), ty AS (SELECT id, min(feature_type) AS pt FROM i WHERE id IS NOT NULL GROUP BY id) SELECT i.feature_type, CASE WHEN len(ps) = 0 THEN 'parent unspecified' WHEN len(ps) > 1 THEN 'multiple parents' ELSE coalesce(pt, 'parent not in database') END AS parent_type, count(*) AS n FROM i LEFT JOIN ty ON len(ps) = 1 AND ty.id = ps[1] GROUP BY 1, 2""")
def gff_parent_types(spark, d):
    from strandloom.operators.packed import split_packed

    rows = load(spark, d, "gff3").select("record_id", "feature_type", "gff_id", "parent").distinct()
    parents = split_packed(rows.select("record_id", "parent"), "parent", "id").groupBy("record_id").agg(F.collect_list("item_text").alias("parents"))
    node = percent_decoded(F.trim("gff_id"))
    return N.parent_types(rows.join(parents, "record_id", "left").withColumn("id", F.when(node != "", node)))
