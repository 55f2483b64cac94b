"""Gene models: genes that share exons merged, positions that belong to one gene and one part only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.overlap import overlap_join
from strandloom.operators.skew import salted_join
from strandloom.session import discard, materialize_counting


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for nodes with a smaller one in their component; alternating large and small stars. Hubs of large stars are spread over tasks."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    cur, seen = materialize_counting(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", {"n": F.count(F.lit(1))})
    mark = None
    while True:
        n = 2 * seen["n"]
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, m, "u", rows=n).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", rows=n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, seen = materialize_counting(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))})
        discard(cur)
        cur = nxt
        if seen == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def merge_sets(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(root, items): sets that share an item, directly or through others, united. ``key`` names the sets, ``items`` is an array."""
    flat = sets.select(F.concat(F.lit("s"), F.col(key).cast("string")).alias("s"), F.explode(items).alias("i"))
    edges = flat.select("s", F.concat(F.lit("i"), F.col("i").cast("string")).alias("t"))
    root = components(edges, "s", "t")
    return flat.join(root, flat.s == root.node, "left").groupBy(F.coalesce("root", "s").alias("root")).agg(F.array_sort(F.collect_set("i")).alias(items))


def merge_genes(exons: DataFrame) -> DataFrame:
    """(gene_id, merged_gene): genes that share an identical exon, directly or through others, get the sorted list of their names. ``exons``: gene_id, chrom, strand, start, end."""
    one = exons.groupBy("chrom", "strand", "start", "end").agg(F.min("gene_id").alias("a"))
    pairs = exons.select("gene_id", "chrom", "strand", "start", "end").distinct().join(one, ["chrom", "strand", "start", "end"]).filter("gene_id <> a").select("a", F.col("gene_id").alias("b")).distinct()
    root = components(pairs, "a", "b")
    every = exons.select(F.col("gene_id").alias("node")).distinct().join(root, "node", "left").select(F.col("node").alias("gene_id"), F.coalesce("root", "node").alias("root"))
    names = every.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("gene_id")), ",").alias("merged_gene"))
    return every.join(names, "root").select("gene_id", "merged_gene")


def gene_models(transcripts: DataFrame, merged: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Per merged gene: ``exon, utr5, cds, utr3, masked`` as segment arrays, and chrom, strand.

    ``transcripts``: gene_id, chrom, strand, segments, cds_genome_start, cds_genome_end. ``exon`` is the union of the transcripts'
    positions; what other merged genes on the strand share, and masks, is ``masked`` and in no part. A part keeps the
    positions that carry no other label in any transcript. All of it is interval arithmetic; nothing is expanded to positions.
    """
    t = transcripts.join(merged, "gene_id").withColumn("b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    parts = t.select("merged_gene", "chrom", "strand", "segments", C.get_utr5("segments", "strand", "b").alias("u5"), C.get_cds("segments", "strand", "b").alias("cds"), C.get_utr3("segments", "strand", "b").alias("u3"))
    union = lambda c: C.merge_segments(F.flatten(F.collect_list(c))).alias(c)
    genes = parts.groupBy("merged_gene", "chrom", "strand").agg(union("segments"), union("u5"), union("cds"), union("u3"))
    long = genes.select("merged_gene", "chrom", "strand", F.explode("segments").alias("s")).select("merged_gene", "chrom", "strand", "s.start", "s.end")
    others = overlap_join(long, long).filter("merged_gene <> merged_gene_r").select("merged_gene", "chrom", "strand", F.col("start_r").alias("start"), F.col("end_r").alias("end"))
    if masks is not None:
        hit = overlap_join(long, masks.select("chrom", "strand", "start", "end"))
        others = others.unionByName(hit.select("merged_gene", "chrom", "strand", F.col("start_r").alias("start"), F.col("end_r").alias("end")))
    # No more segments per gene than neighbours overlap its locus.
    off = others.groupBy("merged_gene", "chrom", "strand").agg(C.merge_segments(F.collect_set(C.segment("start", "end"))).alias("off"))
    g = genes.join(off, ["merged_gene", "chrom", "strand"], "left").withColumn("off", F.coalesce("off", C.no_segments()))
    only = lambda x, y, z: C.subtract(C.subtract(C.subtract(F.col(x), F.col(y)), F.col(z)), F.col("off"))
    return g.select("merged_gene", "chrom", "strand", C.subtract("segments", "off").alias("exon"), only("u5", "cds", "u3").alias("utr5"), only("cds", "u5", "u3").alias("cds"), only("u3", "u5", "cds").alias("utr3"), C.intersect("segments", "off").alias("masked"))


def gene_counts(counts: DataFrame, models: DataFrame, total: float | None = None) -> DataFrame:
    """Per merged gene and part (exon, utr5, cds, utr3): reads, length, rpkm, as columns."""
    from strandloom.operators.regions import counts_in_region

    parts = ["exon", "utr5", "cds", "utr3"]
    rows = models.select("merged_gene", "chrom", "strand", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("segs")) for p in parts])).alias("x"))
    segs = rows.select(F.struct("merged_gene", "x.part").alias("key"), "chrom", "strand", F.explode("x.segs").alias("s")).select("key", "chrom", "strand", "s.start", "s.end")
    got = counts_in_region(counts, segs, "key", total=total)
    cols = []
    for p in parts:
        here = F.col("key.part") == p
        cols += [F.coalesce(F.sum(F.when(here, F.col("counts"))), F.lit(0.0)).alias(f"{p}_reads"), F.coalesce(F.sum(F.when(here, F.col("length"))), F.lit(0)).alias(f"{p}_length"), F.coalesce(F.max(F.when(here, F.col("rpkm"))), F.lit(float("nan"))).alias(f"{p}_rpkm")]
    return models.select("merged_gene").join(got.withColumn("merged_gene", F.col("key.merged_gene")), "merged_gene", "left").groupBy("merged_gene").agg(*cols)
