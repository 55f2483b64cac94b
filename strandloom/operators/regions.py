"""Regions against sites: counts, vectors, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.arrays import SITE
from strandloom.operators.overlap import overlap_join, position_join
from strandloom.operators.periods import periods_and_gaps
from strandloom.session import materialize


def masked_parts(segs: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """(key, start, end): what of each region's segments is masked, overlapping masks counted once."""
    hit = overlap_join(segs, masks.select("chrom", "strand", "start", "end"))
    cut = hit.select(key, F.greatest("start", "start_r").alias("s"), F.least("end", "end_r").alias("e"))
    return periods_and_gaps(cut, [key], "s", "e").filter("found_kind = 'period'").select(key, F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))


def unmasked_sites(counts: DataFrame, masks: DataFrame) -> DataFrame:
    """Sites outside every mask."""
    hit = position_join(counts.select(*SITE), masks.select("chrom", "strand", "start", "end")).select(*SITE).distinct()
    return counts.join(hit, SITE, "left_anti")


def region_lengths(segs: DataFrame, key: str, masks: DataFrame | None = None) -> DataFrame:
    """(key, length): nucleotides of each region that are not masked."""
    n = segs.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    if masks is None:
        return n
    m = masked_parts(segs, masks, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("__m"))
    return n.join(m, key, "left").select(key, (F.col("length") - F.coalesce("__m", F.lit(0))).alias("length"))


def counts_in_region(counts: DataFrame, segs: DataFrame, key: str, masks: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """Per region: ``counts``, ``counts_per_nucleotide``, ``rpkm``, ``length``.

    ``counts`` are sites with values, ``segs`` one row per segment (key, chrom, strand, start, end). Masked positions leave
    numerator and length. A region without sites has 0; a region of length 0 has NaN per nucleotide. ``total`` is the
    library's size for RPKM, by default the sum of the sites. Sites are summed before the join, so the join carries one row
    per site, and regions are summed per map task before the last shuffle.
    """
    if total is None:
        # The sites are read for their sum and for the join; they are made once.
        counts = materialize(counts, "sites")
    t = F.lit(float(total)) if total is not None else counts.agg(F.sum("value").cast("double").alias("t")).scalar()
    sites = counts if masks is None else unmasked_sites(counts, masks)
    got = position_join(sites, segs.select(key, "chrom", "strand", "start", "end")).groupBy(F.col(f"{key}_r").alias(key)).agg(F.sum("value").alias("counts"))
    c = F.coalesce(F.col("counts"), F.lit(0)).cast("double")
    per = F.coalesce(F.try_divide(c, F.col("length")), F.lit(float("nan")))
    return region_lengths(segs, key, masks).join(got, key, "left").select(key, c.alias("counts"), per.alias("counts_per_nucleotide"), F.try_divide(per * 1000.0 * 1e6, t).alias("rpkm"), "length")


def region_sites(counts: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """Sites inside chains with their place in the chain, from the 5' end: key, off, value, pos. ``chains`` has segments as arrays."""
    long = chains.select(key, "chrom", "strand", C.length("segments").alias("n"), F.explode(C.offsets("segments")).alias("s")).select(key, "chrom", "strand", "n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.off").alias("off"))
    hit = position_join(counts, long)
    at = F.col("off_r") + F.col("pos") - F.col("start_r")
    return hit.select(F.col(f"{key}_r").alias(key), F.when(F.col("strand_r") == "-", F.col("n_r") - 1 - at).otherwise(at).alias("off"), "value", "pos", F.col("strand_r").alias("strand"))


def track_vectors(runs: DataFrame, chains: DataFrame, key: str, fill: float = float("nan")) -> DataFrame:
    """(key, ``vector``): the values of a track without strand (chrom, start, end, value) along each chain from its 5' end, ``fill`` where it has none.

    Runs are cut to the chains' segments before they are laid out, so what is expanded is no more than the chains are long.
    """
    segs = chains.select("chrom", "strand", F.explode("segments").alias("s")).select("chrom", "strand", "s.start", "s.end").distinct()
    met = overlap_join(runs.withColumn("strand", F.lit(".")), segs).filter("end > start")
    cut = met.select("chrom", F.col("strand_r").alias("strand"), F.greatest("start", "start_r").alias("a"), F.least("end", "end_r").alias("b"), "value")
    sites = cut.select("chrom", "strand", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("pos"), "value").distinct()
    return count_vectors(sites, chains, key, fill)


def count_vectors(counts: DataFrame, chains: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """(key, ``vector``): the values along each chain from its 5' end, absent sites ``fill``."""
    got = region_sites(counts, chains, key).groupBy(key, "off").agg(F.sum("value").cast("double").alias("value")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("v"))
    zeros = lambda n: F.array_repeat(F.lit(float(fill)), n.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(F.get(F.col("v"), i - 1)["off"])
    filled = F.flatten(F.transform("v", lambda x, i: F.concat(zeros(x["off"] - before(i) - 1), F.array(x["value"]))))
    tail = F.col("n") - 1 - F.element_at("v", -1)["off"]
    return chains.select(key, C.length("segments").alias("n")).join(got, key, "left").select(key, F.when(F.col("v").isNull(), zeros(F.col("n"))).otherwise(F.concat(filled, zeros(tail))).alias("vector"))


def reads_in_regions(mapped: DataFrame, segs: DataFrame, key: str) -> DataFrame:
    """Mapped reads whose position lies in a region, with the region's key; a read that lies in several comes out for each."""
    # Segments of a region that overlap would report a read twice, so they are united; equal reads stay as many as they are.
    whole = segs.groupBy(key, "chrom", "strand").agg(C.merge_segments(F.collect_set(C.segment("start", "end"))).alias("s")).select(key, "chrom", "strand", F.explode("s").alias("s")).select(key, "chrom", "strand", "s.start", "s.end")
    return position_join(mapped, whole).select(*mapped.columns, F.col(f"{key}_r").alias(key))
