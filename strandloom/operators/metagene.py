"""Windows around landmarks and profiles over them; P-site offsets; sub-codon phasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.overlap import position_join
from strandloom.session import materialize
from strandloom.tables import maybe_broadcast


def landmark_windows(transcripts: DataFrame, group: str, landmark: str = "cds_start", upstream: int = 50, downstream: int = 50) -> DataFrame:
    """Per group the largest window around the landmark in which all transcripts agree: one row per position.

    Result: group, chrom, strand, ``x`` (distance from the landmark, 5' to 3'), ``pos``. Groups whose transcripts differ in the landmark's position,
    chrom or strand have no window; transcripts without a coding region take their group out, as in agreement
    there is none. ``transcripts``: group, chrom, strand, segments, cds_genome_start, cds_genome_end.
    """
    if landmark not in ("cds_start", "cds_stop"):
        raise ValueError(f"landmark {landmark!r} is none of cds_start, cds_stop")
    b = C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end")
    t = transcripts.withColumn("b", b).withColumn("at", F.col("b.start") if landmark == "cds_start" else F.col("b.end") - 3)
    t = t.withColumn("ref", C.genomic_coordinate("segments", "strand", "at"))
    per = t.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("ref").alias("coding"), F.min("ref").alias("lo"), F.max("ref").alias("hi"), F.min("chrom").alias("c0"), F.max("chrom").alias("c1"), F.min("strand").alias("s0"), F.max("strand").alias("s1"))
    per = per.filter("n = coding and lo = hi and c0 = c1 and s0 = s1").select(group, "n")
    # One window per transcript, laid out from its 5' end; no coordinate is looked up per position.
    w = t.join(per, group).select(group, "chrom", "strand", "n", C.window_landmark("segments", "strand", "at", upstream, downstream).alias("w"))
    laid = w.withColumn("p", C.positions("w.segments")).select(group, "chrom", "strand", "n", F.col("w.offset").alias("o"), F.posexplode_outer(F.when(F.col("strand") == "-", F.reverse("p")).otherwise(F.col("p"))).alias("i", "pos"))
    at = laid.filter("pos is not null").withColumn("x", F.col("o") + F.col("i") - upstream)
    agreed = at.groupBy(group, "chrom", "strand", "x").agg(F.count(F.lit(1)).alias("seen"), F.min("pos").alias("pos"), F.max("pos").alias("top"), F.max("n").alias("n"))
    return agreed.filter("seen = n and pos = top").select(group, "chrom", "strand", "x", "pos")


def roi_table(windows: DataFrame, group: str, upstream: int = 50, downstream: int = 50) -> DataFrame:
    """One row per group: region text, alignment_offset, zero_point, window_size, region_length, threeprime_offset."""
    g = windows.groupBy(group, "chrom", "strand").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), C.from_positions(F.collect_list("pos")).alias("segments"))
    return g.select(
        F.col(group).alias("region_id"),
        C.to_text("chrom", "segments", "strand").alias("region"),
        (F.col("x0") + upstream).alias("alignment_offset"),
        F.lit(upstream).alias("zero_point"),
        F.lit(upstream + downstream).alias("window_size"),
        C.length("segments").alias("region_length"),
        (F.lit(downstream) - 1 - F.col("x1")).alias("threeprime_offset"),
    )


def window_values(windows: DataFrame, counts: DataFrame, group: str, masks: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Every window position with its value, absent sites 0; masked positions left out. ``by``: further key columns of counts (read lengths)."""
    w = windows
    if masks is not None:
        hit = position_join(w.select("chrom", "strand", "pos"), masks.select("chrom", "strand", "start", "end")).select("chrom", "strand", "pos").distinct()
        w = w.join(hit, ["chrom", "strand", "pos"], "left_anti")
    by = by or []
    if by:
        w = w.crossJoin(maybe_broadcast(counts.select(*by).distinct()))  # read lengths: as many as reads have lengths
    return w.join(counts, [*by, "chrom", "strand", "pos"], "left").select(*by, group, "x", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def profile(values: DataFrame, group: str, normalize_over: tuple[int, int] = (-30, 20), min_counts: float = 10, by: list[str] | None = None, mean: bool = False) -> DataFrame:
    """Per position: ``metagene_average`` and ``regions_counted``.

    A window's values are divided by their mean over ``normalize_over`` (half-open, relative to the landmark); windows with fewer than
    ``min_counts`` there, or none, are left out. The average is the exact median, or the mean.
    """
    by = by or []
    inside = (F.col("x") >= normalize_over[0]) & (F.col("x") < normalize_over[1])
    denominator = values.groupBy(*by, group).agg(F.sum(F.when(inside, F.col("value"))).alias("d"), F.count(F.when(inside, 1)).alias("n")).filter((F.col("d") >= min_counts) & (F.col("d") > 0))
    v = values.join(denominator, [*by, group]).withColumn("v", F.col("value") / (F.col("d") / F.col("n")))
    return v.groupBy(*by, "x").agg((F.avg("v") if mean else F.percentile("v", 0.5)).alias("metagene_average"), F.count("v").alias("regions_counted"))


def psite_offsets(profiles: DataFrame, lengths: list[int], default: int = 13, window: tuple[int, int] | None = None, require_upstream: bool = False) -> DataFrame:
    """(``length``, ``p_offset``): minus the first greatest position of each read length's profile, the default where there is no signal."""
    p = profiles
    if window:
        p = p.filter(F.col("x").between(window[0], window[1]))
    if require_upstream:
        p = p.filter(F.col("x") < 0)
    best = p.filter("metagene_average > 0").groupBy("rlen").agg(F.max_by(-F.col("x"), F.struct("metagene_average", -F.col("x"))).alias("o"))
    spark = profiles.sparkSession
    every = spark.createDataFrame([(int(n),) for n in lengths], "length int")
    return every.join(best, every.length == best.rlen, "left").select("length", F.coalesce("o", F.lit(default)).cast("int").alias("p_offset"))


def roi_coding_part(segments: Column | str, strand: Column | str, alignment_offset: Column | str, zero_point: Column | str) -> Column:
    """The coding part of a window around a coding start: from the landmark to the window's 3' end."""
    return C.subchain(segments, strand, C.col(zero_point) - C.col(alignment_offset), C.length(segments))


def normalization_window(zero_point: int, normalize_over: tuple[int, int] | None = None, norm_region: tuple[int, int] | None = None, default: tuple[int, int] = (20, 50)) -> tuple[int, int]:
    """The window that a profile is normalised over, relative to the landmark.

    ``normalize_over`` is relative to the landmark and wins; ``norm_region`` and ``default`` are places in the window, whose landmark stands at ``zero_point``.
    """
    if normalize_over is not None:
        return normalize_over
    a, b = norm_region if norm_region is not None else default
    return a - zero_point, b - zero_point


def phase_by_size(counts: DataFrame, cds: DataFrame, key: str, codon_buffer: int = 5, back_buffer: int | None = None) -> DataFrame:
    """Per read length: ``reads_counted, fraction_reads_counted, phase0, phase1, phase2``.

    ``counts``: sites with rlen; ``cds``: key, chrom, strand, segments of coding regions. Only whole codons count; ``codon_buffer`` of them
    are left out at the 5' end and ``back_buffer`` at the 3' end: by default as many, for coding parts of windows (:func:`roi_coding_part`), which do not
    reach the stop codon, 1.
    """
    back_buffer = codon_buffer if back_buffer is None else back_buffer
    n = cds.select(key, F.floor(C.length("segments") / 3).alias("codons"))
    # The array functions see one row per coding region; sites join on bins.
    long = cds.select(key, "chrom", "strand", C.length("segments").alias("n"), F.explode(C.offsets("segments")).alias("s")).select(key, "chrom", "strand", "n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.off").alias("off"))
    at = F.col("off_r") + F.col("pos") - F.col("start_r")
    hit = position_join(counts, long).select("rlen", F.col(f"{key}_r").alias(key), F.when(F.col("strand_r") == "-", F.col("n_r") - 1 - at).otherwise(at).alias("off"), "value")
    codon = F.floor(F.col("off") / 3)
    inner = hit.join(n, key).filter((codon >= codon_buffer) & (codon < F.col("codons") - back_buffer))
    s = inner.groupBy("rlen").agg(F.sum("value").alias("reads_counted"), *[F.sum(F.when(F.col("off") % 3 == p, F.col("value")).otherwise(0)).alias(f"p{p}") for p in range(3)])
    s = materialize(s, "phases")  # a row per read length
    total = s.agg(F.sum("reads_counted").cast("double").alias("t")).scalar()
    f = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return s.select(F.col("rlen").alias("read_length"), "reads_counted", f("reads_counted", total).alias("fraction_reads_counted"), *[f(f"p{p}", F.col("reads_counted")).alias(f"phase{p}") for p in range(3)])

