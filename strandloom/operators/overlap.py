"""Interval overlap and containment joins.

Both sides are cut into bins of the coordinate and joined on (chrom, bin); the exact predicate follows. A
pair that meets in several bins counts in the first one both have, so no distinct is needed. Bins of long features only
multiply that feature; a crowded bin is the unit that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nucleotides per bin.
BIN = 20_000


def binned(df: DataFrame, start: str = "start", end: str = "end", width: int = BIN, to: str = "bin") -> DataFrame:
    """One row per bin that the half-open interval touches; empty intervals touch the bin of their start."""
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor((F.col(end) - 1) / width))
    return df.withColumn(to, F.explode(F.sequence(first, last)))


def candidates(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of features that share a bin: an over-estimate of those that overlap. Columns of right get the suffix ``_r``."""
    l = binned(left, width=width)
    r = binned(right, width=width)
    for c in right.columns:
        r = r.withColumnRenamed(c, f"{c}_r")
    return l.join(r, (F.col("chrom") == F.col("chrom_r")) & (l["bin"] == r["bin"])).drop("bin").distinct()


def bin_width(intervals: DataFrame, start: str = "start", end: str = "end") -> int:
    """A power of two near twice the median length: an interval touches two bins or so, and a bin holds little besides."""
    n = intervals.filter(F.col(end) > F.col(start)).agg(F.percentile_approx(F.col(end) - F.col(start), 0.5, 100)).collect()[0][0]
    return min(max(1 << int(2 * n - 1).bit_length(), 256), 1 << 20) if n else BIN


def _strands(strand: str) -> Column:
    """The strands a feature may meet, as an array of keys; of ``.`` both, of no strand none."""
    s = F.col(strand)
    return F.when(s.isin("+", "-"), F.array(s)).when(s == ".", F.array(F.lit("+"), F.lit("-")))


def overlap_join(left: DataFrame, right: DataFrame, stranded: bool = True, width: int | None = None, how: str = "inner") -> DataFrame:
    """Pairs of intervals (chrom, strand, start, end) with a position in common; columns of right get the suffix ``_r``.

    ``stranded``: strands must share a bit, so ``.`` meets either; the strand is a key of the join. ``how``: inner, left_semi, left_anti, which
    keep or drop every row of left, repeated ones as they are. Bins fit the lengths of right (:func:`bin_width`) unless ``width`` is given.
    """
    width = width or bin_width(right)
    if how in ("left_semi", "left_anti"):
        # Which intervals are met depends on their bounds alone, so each is looked up once, however many rows have it.
        key = ["chrom", "strand", "start", "end"]
        own = [F.col(c).alias(f"__{c}") for c in key]
        hit = overlap_join(left.select(*key).distinct(), right.select(*key), stranded, width).select(*own).distinct()
        on = (F.col("chrom") == F.col("__chrom")) & F.col("strand").eqNullSafe(F.col("__strand")) & (F.col("start") == F.col("__start")) & (F.col("end") == F.col("__end"))
        return left.join(hit, on, how)
    if how != "inner":
        raise ValueError(f"how {how!r} is none of inner, left_semi, left_anti")
    l = binned(left, width=width, to="__b")
    r = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    r = binned(r, "start_r", "end_r", width, "__br")
    meet = (F.col("chrom") == F.col("chrom_r")) & (F.col("__b") == F.col("__br")) & (F.col("start") < F.col("end_r")) & (F.col("start_r") < F.col("end"))
    meet &= F.col("__b") == F.floor(F.greatest("start", "start_r") / width)
    if stranded:
        l, r = l.withColumn("__s", F.explode(_strands("strand"))), r.withColumn("__sr", F.explode(_strands("strand_r")))
        # Two features on ``.`` meet under both keys; the first counts.
        meet &= (F.col("__s") == F.col("__sr")) & ~((F.col("strand") == ".") & (F.col("strand_r") == ".") & (F.col("__s") == "-"))
    return l.join(r, meet).drop("__b", "__br", "__s", "__sr")


def position_join(positions: DataFrame, intervals: DataFrame, width: int | None = None, extra: Column | None = None) -> DataFrame:
    """Sites (chrom, strand, pos, ...) with each interval (chrom, strand, start, end, ...) that holds them; columns of intervals get the suffix ``_r``.

    Equal strands, as a key of the join; an interval on ``.`` takes sites of either strand. Each site has one bin, so pairs are unique. Bins fit
    the lengths of the intervals unless ``width`` is given.
    """
    width = width or bin_width(intervals)
    p = positions.withColumn("__b", F.floor(F.col("pos") / width))
    r = intervals.select(*[F.col(c).alias(f"{c}_r") for c in intervals.columns])
    r = binned(r.filter("end_r > start_r"), "start_r", "end_r", width, "__br")
    r = r.withColumn("__sr", F.explode(F.when(F.col("strand_r") == ".", F.array(F.lit("+"), F.lit("-"), F.lit("."))).otherwise(F.array("strand_r"))))
    on = (F.col("chrom") == F.col("chrom_r")) & (F.col("__b") == F.col("__br")) & (F.col("strand") == F.col("__sr")) & (F.col("pos") >= F.col("start_r")) & (F.col("pos") < F.col("end_r"))
    return p.join(r, on if extra is None else on & extra).drop("__b", "__br", "__sr")
