"""Genome arrays as sparse tables ``(chrom, strand, pos, value)``: counting, arithmetic, tracks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize

SITE = ["chrom", "strand", "pos"]


def count_positions(mapped: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of weights per site (and per column of ``by``). Partial sums are made before the shuffle."""
    return mapped.groupBy(*(by or []), *SITE).agg(F.sum("weight").alias("value"))


def array_sum(array: DataFrame) -> DataFrame:
    """One row with the sum of all values."""
    return array.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def normalize(array: DataFrame, total: float | None = None) -> DataFrame:
    """Values per million: of ``total`` if given, else of the array's own sum."""
    if total is None:
        array = materialize(array, "sites")  # read for its sum and for its values
    t = F.lit(float(total)) if total is not None else array_sum(array).scalar()
    return array.withColumn("value", F.try_divide(F.col("value") * 1e6, t))


def scale(array: DataFrame, factor: float) -> DataFrame:
    return array.withColumn("value", F.col("value") * factor)


def densify(array: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every position of the chroms in ``sizes`` (chrom, length), on the strands that the array has, absent ones with 0."""
    strands = array.select("strand").distinct()
    tiles = sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(length - 1) div 100000"))).alias("__t"), "length").join(F.broadcast(strands))
    every = tiles.select("chrom", "strand", F.explode(F.sequence(F.col("__t") * 100000, F.least(F.col("length"), (F.col("__t") + 1) * 100000) - 1)).alias("pos"))
    return every.join(array, SITE, "left").select(*SITE, F.coalesce("value", F.lit(0)).alias("value"))


def shift(array: DataFrame, sizes: DataFrame, constant: float) -> DataFrame:
    """Adds a constant to every position, hence a dense result."""
    return densify(array, sizes).withColumn("value", F.col("value") + constant)


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], mode: str = "all") -> DataFrame:
    """Position by position. ``all``: sites of either, absent values 0; ``same``: sites of both; ``truncate``: up to the shorter of the two arrays on each chrom and strand."""
    if mode not in ("all", "same", "truncate"):
        raise ValueError(f"mode {mode!r} is none of all, same, truncate")
    x, y = (d.select(*SITE, F.col("value").alias(n)) for d, n in ((a, "va"), (b, "vb")))
    out = x.join(y, SITE, "inner" if mode == "same" else "full")
    if mode == "truncate":
        ends = [d.groupBy("chrom", "strand").agg(F.max("pos").alias(n)) for d, n in ((a, "ea"), (b, "eb"))]
        out = out.join(ends[0].join(ends[1], ["chrom", "strand"]), ["chrom", "strand"]).filter(F.col("pos") <= F.least("ea", "eb")).drop("ea", "eb")
    return out.select(*SITE, op(F.coalesce("va", F.lit(0)), F.coalesce("vb", F.lit(0))).alias("value"))


def add(a: DataFrame, b: DataFrame, mode: str = "all") -> DataFrame:
    """Union and sum where no site is lost: no join is needed."""
    if mode == "all":
        return a.select(*SITE, "value").unionByName(b.select(*SITE, "value")).groupBy(*SITE).agg(F.sum("value").alias("value"))
    return combine(a, b, lambda p, q: p + q, mode)


def subtract(a: DataFrame, b: DataFrame, mode: str = "all") -> DataFrame:
    return combine(a, b, lambda p, q: p - q, mode)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites that only one array has are 0 in the product, so an inner join is enough."""
    return combine(a, b, lambda p, q: p * q, "same")


def assign(array: DataFrame, new: DataFrame, regions: DataFrame) -> DataFrame:
    """The array with the sites of ``regions`` (chrom, strand, pos) replaced by those of ``new``."""
    return array.join(regions.select(*SITE).distinct(), SITE, "left_anti").unionByName(new.join(regions.select(*SITE).distinct(), SITE, "left_semi"))


def arrays_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: ``equal``, whether no site differs by more than the tolerance."""
    d = combine(a, b, lambda p, q: F.abs(p - q))
    return d.agg((F.count(F.when(F.col("value") > tolerance, 1)) == 0).alias("equal"))


def nonzero(array: DataFrame) -> DataFrame:
    return array.filter(F.col("value") != 0)


def runs(array: DataFrame, window: int | None = None, tile: int = 100_000) -> DataFrame:
    """Run lengths of non-zero values: ``chrom, strand, start, end, value``.

    ``window`` breaks runs at its multiples, as a track that is exported window by window has them. Without it, runs are built in
    tiles and joined where they meet at a border, so that no chromosome is ever one task.
    """
    w = window or tile
    t = nonzero(array).withColumn("tile", F.floor(F.col("pos") / w))
    key = Window.partitionBy("chrom", "strand", "tile").orderBy("pos")
    new = (F.col("pos") != F.lag("pos").over(key) + 1) | (F.col("value") != F.lag("value").over(key))
    local = t.withColumn("run", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(key)).groupBy("chrom", "strand", "tile", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("value").alias("value"))
    if window:
        return local.select("chrom", "strand", "start", "end", "value")
    edge = (F.col("start") == F.col("tile") * w) | (F.col("end") == (F.col("tile") + 1) * w)
    over = Window.partitionBy("chrom", "strand").orderBy("start")
    broken = (F.col("start") != F.lag("end").over(over)) | (F.col("value") != F.lag("value").over(over))
    joined = local.filter(edge).withColumn("id", F.sum(F.coalesce(broken.cast("int"), F.lit(1))).over(over)).groupBy("chrom", "strand", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value"))
    return local.filter(~edge).select("chrom", "strand", "start", "end", "value").unionByName(joined.select("chrom", "strand", "start", "end", "value"))


def bedgraph_with_zeros(array: DataFrame, tile: int = 100_000) -> DataFrame:
    """Runs from position 0 to the last non-zero one, zero stretches included.

    The run before the first one of a tile comes from a window over tiles, so no chromosome is one task.
    """
    r = materialize(runs(array), "track")
    t = r.withColumn("tile", F.floor(F.col("start") / tile))
    ends = t.groupBy("chrom", "strand", "tile").agg(F.max("end").alias("last")).withColumn("before", F.lag("last").over(Window.partitionBy("chrom", "strand").orderBy("tile"))).drop("last")
    w = Window.partitionBy("chrom", "strand", "tile").orderBy("start")
    prev = F.coalesce(F.lag("end").over(w), "before", F.lit(0))
    gaps = t.join(ends, ["chrom", "strand", "tile"]).withColumn("p", prev).filter(F.col("start") > F.col("p")).select("chrom", "strand", F.col("p").alias("start"), F.col("start").alias("end"), F.lit(0).cast(dict(r.dtypes)["value"]).alias("value"))
    return r.unionByName(gaps)


def variable_step(array: DataFrame) -> DataFrame:
    """Non-zero sites with 1-based positions."""
    return nonzero(array).select("chrom", "strand", (F.col("pos") + 1).alias("pos1"), "value")


def from_runs(r: DataFrame) -> DataFrame:
    """Sites of a run table."""
    return r.filter(F.col("end") > F.col("start")).select("chrom", "strand", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")


def summarize_runs(r: DataFrame) -> DataFrame:
    """Per chrom and strand: covered nucleotides, sum, mean, least, greatest, population deviation. No run is expanded."""
    n = F.col("end") - F.col("start")
    s = r.groupBy("chrom", "strand").agg(F.sum(n).alias("covered"), F.sum(n * F.col("value")).alias("total"), F.sum(n * F.col("value") * F.col("value")).alias("__sq"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    mean = F.try_divide(F.col("total").cast("double"), F.col("covered"))
    var = F.greatest(F.try_divide(F.col("__sq").cast("double"), F.col("covered")) - mean * mean, F.lit(0.0))
    return s.withColumn("mean", mean).withColumn("deviation", F.sqrt(var)).drop("__sq")


def chrom_lengths(array: DataFrame) -> DataFrame:
    """Per chrom: least length that holds the array; strands as text."""
    return array.groupBy("chrom").agg((F.max("pos") + 1).alias("length"), F.array_join(F.array_sort(F.collect_set("strand")), "").alias("strands"))
