"""Statistics between samples, table comparison, and the numbers behind plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower bounds of the bins of summed counts.
BINS = (0, 32, 64, 128, 256, 512, 1024, 2048, 4096)


def sample_pairs(counts: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Every pair of samples side by side: sample_a, sample_b, key, a, b. Samples are few; keys join by hash."""
    x = counts.select(F.col(sample).alias("sample_a"), key, F.col(value).cast("double").alias("a"))
    y = counts.select(F.col(sample).alias("sample_b"), key, F.col(value).cast("double").alias("b"))
    return x.join(y, key).filter("sample_a < sample_b")


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Average ranks of a and b within ``by``, from counts per distinct value: a running sum over distinct values, not over rows."""
    for c in ("a", "b"):
        n = pairs.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
        w = Window.partitionBy(*by).orderBy(c)
        r = n.withColumn(f"r{c}", F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0).drop("__n")
        pairs = pairs.join(r, [*by, c])
    return pairs


def compare_samples(pairs: DataFrame, by: list[str] | None = None, least: float = 128) -> DataFrame:
    """Per pair of samples (and ``by``): n, pearsonr, spearmanr, mean and population deviation of log2(b / a), and 2 ** (3 deviations).

    Rows with a sum of counts below ``least`` are left out of all; rows with a zero count are left out of the ratios.
    """
    by = ["sample_a", "sample_b", *(by or [])]
    kept = _ranked(pairs.filter(F.col("a") + F.col("b") >= least), by)
    ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), F.log2(F.col("b") / F.col("a")))
    s = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearsonr"), F.corr("ra", "rb").alias("spearmanr"), F.avg(ratio).alias("log2_mean"), F.stddev_pop(ratio).alias("log2_std"))
    return s.withColumn("three_sigma", F.pow(F.lit(2.0), 3 * F.col("log2_std")))


def count_bin(total: Column) -> Column:
    """The lower bound of the bin that holds a sum of counts; the last bin is open."""
    out = F.lit(None).cast("int")
    for b in BINS:
        out = F.when(total >= b, b).otherwise(out)
    return out


def binned_statistics(pairs: DataFrame) -> DataFrame:
    """:func:`compare_samples` per bin of summed counts; correlations need more than two rows."""
    s = compare_samples(pairs.withColumn("bin", count_bin(F.col("a") + F.col("b"))), ["bin"], 0)
    few = F.col("n") <= 2
    return s.withColumn("pearsonr", F.when(~few, F.col("pearsonr"))).withColumn("spearmanr", F.when(~few, F.col("spearmanr")))


def table_differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-8, exclude: list[str] | None = None) -> DataFrame:
    """Rows in which two tables differ: keys and ``differing``, the columns that do. Empty if they are equal.

    Numbers may differ by ``tolerance``; nulls, NaN and infinities must stand in the same places; a row that only one table has differs in all
    columns. Tables with other columns are an error.
    """
    cols = [c for c in a.columns if c not in (exclude or [])]
    if sorted(cols) != sorted(c for c in b.columns if c not in (exclude or [])):
        raise ValueError(f"columns differ: {sorted(a.columns)} and {sorted(b.columns)}")
    rest = [c for c in cols if c not in keys]
    x = a.select(*keys, F.struct(*rest, F.lit(1).alias("__in")).alias("x"))
    y = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*rest, F.lit(1).alias("__in")).alias("y"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    kinds = dict(a.dtypes)
    bad = []
    for c in rest:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        same = p.eqNullSafe(q)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(p - q) <= tolerance, F.lit(False))
        bad.append(F.when(~same, F.lit(c)))
    alone = F.col("x").isNull() | F.col("y").isNull()
    j = x.join(y, on, "full")
    every = F.array(*[F.lit(c) for c in rest])
    return j.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.when(alone, every).otherwise(F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")).alias("differing"), alone.alias("__alone")).filter("__alone or size(differing) > 0").drop("__alone")


# What plots are drawn from.
def clean_invalid(df: DataFrame, x: str, y: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Pairs without null, NaN or infinity, clipped to the range."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    out = df.filter(fine(x) & fine(y))
    for c in (x, y):
        v = F.col(c)
        v = F.greatest(v, F.lit(lo)) if lo is not None else v
        out = out.withColumn(c, F.least(v, F.lit(hi)) if hi is not None else v)
    return out


def ma_values(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a > 0 and b > 0 and not isnan(a) and not isnan(b)").withColumn("mean", (F.col("a") + F.col("b")) / 2).withColumn("log2_ratio", F.log2(F.col("b") / F.col("a")))


def phase_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.select(*[c for c in df.columns if c not in columns], *[F.try_divide(F.col(c).cast("double"), total).alias(c) for c in columns])


def triangle(a: Column, b: Column, c: Column) -> Column:
    """struct<x, y>: a point of the simplex as a point in an equilateral triangle."""
    t = a + b + c
    return F.struct(F.try_divide(b + c / 2.0, t).alias("x"), F.try_divide(c * (3**0.5) / 2.0, t).alias("y"))


def kernel_density(df: DataFrame, x: str, points: int = 100, log: float | None = None) -> DataFrame:
    """Gaussian kernel density over ``points`` equal steps with Scott's bandwidth: x, density. The grid is fixed; samples are summed per task.

    With ``log``, the density of the logarithms to that base (of values above 0), x being their antilogarithm. Nulls, NaN and infinities are left out.
    """
    v = F.col(x).cast("double")
    df = df.filter(F.col(x).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    if log is not None:
        d = kernel_density(df.filter(F.col(x) > 0).select((F.log(F.col(x)) / math.log(log)).alias(x)), x, points)
        return d.select(F.pow(F.lit(float(log)), "x").alias("x"), "density")
    s = df.filter(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v")).agg(F.count("v"), F.min("v"), F.max("v"), F.stddev_samp("v")).collect()[0]
    n, lo, hi, sd = s
    spark = df.sparkSession
    if not n or not sd:
        return spark.createDataFrame([], "x double, density double")
    h = sd * n ** (-0.2)
    grid = F.explode(F.array(*[F.lit(lo + (hi - lo) * i / (points - 1)) for i in range(points)]))
    k = F.exp(-F.pow((F.col("x") - F.col("v")) / h, 2) / 2) / (h * (2 * 3.141592653589793) ** 0.5)
    return df.filter(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v")).select("v", grid.alias("x")).groupBy("x").agg((F.sum(k) / n).alias("density"))


def histogram(df: DataFrame, x: str, bins: int = 20, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, lower, upper, n): numbers of values in equal bins, empty ones too; the last bin is closed. Values outside the bounds are left out."""
    v = df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(F.col(x).cast("double").alias("v"))
    if lo is None or hi is None:
        a, b = v.agg(F.min("v"), F.max("v")).collect()[0]
        lo, hi = a if lo is None else lo, b if hi is None else hi
    spark = df.sparkSession
    if lo is None or hi is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins or 1.0
    n = v.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (lo + F.col("id") * width).alias("lower"), (lo + (F.col("id") + 1) * width).alias("upper"))
    return every.join(n, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def stacked_bars(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, part, bottom, height): each value as a bar on top of those before it, in the order of ``columns``; nulls have no height."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    bars = [F.struct(F.lit(c).alias("part"), sum(values[:i], F.lit(0.0)).alias("bottom"), values[i].alias("height")) for i, c in enumerate(columns)]
    return df.select(row, F.explode(F.array(*bars)).alias("b")).select(row, "b.part", "b.bottom", "b.height")


def scatter_histograms(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(axis, bin, lower, upper, n): the marginal histograms of a scatter plot, over pairs in which both values are numbers."""
    fine = clean_invalid(df, x, y)
    return histogram(fine, x, bins).select(F.lit("x").alias("axis"), "*").unionByName(histogram(fine, y, bins).select(F.lit("y").alias("axis"), "*"))


def heatmap_order(profiles: DataFrame, row: str, x: str, value: str) -> DataFrame:
    """(row, ``peak``, ``order``): rows by the first position of their greatest value."""
    p = profiles.groupBy(row).agg(F.max_by(x, F.struct(F.col(value), -F.col(x))).alias("peak"))
    n = p.groupBy("peak").agg(F.count(F.lit(1)).alias("__n"))
    return p.join(n.withColumn("order", F.row_number().over(Window.orderBy("peak")) - 1).drop("__n"), "peak").select(row, "peak", "order")


def hex_to_rgb(c: Column | str) -> Column:
    h = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "^#", "")
    return F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int"))


def rgb_to_hex(rgb: Column | str) -> Column:
    a = F.col(rgb) if isinstance(rgb, str) else rgb
    return F.concat(F.lit("#"), F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")), ""))


def lighten(rgb: Column | str, amount: float = 0.1) -> Column:
    a = F.col(rgb) if isinstance(rgb, str) else rgb
    return F.transform(a, lambda v: F.least(F.lit(255), F.round(v + 255 * amount).cast("int")))


def darken(rgb: Column | str, amount: float = 0.1) -> Column:
    a = F.col(rgb) if isinstance(rgb, str) else rgb
    return F.transform(a, lambda v: F.greatest(F.lit(0), F.round(v - 255 * amount).cast("int")))
