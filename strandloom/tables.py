"""Loading of the stored tables, and the value clean-up they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Texts that stand for "no id", compared in lower case.
PLACEHOLDERS = ("", ".", "na", "nan", "none")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if df is proven to have few rows (counted, at most rows + 1 of them)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_reported_chrom(df: DataFrame, aliases: DataFrame, chrom: str = "chrom", to: str = "chrom") -> DataFrame:
    """Replaces a spelling of a chrom by the name to report; an unlisted spelling stands for itself, null stays null."""
    a = maybe_broadcast(aliases.select(F.col("chrom_alias").alias("__alias"), F.col("chrom").alias("__name")).dropDuplicates(["__alias"]))
    return df.join(a, F.col(chrom) == F.col("__alias"), "left").withColumn(to, F.coalesce("__name", chrom)).drop("__alias", "__name")


def percent_decoded(c: Column | str) -> Column:
    """Undoes %-escapes; a % without two hexadecimal digits is a plain character. Bytes form UTF-8."""
    c = F.col(c) if isinstance(c, str) else c
    marked = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.try_url_decode(marked)).otherwise(c)


def clean_id(c: Column | str) -> Column:
    """An id without outer blanks and double quotes, %-escapes undone; placeholders and empty texts give null."""
    c = F.col(c) if isinstance(c, str) else c
    x = percent_decoded(F.btrim(c, F.lit(' \t\n\x0b\f\r"')))
    return F.when(~F.lower(F.trim(x)).isin(*PLACEHOLDERS), x)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once per row.

    It passes a generator of one row, through which the optimizer pushes no filter: a filter on something derived from the
    column would else be pushed below it with the whole expression copied in for each reference.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))
