"""Joins whose left side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may have; a more frequent key is spread over as many tasks as it takes.
TASK_ROWS = 500_000
#: Most keys that are spread. Where more would be, which takes a left side of at least this many times as many rows, only the most frequent are.
SPREAD_KEYS = 200_000


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Equi-join on the column ``key`` of both sides; keys of ``left`` with more than ``task_rows`` rows are spread over tasks.

    Such keys are found by a pre-aggregated count; at most ``left`` / task_rows of them, and at most :data:`SPREAD_KEYS`, exist, so
    they are broadcast, each with the number of salts that its rows take. Their rows on the right are repeated once per salt. ``rows``
    is the number of left rows, where it is known: without more than ``task_rows`` of them, nothing is counted.
    The salt is a hash of the left row, so that a repeated task gives the same rows.
    Null keys match nothing. ``how`` is inner, left, left_semi or left_anti. No row is dropped.
    """
    if rows is not None and rows <= task_rows:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    seen = counts.agg(F.sum("__n").alias("n"), F.max("__n").alias("top")).collect()[0]
    total, top = seen["n"] or 0, seen["top"] or 0
    floor = max(task_rows, total // SPREAD_KEYS)
    if top <= floor:
        return left.join(right, key, how)
    heavy = F.broadcast(counts.filter(F.col("__n") > floor).filter(F.col(key).isNotNull()).select(F.col(key).alias("__hk"), F.ceil(F.col("__n") / floor).cast("int").alias("__of")))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("__of")).cast("int")
    l = left.join(heavy, F.col(key) == F.col("__hk"), "left").withColumn("__salt", F.coalesce(salt, F.lit(0))).drop("__hk", "__of")
    r = right.join(heavy, F.col(key) == F.col("__hk"), "left")
    r = r.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__of", F.lit(1)) - 1))).drop("__hk", "__of")
    return l.join(r, [key, "__salt"], how).drop("__salt")
