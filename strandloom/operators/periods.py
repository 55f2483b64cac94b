"""Continuous periods and gaps of intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize

#: Coordinates per bucket. A group has at most (its coordinate range / this) buckets, however many rows it has.
BUCKET_WIDTH = 1 << 20


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, bucket_width: int = BUCKET_WIDTH) -> DataFrame:
    """Merges half-open intervals into continuous periods and lists the gaps between them.

    Result: keys, ``found_kind`` (``period`` or ``gap``), ``seg_start``, ``seg_end``,
    ``n_rows`` (rows in the period, repeated ones included; null for gaps),
    ``differing`` (the period has at least two rows with differing bounds; null for gaps).

    Overlapping and touching intervals are one period. Rows with a null bound or
    ``end <= start`` are ignored, a null key is a key of its own, other columns of df are not looked
    at, an empty table gives an empty result.

    Sessions come from ``session_window`` with each row's own duration, within buckets of
    the coordinate, so that no group is ever held by one task: equal intervals collapse
    in the map task before the shuffle, buckets exchange only their first start and greatest end
    over a window of bucket summaries.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.filter("s is not null and e is not null and e > s").withColumn("b", F.floor(F.col("s") / bucket_width))
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(cast(e - s as decimal(19,0)) * cast(0.000001 as decimal(7,6)) as decimal(18,6)))")
    sessions = (
        rows.groupBy(*k, "b", F.session_window(F.timestamp_micros("s"), length).alias("w"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("s").alias("smax"), F.min("e").alias("emin"), F.count(F.lit(1)).alias("n"))
        .drop("w")
    )
    # Touching sessions of a bucket become one island.
    w = Window.partitionBy(*k, "b").orderBy("s")
    isles = (
        sessions.withColumn("new", F.coalesce((F.col("s") > F.lag("e").over(w)).cast("int"), F.lit(1)))
        .withColumn("isle", F.sum("new").over(w))
        .groupBy(*k, "b", "isle")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("smax").alias("smax"), F.min("emin").alias("emin"), F.sum("n").alias("n"))
    )
    # Both branches below read the islands, which are written once instead of being built twice.
    isles = materialize(isles, "isles")
    # What a bucket must know of the others: greatest end and last period's start before it, first start after it.
    over = Window.partitionBy(*k).orderBy("b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        isles.groupBy(*k, "b")
        .agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.max("e").alias("max_e"))
        .withColumn("carry_e", F.max("max_e").over(before))
        .withColumn("next_b_s", F.lead("first_s").over(over))
        .withColumn("carry_s", F.max(F.when(F.col("carry_e").isNull() | (F.col("last_s") > F.col("carry_e")), F.col("last_s"))).over(before))
        .select(*[F.col(c).alias(f"c{c}") for c in k], F.col("b").alias("cb"), "carry_e", "carry_s", "next_b_s")
    )
    same = F.col("b") == F.col("cb")
    for c in k:
        same &= F.col(c).eqNullSafe(F.col(f"c{c}"))
    placed = (
        isles.join(carry, same)
        .withColumn("id", F.when(F.col("s") <= F.col("carry_e"), F.col("carry_s")).otherwise(F.col("s")))
        .withColumn("nxt", F.coalesce(F.lead("s").over(w), "next_b_s"))
        .withColumn("reach", F.greatest("e", "carry_e"))
    )
    # Each island is a part of a period and may open a gap; both go through one aggregation, in which a gap stands alone.
    part = F.struct(F.lit("period").alias("kind"), F.col("id").alias("at"), F.col("e").alias("to"), "smax", "emin", "n")
    gap = F.struct(F.lit("gap").alias("kind"), F.col("reach").alias("at"), F.col("nxt").alias("to"), F.lit(None).cast("long").alias("smax"), F.lit(None).cast("long").alias("emin"), F.lit(None).cast("long").alias("n"))
    return (
        placed.select(*k, F.explode(F.when(F.col("nxt") > F.col("reach"), F.array(part, gap)).otherwise(F.array(part))).alias("x"))
        .groupBy(*k, "x.kind", "x.at")
        .agg(F.max("x.to").alias("to"), F.max("x.smax").alias("smax"), F.min("x.emin").alias("emin"), F.sum("x.n").alias("n"))
        .select(
            *[F.col(n).alias(c) for c, n in zip(keys, k)],
            F.col("kind").alias("found_kind"),
            F.col("at").alias("seg_start"),
            F.col("to").alias("seg_end"),
            F.col("n").alias("n_rows"),
            ((F.col("smax") > F.col("at")) | (F.col("emin") < F.col("to"))).alias("differing"),
        )
    )
