"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_profile(
    rows: DataFrame,
    aliases: DataFrame,
    chrom: str = "chrom",
    region: str = "region",
    start: str = "seg_start",
    end: str = "seg_end",
    record: str | None = "read_id",
    heavy_share: float = 0.05,
) -> DataFrame:
    """Reads, mean length and span per reported chrom and per region, without per-key tasks.

    Result: ``key_field`` (``chrom`` / ``region``), ``key_name``, ``n_rows`` (stored rows),
    ``n_reads`` (records, a record delivered twice counting once; equals ``n_rows`` if ``record`` is None),
    ``mean_length``, ``span_start``, ``span_end``, ``heavy`` (at least ``heavy_share`` of the stored rows).

    Aggregation goes through the join: both inputs are first reduced by the join key (the
    chrom as spelt) to compact states, the states are joined, and sums and counts
    roll up to either key. What is shuffled for that is one state per map task and
    (spelling, region), so a hot key has as many rows there as there are map tasks. With a ``record``
    column all rows are shuffled once before, by it; a row whose record is null is a record of its own.
    Rows with a null key are left out of that key's result but count in the total; rows with
    a null bound or ``end < start`` count as reads, not in lengths and spans.
    """
    c = rows.select(
        F.col(chrom).alias("spelling"),
        F.col(region).alias("region"),
        F.col(start).cast("long").alias("s"),
        F.col(end).cast("long").alias("e"),
        *([F.col(record).alias("rec")] if record else []),
    )
    if record:
        own = F.when(F.col("rec").isNull(), F.monotonically_increasing_id())
        c = c.withColumn("own", own).groupBy("rec", "own").agg(*[F.first(x).alias(x) for x in ("spelling", "region", "s", "e")], F.count(F.lit(1)).alias("n"))
    else:
        c = c.withColumn("n", F.lit(1))
    sized = (F.col("e") >= F.col("s")) & F.col("s").isNotNull()
    states = c.groupBy("spelling", "region").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("reads"),
        F.sum(F.when(sized, F.col("e") - F.col("s"))).alias("len"),
        F.count(F.when(sized, 1)).alias("n_len"),
        F.min(F.when(sized, F.col("s"))).alias("lo"),
        F.max(F.when(sized, F.col("e"))).alias("hi"),
    )
    names = aliases.filter("chrom_alias is not null").groupBy(F.col("chrom_alias").alias("alias")).agg(F.min("chrom").alias("name"))
    joined = states.join(names, F.col("spelling") == F.col("alias"), "left").withColumn("chrom", F.coalesce("name", "spelling"))
    keyed = joined.select(
        F.explode(F.array(F.struct(F.lit("chrom").alias("key_field"), F.col("chrom").alias("key_name")), F.struct(F.lit("region").alias("key_field"), F.col("region").alias("key_name")), F.struct(F.lit("").alias("key_field"), F.lit("").alias("key_name")))).alias("k"),
        "rows",
        "reads",
        "len",
        "n_len",
        "lo",
        "hi",
    )
    per_key = keyed.groupBy("k.key_field", "k.key_name").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("reads").alias("n_reads"),
        F.sum("len").alias("len"),
        F.sum("n_len").alias("n_len"),
        F.min("lo").alias("span_start"),
        F.max("hi").alias("span_end"),
    )
    total = per_key.filter("key_field = ''").select("n_rows").scalar()
    return per_key.filter("key_field <> '' and key_name is not null").select(
        "key_field",
        "key_name",
        "n_rows",
        "n_reads",
        F.try_divide(F.col("len").cast("double"), F.col("n_len")).alias("mean_length"),
        "span_start",
        "span_end",
        (F.col("n_rows") >= F.lit(Decimal(str(heavy_share))) * total).alias("heavy"),
    )
