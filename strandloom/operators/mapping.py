"""Read mapping rules: which genomic position, with which weight, a read counts for.

Reads are rows with ``chrom``, ``strand`` and either ``blocks`` (array of ``struct<start, end>``, introns and deletions excluded) or the
compact form ``start, rlen, k, gap`` (one intron of ``gap`` after ``k`` aligned nucleotides, none if k is 0). ``rlen`` is
the number of aligned positions. Rules are row-local expressions; a rule returns the reads with ``pos`` and ``weight``, reads without
a position dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C

Rule = Callable[[DataFrame], DataFrame]


def pos_at(q: Column, df: DataFrame | None = None) -> Column:
    """Genomic position of the q-th aligned nucleotide (ascending), in the form of reads that df has."""
    if df is not None and "blocks" in df.columns:
        return C.genomic_coordinate("blocks", F.lit("+"), q)
    return F.col("start") + q + F.when((F.col("k") > 0) & (q >= F.col("k")), F.col("gap")).otherwise(0)


def from_5p(offset: Column) -> Column:
    return F.when(F.col("strand") == "-", F.col("rlen") - 1 - offset).otherwise(offset)


def five_prime(offset: int = 0) -> Rule:
    """The position ``offset`` nucleotides behind the 5' end; reads not longer than the offset are dropped."""
    return lambda reads: reads.filter(F.col("rlen") > offset).withColumn("pos", pos_at(from_5p(F.lit(offset)), reads)).withColumn("weight", F.lit(1.0))


def three_prime(offset: int = 0) -> Rule:
    """The position ``offset`` nucleotides before the 3' end."""
    return lambda reads: reads.filter(F.col("rlen") > offset).withColumn("pos", pos_at(from_5p(F.col("rlen") - 1 - offset), reads)).withColumn("weight", F.lit(1.0))


def center(nibble: int = 0) -> Rule:
    """Every position but ``nibble`` at either end, each with an equal part of one; reads with nothing left are dropped."""

    def rule(reads: DataFrame) -> DataFrame:
        n = F.col("rlen") - 2 * nibble
        each = F.explode(F.sequence(F.lit(nibble).cast("bigint"), (F.col("rlen") - nibble - 1).cast("bigint")))
        return reads.filter(n > 0).withColumn("__q", each).withColumn("pos", pos_at(F.col("__q"), reads)).withColumn("weight", F.lit(1.0) / n).drop("__q")

    return rule


def variable_five_prime(offsets: dict[int, int], default: int | None = None) -> Rule:
    """An offset per read length; lengths that are not listed take the default, or are dropped without one. Offsets not below the length drop the read."""

    def rule(reads: DataFrame) -> DataFrame:
        listed = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("rlen").cast("int")) if offsets else F.lit(None).cast("int")
        o = F.coalesce(listed, F.lit(default).cast("int"))
        return reads.withColumn("__o", o).filter(F.col("__o").isNotNull() & (F.col("__o") < F.col("rlen"))).withColumn("pos", pos_at(from_5p(F.col("__o")), reads)).withColumn("weight", F.lit(1.0)).drop("__o")

    return rule


def stratified_variable_five_prime(offsets: dict[int, int], default: int | None = None, shortest: int = 25, longest: int = 35) -> Rule:
    """As :func:`variable_five_prime`, for reads of the lengths given; ``rlen`` stays a key of the result."""
    rule = variable_five_prime(offsets, default)
    return lambda reads: rule(reads.filter(F.col("rlen").between(shortest, longest)))


# Rules for single-block alignments, in which the span counts and splicing does not.
def span_center(nibble: int = 0, offset: int = 0) -> Rule:
    def rule(reads: DataFrame) -> DataFrame:
        n = F.col("rlen") - 2 * nibble
        shift = F.when(F.col("strand") == "-", -offset).otherwise(offset)
        return reads.filter(n > 0).withColumn("pos", F.explode(F.sequence(F.col("start") + nibble + shift, F.col("start") + F.col("rlen") - nibble - 1 + shift))).withColumn("weight", F.lit(1.0) / n)

    return rule


def span_five_prime(offset: int = 0) -> Rule:
    """Dropped only if the offset is above the length."""
    return lambda reads: reads.filter(F.col("rlen") >= offset).withColumn("pos", F.when(F.col("strand") == "-", F.col("start") + F.col("rlen") - 1 - offset).otherwise(F.col("start") + offset)).withColumn("weight", F.lit(1.0))


def span_three_prime(offset: int = 0) -> Rule:
    return lambda reads: reads.filter(F.col("rlen") >= offset).withColumn("pos", F.when(F.col("strand") == "-", F.col("start") + offset).otherwise(F.col("start") + F.col("rlen") - 1 - offset)).withColumn("weight", F.lit(1.0))


def span_variable_five_prime(offsets: dict[int, int], default: int) -> Rule:
    """Mapped also where the offset reaches the length."""

    def rule(reads: DataFrame) -> DataFrame:
        o = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("rlen").cast("int")), F.lit(default)) if offsets else F.lit(default)
        return reads.withColumn("pos", F.when(F.col("strand") == "-", F.col("start") + F.col("rlen") - 1 - o).otherwise(F.col("start") + o)).withColumn("weight", F.lit(1.0))

    return rule


#: Rules by name; :func:`register_rule` adds a user's own.
RULES: dict[str, Callable[..., Rule]] = {
    "fiveprime": five_prime,
    "threeprime": three_prime,
    "center": center,
    "entire": lambda: center(0),
    "fiveprime_variable": variable_five_prime,
    "stratified_fiveprime_variable": stratified_variable_five_prime,
}


def register_rule(name: str, make: Callable[..., Rule]) -> None:
    """A user's rule: ``make(**options)`` returns a function from reads to reads with pos and weight."""
    RULES[name] = make


def size_filter(shortest: int = 1, longest: int = -1) -> Column:
    """Keeps reads of the lengths given; -1 stands for no upper bound."""
    if shortest < 1 or (longest != -1 and longest < shortest):
        raise ValueError("a size filter needs 1 <= shortest <= longest")
    c = F.col("rlen") >= shortest
    return c if longest == -1 else c & (F.col("rlen") <= longest)


def strand_filter(strand: str) -> Column:
    """``.`` keeps both strands."""
    return F.lit(True) if strand == "." else F.col("strand") == strand


def apply_filters(reads: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Named read filters, all of which must hold."""
    for c in filters.values():
        reads = reads.filter(c)
    return reads
