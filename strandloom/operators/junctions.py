"""Splice junctions: discovery, sliding, comparison with known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.overlap import overlap_join


def find_junctions(chains: DataFrame, order: str) -> DataFrame:
    """Unique junctions (chrom, left, right, strand) with the bounds of the exons at which they were first seen, by ``order``.

    The first row per junction is kept by a partial aggregation, not by a window over all of its rows.
    """
    pairs = chains.filter(F.size("segments") > 1).select("chrom", "strand", F.col(order).alias("o"), F.explode(F.sequence(F.lit(0), F.size("segments") - 2)).alias("i"), "segments")
    x = pairs.select("chrom", "strand", "o", F.col("segments")[F.col("i")].alias("a"), F.col("segments")[F.col("i") + 1].alias("b"))
    return x.groupBy("chrom", F.col("a.end").alias("left"), F.col("b.start").alias("right"), "strand").agg(F.min_by(F.struct(F.col("a.start").alias("s"), F.col("b.end").alias("e")), F.struct("o", "a.start", "b.end")).alias("x")).select("chrom", "left", "right", "strand", F.col("x.s").alias("exon_start"), F.col("x.e").alias("exon_end"))


def junction_name(chrom: str = "chrom", left: str = "left", right: str = "right", strand: str = "strand") -> Column:
    return F.concat(F.col(chrom), F.lit("@"), F.col(left).cast("string"), F.lit("^"), F.col(right).cast("string"), F.lit("("), F.col(strand), F.lit(")"))


def parse_junction_name(name: Column | str) -> Column:
    """struct<chrom, left, right, strand> of a name as :func:`junction_name` writes it; null of any other text."""
    n, form = C.col(name), r"\A(.+)@([0-9]+)\^([0-9]+)\(([-+.])\)\z"
    part = lambda i: F.regexp_extract(n, form, i)
    return F.when(n.rlike(form), F.struct(part(1).alias("chrom"), part(2).cast("bigint").alias("left"), part(3).cast("bigint").alias("right"), part(4).alias("strand")))


def _run(a: Column, b: Column, n: int) -> Column:
    """How many leading characters of two texts agree, at most n."""
    same = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (F.substring(a, i, F.lit(1)) != ""))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.lit(n)).otherwise((first - 1).cast("int"))


def match_range(up_exon: Column, intron_start: Column, intron_end: Column, down_exon: Column, maxslide: int = 10) -> Column:
    """struct<minus, plus>: how far a junction slides left and right without a change of the spliced sequence.

    The four texts are the ``maxslide`` nucleotides before and behind either end of the intron, in genome order. Sliding stops at the first mismatch.
    """
    return F.struct((-_run(F.reverse(up_exon), F.reverse(intron_end), maxslide)).alias("minus"), _run(intron_start, down_exon, maxslide).alias("plus"))


#: First and last two nucleotides of introns that count as canonical, per strand, in genome order.
CANONICAL = {"+": (("GT", "AG"), ("GC", "AG")), "-": (("CT", "AC"), ("CT", "GC"))}


def canonical_slides(left: Column, right: Column, strand: Column, span: Column, center: int) -> Column:
    """The slides within ``span`` (struct<minus, plus>) at which the intron has canonical ends.

    ``left`` and ``right`` hold the sequence around either end of the intron; the intron begins, and its last two nucleotides begin, at index ``center``.
    """
    def fits(d: Column) -> Column:
        a, b = F.substring(left, d + center + 1, F.lit(2)), F.substring(right, d + center + 1, F.lit(2))
        out = F.lit(False)
        for s, pairs in CANONICAL.items():
            for x, y in pairs:
                out = out | ((strand == s) & (a == x) & (b == y))
        return out

    return F.filter(F.sequence(span["minus"], span["plus"]), fits)


def known_matches(query: DataFrame, known: DataFrame, slack: str = "span") -> DataFrame:
    """Junctions with the known ones of the same intron length within their slide range; an exact match wins, else the least slide.

    Equi-join on (chrom, strand, intron length); the range is a residual condition. ``query`` has ``span`` = struct<minus, plus>.
    """
    k = known.select(F.col("chrom").alias("kc"), F.col("strand").alias("ks"), F.col("left").alias("kl"), (F.col("right") - F.col("left")).alias("kn")).distinct()
    on = (F.col("chrom") == F.col("kc")) & (F.col("strand") == F.col("ks")) & (F.col("right") - F.col("left") == F.col("kn"))
    d = F.col("kl") - F.col("left")
    hit = query.join(k, on & (d >= F.col(f"{slack}.minus")) & (d <= F.col(f"{slack}.plus")))
    w = Window.partitionBy("chrom", "strand", "left", "right").orderBy(F.abs(F.col("kl") - F.col("left")), F.col("kl"))
    return hit.withColumn("slide", d).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("kc", "ks", "kl", "kn", "__r")


def in_repeats(query: DataFrame, masks: DataFrame) -> DataFrame:
    """Junctions (chrom, strand, left, right) with a masked position between the outermost slides of either end."""
    ends = query.select("*", F.explode(F.array("left", "right")).alias("__e")).select("chrom", "strand", "left", "right", (F.col("__e") + F.col("span.minus") - 1).alias("start"), (F.col("__e") + F.col("span.plus") + 1).alias("end"))
    return overlap_join(ends, masks.select("chrom", "strand", "start", "end"), how="left_semi").select("chrom", "strand", "left", "right").distinct()


def classify(query: DataFrame, known: DataFrame, masks: DataFrame) -> DataFrame:
    """Every junction with ``kind``: repetitive, else known, else canonical, else untouched; and ``slide`` to the place chosen.

    ``query`` has ``span`` and ``canonical`` (array of slides).
    """
    key = ["chrom", "strand", "left", "right"]
    rep = in_repeats(query, masks).withColumn("rep", F.lit(True))
    kn = known_matches(query, known).select(*key, F.col("slide").alias("known_slide"))
    best = F.array_sort("canonical", lambda x, y: (F.abs(x) * 2 + F.when(x > 0, 1).otherwise(0) - F.abs(y) * 2 - F.when(y > 0, 1).otherwise(0)).cast("int"))
    out = query.join(rep, key, "left").join(kn, key, "left")
    kind = F.when(F.col("rep"), "repetitive").when(F.col("known_slide").isNotNull(), "known").when(F.size("canonical") > 0, "canonical").otherwise("untouched")
    slide = F.when(kind == "known", F.col("known_slide")).when(kind == "canonical", F.get(best, F.lit(0))).otherwise(0)
    return out.withColumn("kind", kind).withColumn("slide", slide.cast("bigint")).drop("rep", "known_slide")

