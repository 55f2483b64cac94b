"""Sequences: tiles of a genome, chain sequences, k-mers and their repeat masks."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.session import materialize

#: IUPAC nucleotide codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(C.col(seq), "ACGTNacgtn", "TGCANtgcan"))


def seq_to_regex(seq: str, flags: str = "") -> str:
    """A pattern for a sequence with ambiguous nucleotides; T and U are the same."""
    out = []
    for c in seq.upper():
        s = IUPAC.get(c, c)
        s = s + "U" if "T" in s else s
        out.append(s if len(s) == 1 else f"[{s}]")
    return (f"(?{flags})" if flags else "") + "".join(out)


def random_seq(n: int, nucleotides: str = "NACTG", seed: int | None = None) -> str:
    r = random.Random(seed)
    return "".join(r.choice(nucleotides) for _ in range(n))


def mutate_seqs(seqs: DataFrame, seq: str = "seq", nucleotides: str = "NACTG", mutations: int = 1) -> DataFrame:
    """All distinct sequences within ``mutations`` substitutions, the originals included."""
    out = seqs.select(F.col(seq).alias("seq")).filter("seq is not null").distinct()
    letters = F.array(*[F.lit(x) for x in nucleotides])
    for _ in range(mutations):
        each = out.filter("length(seq) > 0").select("seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i")).select("seq", "i", F.explode(letters).alias("n"))
        out = out.unionByName(each.select(F.concat(F.expr("substring(seq, 1, i - 1)"), "n", F.expr("substring(seq, i + 1)")).alias("seq"))).distinct()
    return out


def with_next(genome: DataFrame, n: int) -> DataFrame:
    """Tiles (chrom, tile_no, seq) with the first n characters of the tiles that follow appended; an equi-join, no window over a chromosome."""
    tile = F.length("seq")
    out = genome.select("chrom", "tile_no", "seq", F.lit("").alias("__more"))
    size = genome.agg(F.max(tile)).collect()[0][0] or 1
    for d in range(1, -(-n // size) + 1):
        nxt = genome.select("chrom", (F.col("tile_no") - d).alias("tile_no"), F.col("seq").alias("__n"))
        out = out.join(nxt, ["chrom", "tile_no"], "left").select("chrom", "tile_no", "seq", F.concat("__more", F.coalesce("__n", F.lit(""))).alias("__more"))
    return out.select("chrom", "tile_no", "seq", F.concat("seq", F.substring("__more", 1, n)).alias("long"))


def segment_sequences(genome: DataFrame, segs: DataFrame, tile: int, key: str) -> DataFrame:
    """(key, seq): spliced sequence of each chain from its 5' end. ``segs``: key, chrom, strand, start, end; positions that the genome lacks are N.

    Segments meet the tiles they touch by an equi-join; only the pieces are gathered per chain.
    """
    s = segs.filter("end > start").withColumn("tile_no", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))))
    j = s.join(genome, ["chrom", "tile_no"], "left")
    a = F.greatest(F.col("start") - F.col("tile_no") * tile, F.lit(0))
    b = F.least(F.col("end") - F.col("tile_no") * tile, F.lit(tile))
    piece = F.rpad(F.coalesce(F.substring("seq", (a + 1).cast("int"), (b - a).cast("int")), F.lit("")), (b - a).cast("int"), "N")
    g = j.groupBy(key, "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "tile_no", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return g.select(key, F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))


def kmers(genome: DataFrame, k: int, tile: int) -> DataFrame:
    """Every k-mer of the genome on the plus strand: chrom, pos, kmer."""
    t = with_next(genome, k - 1)
    at = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)))
    return at.select("chrom", (F.col("tile_no") * tile + F.col("i")).alias("pos"), F.expr(f"substring(long, i + 1, {k})").alias("kmer")).filter(F.length("kmer") == k)


def repeated_kmers(mers: DataFrame, mismatches: int = 0) -> DataFrame:
    """(chrom, pos) of k-mers that align at more than one place of either strand with at most so many mismatches.

    Without mismatches, occurrences of the lesser of a k-mer and its reverse complement are counted (its own reverse complement counts twice).
    With v, k-mers are cut in v + 1 pieces, of which a match must share one: an equi-join on (piece number, piece), then the
    Hamming distance. Distinct k-mers are joined, not their occurrences.
    """
    rc = reverse_complement("kmer")
    canon = mers.filter(~F.col("kmer").contains("N")).withColumn("c", F.least("kmer", rc)).withColumn("own", F.col("kmer") == rc)
    tally = canon.groupBy("c").agg(F.sum(F.when(F.col("own"), 2).otherwise(1)).alias("n"))
    if mismatches:
        tally = materialize(tally, "kmers")
        k = mers.select(F.max(F.length("kmer"))).collect()[0][0] or 0
        cuts = [round(i * k / (mismatches + 1)) for i in range(mismatches + 2)]
        piece = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), F.substring(F.col(c), cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("p")) for i in range(mismatches + 1)])
        u = tally.select("c", F.explode(piece("c")).alias("x")).select("c", "x.i", "x.p")
        both = tally.select("c", "n", F.explode(F.array("c", reverse_complement("c"))).alias("d")).distinct()
        v = both.select("d", "n", F.col("c").alias("cd"), F.explode(piece("d")).alias("x")).select("d", "n", "cd", F.col("x.i").alias("i"), F.col("x.p").alias("p"))
        far = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda a, i: a + (F.substring("c", i, F.lit(1)) != F.substring("d", i, F.lit(1))).cast("int"))
        # The edit distance, which is cut off early, is no greater than the Hamming distance.
        close = (F.col("c") != F.col("d")) & (F.levenshtein("c", "d", mismatches) >= 0)
        near = u.join(v, ["i", "p"]).filter(close).select("c", "d", "cd", "n").distinct().filter(far <= mismatches)
        # Occurrences of other k-mers; of its own reverse complement, each occurrence counts the other strand of itself.
        tally = tally.unionByName(near.select("c", F.when(F.col("cd") != F.col("c"), F.col("n")).otherwise(1).alias("n"))).groupBy("c").agg(F.sum("n").alias("n"))
    return canon.join(tally.filter("n > 1").select("c"), "c", "left_semi").select("chrom", "pos")


def position_runs(repeats: DataFrame, size: int) -> DataFrame:
    """(chrom, s, e): runs of successive positions, cut at multiples of ``size``."""
    w = Window.partitionBy("chrom", "tile").orderBy("pos")
    t = repeats.distinct().withColumn("tile", F.floor(F.col("pos") / size))
    local = t.withColumn("isle", F.col("pos") - F.row_number().over(w)).groupBy("chrom", "tile", "isle").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    return local.select("chrom", "s", "e")


def stitched(local: DataFrame, size: Column) -> DataFrame:
    """Runs (chrom, s, e) that were cut at multiples of ``size`` joined again: only those at such a border, two a tile at most, may go on in the next one."""
    edge = (F.col("s") % size == 0) | (F.col("e") % size == 0)
    over = Window.partitionBy("chrom").orderBy("s")
    whole = local.filter(edge).withColumn("new", F.coalesce((F.col("s") > F.lag("e").over(over)).cast("int"), F.lit(1))).withColumn("id", F.sum("new").over(over)).groupBy("chrom", "id").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return local.filter(~edge).select("chrom", "s", "e").unionByName(whole.select("chrom", "s", "e"))


def strand_masks(runs: DataFrame, k: int, offset: int) -> DataFrame:
    both = F.array(F.struct(F.lit("+").alias("strand"), F.lit(offset).alias("by")), F.struct(F.lit("-").alias("strand"), F.lit(k - 1 - offset).alias("by")))
    return runs.withColumn("x", F.explode(both)).select("chrom", "x.strand", (F.col("s") + F.col("x.by")).alias("start"), (F.col("e") + F.col("x.by")).alias("end"))


def repeat_mask(repeats: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Masks on both strands from the starts of repeated k-mers: chrom, strand, start, end. Plus starts are moved by ``offset``, minus ones by k - 1 - offset."""
    size = 1_000_000
    return strand_masks(stitched(position_runs(repeats, size), F.lit(size)), k, offset)


def all_seqs(n: int, nucleotides: str = "ACGT") -> list[str]:
    return ["".join(x) for x in itertools.product(nucleotides, repeat=n)]
