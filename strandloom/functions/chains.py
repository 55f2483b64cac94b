"""Column functions on discontinuous features (chains).

A chain is a row with ``chrom``, ``strand`` and ``segments``, an array of ``struct<start, end>`` (0-based, half-open),
ascending and disjoint as :func:`merge_segments` gives it. All functions are row-local expressions, so they fuse into
their stage; nulls in any argument give null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:bigint,end:bigint>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def segment(start: Column | str, end: Column | str) -> Column:
    return F.struct(col(start).cast("bigint").alias("start"), col(end).cast("bigint").alias("end"))


def no_segments() -> Column:
    return F.array().cast(SEGMENTS)


# Strands are compared as bit masks: a chain without strand overlaps either strand.
def strand_bits(strand: Column | str) -> Column:
    s = col(strand)
    return F.when(s == "+", 1).when(s == "-", 2).when(s == ".", 3).otherwise(0)


def flip_strand(strand: Column | str) -> Column:
    s = col(strand)
    return F.when(s == "+", "-").when(s == "-", "+").otherwise(s)


def merge_segments(segs: Column | str) -> Column:
    """Sorted; overlapping and touching segments merged; fewer than two segments as they are."""
    s = F.array_sort(col(segs))
    empty = F.struct(no_segments().alias("done"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], x["end"]).alias("end"))
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).when(x["start"] <= acc["open"]["end"], F.struct(acc["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open")))

    merged = F.aggregate(s, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    # Nothing to merge is the common case, and takes one look at neighbours.
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: b["start"] <= a["end"])
    return F.when(F.size(col(segs)) < 2, col(segs).cast(SEGMENTS)).when(~F.exists(pairs, lambda x: x), s.cast(SEGMENTS)).otherwise(merged)


def length(segs: Column | str) -> Column:
    """Nucleotides in the segments; 0 for an empty chain."""
    return F.aggregate(col(segs), F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def span_start(segs: Column | str) -> Column:
    return F.array_min(F.transform(col(segs), lambda x: x["start"]))


def span_end(segs: Column | str) -> Column:
    return F.array_max(F.transform(col(segs), lambda x: x["end"]))


def positions(segs: Column | str) -> Column:
    """Every position of the segments, in genome order."""
    nonempty = F.filter(col(segs), lambda x: x["end"] > x["start"])
    return F.flatten(F.transform(nonempty, lambda x: F.sequence(x["start"], x["end"] - 1)))


def from_positions(pos: Column | str) -> Column:
    """The fewest segments that hold just these positions; repeats and order do not matter."""
    p = F.array_sort(F.array_distinct(F.transform(col(pos), lambda x: x.cast("bigint"))))
    n = F.size(p)
    # A segment begins where the neighbour below is missing and ends where the one above is; both lists are in order.
    neighbour = lambda by: F.concat(F.array(F.lit(None).cast("bigint")), F.slice(p, 1, F.greatest(n - 1, F.lit(0)))) if by < 0 else F.concat(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("bigint")))
    ends = lambda by: F.array_compact(F.zip_with(p, neighbour(by), lambda x, y: F.when(~F.coalesce(y == x + by, F.lit(False)), x)))
    return F.when(n < 1, no_segments()).otherwise(F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))))


def offsets(segs: Column | str) -> Column:
    """The segments with ``off``, the nucleotides of the chain before each, in genome order."""
    start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,off:bigint>>").alias("done"), F.lit(0).cast("bigint").alias("off"))
    step = lambda a, x: F.struct(F.array_append(a["done"], F.struct(x["start"].alias("start"), x["end"].alias("end"), a["off"].alias("off"))).alias("done"), (a["off"] + x["end"] - x["start"]).alias("off"))
    return F.aggregate(col(segs), start, step, lambda a: a["done"])


def chain_coordinate(segs: Column | str, strand: Column | str, x: Column | str, stranded: bool = True) -> Column:
    """Genomic position to position in the chain, counted from its 5' end if ``stranded``; null outside the chain and in introns."""
    p = col(x)
    at = F.aggregate(offsets(segs), F.lit(None).cast("bigint"), lambda a, s: F.when((p >= s["start"]) & (p < s["end"]), s["off"] + p - s["start"]).otherwise(a))
    return F.when(F.lit(stranded) & (col(strand) == "-"), length(segs) - at - 1).otherwise(at)


def genomic_coordinate(segs: Column | str, strand: Column | str, x: Column | str, stranded: bool = True) -> Column:
    """Inverse of :func:`chain_coordinate`; null outside ``[0, length)``."""
    q = F.when(F.lit(stranded) & (col(strand) == "-"), length(segs) - col(x) - 1).otherwise(col(x))
    return F.aggregate(offsets(segs), F.lit(None).cast("bigint"), lambda a, s: F.when((q >= s["off"]) & (q < s["off"] + s["end"] - s["start"]), s["start"] + q - s["off"]).otherwise(a))


def subchain(segs: Column | str, strand: Column | str, start: Column | str, end: Column | str, stranded: bool = True) -> Column:
    """The part ``[start, end)`` of a chain in its own coordinates; bounds outside are clipped. Works on bounds, never on positions."""
    n, minus = length(segs), F.lit(stranded) & (col(strand) == "-")
    a = F.when(minus, n - col(end)).otherwise(col(start))
    b = F.when(minus, n - col(start)).otherwise(col(end))
    clip = F.transform(offsets(segs), lambda s: F.struct((s["start"] + F.greatest(a - s["off"], F.lit(0))).cast("bigint").alias("start"), F.least(s["end"], s["start"] + b - s["off"]).cast("bigint").alias("end")))
    return F.filter(clip, lambda s: s["end"] > s["start"])


def junctions(segs: Column | str) -> Column:
    """The introns between neighbouring segments, as segments."""
    s = col(segs)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    return F.when(F.size(s) > 1, pairs).otherwise(no_segments())


def add_segments(segs: Column | str, more: Column | str) -> Column:
    return merge_segments(F.concat(col(segs), col(more)))


def intersect(segs: Column | str, other: Column | str) -> Column:
    """What two chains have in common, as segments."""
    cut = F.flatten(F.transform(col(segs), lambda a: F.transform(F.filter(col(other), lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])), lambda b: F.struct(F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end")))))
    return merge_segments(cut)


def subtract(segs: Column | str, other: Column | str) -> Column:
    """What the first chain has and the second has not, as segments. ``other`` must be merged."""
    holes = lambda a: F.filter(col(other), lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]))

    def rest(a: Column) -> Column:
        h = holes(a)
        lefts = F.concat(F.array(a["start"]), F.transform(h, lambda b: b["end"]))
        rights = F.concat(F.transform(h, lambda b: b["start"]), F.array(a["end"]))
        return F.filter(F.zip_with(lefts, rights, lambda x, y: F.struct(x.alias("start"), y.alias("end"))), lambda s: s["end"] > s["start"])

    return F.flatten(F.transform(col(segs), rest))


def add_masks(segs: Column | str, masks: Column | str, new: Column | str) -> Column:
    """Old and new masks, cut to the chain's own positions."""
    return intersect(segs, merge_segments(F.concat(col(masks), col(new))))


def masked_length(segs: Column | str, masks: Column | str) -> Column:
    return length(segs) - length(masks)


def get_name(attr: Column | str, text: Column | str) -> Column:
    a = col(attr)
    return F.coalesce(a["ID"], a["Name"], a["name"], col(text))


def get_gene(attr: Column | str, name: Column | str) -> Column:
    """gene_id, else the Parents in order, else ``gene_`` and the name."""
    a = col(attr)
    return F.coalesce(a["gene_id"], F.array_join(F.array_sort(F.split(a["Parent"], ",")), ","), F.concat(F.lit("gene_"), col(name)))


# Coding regions: bounds are genomic, null where nothing is coded.
def cds_bounds(segs: Column | str, strand: Column | str, cds_genome_start: Column | str, cds_genome_end: Column | str) -> Column:
    """struct<start, end> of the coding region in the chain's own coordinates, from its genomic bounds."""
    end = col(cds_genome_end)
    # A genomic end in an intron stands for the end of the exon before; one behind the chain for none.
    inside = F.aggregate(col(segs), F.lit(None).cast("bigint"), lambda a, s: F.when(s["start"] < end, F.least(s["end"], end)).otherwise(a))

    def bounds(o: Column) -> Column:
        at = lambda p: F.aggregate(o, F.lit(None).cast("bigint"), lambda a, s: F.when((p >= s["start"]) & (p < s["end"]), s["off"] + p - s["start"]).otherwise(a))
        x = F.struct(at(col(cds_genome_start).cast("bigint")).alias("lo"), at(inside - 1).alias("hi"), F.aggregate(o, F.lit(0).cast("bigint"), lambda a, s: s["off"] + s["end"] - s["start"]).alias("n"))
        minus = col(strand) == "-"
        turned = lambda b: F.struct(F.when(minus, b["n"] - b["hi"] - 1).otherwise(b["lo"]).alias("start"), F.when(minus, b["n"] - b["lo"]).otherwise(b["hi"] + 1).alias("end"))
        return let(x, lambda b: F.when(b["lo"].isNotNull() & b["hi"].isNotNull(), turned(b)))

    return let(offsets(segs), bounds)


def cds_genome_bounds(segs: Column | str, strand: Column | str, cds_start: Column | str, cds_end: Column | str) -> Column:
    """struct<start, end> of the coding region on the genome, from its bounds in the chain."""
    a = genomic_coordinate(segs, strand, cds_start)
    b = genomic_coordinate(segs, strand, col(cds_end) - 1)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("start"), (F.greatest(a, b) + 1).alias("end")))


def get_cds(segs: Column | str, strand: Column | str, bounds: Column | str) -> Column:
    """The coding part; empty if nothing is coded."""
    b = col(bounds)
    return F.when(b.isNull(), no_segments()).otherwise(subchain(segs, strand, b["start"], b["end"]))


def get_utr5(segs: Column | str, strand: Column | str, bounds: Column | str) -> Column:
    b = col(bounds)
    return F.when(b.isNull(), no_segments()).otherwise(subchain(segs, strand, F.lit(0), b["start"]))


def get_utr3(segs: Column | str, strand: Column | str, bounds: Column | str) -> Column:
    b = col(bounds)
    return F.when(b.isNull(), no_segments()).otherwise(subchain(segs, strand, b["end"], length(segs)))


def add_three_for_stop(segs: Column | str, strand: Column | str, cds_genome_start: Column | str, cds_genome_end: Column | str) -> Column:
    """struct<segments, cds_genome_start, cds_genome_end> with the coding region three nucleotides longer at its 3' end.

    The stop codon skips introns; where the chain ends first, its terminal segment grows.
    """
    s = col(segs)
    minus = col(strand) == "-"
    n = F.size(s)
    same = F.struct(s.cast(SEGMENTS).alias("segments"), col(cds_genome_start).cast("bigint").alias("cds_genome_start"), col(cds_genome_end).cast("bigint").alias("cds_genome_end"))

    def grow(b: Column) -> Column:
        over = F.greatest(b["end"] + 3 - length(segs), F.lit(0))
        return F.transform(s, lambda x, i: F.struct((x["start"] - F.when(minus & (i == 0), over).otherwise(0)).alias("start"), (x["end"] + F.when(~minus & (i == n - 1), over).otherwise(0)).alias("end")))

    def coding(g: Column, last: Column) -> Column:
        lo = F.when(minus, last).otherwise(col(cds_genome_start)).cast("bigint")
        hi = F.when(minus, col(cds_genome_end)).otherwise(last + 1).cast("bigint")
        return F.struct(g.cast(SEGMENTS).alias("segments"), lo.alias("cds_genome_start"), hi.alias("cds_genome_end"))

    extended = lambda b: let(grow(b), lambda g: let(genomic_coordinate(g, strand, b["end"] + 2), lambda last: coding(g, last)))
    return let(cds_bounds(segs, strand, cds_genome_start, cds_genome_end), lambda b: F.when(b.isNull(), same).otherwise(extended(b)))


# Text forms.
def to_text(chrom: Column | str, segs: Column | str, strand: Column | str) -> Column:
    """``chrom:s1-e1^s2-e2(strand)``; ``na`` for an empty chain."""
    parts = F.transform(col(segs), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return F.when(F.size(col(segs)) == 0, "na").otherwise(F.concat(col(chrom), F.lit(":"), F.array_join(parts, "^"), F.lit("("), col(strand), F.lit(")")))


def from_text(text: Column | str) -> Column:
    """struct<chrom, strand, segments> of a chain's text; ``na``, ``nan``, ``none``, ``None:(None)`` and unreadable texts give an empty chain."""
    t = col(text)
    body = F.regexp_extract(t, r":([0-9^-]+)\(", 1)
    segs = F.transform(F.filter(F.split(body, r"\^"), lambda p: p.rlike(r"^[0-9]+-[0-9]+$")), lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("bigint").alias("start"), F.split_part(p, F.lit("-"), F.lit(2)).cast("bigint").alias("end")))
    ok = F.size(segs) > 0
    return F.struct(F.when(ok, F.regexp_extract(t, r"^(.*):[0-9^-]+\([-+.]\)$", 1)).alias("chrom"), F.when(ok, F.regexp_extract(t, r"\(([-+.])\)$", 1)).alias("strand"), F.when(ok, merge_segments(segs)).otherwise(no_segments()).alias("segments"))


def to_igv(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    """``chrom:(start+1)-(end+1)``, as the reading counterpart expects it."""
    return F.concat(col(chrom), F.lit(":"), (col(start) + 1).cast("string"), F.lit("-"), (col(end) + 1).cast("string"))


def from_igv(text: Column | str, strand: Column | str) -> Column:
    g = lambda i: F.regexp_extract(col(text), r"^(.*):([0-9]+)-([0-9]+)$", i)
    return F.struct(g(1).alias("chrom"), (g(2).try_cast("bigint") - 1).alias("start"), (g(3).try_cast("bigint") - 1).alias("end"), col(strand).alias("strand"))


def window_landmark(segs: Column | str, strand: Column | str, landmark: Column | str, upstream: int, downstream: int, delta: int = 0) -> Column:
    """struct<segments, offset, ref_pos>: the window around a landmark (in chain coordinates), clipped to the chain.

    ``offset`` is how far the clipped window begins behind the full one; ``ref_pos`` the genomic position of the landmark, also
    where it lies one behind the last nucleotide.
    """
    at = col(landmark) + delta
    n = length(segs)
    lo, hi = F.greatest(at - upstream, F.lit(0)), F.least(at + downstream, n)
    part = F.when(hi > lo, subchain(segs, strand, lo, hi)).otherwise(no_segments())
    last = genomic_coordinate(segs, strand, n - 1) + F.when(col(strand) == "-", -1).otherwise(1)
    ref = F.when(at == n, last).otherwise(genomic_coordinate(segs, strand, at))
    return F.struct(part.alias("segments"), F.greatest(-(at - upstream), F.lit(0)).cast("bigint").alias("offset"), ref.alias("ref_pos"))


def window_cds_start(segs: Column | str, strand: Column | str, bounds: Column | str, upstream: int, downstream: int) -> Column:
    return F.when(col(bounds).isNotNull(), window_landmark(segs, strand, col(bounds)["start"], upstream, downstream))


def window_cds_stop(segs: Column | str, strand: Column | str, bounds: Column | str, upstream: int, downstream: int) -> Column:
    """The landmark is the first nucleotide of the stop codon."""
    return F.when(col(bounds).isNotNull(), window_landmark(segs, strand, col(bounds)["end"] - 3, upstream, downstream))


# Relations of segments and chains. ``a`` and ``b`` are structs or rows' columns (chrom, strand, segments).
def segment_contains(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (b["start"] >= a["start"]) & (b["end"] <= a["end"])


def segment_overlaps(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def unstranded_overlaps(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & F.exists(a["segments"], lambda x: F.exists(b["segments"], lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def overlaps(a: Column, b: Column) -> Column:
    return unstranded_overlaps(a, b) & (strand_bits(a["strand"]).bitwiseAND(strand_bits(b["strand"])) > 0)


def antisense_overlaps(a: Column, b: Column) -> Column:
    return unstranded_overlaps(a, b) & ((a["strand"] == ".") | (b["strand"] == ".") | (a["strand"] != b["strand"]))


def shared_segments(a: Column, b: Column) -> Column:
    """Segments that both chains have with the same bounds."""
    return F.when((a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]), F.array_intersect(a["segments"], b["segments"])).otherwise(no_segments())


def covers(a: Column, b: Column) -> Column:
    """Every segment of b lies inside one of a."""
    inside = F.forall(b["segments"], lambda y: F.exists(a["segments"], lambda x: (y["start"] >= x["start"]) & (y["end"] <= x["end"])))
    return (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (F.size(b["segments"]) > 0) & inside


def contains(a: Column, b: Column) -> Column:
    """b is a part of a: one segment inside an exon, or a run of a's junctions with ends inside their exons."""
    ja, jb = junctions(a["segments"]), junctions(b["segments"])
    one = F.exists(a["segments"], lambda x: (b["segments"][0]["start"] >= x["start"]) & (b["segments"][0]["end"] <= x["end"]))
    first = F.array_position(ja, jb[0])
    run = (first > 0) & (F.slice(ja, F.greatest(first, F.lit(1)).cast("int"), F.size(jb)) == jb)
    same = (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (length(b["segments"]) <= length(a["segments"]))
    many = run & covers(a, b)
    return same & F.when(F.size(b["segments"]) == 0, F.lit(False)).when(F.size(b["segments"]) == 1, one).otherwise(many)


def chains_equal(a: Column, b: Column) -> Column:
    """The same chrom, strand and segments; two empty chains are not equal."""
    return (F.size(a["segments"]) > 0) & (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"]) & (a["segments"] == b["segments"])


def transcripts_equal(a: Column, b: Column) -> Column:
    return chains_equal(a, b) & a["cds_genome_start"].eqNullSafe(b["cds_genome_start"]) & a["cds_genome_end"].eqNullSafe(b["cds_genome_end"])


def chain_order(chrom: Column | str, segs: Column | str, strand: Column | str, name: Column | str) -> list[Column]:
    """Sort keys of the total order of chains: span, strand, then length, then name."""
    return [col(chrom), span_start(segs), span_end(segs), strand_bits(strand), length(segs), col(name)]
