"""Chain functions against a brute force on positions."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import chains as C

SCHEMA = "i int, chrom string, strand string, segments array<struct<start:bigint,end:bigint>>, lo bigint, hi bigint"


def merged(segs):
    out = []
    for a, b in sorted(segs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chain_rows(n=40, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at, segs = r.randrange(20), []
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(1, 9)
            segs.append((at, at + k))
            at += k + r.randrange(1, 9)
        pos = [p for a, b in segs for p in range(a, b)]
        a, b = sorted(r.sample(range(len(pos) + 1), 2)) if len(pos) > 1 else (0, 1)
        rows.append((i, "c1", r.choice("+-."), segs, pos[a], pos[b - 1] + 1))
    return rows


@pytest.fixture(scope="module")
def chains(spark):
    return spark.createDataFrame(chain_rows(), SCHEMA)


def positions(row):
    return [p for s in row["segments"] for p in range(s["start"], s["end"])]


def five(row, pos=None):
    pos = positions(row) if pos is None else pos
    return pos[::-1] if row["strand"] == "-" else pos


def spans(v):
    return [(s["start"], s["end"]) for s in v]


def test_coordinates_and_parts(chains):
    q = chains.select(
        "*",
        C.length("segments").alias("n"),
        C.positions("segments").alias("pos"),
        C.chain_coordinate("segments", "strand", "lo").alias("at_lo"),
        C.genomic_coordinate("segments", "strand", F.lit(2)).alias("g2"),
        C.genomic_coordinate("segments", "strand", F.lit(500)).alias("g500"),
        C.subchain("segments", "strand", F.lit(1), F.lit(6)).alias("part"),
        C.junctions("segments").alias("j"),
        C.from_positions(F.reverse(C.positions("segments"))).alias("back"),
        C.cds_bounds("segments", "strand", "lo", "hi").alias("b"),
        C.chain_coordinate("segments", "strand", F.lit(-5)).alias("outside"),
        C.from_text(C.to_text("chrom", "segments", "strand")).alias("text"),
    )
    q = q.select("*", C.get_cds("segments", "strand", "b").alias("cds"), C.get_utr5("segments", "strand", "b").alias("u5"), C.get_utr3("segments", "strand", "b").alias("u3"), C.cds_genome_bounds("segments", "strand", "b.start", "b.end").alias("gb"))
    for r in q.collect():
        pos, way = positions(r), five(r)
        assert (r["n"], list(r["pos"])) == (len(pos), pos)
        assert way[r["at_lo"]] == r["lo"]
        assert r["g2"] == (way[2] if len(way) > 2 else None) and r["g500"] is None and r["outside"] is None
        assert sorted(way[1:6]) == [p for a, b in spans(r["part"]) for p in range(a, b)]
        s = spans(r["segments"])
        assert spans(r["j"]) == [(a[1], b[0]) for a, b in zip(s, s[1:])]
        assert spans(r["back"]) == merged(s)
        coding = [p for p in pos if r["lo"] <= p < r["hi"]]
        assert [p for a, b in spans(r["cds"]) for p in range(a, b)] == coding
        first = way.index(five(r, coding)[0])
        assert sorted(way[:first]) == [p for a, b in spans(r["u5"]) for p in range(a, b)]
        assert sorted(way[first + len(coding) :]) == [p for a, b in spans(r["u3"]) for p in range(a, b)]
        assert (r["gb"]["start"], r["gb"]["end"]) == (r["lo"], r["hi"])
        assert (r["text"]["chrom"], r["text"]["strand"], spans(r["text"]["segments"])) == ("c1", r["strand"], merged(s))


def test_set_operations_and_relations(spark, chains):
    a = chains.select(F.struct("i", "chrom", "strand", "segments").alias("a"))
    b = spark.createDataFrame(chain_rows(25, 7), SCHEMA).select(F.struct("i", "chrom", "strand", "segments").alias("b"))
    x, y = F.col("a"), F.col("b")
    p = a.crossJoin(b).select(
        "a", "b", C.intersect("a.segments", "b.segments").alias("both"), C.subtract("a.segments", "b.segments").alias("rest"), C.add_segments("a.segments", "b.segments").alias("union"), C.overlaps(x, y).alias("ov"), C.unstranded_overlaps(x, y).alias("un"), C.antisense_overlaps(x, y).alias("anti"), C.covers(x, y).alias("covers"), F.size(C.shared_segments(x, y)).alias("shared"), C.chains_equal(x, y).alias("eq"), C.contains(x, y).alias("contains")
    )
    for r in p.collect():
        u, v = set(positions(r["a"])), set(positions(r["b"]))
        flat = lambda c: {q for s, e in spans(r[c]) for q in range(s, e)}
        assert flat("both") == u & v and flat("rest") == u - v and flat("union") == u | v
        sa, sb = r["a"]["strand"], r["b"]["strand"]
        assert r["un"] == bool(u & v)
        assert r["ov"] == (bool(u & v) and (sa == sb or "." in (sa, sb)))
        assert r["anti"] == (bool(u & v) and (sa != sb or "." in (sa, sb)))
        same = sa == sb
        assert r["shared"] == (len(set(spans(r["a"]["segments"])) & set(spans(r["b"]["segments"]))) if same else 0)
        assert r["covers"] == (same and v <= u)
        assert r["eq"] == (same and spans(r["a"]["segments"]) == spans(r["b"]["segments"]))
        if r["contains"]:
            assert same and v <= u


def test_literals(spark):
    seg = lambda *s: F.array(*[C.segment(F.lit(a), F.lit(b)) for a, b in s])
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).collect()[0]["v"]
    assert spans(get(C.merge_segments(seg((10, 20), (0, 10))))) == [(0, 20)]
    assert spans(get(C.merge_segments(seg((3, 3))))) == [(3, 3)]
    empty = F.struct(F.lit("c").alias("chrom"), F.lit("+").alias("strand"), C.no_segments().alias("segments"))
    assert get(C.chains_equal(empty, empty)) is False
    assert get(C.to_text(F.lit("c"), C.no_segments(), F.lit("+"))) == "na"
    assert get(F.size(C.from_text(F.lit("None:(None)"))["segments"])) == 0
    assert get(C.to_igv(F.lit("c"), F.lit(4), F.lit(9))) == "c:5-10"
    back = get(C.from_igv(F.lit("c:5-10"), F.lit("-")))
    assert (back["start"], back["end"], back["strand"]) == (4, 9, "-")
    stop = get(C.add_three_for_stop(seg((0, 10), (20, 30)), F.lit("+"), F.lit(2), F.lit(9)))
    assert (stop["cds_genome_start"], stop["cds_genome_end"]) == (2, 22)
    grown = get(C.add_three_for_stop(seg((5, 10), (20, 30)), F.lit("-"), F.lit(6), F.lit(25)))
    assert (spans(grown["segments"])[0], grown["cds_genome_start"], grown["cds_genome_end"]) == ((3, 10), 3, 25)
    none = get(C.add_three_for_stop(seg((5, 10)), F.lit("+"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    assert none["cds_genome_start"] is None
    w = get(C.window_landmark(seg((0, 10), (20, 30)), F.lit("+"), F.lit(3), 5, 10))
    assert (spans(w["segments"]), w["offset"], w["ref_pos"]) == ([(0, 10), (20, 23)], 2, 3)
    attr = F.create_map(F.lit("Parent"), F.lit("b,a"), F.lit("Name"), F.lit("n"))
    assert get(C.get_name(attr, F.lit("t"))) == "n" and get(C.get_gene(attr, F.lit("n"))) == "a,b"
