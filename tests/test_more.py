import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators import junctions as J
from strandloom.operators import sequence as S
from strandloom.operators import stats as T
from strandloom.operators.annotation import identical_attributes, parse_gtf_attributes
from strandloom.operators.genes import components
from strandloom.operators.overlap import candidates, overlap_join
from strandloom.operators.regions import count_vectors, counts_in_region
from strandloom.streaming.live import accumulate_sites, assemble_on_close, tee

SITES = "chrom string, strand string, pos bigint, value double"
SEGS = "key string, chrom string, strand string, start bigint, end bigint"


def test_counts_in_region_edges(spark):
    counts = spark.createDataFrame([("c", "+", 5, 2.0), ("c", "-", 5, 8.0), ("c", "+", 9, 1.0), ("c", "+", 20_000, 3.0)], SITES)
    segs = spark.createDataFrame([("a", "c", "+", 0, 10), ("z", "c", "+", 4, 4), ("none", "d", "+", 0, 5), ("both", "c", ".", 5, 6), ("long", "c", "+", 0, 50_000)], SEGS)
    masks = spark.createDataFrame([("c", "+", 8, 12), ("c", "+", 9, 13)], "chrom string, strand string, start bigint, end bigint")
    r = {x["key"]: x for x in counts_in_region(counts, segs, "key", masks, total=1e6).collect()}
    assert (r["a"]["counts"], r["a"]["length"], r["a"]["rpkm"]) == (2.0, 8, 250.0)
    assert r["z"]["counts_per_nucleotide"] != r["z"]["counts_per_nucleotide"] and r["none"]["counts"] == 0
    assert r["both"]["counts"] == 10 and r["long"]["counts"] == 5 and r["long"]["length"] == 49_995
    chains = spark.createDataFrame([("m", "c", "-", [(4, 7), (9, 11)])], f"key string, chrom string, strand string, segments {C.SEGMENTS}")
    assert count_vectors(counts, chains, "key").collect()[0]["vector"] == [0, 0, 0, 8, 0]


def test_overlap_join(spark):
    f = spark.createDataFrame([(f"f{i}", "c", "+-."[i % 3], i * 7, i * 7 + (40_000 if i == 4 else 9)) for i in range(30)], SEGS)
    rows = f.collect()
    hit = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
    same = lambda a, b: a["strand"] == b["strand"] or "." in (a["strand"], b["strand"])
    for width in (16, 20_000):
        got = [(r["key"], r["key_r"]) for r in overlap_join(f, f, width=width).collect()]
        assert sorted(got) == sorted((a["key"], b["key"]) for a in rows for b in rows if hit(a, b) and same(a, b))
        semi = overlap_join(f, f.filter("key = 'f0'"), False, width, "left_semi").count()
        assert semi == sum(hit(a, rows[0]) for a in rows) and overlap_join(f, f.filter("key = 'f0'"), False, width, "left_anti").count() == 30 - semi
    assert candidates(f, f).count() >= 900


def test_components(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40) if i % 10 != 9] + [("n3", "n35")], "a string, b string")
    groups = {}
    for r in components(e, "a", "b").collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert {k: len(v) + 1 for k, v in groups.items()} == {"n0": 20, "n10": 10, "n20": 10}


def test_junction_slides(spark):
    #         exon   intron......  exon
    genome = "CCCAAG" + "GTAAGTTTTTTCAG" + "GTCCC"
    left, right = 6, 20
    df = spark.createDataFrame([("c", "+", left, right)], "chrom string, strand string, left bigint, right bigint")
    cut = lambda a, b: F.lit(genome[a:b])
    q = df.withColumn("span", J.match_range(cut(left - 5, left), cut(left, left + 5), cut(right - 5, right), cut(right, right + 5), 5))
    s = q.collect()[0]["span"]
    assert (s["minus"], s["plus"]) == (-2, 2)  # AG | GT on both sides
    q = q.withColumn("canonical", J.canonical_slides(cut(left - 6, left + 7), cut(right - 8, right + 5), F.col("strand"), F.col("span"), 6))
    assert q.collect()[0]["canonical"] == [0]
    known = spark.createDataFrame([("c", "+", left + 1, right + 1)], "chrom string, strand string, left bigint, right bigint")
    masks = spark.createDataFrame([("c", "+", 900, 910)], "chrom string, strand string, start bigint, end bigint")
    r = J.classify(q, known, masks).collect()[0]
    assert (r["kind"], r["slide"]) == ("known", 1)
    assert J.classify(q, known.limit(0), masks).collect()[0]["kind"] == "canonical"
    assert J.classify(q, known, masks.withColumn("start", F.lit(5))).collect()[0]["kind"] == "repetitive"


def test_sequence_functions(spark):
    assert S.seq_to_regex("ANR") == "A[ACGT" + "U][AG]" and len(S.random_seq(9, seed=1)) == 9
    one = spark.createDataFrame([("AC",)], "seq string")
    assert S.mutate_seqs(one, nucleotides="ACG").count() == 5
    assert one.select(S.reverse_complement("seq")).collect()[0][0] == "GT"
    g = spark.createDataFrame([("c", 0, "AAAACCCC"), ("c", 1, "AAAACCTC")], "chrom string, tile_no bigint, seq string")
    mers = S.kmers(g, 6, 8)
    assert mers.count() == 11
    exact = {r["pos"] for r in S.repeated_kmers(mers).collect()}
    near = {r["pos"] for r in S.repeated_kmers(mers, 1).collect()}
    whole = "AAAACCCCAAAACCTC"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    m = [whole[i : i + 6] for i in range(11)]
    want = lambda v: {i for i in range(11) if sum((far(m[i], m[j]) <= v) + (far(m[i], rc(m[j])) <= v) for j in range(11)) > 1}
    assert exact == want(0) and near == want(1)
    assert {(r["strand"], r["start"], r["end"]) for r in S.repeat_mask(spark.createDataFrame([("c", 3), ("c", 4), ("c", 9)], "chrom string, pos bigint"), 6, 2).collect()} == {("+", 5, 7), ("+", 11, 12), ("-", 6, 8), ("-", 12, 13)}


def test_plot_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (9.0, 3.0), (2.5, float("inf"))], "a double, b double")
    assert [tuple(r) for r in T.clean_invalid(df, "a", "b", hi=5.0).collect()] == [(1.0, 2.0), (5.0, 3.0)]
    d = T.kernel_density(spark.createDataFrame([(float(i % 7),) for i in range(50)], "x double"), "x").collect()
    assert len(d) == 100 and all(r["density"] > 0 for r in d)
    assert T.kernel_density(spark.createDataFrame([], "x double"), "x").count() == 0
    assert T.ma_values(df).count() == 3
    rgb = spark.range(1).select(T.rgb_to_hex(T.hex_to_rgb(F.lit("#0a10ff"))).alias("h"), T.darken(T.hex_to_rgb(F.lit("#0a10ff")), 0.1).alias("d"), T.triangle(F.lit(1), F.lit(1), F.lit(2)).alias("t")).collect()[0]
    assert rgb["h"] == "#0a10ff" and rgb["d"] == [0, 0, 230] and rgb["t"]["x"] == 0.5
    h = T.heatmap_order(spark.createDataFrame([("r", 0, 1.0), ("r", 1, 5.0), ("s", 0, 5.0), ("s", 1, 5.0)], "r string, x int, v double"), "r", "x", "v").collect()
    assert {r["r"]: r["peak"] for r in h} == {"r": 1, "s": 0}


def test_table_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None), (3, float("inf"), "z")], "k int, v double, s string")
    b = spark.createDataFrame([(3, float("inf"), "z"), (1, 1.0 + 1e-10, "x"), (2, float("nan"), None)], "k int, v double, s string")
    assert T.table_differences(a, b, ["k"]).count() == 0
    c = b.filter("k < 3").withColumn("v", F.col("v") + 1).withColumn("s", F.lit("q"))
    assert {r["k"]: sorted(r["differing"]) for r in T.table_differences(a, c, ["k"]).collect()} == {1: ["s", "v"], 2: ["s"], 3: ["s", "v"]}
    with pytest.raises(ValueError):
        T.table_differences(a, b.drop("s"), ["k"])


def test_attributes(spark):
    f = spark.createDataFrame([("t", {"a": "1", "b": "2"}), ("t", {"a": "1", "b": "3"}), ("u", {})], "key string, attr map<string,string>")
    assert {r["key"]: r["attr"] for r in identical_attributes(f, "key").collect()} == {"t": {"a": "1"}, "u": {}}
    m = spark.range(1).select(parse_gtf_attributes(F.lit('gene_id "a;b"; tag x; tag "y z"; '))).collect()[0][0]
    assert m == {"gene_id": "a;b", "tag": "x,y z"}


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("c", "+", i % 3, 1.0) for i in range(9)], "chrom string, strand string, pos bigint, weight double").write.parquet(src)
    q = accumulate_sites(spark.readStream.schema("chrom string, strand string, pos bigint, weight double").parquet(src)).writeStream.outputMode("complete").format("memory").queryName("sites").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["pos"]: r["value"] for r in spark.sql("select * from sites").collect()} == {0: 3.0, 1: 3.0, 2: 3.0}
    seen = []
    t = tee(spark.readStream.schema("chrom string, strand string, pos bigint, weight double").parquet(src), [lambda b, n: seen.append(b.count()), lambda b, n: b.write.mode("append").parquet(out)], str(tmp_path / "cp"))
    t.awaitTermination(60)
    assert sum(seen) == 9 and spark.read.parquet(out).count() == 9
    at = dt.datetime(2022, 1, 1)
    rows = [("t1", "c", "+", 0, 5, at), ("t1", "c", "+", 9, 12, at + dt.timedelta(seconds=20)), ("t2", "c", "+", 3, 4, at + dt.timedelta(hours=1))]
    feats = str(tmp_path / "f")
    schema = "transcript_id string, chrom string, strand string, start bigint, end bigint, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(feats)
    q = assemble_on_close(spark.readStream.schema(schema).parquet(feats), "at").writeStream.outputMode("append").format("memory").queryName("tx").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [[tuple(s) for s in r["segments"]] for r in spark.sql("select * from tx where transcript_id = 't1'").collect()] == [[(0, 5), (9, 12)]]
