import math

from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators import annotation as N
from strandloom.operators import junctions as J
from strandloom.operators import metagene as MG
from strandloom.operators import overlap as O
from strandloom.operators import regions as R
from strandloom.operators import stats as T
from strandloom.streaming.live import assemble_on_punctuation


def test_semi_joins_keep_repeated_rows(spark):
    iv = "chrom string, strand string, start bigint, end bigint, n int"
    left = spark.createDataFrame([("c", "+", 0, 10, 1), ("c", "+", 0, 10, 1), ("c", ".", 5, 9, 2), ("c", None, 0, 10, 3), ("c", "-", 50, 60, 4), ("d", "+", 0, 3, 5)], iv)
    right = spark.createDataFrame([("c", "+", 8, 12, 0), ("c", "+", 9, 12, 0), ("c", "-", 100, 400_000, 0)], iv)
    for width in (None, 4):
        semi = O.overlap_join(left, right, how="left_semi", width=width)
        assert sorted(r["n"] for r in semi.collect()) == [1, 1, 2] and semi.columns == left.columns
        assert sorted(r["n"] for r in O.overlap_join(left, right, how="left_anti", width=width).collect()) == [3, 4, 5]
        assert sorted((r["n"], r["start_r"]) for r in O.overlap_join(left, right, width=width).collect()) == [(1, 8), (1, 8), (1, 9), (1, 9), (2, 8)]
    both = left.filter("strand = '.'")
    assert O.overlap_join(both, both).count() == 1
    assert O.overlap_join(left, right.limit(0)).count() == 0 and O.position_join(left.withColumn("pos", F.col("start")), right.limit(0)).count() == 0


def test_reads_in_overlapping_segments(spark):
    reads = spark.createDataFrame([("r", "c", "+", 3)] * 2 + [("s", "c", "+", 30)], "read_id string, chrom string, strand string, pos bigint")
    segs = spark.createDataFrame([("k", "c", "+", 0, 5), ("k", "c", "+", 2, 8), ("l", "c", ".", 0, 4)], "key string, chrom string, strand string, start bigint, end bigint")
    assert sorted((r["read_id"], r["key"]) for r in R.reads_in_regions(reads, segs, "key").collect()) == [("r", "k"), ("r", "k"), ("r", "l"), ("r", "l")]


def test_merge_and_positions(spark):
    cases = [[(5, 9), (0, 3)], [(0, 3), (3, 5)], [(0, 9), (2, 4), (20, 21)], [(4, 6)], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s {C.SEGMENTS}")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", C.merge_segments("s").alias("m")).collect()}
    assert got == {0: [(0, 3), (5, 9)], 1: [(0, 5)], 2: [(0, 9), (20, 21)], 3: [(4, 6)], 4: []}
    p = spark.createDataFrame([(0, [7, 3, 4, 4, 5, 9]), (1, []), (2, [1])], "i int, p array<int>")
    assert {r["i"]: [tuple(x) for x in r["s"]] for r in p.select("i", C.from_positions("p").alias("s")).collect()} == {0: [(3, 6), (7, 8), (9, 10)], 1: [], 2: [(1, 2)]}


def test_window_parts(spark):
    assert MG.normalization_window(50, (-30, 20)) == (-30, 20) and MG.normalization_window(50, None, (70, 100)) == (20, 50) and MG.normalization_window(50) == (-30, 0)
    df = spark.createDataFrame([("+", [(0, 10), (20, 40)], 45, 50), ("-", [(0, 10), (20, 40)], 45, 50)], f"strand string, segments {C.SEGMENTS}, a int, z int")
    got = {r["strand"]: [tuple(x) for x in r["s"]] for r in df.select("strand", MG.roi_coding_part("segments", "strand", "a", "z").alias("s")).collect()}
    assert got == {"+": [(5, 10), (20, 40)], "-": [(0, 10), (20, 35)]}


def test_gff3_types_and_names(spark):
    f = spark.createDataFrame([("c", "+", "lnc_RNA", 0, 50, "t", ["g"]), ("c", "+", "noncoding_exon", 0, 10, None, ["t"]), ("c", "+", "interior_exon", 20, 30, None, ["t"]), ("c", "+", "CDS_predicted", 22, 28, None, ["t"])], "chrom string, strand string, feature_type string, start bigint, end bigint, ID string, parents array<string>")
    t = N.assemble_gff3(f)[0].collect()[0]
    assert ([tuple(s) for s in t["segments"]], t["cds_genome_start"], t["gene_id"]) == ([(0, 10), (20, 30)], 22, "g") and len(N.TRANSCRIPT_TYPES) == len(set(N.TRANSCRIPT_TYPES)) > 90
    names = spark.createDataFrame([("c@x@5^9(-)",), ("nothing",), (None,)], "n string").select(J.parse_junction_name("n").alias("j")).collect()
    assert tuple(names[0]["j"]) == ("c@x", 5, 9, "-") and names[1]["j"] is None and names[2]["j"] is None
    p = spark.createDataFrame([("a", "gene", []), ("b", "exon", ["a"])], "id string, feature_type string, parents array<string>")
    assert {r["feature_type"] for r in N.parent_types(p, keep=["exon"]).collect()} == {"exon"}


def test_numbers_behind_plots(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (9.0, 4.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    h = {r["bin"]: r["n"] for r in T.histogram(df, "x", 4).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 1} and T.histogram(df.limit(0), "x").count() == 0
    assert sum(r["n"] for r in T.scatter_histograms(df, "x", "y", 3).collect()) == 6
    b = {(r["x"], r["part"]): (r["bottom"], r["height"]) for r in T.stacked_bars(df.filter("x < 2.5"), "x", ["y", "x"]).collect()}
    assert b == {(1.0, "y"): (0.0, 2.0), (1.0, "x"): (2.0, 1.0), (2.0, "y"): (0.0, 2.5), (2.0, "x"): (2.5, 2.0)}
    k = T.kernel_density(df, "x", 5, log=2).orderBy("x").collect()
    assert abs(k[0]["x"] - 1) < 1e-9 and abs(k[-1]["x"] - 9) < 1e-9 and all(r["density"] > 0 and math.isfinite(r["density"]) for r in k)


def test_punctuation(spark, tmp_path):
    """Transcripts come out at ``###``, at a change of chrom in a sorted file, and at the end of the file."""
    exon = lambda c, a, b, t: f"{c}\ts\texon\t{a}\t{b}\t.\t+\t.\tID=e;Parent={t}"
    text = [exon("c", 1, 5, "t1"), exon("c", 9, 12, "t1,t2"), "###", exon("c", 20, 30, "t3"), exon("d", 1, 4, "t4"), "##end"]
    src = str(tmp_path / "lines")
    spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, number int, line string").coalesce(1).write.parquet(src)
    for by_chrom, name in ((False, "marks"), (True, "marks_sorted")):
        q = assemble_on_punctuation(spark.readStream.schema("file string, number int, line string").parquet(src), sorted_by_chrom=by_chrom).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = {r["transcript_id"]: (r["chrom"], [tuple(s) for s in r["segments"]]) for r in spark.sql(f"select * from {name}").collect()}
        assert got == {"t1": ("c", [(0, 5), (8, 12)]), "t2": ("c", [(8, 12)]), "t3": ("c", [(19, 30)]), "t4": ("d", [(0, 4)])}
