import random

import pytest

from strandloom.plans import programs as P
from strandloom.sources.text import read_table


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("programs")
    r = random.Random(8)
    seq = "".join(r.choice("ACGT") for _ in range(900))
    seq = seq[:700] + seq[100:160] + seq[760:]  # a repeat of 60 nt
    seq = seq[:220] + "GTAAGC" + seq[226:294] + "TTTCAG" + seq[300:]  # an intron from 220 to 300
    (d / "g.fa").write_text(f">c1 x\n{seq[:400]}\n{seq[400:]}\n")
    (d / "t.bed").write_text("c1\t100\t400\tt1\t0\t+\t130\t370\t0\t2\t120,100,\t0,200,\nc1\t500\t620\tt2\t0\t-\t520\t610\t0\t1\t120,\t0,\n")
    reads = []
    for i in range(400):
        strand, lo, hi = r.choice([("+", 100, 190), ("+", 300, 370), ("-", 500, 590)])
        reads.append(f"r{i}\t{strand}\tc1\t{r.randrange(lo, hi)}\t{'A' * r.randrange(26, 31)}\tI\t0\t")
    (d / "r.bwt").write_text("\n".join(reads) + "\n")
    (d / "m.bed").write_text("c1\t310\t330\n")
    (d / "g.gff").write_text("c1\ts\tgene\t1\t9\t.\t+\t.\tID=g\nc1\ts\tmRNA\t1\t9\t.\t+\t.\tID=m;Parent=g\nc1\ts\texon\t1\t9\t.\t+\t.\tParent=m\n")
    return d


def table(spark, path):
    return read_table(spark, str(path)).collect()


def test_counts_and_tracks(spark, files, tmp_path):
    f = lambda n: str(files / n)
    P.main(["counts_in_region", str(tmp_path / "c"), f("r.bwt"), f("t.bed"), "--masks", f("m.bed"), "--offset", "12"])
    c = {r["region_name"]: r for r in table(spark, tmp_path / "c")}
    assert c["t1"]["length"] == 200 and c["t2"]["counts"] > 50  # masks without strand take either
    P.get_count_vectors(spark, str(tmp_path / "v"), f("r.bwt"), f("t.bed"), offset="12")
    v = spark.read.text(str(tmp_path / "v"))
    assert v.filter("ID = 't2'").count() == 120
    P.make_wiggle(spark, str(tmp_path / "w"), f("r.bwt"), output_format="variable_step")
    assert spark.read.text(str(tmp_path / "w" / "fw")).filter("value like 'variableStep%'").count() == 1


def test_models_and_profiles(spark, files, tmp_path):
    f = lambda n: str(files / n)
    cs, mg = str(tmp_path / "cs"), str(tmp_path / "mg")
    P.cs_generate(spark, cs, f("t.bed"))
    P.cs_count(spark, str(tmp_path / "k1"), cs, f("r.bwt"))
    k = {r["region"]: r for r in table(spark, tmp_path / "k1")}
    assert (k["gene_t1"]["cds_length"], k["gene_t1"]["utr5_length"], k["gene_t2"]["utr5_length"]) == (160, 30, 10)
    P.cs_chart(spark, str(tmp_path / "chart"), str(tmp_path / "k1"), str(tmp_path / "k1"))
    assert table(spark, tmp_path / "chart" / "bigtable")
    P.metagene_generate(spark, mg, f("t.bed"))
    assert {r["region_id"] for r in table(spark, tmp_path / "mg" / "rois")} == {"gene_t1", "gene_t2"}
    P.metagene_count(spark, str(tmp_path / "mc"), mg, f("r.bwt"), min_counts="1")
    assert {r["x"] for r in table(spark, tmp_path / "mc")} >= set(range(-10, 50))
    P.psite(spark, str(tmp_path / "ps"), mg, f("r.bwt"), min_counts="1", max_length="32")
    assert len(table(spark, tmp_path / "ps")) == 9
    P.phase_by_size(spark, str(tmp_path / "ph"), f("t.bed"), f("r.bwt"))
    for r in table(spark, tmp_path / "ph"):
        assert abs(r["phase0"] + r["phase1"] + r["phase2"] - 1) < 1e-9


def test_junctions_and_formats(spark, files, tmp_path):
    f = lambda n: str(files / n)
    P.findjuncs(spark, str(tmp_path / "j"), f("t.bed"))
    j = spark.read.parquet(str(tmp_path / "j" / "juncs")).collect()
    assert [(r["left"], r["right"]) for r in j] == [(220, 300)]
    P.slidejuncs(spark, str(tmp_path / "s"), str(tmp_path / "j" / "bed"), f("g.fa"))
    assert [(r["left"], r["right"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [(220, 300, "canonical")]
    P.crossmap(spark, str(tmp_path / "x"), f("g.fa"), "29", "14")
    spans = {tuple(r["value"].split("\t")[i] for i in (1, 2, 5)) for r in spark.read.text(str(tmp_path / "x")).collect()}
    assert any(s == "+" and int(a) <= 114 and int(b) >= 146 for a, b, s in spans) and len({s for *_, s in spans}) == 2
    P.gff_parent_types(spark, str(tmp_path / "p"), f("g.gff"))
    assert {r["feature_type"] for r in table(spark, tmp_path / "p")} == {"gene", "mRNA", "exon"}
    P.reformat_transcripts(spark, str(tmp_path / "o.gtf"), f("t.bed"), "gtf")
    P.reformat_transcripts(spark, str(tmp_path / "o.bed"), str(tmp_path / "o.gtf"))
    back = sorted(r["value"] for r in spark.read.text(str(tmp_path / "o.bed")).collect())
    assert [x.split("\t")[1:3] + x.split("\t")[6:8] for x in back] == [["100", "400", "130", "370"], ["500", "620", "520", "610"]]
    P.test_table_equality(spark, str(tmp_path / "e"), str(tmp_path / "p"), str(tmp_path / "p"), "feature_type")
    assert table(spark, tmp_path / "e") == []


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from strandloom.functions.text import number, parse_list, short_name, unique_names
    from strandloom.operators.genes import merge_sets

    r = spark.range(1).select(number(F.lit(" 5 ")).alias("a"), number(F.lit("nan")).alias("b"), parse_list(F.lit("['x', 3]")).alias("c"), parse_list(F.lit("[]")).alias("d")).collect()[0]
    assert (r["a"]["i"], r["b"]["i"], r["c"], r["d"]) == (5, None, ["x", "3"], [])
    assert unique_names(["a", "b", "a"]) == ["a", "b", "a2"] and short_name("/x/y.py") == "y"
    s = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"])], "k int, v array<string>")
    assert sorted(tuple(x["v"]) for x in merge_sets(s, "k", "v").collect()) == [("a", "b", "c"), ("d",)]
