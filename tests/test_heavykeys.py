from strandloom.operators.heavykeys import key_profile

ROWS = "read_id bigint, chrom string, region string, seg_start bigint, seg_end bigint, rows string"
NAMES = "chrom_alias string, chrom string"


def test_profile(spark):
    rows = [(i, "1" if i % 2 else "chr1", None if i % 5 == 0 else "r", i, i + 10, "x") for i in range(90)]
    rows += rows[:10]  # delivered twice
    rows += [(200, "solo", "s", None, 7, "x"), (201, None, "s", 5, 3, "x")]
    got = {(r["key_field"], r["key_name"]): r for r in key_profile(spark.createDataFrame(rows, ROWS), spark.createDataFrame([("1", "chr1"), ("chr1", "chr1"), (None, "z")], NAMES)).collect()}
    assert set(got) == {("chrom", "chr1"), ("chrom", "solo"), ("region", "r"), ("region", "s")}
    one = got["chrom", "chr1"]
    assert (one["n_rows"], one["n_reads"], one["mean_length"], one["span_start"], one["span_end"], one["heavy"]) == (100, 90, 10.0, 0, 99, True)
    assert got["region", "s"]["n_reads"] == 2 and got["region", "s"]["mean_length"] is None and not got["region", "s"]["heavy"]


def test_share_is_exact(spark):
    rows = [(i, "a" if i < 5 else f"c{i}", "r", 0, 1, "") for i in range(100)]
    got = {r["key_name"]: r["heavy"] for r in key_profile(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], NAMES), record=None).collect()}
    assert got["a"] and not got["c50"]


def test_empty(spark):
    assert key_profile(spark.createDataFrame([], ROWS), spark.createDataFrame([], NAMES)).count() == 0


def test_null_records_are_records_of_their_own(spark):
    rows = [(None, "a", "r", 0, 10, ""), (None, "a", "s", 20, 50, ""), (None, "b", "s", 5, 6, ""), (1, "a", "r", 0, 10, ""), (1, "a", "r", 0, 10, "")]
    got = {r["key_name"]: (r["n_rows"], r["n_reads"], r["span_start"], r["span_end"]) for r in key_profile(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], NAMES)).collect()}
    assert got == {"a": (4, 3, 0, 50), "b": (1, 1, 5, 6), "r": (3, 2, 0, 10), "s": (2, 2, 5, 50)}
