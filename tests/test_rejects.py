from strandloom.operators.rejects import parse_axt_lines, split_rejects

GOOD = ["0", "chrA", "1", "4", "q1", "11", "13", "+", "-5", "4", "ACGT", "A-gt"]


def line(**change):
    f = dict(zip("aln t ts te q qs qe st sc n a b".split(), GOOD)) | change
    return "\t".join(f.values())


CASES = [
    (line(), None),
    (line(sc=""), None),
    (line(q='"q ""x""\t1"') + "\r", None),
    (line(q='5"x'), None),
    (line(aln="١"), "value"),
    (line(ts="0"), "value"),
    (line(ts="5"), "value"),
    (line(q="  "), "value"),
    (line(q=""), "value"),
    (line(st="++"), "value"),
    (line(n="5"), "value"),
    (line(n="0", a="", b=""), "value"),
    (line(a="ACXT"), "value"),
    (line(qe="14"), "value"),
    (line(sc="1.5"), "value"),
    (line() + "\tx", "columns"),
    ("a\tb", "columns"),
    ("\t" + line(), "columns"),
    (line(q='"open'), "quoting"),
    (line(q='"x"y'), "quoting"),
    (line(ts="9" * 60), "value"),
    ('"' + '""' * 50_000 + '"', "columns"),
    ("x" * 300_000, "columns"),
]


def test_cases(spark):
    rows = [(i, t, "r", "clash") for i, (t, _) in enumerate(CASES)] + [(900, None, "r", "c"), (901, "", "r", "c"), (902, "  \t ", "r", "c"), (903, "# note", "r", "c"), (904, "\r", "r", "c")]
    df = spark.createDataFrame(rows, "raw_id int, raw_line string, fail_reason string, qName string")
    parsed = parse_axt_lines(df)
    got = {r["raw_id"]: r["fail_reason"] for r in parsed.select("raw_id", "fail_reason").collect()}
    assert got == {i: why for i, (_, why) in enumerate(CASES)}
    ok, bad = split_rejects(parsed)
    assert ok.count() + bad.count() == len(CASES)
    names = {r["raw_id"]: r["qName"] for r in ok.collect()}
    assert names[2] == 'q "x"\t1' and names[3] == '5"x'
    assert dict(ok.dtypes)["tStart"] == "bigint"


def test_wide_numbers(spark):
    """A valid number above bigint is kept as text beside the typed columns, not lost."""
    df = spark.createDataFrame([(1, line(aln="9" * 20)), (2, line(aln="7", sc="-" + "8" * 25)), (3, line(aln="7"))], "raw_id int, raw_line string")
    got = {r["raw_id"]: (r["aln_no"], r["wide"]) for r in split_rejects(parse_axt_lines(df))[0].collect()}
    assert got == {1: (None, "aln_no=" + "9" * 20), 2: (7, "score=-" + "8" * 25), 3: (7, None)}


def test_empty(spark):
    assert parse_axt_lines(spark.createDataFrame([], "raw_id int, raw_line string")).count() == 0
