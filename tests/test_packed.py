import pytest

from strandloom.operators.packed import split_packed

IDS = [
    ("a,b", ["a", "b"]),
    ("a; b ;c;", ["a", "b", "c"]),
    ("a|b", ["a", "b"]),
    ("a\tb\tc", ["a", "b", "c"]),
    ("a  b", ["a", "b"]),
    (";a,b", [None, "a", "b"]),
    ("a;;b", ["a", None, "b"]),
    ('["x,1", "y 2"]', ["x,1", "y 2"]),
    ('"a ""q"" b";c', ['a "q" b', "c"]),
    ("g:1%2C2,%41", ["g:1,2", "A"]),
    ('"gene:5%s"', ["gene:5%s"]),
    ("a=b,c", ["a", "b", "c"]),
    ("", []),
    ("  ", []),
    (".", []),
    (None, []),
    (",", []),
    (",".join(f"id{i}" for i in range(5000)), [f"id{i}" for i in range(5000)]),
]
NUMBERS = [
    ("1,2,3", 3, ["1", "2", "3"]),
    ("1,2;3,4", 2, ["1,2", "3,4"]),
    ("1,2;3,4", 4, ["1", "2", "3", "4"]),
    ("1,234,567; 8,901,234.5", 2, ["1,234,567", "8,901,234.5"]),
    ('"1,234", "5,678"', 2, ["1,234", "5,678"]),
    ("1.5, 2|3;4", 4, ["1.5", "2", "3", "4"]),
    ("1.5||nan,", None, ["1.5", None, "nan"]),
    ("{1; -2e-5}", 2, ["1", "-2e-5"]),
    ("1,5", 1, ["1,5"]),
    ("1,234,567, 2,345,678", 2, ["1,234,567", "2,345,678"]),
    ("77,5 8,25", 2, ["77,5", "8,25"]),
    ("a,b", 2, ["a", "b"]),
]


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["i"], []).append((r["item_pos"], r["item_text"]))
    return {i: sorted(v) for i, v in out.items()}


def places(values):
    return [(i, v) for i, v in enumerate(values, 1) if v is not None]


def test_ids(spark):
    df = spark.createDataFrame([(i, f, "old") for i, (f, _) in enumerate(IDS)], "i int, f string, item_text string")
    got = collect(split_packed(df, "f", "id"))
    for i, (f, v) in enumerate(IDS):
        assert got.get(i, []) == places(v), f


def test_numbers(spark):
    df = spark.createDataFrame([(i, f, n) for i, (f, n, _) in enumerate(NUMBERS)], "i int, f string, n int")
    got = collect(split_packed(df, "f", "number", "n"))
    for i, (f, n, v) in enumerate(NUMBERS):
        assert got.get(i, []) == places(v), (f, n)


@pytest.mark.parametrize("kind", ["id", "number"])
def test_empty(spark, kind):
    assert split_packed(spark.createDataFrame([], "i int, f string"), "f", kind).count() == 0


def test_scores(spark):
    """Every differing parse is scored, and the winner leads by bits; a parse that breaks the stated size pays for it."""
    df = spark.createDataFrame([(1, "1,5;2,5", 2), (2, "1,5;2,5", 4), (3, "7", 1)], "i int, f string, n int")
    got = {r["i"]: (r["dialect"], r["n_parses"], r["lead_bits"]) for r in split_packed(df, "f", "number", "n", scores=True).collect()}
    assert got[1][:2] == ("semicolon", 4) and got[2][:2] == ("any_mark", 4) and got[3] == ("single", 1, None)
    assert got[1][2] > 0 and got[2][2] > 0
