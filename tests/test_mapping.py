import pytest
from pyspark.sql import functions as F

from strandloom.operators import arrays as A
from strandloom.operators import mapping as M

#: One read per length and strand, unspliced and spliced after 11.
READS = [("c", st, 100, n, k, 50 if k else 0) for st in "+-" for n in range(25, 36) for k in (0, 11)]


def aligned(r):
    _, _, start, n, k, gap = r
    return [start + q + (gap if k and q >= k else 0) for q in range(n)]


def five(r):
    p = aligned(r)
    return p if r[1] == "+" else p[::-1]


@pytest.fixture(scope="module", params=["compact", "blocks"])
def reads(spark, request):
    df = spark.createDataFrame(READS, "chrom string, strand string, start bigint, rlen int, k int, gap int")
    if request.param == "blocks":
        one = F.array(F.struct("start", (F.col("start") + F.col("rlen")).alias("end")))
        two = F.array(F.struct("start", (F.col("start") + F.col("k")).alias("end")), F.struct((F.col("start") + F.col("k") + F.col("gap")).alias("start"), (F.col("start") + F.col("rlen") + F.col("gap")).alias("end")))
        df = df.withColumn("blocks", F.when(F.col("k") > 0, two).otherwise(one)).drop("start", "k", "gap")
    return df


def got(df):
    return sorted((r["strand"], r["rlen"], r["pos"]) for r in df.collect())


@pytest.mark.parametrize("offset", [0, 10, 13, 30, 40])
def test_ends(reads, offset):
    assert got(M.five_prime(offset)(reads)) == sorted((r[1], r[3], five(r)[offset]) for r in READS if offset < r[3])
    assert got(M.three_prime(offset)(reads)) == sorted((r[1], r[3], five(r)[::-1][offset]) for r in READS if offset < r[3])


def test_center(reads):
    rows = M.center(13)(reads).collect()
    assert sorted((r["strand"], r["rlen"], r["pos"]) for r in rows) == sorted((r[1], r[3], p) for r in READS for p in aligned(r)[13:-13])
    assert abs(sum(r["weight"] for r in rows) - sum(1 for r in READS if r[3] > 26)) < 1e-9
    assert M.center(20)(reads).count() == 0


def test_variable(reads):
    table = {25: 3, 26: 30}
    want = sorted((r[1], r[3], five(r)[table.get(r[3], 12)]) for r in READS if table.get(r[3], 12) < r[3])
    assert got(M.variable_five_prime(table, 12)(reads)) == want
    assert {r["rlen"] for r in M.variable_five_prime(table)(reads).collect()} == {25}
    assert {r["rlen"] for r in M.stratified_variable_five_prime({}, 12, 28, 30)(reads).collect()} == {28, 29, 30}


def test_span_rules(spark):
    df = spark.createDataFrame([("c", "+", 10, 5), ("c", "-", 10, 5)], "chrom string, strand string, start bigint, rlen int")
    at = lambda rule: [r["pos"] for r in rule(df).orderBy("strand").collect()]
    assert at(M.span_five_prime(5)) == [15, 9] and at(M.span_three_prime(0)) == [14, 10] and at(M.span_variable_five_prime({5: 7}, 0)) == [17, 7]
    assert M.span_center(1)(df).count() == 6 and M.span_five_prime(6)(df).count() == 0


def test_filters_and_registry(reads):
    with pytest.raises(ValueError):
        M.size_filter(5, 3)
    M.register_rule("first", lambda: M.five_prime(0))
    assert M.RULES["first"]()(reads.filter(M.size_filter(30, 30)).filter(M.strand_filter("-"))).count() == 2


def test_arrays(spark):
    schema = "chrom string, strand string, pos bigint, value double"
    a = spark.createDataFrame([("c", "+", 1, 2.0), ("c", "+", 2, 2.0), ("c", "+", 5, 1.0)], schema)
    b = spark.createDataFrame([("c", "+", 2, 3.0), ("c", "+", 3, 4.0)], schema)
    vals = lambda d: {r["pos"]: r["value"] for r in d.collect()}
    assert vals(A.add(a, b)) == {1: 2, 2: 5, 3: 4, 5: 1}
    assert vals(A.subtract(a, b)) == {1: 2, 2: -1, 3: -4, 5: 1}
    assert vals(A.multiply(a, b)) == {2: 6}
    assert vals(A.add(a, b, "same")) == {2: 5} and vals(A.add(a, b, "truncate")) == {1: 2, 2: 5, 3: 4}
    assert vals(A.scale(a, 2)) == {1: 4, 2: 4, 5: 2}
    dense = A.shift(a, spark.createDataFrame([("c", 6)], "chrom string, length bigint"), 1.0)
    assert vals(dense) == {0: 1, 1: 3, 2: 3, 3: 1, 4: 1, 5: 2}
    assert vals(A.assign(a, b, b)) == {1: 2, 2: 3, 3: 4, 5: 1}
    assert A.arrays_equal(a, a).collect()[0]["equal"] and not A.arrays_equal(a, b).collect()[0]["equal"]
    runs = {(r["start"], r["end"], r["value"]) for r in A.runs(a, tile=2).collect()}
    assert runs == {(1, 3, 2.0), (5, 6, 1.0)}
    assert {(r["start"], r["end"]) for r in A.runs(a, window=2).collect()} == {(1, 2), (2, 3), (5, 6)}
    zeros = {(r["start"], r["end"], r["value"]) for r in A.bedgraph_with_zeros(a).collect()}
    assert zeros == {(0, 1, 0.0), (1, 3, 2.0), (3, 5, 0.0), (5, 6, 1.0)}
    assert vals(A.from_runs(A.runs(a))) == vals(a)
    assert vals(A.normalize(a, 5))[5] == 200_000
