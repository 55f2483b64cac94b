import random

from pyspark.sql import functions as F

from strandloom.llm.components import connected_components, group_by_match, spanning_forest


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {(x, min(g)) for g in groups.values() for x in g}


def test_levels_against_brute_force(spark):
    r = random.Random(5)
    pairs = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(180)]
    pairs += [("hub", f"h{i}") for i in range(150)]  # a third of all pairs in one star
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(120)]  # a long chain
    pairs += [(b, a) for a, b in pairs[:40]] + pairs[:40] + [(None, "x"), ("y", None), ("z", "z"), ("é", "e")]
    df = spark.createDataFrame([(*p, "c") for p in pairs], "a string, b string, root string")
    for limit in (1_000_000, 25):
        got = group_by_match(df, "a", "b") if limit > 100 else None
        rows = {(x["node"], x["group_id"]) for x in got.collect()} if got is not None else None
        if rows is None:
            rooted = connected_components(df, "a", "b", limit).collect()
            rows = {(x["node"], x["root"]) for x in rooted}
            assert len(rows) == len(rooted)
            rows |= {(x, x) for _, x in rows}
        assert rows == brute(pairs)


def test_forest_and_empty(spark):
    f = spanning_forest(iter([("b", "a"), ("c", "b"), ("c", "c")]))
    assert len(f) == 2 and len({(r, k) for _, r, k in f}) == 1 and {x for x, _, _ in f} | {f[0][1]} == {"a", "b", "c"}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_long_chain_in_few_levels(spark):
    """A chain in the order of its ids over more than a hundred partitions: levels are logarithmic, not linear."""
    n, sizes = 100_000, []
    chain = spark.range(n).select(F.format_string("c%07d", "id").alias("a"), F.format_string("c%07d", F.col("id") + 1).alias("b")).repartition(120, "a")
    got = connected_components(chain, "a", "b", 800, sizes)
    assert got.groupBy("root").count().collect() == [("c0000000", n)]
    assert len(sizes) <= 12 and all(y < 0.7 * x for x, y in zip(sizes, sizes[1:]))
