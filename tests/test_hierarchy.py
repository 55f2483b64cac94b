import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators.hierarchy import cycle_nodes, descendants, hierarchy
from strandloom.operators.skew import salted_join


def brute(nodes, edges):
    edges = {(c, p) for c, p in edges if c in nodes and p in nodes}
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def reach(n):
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        return seen

    cyc = {n for n in nodes if n in reach(n)}
    memo = {}

    def walk(n):
        if n not in memo:
            memo[n] = {(n, 0, (n,))} if n not in up else {(r, d + 1, (*path, n)) for p in up[n] if p not in cyc for r, d, path in walk(p)}
        return memo[n]

    out = {(n, r, d) for n in nodes - cyc for r, d, _ in walk(n)}
    return out, cyc, {(n, path) for n in nodes - cyc for _, _, path in walk(n)}


def run(spark, nodes, edges, every=3, **kw):
    n = spark.createDataFrame([(x, "k") for x in nodes], "node string, parent string")
    e = spark.createDataFrame([(*x, "k") for x in edges], "child string, parent string, node string")
    return hierarchy(n, e, every=every, **kw)


def test_random_graphs(spark):
    for seed in (1, 4):
        r = random.Random(seed)
        nodes = {f"n{i}" for i in range(40)}
        edges = [(f"n{a}", f"n{b}") for a in range(40) for b in [r.randrange(max(1, a)) if r.random() < 0.9 else r.randrange(40)] if r.random() < 0.9]
        edges += [(f"n{r.randrange(20, 40)}", f"n{r.randrange(20)}") for _ in range(8)] + [("n3", "n3"), ("n9", "gone"), (None, "n1"), ("n1", None)] + edges[:5]
        nodes_in = [*nodes, None, "n1"]
        tree, cyc = run(spark, nodes_in, edges, with_path=True)
        want, ring, paths = brute(nodes, edges)
        rows = tree.collect()
        assert {(x["node"], x["root"], x["depth"]) for x in rows} == want
        assert {(x["node"], tuple(x["path"])) for x in rows} == paths
        assert {x["node"] for x in cyc.collect()} == ring


def test_deep_chain_and_rings(spark):
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 150)]
    ring = [(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)] + [("below", "r3"), ("r5", "above")]
    nodes = {x for e in chain + ring for x in e}
    tree, cyc = run(spark, nodes, chain + ring, every=8)
    want, on, _ = brute(nodes, chain + ring)
    assert {(x["node"], x["root"], x["depth"]) for x in tree.collect()} == want
    assert {x["node"] for x in cyc.collect()} == on


@pytest.mark.parametrize("solve_edges", [2, 1000])
def test_rings_without_splitters(spark, solve_edges):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("x", "y"), ("y", "x"), ("x", "r0")] + [(f"s{i}", f"s{(i + 1) % 7}") for i in range(7)]
    got = cycle_nodes(spark.createDataFrame(ring, "child string, parent string"), every=1 << 30, solve_edges=solve_edges)
    assert {r["node"] for r in got.collect()} == {x for e in ring for x in e}


def test_reduction_against_brute_force(spark):
    """Graphs far above the edges that one task solves: reduced by splitters, or coloured where that makes them no smaller."""
    r = random.Random(8)
    for dense in (False, True):
        edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(150 if dense else 66)]
        edges += [] if dense else [(f"q{i}", f"q{i + 1}") for i in range(30)] + [("q30", "q4"), ("n1", "q0")]
        _, ring, _ = brute({x for e in edges for x in e}, edges)
        got = cycle_nodes(spark.createDataFrame(sorted(set(edges)), "child string, parent string"), every=4, solve_edges=5)
        assert {x["node"] for x in got.collect()} == ring


def test_one_large_ring(spark):
    """Ten thousand nodes in one ring, of which a task holds a hundred: each reduction leaves fewer, nothing grows."""
    n = 10_000
    ring = spark.range(n).select(F.format_string("k%05d", "id").alias("child"), F.format_string("k%05d", (F.col("id") + 1) % n).alias("parent"))
    assert cycle_nodes(ring, solve_edges=100).count() == n


def test_hub_and_descendants(spark):
    edges = [(f"k{i}", "hub") for i in range(60)] + [("hub", "top")]
    nodes = {x for e in edges for x in e}
    tree, _ = run(spark, nodes, edges, with_path=True)
    d = {(r["node"], r["descendant"], r["distance"]) for r in descendants(tree).collect()}
    assert len(d) == 121 and ("top", "k7", 2) in d and ("hub", "k7", 1) in d


def test_empty(spark):
    tree, cyc = run(spark, set(), [])
    assert tree.count() == 0 and cyc.count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(i, f"w{i}") for i in range(0, 300, 2)] + [(0, "again")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(left, right, "k", how, task_rows=30)
        b = left.join(right, "k", how)
        assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=str)
