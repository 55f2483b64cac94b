"""Groups from pairwise matches: union-find in bounded partitions, forests merged hierarchically."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import salted_join
from strandloom.session import discard, materialize

#: Edges one union-find holds at a time; bounds a task's memory.
PARTITION_EDGES = 1 << 16
_FOREST = "node string, root string, rank long"


def spanning_forest(pairs: Iterator[tuple[str, str]], seed: int = 0) -> list[tuple[str, str, int]]:
    """(node, root, rank of the root) of every node that is not a root; the root is the node of least rank of its tree, ranks being hashes."""
    parent: dict[str, str] = {}
    ranks: dict[str, int] = {}

    def find(x: str) -> str:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def rank(x: str) -> int:
        if x not in ranks:
            ranks[x] = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) >> 1
        return ranks[x]

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            if (rank(b), b) < (rank(a), a):
                a, b = b, a
            parent[b] = a
    return [(x, r, rank(r)) for x in list(parent) for r in [find(x)]]


def _forests(batches: Iterator[pa.RecordBatch], limit: int, seed: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str]] = []

    def out():
        f = spanning_forest(iter(held), seed)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.string()), pa.array([x[1] for x in f], pa.string()), pa.array([x[2] for x in f], pa.int64())], names=["node", "root", "rank"])

    for b in batches:
        held.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if len(held) >= limit:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(pairs: DataFrame, a: str, b: str, partition_edges: int = PARTITION_EDGES, sizes: list[int] | None = None) -> DataFrame:
    """(node, root) for every node linked to another one, directly or not; root is the smallest node of the group, by bytes.

    Roots themselves have no row, nor have nodes linked only to themselves; pairs with a null side link
    nothing; repeated pairs and both directions are harmless; an empty table gives an empty result.

    Every partition of edges is reduced to a spanning forest by union-find, ``partition_edges`` at a time, and forests merge level by
    level: every node is contracted into the root of least rank that any partition gives it, the edges between contracted nodes go on
    to the next level, in partitions of bounded size, until one partition holds the rest. Ranks are hashes with a new
    seed each level, so that whatever the order of ids, a level keeps on average about half of the nodes of a chain and fewer of anything denser: the number of levels is logarithmic
    (``sizes``, if given, collects the forest edges of each). Contractions are then followed from the last level back to the first.
    Frequent roots are salted where edges are contracted and contractions followed.
    """
    edges = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root"))
    levels: list[DataFrame] = []
    spent: list[DataFrame] = []
    while True:
        seed = len(levels)
        forest = materialize(edges.mapInArrow(lambda it: _forests(it, partition_edges, seed), _FOREST), "forest")
        n = forest.count()
        discard(*spent)
        spent = [forest]
        if sizes is not None:
            sizes.append(n)
        if n <= partition_edges:
            # All that is left fits one union-find, so its components are global.
            levels.append(forest.coalesce(1).mapInArrow(lambda it: _forests(it, partition_edges + 1, seed), _FOREST).select("node", "root"))
            break
        one = lambda c: F.struct(F.col(c).alias("node"), "root", "rank")
        every = forest.select(F.explode(F.array(one("node"), one("root"))).alias("x")).groupBy("x.node").agg(F.min(F.struct("x.rank", "x.root")).alias("m"))
        to = materialize(every.select("node", F.col("m.root").alias("root")), "level")
        levels.append(to)
        lower = forest.select("node", "root").join(to.select("node", F.col("root").alias("u")), "node").select("u", "root")
        both = salted_join(lower, to.select(F.col("node").alias("root"), F.col("root").alias("v")), "root").filter("u <> v")
        edges = both.select(F.least("u", "v").alias("node"), F.greatest("u", "v").alias("root")).repartition(-(-n // partition_edges), "node", "root").distinct()
    out = materialize(levels.pop(), "groups")
    while levels:
        # A contracted node that the level above has not is the last of its group.
        out = materialize(salted_join(levels.pop(), out.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "groups")
    least = out.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least"))
    whole = salted_join(out, least, "root").select("node", F.col("least").alias("root")).unionByName(least.select(F.col("root").alias("node"), F.col("least").alias("root")))
    return whole.filter("node <> root").distinct()


def group_by_match(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id) of every node in a group of at least two; group_id is the smallest node of the group."""
    rooted = connected_components(links, a, b)
    return rooted.select("node", F.col("root").alias("group_id")).unionByName(rooted.select(F.col("root").alias("node"), F.col("root").alias("group_id")).distinct())
