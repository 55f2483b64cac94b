"""Full hierarchies from parent-child rows: roots, depths, paths, descendants and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import salted_join
from strandloom.session import discard, materialize, materialize_counting
from strandloom.tables import BROADCAST_ROWS

#: One node in so many is a splitter.
SPLITTER_EVERY = 16
#: Edges of a graph that one task searches for cycles; a larger graph is reduced first.
SOLVE_EDGES = 1 << 17
#: Rounds in which leaves and roots are peeled off before a graph is searched or reduced.
PEEL_ROUNDS = 4


def _is_splitter(c: Column | str, every: int, level: int = 0) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(7 + level)), F.lit(every)) == 0


def _walk(steps: DataFrame, with_path: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Walks on until every walk is done, by doubling: (node, stop, dist, top[, path]) and the tables to discard.

    ``steps`` has node, stop, dist, top, done[, path]; a walk that is not done goes on from its stop. Walks open after round r have 2^r
    steps, so equal walks can only meet in one round, and what is done is not looked at again but as a continuation.
    """
    cols = ["node", "stop", "dist", "top", *(["path"] if with_path else [])]
    counted = {"n": F.count(F.lit(1)), "open": F.count(F.when(~F.col("done"), 1))}
    now, seen = materialize_counting(steps, "walk", counted)
    done, used = [now.filter("done")], [now]
    while seen["open"]:
        every = now.filter("not done").withColumn("done", F.lit(False))
        for t in done:
            every = every.unionByName(t)
        ahead = every.select(F.col("node").alias("stop"), F.col("stop").alias("s2"), F.col("dist").alias("d2"), F.col("top").alias("t2"), F.col("done").alias("done2"), *([F.col("path").alias("p2")] if with_path else []))
        moved = salted_join(now.filter("not done"), ahead, "stop", rows=seen["open"])
        moved = moved.select("node", F.col("s2").alias("stop"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("t2").alias("top"), F.col("done2").alias("done"), *([F.concat("p2", "path").alias("path")] if with_path else []))
        now, seen = materialize_counting(moved.distinct(), "walk", counted)
        done.append(now.filter("done"))
        used.append(now)
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.select(*cols), used


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ring) of the nodes on cycles of one graph, ring naming the strongly connected part; linear in its edges."""
    up: dict[str, list[str]] = {}
    for b in batches:
        for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(c, []).append(p)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    found: list[tuple[str, str]] = []
    for start in up:
        if start in order:
            continue
        todo = [(start, iter(up[start]))]
        order[start] = low[start] = len(order)
        held.append(start)
        inside.add(start)
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = len(order)
                    held.append(y)
                    inside.add(y)
                    todo.append((y, iter(up.get(y, ()))))
                    break
                if y in inside:
                    low[x] = min(low[x], order[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == order[x]:
                    part = [held.pop()]
                    while part[-1] != x:
                        part.append(held.pop())
                    inside.difference_update(part)
                    if len(part) > 1:
                        ring = "c" + min(part)
                        found += [(y, ring) for y in part]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=["node", "ring"])


def _peeled(core: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges left after some rounds of taking off leaves and roots, and their number."""
    for _ in range(PEEL_ROUNDS):
        if not n:
            break
        left = salted_join(core, core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi", rows=n)
        left = left.join(core.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")
        nxt, seen = materialize_counting(left, "core", {"n": F.count(F.lit(1))})
        discard(core)
        core, n, before = nxt, seen["n"], n
        if n == before:
            break
    return core, n


def _coloured(core: DataFrame) -> DataFrame:
    """(node, ring) of the nodes on cycles of a graph that reduction does not make smaller: every node takes the least node above it as its colour, a colour's own part is what its node reaches within the colour.

    One pass over the edges a step; steps are as many as the parts are wide.
    """
    out = None
    while not core.isEmpty():
        ends = core.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        colour = materialize(ends.select("node", F.col("node").alias("c")), "colour")
        moving = True
        while moving:
            above = salted_join(core.select("child", F.col("parent").alias("node")), colour, "node").groupBy(F.col("child").alias("node")).agg(F.min("c").alias("a"))
            nxt = colour.join(above, "node", "left").select("node", F.least("c", "a").alias("c"), (F.col("a") < F.col("c")).alias("moved"))
            nxt, seen = materialize_counting(nxt, "colour", {"n": F.count(F.when(F.col("moved"), 1))})
            moving, colour = seen["n"] > 0, nxt.select("node", "c")
        same = core.join(colour.select(F.col("node").alias("child"), "c"), "child")
        same = salted_join(same, colour.select(F.col("node").alias("parent"), F.col("c").alias("pc")), "parent").filter("c = pc")
        same = materialize(same.select("child", "parent", "c"), "core")
        part = materialize(colour.filter("node = c"), "part")
        fresh = part
        while True:
            step = fresh.select(F.col("node").alias("child")).join(same, "child").select(F.col("parent").alias("node"), "c").distinct().join(part.select("node"), "node", "left_anti")
            fresh, seen = materialize_counting(step, "part", {"n": F.count(F.lit(1))})
            if not seen["n"]:
                break
            part = materialize(part.unionByName(fresh), "part")
        rings = part.join(part.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "c").select("node", F.concat(F.lit("c"), "c").alias("ring"))
        out = rings if out is None else out.unionByName(rings)
        gone = part.select("node")
        rest = same.join(gone.withColumnRenamed("node", "child"), "child", "left_anti").join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti")
        core, _ = _peeled(*(lambda t, m: (t, m["n"]))(*materialize_counting(rest.select("child", "parent"), "core", {"n": F.count(F.lit(1))})))
    return out if out is not None else core.select(F.col("child").alias("node"), F.col("parent").alias("ring"))


def _rings(core: DataFrame, n: int, every: int, solve_edges: int, level: int = 0) -> DataFrame:
    """(node, ring) of the nodes on cycles of the n distinct edges ``core`` without loops; nodes of one ring have a strongly connected part in common.

    A graph of more than ``solve_edges`` is reduced: nodes with one parent and one child that are no splitters are passed over, so that what is
    left are splitters and branching nodes, with at most as many edges; every passed stretch keeps its name, and is on a cycle if its ends
    are on the same. A stretch that never comes to an end is a ring without splitter, on which all nodes are.
    """
    core, n = _peeled(core, n)
    if n <= solve_edges:
        return core.select("child", "parent").coalesce(1).mapInArrow(_strong, "node string, ring string")
    ends = core.select(F.explode(F.array(F.struct(F.col("child").alias("node"), F.lit(1).alias("u"), F.lit(0).alias("d")), F.struct(F.col("parent").alias("node"), F.lit(0).alias("u"), F.lit(1).alias("d")))).alias("x"))
    stops = ends.groupBy("x.node").agg(F.sum("x.u").alias("u"), F.sum("x.d").alias("d"))
    stops = materialize(stops.select("node", ((F.col("u") != 1) | (F.col("d") != 1) | _is_splitter("node", every, level)).alias("halt")), "stops")
    e = core.join(stops.select(F.col("node").alias("child"), F.col("halt").alias("from_stop")), "child")
    e = materialize(salted_join(e, stops.select(F.col("node").alias("parent"), F.col("halt").alias("to_stop")), "parent", rows=n), "core")
    # Passed-over nodes have one parent and one child each, so no key of these joins is frequent.
    now, seen = materialize_counting(e.filter("not from_stop").select(F.col("child").alias("node"), F.col("parent").alias("stop"), F.when(F.col("to_stop"), F.col("child")).alias("last"), F.col("to_stop").alias("done")), "walk", {"open": F.count(F.when(~F.col("done"), 1))})
    open_ = None
    while seen["open"] and seen["open"] != open_:
        open_ = seen["open"]
        ahead = now.select(F.col("node").alias("stop"), F.col("stop").alias("s2"), F.col("last").alias("l2"), F.col("done").alias("done2"))
        moved = now.filter("not done").join(ahead, "stop").select("node", F.col("s2").alias("stop"), F.col("l2").alias("last"), F.col("done2").alias("done"))
        nxt, seen = materialize_counting(now.filter("done").unionByName(moved), "walk", {"open": F.count(F.when(~F.col("done"), 1))})
        discard(now)
        now = nxt
    # Lengths of stretches are without gaps, so where a round ends none, the open ones never end.
    endless = now.filter("not done").select("node", F.lit("r").alias("ring"))
    onward = now.filter("done").select(F.col("node").alias("parent"), F.col("stop").alias("s2"), "last")
    hops = e.filter("from_stop").join(onward, "parent", "left").filter("to_stop or s2 is not null").select("child", F.coalesce("s2", "parent").alias("parent"), F.col("last").alias("stretch"))
    hops = materialize(hops, "hops")
    reduced, seen = materialize_counting(hops.filter("child <> parent").select("child", "parent").distinct(), "core", {"n": F.count(F.lit(1))})
    upper = _coloured(reduced) if seen["n"] > 0.9 * n else _rings(reduced, seen["n"], every, solve_edges, level + 1)
    upper = materialize(upper.unionByName(hops.filter("child = parent").select(F.col("child").alias("node"), F.concat(F.lit("c"), "child").alias("ring")).distinct()).groupBy("node").agg(F.min("ring").alias("ring")), "rings")
    ring = lambda c: upper.select(F.col("node").alias(c), F.col("ring").alias(f"ring_{c}"))
    held = hops.filter("stretch is not null").join(ring("child"), "child")
    held = salted_join(held, ring("parent"), "parent").filter("ring_child = ring_parent").select(F.col("stretch").alias("last"), F.col("ring_child").alias("ring"))
    passed = now.filter("done").join(held, "last").select("node", "ring")
    return upper.unionByName(passed).unionByName(endless)


def cycle_nodes(edges: DataFrame, every: int = SPLITTER_EVERY, solve_edges: int = SOLVE_EDGES) -> DataFrame:
    """The nodes (column ``node``) on a cycle of ``edges`` (child, parent), self-loops included.

    Leaves and roots are peeled off first, so that shallow forests leave little; what remains is reduced to its splitters and
    branching nodes until one task can hold it (:func:`_rings`). Every step is linear in the edges.
    """
    loops = edges.filter("child = parent").select(F.col("child").alias("node"))
    core, seen = materialize_counting(edges.filter("child <> parent").select("child", "parent").distinct(), "core", {"n": F.count(F.lit(1))})
    return loops.unionByName(_rings(core, seen["n"], every, solve_edges).select("node")).distinct()


def hierarchy(nodes: DataFrame, edges: DataFrame, with_path: bool = False, every: int = SPLITTER_EVERY, solve_edges: int = SOLVE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(one row per node, root and path length; nodes on cycles).

    ``nodes`` has the column ``node``, ``edges`` the columns ``child``, ``parent``; edges with an end that is
    no node, and null ends, are ignored, repeated edges count once. A root has no parent among the
    nodes. The first result has ``node``, ``root``, ``depth`` and, ``with_path``, ``path`` (from the
    root down to the node; then one row per path). Paths touch no node on a cycle; a node all of whose
    paths do does not appear. The second has ``node``. Empty input gives empty results.

    Deterministic hash splitters cut the paths; every node is walked to its next splitter or root,
    the reduced graph of splitters is solved by doubling, and the pieces are joined to exact paths.
    """
    count = {"n": F.count(F.lit(1))}
    nodes = materialize(nodes.filter("node is not null").select(F.col("node").cast("string")).distinct(), "nodes")
    given, seen = materialize_counting(edges.filter("child is not null and parent is not null").select("child", "parent").distinct(), "given", count)
    e = salted_join(given, nodes.withColumnRenamed("node", "parent"), "parent", "left_semi", rows=seen["n"])
    e, seen = materialize_counting(e.join(nodes.withColumnRenamed("node", "child"), "child", "left_semi").select("child", "parent"), "edges", count)
    n = seen["n"]
    loops = e.filter("child = parent").select(F.col("child").alias("node"))
    core = e.filter("child <> parent")
    cyc, seen = materialize_counting(loops.unionByName(_rings(core, n, every, solve_edges).select("node")).distinct(), "cycles", count)
    clean = e.withColumn("clean", F.lit(True))
    if seen["n"]:
        few = F.broadcast(cyc) if seen["n"] <= BROADCAST_ROWS else cyc
        on = lambda c, t: few.select(F.col("node").alias(c), F.lit(True).alias(t))
        clean = (e.join(on("parent", "__p"), "parent", "left") if few is not cyc else salted_join(e, on("parent", "__p"), "parent", "left", rows=n)).join(on("child", "__c"), "child", "left")
        clean = materialize(clean.select("child", "parent", (F.col("__p").isNull() & F.col("__c").isNull()).alias("clean")), "edges")
    # A root has no parent; a node that lost all its parents to cycles ends walks as a root does, but is none.
    kids = clean.groupBy(F.col("child").alias("node")).agg(F.max("clean").alias("clean"))
    state = materialize(nodes.join(kids, "node", "left").select("node", F.col("clean").isNull().alias("root"), (~F.coalesce("clean", F.lit(True))).alias("lost")), "state")
    marked = salted_join(clean.filter("clean").select("child", "parent"), state.select(F.col("node").alias("parent"), "root", "lost"), "parent", rows=n).filter("not lost")
    path = ["path"] if with_path else []
    first = marked.select(F.col("child").alias("node"), F.col("parent").alias("stop"), F.lit(1).cast("int").alias("dist"), F.col("root").alias("top"), (F.col("root") | _is_splitter("parent", every)).alias("done"), *([F.array("parent").alias("path")] if with_path else []))
    walks, _ = _walk(first, with_path)
    # Splitters alone, doubled to their roots.
    solved, _ = _walk(walks.filter(_is_splitter("node", every)).withColumn("done", F.col("top")), with_path)
    direct = walks.filter("top").select("node", F.col("stop").alias("root"), F.col("dist").alias("depth"), *path)
    onward = solved.select(F.col("node").alias("stop"), F.col("stop").alias("root"), F.col("dist").alias("d2"), *([F.col("path").alias("p2")] if with_path else []))
    via = salted_join(walks.filter("not top").drop("top"), onward, "stop").select("node", "root", (F.col("dist") + F.col("d2")).alias("depth"), *([F.concat("p2", "path").alias("path")] if with_path else []))
    selves = state.filter("root").select("node", F.col("node").alias("root"), F.lit(0).cast("int").alias("depth"), *([F.expr("cast(array() as array<string>)").alias("path")] if with_path else []))
    out = direct.unionByName(via).distinct().unionByName(selves)
    if with_path:
        out = out.withColumn("path", F.concat("path", F.array("node")))
    return out, cyc


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance), each once, from the paths of :func:`hierarchy`; a node is not its own descendant."""
    steps = paths.select("path", F.posexplode("path").alias("i", "node"))
    rest = steps.select("node", F.posexplode(F.expr("slice(path, i + 2, size(path))")).alias("j", "descendant"))
    return rest.select("node", "descendant", (F.col("j") + 1).cast("int").alias("distance")).distinct()
