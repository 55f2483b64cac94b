import random

from strandloom.operators.periods import periods_and_gaps

SCHEMA = "chain bigint, strand string, lo bigint, hi bigint, s string, found_kind string"


def brute(rows):
    groups = {}
    for c, st, lo, hi, *_ in rows:
        if lo is not None and hi is not None and hi > lo:
            groups.setdefault((c, st), set()).add((lo, hi))
    out = set()
    for k, v in groups.items():
        cur, n, prev = None, 0, None
        for lo, hi in sorted(v) + [(None, None)]:
            if cur and lo is not None and lo <= cur[1]:
                cur, n = (cur[0], max(cur[1], hi)), n + 1
                continue
            if cur:
                out.add((*k, "period", *cur, n > 1))
                if prev is not None:
                    out.add((*k, "gap", prev, cur[0], None))
                prev = cur[1]
            cur, n = (lo, hi), 1
    return out


def found(spark, rows, width):
    r = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["chain", "strand"], "lo", "hi", width).collect()
    got = {(x["chain"], x["strand"], x["found_kind"], x["seg_start"], x["seg_end"], x["differing"]) for x in r}
    assert len(got) == len(r)
    return got


def test_random_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        lo = r.randrange(-50, 600)
        # a third of all rows in one chain; repeats, nulls, empty and reversed bounds
        rows.append((1 if r.random() < 0.35 else r.randrange(8), r.choice(["+", "-", None]), r.choice([lo, lo, lo, lo, None]), lo + r.choice([-2, 0, 1, 5, 9, 120]), "x", "y"))
    rows += rows[:60]
    for width in (16, 1 << 20):
        assert found(spark, rows, width) == brute(rows)


def test_touching_and_empty(spark):
    rows = [(1, "+", 0, 10, "", ""), (1, "+", 10, 20, "", ""), (1, "+", 25, 30, "", ""), (1, "+", 25, 30, "", "")]
    assert found(spark, rows, 8) == {(1, "+", "period", 0, 20, True), (1, "+", "period", 25, 30, False), (1, "+", "gap", 20, 25, None)}
    assert found(spark, [], 8) == set()
