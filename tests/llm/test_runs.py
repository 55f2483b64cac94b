import datetime as dt
import random

import pytest

from strandloom.llm.runs import collapse_runs

SCHEMA = "lane_id string, seq_no bigint, chrom string, strand string, seg_start bigint, seg_end bigint, acquired_at timestamp, n bigint, run string"
T0 = dt.datetime(2022, 1, 1)


def brute(rows, tol):
    out = []
    seen = {}
    for r in rows:
        if None not in (r[1], r[4], r[5]):
            seen[r[0], r[1]] = r
    prev = cur = None
    for r in sorted(seen.values(), key=lambda r: (r[0] or "", r[1])):
        if prev and prev[0] == r[0] and prev[2:4] == r[2:4] and abs(prev[4] - r[4]) <= tol and abs(prev[5] - r[5]) <= tol:
            cur.append(r)
        else:
            cur = [r]
            out.append(cur)
        prev = r
    return {(c[0][0], c[0][1], c[-1][1], len(c), (max(x[6] for x in c) - min(x[6] for x in c)) // dt.timedelta(microseconds=1)) for c in out}


def rows():
    r = random.Random(2)
    out, at = [], 100
    for lane in ("a", "b", None):
        for i in range(200 if lane == "a" else 60):
            if r.random() < 0.35:
                at = r.randrange(1000)
            jitter = r.choice([0, 0, 1, 3, 4])
            out.append((lane, i * r.choice([1, 1, 1, 2]) + i, r.choice(["c", "c", "c", None]), r.choice(["+", "+", "+", "-"]), None if r.random() < 0.1 else at + jitter, at + 30, T0 + dt.timedelta(microseconds=r.randrange(10**6)), 1, "x"))
    r.shuffle(out)
    unique = {(x[0], x[1]): x for x in out}
    return [*unique.values(), *list(unique.values())[:30]]


@pytest.mark.parametrize("chunk", [4, 1 << 15])
def test_against_brute_force(spark, chunk):
    data = rows()
    got = collapse_runs(spark.createDataFrame(data, SCHEMA), chunk=chunk).collect()
    mine = {(x["lane_id"], x["first_seq_no"], x["last_seq_no"], x["n_reads"], x["duration_us"]) for x in got}
    assert len(mine) == len(got) and mine == brute(data, 3)
    two = collapse_runs(spark.createDataFrame(data, SCHEMA), chunk=chunk, time=None, least=2).collect()
    assert {(x["lane_id"], x["first_seq_no"], x["last_seq_no"]) for x in two} == {x[:3] for x in mine if x[3] > 1}


def test_empty(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
