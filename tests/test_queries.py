"""Queries of the registry against their SQL in DuckDB, on the smallest stored tables. All of them run with STRANDLOOM_ALL=1."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no stored tables")
SHORT = ["gtf_round_trip", "gff3_round_trip", "bed_round_trip", "wiggle_round_trip", "fasta_round_trip", "junction_classes", "unstranded_masks", "psite_offsets_median", "p4_sizes", "p1_groups", "p9_limits", "p2_found", "p5_found", "p7_profile", "p6_found", "counts_in_region", "counts_in_region_masked", "map_center", "merge_genes", "metagene_profile", "find_junctions", "track_runs"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("STRANDLOOM_ALL") else [n for n in SHORT if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in r.description], r.fetchall())


def test_registries():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (2, 4, 5, 6, 7)} <= set(q)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
