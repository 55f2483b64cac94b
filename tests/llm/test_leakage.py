import os
import random
from collections import Counter

import pytest

from strandloom.llm.leakage import build_index, find_leaks, words
from strandloom.llm.queries import llm

DATA = "/root/testdata/sf0.001"

VOCABULARY = [f"w{i}" for i in range(60)] + ["the", "of"] * 20


def brute(items, docs, run):
    out = set()
    for i, p in items:
        w = words(p or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in docs:
            x = words(t or "")
            if any(tuple(x[k : k + run]) in grams for k in range(len(x) - run + 1)):
                out.add((i, d))
    return out


def test_words():
    assert words("The ﬁrst&amp;second  co-\noperate, zero​width Fähre") == ["the", "first", "second", "cooperate", "zerowidth", "fähre"]
    assert words("co-\u200b\noperate \u00adsoft\u00ad\nly &#97;nd&shy;roid") == ["cooperate", "softly", "android"]


def test_against_brute_force(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(r.choice([5, 13, 20, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "a b c"), (3, None)]
    docs = [(d, text(r.randrange(0, 120))) for d in range(30)] + [(80, None), (81, "")]
    for d in range(40, 60):  # parts of passages of all lengths around the limit, rewritten
        i, p = r.choice(items[:25])
        w = p.split()
        k = r.randrange(max(1, len(w) - 14))
        piece = w[k : k + r.choice([11, 12, 13, 14, 30])]
        docs.append((d, text(20) + " ; " + ",\n".join(piece).upper() + "! " + text(9)))
    docs.append((70, items[3][1] + " " + text(40_000) + " " + items[4][1]))
    docs += [(71, docs[-1][1])]
    i = spark.createDataFrame([(*x, "n") for x in items + items[:3]], "item_id int, passage string, doc_id string")
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, n int")
    got = find_leaks(build_index(d), i).collect()
    mine = {(x["item_id"], x["doc_id"]) for x in got}
    assert len(got) == len(mine) and mine == brute(items, docs, 13)
    longest = {(x["item_id"], x["doc_id"]): x["longest_run"] for x in got}
    if (3, 70) in longest:
        assert longest[3, 70] >= len(words(items[3][1])) - 1


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id int, passage string")
    assert find_leaks(build_index(d), i).count() == 0


def test_every_document_under_an_alignment(spark):
    """A passage lies over the border of two documents; each is reported with its own words."""
    p = [f"x{i}" for i in range(60)]
    the = ["the"] * 40 + [f"y{i}" for i in range(20)]
    docs = [(1, " ".join(p[:20])), (2, " ".join(p[21:])), (3, " ".join(the[:39])), (4, " ".join(the[40:])), (5, "")]
    got = find_leaks(build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)), spark.createDataFrame([(1, " ".join(p)), (2, " ".join(the))], "item_id int, passage string")).collect()
    assert {(r["item_id"], r["doc_id"], r["longest_run"]) for r in got} == {(1, 1, 20), (1, 2, 39), (2, 3, 39), (2, 4, 20)}


def near_brute(passage, text, run, near):
    """The most of ``near`` successive passage words that stand in ascending order in the text, each within (near - run) // 2 of its place."""
    p, x, slack, best = words(passage), words(text), (near - run) // 2, 0
    if len(p) < run:
        return 0
    for b in range(-len(p) - slack, len(x) + slack):
        for s in range(max(len(p) - near, 0) + 1):
            dp = [0] * (len(x) + 1)  # dp[k]: most words in order with the last at place k - 1
            for j in range(s, min(s + near, len(p))):
                for k in range(min(b + j + slack, len(x) - 1), max(b + j - slack, 0) - 1, -1):
                    if x[k] == p[j]:
                        dp[k + 1] = max(dp[k + 1], 1 + max(dp[: k + 1]))
            best = max(best, max(dp))
    return best


def test_proximity_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 8
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([13, 16, 24, 5])]
    docs = []
    for d in range(14):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(6)):  # words put in, left out, replaced
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(3)
        docs.append((d, " ".join([r.choice(vocabulary) for _ in range(3)] + w)))
    got = find_leaks(build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)), spark.createDataFrame(items, "item_id int, passage string"), run=9, near=13).collect()
    want = {(i, d): near_brute(p, t, 9, 13) for i, p in items for d, t in docs}
    assert {(x["item_id"], x["doc_id"]): x["near_words"] for x in got} == {k: n for k, n in want.items() if n >= 9}
    assert any(x["longest_run"] < 9 for x in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no stored tables")
def test_stored_tables_against_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{DATA}/eval_items.parquet").select("item_id", "passage").collect()]
    want = brute(items, docs, 13)
    assert want and {tuple(x) for x in llm.queries["p8_found"](spark, DATA).collect()} == want
    per = {x["item_id"]: x["n_docs"] for x in llm.queries["p8_items"](spark, DATA).collect()}
    assert per == dict(Counter(i for i, _ in want))
