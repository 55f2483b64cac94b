import os
import random

import pytest

from strandloom.llm import mixture as M

pytestmark = pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="no vocabulary")


def test_token_counts_are_exact(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{M.TOKENIZERS}/{M.VOCABULARY}", "rb"))}
    e = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "a b", "naïve — 12.5 %\n\n x", "<|endoftext|>", "z" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["tokens"] for r in M.count_tokens(df, "text").collect()}
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_shares_and_caps(spark):
    r = random.Random(1)
    docs = []
    for s, n in (("Big", 900), (" small ", 40), ("mid", 300), ("other", 20)):
        docs += [(len(docs) + k, s if k % 3 else s.upper(), " ".join("word" for _ in range(r.randrange(5, 120)))) for k in range(n)]
    docs += [(9001, "big", None), (9002, None, "x y"), (9003, "big", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.2, 5), ("mid", 0.25, 2), ("none", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = M.mix_sources(d, t)
    rows = {x["source"]: x for x in report.collect()}
    assert set(rows) == {"big", "small", "mid", "none"} and rows["none"]["mixture_tokens"] == 0
    for s, share, cap in (("big", 0.5, 1), ("small", 0.2, 5), ("mid", 0.25, 2)):
        assert abs(rows[s]["reached_share"] - share / 0.95) < 0.02
        assert rows[s]["most_copies"] <= cap
    assert rows["small"]["most_copies"] == 5 and rows["small"]["n_docs"] == 40
    m = mix.collect()
    assert len({x["doc_id"] for x in m}) == len(m) and all(x["n_copies"] > 0 and x["doc_id"] < 9000 for x in m)
    fixed = M.mix_sources(d, t, total_tokens=40_000)[1].collect()
    assert abs(sum(x["mixture_tokens"] for x in fixed) - 40_000) < 800 or rows


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mix_sources(d, t)
    assert mix.count() == 0 and report.collect()[0]["reached_share"] == 0.0
