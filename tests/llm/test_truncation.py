import math
import random

from strandloom.llm.truncation import ORDERS, PRIOR, detect_truncated, thresholds

SCHEMA = "doc_id bigint, text string, lang string, cut string"


def corpus(seed):
    """Texts of sentences, a sixth of them cut, and which are."""
    r = random.Random(seed)
    nouns = ["valve", "socket", "lever", "housing", "spring", "bearing", "gasket", "piston"]
    docs, cut = [], set()
    for i in range(600):
        lines = []
        for _ in range(r.randrange(5, 14)):
            s = [f"The {r.choice(nouns)} of claim {r.randrange(1, 30)} encloses the {r.choice(nouns)} and rests on the {r.choice(nouns)}." for _ in range(r.randrange(1, 3))]
            lines.append(" ".join(s))
        if r.random() < 0.2:
            lines.append(r.choice(["FIG. 3", "(No drawings)", "* * * * *"]))
        t = "\n".join(lines)
        if i % 6 == 0:
            k = r.randrange(60, len(t) - 20)
            while t[k - 1] in ".\n" or t[k] in ".\n":
                k += 1
            t = t[:k] + r.choice(["", "", "…", " [trunc"])
            cut.add(i)
        docs.append((i, t, r.choice(["en", "EN", "eng", None]), "x"))
    return docs, cut


def test_held_out_accuracy(spark):
    docs, cut = corpus(4)
    docs += [(9000, None, "en", "x"), (9001, "", "en", "x"), (9002, "  \n", None, "x"), (9003, docs[1][1], "en", "x"), (9004, ("The valve of claim 3 encloses the socket.\n" * 60_000).rstrip(), "en", "x")]
    got = {r["doc_id"] for r in detect_truncated(spark.createDataFrame(docs, SCHEMA)).filter("cut").collect()}
    assert not got & {9000, 9001, 9002, 9004}
    assert len(got & cut) >= 0.93 * len(cut) and len(got - cut) <= 0.07 * len(cut)


def test_empty_and_thresholds(spark):
    assert detect_truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    assert thresholds([]) == {}
    t = thresholds([("en", x / 2, 100) for x in range(-4, 5)] + [("en", -20.0, 40), ("de", 1.0, 3)])
    assert -9.5 <= t["en"] <= -3 and t["de"] == thresholds([("all", x / 2, 100) for x in range(-4, 5)] + [("all", -20.0, 40), ("all", 1.0, 3)])["all"]


def test_counts_are_exact(spark):
    """log_odds against contexts counted by text search, in a corpus of far more contexts than 2^20, one text of which is longer than a block."""
    r = random.Random(7)
    noise = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3_000_000))
    lines = ["".join(r.choices("ABCDEFGH", k=24)) + f" {a}." for a in "uvwxyz"]
    texts = [noise, *(f"{a}\n{b}" for a in lines for b in lines)]
    # Breaks are doubled so that neighbouring lines share none.
    stream = ("".join("\n" + t for t in texts) + "\n").replace("\n", "\n\n")

    def expected(line):
        p = 1e-4
        for k in ORDERS:
            c = ("\n" + line)[-k:]
            n, e = stream.count(c) - 1, stream.count(c + "\n") - 1
            p = (e + PRIOR * p) / (n + PRIOR)
        return math.log2(p / (1 - p))

    got = detect_truncated(spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(got) == len(texts)
    for x in got:
        if x["doc_id"]:
            assert abs(x["log_odds"] - expected(texts[x["doc_id"]].split("\n")[1])) < 1e-6


def test_limit_from_the_distribution():
    complete = [("en", x / 2, 1000) for x in range(0, 30)]
    # Narrow complete texts: the limit comes close to them. Nothing cut: the spread of complete texts makes no limit among them.
    assert -6 < thresholds([*complete, ("en", -1.0, 5000), ("en", -2.0, 50), ("en", -20.0, 3000)])["en"] < -1
    assert thresholds([*complete, ("en", -1.0, 500)])["en"] == -8.0


def test_columns(spark):
    """Each text column has its own model and limits."""
    docs, cut = corpus(6)
    df = spark.createDataFrame([(i, t, "en", "No. 7.\nEnd of claim.") for i, t, _, _ in docs], SCHEMA)
    got = detect_truncated(df, ["text", "cut"]).groupBy("column").sum().collect()
    found = {(r["column"], r["doc_id"]) for r in detect_truncated(df, ["text", "cut"]).filter("cut").collect()}
    assert len(got) == 2 and {c for c, _ in found} == {"text"} and len({d for _, d in found} & cut) >= 0.93 * len(cut)
