"""Texts cut off by field limits or during transfer, found with a backward character n-gram model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import salted_join
from strandloom.session import materialize

#: Context lengths of the model, in characters from the end backwards; each is the double of the one before.
ORDERS = (1, 2, 4, 8, 16, 32)
#: log2 of the bits a wanted context has in the filter of training, and of the largest filter (128 MB). The filter only saves work.
FILTER_BITS_EACH, FILTER_BITS_MOST = 4, 30
#: Characters of a text's end that scoring looks at: the longest context and room for collapsed digits.
TAIL = 96
#: Weight of the shorter context's estimate, in observations.
PRIOR = 20.0
#: Characters hashed at a time, few enough for a core's cache, and counted at a time; they bound a task's memory for texts of any length.
BLOCK, COUNTED = 1 << 16, 1 << 21
#: Contexts up to this length are common enough to be known from other texts than copies.
SAFE_ORDER = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
#: What a cut leaves behind it: ellipses, a torn tag, character reference, bracketed note or character.
_DEBRIS = r"(?:\s|…|\.\.\.|�|<[^>\s]{0,12}|&#?\w{0,8}|\[\w{0,12}…?\]?)+\z"
_MARK = r"(?:…|\.\.\.|�|<[^>\s]{0,12}|&#?\w{0,8}|\[(?:trunc\w{0,8}|more|cut)?…?\]?)\s*\z"


def _codes(text: str) -> np.ndarray:
    """Code points, digits as one symbol and runs of them as one, blanks other than line breaks likewise."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    digit = (a >= 48) & (a <= 57)
    a[digit] = 57
    blank = (a == 32) | (a == 9) | (a == 160) | (a == 13)
    a[blank] = 32
    same = np.zeros(len(a), bool)
    same[1:] = (digit[1:] & digit[:-1]) | (blank[1:] & blank[:-1])
    return a[~same]


def _contexts(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the 64-bit hash of the context that ends at each place.

    A context does not reach back over the start of its line, so that a closing line is a context of its own.
    """
    at = np.arange(len(codes), dtype=np.int32)
    start = np.maximum.accumulate(np.where(codes == 10, at, np.int32(0)))
    in_line = at
    in_line[1:] -= start[:-1]
    in_line[codes == 10] = 0
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MUL
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, power = 1, _STEP
    for n in ORDERS:
        while width < n:
            if width < len(h):
                longer = h[width:] + h[:-width] * (in_line[width:] >= width) * np.uint64(power)
                h = np.concatenate([h[:width], longer])
            power = power * power & 0xFFFFFFFFFFFFFFFF
            width *= 2
        mixed = (h + np.uint64(n)) * _MUL
        yield (mixed ^ (mixed >> np.uint64(32))) * _MUL


def _end_contexts(tails: list[str]) -> pa.Array:
    """Per tail, the hashes of the contexts at its end, one an order; none for a blank tail."""
    last = [t[t.rfind("\n") + 1 :] if t.strip() else "" for t in tails]
    some = [x for x in last if x]
    codes = _codes("".join("\n" + x for x in some) + "\n")
    ends = np.flatnonzero(codes == 10)[1:] - 1
    keys = np.stack([c[ends] for c in _contexts(codes)], axis=1).ravel().view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(ORDERS) if x else 0 for x in last])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts with a line break before each and one after the last, as one stream in pieces of bounded length."""
    held: list[str] = []
    size = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            for i in range(0, len(t), BLOCK):
                held.append(t[i : i + BLOCK] if i else "\n" + t[:BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    yield "".join(held)
                    held, size = [], 0
    yield "".join(held) + "\n"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, first): places from ``first`` up to the last but one are new; each place of a text is so once, with its whole context and what follows."""
    codes, last = np.full(1, 10, dtype=np.uint32), "\n"
    for s in _stream(batches):
        kept = codes[-ORDERS[-1] - 1 :]
        codes = np.concatenate([kept, _codes(last + s)[1:]])
        last = s[-1]
        yield codes, len(kept) - 1


def wanted_filter(tails: DataFrame) -> np.ndarray:
    """Bits set for the contexts that some text ends with, in words of 64; a bit may stand for several contexts."""
    bits = min(max((tails.count() * len(ORDERS)).bit_length() + FILTER_BITS_EACH, 10), FILTER_BITS_MOST)
    at = tails.select(F.explode("contexts").alias("c")).select(F.shiftrightunsigned("c", 64 - bits).alias("i"))
    words = at.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def train(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(context, n, s): exact occurrences and stops of contexts over every place of every text, wanted ones and the few others that pass the filter.

    A context stops where a line break or the end of the text follows. Tasks sum up some blocks at a time, partial sums go by context. A
    context can be wanted only if its shorter ones are, so a place that fails the filter is not looked at in longer orders.
    """
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def f(batches):
        words = held.value
        down = np.uint64(64 - (len(words).bit_length() - 1 + 6))
        size, found = 0, [[] for _ in ORDERS]
        for codes, first in _blocks(batches):
            at = np.flatnonzero(codes[first:-1] != 10) + first
            stops = codes[1:] == 10
            for c, kept in zip(_contexts(codes), found):
                c = c[at]
                i = c >> down
                ok = (words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)
                at, c = at[ok], c[ok]
                kept.append((c, c[stops[at]]))
            size += len(codes)
            if size >= COUNTED:
                yield from sums(found)
                size, found = 0, [[] for _ in ORDERS]
        yield from sums(found)

    def sums(found):
        for kept in found:
            if not kept:
                continue
            keys, n = np.unique(np.concatenate([c for c, _ in kept]), return_counts=True)
            stopped, m = np.unique(np.concatenate([c for _, c in kept]), return_counts=True)
            s = np.zeros(len(keys), dtype=np.int64)
            s[keys.searchsorted(stopped)] = m
            for j in range(0, len(keys), 50_000):
                k = slice(j, j + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[k].view(np.int64)), pa.array(n[k].astype(np.int64)), pa.array(s[k])], names=["context", "n", "s"])

    return texts.mapInArrow(f, "context long, n long, s long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def stop_log_odds(counts: Column | str, own_stop: Column | str, long_line: Column | str) -> Column:
    """log2 of P(stop) / P(continuation) after the last context, from its (k, n, s) by order, backed off from long contexts to short ones.

    The text's own occurrence is left out. In a line that is longer than the contexts, the estimate up to
    :data:`SAFE_ORDER` bounds that of all: the longest ones may be known only from copies cut at the same place.
    """
    own, long_line = F.expr(f"cast({own_stop} as int)"), F.col(long_line)

    def step(a, x):
        n = F.greatest(F.coalesce(x["n"], F.lit(0)) - 1, F.lit(0))
        e = F.least(F.greatest(F.coalesce(x["s"], F.lit(0)) - own, F.lit(0)), n)
        p = (e + PRIOR * a["p"]) / (n + PRIOR)
        return F.struct(p.alias("p"), F.when(long_line & (x["k"] == ORDERS.index(SAFE_ORDER)), p).otherwise(a["least"]).alias("least"))

    end = lambda a: F.least(F.greatest(F.least(a["p"], a["least"]), F.lit(1e-9)), F.lit(1 - 1e-9))
    p = F.aggregate(counts, F.struct(F.lit(1e-4).alias("p"), F.lit(1.0).alias("least")), step, end)
    return F.log2(p / (1 - p))


def language_group(lang: Column) -> Column:
    """The first two letters of a language code; three-letter codes by their two-letter form; anything else ``und``."""
    c = F.lower(F.trim(lang))
    c = F.when(c.isin("eng"), "en").when(c.isin("ger", "deu"), "de").when(c.isin("fre", "fra"), "fr").when(c.isin("spa"), "es").otherwise(F.regexp_extract(c, r"\A([a-z]{2})(?:\z|[-_])", 1))
    return F.when(c.isNull() | c.isin("", "xx"), "und").otherwise(c)


def thresholds(histogram: list[tuple[str, float, int]], least: int = 200, default: float = -8.0) -> dict[str, float]:
    """Per group, the log-odds below which a text counts as cut: 3.5 deviations under the mean of the complete texts.

    Complete are, for this, the texts above the split of greatest variance between classes. All log-odds above 0, where to stop
    is likelier than to go on, count as 0: how sure a complete end is says nothing about where cut ones begin. Groups with
    fewer texts than ``least`` take the threshold of all together. ``default`` holds where the texts below the split do not lie
    under it on average, so that nothing looks cut.
    """

    def limit(h: dict[float, int]) -> float:
        capped: dict[float, int] = {}
        for x, c in h.items():
            capped[min(x, 0.0)] = capped.get(min(x, 0.0), 0) + c
        h, xs = capped, sorted(capped)
        n, total = sum(h.values()), sum(x * h[x] for x in xs)
        best, at, w, s = -1.0, xs[0] - 1, 0, 0.0
        for a, b in zip(xs, xs[1:]):
            w += h[a]
            s += a * h[a]
            v = w * (n - w) * (s / w - (total - s) / (n - w)) ** 2
            if v > best:
                best, at = v, (a + b) / 2
        top = {x: c for x, c in h.items() if x > at}
        low = {x: c for x, c in h.items() if x <= at}
        m = sum(x * c for x, c in top.items()) / sum(top.values())
        sd = math.sqrt(sum(c * (x - m) ** 2 for x, c in top.items()) / sum(top.values()))
        return m - 3.5 * sd if low and sum(x * c for x, c in low.items()) / sum(low.values()) < default else default

    groups: dict[str, dict[float, int]] = {}
    everything: dict[float, int] = {}
    for g, x, n in histogram:
        groups.setdefault(g, {})[x] = groups.get(g, {}).get(x, 0) + n
        everything[x] = everything.get(x, 0) + n
    common = limit(everything) if everything else default
    return {g: limit(h) if sum(h.values()) >= least else common for g, h in groups.items()}


def detect_truncated(docs: DataFrame, text: str | list[str] = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Every document with text: ``key``, ``column``, ``lang_group``, ``log_odds``, ``limit``, ``marked`` (debris of a cut at the end) and ``cut``.

    Of several text columns, each has its own model and limits; a document has a row for each of them in which it has text.

    A backward character n-gram model is trained over all texts; a text is cut if the log-odds of stopping
    after its last context (debris of the cut taken off) lie under the limit of its language and column. Null texts
    are left out; texts that are empty or blank are not cut. ``key`` need not be unique or non-null; other
    columns are not looked at. Texts of any length are trained on whole. Contexts that texts end with are counted
    exactly, by 64-bit hashes: at most orders * documents of them, joined to the ends. Only a filter of bounded
    size (:data:`FILTER_BITS_MOST`) passes the driver.
    """
    if not isinstance(text, str):
        out = [detect_truncated(docs, c, lang, key) for c in text]
        return reduce(DataFrame.unionByName, out)
    ends = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), language_group(F.col(lang)).alias("lang_group"), F.substring(F.col(text), -2 * TAIL, 2 * TAIL).alias("end"))
    tails = ends.select("key", "lang_group", F.col("end").rlike(_MARK).alias("marked"), (~F.col("end").rlike(_DEBRIS)).alias("own_stop"), F.substring(F.regexp_replace("end", _DEBRIS, ""), -TAIL, TAIL).alias("tail"))
    kind = tails.schema["key"].dataType.simpleString()

    def f(batches):
        for b in batches:
            texts = b.column(4).to_pylist()
            long_line = pa.array([len(t) - t.rfind("\n") > ORDERS[-1] for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], long_line, _end_contexts(texts)], names=["key", "lang_group", "marked", "own_stop", "long_line", "contexts"])

    tails = tails.mapInArrow(f, f"key {kind}, lang_group string, marked boolean, own_stop boolean, long_line boolean, contexts array<bigint>")
    tails = materialize(tails.withColumn("id", F.monotonically_increasing_id()), "tails")
    counted = train(docs.filter(F.col(text).isNotNull()).select(F.col(text)), wanted_filter(tails))
    # Short contexts are the end of a large share of all texts.
    each = salted_join(tails.select("id", F.posexplode("contexts").alias("k", "context")), counted, "context", "left")
    counts = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "n", "s"))).alias("counts"))
    odds = F.coalesce(stop_log_odds("counts", "own_stop", "long_line"), F.lit(0.0))
    scored = materialize(tails.join(counts, "id", "left").select("key", "lang_group", "marked", odds.alias("log_odds")), "odds")
    bins = scored.groupBy("lang_group", F.round(F.col("log_odds") * 2).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # Language groups are codes of two letters, so this is a table of bounded size.
    limits = thresholds([(r["lang_group"], r["x"] / 2, r["n"]) for r in bins.collect()])
    table = F.create_map(*[F.lit(x) for g, v in limits.items() for x in (g, v)]) if limits else F.expr("map('', double(0))")
    return scored.withColumn("limit", F.element_at(table, F.col("lang_group"))).withColumn("cut", F.col("log_odds") < F.col("limit")).select(F.col("key").alias(key), F.lit(text).alias("column"), "lang_group", "log_odds", "limit", "marked", "cut")
