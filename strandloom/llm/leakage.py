"""Evaluation passages inside a training corpus, through a distributed positional inverted index."""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.session import materialize

#: Words per segment of the index; a longer document forms a segment of its own.
SEGMENT_WORDS = 1 << 20
#: Words of query passages searched at a time; larger query sets go through the index in several blocks.
QUERY_WORDS = 2_000_000
#: Words in a row that make a leak.
RUN = 13

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑­¬][^\S\n]*\r?\n\s*(?=[^\W_])")
_INVISIBLE = re.compile("[͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case; character references, ligatures, invisible characters and words broken over lines undone."""
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = _INVISIBLE.sub("", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if plain:
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKC", text.replace("\u00ad", ""))
    return _WORD.findall(text.casefold())


def _segment(ids: list, texts: list[list[str]]) -> dict:
    """Postings of a block of documents: for each term the places in the block's word stream, ascending."""
    vocabulary: defaultdict[str, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    get = vocabulary.__getitem__
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    terms = np.fromiter((get(x) for w in texts for x in w), dtype=np.int32, count=int(lengths.sum()))
    # One free place between documents, so that no run crosses them.
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    places = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(texts)), lengths)
    order = np.argsort(terms, kind="stable")
    sizes = np.bincount(terms, minlength=len(vocabulary))
    sorted_places = places[order]
    deltas = np.diff(sorted_places, prepend=0)
    heads = np.cumsum(sizes) - sizes
    deltas[heads] = sorted_places[heads]
    planes = deltas.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # bytes of equal weight together pack better
    return {
        "doc_ids": ids,
        "doc_starts": starts.tolist(),
        "terms": "\n".join(vocabulary),
        "sizes": sizes.astype("<u4").tobytes(),
        "postings": zstandard.ZstdCompressor(level=1).compress(planes),
        "n": len(terms),
    }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A document-partitioned positional index of every word of every document with text; one row per segment.

    Documents stay where they are read, so building shuffles nothing; a segment holds the postings of
    about :data:`SEGMENT_WORDS` words.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_ids array<{kind}>, doc_starts array<bigint>, terms string, sizes binary, postings binary, n bigint"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out():
            s = _segment(ids, texts)
            arrow = pa.schema([("doc_ids", pa.list_(id_type)), ("doc_starts", pa.list_(pa.int64())), ("terms", pa.string()), ("sizes", pa.binary()), ("postings", pa.binary()), ("n", pa.int64())])
            return pa.RecordBatch.from_pylist([s], schema=arrow)

        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    w = words(t)
                    ids.append(i)
                    texts.append(w)
                    size += len(w) + 1
                    if size >= SEGMENT_WORDS:
                        yield out()
                        ids, texts, size = [], [], 0
        if ids:
            yield out()

    return docs.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(f, schema)


class Queries:
    """Query passages as one stream of numbers of their distinct words, so that whole sets are looked up in a segment at once."""

    def __init__(self, passages: list[tuple[object, list[str]]]) -> None:
        self.keys = [q for q, _ in passages]
        names: dict[str, int] = {}
        self.stream = np.array([names.setdefault(w, len(names)) for _, p in passages for w in p], dtype=np.int64)
        self.names = pa.array(list(names), pa.string())
        self.ends = np.cumsum([len(p) for _, p in passages], dtype=np.int64)


def _alive(known: np.ndarray, ends: np.ndarray, width: int, least: int) -> np.ndarray:
    """Passages (by number) with at least ``least`` known words in some ``width`` successive ones; shorter passages count as a whole."""
    c = np.concatenate([[0], np.cumsum(known)])
    begins = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - begins)
    stop = np.minimum(np.arange(len(known)) + width, ends[owner])
    return np.unique(owner[c[stop] - c[:-1] >= least])


def _search(segment: dict, queries: Queries, run: int, near: int | None) -> Iterator[tuple[object, object, int, int, int]]:
    """(query, doc, longest run, matched words, most words near each other), one row for each document of each alignment that matches.

    Words are looked up for all queries at once; a passage of which no window has enough words in the segment goes no further.
    """
    n = int(segment["n"])
    if not n:
        return
    # Words looked at together, how far one may be from its place, and how many of the rarest must agree on an alignment.
    width, slack, need = (near, (near - run) // 2, 4) if near else (run, 0, 3)
    number = pc.index_in(queries.names, value_set=pa.array(segment["terms"].split("\n"), pa.string()))
    number = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    stream = number[queries.stream]
    passages = _alive(stream >= 0, queries.ends, width, run)
    if not len(passages):
        return
    sizes = np.frombuffer(segment["sizes"], "<u4").astype(np.int64)
    deltas = np.frombuffer(zstandard.ZstdDecompressor().decompress(segment["postings"]), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    heads = np.cumsum(sizes) - sizes
    starts = np.asarray(segment["doc_starts"])
    # All lists at once: sums over the whole, less what was reached before each list.
    places = np.cumsum(deltas, dtype=np.int64)
    places -= np.repeat(places[heads] - deltas[heads], sizes)
    at_place = np.full(int(places.max()) + 2, -2, np.int32)  # the word at each place, for looking at an alignment as a whole
    at_place[places] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def postings(t: int) -> np.ndarray:
        return places[heads[t] : heads[t] + sizes[t]]

    for i in passages:
        t = stream[queries.ends[i - 1] if i else 0 : queries.ends[i]]
        df = np.where(t >= 0, sizes[t], 0)
        w = min(width, len(t))
        windows = np.lib.stride_tricks.sliding_window_view(df, w)
        enough = np.flatnonzero((windows > 0).sum(axis=1) >= run)
        # At most w - run words of a window may miss (those that the segment lacks are the rarest of all), so ``need`` of these are there.
        anchors = np.unique(np.argsort(windows[enough], axis=1, kind="stable")[:, : w - run + need] + enough[:, None])
        anchors = anchors[df[anchors] > 0]
        if len(anchors) < need:
            continue
        # Offset-adjusted lists of the anchors hold places at which the passage would begin; a match needs several that agree.
        begins = np.sort(np.concatenate([postings(t[a]) - a for a in anchors]))
        begins = np.unique(begins[: 1 - need][begins[need - 1 :] - begins[: 1 - need] <= 2 * slack])
        if not len(begins):
            continue

        def standing(at: np.ndarray, off: int) -> np.ndarray:
            """Those of the alignments in which enough words of a window stand within ``off`` of their place."""
            kept = []
            for step in range(0, len(at), 1 << 14):
                some = at[step : step + (1 << 14)]
                hits = np.zeros((len(some), len(t) + 1), np.int32)
                if not off:
                    where = some[:, None] + np.arange(len(t))
                    # The last place of the array holds no word, as do places outside.
                    hits[:, 1:] = at_place[np.where((where >= 0) & (where < len(at_place)), where, len(at_place) - 1)] == np.where(t >= 0, t, -3)
                for j, term in enumerate(t if off else ()):
                    if term >= 0:
                        p = postings(term)
                        k = np.searchsorted(p, some + j - off)
                        hits[:, j + 1] = (p[np.minimum(k, len(p) - 1)] <= some + j + off) & (k < len(p))
                c = np.cumsum(hits, axis=1)
                kept.append(some[(c[:, w:] - c[:, :-w] >= run).any(axis=1)])
            return np.concatenate(kept) if kept else at

        begins = standing(begins, 2 * slack)
        if slack:
            begins = standing(np.unique(begins[:, None] + np.arange(-slack, slack + 1)), slack)
        for begin in begins.tolist():
            yield from _matches(segment["doc_ids"], starts, at_place, queries.keys[i], t, begin, w, run, slack)


def _matches(doc_ids: list, starts: np.ndarray, at_place: np.ndarray, query: object, t: np.ndarray, begin: int, width: int, run: int, slack: int) -> Iterator[tuple[object, object, int, int, int]]:
    """The documents that lie under one alignment of a passage and hold enough of its words, each with its own words only."""
    first, last = np.searchsorted(starts, [begin - slack, begin + len(t) - 1 + slack], side="right") - 1
    where = (begin + np.arange(len(t)))[:, None] + np.arange(-slack, slack + 1)
    held = at_place[np.where((where >= 0) & (where < len(at_place)), where, len(at_place) - 1)] == np.where(t >= 0, t, -3)[:, None]
    for d in range(max(int(first), 0), int(last) + 1):
        lo = int(starts[d])
        hi = int(starts[d + 1]) - 1 if d + 1 < len(starts) else lo + (1 << 40)
        own = held & (where >= lo) & (where < hi)
        exact = own[:, slack].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], exact, [0]])))
        longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
        most = _most_in_order(own, where, width, run) if slack or width > run else longest
        if longest >= run or most >= run:
            yield query, doc_ids[d], longest, int(exact.sum()), most


def _most_in_order(own: np.ndarray, where: np.ndarray, width: int, run: int) -> int:
    """The most of ``width`` successive words that can be given places in ascending order, of the places in ``where`` that are ``own``; 0 if fewer than ``run``."""
    c = np.concatenate([[0], np.cumsum(own.any(axis=1))])
    width = min(width, len(own))
    some = c[width:] - c[:-width]
    if some.max() < run:
        return 0
    best, here = run - 1, [w[o].tolist() for w, o in zip(where, own)]
    for s in np.argsort(-some, kind="stable").tolist():
        if some[s] <= best:
            break
        chosen: list[int] = []  # chosen[k] is the least place at which k + 1 words can end
        for found in here[s : s + width]:
            for x in reversed(found):  # from the right, so that a word is taken once
                k = bisect.bisect_left(chosen, x)
                chosen[k : k + 1] = [x]
        best = max(best, len(chosen))
    return best if best >= run else 0


def find_leaks(index: DataFrame, items: DataFrame, key: str = "item_id", passage: str = "passage", run: int = RUN, near: int | None = None) -> DataFrame:
    """(``key``, ``doc_id``, ``longest_run``, ``matched_words``, ``near_words``) of every document that holds at least ``run`` words of an item's passage together.

    Without ``near``, only exact phrases count: ``run`` consecutive words, in order. With it, proximity matches come out, too: at least ``run`` of
    ``near`` successive words of the passage in order, none further than half of ``near - run`` from its place in some alignment, so that words may be
    put in, left out or replaced in between. ``longest_run`` is the longest exact phrase in one alignment, ``matched_words`` the most words that stand in their exact
    place relative to it, ``near_words`` the most of ``near`` words in one proximity match (without ``near``, the longest run). Every
    document under an alignment comes out with its own words only. Items with a null passage or fewer than ``run`` words match
    nothing; an item that occurs twice reports once. The queries are a stated set: they are read in blocks of at most
    :data:`QUERY_WORDS` words, and each block is broadcast to all segments.
    """
    if near is not None and near <= run:
        raise ValueError("near must be above run: that many words are looked at together")
    kind = items.schema[key].dataType.simpleString()
    id_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    q_type, d_type = to_arrow_type(items.schema[key].dataType), to_arrow_type(index.schema["doc_ids"].dataType.elementType)
    spark = index.sparkSession
    out, block, size = None, [], 0
    names = ["q", "d", "longest_run", "matched_words", "near_words"]

    def searched(some):
        held = spark.sparkContext.broadcast(some)

        def f(batches):
            queries = Queries(held.value)
            for b in batches:
                for s in b.to_pylist():
                    rows = list(_search(s, queries, run, near)) if queries.keys else []
                    if rows:
                        q, doc, *counts = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(q, q_type), pa.array(doc, d_type), *(pa.array(x, pa.int32()) for x in counts)], names=names)

        return index.mapInArrow(f, f"q {kind}, d {id_kind}, longest_run int, matched_words int, near_words int")

    rows = items.select(F.col(key), F.col(passage)).filter(F.col(passage).isNotNull()).distinct()
    for r in rows.toLocalIterator():
        w = words(r[1])
        if len(w) < run:
            continue
        block.append((r[0], w))
        size += len(w)
        if size >= QUERY_WORDS:
            found = searched(block)
            out = found if out is None else out.unionByName(found)
            block, size = [], 0
    if block or out is None:
        found = searched(block)
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("q").alias(key), F.col("d").alias("doc_id")).agg(*[F.max(c).alias(c) for c in names[2:]])


def stored_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of :func:`build_index` as a table in the shared folder."""
    return materialize(build_index(docs, key, text), "index")
