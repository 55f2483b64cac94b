"""Repeated k-mers of a tiled genome: letters in two bits, gathered into stretches, so that k-mers are numbers that no row is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import sequence as S
from strandloom.session import discard, materialize, materialize_counting

#: Letters of a stretch, and tiles that a task packs at a time.
STRETCH, HELD = 1 << 20, 1 << 19
#: Longest k-mers that are a long, and that are counted in a table of all there are; numbers of a part of that table.
LONGEST, TABLE, PART = 31, 11, 1 << 16
#: k-mers of either strand that a round compares, rounds at most, and k-mers of a bucket of a round.
ROUND, ROUNDS, BUCKET = 24_000_000, 32, 1_500_000

_CODE = np.full(256, 5, np.uint8)  # 4: unknown or no letter, 5: a letter that two bits cannot say
_CODE[list(b"ACGT")] = range(4)
_CODE[[0, ord("N")]] = 4
_FOUR = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1).view(np.uint32)


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """Shuffle files go with the job that wrote them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _bytes(col: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in col]


def _packed(b: pa.RecordBatch, tile: int, known: dict) -> tuple[np.ndarray, ...]:
    """Of each tile of (chrom, tile_no, seq): number of the chrom, tile_no, letters, bits of the unknown ones, whether it has other letters."""
    names = pc.dictionary_encode(b.column(0), null_encoding="encode")
    chrom = np.array([known.setdefault(x, len(known)) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    seq = pc.cast(b.column(2), pa.large_string())
    at = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    if size.max() > tile:
        raise ValueError(f"a tile has {size.max()} letters, more than {tile}")
    width = -(-tile // 4) * 4
    if width == tile and size.min() == tile:
        letters = data.reshape(-1, tile)
    else:
        letters = np.zeros((len(size), width), np.uint8)
        letters[np.arange(width) < size[:, None]] = data
    code = _CODE[letters]
    unknown = code > 3
    v = (code & 3).view("<u4")
    return chrom, b.column(1).to_numpy(), (v << 6 | v >> 4 | v >> 14 | v >> 24).astype(np.uint8), np.packbits(unknown, axis=1), (code == 5).any(axis=1)


def _packer(tile: int, per: int, ahead: int, kind: type) -> Callable:
    """Tiles (chrom, tile_no, seq) to parts of stretches of ``per`` tiles; the first ``ahead`` tiles of a stretch stand behind the one before, too."""

    def parts(held: list, known: dict, of: pa.DataType) -> Iterator[pa.RecordBatch]:
        chrom, no, letters, unknown, odd = (np.concatenate(x) for x in zip(*held))
        block, off = np.divmod(no, per)
        head = np.flatnonzero(off < ahead)
        row = np.concatenate([np.arange(len(no)), head])
        block, off = np.concatenate([block, block[head] - 1]), np.concatenate([off, off[head] + per])
        order = np.lexsort((off, block, chrom[row]))
        row, block, off = row[order], block[order], off[order]
        cuts = [0, *(np.flatnonzero((np.diff(chrom[row]) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(row)]
        letters, unknown, odd, off, names = letters[row], unknown[row], odd[row], off.astype(kind), list(known)
        some = unknown.any()
        for lo in range(0, len(cuts) - 1, 256):
            at = list(zip(cuts[lo : lo + 256], cuts[lo + 1 : lo + 257]))
            yield pa.RecordBatch.from_arrays([
                pa.array([names[chrom[row[a]]] for a, _ in at], of), pa.array([int(block[a]) for a, _ in at], pa.int64()),
                pa.array([off[a:z].tobytes() for a, z in at], pa.binary()), pa.array([letters[a:z].tobytes() for a, z in at], pa.binary()),
                pa.array([unknown[a:z].tobytes() if some and unknown[a:z].any() else None for a, z in at], pa.binary()), pa.array([bool(odd[a:z].any()) for a, z in at]),
            ], names=["chrom", "block", "nos", "letters", "unknown", "odd"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, n, of = [], {}, 0, pa.string()
        for b in batches:
            if b.num_rows:
                of = b.column(0).type
                held.append(_packed(b, tile, known))
                n += b.num_rows
            if n >= HELD:
                yield from parts(held, known, of)
                held, n = [], 0
        if held:
            yield from parts(held, known, of)

    return f


def _gather(per: int, kind: type, tile: int) -> Callable:
    """One stretch of its parts, tiles in order; their numbers as differences."""
    width, bits = -(-tile // 4), -(-(-(-tile // 4) * 4) // 8)

    def f(key: tuple, t: pa.Table) -> pa.Table:
        nos = _bytes(t.column("nos"), kind)
        no, at = np.unique(np.concatenate(nos), return_index=True)
        if no[0] >= per:
            return t.slice(0, 0).select(["chrom", "block", "nos", "letters", "unknown", "odd"])
        letters = np.concatenate(_bytes(t.column("letters"), np.uint8)).reshape(-1, width)[at]
        unknown = None
        if t.column("unknown").null_count < t.num_rows:
            unknown = np.concatenate([x.reshape(-1, bits) if len(x) else np.zeros((len(n), bits), np.uint8) for x, n in zip(_bytes(t.column("unknown"), np.uint8), nos)])[at].tobytes()
        return pa.table({"chrom": t.column("chrom").slice(0, 1), "block": t.column("block").slice(0, 1), "nos": pa.array([np.diff(no, prepend=no[:1] * 0).astype(kind).tobytes()], pa.binary()), "letters": pa.array([letters.tobytes()], pa.binary()), "unknown": pa.array([unknown], pa.binary()), "odd": pa.array([pc.any(t.column("odd")).as_py()])})

    return f


def _words(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every k letters: their number, that of the reverse complement, whether all are known. Windows are doubled, not built letter by letter."""

    def join(a, p, b, q):
        n = len(b[0]) - p
        return a[0][:n] << 2 * q | b[0][p:], b[1][p:] << 2 * p | a[1][:n], a[2][:n] & b[2][p:]

    x = (code & 3).astype(np.int32 if k <= 15 else np.int64)
    have, size, out, n = (x, 3 - x, code < 4), 1, None, 0
    while True:
        if k & size:
            out, n = (have, size) if out is None else (join(out, n, have, size), n + size)
        if 2 * size > k:
            return out
        have, size = join(have, size, have, size), 2 * size


def _stretches(b: pa.RecordBatch, k: int, tile: int, per: int, kind: type) -> Iterator[tuple]:
    """Of each stretch: row, number of the first letter of each slot of a tile within the stretch, k-mers that start in it, as :func:`_words`."""
    width = -(-tile // 4)
    for i in range(b.num_rows):
        nos, letters, unknown = (_bytes(b.column(c).slice(i, 1), t)[0] for c, t in (("nos", kind), ("letters", np.uint8), ("unknown", np.uint8)))
        no = np.cumsum(nos, dtype=np.int64)
        slot = np.concatenate([[0], np.cumsum(1 + (np.diff(no) > 1))])  # an empty tile where tiles are missing
        code = np.full((slot[-1] + 1, tile), 4, np.uint8)
        each = _FOUR[letters].view(np.uint8).reshape(len(no), width * 4)
        if len(unknown):
            each[np.unpackbits(unknown.reshape(len(no), -1), axis=1)[:, : width * 4] > 0] = 4
        code[slot] = each[:, :tile]
        if code.size < k:
            continue
        first = np.zeros(len(code), np.int64)
        first[slot] = no * tile
        w, r, known = _words(code.reshape(-1), k)
        n = (slot[np.searchsorted(no, per) - 1] + 1) * tile
        yield i, first, w[:n], r[:n], known[:n]


def _tally(k: int, *how) -> Callable:
    """Bits of the k-mers, the lesser of both strands, that occur, and that occur more than once in the stretches of a task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4**k, np.int64)
        for b in batches:
            for _, _, w, r, known in _stretches(b, k, *how):
                n += np.bincount(np.minimum(w, r)[known], minlength=4**k)
                np.add.at(n, w[(w == r) & known], 1)  # its own reverse complement counts twice
        if n.any():
            n = n.reshape(-1, min(PART, 4**k))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), *(pa.array([np.packbits(x).tobytes() for x in n >= least], pa.binary()) for least in (1, 2))], names=["part", "one", "two"])

    return f


def _sum(t: pa.Table) -> pa.Table:
    one = two = np.uint8(0)
    for a, b in zip(_bytes(t.column("one"), np.uint8), _bytes(t.column("two"), np.uint8)):
        one, two = one | a, two | b | one & a
    return pa.table({"part": t.column("part").slice(0, 1), "two": pa.array([two.tobytes()], pa.binary())})


def _bounds(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return at[::2], at[1::2]


def _marked(bits: bytes, k: int, tile: int, per: int, kind: type) -> Callable:
    """Runs of starts of k-mers whose bit is set."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for b in batches:
            for i, first, w, r, known in _stretches(b, k, tile, per, kind):
                s, e = _bounds(is_set[np.minimum(w, r)] & known)
                start = b.column("block")[i].as_py() * per * tile + first[s // tile] + s % tile
                yield pa.RecordBatch.from_arrays([b.column("chrom").take(pa.array(np.full(len(s), i))), pa.array(start), pa.array(start + e - s)], names=["chrom", "start", "end"])

    return f


def _planes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _of_planes(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = x.reshape(n, -1).T
    return out.reshape(-1).view("<i8")


def _halves(which: int, rounds: int, buckets: int, k: int, tile: int, per: int, kind: type) -> Callable:
    """k-mers of both strands whose first half belongs to a round, by bucket of that half: (chrom, block, bucket, words, offs). Starts that are found already are in buckets under 0."""
    size, low = -(-2 * k // 8), 2 * (k - k // 2)
    lo, hi = (-(-(x << 32) // rounds) for x in (which, which + 1))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, first, *both, known in _stretches(b, k, tile, per, kind):
                words, offs, hashes = [], [], []
                for x in both:
                    h = (x >> low) * np.int64(0x9E3779B1) & 0xFFFFFFFF
                    at = np.flatnonzero((h >= lo) & (h < hi) & known)
                    words, offs, hashes = [*words, x[at]], [*offs, first[at // tile] + at % tile], [*hashes, h[at]]
                x, o, h = (np.concatenate(v) for v in (words, offs, hashes))
                if not len(x):
                    continue
                order = np.argsort(x)
                x, o, h = x[order], o[order], h[order]
                new = np.concatenate([[True], x[1:] != x[:-1]])
                sure = o[~(new & np.append(new[1:], True))]  # twice in the stretch: found already, and of each only one goes to be compared
                order = np.flatnonzero(new)[np.argsort(h[new])]
                x, o, bucket = x[order], o[order], (h[order] - lo) * buckets // (hi - lo)
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(x)]
                at = list(zip(cuts, cuts[1:]))
                rows = [(int(bucket[s]), _planes(x[s:e], size), _planes(o[s:e], 4)) for s, e in at]
                if len(sure):
                    rows.append((-1 - b.column("block")[i].as_py() % 1024, b"", _planes(sure, 4)))
                row = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([b.column("chrom").take(row), b.column("block").take(row), *(pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary())))], names=["chrom", "block", "bucket", "words", "offs"])

    return f


def _close(words: np.ndarray, k: int, mismatches: int) -> np.ndarray:
    """The numbers, in order, that occur twice or, with a mismatch, differ from another in one letter of the second half."""
    s = np.sort(words)
    same = s[1:] == s[:-1]
    out = [s[1:][same]]
    u = s[np.concatenate([[True], ~same])]
    for low in range(0, 2 * (k - k // 2) * mismatches, 2):
        rest = (1 << low) - 1
        v = np.sort(((u >> low + 2) << low | u & rest) << 2 | u >> low & 3)
        pair = v[1:] >> 2 == v[:-1] >> 2
        hit = np.zeros(len(v), bool)
        hit[1:] |= pair
        hit[:-1] |= pair
        v, c = v[hit] >> 2, v[hit] & 3
        out.append((v >> low) << low + 2 | c << low | v & rest)
    return np.unique(np.concatenate(out))


def _compared(k: int, mismatches: int) -> Callable:
    """Starts (chrom, block, offs) of the k-mers of a bucket that have another near."""
    size = -(-2 * k // 8)

    def f(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            return t.select(["chrom", "block", "offs"])
        words = [_of_planes(x, size) for x in _bytes(t.column("words"), np.uint8)]
        near = _close(np.concatenate(words), k, mismatches)
        rows, offs = [], []
        if len(near):
            for i, x in enumerate(words):
                hit = near[np.minimum(np.searchsorted(near, x), len(near) - 1)] == x
                if hit.any():
                    rows.append(i)
                    offs.append(_planes(_of_planes(_bytes(t.column("offs").slice(i, 1), np.uint8)[0], 4)[hit], 4))
        return t.select(["chrom", "block"]).take(pa.array(rows, pa.int64())).append_column("offs", pa.array(offs, pa.binary()))

    return f


def _starts_to_runs(span: int) -> Callable:
    def f(t: pa.Table) -> pa.Table:
        at = np.unique(np.concatenate([_of_planes(x, 4) for x in _bytes(t.column("offs"), np.uint8)]))
        new = np.flatnonzero(np.diff(at) > 1) + 1
        start = t.column("block")[0].as_py() * span + at
        s, e = start[np.concatenate([[0], new])], start[np.concatenate([new - 1, [len(at) - 1]])] + 1
        return pa.table({"chrom": t.column("chrom").take(pa.array(np.zeros(len(s), np.int64))), "start": pa.array(s), "end": pa.array(e)})

    return f


def repeat_runs(genome: DataFrame, k: int, tile: int, mismatches: int = 0) -> DataFrame:
    """(chrom, start, end): runs of starts of k-mers that :func:`sequence.repeated_kmers` finds, cut at multiples of the length that the column ``span`` has.

    Tiles (chrom, tile_no, seq) of at most ``tile`` letters are packed and shuffled once. k-mers of up to TABLE letters are counted in a table of all there are,
    of which tasks exchange two bits a k-mer. Longer ones, and those with a mismatch, go by their first halves, in rounds that bound what is on disk: of two k-mers that differ
    in one letter, the first halves agree on one of the strands. Other letters than ACGTN, more mismatches and longer k-mers go as rows.
    """
    spark = genome.sparkSession
    ahead = -(-(k - 1) // tile)
    per = max(STRETCH // tile, ahead, 1)
    kind = np.uint16 if per + ahead <= 1 << 16 else np.uint32
    if k <= LONGEST and mismatches <= 1 and (per + ahead) * tile < 1 << 31:
        how = (tile, per, kind)
        name = genome.schema["chrom"].dataType.simpleString()
        schema = f"chrom {name}, block bigint, nos binary, letters binary, unknown binary, odd boolean"
        tiles = genome.select("chrom", F.col("tile_no").cast("bigint").alias("tile_no"), "seq").filter("tile_no is not null and seq is not null")
        parts = tiles.mapInArrow(_packer(tile, per, ahead, kind), schema)
        with _shuffles_deleted(spark):
            whole, seen = materialize_counting(parts.groupBy("chrom", "block").applyInArrow(_gather(per, kind, tile), schema), "stretches", {"odd": F.coalesce(F.max(F.col("odd").cast("int")), F.lit(0)), "letters": F.coalesce(F.sum(F.length("letters") * 4), F.lit(0))})
            if not seen["odd"]:
                runs = f"chrom {name}, start bigint, end bigint"
                if mismatches == 0 and k <= TABLE:
                    bits = whole.mapInArrow(_tally(k, *how), "part int, one binary, two binary").groupBy("part").applyInArrow(_sum, "part int, two binary").collect()
                    out = whole.mapInArrow(_marked(b"".join(bytes(x["two"]) for x in sorted(bits)) or bytes(4**k // 8 + 1), k, *how), runs)
                else:
                    n = 2 * seen["letters"]
                    rounds = max(1, min(ROUNDS, -(-n // ROUND)))
                    buckets = max(1, -(-n // (rounds * BUCKET)))
                    found = []
                    for i in range(rounds):
                        cut = whole.mapInArrow(_halves(i, rounds, buckets, k, *how), f"chrom {name}, block bigint, bucket int, words binary, offs binary")
                        found.append(materialize(cut.groupBy("bucket").applyInArrow(_compared(k, mismatches), f"chrom {name}, block bigint, offs binary"), "starts"))
                    discard(whole)
                    starts = spark.read.schema(found[0].schema).parquet(*[x._strandloom_path for x in found])
                    out = starts.groupBy("chrom", "block").applyInArrow(_starts_to_runs(per * tile), runs)
                return out.withColumn("span", F.lit(per * tile).cast("bigint"))
        discard(whole)
    size = 1_000_000
    rows = S.repeated_kmers(S.kmers(genome, k, tile), mismatches)
    return S.position_runs(rows, size).select("chrom", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(size).cast("bigint").alias("span"))


def repeat_sums(runs: DataFrame) -> DataFrame:
    """(chrom, n_repeated, pos_sum): how many starts the runs have, and the sum of these."""
    return runs.groupBy("chrom").agg(F.sum(F.expr("end - start")).alias("n_repeated"), F.sum(F.expr("(start + end - 1) * (end - start) div 2")).alias("pos_sum"))


def repeat_masks(runs: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """:func:`sequence.repeat_mask` of runs."""
    kept = materialize(runs, "runs")
    return S.strand_masks(S.stitched(kept.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "span"), F.col("span")), k, offset)
