"""Large files read in parts: byte ranges of text files, and block ranges of BGZF files with an index.

A file of a mounted file system is opened by every task at its own part; planning reads the list of files and, of indexed files, the index.
Files that tasks cannot open, and compressed text, are read whole, one file a task.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that make a part.
PART = 64 << 20
#: Bytes before a part from which records that cross its border are told from those that begin in it.
BEFORE = 1 << 16
_PLAN = "path string, begin bigint, stop bigint"


def local_files(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]] | None:
    """(path, length) of the files, if all of them are of a mounted file system and uncompressed; else None. One row per file passes the driver."""
    rows = spark.read.format("binaryFile").load(paths).select("path", "length").collect()
    out = [(unquote(r["path"].removeprefix("file:").replace("///", "/", 1)), r["length"]) for r in rows if r["path"].startswith("file:")]
    return out if len(out) == len(rows) and all(os.path.isfile(p) and not p.endswith((".gz", ".bz2", ".zst", ".zip")) for p, _ in out) else None


def parts(spark: SparkSession, files: list[tuple[str, int]], part: int = PART) -> DataFrame:
    """(path, begin, stop): one row, and one task, per byte range."""
    rows = [(p, a, min(a + part, n)) for p, n in files for a in range(0, n, part)]
    return spark.createDataFrame(rows, _PLAN).repartition(max(1, len(rows)), "path", "begin") if rows else spark.createDataFrame([], _PLAN)


def framed(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded size."""
    schema = pa.schema(fields)
    while held := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def lines_of(path: str, begin: int, stop: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin in [begin, stop), without their ends."""
    with open(path, "rb") as fh:
        if begin:
            fh.seek(begin - 1)
            fh.readline()
        while (at := fh.tell()) < stop and (raw := fh.readline()):
            yield at, raw.decode("utf-8", "replace").rstrip("\r\n")


# FASTQ.
def fastq_records(fh: BinaryIO, begin: int = 0, stop: int = 1 << 62) -> Iterator[tuple[str | None, str | None, str | None, str | None]]:
    """(name, seq, qual, None) of the records that begin in the range, (None, None, None, line) for lines that are part of none.

    A record is a line with ``@``, its sequence, a line with ``+`` and as many qualities; as a quality may begin with ``@``, the four are looked at together.
    """
    # Lines at the start of a part may belong to a record of the part before, so reading begins before it.
    if begin > BEFORE:
        fh.seek(begin - BEFORE)
        fh.readline()
    held: list[tuple[int, str]] = []
    while True:
        while len(held) < 4:
            at, raw = fh.tell(), fh.readline()
            if not raw:
                break
            line = raw.decode("ascii", "replace").rstrip("\r\n")
            if line or held:
                held.append((at, line))
        if not held or held[0][0] >= stop:
            return
        mine = held[0][0] >= begin
        if len(held) == 4 and held[0][1].startswith("@") and held[2][1].startswith("+") and len(held[1][1]) == len(held[3][1]):
            if mine:
                yield (held[0][1][1:].split() or [""])[0], held[1][1], held[3][1], None
            held.clear()
        else:
            line = held.pop(0)[1]
            if mine and line:
                yield None, None, None, line


# wiggle.
def wiggle_head(path: str, begin: int, stop: int) -> tuple[str | None, int]:
    """(the last declaration in a part or None, fixed-step data lines after it)."""
    head, n = None, 0
    for _, line in lines_of(path, begin, stop):
        x = line.split()
        if x and x[0] in ("variableStep", "fixedStep"):
            head, n = line, 0
        elif len(x) == 1:
            n += 1
    return head, n


def wiggle_rows(lines: Iterator[str], head: str | None, done: int) -> Iterator[tuple]:
    """(chrom, start, end, value, None), or (None, None, None, None, line) for a line that is no data of the declared form; ``done`` data lines of ``head`` came before."""
    decl = dict(p.split("=", 1) for p in head.split()[1:] if "=" in p) | {"kind": head.split()[0]} if head else None
    at = int(decl.get("start", 1)) + done * int(decl.get("step", 1)) if decl and decl["kind"] == "fixedStep" else 0
    for line in lines:
        x = line.split()
        if not x or x[0] in ("track", "browser") or x[0].startswith("#"):
            continue
        try:
            if x[0] in ("variableStep", "fixedStep"):
                decl = dict(p.split("=", 1) for p in x[1:]) | {"kind": x[0]}
                at = int(decl.get("start", 1))
                int(decl.get("span", 1)), int(decl.get("step", 1)), decl["chrom"]
            elif len(x) == 4:
                yield x[0], int(x[1]), int(x[2]), float(x[3]), None
            elif decl and decl["kind"] == "variableStep" and len(x) == 2:
                p = int(x[0]) - 1
                yield decl["chrom"], p, p + int(decl.get("span", 1)), float(x[1]), None
            elif decl and decl["kind"] == "fixedStep" and len(x) == 1:
                value = float(x[0])
                yield decl["chrom"], at - 1, at - 1 + int(decl.get("span", 1)), value, None
                at += int(decl.get("step", 1))
            else:
                yield None, None, None, None, line
        except (ValueError, KeyError):
            if decl and decl["kind"] == "fixedStep" and len(x) == 1:
                at += int(decl.get("step", 1))
            yield None, None, None, None, line


# BGZF with an index.
class Bgzf:
    """Reads of a block-compressed file from virtual places (compressed offset << 16 | place in the block); one block is held at a time."""

    def __init__(self, path: str, at: int = 0) -> None:
        self.fh = open(path, "rb")
        self.block, self.data, self.pos = at >> 16, b"", at & 0xFFFF
        self.next = self.block
        self._load()

    def _load(self) -> bool:
        self.block = self.next
        self.fh.seek(self.block)
        head = self.fh.read(18)
        if len(head) < 18:
            self.data = b""
            return False
        size = struct.unpack_from("<H", head, 16)[0] + 1
        raw = head + self.fh.read(size - 18)
        self.data = zlib.decompress(memoryview(raw)[18:-8], -15)
        self.next = self.block + size
        return True

    def tell(self) -> int:
        while self.pos >= len(self.data):
            self.pos -= len(self.data)
            if not self._load():
                self.pos = 0
                break
        return self.block << 16 | self.pos

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.pos >= len(self.data):
                self.pos -= len(self.data)
                if not self._load():
                    break
                continue
            piece = self.data[self.pos : self.pos + n]
            out.append(piece)
            self.pos += len(piece)
            n -= len(piece)
        return b"".join(out)

    def readline(self) -> bytes:
        out = []
        while True:
            if self.pos >= len(self.data):
                self.pos -= len(self.data)
                if not self._load():
                    break
                continue
            end = self.data.find(b"\n", self.pos)
            out.append(self.data[self.pos : end + 1 if end >= 0 else len(self.data)])
            self.pos += len(out[-1])
            if end >= 0:
                break
        return b"".join(out)


def _bins(data: bytes, at: int, refs: int) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Per reference: chunks by bin, and least places by window of 2^14."""
    out = []
    for _ in range(refs):
        bins = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            b, k = struct.unpack_from("<Ii", data, at)
            v = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            if b < 37450:  # the one above holds counts, not places
                bins[b] = list(zip(v[::2], v[1::2]))
            at += 8 + 16 * k
        (n,) = struct.unpack_from("<i", data, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def bai(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    with open(path, "rb") as fh:
        data = fh.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is no BAM index")
    return _bins(data, 8, struct.unpack_from("<i", data, 4)[0])


def tabix_index(path: str) -> tuple[dict, list[tuple[dict[int, list[tuple[int, int]]], list[int]]]]:
    """(columns, names and comment sign; bins) of a .tbi file."""
    data = b""
    fh = Bgzf(path)
    while piece := fh.read(1 << 20):
        data += piece
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path} is no tabix index")
    refs, form, seq, begin, end, meta, skip, n = struct.unpack_from("<8i", data, 4)
    names = data[36 : 36 + n].split(b"\0")[:-1]
    return {"names": [x.decode() for x in names], "zero_based": bool(form & 0x10000), "seq": seq, "begin": begin, "end": end, "meta": chr(meta), "skip": skip}, _bins(data, 36 + n, refs)


def region_chunks(index: tuple[dict[int, list[tuple[int, int]]], list[int]], begin: int, end: int) -> list[tuple[int, int]]:
    """The places to read for [begin, end): chunks of every bin that may hold such features, those before the window's least place left out, merged."""
    bins, linear = index
    least = linear[min(begin >> 14, len(linear) - 1)] if linear else 0
    found = []
    for shift, first in ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        for b in range(first + (begin >> shift), first + ((end - 1) >> shift) + 1):
            found += [c for c in bins.get(b, []) if c[1] > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        a = max(a, least)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def split_places(index: list[tuple[dict[int, list[tuple[int, int]]], list[int]]], first: int, size: int, part: int = PART) -> list[tuple[int, int]]:
    """Ranges of places that cover a whole file, cut where the index knows a record to begin, of about ``part`` compressed bytes."""
    cuts, last = [first], first >> 16
    for v in sorted({v for _, linear in index for v in linear if v > first}):
        if (v >> 16) - last >= part:
            cuts.append(v)
            last = v >> 16
    return list(zip(cuts, [*cuts[1:], size << 16]))


def read_tabix(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, part: int = PART) -> DataFrame:
    """(line) of a BGZF text file with its ``.tbi`` beside it: all lines in parts, or those whose features meet one of ``regions`` (chrom, start, end; 0-based, half-open), each once.

    Only the blocks that the index names for the regions are read; overlapping regions share them.
    """
    head, index = tabix_index(path + ".tbi")
    ids = {n: i for i, n in enumerate(head["names"])}
    wanted: dict[str, list[tuple[int, int]]] = {}
    if regions is None:
        plan = split_places(index, 0, os.path.getsize(path), part)
    else:
        chunks = []
        for c, a, b in regions:
            if c in ids and b > a:
                wanted.setdefault(c, []).append((a, b))
                chunks += region_chunks(index[ids[c]], a, b)
        plan = []
        for a, b in sorted(chunks):
            if plan and a <= plan[-1][1]:
                plan[-1] = (plan[-1][0], max(plan[-1][1], b))
            else:
                plan.append((a, b))
    if not plan:
        return spark.createDataFrame([], "line string")
    rows = spark.createDataFrame([(path, a, b) for a, b in plan], _PLAN).repartition(len(plan), "begin")
    every = regions is None

    def lines(p: str, a: int, b: int) -> Iterator[tuple[str]]:
        fh, skip = Bgzf(p, a), head["skip"] if a == 0 else 0
        while fh.tell() < b and (raw := fh.readline()):
            line = raw.decode("utf-8", "replace").rstrip("\r\n")
            if skip or not line or line.startswith(head["meta"]):
                skip = max(skip - 1, 0)
                continue
            if not every:
                f = line.split("\t")
                s = int(f[head["begin"] - 1]) - (0 if head["zero_based"] else 1)
                e = int(f[head["end"] - 1]) if head["end"] else s + 1
                if not any(x < e and s < y for x, y in wanted.get(f[head["seq"] - 1], [])):
                    continue
            yield (line,)

    def parse(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from framed(lines(r["path"], r["begin"], r["stop"]), [("line", pa.string())])

    return rows.mapInArrow(parse, "line string")
