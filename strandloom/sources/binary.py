"""Readers and small writers of binary formats: BAM, bigWig, bigBed, 2bit; as Spark data sources where files split.

Formats are decoded in Python within Arrow batches; each file, or block range of a file, is a partition. Parquet is the native form for
repeated work.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.sources.spans import PART, Bgzf, bai, framed, local_files, region_chunks, split_places

#: Magic numbers of the formats.
BIGWIG, BIGBED, CHROM_TREE, BLOCK_TREE, TWOBIT = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0, 0x1A412743
#: Index blocks of a bigWig or bigBed file that make a partition.
BLOCKS = 256


class Record:
    """A fixed binary layout: names and a struct format."""

    def __init__(self, fmt: str, names: list[str], order: str = "<") -> None:
        self.form, self.struct, self.names = (fmt, names, order), struct.Struct(order + fmt), names

    def __reduce__(self):
        return Record, self.form

    def read(self, fh) -> dict:
        return dict(zip(self.names, self.struct.unpack(fh.read(self.struct.size))))

    def write(self, **values) -> bytes:
        return self.struct.pack(*[values.get(n, 0) for n in self.names])


HEADER = Record("IHHQQQHHQQIQ", ["magic", "version", "zoom_levels", "chrom_tree", "data", "index", "fields", "bed_fields", "autosql", "summary", "buffer", "extension"])
TREE = Record("IIIIQQ", ["magic", "block_size", "key_size", "val_size", "count", "reserved"])
NODE = Record("BBH", ["is_leaf", "reserved", "count"])
INDEX = Record("IIQIIIIQII", ["magic", "block_size", "count", "chrom0", "base0", "chrom1", "base1", "end", "per_slot", "reserved"])
LEAF = Record("IIIIQQ", ["chrom0", "base0", "chrom1", "base1", "offset", "size"])
BRANCH = Record("IIIIQ", ["chrom0", "base0", "chrom1", "base1", "offset"])
SUMMARY = Record("Qdddd", ["bases", "least", "greatest", "total", "squares"])
EXTENSION = Record("HHQ48x", ["size", "indexes", "list"])
EXTRA_INDEX = Record("HHQIHH", ["kind", "fields", "offset", "reserved", "field", "reserved2"])
SECTION = Record("IIIIIBBH", ["chrom", "start", "end", "step", "span", "kind", "reserved", "count"])


def _chroms(fh, at: int) -> dict[int, tuple[str, int]]:
    fh.seek(at)
    t = TREE.read(fh)
    if t["magic"] != CHROM_TREE:
        raise ValueError("no chromosome tree")
    out, todo = {}, [fh.tell()]
    while todo:
        fh.seek(todo.pop())
        n = NODE.read(fh)
        for _ in range(n["count"]):
            key = fh.read(t["key_size"]).rstrip(b"\0").decode()
            if n["is_leaf"]:
                i, size = struct.unpack("<II", fh.read(8))
                out[i] = (key, size)
            else:
                todo.append(struct.unpack("<Q", fh.read(8))[0])
    return out


def _blocks(fh, at: int, want: tuple[int, int, int] | None) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks, of those that meet (chrom id, start, end) only."""
    fh.seek(at)
    if INDEX.read(fh)["magic"] != BLOCK_TREE:
        raise ValueError("no block index")
    out, todo = [], [fh.tell()]
    while todo:
        fh.seek(todo.pop())
        n = NODE.read(fh)
        for _ in range(n["count"]):
            x = (LEAF if n["is_leaf"] else BRANCH).read(fh)
            if want and not ((x["chrom0"], x["base0"]) < (want[0], want[2]) and (want[0], want[1]) < (x["chrom1"], x["base1"])):
                continue
            if n["is_leaf"]:
                out.append((x["offset"], x["size"]))
            else:
                todo.append(x["offset"])
    return sorted(out)


def _extra_indexes(fh, h: dict) -> dict[int, int]:
    """Offsets of the search trees of a bigBed file, by number of the field."""
    if not h["extension"]:
        return {}
    fh.seek(h["extension"])
    x = EXTENSION.read(fh)
    fh.seek(x["list"])
    return {e["field"]: e["offset"] for e in [EXTRA_INDEX.read(fh) for _ in range(x["indexes"])]}


def _search_tree(fh, at: int, key: bytes) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks that a search tree has for a key."""
    fh.seek(at)
    t = TREE.read(fh)
    if t["magic"] != CHROM_TREE:
        raise ValueError("no search tree")
    key, out, todo = key.ljust(t["key_size"], b"\0"), [], [fh.tell()]
    while todo:
        fh.seek(todo.pop())
        n = NODE.read(fh)
        if n["is_leaf"]:
            for _ in range(n["count"]):
                k, v = fh.read(t["key_size"]), fh.read(16)
                if k == key:
                    out.append(struct.unpack("<QQ", v))
        else:
            items = [(fh.read(t["key_size"]), *struct.unpack("<Q", fh.read(8))) for _ in range(n["count"])]
            # A child holds keys from its own up to the next one's, which equal keys may go on past.
            todo += [c for (k, c), nxt in zip(items, [*items[1:], None]) if k <= key and (nxt is None or nxt[0] >= key)]
    return sorted(set(out))


def search_bigbed(spark: SparkSession, path: str, field: str, values: list[str]) -> DataFrame:
    """The records of a bigBed file whose ``field`` is one of ``values``, through the field's search tree; a field without one is an error.

    Result: chrom, start, end, rest. Only the blocks that the tree names are read; values are spread over tasks.
    """
    from strandloom.sources.text import parse_autosql

    info = ucsc_info(path)
    if field not in info.get("indexed_fields", []):
        raise ValueError(f"{field!r} is not indexed in {path}; indexed are {info.get('indexed_fields', [])}")
    i = [c for c, _, _ in parse_autosql(info["autosql"])[1]].index(field)
    fields = [("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rest", pa.string())]

    def found(value: str) -> Iterator[tuple]:
        with open(path, "rb") as fh:
            h = HEADER.read(fh)
            chroms = _chroms(fh, h["chrom_tree"])
            for offset, size in _search_tree(fh, _extra_indexes(fh, h)[i], value.encode()):
                fh.seek(offset)
                data = fh.read(size)
                for x in _bed_items(zlib.decompress(data) if h["buffer"] else data, chroms):
                    if i >= 3 and x[3].split("\t")[i - 3 : i - 2] == [value] or i == 0 and x[0] == value:
                        yield x

    def f(batches):
        for b in batches:
            for v in b.column(0).to_pylist():
                yield from framed(found(v), fields)

    return spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "v string").mapInArrow(f, "chrom string, start bigint, end bigint, rest string")


def ucsc_info(path: str) -> dict:
    """Header, chromosomes, autoSql, number of records and fields with a search tree of a bigWig or bigBed file."""
    from strandloom.sources.text import parse_autosql

    with open(path, "rb") as fh:
        h = HEADER.read(fh)
        if h["magic"] not in (BIGWIG, BIGBED):
            raise ValueError(f"{path} is neither bigWig nor bigBed")
        out = {"kind": "bigwig" if h["magic"] == BIGWIG else "bigbed", "chroms": dict(_chroms(fh, h["chrom_tree"]).values()), "bed_fields": h["bed_fields"], "extension_fields": h["fields"] - h["bed_fields"], "zoom_levels": h["zoom_levels"]}
        if h["autosql"]:
            fh.seek(h["autosql"])
            out["autosql"] = fh.read(1 << 16).split(b"\0", 1)[0].decode()
        if h["summary"]:
            fh.seek(h["summary"])
            out["summary"] = SUMMARY.read(fh)
        if out["kind"] == "bigbed":
            fh.seek(h["data"])
            out["records"] = struct.unpack("<Q", fh.read(8))[0]
            extra = sorted(_extra_indexes(fh, h))
            names = [c for c, _, _ in parse_autosql(out["autosql"])[1]] if extra and out.get("autosql") else []
            out["indexed_fields"] = [names[i] if i < len(names) else str(i) for i in extra]
    return out


def _wig_items(data: bytes, chroms) -> Iterator[tuple[str, int, int, float]]:
    s = dict(zip(SECTION.names, SECTION.struct.unpack_from(data)))
    chrom, at = chroms[s["chrom"]][0], SECTION.struct.size
    for i in range(s["count"]):
        if s["kind"] == 1:
            a, b, v = struct.unpack_from("<IIf", data, at + 12 * i)
        elif s["kind"] == 2:
            a, v = struct.unpack_from("<If", data, at + 8 * i)
            b = a + s["span"]
        else:
            (v,) = struct.unpack_from("<f", data, at + 4 * i)
            a = s["start"] + s["step"] * i
            b = a + s["span"]
        yield chrom, a, b, v


def _bed_items(data: bytes, chroms) -> Iterator[tuple[str, int, int, str]]:
    at = 0
    while at < len(data):
        c, a, b = struct.unpack_from("<III", data, at)
        end = data.index(b"\0", at + 12)
        yield chroms[c][0], a, b, data[at + 12 : end].decode()
        at = end + 1


class _Range(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]]) -> None:
        self.path, self.blocks = path, blocks


class _UcscReader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.options, self.kind = options, kind
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def _regions(self) -> list[list] | None:
        """[chrom, start, end, strand or None] of each region asked for; None for all."""
        o = self.options
        if "regions" in o:
            return [[*r, None][:4] for r in json.loads(o["regions"])]
        return [[o["chrom"], int(o.get("start", 0)), int(o.get("end", 1 << 32)), o.get("strand")]] if "chrom" in o else None

    def _want(self, chroms) -> list[tuple[int, int, int]] | None:
        ids = {n: i for i, (n, _) in chroms.items()}
        regions = self._regions()
        return None if regions is None else [(ids.get(c, -1), a, b) for c, a, b, _ in regions]

    def partitions(self):
        out = []
        for p in self.paths:
            with open(p, "rb") as fh:
                h = HEADER.read(fh)
                if h["magic"] != (BIGWIG if self.kind == "bigwig" else BIGBED):
                    raise ValueError(f"{p} is no {self.kind} file")
                want = self._want(_chroms(fh, h["chrom_tree"]))
                b = sorted({x for w in ([None] if want is None else want) for x in _blocks(fh, h["index"], w)})
            out += [_Range(p, b[i : i + BLOCKS]) for i in range(0, len(b), BLOCKS)]
        return out or [_Range("", [])]

    def read(self, part):
        if not part.blocks:
            return
        with open(part.path, "rb") as fh:
            h = HEADER.read(fh)
            chroms = _chroms(fh, h["chrom_tree"])
            regions = self._regions()
            meets = lambda x: any(x[0] == c and x[1] < b and a < x[2] and (s in (None, ".") or self.kind == "bigwig" or (x[3].split("\t") + ["."] * 3)[2] in (s, ".")) for c, a, b, s in regions)
            for offset, size in part.blocks:
                fh.seek(offset)
                data = fh.read(size)
                if h["buffer"]:
                    data = zlib.decompress(data)
                for x in (_wig_items if self.kind == "bigwig" else _bed_items)(data, chroms):
                    if regions is None or meets(x):
                        yield x


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").load(path)``: chrom, start, end, value. Options chrom, start, end read only the blocks that they meet."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start bigint, end bigint, value float"

    def reader(self, schema):
        return _UcscReader(dict(self.options), "bigwig")


class BigBedSource(DataSource):
    """``spark.read.format("bigbed").load(path)``: chrom, start, end, rest (tab-separated further fields).

    Options chrom, start, end, strand give one region, ``regions`` several as JSON ``[[chrom, start, end, strand], ...]``; only the blocks that they meet are
    read, and a record that meets several comes out once. Records on ``.`` meet either strand.
    """

    @classmethod
    def name(cls) -> str:
        return "bigbed"

    def schema(self) -> str:
        return "chrom string, start bigint, end bigint, rest string"

    def reader(self, schema):
        return _UcscReader(dict(self.options), "bigbed")


def bam_header(fh: Bgzf) -> list[str]:
    """Names of the references; fh stands at the first record after it."""
    if fh.read(4) != b"BAM\1":
        raise ValueError("no BAM data")
    (n,) = struct.unpack("<i", fh.read(4))
    fh.read(n)
    (refs,) = struct.unpack("<i", fh.read(4))
    names = []
    for _ in range(refs):
        (k,) = struct.unpack("<i", fh.read(4))
        names.append(fh.read(k)[:-1].decode())
        fh.read(4)
    return names


def bam_records(fh: Bgzf, names: list[str], stop: int) -> Iterator[tuple]:
    """(read_id, flag, chrom, strand, start, mapq, blocks, rlen, seq_length) of the records before the place ``stop``; unmapped reads have no chrom."""
    while fh.tell() < stop:
        raw = fh.read(4)
        if len(raw) < 4:
            return
        data = fh.read(struct.unpack("<i", raw)[0])
        ref, pos, name_len, mapq, _, cigars, flag, seq_len = struct.unpack_from("<iiBBHHHi", data)
        name = data[32 : 32 + name_len - 1].decode()
        p, blocks = pos, []
        for v in struct.unpack_from(f"<{cigars}I", data, 32 + name_len):
            op, k = v & 15, v >> 4
            if op in (0, 7, 8):
                if blocks and blocks[-1][1] == p:
                    blocks[-1] = (blocks[-1][0], p + k)
                else:
                    blocks.append((p, p + k))
                p += k
            elif op in (2, 3):
                p += k
        mapped = ref >= 0 and not flag & 4
        yield name, flag, names[ref] if mapped else None, "-" if flag & 16 else "+", pos if mapped else None, mapq, blocks, sum(b - a for a, b in blocks), seq_len


def read_bam(spark: SparkSession, paths: str | list[str], chrom: str | None = None, start: int = 0, end: int = 1 << 29, part: int = PART) -> DataFrame:
    """Mapped reads of BAM files in the form that mapping rules take (blocks, rlen), with flag and mapq; with ``chrom``, those with an aligned position in [start, end).

    A file with its ``.bai`` beside it is read in parts that begin where the index knows a record to begin, of a region only the blocks that the index
    names; a file without is one task, which holds one block at a time. Files must be of a mounted file system.
    """
    schema = "read_id string, flag int, chrom string, strand string, start bigint, mapq int, blocks array<struct<start:bigint,end:bigint>>, rlen int, seq_length int"
    cols = ["read_id", "flag", "chrom", "strand", "start", "mapq", "blocks", "rlen", "seq_length"]
    files = local_files(spark, paths)
    if files is None:
        raise ValueError("BAM files must be of a file system that the tasks can open")
    plan = []
    for path, size in files:
        if path.endswith(".bai"):
            continue
        fh = Bgzf(path)
        names = bam_header(fh)
        first = fh.tell()
        index = next((bai(p) for p in (f"{path}.bai", path.removesuffix(".bam") + ".bai") if os.path.isfile(p)), None)
        if chrom is not None and chrom not in names:
            continue
        if index is None:
            ranges = [(first, size << 16)]
        elif chrom is None:
            ranges = split_places(index, first, size, part)
        else:
            ranges = region_chunks(index[names.index(chrom)], start, min(end, 1 << 29))
        plan += [(path, a, b) for a, b in ranges]
    if not plan:
        return spark.createDataFrame([], schema)

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int32(), pa.int32()]

    def reads(path: str, a: int, b: int) -> Iterator[tuple]:
        for r in bam_records(Bgzf(path, a), bam_header(Bgzf(path)), b):
            if r[2] is not None and (chrom is None or r[2] == chrom and any(x < end and start < y for x, y in r[6])):
                yield (*r[:6], [{"start": x, "end": y} for x, y in r[6]], *r[7:])

    def parse(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from framed(reads(r["path"], r["begin"], r["stop"]), list(zip(cols, kinds)))

    return spark.createDataFrame(plan, "path string, begin bigint, stop bigint").repartition(len(plan), "path", "begin").mapInArrow(parse, schema)


def twobit_records(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, seq) of a 2bit file; masked bases in lower case, unknown ones N."""
    order = "<" if struct.unpack_from("<I", data)[0] == TWOBIT else ">"
    magic, _, count, _ = struct.unpack_from(order + "IIII", data)
    if magic != TWOBIT:
        raise ValueError("no 2bit data")
    at = 16
    for _ in range(count):
        k = data[at]
        name = data[at + 1 : at + 1 + k].decode()
        (p,) = struct.unpack_from(order + "I", data, at + 1 + k)
        at += 5 + k

        def table(p):
            (n,) = struct.unpack_from(order + "I", data, p)
            v = struct.unpack_from(f"{order}{2 * n}I", data, p + 4)
            return list(zip(v[:n], v[n:])), p + 4 + 8 * n

        (size,) = struct.unpack_from(order + "I", data, p)
        unknown, p = table(p + 4)
        masked, p = table(p)
        p += 4
        packed = data[p : p + (size + 3) // 4]
        s = bytearray("".join("TCAG"[b >> i & 3] for b in packed for i in (6, 4, 2, 0))[:size], "ascii")
        for a, n in unknown:
            s[a : a + n] = b"N" * n
        for a, n in masked:
            s[a : a + n] = bytes(s[a : a + n]).lower()
        yield name, s.decode()


def read_twobit(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq) of 2bit files."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                for n, s in twobit_records(bytes(raw)):
                    yield pd.DataFrame([(n, s)], columns=["name", "seq"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(parse, "name string, seq string")


def register(spark: SparkSession) -> None:
    """Makes the formats ``bigwig`` and ``bigbed`` known to the session."""
    spark.dataSource.register(BigWigSource)
    spark.dataSource.register(BigBedSource)


def write_ucsc(path: str, kind: str, chroms: dict[str, int], items: list[tuple], per_block: int = 512, autosql: str = "", indexed: list[str] | None = None) -> None:
    """A small bigWig (chrom, start, end, value) or bigBed (chrom, start, end, rest) file from sorted items: one index level. ``indexed`` fields of a bigBed file, by their autoSql names, get a search tree."""
    from strandloom.sources.text import parse_autosql

    ids = {n: i for i, n in enumerate(sorted(chroms))}
    key = max(map(len, chroms), default=1)
    blocks, rests, places = [], [], []
    by_chrom = sorted(items, key=lambda x: (ids[x[0]], x[1]))
    i = 0
    while i < len(by_chrom):
        part = [x for x in by_chrom[i : i + per_block] if x[0] == by_chrom[i][0]]
        c = ids[part[0][0]]
        if kind == "bigwig":
            data = SECTION.write(chrom=c, start=part[0][1], end=part[-1][2], step=0, span=0, kind=1, reserved=0, count=len(part)) + b"".join(struct.pack("<IIf", *x[1:]) for x in part)
        else:
            data = b"".join(struct.pack("<III", c, x[1], x[2]) + x[3].encode() + b"\0" for x in part)
        blocks.append((c, part[0][1], max(x[2] for x in part), zlib.compress(data), len(data)))
        rests.append([x[3] for x in part])
        i += len(part)
    head, sql = HEADER.struct.size, autosql.encode() + b"\0" if autosql else b""
    tree_at = head + len(sql) + SUMMARY.struct.size
    tree = TREE.write(magic=CHROM_TREE, block_size=max(1, len(ids)), key_size=key, val_size=8, count=len(ids), reserved=0) + NODE.write(is_leaf=1, reserved=0, count=len(ids)) + b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", j, chroms[n]) for n, j in ids.items())
    data_at = tree_at + len(tree)
    body, at, leaves = struct.pack("<Q", len(items)), data_at + 8, b""
    if kind == "bigwig":
        body, at = struct.pack("<I", len(blocks)), data_at + 4
    for c, a, b, z, _ in blocks:
        leaves += LEAF.write(chrom0=c, base0=a, chrom1=c, base1=b, offset=at, size=len(z))
        places.append((at, len(z)))
        body += z
        at += len(z)
    last = blocks[-1] if blocks else (0, 0, 0, b"", 0)
    index = INDEX.write(magic=BLOCK_TREE, block_size=max(1, len(blocks)), count=len(blocks), chrom0=0, base0=0, chrom1=last[0], base1=last[2], end=at, per_slot=per_block, reserved=0) + NODE.write(is_leaf=1, reserved=0, count=len(blocks)) + leaves
    extra, extension = b"", 0
    if indexed:
        names = [c for c, _, _ in parse_autosql(autosql)[1]]
        extension = at + len(index)
        tree_at2 = extension + EXTENSION.struct.size + len(indexed) * EXTRA_INDEX.struct.size
        listed, trees = b"", b""
        for name in indexed:
            i = names.index(name)
            keys = sorted({(r.split("\t")[i - 3].encode(), p) for rs, p in zip(rests, places) for r in rs})
            size = max(len(k) for k, _ in keys)
            listed += EXTRA_INDEX.write(fields=1, offset=tree_at2 + len(trees), field=i)
            trees += TREE.write(magic=CHROM_TREE, block_size=len(keys), key_size=size, val_size=16, count=len(keys)) + NODE.write(is_leaf=1, count=len(keys)) + b"".join(k.ljust(size, b"\0") + struct.pack("<QQ", *p) for k, p in keys)
        extra = EXTENSION.write(size=EXTENSION.struct.size, indexes=len(indexed), list=extension + EXTENSION.struct.size) + listed + trees
    w = [(x[2] - x[1], x[3]) for x in items] if kind == "bigwig" else []
    summary = SUMMARY.write(bases=sum(n for n, _ in w), least=min((v for _, v in w), default=0.0), greatest=max((v for _, v in w), default=0.0), total=float(sum(n * v for n, v in w)), squares=float(sum(n * v * v for n, v in w)))
    n_fields = 3 + (items[0][3].count("\t") + 1 if kind == "bigbed" and items and items[0][3] else 0)
    h = HEADER.write(magic=BIGWIG if kind == "bigwig" else BIGBED, version=4, zoom_levels=0, chrom_tree=tree_at, data=data_at, index=at, fields=n_fields if kind == "bigbed" else 0, bed_fields=min(n_fields, 12) if kind == "bigbed" else 0, autosql=head if sql else 0, summary=head + len(sql), buffer=max((b[4] for b in blocks), default=1), extension=extension)
    with open(path, "wb") as fh:
        fh.write(h + sql + summary + tree + body + index + extra)
