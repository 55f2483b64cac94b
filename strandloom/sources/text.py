"""Readers of the text formats of genomics. Coordinates become 0-based and half-open; compressed files are read as they are.

Rows that do not parse come back as a second DataFrame ``(line, reason)``; nothing is dropped silently.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.annotation import gff3_parents, parse_gff3_attributes, parse_gtf_attributes
from strandloom.sources import spans

#: Further columns of BED subtypes, with their types.
BED_SUBTYPES = {
    "bedDetail": (("ID", "string"), ("description", "string")),
    "narrowPeak": (("signalValue", "double"), ("pValue", "double"), ("qValue", "double"), ("peak", "int")),
    "broadPeak": (("signalValue", "double"), ("pValue", "double"), ("qValue", "double")),
    "gappedPeak": (("signalValue", "double"), ("pValue", "double"), ("qValue", "double")),
    "tagAlign": (("sequence", "string"), ("score", "double"), ("strand", "string")),
    "pairedTagAlign": (("seq1", "string"), ("seq2", "string")),
    "peptideMapping": (("rawScore", "double"), ("spectrumId", "string"), ("peptideRank", "int"), ("peptideRepeatCount", "int")),
}


def _zipped(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines (value) of the members of zip files, which are read whole, one a task."""

    def members(raw: bytes) -> Iterator[tuple[str]]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in z.namelist():
                for line in io.TextIOWrapper(z.open(name), "utf-8", "replace", newline="\n"):
                    yield (line.rstrip("\n"),)

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield from spans.framed(members(raw), [("value", pa.string())])

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(parse, "value string")


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank lines, without carriage returns at their ends. Compressed files are known by their names; zip files give the lines of all members."""
    each = [paths] if isinstance(paths, str) else list(paths)
    zips, rest = [p for p in each if p.endswith(".zip")], [p for p in each if not p.endswith(".zip")]
    raw = spark.read.text(rest) if rest else None
    if zips:
        raw = _zipped(spark, zips) if raw is None else raw.select("value").unionByName(_zipped(spark, zips))
    return raw.select(F.regexp_replace("value", r"\r$", "").alias("line")).filter(F.trim("line") != "")


def _fields(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.withColumn("f", F.split("line", sep))


def _f(i: int) -> Column:
    return F.get(F.col("f"), F.lit(i))


def _ints(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("bigint"))


def read_bed(spark: SparkSession, paths: str | list[str], extra: int | list[str] | list[tuple[str, str]] = 0, subtype: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of BED3 to BED12, with further columns.

    ``extra``: a number (columns ``custom0`` ...), names, or (name, type) pairs; ``subtype`` names one of :data:`BED_SUBTYPES`. A further value that
    does not fit its type is null in the typed column and kept as text in ``attr``. Missing columns take their defaults: ID from the position, NaN score,
    strand ``.``, thick bounds at the start, black, one block. ``browser``, ``track`` and ``#`` lines are skipped.
    """
    if subtype:
        extra = list(BED_SUBTYPES[subtype])
    if isinstance(extra, int):
        extra = [f"custom{i}" for i in range(extra)]
    typed = [(e, "string") if isinstance(e, str) else e for e in extra]
    lines = text_lines(spark, paths).filter(~F.col("line").rlike(r"^(browser|track|#)"))
    df = _fields(lines).withColumn("n", F.size("f") - len(typed))
    df = df.withColumn("s", _f(1).try_cast("bigint")).withColumn("e", _f(2).try_cast("bigint"))
    standard = lambda i, c: F.when(F.col("n") > i, c)
    sizes, starts = standard(10, _ints(_f(10))), standard(11, _ints(_f(11)))
    blocks = F.zip_with(sizes, starts, lambda a, b: C.segment(F.col("s") + b, F.col("s") + b + a))
    broken = F.coalesce(F.size(sizes) != F.size(starts), F.lit(False)) | F.coalesce(F.exists(blocks, lambda b: b["start"].isNull() | b["end"].isNull()), F.lit(False))
    reason = F.when(F.col("n") < 3, "fewer than 3 columns").when(F.col("s").isNull() | F.col("e").isNull(), "bounds are no numbers").when(F.col("e") < F.col("s"), "end before start").when((F.col("n") > 11) & broken, "blocks do not parse")
    df = df.withColumn("reason", reason)
    strand = F.coalesce(standard(5, F.when(_f(5).isin("+", "-", "."), _f(5))), F.lit("."))
    own = F.concat(_f(0), F.lit(":"), F.col("s"), F.lit("-"), F.col("e"), F.lit("("), strand, F.lit(")"))
    ts, te = standard(6, _f(6).try_cast("bigint")), standard(7, _f(7).try_cast("bigint"))
    coding = ts.isNotNull() & te.isNotNull() & (ts >= 0) & (te > ts)
    rgb = F.transform(F.split(F.coalesce(standard(8, _f(8)), F.lit("0,0,0")), ","), lambda x: F.lpad(F.lower(F.hex(F.trim(x).try_cast("int"))), 2, "0"))
    color = F.when((F.size(rgb) == 3) & ~F.exists(rgb, lambda x: x.isNull()), F.concat(F.lit("#"), F.array_join(rgb, ""))).otherwise("#000000")
    more = [_f_at(F.col("n") + i).try_cast(t).alias(n) for i, (n, t) in enumerate(typed)]
    attr = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in typed]), F.array(*[_f_at(F.col("n") + i) for i in range(len(typed))])) if typed else F.expr("cast(map() as map<string,string>)")
    names = {n for n, _ in typed}
    base = {
        "chrom": _f(0),
        "start": F.col("s"),
        "end": F.col("e"),
        "strand": strand,
        "ID": F.coalesce(standard(3, _f(3)), own),
        "score": F.coalesce(standard(4, _f(4).try_cast("double")), F.lit(float("nan"))),
        "thick_start": F.when(coding, ts).otherwise(F.col("s")),
        "thick_end": F.when(coding, te).otherwise(F.col("s")),
        "color": color,
        "segments": F.coalesce(F.when(F.col("n") > 11, C.merge_segments(blocks)), F.array(C.segment("s", "e"))),
    }
    ok = df.filter("reason is null").select(*[c.alias(n) for n, c in base.items() if n not in names], *more, attr.alias("attr"))
    return ok, df.filter("reason is not null").select("line", "reason")


def _f_at(i: Column) -> Column:
    return F.get(F.col("f"), i)


def _gff(spark: SparkSession, paths, attributes) -> tuple[DataFrame, DataFrame]:
    lines = text_lines(spark, paths).filter(~F.col("line").startswith("#"))
    df = _fields(lines).withColumn("s", _f(3).try_cast("bigint") - 1).withColumn("e", _f(4).try_cast("bigint"))
    reason = F.when(F.size("f") < 9, "fewer than 9 columns").when(F.col("s").isNull() | F.col("e").isNull(), "bounds are no numbers").when(F.col("e") < F.col("s"), "end before start")
    df = df.withColumn("reason", reason)
    ok = df.filter("reason is null").select(
        _f(8).alias("column9"), _f(0).alias("chrom"), _f(1).alias("source"), _f(2).alias("feature_type"), F.col("s").alias("start"), F.col("e").alias("end"), _f(5).try_cast("double").alias("score"), F.when(_f(6).isin("+", "-"), _f(6)).otherwise(".").alias("strand"), _f(7).try_cast("int").alias("phase"), attributes(_f(8)).alias("attr")
    )
    return ok, df.filter("reason is not null").select("line", "reason")


def read_gtf(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of GTF2; gene_id and transcript_id as columns, all attributes in ``attr``."""
    ok, bad = _gff(spark, paths, parse_gtf_attributes)
    return ok.drop("column9").withColumn("gene_id", F.element_at("attr", "gene_id")).withColumn("transcript_id", F.element_at("attr", "transcript_id")), bad


def read_gff3(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of GFF3. Sequence after ``##FASTA`` is cut off per file: lines that begin with ``>`` and lines of nothing but letters are sequence, every other line that is no feature is a reject. ``parents`` are split before their escapes are undone."""
    ok, bad = _gff(spark, paths, parse_gff3_attributes)
    return ok.withColumn("ID", F.element_at("attr", "ID")).withColumn("parents", gff3_parents("column9")).drop("column9"), bad.filter(~F.col("line").rlike(r"\A(?:>.*|[A-Za-z*-]+)\z"))


def read_gff3_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(directive, value) of the ``##`` lines, among them sequence-region."""
    x = text_lines(spark, paths).filter(F.col("line").startswith("##") & ~F.col("line").startswith("###"))
    return x.select(F.regexp_extract("line", r"^##(\S+)", 1).alias("directive"), F.trim(F.regexp_extract("line", r"^##\S+\s*(.*)$", 1)).alias("value"))


def read_psl(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(alignments, rejects) of PSL: target coordinates as segments. Of a two-letter strand the second letter is the target's."""
    lines = text_lines(spark, paths).filter(F.col("line").rlike(r"^\s*[0-9]+\t"))
    df = _fields(lines)
    names = ["match_length", "mismatches", "rep_matches", "N", "query_gap_count", "query_gap_bases", "target_gap_count", "target_gap_bases"]
    t, b, q = (F.transform(_ints(_f(i)), lambda x: x) for i in (20, 18, 19))
    reason = F.when(F.size("f") < 21, "fewer than 21 columns").when((F.size(t) != F.size(b)) | (F.size(q) != F.size(b)), "block lists differ in length").when(F.exists(t, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull()), "blocks are no numbers")
    df = df.withColumn("reason", reason)
    strand = F.substring(_f(8), -1, 1)
    ok = df.filter("reason is null").select(
        _f(9).alias("query_name"), _f(13).alias("chrom"), strand.alias("strand"), C.merge_segments(F.zip_with(t, b, lambda x, y: C.segment(x, x + y))).alias("segments"), *[_f(i).try_cast("bigint").alias(n) for i, n in enumerate(names)], _f(10).try_cast("bigint").alias("query_length"), _f(11).try_cast("bigint").alias("query_start"), _f(12).try_cast("bigint").alias("query_end"), _f(14).try_cast("bigint").alias("target_length"), _f(15).try_cast("bigint").alias("target_start"), _f(16).try_cast("bigint").alias("target_end"), q.alias("q_starts"), t.alias("t_starts"), b.alias("block_sizes")
    )
    return ok, df.filter("reason is not null").select("line", "reason")


def bundle_psl(alignments: DataFrame, order: str | None = None) -> DataFrame:
    """The alignments of each query as one row; with ``order``, of each stretch of consecutive rows of a query."""
    a = alignments if order is None else consecutive(alignments, "query_name", order)
    return a.groupBy("query_name", *(["run"] if order else [])).agg(F.collect_list(F.struct("chrom", "strand", "segments")).alias("alignments"))


def read_bowtie(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(reads, rejects) of the legacy bowtie format, in the form that mapping rules take."""
    df = _fields(text_lines(spark, paths)).withColumn("s", _f(3).try_cast("bigint"))
    reason = F.when(F.size("f") < 5, "fewer than 5 columns").when(F.col("s").isNull(), "position is no number").when(~_f(1).isin("+", "-"), "strand is none")
    df = df.withColumn("reason", reason)
    n = F.length(_f(4))
    ok = df.filter("reason is null").select(_f(0).alias("read_id"), _f(2).alias("chrom"), _f(1).alias("strand"), F.col("s").alias("start"), n.alias("rlen"), F.lit(0).alias("k"), F.lit(0).alias("gap"), _f(4).alias("seq"), _f(5).alias("qual"), _f(7).alias("mismatches"))
    return ok, df.filter("reason is not null").select("line", "reason")


def read_wiggle(spark: SparkSession, paths: str | list[str], strand: str = ".", part: int = spans.PART) -> tuple[DataFrame, DataFrame]:
    """(runs, rejects) of wiggle and bedGraph: chrom, strand, start, end, value.

    A data line belongs to the last declaration before it in its file. Files are read in parts: a first pass finds the last declaration of each part and
    the lines after it, one row a part, from which every part knows the one that it begins under.
    """
    schema = "chrom string, start bigint, end bigint, value double, line string"
    fields = [("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64()), ("line", pa.string())]
    files = spans.local_files(spark, paths)
    if files is None:

        def whole(batches):
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    yield from spans.framed(spans.wiggle_rows(iter(raw.decode("utf-8", "replace").splitlines()), None, 0), fields)

        rows = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(whole, schema)
    else:
        plan = spans.parts(spark, files, part)

        def heads(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    yield from spans.framed(iter([(*r.values(), *spans.wiggle_head(*r.values()))]), [("path", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("head", pa.string()), ("n", pa.int64())])

        big = [f for f in files if f[1] > part]
        known: dict[tuple[str, int], tuple[str | None, int]] = {}
        if big:
            head, n, last = None, 0, None
            for r in sorted(spans.parts(spark, big, part).mapInArrow(heads, "path string, begin bigint, stop bigint, head string, n bigint").collect(), key=lambda r: (r["path"], r["begin"])):
                head, n = (head, n) if r["path"] == last else (None, 0)
                known[r["path"], r["begin"]] = (head, n)
                head, n, last = (r["head"], r["n"], r["path"]) if r["head"] else (head, n + r["n"], r["path"])
        under = spark.createDataFrame([(p, a, h, n) for (p, a), (h, n) in known.items()], "path string, begin bigint, head string, n bigint")

        def parse(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    yield from spans.framed(spans.wiggle_rows((x for _, x in spans.lines_of(r["path"], r["begin"], r["stop"])), r["head"], r["n"]), fields)

        rows = plan.join(F.broadcast(under), ["path", "begin"], "left").select("path", "begin", "stop", "head", F.coalesce("n", F.lit(0)).alias("n")).mapInArrow(parse, schema)
    return rows.filter("line is null").select("chrom", F.lit(strand).alias("strand"), "start", "end", "value"), rows.filter("line is not null").select("line", F.lit("no data of the declared form").alias("reason"))


def read_bedgraph(spark: SparkSession, paths: str | list[str], strand: str = ".") -> tuple[DataFrame, DataFrame]:
    """(runs, rejects) of plain bedGraph, which has no state and is read in splits."""
    df = text_lines(spark, paths).filter(~F.col("line").rlike(r"^(browser|track|#)")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    v = [_f(0).alias("chrom"), F.lit(strand).alias("strand"), _f(1).try_cast("bigint").alias("start"), _f(2).try_cast("bigint").alias("end"), _f(3).try_cast("double").alias("value")]
    bad = (F.size("f") != 4) | _f(1).try_cast("bigint").isNull() | _f(2).try_cast("bigint").isNull() | _f(3).try_cast("double").isNull()
    return df.filter(~bad).select(*v), df.filter(bad).select("line", F.lit("not four columns of the right types").alias("reason"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, description, seq), one row per record; records are split at a ``>`` that begins a line, so a large file is read in parts."""
    x = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return x.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+\s*", "")).alias("description"), F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 2)"), r"\s", "").alias("seq"))


def tile_sequences(records: DataFrame, tile: int = 32_768) -> DataFrame:
    """Genome tiles (chrom, tile_no, seq) of sequence records."""
    n = F.greatest(F.ceil(F.length("seq") / tile), F.lit(1))
    return records.select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("tile_no"), "seq").select("chrom", "tile_no", F.expr(f"substring(seq, int(tile_no * {tile} + 1), {tile})").alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str], part: int = spans.PART, rejects: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(name, seq, qual): four lines to a record. Files are read in parts; compressed ones whole. With ``rejects``, also the lines that are part of no record, with the reason."""
    schema, cols = "name string, seq string, qual string, line string", ["name", "seq", "qual", "line"]
    files = spans.local_files(spark, paths)
    if files is not None:
        plan = spans.parts(spark, files, part)
    else:
        plan = spark.read.format("binaryFile").load(paths).select("path", "content")

    def records(r: dict) -> Iterator[tuple]:
        if files is not None:
            with open(r["path"], "rb") as fh:
                yield from spans.fastq_records(fh, r["begin"], r["stop"])
        else:
            raw = io.BytesIO(r["content"])
            yield from spans.fastq_records(io.BytesIO(gzip.decompress(raw.getvalue())) if r["content"][:2] == b"\x1f\x8b" else raw)

    def parse(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from spans.framed(records(r), [(c, pa.string()) for c in cols])

    rows = plan.mapInArrow(parse, schema)
    ok = rows.filter("line is null").drop("line")
    return (ok, rows.filter("line is not null").select("line", F.lit("no record of four lines").alias("reason"))) if rejects else ok


def read_flat_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, seq) of GenBank (``LOCUS``/``ORIGIN``) and EMBL (``ID``/``SQ``) files; records end at ``//``."""
    x = spark.read.option("lineSep", "\n//").text(paths).filter(F.trim("value") != "")
    name = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("value", r"(?m)^ID\s+([^\s;]+)", 1), F.lit("")))
    body = F.regexp_extract("value", r"(?s)\n(?:ORIGIN|SQ)[^\n]*\n(.*)\z", 1)
    return x.select(name.alias("name"), F.upper(F.regexp_replace(body, r"[^A-Za-z]", "")).alias("seq")).filter("name is not null")


def read_offsets(path: str, text: str | None = None) -> tuple[dict[int, int], int | None]:
    """(offset per read length, default) of a two-column table with a row per length and perhaps ``default``. A malformed table is an error."""
    if text is None:
        with open(path) as fh:
            text = fh.read()
    out: dict[int, int] = {}
    default = None
    for line in text.splitlines():
        if not line.strip() or line.startswith("#") or line.startswith("length"):
            continue
        x = line.split("\t")
        if len(x) != 2:
            raise ValueError(f"offset table: {line!r} has not two columns")
        try:
            o = int(x[1])
            if x[0] == "default":
                if default is not None:
                    raise ValueError
                default = o
            elif int(x[0]) in out:
                raise ValueError
            else:
                out[int(x[0])] = o
        except ValueError:
            raise ValueError(f"offset table: {line!r} is repeated or no number") from None
    return out, default


def read_table(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header row and ``#`` comments."""
    r = spark.read.option("sep", "\t").option("header", True).option("comment", "#")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(paths)


def consecutive(df: DataFrame, key: str, order: str, chunk: int = 1 << 20) -> DataFrame:
    """Rows with ``run``: the number of the stretch of equal keys in order (a bundle of neighbouring lines). ``order`` is a column of whole numbers.

    Runs are numbered in chunks of ``order``; a window over chunk summaries tells each chunk the last key and the number of runs before it.
    """
    t = df.withColumn("__c", F.floor(F.col(order) / chunk))
    w = Window.partitionBy("__c").orderBy(order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"))
    t = t.withColumn("__new", new).withColumn("__n", F.sum("__new").over(w)).drop("__new")
    ends = t.groupBy("__c").agg(F.min_by(F.struct(F.col(key).alias("k")), order).alias("first"), F.max_by(F.struct(F.col(key).alias("k")), order).alias("last"), F.max("__n").alias("runs"))
    over = Window.orderBy("__c")
    joins = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(over)).cast("int"), F.lit(0))
    ends = ends.withColumn("own", F.col("runs") - joins).select("__c", (F.sum("own").over(over) - F.col("own") - joins).alias("before"))
    return t.join(ends, "__c").withColumn("run", F.col("before") + F.col("__n")).drop("__c", "__n", "before")


#: autoSql types and the Spark types they become.
AUTOSQL_TYPES = {"int": "int", "uint": "bigint", "short": "smallint", "ushort": "int", "byte": "tinyint", "ubyte": "smallint", "float": "float", "double": "double", "char": "string", "string": "string", "lstring": "string", "bigint": "bigint"}


def parse_autosql(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(table name, [(column, Spark type, comment)]) of an autoSql declaration. Repeated names get 2, 3, ...; unknown types are text; sized types and sets are arrays."""
    import re

    head = re.search(r"(?:table|simple|object)\s+(\w+)\s*(?:\"[^\"]*\")?\s*\(", text)
    if not head:
        raise ValueError("no autoSql declaration")
    out: list[tuple[str, str, str]] = []
    seen: dict[str, int] = {}
    for m in re.finditer(r"(\w+)(\s*\(([^)]*)\))?(?:\s*\[\s*(\w+)\s*\])?\s+(\w+)\s*[^;\"]*;\s*\"([^\"]*)\"", text[head.end() :]):
        kind, choices, size, name, comment = m[1], m[2], m[4], m[5], m[6]
        seen[name] = seen.get(name, 0) + 1
        name = name if seen[name] == 1 else f"{name}{seen[name]}"
        t = "array<string>" if kind == "set" else "string" if choices else AUTOSQL_TYPES.get(kind, "string")
        if size and t != "string":
            t = f"array<{t}>"
        elif size and kind in ("string", "lstring"):
            t = "array<string>"
        out.append((name, t, comment))
    return head[1], out


def cast_autosql(values: Column, columns: list[tuple[str, str, str]]) -> list[Column]:
    """Typed columns of an array of texts, as :func:`parse_autosql` declares them."""
    out = []
    for i, (n, t, _) in enumerate(columns):
        v = F.get(values, F.lit(i))
        if t.startswith("array<"):
            v = F.transform(F.filter(F.split(v, ","), lambda x: x != ""), lambda x: F.trim(x).try_cast(t[6:-1]))  # noqa: B023
            v = F.array_distinct(v) if t == "array<string>" else v
        else:
            v = v.try_cast(t)
        out.append(v.alias(n))
    return out
