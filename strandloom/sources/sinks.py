"""Writers: features, tracks, sequences and tables as lines of text. Each returns a DataFrame with a ``line`` column; :func:`write_lines` stores it."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators.annotation import escape, format_gff3_attributes, format_gtf_attributes


def _tab(*cols: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in cols])


def bed_score(score: Column | str) -> Column:
    """Rounded half to even; 0 where there is no number."""
    v = C.col(score).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(F.bround(v, 0).cast("bigint"))


def bed_color(color: Column | str) -> Column:
    h = F.lower(F.regexp_replace(C.col(color), "^#", ""))
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    return F.when(h.rlike("^[0-9a-f]{6}$"), F.concat_ws(",", part(1), part(3), part(5))).otherwise("0,0,0")


def as_bed(df: DataFrame, name: str = "ID", score: str | None = None, color: str | None = None, thick: tuple[str, str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """BED12 lines of chains (chrom, strand, segments); an empty chain gives an empty line. ``thick`` names the coding bounds, by default the start of the span."""
    s, start = F.col("segments"), C.span_start("segments")
    lo, hi = (F.coalesce(F.col(thick[0]), start), F.coalesce(F.col(thick[1]), start)) if thick else (start, start)
    sizes = F.array_join(F.transform(s, lambda x: (x["end"] - x["start"]).cast("string")), ",")
    starts = F.array_join(F.transform(s, lambda x: (x["start"] - start).cast("string")), ",")
    line = _tab(F.col("chrom"), start, C.span_end("segments"), F.col(name), bed_score(score) if score else F.lit(0), F.col("strand"), lo, hi, bed_color(color) if color else F.lit("0,0,0"), F.size(s), F.concat(sizes, F.lit(",")), F.concat(starts, F.lit(",")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in extra or []])
    return df.select(F.when(F.size(s) == 0, "").otherwise(line).alias("line"))


def _feature(kind: Column | str, start: Column, end: Column, frame: Column, attributes: Column, source: str = ".") -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return _tab(F.col("chrom"), F.lit(source), k, start + 1, end, F.lit("."), F.col("strand"), frame, attributes)


def cds_frame(off: Column) -> Column:
    """Frame of a coding segment that begins ``off`` nucleotides behind the coding start."""
    return ((3 - off % 3) % 3).cast("string")


def _stranded_offsets(segs: Column, strand: Column) -> Column:
    """Segments with ``off`` counted from the 5' end."""
    n = C.length(segs)
    return F.transform(C.offsets(segs), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(strand == "-", n - s["off"] - (s["end"] - s["start"])).otherwise(s["off"]).alias("off")))


def as_gtf(df: DataFrame, feature: str = "exon") -> DataFrame:
    """GTF2 lines of chains with ``attr``: one per segment; CDS segments have a frame."""
    x = df.withColumn("__s", F.explode(_stranded_offsets(F.col("segments"), F.col("strand"))))
    frame = cds_frame(F.col("__s.off")) if feature == "CDS" else F.lit(".")
    return x.select(_feature(feature, F.col("__s.start"), F.col("__s.end"), frame, format_gtf_attributes("attr")).alias("line"))


def transcript_as_gtf(df: DataFrame) -> DataFrame:
    """GTF2 lines of transcripts: exons, CDS without its last three nucleotides, start and stop codon."""
    t = df.withColumn("__b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    b, s, st = F.col("__b"), F.col("segments"), F.col("strand")
    part = lambda kind, segs: F.transform(_stranded_offsets(segs, st), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["off"].alias("off")))
    coding = F.concat(part("CDS", C.subchain(s, st, b["start"], b["end"] - 3)), part("start_codon", C.subchain(s, st, b["start"], b["start"] + 3)), part("stop_codon", C.subchain(s, st, b["end"] - 3, b["end"])))
    rows = t.withColumn("__x", F.explode(F.when(b.isNull(), part("exon", s)).otherwise(F.concat(part("exon", s), coding))))
    frame = F.when(F.col("__x.kind") == "exon", ".").otherwise(cds_frame(F.col("__x.off")))
    return rows.select(_feature(F.col("__x.kind"), F.col("__x.start"), F.col("__x.end"), frame, format_gtf_attributes("attr")).alias("line"))


def as_gff3(df: DataFrame, feature: str = "region") -> DataFrame:
    """GFF3 lines of chains of one segment; others are an error at run time."""
    one = F.when(F.size("segments") == 1, F.col("segments")[0]).otherwise(F.raise_error(F.lit("GFF3 can hold chains of one segment only")))
    return df.withColumn("__s", one).select(_feature(feature, F.col("__s.start"), F.col("__s.end"), F.lit("."), format_gff3_attributes("attr")).alias("line"))


def transcript_as_gff3(df: DataFrame, name: str = "ID") -> DataFrame:
    """GFF3 lines of transcripts: an mRNA and its exon, UTR and CDS children."""
    t = df.withColumn("__b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    b, s, st = F.col("__b"), F.col("segments"), F.col("strand")
    part = lambda kind, segs: F.transform(_stranded_offsets(segs, st), lambda x, i: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["off"].alias("off"), i.alias("i")))
    coding = F.concat(part("five_prime_UTR", C.get_utr5(s, st, b)), part("CDS", C.get_cds(s, st, b)), part("three_prime_UTR", C.get_utr3(s, st, b)))
    top = F.array(F.struct(F.lit("mRNA").alias("kind"), C.span_start(s).alias("start"), C.span_end(s).alias("end"), F.lit(0).cast("bigint").alias("off"), F.lit(0).alias("i")))
    rows = t.withColumn("__x", F.explode(F.when(b.isNull(), F.concat(top, part("exon", s))).otherwise(F.concat(top, part("exon", s), coding))))
    kind, own = F.col("__x.kind"), escape(name)
    attributes = F.when(kind == "mRNA", format_gff3_attributes("attr")).otherwise(F.concat(F.lit("ID="), own, F.lit(":"), kind, F.lit(":"), F.col("__x.i").cast("string"), F.lit(";Parent="), own))
    frame = F.when(kind == "CDS", cds_frame(F.col("__x.off"))).otherwise(".")
    return rows.select(_feature(kind, F.col("__x.start"), F.col("__x.end"), frame, attributes).alias("line"))


def as_psl(df: DataFrame) -> DataFrame:
    """PSL lines of alignments as :func:`strandloom.sources.text.read_psl` gives them; a missing column is an error."""
    a = lambda c: F.concat(F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ","), F.lit(","))
    cols = ["match_length", "mismatches", "rep_matches", "N", "query_gap_count", "query_gap_bases", "target_gap_count", "target_gap_bases", "strand", "query_name", "query_length", "query_start", "query_end", "chrom", "target_length", "target_start", "target_end"]
    return df.select(_tab(*[F.col(c) for c in cols], F.size("t_starts"), a("block_sizes"), a("q_starts"), a("t_starts")).alias("line"))


def _number(c: Column | str) -> Column:
    """Whole numbers without a decimal point."""
    v = C.col(c).cast("double")
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def as_bedgraph(runs: DataFrame) -> DataFrame:
    return runs.select("chrom", "start", _tab(F.col("chrom"), F.col("start"), F.col("end"), _number("value")).alias("line"))


def as_variable_step(array: DataFrame, tile: int = 1_000_000) -> DataFrame:
    """variableStep lines of sites, with a declaration before the first line of each ``tile`` of a chrom, so that a file may begin with any tile.

    To be written with ``order`` chrom, tile, start and ``keep`` chrom, tile.
    """
    body = array.filter("value <> 0").select("chrom", F.floor(F.col("pos") / tile).alias("tile"), F.col("pos").alias("start"), F.concat_ws(" ", (F.col("pos") + 1).cast("string"), _number("value")).alias("line"))
    head = body.select("chrom", "tile").distinct().select("chrom", "tile", F.lit(-1).cast("bigint").alias("start"), F.concat(F.lit("variableStep chrom="), "chrom", F.lit(" span=1")).alias("line"))
    return head.unionByName(body)


def as_fasta(df: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None, compression: str | None = None, keep: list[str] | None = None) -> None:
    """Text files, range-partitioned and sorted by ``order`` where given, so that parts in sequence are the whole in order; rows equal in ``keep`` stay in one file."""
    if order and keep:
        lines = lines.repartitionByRange(*keep).sortWithinPartitions(*order)
    elif order:
        lines = lines.orderBy(*order)
    w = lines.select("line").write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def write_table(df: DataFrame, path: str, comments: dict[str, str] | None = None) -> None:
    """A tab-separated table with a header, and a ``_provenance`` file of ``##`` lines beside it."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    spark = df.sparkSession
    note = "".join(f"## {k}: {v}\n" for k, v in ({"date": datetime.date.today().isoformat()} | (comments or {})).items())
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_provenance")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(note.encode()))
    out.close()


def write_gene_tables(models: DataFrame, path: str) -> None:
    """One table of the parts as texts and a BED file of each part."""
    parts = ["exon", "utr5", "cds", "utr3", "masked"]
    write_table(models.select(F.col("merged_gene").alias("region"), *[C.to_text("chrom", p, "strand").alias(p) for p in parts]), f"{path}/positions")
    for p in parts:
        write_lines(as_bed(models.filter(F.size(p) > 0).select("chrom", "strand", F.col(p).alias("segments"), F.col("merged_gene").alias("ID"))), f"{path}/{p}.bed")


def write_vectors(vectors: DataFrame, key: str, path: str) -> None:
    """One folder per region with a value per line."""
    vectors.select(key, F.posexplode("vector").alias("i", "v")).repartition(key).sortWithinPartitions(key, "i").select(key, F.format_string("%.8f", "v").alias("line")).write.mode("overwrite").partitionBy(key).text(path)
