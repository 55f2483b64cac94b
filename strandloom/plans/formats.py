"""Queries that write a view in a file format, read it back and are checked against SQL on the view itself."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators import annotation as N
from strandloom.operators import arrays as A
from strandloom.operators import sequence as S
from strandloom.plans.genome import TILE, exons, masks, track, transcripts
from strandloom.plans.registry import Registry
from strandloom.plans.views import ctes, view
from strandloom.session import shared_dir
from strandloom.sources import sinks as K
from strandloom.sources import text as X
from strandloom.tables import load

formats = Registry()

_CHAIN = "min(chrom) || ':' || string_agg(concat(seg_start, '-', seg_end), '^' ORDER BY seg_start) || '(' || min(strand) || ')'"


def _path(spark, label: str) -> str:
    """A folder of the session's shared one, deleted with the session."""
    path = os.path.join(shared_dir(spark), f"strandloom-{label}-{uuid.uuid4().hex}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _written(lines: DataFrame, label: str, order: list[str] | None = None, compression: str | None = None) -> str:
    path = _path(lines.sparkSession, label)
    K.write_lines(lines, path, order, compression)
    return path


def _attributed(spark, d) -> DataFrame:
    t = transcripts(spark, d)
    return t.withColumn("ID", F.col("tx_id")).withColumn("attr", F.create_map(F.lit("gene_id"), "gene_id", F.lit("transcript_id"), "tx_id", F.lit("ID"), "tx_id", F.lit("note"), F.concat(F.lit('a;b,"'), "tx_id", F.lit("=%"))))


@formats.add("bed_round_trip", ctes("seg") + f" SELECT tx_id, {_CHAIN} AS region, min(cds_start) AS thick_start, min(cds_end) AS thick_end, '#0a00ff' AS color, 7.0::DOUBLE AS score FROM seg GROUP BY tx_id")
def bed_round_trip(spark, d):
    """Transcripts as gzip-compressed BED12 with coding bounds, colour and score."""
    t = transcripts(spark, d).withColumn("c", F.lit("#0a00ff")).withColumn("s", F.lit(6.5))
    back, _ = X.read_bed(spark, _written(K.as_bed(t, "tx_id", "s", "c", ("cds_genome_start", "cds_genome_end")), "bed", compression="gzip"))
    # 6.5 is written as 6 (half to even), so one is added to tell the column from a default.
    return back.select(F.col("ID").alias("tx_id"), C.to_text("chrom", "segments", "strand").alias("region"), "thick_start", "thick_end", "color", (F.col("score") + 1).alias("score"))


@formats.add("bed_extra_columns", ctes("masks") + " SELECT mask_id, chrom, strand, start, end_ AS \"end\", CAST((end_ - start) / 4.0 AS DOUBLE) AS signalValue, CAST(end_ - start AS INTEGER) AS peak, 'n/a' AS unfit FROM masks")
def bed_extra_columns(spark, d):
    """Masks with the further columns of a BED subtype; a value that does not fit its type is kept as text."""
    m = masks(spark, d).withColumn("n", F.col("end") - F.col("start"))
    m = m.withColumn("segments", F.array(C.segment("start", "end"))).withColumn("v", F.col("n") / 4).withColumn("p", F.lit("n/a")).withColumn("q", F.lit(1.5))
    back, _ = X.read_bed(spark, _written(K.as_bed(m, "mask_id", extra=["v", "p", "q", "n"]), "bed"), subtype="narrowPeak")
    return back.filter("pValue is null and qValue = 1.5").select(F.col("ID").alias("mask_id"), "chrom", "strand", "start", "end", "signalValue", "peak", F.element_at("attr", "pValue").alias("unfit"))


@formats.add("bed_rejects", ctes("masks") + " SELECT CASE s % 4 WHEN 0 THEN 'fewer than 3 columns' WHEN 1 THEN 'bounds are no numbers' WHEN 2 THEN 'end before start' ELSE 'valid' END AS outcome, count(*) AS n FROM (SELECT end_ - start AS s FROM masks) x GROUP BY 1")
def bed_rejects(spark, d):
    """Lines broken in several ways come back with the reason, the others as features."""
    n = (F.col("end") - F.col("start")) % 4
    line = F.when(n == 0, F.concat_ws("\t", "chrom", F.col("start").cast("string"))).when(n == 1, F.concat("chrom", F.lit("\tx\t9"))).when(n == 2, F.concat("chrom", F.lit("\t9\t5"))).otherwise(F.concat_ws("\t", F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("mask_id")))
    ok, bad = X.read_bed(spark, _written(masks(spark, d).select(line.alias("line")), "bed"))
    return ok.select(F.lit("valid").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@formats.add("gtf_round_trip", ctes("seg") + f" SELECT tx_id, min(gene_id) AS gene_id, {_CHAIN} AS region, min(cds_start) AS cds_genome_start, min(cds_end) AS cds_genome_end FROM seg GROUP BY tx_id")
def gtf_round_trip(spark, d):
    """Transcripts as GTF2 exons, CDS and codons, assembled again."""
    ok, _ = N.assemble_transcripts(X.read_gtf(spark, _written(K.transcript_as_gtf(_attributed(spark, d)), "gtf"))[0])
    return ok.select(F.col("transcript_id").alias("tx_id"), "gene_id", C.to_text("chrom", "segments", "strand").alias("region"), "cds_genome_start", "cds_genome_end")


_CDS_ROWS = "z AS (SELECT tx_id, strand, greatest(seg_start, cds_start) AS a, least(seg_end, cds_end) AS b FROM seg WHERE greatest(seg_start, cds_start) < least(seg_end, cds_end)), f AS (SELECT *, CASE WHEN strand = '-' THEN sum(b - a) OVER (PARTITION BY tx_id ORDER BY a DESC) ELSE sum(b - a) OVER (PARTITION BY tx_id ORDER BY a) END - (b - a) AS off FROM z)"


@formats.add("gff3_frames", ctes("seg") + f", {_CDS_ROWS} SELECT tx_id, a AS start, b AS \"end\", CAST((3 - off % 3) % 3 AS INTEGER) AS phase FROM f")
def gff3_frames(spark, d):
    """Coding segments of transcripts written as GFF3, with their frames."""
    rows, _ = X.read_gff3(spark, _written(K.transcript_as_gff3(_attributed(spark, d)), "gff3"))
    return rows.filter("feature_type = 'CDS'").select(F.explode("parents").alias("tx_id"), "start", "end", "phase")


@formats.add("gff3_round_trip", ctes("seg") + f" SELECT tx_id, {_CHAIN} AS region, min(cds_start) AS cds_genome_start, min(cds_end) AS cds_genome_end FROM seg GROUP BY tx_id")
def gff3_round_trip(spark, d):
    """Transcripts as GFF3 features and their children, assembled again."""
    ok, _ = N.assemble_gff3(X.read_gff3(spark, _written(K.transcript_as_gff3(_attributed(spark, d)), "gff3"))[0])
    return ok.select(F.col("transcript_id").alias("tx_id"), C.to_text("chrom", "segments", "strand").alias("region"), "cds_genome_start", "cds_genome_end")


@formats.add("chain_lines", ctes("seg") + ", m AS (SELECT 'gff3' AS kind, chrom, strand, seg_start AS start, seg_end AS \"end\", tx_id, exon_no FROM seg), k AS (SELECT 'gtf', chrom, strand, seg_start, seg_end, tx_id, exon_no FROM seg) SELECT kind, chrom, strand, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(\"end\") AS BIGINT) AS ends, count(DISTINCT tx_id) AS n_tx FROM (SELECT * FROM m UNION ALL SELECT * FROM k) x GROUP BY kind, chrom, strand")
def chain_lines(spark, d):
    """Exons as GFF3 lines of one segment each, and chains as GTF2 lines of their segments."""
    t = _attributed(spark, d)
    one = t.withColumn("s", F.explode("segments")).withColumn("segments", F.array("s"))
    g3 = X.read_gff3(spark, _written(K.as_gff3(one, "exon"), "gff3"))[0].select(F.lit("gff3").alias("kind"), "chrom", "strand", "start", "end", F.col("ID").alias("tx"))
    g2 = X.read_gtf(spark, _written(K.as_gtf(t), "gtf"))[0].select(F.lit("gtf").alias("kind"), "chrom", "strand", "start", "end", F.col("transcript_id").alias("tx"))
    return g3.unionByName(g2).groupBy("kind", "chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.count_distinct("tx").alias("n_tx"))


@formats.add("attribute_escapes", r"""WITH g AS (SELECT DISTINCT gtf_id, gene_id, transcript_id FROM gtf2) SELECT gtf_id, '<' || coalesce(gene_id, '') || ';,=&%' || chr(9) || chr(1) || chr(127) || '"' || coalesce(transcript_id, '') || '>' AS value, '%3B%2C%3D%26%25%09%01%7F' AS escaped FROM g""")
def attribute_escapes(spark, d):
    """Raw ids with separators and control characters as attribute values, in GFF3 form and back."""
    value = F.concat(F.lit("<"), F.coalesce("gene_id", F.lit("")), F.lit(';,=&%\t\x01\x7f"'), F.coalesce("transcript_id", F.lit("")), F.lit(">"))
    g = load(spark, d, "gtf2").select("gtf_id", "gene_id", "transcript_id").distinct().withColumn("attr", F.create_map(F.lit("k"), value, F.lit("x;y"), F.lit("z")))
    line = g.select("gtf_id", N.format_gff3_attributes("attr").alias("t"))
    back = line.withColumn("attr", N.parse_gff3_attributes("t")).filter(F.element_at("attr", "x;y") == "z")
    return back.select("gtf_id", F.element_at("attr", "k").alias("value"), F.regexp_extract("t", "%3B%2C%3D%26%25%09%01%7F", 0).alias("escaped"))


@formats.add("psl_round_trip", ctes("seg") + ", n AS (SELECT tx_id, chrom, strand, seg_start, seg_end, sum(seg_end - seg_start) OVER (PARTITION BY tx_id ORDER BY seg_start) - (seg_end - seg_start) AS q FROM seg) SELECT tx_id AS query_name, " + _CHAIN + " AS region, CAST(sum(seg_end - seg_start) AS BIGINT) AS query_length, string_agg(CAST(CAST(q AS BIGINT) AS VARCHAR), ',' ORDER BY seg_start) AS q_starts, CAST(count(*) AS INTEGER) AS n_blocks FROM n GROUP BY tx_id")
def psl_round_trip(spark, d):
    """Transcripts as alignments of their own sequence in PSL."""
    zero = F.lit(0)
    t = transcripts(spark, d).withColumn("o", C.offsets("segments")).withColumn("n", C.length("segments"))
    a = t.select(
        F.col("n").alias("match_length"), *[zero.alias(c) for c in ("mismatches", "rep_matches", "N", "query_gap_count", "query_gap_bases")], (F.size("segments") - 1).alias("target_gap_count"), (C.span_end("segments") - C.span_start("segments") - F.col("n")).alias("target_gap_bases"), "strand", F.col("tx_id").alias("query_name"), F.col("n").alias("query_length"), zero.alias("query_start"),
        F.col("n").alias("query_end"), "chrom", F.lit(1_000_000_000).alias("target_length"), C.span_start("segments").alias("target_start"), C.span_end("segments").alias("target_end"), F.transform("o", lambda s: s["end"] - s["start"]).alias("block_sizes"), F.transform("o", lambda s: s["off"]).alias("q_starts"), F.transform("o", lambda s: s["start"]).alias("t_starts"),
    )
    back, _ = X.read_psl(spark, _written(K.as_psl(a), "psl"))
    return back.select("query_name", C.to_text("chrom", "segments", "strand").alias("region"), "query_length", F.array_join(F.transform("q_starts", lambda x: x.cast("string")), ",").alias("q_starts"), F.size("block_sizes").alias("n_blocks"))


@formats.add("psl_bundles", "WITH a AS (SELECT DISTINCT read_id, seq_no, lane_id, coalesce(region, '~') AS region FROM alignments WHERE seq_no IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY lane_id, seq_no, read_id) AS i FROM a), l AS (SELECT *, CASE WHEN region IS NOT DISTINCT FROM lag(region) OVER (ORDER BY i) AND i > 1 THEN 0 ELSE 1 END AS new FROM o), r AS (SELECT *, sum(new) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l), b AS (SELECT run, region, count(*) AS size FROM r GROUP BY run, region) SELECT region, size, count(*) AS n FROM b GROUP BY region, size")
def psl_bundles(spark, d):
    """Consecutive rows with one name as bundles: how many bundles of which size each name has."""
    a = load(spark, d, "alignments").filter("seq_no is not null").select("read_id", "seq_no", "lane_id", F.coalesce("region", F.lit("~")).alias("query_name")).distinct()
    # Consecutive numbers from per-lane counts; no window over all rows.
    from pyspark.sql import Window

    n = a.groupBy("lane_id").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("lane_id")) - F.col("n")).drop("n")
    i = a.join(n, "lane_id").withColumn("i", F.row_number().over(Window.partitionBy("lane_id").orderBy("seq_no", "read_id")) + F.col("before"))
    rows = i.select("query_name", F.lit("c").alias("chrom"), F.lit("+").alias("strand"), C.no_segments().alias("segments"), "i")
    return X.bundle_psl(rows, "i").groupBy(F.col("query_name").alias("region"), F.size("alignments").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@formats.add("bowtie_reads", ctes("reads") + " SELECT chrom, strand, rlen, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM reads WHERE k = 0 GROUP BY chrom, strand, rlen")
def bowtie_reads(spark, d):
    """Unspliced reads as legacy bowtie lines, read back in the form that mapping rules take."""
    r = view(spark, d, "reads").filter("k = 0")
    line = F.concat_ws("\t", F.lit("r"), "strand", "chrom", F.col("start").cast("string"), F.expr("repeat('A', cast(rlen as int))"), F.expr("repeat('I', cast(rlen as int))"), F.lit("0"), F.lit(""))
    back, _ = X.read_bowtie(spark, _written(r.select(line.alias("line")), "bowtie"))
    return back.groupBy("chrom", "strand", F.col("rlen").cast("bigint").alias("rlen")).agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@formats.add("wiggle_round_trip", ctes("track") + " SELECT chrom, pos AS start, pos + 1 AS \"end\", CAST(value AS DOUBLE) AS value FROM track WHERE strand = '+' AND value <> 0")
def wiggle_round_trip(spark, d):
    """The track of one strand as variableStep lines in several files, each with its declarations."""
    lines = K.as_variable_step(track(spark, d).filter("strand = '+'"), tile=500)
    path = _path(spark, "wig")
    K.write_lines(lines, path, ["chrom", "tile", "start"], keep=["chrom", "tile"])
    return X.read_wiggle(spark, path, "+")[0].select("chrom", "start", "end", "value")


@formats.add("bedgraph_round_trip", ctes("track") + ", t AS (SELECT chrom, strand, pos, CAST(value AS DOUBLE) AS value FROM track), f AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, strand, value ORDER BY pos) AS g FROM t WHERE value <> 0) SELECT chrom, strand, min(pos) AS start, max(pos) + 1 AS \"end\", value FROM f GROUP BY chrom, strand, value, g")
def bedgraph_round_trip(spark, d):
    """Runs of the track as a bedGraph file per strand."""
    runs = A.runs(track(spark, d))
    out = None
    for s in "+-":
        one = X.read_bedgraph(spark, _written(K.as_bedgraph(runs.filter(F.col("strand") == s)), "bedgraph", ["chrom", "start"]), s)[0]
        out = one if out is None else out.unionByName(one)
    return out


@formats.add("fasta_round_trip", ctes("genome") + " SELECT chrom AS name, 'tile ' || CAST(tile_no AS VARCHAR) || ' 5->3' AS description, md5(seq) AS digest, count(*) AS n FROM genome GROUP BY ALL")
def fasta_round_trip(spark, d):
    """Genome tiles as FASTA records whose headers hold the sign that begins records."""
    g = view(spark, d, "genome").withColumn("name", F.concat("chrom", F.lit(" tile "), F.col("tile_no").cast("string"), F.lit(" 5->3")))
    return X.read_fasta(spark, _written(K.as_fasta(g), "fasta")).groupBy("name", "description", F.md5("seq").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@formats.add("sequence_tiles", ctes("seg") + " SELECT tx_id AS chrom, CAST(ceil(sum(seg_end - seg_start) / 100.0) AS BIGINT) AS n_tiles, CAST(sum(seg_end - seg_start) AS BIGINT) AS length FROM seg GROUP BY tx_id")
def sequence_tiles(spark, d):
    """Spliced sequences cut into tiles of 100."""
    s = S.segment_sequences(view(spark, d, "genome"), exons(spark, d), TILE, "tx_id").select(F.col("tx_id").alias("name"), "seq")
    return X.tile_sequences(s, 100).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(F.length("seq")).alias("length"))


@formats.add("fastq_reads", ctes("genome") + " SELECT chrom || '_' || CAST(tile_no AS VARCHAR) AS name, seq, '@' || repeat('I', 31) AS qual FROM genome WHERE tile_no % 7 < 4")
def fastq_reads(spark, d):
    """Reads as FASTQ records whose qualities begin as headers do."""
    g = view(spark, d, "genome").filter("tile_no % 7 < 4")
    line = F.concat(F.lit("@"), "chrom", F.lit("_"), F.col("tile_no").cast("string"), F.lit(" x\n"), "seq", F.lit("\n+\n@"), F.repeat(F.lit("I"), F.lit(31)))
    return X.read_fastq(spark, _written(g.select(line.alias("line")), "fastq"))


@formats.add("table_round_trip", ctes("reads", "seg") + ", c AS (SELECT chrom, strand, start % 1000 AS bin, count(*) AS n FROM reads GROUP BY ALL) SELECT chrom, strand, CAST(bin AS BIGINT) AS bin, n FROM c")
def table_round_trip(spark, d):
    """A table of counts with header and provenance, written and read back."""
    t = view(spark, d, "reads").groupBy("chrom", "strand", (F.col("start") % 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    path = _path(spark, "table")
    K.write_table(t, path, {"program": "table_round_trip"})
    return X.read_table(spark, path, "chrom string, strand string, bin bigint, n bigint")


@formats.add("vector_files", ctes("masks") + " SELECT mask_id, end_ - start AS n, CAST(sum(x) AS DOUBLE) AS total FROM (SELECT mask_id, start, end_, unnest(range(end_ - start)) AS x FROM masks) v GROUP BY ALL")
def vector_files(spark, d):
    """A folder of values per region, read back."""
    v = masks(spark, d).filter("end > start").select("mask_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("end") - F.col("start") - 1), lambda x: x.cast("double")).alias("vector"))
    path = _path(spark, "vectors")
    K.write_vectors(v, "mask_id", path)
    return spark.read.text(path).groupBy("mask_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("total"))


@formats.add("autosql_columns", "WITH r AS (SELECT DISTINCT rec_id, my_string, a_field_size, float_array, alpha FROM autosql_records), l AS (SELECT *, list_filter(string_split(float_array, ','), lambda x: x <> '') AS f FROM r) SELECT rec_id, my_string, a_field_size, CAST(len(f) AS INTEGER) AS n_places, CAST(len(list_filter(f, lambda x: regexp_full_match(trim(x, E' \\t'), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)(e[+-]?[0-9]+)?'))) AS INTEGER) AS n_numbers FROM l")
def autosql_columns(spark, d):
    """Records typed by an autoSql declaration; what is no number in a float list is null."""
    _, cols = X.parse_autosql('table r "records" ( string my_string; "text" int a_field_size; "size" float[a_field_size] float_array; "list" )')
    r = load(spark, d, "autosql_records").select("rec_id", "my_string", "a_field_size", "float_array", "alpha").distinct()
    t = r.select("rec_id", F.array("my_string", F.col("a_field_size").cast("string"), "float_array").alias("v")).select("rec_id", *X.cast_autosql(F.col("v"), cols))
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    size = lambda c: F.when(F.col("float_array").isNotNull(), F.size(c))
    return t.select("rec_id", "my_string", "a_field_size", size("float_array").alias("n_places"), size(F.filter("float_array", plain)).alias("n_numbers"))


@formats.add("identical_attributes", "WITH g AS (SELECT DISTINCT gtf_id, gene_id, source, feature_type, strand FROM gtf2 WHERE gene_id IS NOT NULL), x AS (SELECT gene_id, CASE WHEN count(source) = count(*) AND min(source) = max(source) THEN min(source) END AS source, CASE WHEN count(feature_type) = count(*) AND min(feature_type) = max(feature_type) THEN min(feature_type) END AS feature_type, CASE WHEN count(strand) = count(*) AND min(strand) = max(strand) THEN min(strand) END AS strand FROM g GROUP BY gene_id) SELECT * FROM x")
def identical_attributes(spark, d):
    """What all rows of a gene have in common."""
    g = load(spark, d, "gtf2").filter("gene_id is not null").select("gtf_id", "gene_id", "source", "feature_type", "strand").distinct()
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))) for c in ("source", "feature_type", "strand")]))
    same = N.identical_attributes(g.select("gene_id", F.map_from_entries(pairs).alias("attr")), "gene_id")
    return same.select("gene_id", *[F.element_at("attr", c).alias(c) for c in ("source", "feature_type", "strand")])


@formats.add("site_lines", ctes("reads") + " SELECT chrom, count(*) AS n FROM (SELECT DISTINCT chrom, strand, start FROM reads) x GROUP BY chrom")
def site_lines(spark, d):
    """Sites through a bedGraph of one line each and back into an array."""
    s = view(spark, d, "reads").select("chrom", "strand", F.col("start").alias("pos"), F.lit(1.0).alias("weight"))
    r = A.count_positions(s).select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    path = _written(K.as_bedgraph(r), "bedgraph")
    return A.from_runs(X.read_bedgraph(spark, path, "+")[0]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


