"""End-to-end programs from files to files: ``python -m strandloom.plans.programs NAME OUT INPUT... [--option value]``.

Alignments are BAM or legacy bowtie files or Parquet tables of reads; annotations BED, GTF2, GFF3 or PSL; masks BED or another annotation.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import chains as C
from strandloom.operators import annotation as N
from strandloom.operators import arrays as A
from strandloom.operators import genes as G
from strandloom.operators import junctions as J
from strandloom.operators import mapping as M
from strandloom.operators import metagene as MG
from strandloom.operators import regions as R
from strandloom.operators import sequence as S
from strandloom.operators import stats as T
from strandloom.sources import binary as B
from strandloom.sources import sinks as K
from strandloom.sources import text as X


def alignments(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".bam"):
        return B.read_bam(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return X.read_bowtie(spark, path)[0]


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """Chains ``ID, gene_id, chrom, strand, segments, cds_genome_start, cds_genome_end, attr`` of any annotation file."""
    name = path.removesuffix(".gz")
    none = F.lit(None).cast("bigint")
    attr = F.create_map(F.lit("gene_id"), F.coalesce("gene_id", F.lit("")), F.lit("transcript_id"), F.col("ID"), F.lit("ID"), F.col("ID"))
    if name.endswith((".gtf", ".gtf2")):
        t, _ = N.assemble_transcripts(X.read_gtf(spark, path)[0])
    elif name.endswith((".gff", ".gff3")):
        t, _ = N.assemble_gff3(X.read_gff3(spark, path)[0])
    else:
        if name.endswith(".psl"):
            p = X.read_psl(spark, path)[0].select(F.col("query_name").alias("transcript_id"), "chrom", "strand", "segments", none.alias("cds_genome_start"), none.alias("cds_genome_end"))
        else:
            coding = F.col("thick_end") > F.col("thick_start")
            p = X.read_bed(spark, path)[0].select(F.col("ID").alias("transcript_id"), "chrom", "strand", "segments", F.when(coding, F.col("thick_start")).alias("cds_genome_start"), F.when(coding, F.col("thick_end")).alias("cds_genome_end"))
        t = p.withColumn("gene_id", F.concat(F.lit("gene_"), "transcript_id"))
    return t.withColumnRenamed("transcript_id", "ID").withColumn("attr", attr)


def segments(chains: DataFrame, key: str = "ID") -> DataFrame:
    return chains.select(F.col(key), "chrom", "strand", F.explode("segments").alias("s")).select(key, "chrom", "strand", "s.start", "s.end")


def mapped(spark: SparkSession, path: str, mapping: str = "fiveprime", offset: str = "0", min_length: str = "25", max_length: str = "100") -> DataFrame:
    reads = alignments(spark, path).filter(M.size_filter(int(min_length), int(max_length)))
    if mapping.endswith("variable"):
        table, default = X.read_offsets(offset)
        return M.RULES[mapping](table, default)(reads)
    return M.RULES[mapping](*([] if mapping == "entire" else [int(offset)]))(reads)


def _masks(spark: SparkSession, path: str | None) -> DataFrame | None:
    return segments(annotation(spark, path)).select("chrom", "strand", "start", "end") if path else None


def counts_in_region(spark, out, reads, regions, masks=None, sum=None, **rule):
    counts = A.count_positions(mapped(spark, reads, **rule))
    total = float(sum) if sum else None
    K.write_table(R.counts_in_region(counts, segments(annotation(spark, regions)), "ID", _masks(spark, masks), total).withColumnRenamed("ID", "region_name"), out)


def get_count_vectors(spark, out, reads, regions, masks=None, **rule):
    counts = A.count_positions(mapped(spark, reads, **rule))
    m = _masks(spark, masks)
    K.write_vectors(R.count_vectors(counts if m is None else R.unmasked_sites(counts, m), annotation(spark, regions), "ID"), "ID", out)


def make_wiggle(spark, out, reads, output_format="bedgraph", normalize=None, **rule):
    counts = A.count_positions(mapped(spark, reads, **rule))
    counts = A.normalize(counts) if normalize else counts
    for strand, name in (("+", "fw"), ("-", "rc")):
        one = counts.filter(F.col("strand") == strand)
        lines = K.as_bedgraph(A.runs(one, window=100_000)) if output_format == "bedgraph" else K.as_variable_step(one)
        bed = output_format == "bedgraph"
        K.write_lines(lines, f"{out}/{name}", ["chrom", "start"] if bed else ["chrom", "tile", "start"], keep=None if bed else ["chrom", "tile"])


def cs_generate(spark, out, annotations, masks=None):
    t = annotation(spark, annotations)
    merged = G.merge_genes(segments(t.drop("attr"), "gene_id"))
    models = G.gene_models(t, merged, _masks(spark, masks))
    K.write_table(merged.orderBy("gene_id"), f"{out}/merged")
    models.write.mode("overwrite").parquet(f"{out}/models")
    K.write_gene_tables(spark.read.parquet(f"{out}/models"), out)


def cs_count(spark, out, generated, reads, **rule):
    K.write_table(G.gene_counts(A.count_positions(mapped(spark, reads, **rule)), spark.read.parquet(f"{generated}/models")).withColumnRenamed("merged_gene", "region"), out)


def cs_chart(spark, out, *tables, column="exon_reads"):
    """Tables of cs_count, one per sample."""
    rows = None
    for i, t in enumerate(tables):
        one = X.read_table(spark, t).select("region", F.lit(f"s{i}").alias("sample"), F.col(column).cast("double").alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    pairs = T.sample_pairs(rows, "region", "sample", "v")
    K.write_table(T.compare_samples(pairs), f"{out}/bigtable")
    K.write_table(T.binned_statistics(pairs), f"{out}/bintable")


def metagene_generate(spark, out, annotations, landmark="cds_start", upstream="50", downstream="50"):
    w = MG.landmark_windows(annotation(spark, annotations), "gene_id", landmark, int(upstream), int(downstream))
    w.write.mode("overwrite").parquet(f"{out}/windows")
    K.write_table(MG.roi_table(spark.read.parquet(f"{out}/windows"), "gene_id", int(upstream), int(downstream)).orderBy("region_id"), f"{out}/rois")


def metagene_count(spark, out, generated, reads, masks=None, min_counts="10", normalize_from="-30", normalize_to="20", **rule):
    counts = A.count_positions(mapped(spark, reads, **rule))
    values = MG.window_values(spark.read.parquet(f"{generated}/windows"), counts, "gene_id", _masks(spark, masks))
    K.write_table(MG.profile(values, "gene_id", (int(normalize_from), int(normalize_to)), float(min_counts)).orderBy("x"), out)


def psite(spark, out, generated, reads, min_length="25", max_length="35", min_counts="10", default="13", require_upstream=None):
    counts = A.count_positions(mapped(spark, reads, "fiveprime", "0", min_length, max_length), ["rlen"])
    values = MG.window_values(spark.read.parquet(f"{generated}/windows"), counts, "gene_id", by=["rlen"])
    p = MG.profile(values, "gene_id", (-30, 20), float(min_counts), ["rlen"])
    offsets = MG.psite_offsets(p, list(range(int(min_length), int(max_length) + 1)), int(default), require_upstream=bool(require_upstream))
    text = offsets.select(F.col("length").cast("string").alias("length"), "p_offset").unionByName(spark.createDataFrame([("default", int(default))], "length string, p_offset int"))
    K.write_table(text.coalesce(1), out)


def phase_by_size(spark, out, annotations, reads, codon_buffer="5", **rule):
    """``annotations`` may be a folder of metagene_generate: then the coding parts of its windows count, all but their last codon."""
    counts = A.count_positions(mapped(spark, reads, **rule), ["rlen"])
    if not annotations.removesuffix(".gz").endswith((".bed", ".gtf", ".gtf2", ".gff", ".gff3", ".psl")):
        r = X.read_table(spark, f"{annotations}/rois").select(F.col("region_id").alias("ID"), C.from_text("region").alias("c"), "alignment_offset", "zero_point").select("ID", "c.chrom", "c.strand", MG.roi_coding_part("c.segments", "c.strand", "alignment_offset", "zero_point").alias("segments"))
        return K.write_table(MG.phase_by_size(counts, r, "ID", int(codon_buffer), 1).orderBy("read_length"), out)
    t = annotation(spark, annotations).withColumn("b", C.cds_bounds("segments", "strand", "cds_genome_start", "cds_genome_end"))
    K.write_table(MG.phase_by_size(counts, t.filter("b is not null").select("ID", "chrom", "strand", C.get_cds("segments", "strand", "b").alias("segments")), "ID", int(codon_buffer)).orderBy("read_length"), out)


def crossmap(spark, out, fasta, read_length="29", offset="14", mismatches="0", tile=32_768):
    mers = S.kmers(X.tile_sequences(X.read_fasta(spark, fasta), tile), int(read_length), tile)
    m = S.repeat_mask(S.repeated_kmers(mers, int(mismatches)), int(read_length), int(offset))
    K.write_lines(K.as_bed(m.select("chrom", "strand", F.array(C.segment("start", "end")).alias("segments"), F.concat_ws(":", "chrom", "start", "strand").alias("ID"))), out)


def findjuncs(spark, out, annotations):
    j = J.find_junctions(annotation(spark, annotations), "ID")
    j.write.mode("overwrite").parquet(f"{out}/juncs")
    two = spark.read.parquet(f"{out}/juncs").select("chrom", "strand", F.array(C.segment("exon_start", "left"), C.segment("right", "exon_end")).alias("segments"), J.junction_name().alias("ID"))
    K.write_lines(K.as_bed(two), f"{out}/bed")


def slidejuncs(spark, out, query, fasta, known=None, masks=None, maxslide="10", tile=32_768):
    n = int(maxslide)
    j = J.find_junctions(annotation(spark, query), "ID").select("chrom", "strand", "left", "right")
    side = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("at")), F.struct(F.lit("r").alias("side"), F.col("right").alias("at"))))
    # Two nucleotides more, for the ends of introns at the outermost slides.
    ends = j.select(F.struct("chrom", "strand", "left", "right").alias("key"), "chrom", side.alias("x")).select(F.struct("key", "x.side").alias("k"), "chrom", F.lit("+").alias("strand"), (F.col("x.at") - n - 2).alias("start"), (F.col("x.at") + n + 2).alias("end"))
    genome = X.tile_sequences(X.read_fasta(spark, fasta), tile)
    two = S.segment_sequences(genome, ends, tile, "k").select("k.key", "k.side", F.upper("seq").alias("seq")).groupBy("key").agg(*[F.max(F.when(F.col("side") == s, F.col("seq"))).alias(s) for s in "lr"])
    cut = lambda c, a, k: F.substring(c, a + 1, k)
    right = F.translate("r", "N", "n")
    span = J.match_range(cut("l", 2, n), cut("l", n + 2, n), F.substring(right, 3, n), F.substring(right, n + 3, n), n)
    # Intron ends: two nucleotides from `left` on, the last two before `right`.
    q = two.select("key.*", "l", "r", span.alias("span")).withColumn("canonical", J.canonical_slides(F.col("l"), F.concat(F.lit("NN"), F.col("r")), F.col("strand"), F.col("span"), n + 2))
    nothing = q.select("chrom", "strand", "left", "right").limit(0)
    k = J.find_junctions(annotation(spark, known), "ID") if known else nothing
    m = _masks(spark, masks) if masks else nothing.select("chrom", "strand", F.col("left").alias("start"), F.col("right").alias("end"))
    done = J.classify(q, k, m).select("chrom", "strand", (F.col("left") + F.col("slide")).alias("left"), (F.col("right") + F.col("slide")).alias("right"), "kind").distinct()
    done.write.mode("overwrite").partitionBy("kind").parquet(out)


def gff_parent_types(spark, out, gff):
    f = X.read_gff3(spark, gff)[0].select(F.col("ID").alias("id"), F.coalesce("parents", F.expr("cast(array() as array<string>)")).alias("parents"), "feature_type")
    K.write_table(N.parent_table(N.parent_types(f)), out)


def reformat_transcripts(spark, out, annotations, output_format="bed"):
    t = annotation(spark, annotations)
    make = {"bed": lambda d: K.as_bed(d, thick=("cds_genome_start", "cds_genome_end")), "gtf": K.transcript_as_gtf, "gff3": K.transcript_as_gff3}
    K.write_lines(make[output_format](t), out)


def test_table_equality(spark, out, a, b, keys, tolerance="1e-8"):
    K.write_table(T.table_differences(X.read_table(spark, a), X.read_table(spark, b), keys.split(","), float(tolerance)).withColumn("differing", F.array_join("differing", ",")), out)


PROGRAMS = {f.__name__: f for f in (counts_in_region, get_count_vectors, make_wiggle, cs_generate, cs_count, cs_chart, metagene_generate, metagene_count, psite, phase_by_size, crossmap, findjuncs, slidejuncs, gff_parent_types, reformat_transcripts, test_table_equality)}


def main(args: list[str]) -> None:
    if not args or args[0] not in PROGRAMS:
        sys.exit(f"{__doc__}\nNames: {', '.join(PROGRAMS)}")
    from strandloom.session import get_spark

    options, rest, i = {}, [], 1
    while i < len(args):
        if args[i].startswith("--"):
            options[args[i][2:].replace("-", "_")] = args[i + 1]
            i += 2
        else:
            rest.append(args[i])
            i += 1
    spark = SparkSession.getActiveSession() or get_spark()
    PROGRAMS[args[0]](spark, *rest, **options)


if __name__ == "__main__":
    main(sys.argv[1:])
