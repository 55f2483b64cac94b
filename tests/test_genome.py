from strandloom.plans.genome import genome


def test_transcripts_of_unclean_ids(spark, tmp_path):
    """Rows count for the transcript that their id names once cleaned; placeholders name none."""
    ids = ["YT-1.2", ' "YT-1.2" ', "YT%2D1.2", "  YT-7.1", '"x y"', "nan", " ", None]
    rows = [("chr1", "CDS" if i == 2 else "exon", 1 + 100 * i, 50 + 100 * i, "+", "g", t) for i, t in enumerate(ids)]
    spark.createDataFrame(rows, "seqname string, feature_type string, seg_start bigint, seg_end bigint, strand string, gene_id string, transcript_id string").write.parquet(f"{tmp_path}/gtf2.parquet")
    spark.createDataFrame([("1", "chr1")], "chrom_alias string, chrom string").write.parquet(f"{tmp_path}/chrom_aliases.parquet")
    got = {tuple(r) for r in genome.queries["assemble_transcripts"](spark, str(tmp_path)).collect()}
    assert got == {("YT-1.2", 150, 200, 250), ("YT-7.1", 50, None, None), ("x y", 50, None, None)}
