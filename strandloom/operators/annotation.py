"""Transcripts from annotation rows, attributes shared by features, audits of parent types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import chains as C

#: Feature types that make exons, and those that make the coding region.
EXON_TYPES = ("exon", "5UTR", "3UTR", "CDS", "start_codon", "stop_codon")
CDS_TYPES = ("CDS", "start_codon", "stop_codon")
#: Types of transcripts, exons and coding regions in GFF3, as the Sequence Ontology (2.5.3) names them.
TRANSCRIPT_TYPES = tuple("""
transcript mature_transcript enzymatic_RNA mRNA mRNA_with_frameshift mRNA_with_minus_1_frameshift mRNA_with_minus_2_frameshift mRNA_with_plus_1_frameshift mRNA_with_plus_2_frameshift
polyadenylated_mRNA polycistronic_mRNA dicistronic_mRNA monocistronic_mRNA recoded_mRNA mRNA_recoded_by_codon_redefinition mRNA_recoded_by_translational_bypass trans_spliced_mRNA
ncRNA antisense_RNA MicF_RNA class_I_RNA class_II_RNA enhancerRNA guide_RNA lnc_RNA antisense_lncRNA intronic_lncRNA lincRNA piRNA priRNA rasiRNA RNase_MRP_RNA RNase_P_RNA
rRNA large_subunit_rRNA rRNA_21S rRNA_23S rRNA_25S rRNA_28S rRNA_5_8S rRNA_5S small_subunit_rRNA rRNA_16S rRNA_18S rRNA_cleavage_RNA
scRNA shRNA siRNA small_regulatory_ncRNA CsrB_RsmB_RNA DsrA_RNA GcvB_RNA IoR miRNA moR OxyS_RNA RNA_6S RprA_RNA RRE_RNA spot42_RNA tmRNA
snoRNA C_D_box_snoRNA methylation_guide_snoRNA U14_snoRNA U3_snoRNA H_ACA_box_snoRNA pseudouridylation_guide_snoRNA
snRNA U11_snRNA U12_snRNA U1_snRNA U2_snRNA U4_snRNA U4atac_snRNA U5_snRNA U6_snRNA U6atac_snRNA SRP_RNA tasiRNA telomerase_RNA telomeric_transcript anti_ARRET ARIA ARRET TERRA
tRNA alanyl_tRNA arginyl_tRNA asparaginyl_tRNA aspartyl_tRNA cysteinyl_tRNA glutaminyl_tRNA glutamyl_tRNA glycyl_tRNA histidyl_tRNA isoleucyl_tRNA leucyl_tRNA lysyl_tRNA methionyl_tRNA
phenylalanyl_tRNA prolyl_tRNA pyrrollysyl_tRNA selenocysteinyl_tRNA seryl_tRNA threonyl_tRNA tryptophanyl_tRNA tyrosyl_tRNA valyl_tRNA vault_RNA Y_RNA
edited_transcript edited_mRNA edited_transcript_by_A_to_I_substitution non_functional_homolog_of_pseudogenic_transcript pseudogenic_transcript
""".split())
GFF3_EXON_TYPES = tuple("exon coding_exon noncoding_exon exon_of_single_exon_gene interior_exon interior_coding_exon five_prime_coding_exon three_prime_coding_exon five_prime_noncoding_exon three_prime_noncoding_exon pseudogenic_exon".split())
GFF3_CDS_TYPES = ("CDS", "CDS_fragment", "CDS_indpendently_known", "CDS_predicted")


def identical_attributes(features: DataFrame, key: str, attr: str = "attr") -> DataFrame:
    """(key, attr): the attributes that all features of a key have with the same value."""
    n = features.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    each = features.select(key, F.explode(attr).alias("k", "v")).groupBy(key, "k").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = each.join(n, key).filter("m = n and lo = hi").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "lo")))).alias("attr"))
    return n.select(key).join(same, key, "left").select(key, F.coalesce("attr", F.expr("cast(map() as map<string,string>)")).alias("attr"))


def assemble_transcripts(features: DataFrame, key: str = "transcript_id", gene: str = "gene_id", exon_types: tuple[str, ...] = EXON_TYPES, cds_types: tuple[str, ...] = CDS_TYPES) -> tuple[DataFrame, DataFrame]:
    """(transcripts, rejects) from rows key, gene, chrom, strand, feature_type, start, end (0-based, half-open).

    A transcript has ``segments``, ``cds_genome_start``, ``cds_genome_end`` (null if nothing is coded) and the gene that all its rows name.
    Transcripts on more than one chrom or strand, and those whose coding region leaves their exons, are rejected with the ``reason``. Rows of other
    types and rows with null key, bounds or ``end <= start`` are ignored. One aggregation per transcript; segments are gathered as a set.
    """
    rows = features.filter(F.col(key).isNotNull() & (F.col("end") > F.col("start")) & F.col("feature_type").isin(*exon_types))
    coding = F.col("feature_type").isin(*cds_types)
    g = rows.groupBy(key).agg(
        F.min("chrom").alias("chrom"),
        F.max("chrom").alias("__c"),
        F.min("strand").alias("strand"),
        F.max("strand").alias("__s"),
        F.when(F.min(gene) == F.max(gene), F.min(gene)).alias(gene),
        C.merge_segments(F.collect_set(C.segment("start", "end"))).alias("segments"),
        F.min(F.when(coding, F.col("start"))).alias("cds_genome_start"),
        F.max(F.when(coding, F.col("end"))).alias("cds_genome_end"),
    )
    mixed = (F.col("chrom") != F.col("__c")) | (F.col("strand") != F.col("__s"))
    outside = F.col("cds_genome_start").isNotNull() & (C.chain_coordinate("segments", "strand", "cds_genome_start").isNull() | C.chain_coordinate("segments", "strand", F.col("cds_genome_end") - 1).isNull())
    g = g.withColumn("reason", F.when(mixed, "more than one chrom or strand").when(outside, "coding region outside exons")).drop("__c", "__s")
    return g.filter("reason is null").drop("reason"), g.filter("reason is not null").select(key, "reason")


def assemble_gff3(features: DataFrame, transcript_types: tuple[str, ...] = TRANSCRIPT_TYPES, exon_types: tuple[str, ...] = GFF3_EXON_TYPES, cds_types: tuple[str, ...] = GFF3_CDS_TYPES) -> tuple[DataFrame, DataFrame]:
    """(transcripts, rejects) from GFF3 features (chrom, strand, feature_type, start, end, ID, parents).

    A child with several parents belongs to each; an exon or CDS without parents forms a transcript of its own ID. Transcripts without
    such children do not come out; the gene is the transcript feature's parent. Coding rows count as exons where exons are missing.
    """
    parts = features.filter(F.col("feature_type").isin(*exon_types, *cds_types))
    owners = F.when(F.size("parents") > 0, F.col("parents")).otherwise(F.array("ID"))
    rows = parts.withColumn("transcript_id", F.explode_outer(owners)).withColumn("gene_id", F.lit(None).cast("string")).withColumn("feature_type", F.when(F.col("feature_type").isin(*cds_types), "CDS").otherwise("exon"))
    ok, bad = assemble_transcripts(rows.select("transcript_id", "gene_id", "chrom", "strand", "feature_type", "start", "end"))
    genes = features.filter(F.col("feature_type").isin(*transcript_types) & F.col("ID").isNotNull()).groupBy(F.col("ID").alias("transcript_id")).agg(F.min(F.array_join(F.array_sort("parents"), ",")).alias("gene_id"))
    return ok.drop("gene_id").join(genes, "transcript_id", "left"), bad


def parent_types(features: DataFrame, exclude: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(feature_type, parent_type, n) of rows id, parents (array), feature_type: the type of the parent, else ``parent unspecified``, ``parent not in database`` or ``multiple parents``."""
    f = features if not exclude else features.filter(~F.col("feature_type").isin(*exclude))
    f = f if not keep else f.filter(F.col("feature_type").isin(*keep))
    types = f.filter("id is not null").groupBy("id").agg(F.min("feature_type").alias("ptype"))
    none = F.coalesce(F.size("parents"), F.lit(0)) < 1
    x = f.select("feature_type", F.when(none, "parent unspecified").when(F.size("parents") > 1, "multiple parents").alias("fixed"), F.when(F.size("parents") == 1, F.get("parents", F.lit(0))).alias("pid"))
    j = x.join(types, F.col("pid") == F.col("id"), "left")
    return j.groupBy("feature_type", F.coalesce("fixed", "ptype", F.lit("parent not in database")).alias("parent_type")).agg(F.count(F.lit(1)).alias("n"))


def parent_table(counts: DataFrame) -> DataFrame:
    """The contingency table of :func:`parent_types`, one column per parent type."""
    return counts.groupBy("feature_type").pivot("parent_type").agg(F.sum("n"))


# Attribute columns of GTF2 and GFF3.
def escape(c: Column | str, gtf: bool = False) -> Column:
    """Percent signs, separators (``; , = &``, quotes in GTF2) and all control characters by their code."""
    special = "[%;,=&\\x00-\\x1f\\x7f-\\x9f" + ('"]' if gtf else "]")
    one = lambda x: F.when(x.rlike(special), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)
    c = C.col(c)
    return F.when(c.rlike(special), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _grouped(pairs: Column) -> Column:
    """A map of key/value structs; values of a repeated key are joined by commas."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), ",")))


def gff3_parents(c: Column | str) -> Column:
    """The values of Parent, escapes undone after the list is split, so that an escaped comma is part of an ID; null without one."""
    from strandloom.tables import percent_decoded

    raw = F.nullif(F.trim(F.regexp_extract(C.col(c), r"(?:\A|;)\s*Parent\s*=([^;]*)", 1)), F.lit(""))
    return F.transform(F.split(raw, ","), lambda x: percent_decoded(F.trim(x)))


def parse_gff3_attributes(c: Column | str) -> Column:
    """``k=v;k=v`` as a map, escapes undone; lists stay as comma-separated texts."""
    from strandloom.tables import percent_decoded

    parts = F.filter(F.transform(F.split(C.col(c), ";"), lambda p: F.trim(p)), lambda p: p.contains("="))
    return _grouped(F.transform(parts, lambda p: F.struct(percent_decoded(F.trim(F.substring_index(p, "=", 1))).alias("k"), percent_decoded(F.trim(F.substr(p, F.position(F.lit("="), p) + 1))).alias("v"))))


def parse_gtf_attributes(c: Column | str) -> Column:
    """``key "value"; key value;`` as a map; separators inside quotes belong to the value."""
    from strandloom.tables import percent_decoded

    whole = F.regexp_extract_all(C.col(c), F.lit(r'([^\s;"]+\s+(?:"[^"]*+"|[^;"]*+))\s*(?:;|$)'), F.lit(1))
    return _grouped(F.transform(whole, lambda p: F.struct(F.regexp_extract(p, r"\A(\S+)", 1).alias("k"), percent_decoded(F.btrim(F.regexp_replace(p, r"\A\S+\s+", ""), F.lit('" '))).alias("v"))))


def format_gff3_attributes(attr: Column | str, exclude: list[str] | None = None) -> Column:
    kept = F.filter(F.array_sort(F.map_entries(C.col(attr))), lambda e: ~e["key"].isin(*(exclude or [""])))
    return F.array_join(F.transform(kept, lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"]))), ";")


def format_gtf_attributes(attr: Column | str, exclude: list[str] | None = None) -> Column:
    """gene_id and transcript_id first."""
    a = C.col(attr)
    first = F.transform(F.array(F.lit("gene_id"), F.lit("transcript_id")), lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(a, k), F.lit("")).alias("value")))
    rest = F.filter(F.array_sort(F.map_entries(a)), lambda e: ~e["key"].isin("gene_id", "transcript_id", *(exclude or [])))
    entry = lambda e: F.concat(e["key"], F.lit(' "'), escape(e["value"], True), F.lit('";'))
    return F.array_join(F.transform(F.concat(first, rest), entry), " ")
