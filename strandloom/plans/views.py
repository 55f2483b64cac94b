"""Genomic views of the stored star-schema tables.

The same text runs in Spark and in DuckDB, so queries and their SQL checks start from equal rows. Only integer
arithmetic is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Base tables the views read.
BASE = ("part", "lineitem", "supplier", "orders", "events")

VIEWS = {
    # Two isoforms per gene on five chromosomes; some neighbours overlap, some share exons.
    "gene": """SELECT g, chrom, CASE WHEN slot % 4 < 2 THEN '+' ELSE '-' END AS strand,
 1000 + slot * 1500 - CASE WHEN slot % 16 = 3 THEN 1500 WHEN slot % 8 = 1 THEN 600 ELSE 0 END AS base
 FROM (SELECT g, concat('chr', CAST(g % 5 AS STRING)) AS chrom, CAST((g - g % 5) / 5 AS BIGINT) AS slot
 FROM (SELECT DISTINCT CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS g FROM part) t) u""",
    # Three exons per transcript, genomic coding bounds.
    "seg": """SELECT concat('tx', CAST(p_partkey AS STRING)) AS tx_id, concat('g', CAST(gene.g AS STRING)) AS gene_id, chrom, strand, n AS exon_no,
 base + CASE n WHEN 0 THEN 0 WHEN 1 THEN 400 ELSE 800 END AS seg_start,
 base + CASE n WHEN 0 THEN 200 + (gene.g % 7) * 10 WHEN 1 THEN 550 + 30 * (p_partkey % 2) ELSE 1100 + (gene.g % 5) * 20 END AS seg_end,
 base + 60 AS cds_start, base + 950 AS cds_end
 FROM part p JOIN gene ON CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) = gene.g CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    # Reads of 25 to 35 nt, a third spliced: k is the first block's length, gap the intron's.
    "reads": """SELECT chrom, CASE WHEN l_linestatus = 'F' THEN strand ELSE CASE WHEN strand='+' THEN '-' ELSE '+' END END AS strand,
 base + (l_orderkey * 31 + l_linenumber * 7) % 1000 AS start, 25 + CAST(l_quantity AS BIGINT) % 11 AS rlen,
 CASE WHEN l_returnflag = 'R' THEN 10 + l_linenumber ELSE 0 END AS k, CASE WHEN l_returnflag = 'R' THEN 100 + 10 * l_linenumber ELSE 0 END AS gap
 FROM lineitem l JOIN gene ON CAST((l_partkey - l_partkey % 2) / 2 AS BIGINT) = gene.g""",
    # 20 to 49 nt inside third exons.
    "masks": """SELECT concat('m', CAST(s_suppkey AS STRING)) AS mask_id, chrom, strand, base + 820 + s_suppkey % 50 AS start, base + 840 + s_suppkey % 50 + s_suppkey % 30 AS end_
 FROM supplier s JOIN gene ON gene.g = s_suppkey * 10 + s_suppkey % 10""",
    # Pseudo-random sequence in tiles of 32 nt.
    "genome": """SELECT concat('chr', CAST(c AS STRING)) AS chrom, CAST(t AS BIGINT) AS tile_no, translate(md5(concat('chr', CAST(c AS STRING), ':', CAST(t AS STRING))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq
 FROM (SELECT DISTINCT o_orderkey AS t FROM orders) a CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) b""",
    # A sparse quantitative track of integer values.
    "track": """SELECT chrom, strand, pos, CAST(sum(value) AS BIGINT) AS value FROM (SELECT concat('chr', CAST(user_id % 5 AS STRING)) AS chrom, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
 1000 + (event_id * 13) % 3000 AS pos, CAST(floor(value) AS BIGINT) AS value FROM events) e GROUP BY chrom, strand, pos""",
}
_NEEDS = {"seg": ["gene"], "reads": ["gene"], "masks": ["gene"]}


def ctes(*names: str) -> str:
    """``WITH`` clause (open for more) that defines the views named, and those they need."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet files in sf_dir."""
    text = f"{ctes(name)} SELECT * FROM {name}"
    for t in BASE:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)
