"""Runs of equal or nearly equal consecutive events, each collapsed into one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize

#: Sequence numbers per chunk; bounds what one task sorts and holds at a time.
CHUNK = 1 << 15
_NONE = np.iinfo(np.int64).min


def _codes(col: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.dictionary_encode(col, null_encoding="encode").combine_chunks().indices, -1).to_numpy(zero_copy_only=False)


def _chunk_runs(least: int, tolerance: int):
    def f(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        seq = t.column("seq").to_numpy()
        keep = np.ones(len(seq), bool)
        keep[1:] = seq[1:] != seq[:-1]  # a read delivered twice is one read
        t, seq = t.filter(pa.array(keep)), seq[keep]
        s, e, at = (pc.fill_null(t.column(c), _NONE).to_numpy() for c in ("s", "e", "at"))
        chrom, strand = _codes(t.column("chrom")), _codes(t.column("strand"))
        starts = np.ones(len(seq), bool)
        same = (chrom[1:] == chrom[:-1]) & (strand[1:] == strand[:-1])
        starts[1:] = ~(same & (np.abs(s[1:] - s[:-1]) <= tolerance) & (np.abs(e[1:] - e[:-1]) <= tolerance))
        # Run starts as a sorted array of the chunk; each event belongs to the last start at or before it.
        heads = np.flatnonzero(starts)
        run = np.searchsorted(seq[heads], seq, side="right") - 1
        n = np.bincount(run, minlength=len(heads))
        tails = heads + n - 1
        t0 = np.minimum.reduceat(np.where(at == _NONE, np.iinfo(np.int64).max, at), heads)
        t1 = np.maximum.reduceat(at, heads)
        first, last = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
        first[0], last[-1] = True, True
        pick = np.flatnonzero(first | last | (n >= least))
        h, z = heads[pick], tails[pick]
        timed = t1[pick] != _NONE
        cols = {
            "lane": pa.array([key[0].as_py()] * len(pick), t.schema.field("lane").type),
            "chunk": pa.array(np.full(len(pick), key[1].as_py(), np.int64)),
            "first_seq": pa.array(seq[h]),
            "last_seq": pa.array(seq[z]),
            "n": pa.array(n[pick].astype(np.int64)),
            "t0": pa.array(t0[pick], mask=~timed),
            "t1": pa.array(t1[pick], mask=~timed),
            "is_first": pa.array(first[pick]),
            "is_last": pa.array(last[pick]),
            "chrom": t.column("chrom").take(pa.array(h)),
            "strand": t.column("strand").take(pa.array(h)),
            "s0": pa.array(s[h]),
            "e0": pa.array(e[h]),
            "s1": pa.array(s[z]),
            "e1": pa.array(e[z]),
        }
        return pa.table(cols)

    return f


def collapse_runs(
    reads: DataFrame,
    entity: str = "lane_id",
    seq: str = "seq_no",
    chrom: str = "chrom",
    strand: str = "strand",
    start: str = "seg_start",
    end: str = "seg_end",
    time: str | None = "acquired_at",
    tolerance: int = 3,
    least: int = 1,
    chunk: int = CHUNK,
) -> DataFrame:
    """Each run of consecutive like reads as one row: entity, ``first_seq_no``, ``last_seq_no``, ``n_reads``, ``duration_us``, ``chrom``, ``strand``, ``seg_start``, ``seg_end`` (of the first read).

    A read continues the run of the read before it (by ``seq``) if chrom and strand are equal and both bounds
    differ by at most ``tolerance`` from that read's. Reads with a null bound or sequence number are skipped and do not
    interrupt a run; a sequence number that occurs twice in an entity is one read; null chroms, strands and entities
    are equal to each other. Runs shorter than ``least`` are left out. ``duration_us`` is null where no
    read has a time. Other columns are not looked at; an empty table gives an empty result.

    An entity is cut into chunks of sequence numbers, so that a hot one is spread over tasks. In a chunk, run starts
    form a sorted array in which each read is looked up by binary search; of every chunk only the
    first and last run go on to be joined across chunk borders.
    """
    t = F.unix_micros(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")
    rows = reads.select(F.col(entity).alias("lane"), F.col(seq).cast("long").alias("seq"), F.col(chrom).alias("chrom"), F.col(strand).alias("strand"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), t.alias("at"))
    rows = rows.filter("seq is not null and s is not null and e is not null").withColumn("chunk", F.floor(F.col("seq") / chunk))
    lane = dict(rows.dtypes)["lane"]
    schema = f"lane {lane}, chunk long, first_seq long, last_seq long, n long, t0 long, t1 long, is_first boolean, is_last boolean, chrom string, strand string, s0 long, e0 long, s1 long, e1 long"
    # Written once: inner runs and those at the borders are two branches, each of which would scan and shuffle all rows.
    parts = materialize(rows.groupBy("lane", "chunk").applyInArrow(_chunk_runs(least, tolerance), schema), "runs")
    inner = parts.filter("not is_first and not is_last")
    w = Window.partitionBy("lane").orderBy("chunk", "first_seq")
    before = lambda c: F.lag(c).over(w)
    near = (F.abs(F.col("s0") - before("s1")) <= tolerance) & (F.abs(F.col("e0") - before("e1")) <= tolerance)
    goes_on = F.col("is_first") & F.coalesce(before("chrom").eqNullSafe(F.col("chrom")) & before("strand").eqNullSafe(F.col("strand")) & near, F.lit(False))
    edges = parts.filter("is_first or is_last").withColumn("new", (~goes_on).cast("int")).withColumn("run", F.sum("new").over(w))
    joined = edges.groupBy("lane", "run").agg(
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("n").alias("n"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.min_by(F.struct("chrom", "strand", "s0", "e0"), "first_seq").alias("h"),
    )
    cols = ["lane", "first_seq", "last_seq", "n", "t0", "t1", "chrom", "strand", "s0", "e0"]
    every = inner.select(*cols).unionByName(joined.select(*cols[:6], "h.chrom", "h.strand", "h.s0", "h.e0"))
    return every.filter(F.col("n") >= least).select(
        F.col("lane").alias(entity), F.col("first_seq").alias("first_seq_no"), F.col("last_seq").alias("last_seq_no"), F.col("n").alias("n_reads"), (F.col("t1") - F.col("t0")).alias("duration_us"), "chrom", "strand", F.col("s0").alias("seg_start"), F.col("e0").alias("seg_end")
    )
