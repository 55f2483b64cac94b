"""Streaming forms of accumulation and assembly."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate_sites(mapped: DataFrame) -> DataFrame:
    """Running sums per site of a stream of mapped reads; write in ``update`` or ``complete`` mode."""
    return mapped.groupBy("chrom", "strand", "pos").agg(F.sum("weight").alias("value"))


def windowed_sites(mapped: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sums per site and event-time window; windows close when the watermark has passed, so state is bounded."""
    return mapped.withWatermark(time, late).groupBy(F.window(time, width), "chrom", "strand", "pos").agg(F.sum("weight").alias("value"))


def assemble_on_close(features: DataFrame, time: str, gap: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Transcripts of a stream of feature rows: the rows of a transcript_id that come within ``gap`` of each other form one session and are emitted when it is over."""
    rows = features.withWatermark(time, late)
    w = F.session_window(time, gap)
    return rows.groupBy(w, "transcript_id", "chrom", "strand").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("segments")).select("transcript_id", "chrom", "strand", "segments")


def assemble_on_punctuation(lines: DataFrame, file: str = "file", number: str = "number", sorted_by_chrom: bool = False) -> DataFrame:
    """Transcripts of a stream of GFF3 lines (file, number, line), emitted as soon as nothing more of them can come.

    A line ``###`` and, of files ``sorted_by_chrom``, a change of chrom say that what came before is complete; a file ends with ``##FASTA`` or ``##end``. Lines that
    are still open wait in the state of their file, which holds no more than one stretch between such marks. Result: transcript_id, chrom, strand, segments.
    """
    schema = "transcript_id string, chrom string, strand string, segments array<struct<start:bigint,end:bigint>>"

    def parse(line: str):
        f = line.split("\t")
        if len(f) < 9 or f[2] != "exon":
            return None
        parent = next((p.split("=", 1)[1] for p in f[8].split(";") if p.strip().startswith("Parent=")), None)
        return [(p, f[0], f[6], int(f[3]) - 1, int(f[4])) for p in parent.split(",")] if parent else None

    def whole(held: list) -> list[tuple]:
        out: dict = {}
        for t, c, s, a, b in held:
            out.setdefault((t, c, s), set()).add((a, b))
        return [(*k, [{"start": a, "end": b} for a, b in sorted(v)]) for k, v in out.items()]

    def f(key, batches, state):
        import pandas as pd

        held, chrom = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values(number)
        out: list[tuple] = []
        held = [tuple(x) for x in json.loads(held[0])] if held else []
        for line in rows["line"]:
            mark = line.startswith("###") or line.startswith(("##FASTA", "##end"))
            here = line.split("\t", 1)[0] if "\t" in line and not line.startswith("#") else None
            if mark or (sorted_by_chrom and here and chrom and here != chrom):
                out += whole(held)
                held = []
            chrom = here or chrom
            held += [] if mark else parse(line) or []
        state.update(([json.dumps(held)], chrom))
        yield pd.DataFrame(out, columns=["transcript_id", "chrom", "strand", "segments"])

    return lines.select(file, number, "line").groupBy(file).applyInPandasWithState(f, schema, "held array<string>, chrom string", "append", "NoTimeout")


def tee(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Starts a query that hands every micro-batch to all sinks. The batch is held once."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for s in sinks:
                s(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
