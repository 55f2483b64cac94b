"""Mixtures of sources with target shares of the total size in tokens, by entropy balancing."""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialize

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks of documents of one source and size are taken in so many hash buckets, so that a frequent size is no single task.
RANK_BUCKETS = 64
NEWTON_STEPS = 60
TOLERANCE = 1e-9


def source_name(c):
    """Sources compare without case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"\A\s+|\s+\z", ""))


def count_tokens(docs: DataFrame, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """docs without ``text``, with ``tokens``: the length of the whole text under the vocabulary at ``path``; 0 for null.

    The vocabulary (under 1 MB) is read once on the driver and broadcast.
    """
    with open(path, "rb") as fh:
        held = docs.sparkSession.sparkContext.broadcast(fh.read())
    rest = docs.drop("tokens", text)
    kept = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "tokens bigint"])

    def f(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], names=[*kept, "tokens"])

    return docs.select(*kept, text).mapInArrow(f, schema)


def solve_rates(cells: DataFrame, wanted: dict[str, float], caps: dict[str, int]) -> dict[str, tuple[float, float, bool]]:
    """Per source (multiplier, mean size, whether the steps converged): a document of t tokens gets the rate min(cap, exp(multiplier * t / mean)).

    ``cells`` has source, tokens, n. Rates are as near as possible to one each in relative entropy, under the
    constraint that a source's expected tokens are ``wanted``: the dual has one multiplier per source and is solved by
    Newton steps, kept within a bracket; each step sums over the cells once, in parallel.
    An infinite multiplier stands for the cap itself.
    """
    means = {r["source"]: r["m"] for r in cells.groupBy("source").agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    full = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).collect()}
    done: dict[str, float] = {s: math.inf for s in wanted if wanted[s] >= caps[s] * full[s] * (1 - 1e-12)}
    done |= {s: -math.inf for s in wanted if wanted[s] <= 0}
    lam = {s: 0.0 for s in wanted if s not in done}
    low, high = {s: -math.inf for s in lam}, {s: math.inf for s in lam}
    for _ in range(NEWTON_STEPS):
        if not lam:
            break
        table = lambda d: F.element_at(F.create_map(*[F.lit(x) for s, v in d.items() for x in (s, float(v))]), F.col("source"))
        z = F.col("tokens") / table({s: means[s] for s in lam})
        # The exponent is bounded, as the rate is cut at the cap anyway.
        rate = F.exp(F.least(table(lam) * z, F.lit(50.0)))
        cap = table({s: caps[s] for s in lam})
        size = F.col("n") * F.col("tokens")
        sums = cells.filter(F.col("source").isin(*lam)).groupBy("source").agg(F.sum(size * F.least(rate, cap)).alias("g"), F.sum(F.when(rate < cap, size * z * rate).otherwise(0.0)).alias("h"))
        for r in sums.collect():
            s, g, h = r["source"], r["g"] - wanted[r["source"]], r["h"]
            if abs(g) <= TOLERANCE * wanted[s]:
                done[s] = lam.pop(s)
                continue
            if g > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - g / h if h > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 5:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else lam[s] + math.copysign(1.0, -g)
            lam[s] = step
    return {s: (v, means.get(s, 1.0), s in done) for s, v in (done | lam).items()}


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", total_tokens: int | None = None, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}") -> tuple[DataFrame, DataFrame]:
    """(documents with ``n_copies`` > 0, shares reached per source).

    ``docs`` has ``key``, ``source`` and ``text``, ``targets`` has ``source``, ``target_share`` and ``max_repeats``. Each source
    gets its share of the mixture's tokens; no document occurs more than ``max_repeats`` times. Sources without
    documents cannot contribute: the shares of the others are scaled to sum to one, and the report shows the share that
    was missed. Without ``total_tokens`` the mixture is the largest in which every share can be met
    under the repeat limits; with it, a source too small for its share gives all it may.

    Documents of a source that is no target, or null, and texts of no tokens are left out of the mixture; a source named
    twice in ``targets`` counts once (largest share). ``converged`` in the report is false for a source whose multiplier is not within the
    tolerance after :data:`NEWTON_STEPS`. Rates from :func:`solve_rates` are rounded by systematic sampling over
    the documents of a source in order of size, so that a source misses its tokens by less than two documents.
    """
    goal = targets.filter("source is not null and target_share is not null").select(source_name("source").alias("source"), F.col("target_share").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    # One row per source of the mixture: as small as the list of targets that the caller states.
    goals = {}
    for r in goal.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect():
        goals[r["source"]] = (r["target_share"], r["max_repeats"])
    named = docs.select(F.col(key).alias("key"), source_name("source").alias("source"), F.col("text")).filter(F.col("source").isin(*goals) if goals else F.lit(False))
    sized = materialize(count_tokens(named, "text", tokenizer).filter("tokens > 0"), "sized")
    cells = materialize(sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "cells")
    have = {r["source"]: (r["t"], r["n"]) for r in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    usable = {s: v for s, v in goals.items() if s in have and v[0] > 0 and v[1] > 0}
    scale = sum(v[0] for v in usable.values()) or 1.0
    room = {s: usable[s][1] * have[s][0] for s in usable}
    total = total_tokens if total_tokens is not None else min((room[s] * scale / usable[s][0] for s in usable), default=0)
    wanted = {s: min(total * usable[s][0] / scale, room[s]) for s in usable}
    rates = solve_rates(cells, wanted, {s: usable[s][1] for s in usable}) if usable else {}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, float(v), float(m), int(usable[s][1])) for s, (v, m, _) in rates.items()], "source string, lam double, mean double, cap int")
    rate = F.when(F.col("lam") == math.inf, F.col("cap").cast("double")).when(F.col("lam") == -math.inf, 0.0).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(50.0))), F.col("cap").cast("double")))
    bucket = F.pmod(F.xxhash64(F.col("key")), F.lit(RANK_BUCKETS)).cast("int")
    # Offsets of systematic sampling: over sizes, then over the buckets of a size, then over its documents.
    rated = cells.join(F.broadcast(plan), "source").withColumn("rate", rate).withColumn("part", F.col("rate") - F.floor("rate"))
    by_size = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("part") * F.col("n")).over(by_size), F.lit(0.0))).select("source", "tokens", "rate", "part", "before")
    placed = sized.withColumn("b", bucket)
    by_bucket = Window.partitionBy("source", "tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "tokens", "b").agg(F.count(F.lit(1)).alias("m")).withColumn("r0", F.coalesce(F.sum("m").over(by_bucket), F.lit(0))).drop("m")
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "b").orderBy(F.xxhash64("key"), "key"))
    offsets = offsets.join(rated, ["source", "tokens"])
    docs_out = placed.withColumn("r", rank).join(offsets, ["source", "tokens", "b"])
    upto = F.col("before") + F.col("part") * (F.col("r0") + F.col("r"))
    extra = F.floor(upto + 0.5) - F.floor(upto - F.col("part") + 0.5)
    mixture = docs_out.select(F.col("key").alias(key), "source", "tokens", (F.floor("rate") + extra).cast("int").alias("n_copies")).filter("n_copies > 0")
    mixture = materialize(mixture, "mixture")
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_copies")).alias("mixture_tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_copies").alias("n_copies"), F.max("n_copies").alias("most_copies"))
    report = spark.createDataFrame([(s, float(v[0]), int(v[1]), int(have.get(s, (0, 0))[0]), rates[s][2] if s in rates else True) for s, v in goals.items()], "source string, target_share double, max_repeats int, available_tokens bigint, converged boolean")
    whole = got.select(F.sum("mixture_tokens")).scalar()
    report = report.join(F.broadcast(got), "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("mixture_tokens", F.lit(0)).alias("mixture_tokens"), F.coalesce(F.try_divide(F.col("mixture_tokens").cast("double"), whole), F.lit(0.0)).alias("reached_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "converged"
    )
    return mixture, report
