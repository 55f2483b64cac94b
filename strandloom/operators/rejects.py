"""Typed loading of delimited lines, with the rows that fail to parse set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.tables import once

#: Columns of a flattened axt record, in order.
AXT_FIELDS = ("aln_no", "tName", "tStart", "tEnd", "qName", "qStart", "qEnd", "qStrand", "score", "symCount", "tSym", "qSym")

# Possessive, so that Java's matcher loops instead of recursing: long lines do not overflow the stack.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^"\t][^\t]*+|)'
_WELL_QUOTED = rf"\A{_FIELD}(?:\t{_FIELD})*+\z"


def split_quoted(line: Column) -> Column:
    """The tab-separated fields of a well quoted line, quotes undone. Lines without a quote are merely split."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({_FIELD})"), F.lit(1))
    undone = F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(line.contains('"'), undone).otherwise(F.split(line, "\t", -1))


def _digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def _number(c: Column) -> Column:
    """Value of a digit string; null beyond 38 significant digits."""
    return F.when(_digits(c), F.coalesce(F.regexp_replace(c, r"\A0+(?=[0-9])", ""), F.lit("0")).try_cast("decimal(38,0)"))


def parse_axt_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """Every line with ``fields`` (typed struct), ``errors`` (array of rules broken) and ``fail_reason``.

    A line is loaded as nullable text, the rules are evaluated as column expressions into
    ``errors``; a row with an empty array is valid. ``fail_reason`` is the first of ``quoting``,
    ``columns``, ``value`` that applies, null for valid rows. Null and blank lines and comments
    (``#`` at the start) are left out. All other columns of ``lines`` are kept, those
    called ``fields``, ``errors`` or ``fail_reason`` excepted. Numbers above 38 digits count as ``value``
    errors. A valid number that bigint cannot hold is null in its column and kept as text in ``wide`` of the typed struct (``name=text``, by
    semicolons; null where there is none).
    Row-local: no shuffle, no Python.
    """
    keep = [c for c in lines.columns if c not in ("fields", "errors", "fail_reason")]
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    df = lines.select(*[F.col(f"`{c}`") for c in keep], text.alias("__l")).filter(F.col("__l").rlike(r"\S") & ~F.col("__l").startswith("#"))
    df = df.withColumn("__q", ~F.col("__l").contains('"') | F.col("__l").rlike(_WELL_QUOTED))
    df = once(df, "__f", F.when(F.col("__q"), split_quoted(F.col("__l"))))
    df = df.withColumn("__n", F.size("__f"))
    g = {n: F.get(F.col("__f"), F.lit(i)) for i, n in enumerate(AXT_FIELDS)}
    num = {n: _number(g[n]) for n in ("tStart", "tEnd", "qStart", "qEnd", "symCount")}
    rules: dict[str, Column] = {"aln_no": ~_digits(g["aln_no"])}
    for a, b in (("tStart", "tEnd"), ("qStart", "qEnd")):
        for n in (a, b):
            rules[n] = ~F.coalesce(num[n] >= 1, F.lit(False))
        rules[f"{a}>{b}"] = num[a] > num[b]
    for n in ("tName", "qName"):
        rules[n] = ~g[n].rlike(r"\S")
    rules["qStrand"] = ~g["qStrand"].isin("+", "-")
    rules["score"] = ~g["score"].rlike(r"\A(?:-?[0-9]+)?\z")
    rules["symCount"] = ~F.coalesce(num["symCount"] >= 1, F.lit(False))
    for side, a, b in (("tSym", "tStart", "tEnd"), ("qSym", "qStart", "qEnd")):
        rules[side] = ~g[side].rlike(r"\A[ACGTNacgtn-]*+\z")
        rules[f"{side} length"] = F.length(g[side]).cast("decimal(38,0)") != num["symCount"]
        bases = F.length(F.replace(g[side], F.lit("-"), F.lit(""))).cast("decimal(38,0)")
        rules[f"{side} bases"] = bases != num[b] - num[a] + 1
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    errors = F.when(~F.col("__q"), F.array(F.lit("quoting"))).when(F.col("__n") != len(AXT_FIELDS), F.array(F.lit("columns"))).otherwise(broken)
    numbers = ("aln_no", "tStart", "tEnd", "qStart", "qEnd", "score", "symCount")
    too_wide = F.array_compact(F.array(*[F.when((g[n] != "") & g[n].try_cast("bigint").isNull(), F.concat(F.lit(f"{n}="), g[n])) for n in numbers]))
    typed = F.struct(*[(g[n].try_cast("bigint") if n in numbers else g[n]).alias(n) for n in AXT_FIELDS], F.when(F.size(too_wide) > 0, F.array_join(too_wide, ";")).alias("wide"))
    return (
        once(df, "errors", errors)
        .withColumn("fail_reason", F.when(~F.col("__q"), "quoting").when(F.col("__n") != len(AXT_FIELDS), "columns").when(F.size("errors") > 0, "value"))
        .withColumn("fields", F.when(F.size("errors") == 0, typed))
        .drop("__l", "__q", "__f", "__n")
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with typed columns, rejected rows with errors and fail_reason) of :func:`parse_axt_lines`."""
    ok = parsed.filter(F.size("errors") == 0)
    rest = [c for c in parsed.columns if c not in ("fields", "errors", "fail_reason") and c not in (*AXT_FIELDS, "wide")]
    return ok.select(*rest, "fields.*"), parsed.filter(F.size("errors") > 0).drop("fields")
