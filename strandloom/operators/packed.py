"""Several values packed in one field, split under the dialect of least description length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import salted_join
from strandloom.session import materialize
from strandloom.tables import maybe_broadcast, once, percent_decoded


@dataclass(frozen=True)
class Dialect:
    """How values are set apart: ``sep`` matches one separator, ``rest`` a character of an unquoted value, ``lead`` is a text that ``sep`` matches, ``hint`` what a field must contain for the parse to differ from that of ``single``, ``kinds`` the bits that tell one separator from the others."""

    name: str
    sep: str
    rest: str
    lead: str
    hint: str
    kinds: float


#: In order of preference at equal length; the place in the list is paid for in bits.
DIALECTS = (
    Dialect("single", r"\A\x00", r"[\s\S]", "\0", "", 0.0),
    Dialect("comma", r",", r"[^,]", ",", ",", 0.0),
    Dialect("semicolon", r";", r"[^;]", ";", ";", 0.0),
    Dialect("pipe", r"\|", r"[^|]", "|", r"\|", 0.0),
    Dialect("tab", r"\t", r"[^\t]", "\t", r"\t", 0.0),
    Dialect("blank", r"\s++", r"[^\s]", " ", r"\s", 0.0),
    Dialect("comma_blank", r",\s", r"(?:(?!,\s)[\s\S])", ", ", r",\s", 0.0),
    Dialect("any_mark", r"[^\S\t]*+[,;|\t]", r"[^,;|\t]", ",", r"[,;|\t]", 2.0),
    Dialect("any_mark_or_blank", r"(?:\s*+[,;|]|\s++)", r"[^,;|\s]", ",", r"[,;|\s]", 2.3),
    Dialect("any_other", r"(?:\s*+[^\p{L}\p{N}:._%\"\s-]|\s++)", r"[\p{L}\p{N}:._%\"-]", ",", r"[^\p{L}\p{N}:._%-]", 5.0),
)
_BLANKS = " \t\r\n\f\v"
_QUOTED = r'"(?:[^"]++|"")*+"'
#: Bits for a number of places other than the stated one, and for a value outside the language of its kind, which is spelled out.
MISCOUNT_BITS, ESCAPE_BITS, CHARACTER_BITS = 4096.0, 24.0, 8.0

_PLAIN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|[+-]?(?:nan|inf(?:inity)?)"
#: What an unquoted value may look like; ``number_comma`` (decimal comma, digit grouping) only where the number of places is stated.
VALUE = {
    "id": r"[\p{L}\p{N}:._%-]++",
    "number": _PLAIN,
    "number_comma": _PLAIN + r"|[+-]?[0-9]+,[0-9]+|[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?",
}


def _body(field: Column) -> Column:
    """The field without outer blanks and without a pair of brackets around the list."""
    t = F.btrim(field, F.lit(_BLANKS))
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    closed = (t.startswith("[") & t.endswith("]")) | (t.startswith("{") & t.endswith("}")) | (t.startswith("(") & t.endswith(")"))
    return F.when(closed, F.btrim(inner, F.lit(_BLANKS))).otherwise(t)


def _places(body: Column, d: Dialect) -> Column:
    """The raw places of a field under a dialect; separators at the end add none."""
    pattern = rf"(?:{d.sep})[^\S\t]*+({_QUOTED}[^\S\t]*+(?=(?:{d.sep})|\z)|{d.rest}*+)"
    kept = F.regexp_replace(body, rf"(?:(?:{d.sep})[^\S\t]*+)++\z", "") if d.hint else body
    return F.transform(F.regexp_extract_all(F.concat(F.lit(d.lead), kept), F.lit(pattern), F.lit(1)), lambda x: F.btrim(x, F.lit(_BLANKS)))


def _is_quoted(x: Column) -> Column:
    return x.rlike(rf"\A{_QUOTED}\z")


def _inner(x: Column) -> Column:
    return F.when(_is_quoted(x), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def _shape(body: Column, kind: str) -> Column:
    """A field without what no parse and no code looks at: runs of letters as a, of digits as 9; in numbers, runs of one or two, three and more digits differ (as grouping does) and letters stay."""
    if kind == "id":
        return F.regexp_replace(F.regexp_replace(body, r"\p{L}+", "a"), r"\p{N}+", "9")
    s = F.regexp_replace(F.lower(body), r"[0-9]{4,}+", "9999")
    return F.regexp_replace(F.regexp_replace(s, r"(?<![0-9])[0-9]{3}(?![0-9])", "999"), r"(?<![0-9])[0-9]{1,2}(?![0-9])", "9")


def score_dialects(fields: DataFrame, kind: str) -> DataFrame:
    """Every distinct (``__key``, ``__shape``, ``__size``) of ``fields`` with the cheapest dialect: ``__key``, ``di``, ``bits``, ``lead`` (bits to the next parse with other places, null if there is none) and ``n_parses``.

    All parses are scored: the code length of their values, the kind of each separator, the dialect, and a wrong number
    of places. The value code is learnt over all fields: a value of the kind's language costs the bits of its shape's frequency among the
    values of parses with the right number of places; any other value is spelled out. Nothing is ruled out beforehand.
    """
    shapes = fields.groupBy("__key", "__shape", "__size").agg(F.count(F.lit(1)).alias("n"))
    one = [F.when(F.col("__shape").rlike(d.hint) if d.hint else F.lit(True), F.struct(F.lit(i).alias("di"), _places(F.col("__shape"), d).alias("places"))) for i, d in enumerate(DIALECTS)]
    parses = shapes.select("__key", "__size", "n", F.explode(F.array_compact(F.array(*one))).alias("x")).select("__key", "__size", "n", "x.di", "x.places")
    parses = materialize(parses, "parses")
    counted = F.coalesce(F.size("places") == F.col("__size"), F.lit(True))
    v = F.col("v")
    language = F.when(F.col("__size").isNull(), v.rlike(rf"\A(?:{VALUE[kind]})\z")).otherwise(v.rlike(rf"\A(?:{VALUE[kind if kind == 'id' else 'number_comma']})\z"))
    values = parses.select("__key", "di", "n", "__size", counted.alias("counted"), F.xxhash64("places").alias("parse"), F.size("places").alias("m"), F.explode("places").alias("v"))
    values = values.select("__key", "di", "n", "counted", "parse", "m", "v", F.when(_is_quoted(v), F.lit('"')).when((v == "") | language, v).alias("code"))
    # One row per value shape; small, but not bounded, so it is broadcast only when proven to be.
    book = values.filter("counted and code is not null").groupBy("code").agg(F.sum("n").alias("c"))
    book = materialize(book, "code")
    total = book.agg(F.sum("c").cast("double").alias("t")).scalar()
    book = book.select("code", (F.log2(total) - F.log2(F.col("c"))).alias("b"))
    coded = values.join(maybe_broadcast(book), "code", "left")
    spelled = ESCAPE_BITS + CHARACTER_BITS * F.length("v")
    kinds, di = F.array(*[F.lit(d.kinds) for d in DIALECTS]), F.col("di")
    cost = coded.groupBy("__key", "di", "parse", "counted", "m").agg(F.sum(F.coalesce("b", spelled)).alias("b"))
    cost = cost.withColumn("bits", F.col("b") + di * 0.5 + F.get(kinds, di) * (F.col("m") - 1) + F.when(F.col("counted"), 0.0).otherwise(MISCOUNT_BITS))
    ranked = cost.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("bits", "di", "parse"))).alias("r"))
    first = F.get("r", F.lit(0))
    other = F.get(F.filter("r", lambda x: x["parse"] != first["parse"]), F.lit(0))
    return ranked.select("__key", first["di"].alias("di"), first["bits"].alias("bits"), (other["bits"] - first["bits"]).alias("lead"), F.size(F.array_distinct(F.transform("r", lambda x: x["parse"]))).alias("n_parses"))


def split_packed(df: DataFrame, field: str, kind: str, size: str | None = None, scores: bool = False) -> DataFrame:
    """One row per place of a packed field: all columns of df, ``item_pos`` (from 1), ``item_text``, ``n_values``, ``dialect``; with ``scores``, also ``n_parses`` and ``lead_bits``.

    ``kind`` is ``id`` (Parent lists) or ``number`` (float arrays); ``size`` names the column with the
    stated number of places, if there is one. Each field is split under the dialect whose parse has the least description
    length (:func:`score_dialects`), ties by order of :data:`DIALECTS`. Fields with one shape and size have the same lengths, so each
    shape is scored once, however many fields have it.

    Null, blank and ``.`` fields give no row; empty places count in ``item_pos`` but give no row.
    ``item_text`` is without outer blanks and quotes, %-escapes undone. Columns of df named like
    a result column are replaced. Fields are shuffled only where the table of shapes is too large to be broadcast.
    """
    base = once(df.drop("item_pos", "item_text", "n_values", "dialect", "n_parses", "lead_bits"), "__body", _body(F.col(field)))
    base = base.withColumn("__size", F.col(size).cast("int") if size else F.lit(None).cast("int"))
    base = base.filter(F.col("__body").isNotNull() & ~F.col("__body").isin("", "."))
    # Written once, as fields are read for their shapes and for the split.
    base = materialize(base.withColumn("__key", F.concat(F.coalesce(F.col("__size").cast("string"), F.lit("")), F.lit(":"), _shape(F.col("__body"), kind))), "fields")
    best = materialize(score_dialects(base.select("__key", F.expr("substring(__key, position(':' in __key) + 1)").alias("__shape"), "__size"), kind), "dialects")
    few = maybe_broadcast(best)
    kept = base.drop("__size")
    won = kept.join(few, "__key") if few is not best else salted_join(kept, best, "__key")
    di = F.col("di")
    parse = F.when(di == 0, _places(F.col("__body"), DIALECTS[0]))
    for i, d in enumerate(DIALECTS[1:], 1):
        parse = parse.when(di == i, _places(F.col("__body"), d))
    won = once(won, "__best", parse).withColumn("n_values", F.size(F.filter("__best", lambda v: v != "")))
    # The outer form, as for the inner one a filter on the places is inferred and pushed down, which parses every field again.
    names = F.array(*[F.lit(d.name) for d in DIALECTS])
    extra = ["n_parses", F.col("lead").alias("lead_bits")] if scores else []
    rows = won.select(*[F.col(f"`{c}`") for c in base.columns if not c.startswith("__")], "n_values", F.get(names, di).alias("dialect"), *extra, F.posexplode_outer("__best").alias("__p", "__v"))
    text = F.btrim(_inner(F.col("__v")), F.lit(_BLANKS))
    return rows.filter("__v <> ''").withColumn("item_pos", (F.col("__p") + 1).cast("int")).withColumn("item_text", percent_decoded(text)).drop("__p", "__v")
