"""Typing of texts and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.chains import col


def number(c: Column | str) -> Column:
    """struct<i, d>: a text as whole number and as double; null where it is none. ``nan`` and ``inf`` are doubles."""
    t = F.trim(col(c))
    return F.struct(t.try_cast("bigint").alias("i"), t.try_cast("double").alias("d"))


def parse_list(c: Column | str) -> Column:
    """``[a, 'b', 3]`` as an array of texts without quotes; an empty list is an empty array."""
    inner = F.regexp_extract(col(c), r"^\s*[\[(](.*)[\])]\s*$", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: x != "")


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get 2, 3, ... appended."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}{seen[n]}")
    return out


def short_name(path: str, separator: str = "/", terminator: str = ".py") -> str:
    """The last part of a path without its terminator."""
    base = path.rstrip(separator).split(separator)[-1]
    return re.sub(re.escape(terminator) + "$", "", base)
