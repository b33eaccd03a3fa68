"""Name folding and matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: str) -> str:
    """Decomposed, without the combining marks U+0300-U+036F, in lower case, with sharp s as ss; not trimmed."""
    if text.isascii():
        return text.lower()
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")
    return plain.lower().replace("ß", "ss")


def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fold, na_action="ignore")


def fold_name(name: Column) -> Column:
    """T1 of a column. Plain ASCII names are folded by the JVM; only the others cross to Python."""
    odd = F.when(name.rlike(r"[^\x00-\x7F]"), name)
    return F.coalesce(F.pandas_udf(_fold, "string")(odd), F.lower(name))


def match_score(name_folded: Column, query_folded: Column) -> Column:
    """2 for equal, 1 for a prefix, 0 for a substring, else NULL; NULL for an empty query."""
    score = F.when(name_folded == query_folded, 2).when(F.startswith(name_folded, query_folded), 1).when(F.contains(name_folded, query_folded), 0)
    return F.when(query_folded != "", score)


def bucket(name_folded: Column) -> Column:
    """Of a folded name, by its first letter after trimming: a-z 0 to 25, another character 26, none 27."""
    first = F.substring(F.trim(name_folded), 1, 1)
    return F.when(first == "", 27).when(first.between("a", "z") & (F.octet_length(first) == 1), F.ascii(first) - 97).otherwise(26)


def probe_buckets(query: str) -> list[int]:
    """T4: the buckets that a query reads."""
    q = fold(query.strip())
    own = 27 if not q else ord(q[0]) - 97 if "a" <= q[0] <= "z" else 26
    return sorted({own, 26})


def category_label(index: Column, categories: Column) -> Column:
    """1-based index into category paths: the last step, underscores as spaces."""
    return F.translate(F.trim(F.element_at(F.split(F.get(categories, index - 1), ">"), -1)), "_", " ")
