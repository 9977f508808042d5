"""Small Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word and space classes of the operators' contracts.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # on lower-cased text
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_of(c: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(c, F.lit(""))


def split_words(c: Column, separators: str) -> Column:
    """Array of the non-empty pieces between runs of ``separators``."""
    return F.filter(F.split(text_of(c), separators), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: the value is
    bound as a lambda variable, so the optimizer cannot copy its expression
    into every place that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(first, last) -> Column:
    """The integers first..last as an array, empty when last < first."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))) \
        .otherwise(F.array().cast("array<int>"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys of ``a`` stay.
    Other columns of ``b`` must have names of their own."""
    own = dict(zip(keys, fresh(a, *[f"__r_{k}" for k in keys]), strict=True))
    c = b.withColumnsRenamed(own)
    cond = F.lit(True)
    for k, r in own.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return a.join(c, cond, how).drop(*own.values())
