"""Words, lines and small expression helpers shared by the corpus operators.

A word is ``[^\\x20\\x09-\\x0D]+``: a run of anything but ASCII white space. On bytes this is what
``bytes.split()`` gives, on columns what :func:`words` gives. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of ``text``, as an array; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often a lambda in ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def columns_of(df, names: list[str]) -> None:
    """Fail early, with the operator's own words, where a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
