"""Hex colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hex(text: Column, fallback: tuple[int, int, int] | None = (0, 0, 0)) -> Column:
    """STRUCT(r, g, b) of ``#RRGGBB`` (the # may be missing); ``fallback`` for anything else, null without one."""
    valid = F.coalesce(text.rlike("^#?[0-9A-Fa-f]{6}$"), F.lit(False))
    digits = F.when(valid, F.regexp_replace(text, "^#", "")).otherwise("000000")
    part = lambda i: F.conv(F.substr(digits, F.lit(i), F.lit(2)), 16, 10).cast("int")
    other = lambda i: F.lit(fallback[i] if fallback else None).cast("int")
    return F.struct(*(F.when(valid, part(2 * i + 1)).otherwise(other(i)).alias(n) for i, n in enumerate("rgb")))


def format_hex(r: Column, g: Column, b: Column) -> Column:
    """``#RRGGBB`` of parts from 0 to 1, cut to whole bytes."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex((c * 255).cast("int")), 2, "0") for c in (r, g, b)))
