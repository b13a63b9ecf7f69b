"""String functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s+"
LONG = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind, Unicode's included, at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def not_blank(text: Column) -> Column:
    return text.rlike(r"[^\s\p{Z}]")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings without regard to case, 0 to 1.

    ``1 - distance / longer length`` by edit distance; where either is over 30 characters, twice the
    common prefix over both lengths. Equal strings give 1, an empty one 0.
    """
    x, y = F.lower(a), F.lower(b)
    n, m = F.length(x), F.length(y)
    prefix = F.aggregate(
        F.sequence(F.lit(1), F.least(n, m)),
        F.lit(0),
        lambda k, i: F.when((k == i - 1) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(k),
    )
    by_prefix = 2.0 * prefix / (n + m)
    by_edits = 1.0 - F.levenshtein(x, y) / F.greatest(n, m)
    return F.when(x == y, 1.0).when((n == 0) | (m == 0), 0.0).when((n > LONG) | (m > LONG), by_prefix).otherwise(by_edits)


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def heading_digits(style: Column) -> Column:
    """Level in a style's name: its digits, 1 where there are none."""
    return F.coalesce(F.regexp_replace(style, "[^0-9]", "").try_cast("int"), F.lit(1))


def ensure_suffix(name: Column, suffix: str = ".pdf") -> Column:
    return F.when(F.endswith(F.lower(name), F.lit(suffix)), name).otherwise(F.concat(name, F.lit(suffix)))


def appearance_font(da: Column) -> Column:
    """STRUCT(font_name, font_size) from a default-appearance string such as ``/Helv 12 Tf 0 g``; nulls without one."""
    parts = F.split(F.trim(da), SPACE)
    at = F.array_position(parts, "Tf")
    size = F.when(at >= 3, F.element_at(parts, (at - 1).cast("int")).try_cast("double"))
    name = F.when(at >= 3, F.regexp_replace(F.element_at(parts, (at - 2).cast("int")), "^/", ""))
    return F.struct(name.alias("font_name"), size.alias("font_size"))


def style_flags(font_name: Column) -> Column:
    low = F.lower(F.coalesce(font_name, F.lit("")))
    return F.struct(F.contains(low, F.lit("bold")).alias("bold"), (F.contains(low, F.lit("italic")) | F.contains(low, F.lit("oblique"))).alias("italic"))


def truncate_cell(text: Column, width: Column, padding: float, font_size: float) -> Column:
    """Cell text on one line, cut to the characters that fit."""
    fits = F.greatest(F.lit(0), F.floor((width - 2 * padding) / (0.5 * font_size))).cast("int")
    return F.substr(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(1), fits)


def default_field_name(text: Column, n: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.substr(text, F.lit(1), F.lit(30))), F.lit("")), F.concat(F.lit("Field "), n.cast("string")))


def winansi(text: Column) -> Column:
    """Characters that the encoding lacks become question marks."""
    return F.regexp_replace(text, "[^\\x20-\\x7E\\u00A0-\\u00FF]", "?")


FONT_FAMILIES = {"times": "Times-Roman", "courier": "Courier", "helvetica": "Helvetica"}


def font_alias(name: Column) -> Column:
    """The standard font that a family name stands for; Helvetica where none fits."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("Helvetica")
    for key, font in FONT_FAMILIES.items():
        out = F.when(F.contains(low, F.lit(key)), font).otherwise(out)
    return out


def substitute_tokens(text: Column, values: dict[str, Column], defaults: dict[str, str]) -> Column:
    """``{{token}}`` replaced for each token of ``defaults``."""
    for token, default in defaults.items():
        text = F.replace(text, F.lit("{{" + token + "}}"), F.coalesce(values.get(token, F.lit(None).cast("string")), F.lit(default)))
    return text


def parse_money(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def slug(name: Column, length: int | None = 8) -> Column:
    """The letters a to z of a name in lower case, the first ``length`` of them."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return letters if length is None else F.substr(letters, F.lit(1), F.lit(length))


def serial(prefix: str, n: Column, width: int = 3) -> Column:
    """``prefix`` and a number with zeros before it."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def boundary_words(text: Column) -> Column:
    """Words between boundaries of letters and digits, punctuation left out; an apostrophe or point inside a word stays."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"), F.lit(0))


def local_path(url: Column) -> Column:
    """A path of a ``file://`` URL, or of a path; percent escapes are resolved in URLs only."""
    return F.when(F.startswith(url, F.lit("file://")), F.try_url_decode(F.replace(F.regexp_replace(url, "^file://", ""), F.lit("+"), F.lit("%2B")))).otherwise(url)
