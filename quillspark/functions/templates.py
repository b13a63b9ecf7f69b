"""Placeholders and key paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{([^}]+)\}\}"


def key_path(json: Column, path: str) -> Column:
    """The value at a dotted path as text; an empty string where it is missing or null."""
    return F.coalesce(F.get_json_object(json, "$." + path), F.lit(""))


def key_path_list(variant: Column, path: str, of: str) -> Column:
    """The array at a dotted path; empty where it is missing."""
    return F.coalesce(F.try_variant_get(variant, "$." + path, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def bind(template: Column, resolve: Callable[[Column], Column]) -> Column:
    """Every ``{{key}}`` replaced once by ``resolve(key)``; what a value holds is not expanded again."""
    parts = F.split(template, r"\{\{")
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda p: F.when(
            p.rlike(r"(?s)^[^}]+\}\}"),
            F.concat(F.coalesce(resolve(F.regexp_extract(p, r"^([^}]+)\}\}", 1)), F.lit("")), F.regexp_replace(p, r"^[^}]+\}\}", "")),
        ).otherwise(F.concat(F.lit("{{"), p)),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
