"""Tables that results hang on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points; names in any case, A4 for all others.
PAGE_SIZES = {"A4": (595.0, 842.0), "LETTER": (612.0, 792.0), "LEGAL": (612.0, 1008.0)}
#: Points by heading level; 12 for all others.
HEADING_SIZES = {1: 24.0, 2: 20.0, 3: 16.0, 4: 14.0, 5: 12.0, 6: 11.0}
#: Uniform type names and the media types that they stand for; others stand for themselves.
MEDIA_TYPES = {
    "org.openxmlformats.wordprocessingml.document": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "com.microsoft.word.doc": "application/msword",
    "com.adobe.pdf": "application/pdf",
    "public.plain-text": "text/plain",
    "public.image": "image/*",
    "public.png": "image/png",
    "public.jpeg": "image/jpeg",
}
#: Colours that take the place of a text that is none, by what is coloured; null: the element is not coloured.
FALLBACK_COLORS = {
    "highlight": (255, 255, 0),
    "annotation": (255, 255, 0),
    "template": (0, 0, 0),
    "edit": (0, 0, 0),
    "redaction": (0, 0, 0),
    "watermark": (255, 0, 0),
    "overlay": None,
}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def page_size(name: Column) -> Column:
    """STRUCT(width, height)."""
    known = F.upper(F.coalesce(name, F.lit("")))
    pick = lambda i: F.coalesce(F.try_element_at(_map({k: v[i] for k, v in PAGE_SIZES.items()}), known), F.lit(PAGE_SIZES["A4"][i]))
    return F.struct(pick(0).alias("width"), pick(1).alias("height"))


def heading_size(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(HEADING_SIZES), level), F.lit(12.0))


def media_type(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(MEDIA_TYPES), name), name)
