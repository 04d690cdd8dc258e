"""JSON in model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import text


def lenient(c: Column) -> Column:
    """The JSON value in a text that may have code fences, words around it and trailing commas; null if there is none."""
    bare = F.trim(F.regexp_replace(text(c), "(?i)```(?:json)?", ""))
    braces = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    brackets = F.regexp_extract(bare, "(?s)\\[.*\\]", 0)
    trimmed = lambda x: F.regexp_replace(x, ",\\s*([}\\]])", "$1")
    return F.coalesce(*(F.try_parse_json(x) for x in (bare, braces, trimmed(braces), brackets, trimmed(brackets))))
