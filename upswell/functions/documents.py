"""Column expressions over nested song documents, spans and source texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column) -> Column:
    """First ten characters as an ISO date; empty or NULL gives NULL."""
    return F.to_date(F.nullif(F.substring(value, 1, 10), F.lit("")), "yyyy-MM-dd")


def pick_pv(pvs: Column, service: str) -> Column:
    """Id of the service's first original upload, else of its first upload."""
    usable = F.filter(pvs, lambda p: (p["service"] == service) & (p["pvId"] != ""))
    original = F.filter(usable, lambda p: p["pvType"] == "Original")
    return F.coalesce(F.get(original, F.lit(0))["pvId"], F.get(usable, F.lit(0))["pvId"])


def artist_role(roles: Column, categories: Column) -> Column:
    """Explicit roles, else the categories, else the empty string."""
    explicit = F.when(~roles.isin("", "Default"), roles)
    return F.coalesce(explicit, categories, F.lit(""))


def source_text(title: Column, song_type: Column, artists: Column, tags: Column) -> Column:
    """Text to embed: fixed field order, lists in code-point order."""
    return F.concat(
        title,
        F.lit("\ntype: "),
        F.coalesce(song_type, F.lit("")),
        F.lit("\nartists: "),
        F.array_join(F.array_sort(artists), ", "),
        F.lit("\ntags: "),
        F.array_join(F.array_sort(tags), ", "),
    )


def dig(json: Column, *keys: str) -> Column:
    """Value under ``keys`` as text: the flat dotted key first, then the nested path."""
    path = ".".join(keys)
    flat = F.get_json_object(json, f"$['{path}']")
    return F.coalesce(flat, F.get_json_object(json, f"$.{path}"))


def span_model(attributes: Column) -> Column:
    """Model a span was billed to; an empty response model falls through."""
    return F.coalesce(
        F.nullif(dig(attributes, "llm", "response", "model"), F.lit("")),
        dig(attributes, "llm", "model_name"),
    )


def span_tokens(attributes: Column) -> Column:
    """Total tokens of a span, NULL when unknown."""
    return dig(attributes, "llm", "token_count", "total").cast("bigint")
