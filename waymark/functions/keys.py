"""Content-derived keys, references and label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that speak about the record and not about the world.
GENERIC_LABELS = (
    "annotation", "content", "color", "data", "description", "date", "detail", "document", "element", "file", "form", "identifier",
    "image", "information", "item", "location", "itinerary", "label", "list", "metadata", "number", "object", "page", "pattern",
    "percentage", "property", "photo", "picture", "qr code", "record", "revision", "result", "score", "schedule", "screenshot",
    "selection", "size", "space", "status", "symbol", "text", "timeline", "thing", "transformation", "time", "value", "version",
)
# Screen categories, and those that never give evidence.
CATEGORIES = ("map", "place", "product", "food", "article", "event", "media", "settings", "code", "chat", "auth", "finance", "other")
SENSITIVE = ("chat", "auth", "finance")


def content_key(ids: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted ids joined by bars."""
    return F.substring(F.sha2(F.array_join(F.sort_array(ids), "|"), 256), 1, 16)


def place_reference(lat: Column, lon: Column) -> Column:
    return F.format_string("place:%.5f,%.5f", lat, lon)


def normalised(label: Column) -> Column:
    return F.trim(F.replace(label, F.lit("_"), F.lit(" ")))


def is_generic(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(*GENERIC_LABELS)


# Evidence sources by reference prefix; any other reference is a photograph.
PREFIXES = {"caption:": "stay_caption", "photo:": "single_caption", "screen:": "screen", "place:": "journey", "stay:": "stay_caption", "single:": "single_caption", "profile:": "kept_reading"}


def source_of(reference: Column) -> Column:
    """The evidence source that a reference names by its prefix."""
    out = F.lit("photograph")
    for prefix, source in PREFIXES.items():
        out = F.when(reference.startswith(prefix), source).otherwise(out)
    return out


def blurred(reference: Column, decimals: int = 2) -> Column:
    """A place reference with its coordinates rounded; others pass."""
    number = lambda i: F.bround(F.regexp_extract(reference, r"^place:(-?[0-9.]+),(-?[0-9.]+)$", i).try_cast("double"), decimals)
    return F.when(reference.startswith("place:"), F.format_string(f"place:%.{decimals}f,%.{decimals}f", number(1), number(2))).otherwise(reference)


# What the sources are called, in the order in which they are named.
SOURCE_LABELS = {"photograph": "photograph", "journey": "journey", "stay_caption": "stay caption", "single_caption": "single caption", "screen": "screen reading", "kept_reading": "kept reading", "activity": "daily activity"}


def read_from(references: Column) -> Column:
    """``read from a, b and c``: the sources of an array of references in their fixed order; empty without references."""
    present = F.transform(references, source_of)
    named = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SOURCE_LABELS.items())), lambda x: F.array_contains(present, x["k"]))
    labels = F.transform(named, lambda x: x["v"])
    most = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), ", ")
    told = F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise(F.concat(most, F.lit(" and "), F.get(labels, F.size(labels) - 1)))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(F.lit("read from "), told)).otherwise("")
