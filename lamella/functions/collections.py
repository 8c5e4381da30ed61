"""Lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(items: Column, *values: Column) -> Column:
    """A list with more elements; an absent list counts as empty."""
    return F.concat(F.coalesce(items, F.array()), F.array(*values)) if values else items


def put(entries: Column, key: Column, value: Column) -> Column:
    """A map with an entry more; of equal keys the last wins."""
    return last_wins(F.concat(F.map_entries(entries), F.array(F.struct(key.alias("key"), value.alias("value")))))


def last_wins(entries: Column) -> Column:
    """A map from an array of entries: of equal keys the last stays, in the place of its first."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))


def entries(m: Column) -> Column:
    """The entries of a map as an array, to be exploded."""
    return F.map_entries(m)


def merge_pairs(everywhere: Column, own: Column) -> Column:
    """Both maps' pairs; those of the second win."""
    return last_wins(F.concat(F.map_entries(everywhere), F.map_entries(own)))


def fixed(items: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(items, 1, n)


def uuid_text(b: Column) -> Column:
    """The usual text of the 16 bytes of a UUID; other lengths fail the query."""
    h = F.lower(F.hex(b))
    text = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(b.isNull(), F.lit(None).cast("string")).when(F.octet_length(b) == 16, text).otherwise(F.raise_error(F.lit("a UUID has 16 bytes")).cast("string"))


def uuid_bytes(s: Column) -> Column:
    return F.unhex(F.replace(s, F.lit("-"), F.lit("")))


def empty_as_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)
