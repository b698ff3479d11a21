"""JSON payloads, class maps and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(payload: Column, *path: str) -> Column:
    return F.get_json_object(payload, "$" + "".join(f"['{p}']" for p in path))


def has_key(payload: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def merged(a: Column, b: Column) -> Column:
    """Two flat JSON objects as one; the second wins."""
    kind = "map<string,string>"
    left, right = F.coalesce(F.from_json(a, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(b, kind), F.create_map().cast(kind))
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right))


def class_rules(rules: Column) -> Column:
    """A JSON object by class as a map; a part of the wrong type is null."""
    raw = F.from_json(rules, "map<string,struct<min_confidence:string,min_dwell_ms:string,motion_gate:string>>")
    return F.transform_values(
        raw,
        lambda _, r: F.struct(
            r["min_confidence"].try_cast("double").alias("min_confidence"), r["min_dwell_ms"].try_cast("long").alias("min_dwell_ms"), r["motion_gate"].alias("motion_gate")
        ),
    )


def changed(before: Column, after: Column) -> Column:
    """Fields of two string maps that differ, as map(name -> struct(before, after))."""
    both = F.map_zip_with(before, after, lambda _, a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def masked_url(url: Column) -> Column:
    """A URL without the password in it and with its secret parameters starred."""
    bare = F.regexp_replace(url, r"(://[^:/@\s]+):[^@/\s]+@", "$1:***@")
    return F.regexp_replace(bare, r"(?i)([?&](?:password|token|secret|key)=)[^&#]*", "$1***")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")


def event_key(*parts: Column) -> Column:
    """A stable id of an event from the fields that make it one."""
    return F.sha1(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)))


def class_of_kind(kind: Column) -> Column:
    """The class by which an identity of a kind is shown first; null for kinds without one."""
    return F.when(kind == "person", 0).when(kind == "vehicle", 2).when(kind.isin("pet", "animal"), 15)
