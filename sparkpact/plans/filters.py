"""Which objects are managed: by name, by type, by schema."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkpact.sources.catalog import TABLE_PARTS, Catalog

# Object types of filters, with the kinds that they stand for.
TYPES = {
    "extensions": ("extension",), "tables": ("table", "partition", "column"), "enums": ("enum",), "domains": ("domain",), "functions": ("function", "aggregate"), "views": ("view",), "triggers": ("trigger",), "sequences": ("sequence",), "partitions": ("partition",), "policies": ("policy",), "indexes": ("index",), "foreignkeys": ("foreign_key",), "checkconstraints": ("check",), "schemas": ("schema",), "defaultprivileges": ("default_privilege",), "grants": ("grant",),
}
NESTED = {"triggers", "policies", "indexes", "foreignkeys", "checkconstraints"}


def name_regex(pattern: str) -> str:
    """A glob over names as a regular expression; a pattern with a dot is for qualified names."""
    return fnmatch.translate(pattern).replace("(?s:", "(?:").replace(r"\z", r"\Z")


def name_matches(key: str, name: str, pattern: str) -> bool:
    return bool(re.match(name_regex(pattern), key if "." in pattern else name))


def named(key: str, name: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> bool:
    include = list(include)
    return (not include or any(name_matches(key, name, p) for p in include)) and not any(name_matches(key, name, p) for p in exclude)


def name_condition(include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """The name filter over a catalog relation: include, then exclude wins."""
    bare = F.regexp_extract("key", r"([^.]+)$", 1)
    hit = lambda p: (F.col("key") if "." in p else bare).rlike(name_regex(p).replace(r"\Z", "$").replace("(?:", "^(?:", 1))
    wanted = F.lit(True)
    include = list(include)
    if include:
        wanted = F.lit(False)
        for p in include:
            wanted = wanted | hit(p)
    for p in exclude:
        wanted = wanted & ~hit(p)
    return wanted


def kinds_of(include: Iterable[str] = (), exclude: Iterable[str] = ()) -> set[str]:
    """Kinds that stay under a type filter. Only nested types included: their tables stay with
    them. Tables and partitions go together."""
    include, exclude = {t.lower() for t in include}, {t.lower() for t in exclude}
    unknown = (include | exclude) - TYPES.keys()
    if unknown:
        raise ValueError(f"unknown object types: {', '.join(sorted(unknown))}")
    every = {k for kinds in TYPES.values() for k in kinds} | {"server", "owner", "comment", "primary_key", "exclusion"}
    if not include:
        kept = set(every)
    else:
        kept = {k for t in include for k in TYPES[t]} | {"server", "owner", "comment"}
        if include & NESTED or "tables" in include or "partitions" in include:
            kept |= {"table", "partition", "column", "primary_key", "exclusion"}
        if include == {"tables"}:
            kept |= set(TABLE_PARTS)
    for t in exclude:
        kept -= set(TYPES[t])
    if "table" not in kept:
        kept -= set(TABLE_PARTS)
    return kept


def filtered(catalog: Catalog, include: Iterable[str] = (), exclude: Iterable[str] = (), include_types: Iterable[str] = (), exclude_types: Iterable[str] = (), target_schemas: Iterable[str] | None = None, managed_partitions: bool = True) -> Catalog:
    """The managed part of a catalog; comments, owners and grants follow their objects."""
    include, exclude = list(include), list(exclude)
    kinds = kinds_of(include_types, exclude_types)
    schemas = set(target_schemas) if target_schemas is not None else None
    out = Catalog()
    for at, o in catalog.objects.items():
        if o.kind not in kinds:
            continue
        if o.kind in ("owner", "grant", "comment"):
            continue
        own_key, own_name = (o.parent, o.parent.split(".")[-1]) if o.kind in TABLE_PARTS else (o.key, o.name.partition("(")[0])
        if o.kind not in ("schema", "server", "default_privilege") and not named(own_key.partition("(")[0], own_name, include, exclude):
            continue
        if schemas is not None and o.kind not in ("extension", "server"):
            schema = o.name if o.kind == "schema" else o.attrs.get("in_schema") if o.kind == "default_privilege" else o.schema
            if schema not in schemas and not (o.kind == "default_privilege" and schema is None):
                continue
        if not managed_partitions and o.kind == "partition" and (("table", o.attrs["parent"]) in catalog.objects) and named(o.attrs["parent"], o.attrs["parent"].split(".")[-1], include, exclude):
            continue
        out.objects[at] = o
    held = {f"{k} {key}" for k, key in out.objects} | {f"type {key}" for k, key in out.objects if k in ("enum", "domain")} | {f"table {key}" for k, key in out.objects if k in ("view", "partition")}
    for at, o in catalog.objects.items():
        if o.kind in ("owner", "grant", "comment") and o.kind in kinds and (o.attrs["on"] in held or o.attrs["on"].startswith("constraint ") and o.attrs["on"].split(" ")[-1].rpartition(".")[0] in {key for _, key in out.objects}):
            out.objects[at] = o
    return out
