"""The catalog: a schema as rows, one relation for all kinds of objects.

A row is (kind, key, schema, parent, name, attrs): attrs maps attribute names to text (lists and
structures as JSON, sorted), so that one keyed join compares all kinds at once. What each kind
compares, and what a change means, is data: KINDS.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkpact.functions.types import declared_type

SCHEMA = "kind string, key string, schema string, parent string, name string, attrs map<string,string>"


def local_relation(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small relation that is part of the plan: no job reads it, and joins see its size."""
    fields = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    plain = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in columns]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(plain, kinds, strict=True)], names=fields.names), fields)


@dataclass(frozen=True)
class Kind:
    """on_change: alter, recreate (drop and create) or ignore. tier: order of creation."""

    name: str
    tier: int
    on_change: str
    compare: tuple[str, ...] = ()
    expressions: tuple[str, ...] = ()  # compared by canonical form
    optional: tuple[str, ...] = ()  # compared only where the target states them


KINDS = {
    k.name: k
    for k in (
        Kind("schema", 0, "ignore"),
        Kind("extension", 1, "alter", ("version", "schema"), optional=("version", "schema")),
        Kind("server", 2, "alter", ("fdw", "type", "version", "options")),
        Kind("enum", 3, "alter", ("values",)),
        Kind("domain", 4, "alter", ("data_type", "not_null", "collation"), ("default", "checks")),
        Kind("sequence", 5, "alter", ("data_type", "start", "increment", "min", "max", "cycle", "cache", "owned_by"), optional=("start", "increment", "min", "max", "cache", "data_type")),
        Kind("function", 6, "alter", ("return_type", "language", "volatility", "security", "config", "args"), ("body",)),
        Kind("aggregate", 7, "recreate", ("sfunc", "stype", "finalfunc", "initcond", "parallel")),
        Kind("table", 8, "alter", ("partition_by", "rls", "force_rls")),
        Kind("partition", 9, "recreate", ("parent", "bound")),
        Kind("column", 10, "alter", ("data_type", "nullable", "identity"), ("default", "generated")),
        Kind("primary_key", 11, "recreate", ("columns",)),
        Kind("index", 12, "recreate", ("unique", "method", "is_constraint"), ("columns", "predicate")),
        Kind("foreign_key", 13, "recreate", ("columns", "ref_table", "ref_columns", "on_delete", "on_update", "deferrable", "initially_deferred")),
        Kind("check", 14, "recreate", (), ("expression",)),
        Kind("exclusion", 15, "recreate", ("method", "deferrable", "initially_deferred"), ("elements", "where")),
        Kind("view", 16, "alter", ("materialized",), ("query",)),
        Kind("trigger", 17, "recreate", ("timing", "events", "update_columns", "for_each_row", "function", "args", "old_table", "new_table", "constraint", "deferrable", "initially_deferred", "enabled"), ("when",)),
        Kind("policy", 18, "alter", ("roles", "command"), ("using", "check")),
        Kind("owner", 19, "alter", ("owner",)),
        Kind("grant", 20, "alter", ("privileges", "grantable")),
        Kind("default_privilege", 21, "alter", ("privileges", "grantable")),
        Kind("comment", 22, "alter", ("comment",)),
    )
}

#: Kinds that belong to a table and go with it.
TABLE_PARTS = ("column", "primary_key", "index", "foreign_key", "check", "exclusion", "trigger", "policy")


#: Attributes that are text as they stand; all others are JSON where they are not plain words.
TEXT = frozenset("data_type default generated expression predicate where query body using check when comment owner on grantee role in_schema object_type constraint_name sfunc finalfunc stype initcond function method command timing enabled language volatility security return_type ref_table on_delete on_update fdw type version schema owned_by collation identity parent old_table new_table parallel partkey arguments definition".split())


def parsed(attrs: dict[str, str] | None) -> dict:
    """Attributes from their text form."""
    out = {}
    for k, v in (attrs or {}).items():
        if k in TEXT:
            out[k] = v
        else:
            try:
                out[k] = json.loads(v)
            except ValueError:
                out[k] = v
    return out


@dataclass
class Obj:
    kind: str
    schema: str
    name: str
    parent: str = ""
    attrs: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        qualified = f"{self.schema}.{self.name}" if self.schema and not self.parent else self.name
        return f"{self.parent}.{self.name}" if self.parent else qualified

    def text_attrs(self) -> dict[str, str]:
        """Attributes as text; what is None is left out."""
        return {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in sorted(self.attrs.items()) if v is not None}


class DuplicateObject(ValueError):
    pass


class Catalog:
    """Objects by (kind, key), with the order in which they came."""

    def __init__(self, objects: Iterable[Obj] = ()) -> None:
        self.objects: dict[tuple[str, str], Obj] = {}
        for o in objects:
            self.add(o)

    def add(self, o: Obj, replace: bool = False, source: str = "") -> Obj:
        at = (o.kind, o.key)
        if at in self.objects and not replace:
            raise DuplicateObject(f"{o.kind} {o.key} is defined twice" + (f" ({source})" if source else ""))
        self.objects[at] = o
        return o

    def get(self, kind: str, key: str) -> Obj | None:
        return self.objects.get((kind, key))

    def of(self, kind: str, parent: str | None = None) -> list[Obj]:
        return [o for (k, _), o in self.objects.items() if k == kind and (parent is None or o.parent == parent)]

    def remove(self, kind: str, key: str) -> None:
        """Remove an object, and with a table what belongs to it."""
        self.objects.pop((kind, key), None)
        if kind in ("table", "partition", "view"):
            for at in [a for a, o in self.objects.items() if o.parent == key and a[0] in (*TABLE_PARTS, "trigger")]:
                del self.objects[at]
        for at in [a for a, o in self.objects.items() if a[0] in ("owner", "grant", "comment") and o.attrs.get("on") == f"{kind} {key}"]:
            del self.objects[at]

    def rows(self) -> list[tuple]:
        return [(o.kind, o.key, o.schema, o.parent, o.name, o.text_attrs()) for _, o in sorted(self.objects.items())]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return local_relation(spark, self.rows(), SCHEMA)

    def to_json(self) -> str:
        return json.dumps([list(r) for r in self.rows()], sort_keys=True)

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON; equal schemas have equal fingerprints."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def copy(self) -> Catalog:
        out = Catalog()
        out.objects = {k: Obj(o.kind, o.schema, o.name, o.parent, json.loads(json.dumps(o.attrs))) for k, o in self.objects.items()}
        return out

    @classmethod
    def merged(cls, parts: Iterable[tuple[str, Catalog]]) -> Catalog:
        """All kinds of all parts; an object in two of them is an error that names both sources."""
        out, came_from = cls(), {}
        for source, part in parts:
            for at, o in part.objects.items():
                if at in out.objects:
                    if at[0] == "schema":
                        continue
                    raise DuplicateObject(f"{at[0]} {at[1]} is defined in {came_from[at]} and in {source}")
                out.objects[at] = o
                came_from[at] = source
        return out


def from_dataframes(frames: dict[str, DataFrame], schema: str = "public") -> Catalog:
    """The catalog of live tables: columns, types and nullability from their Spark schemas."""
    out = Catalog()
    for name, df in sorted(frames.items()):
        out.add(Obj("table", schema, name, "", {"rls": False, "force_rls": False}))
        for f in df.schema.fields:
            out.add(Obj("column", schema, f.name, f"{schema}.{name}", {"data_type": declared_type(f.dataType), "nullable": f.nullable}))
    return out
