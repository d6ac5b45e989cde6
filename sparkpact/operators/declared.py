"""Contracts as they are declared: from a catalog's rows to plans over the tables' data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.functions.translate import to_spark
from sparkpact.functions.types import spark_type
from sparkpact.operators import contracts as C
from sparkpact.operators.apply import exclusion_violations
from sparkpact.sources.catalog import Catalog


def expression(text: str) -> Column:
    return F.expr(to_spark(text))


def contract_report(spark: SparkSession, catalog: Catalog, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, contract, n): the violations of every declared contract of the given tables: NOT NULL,
    keys, unique indexes, foreign keys, checks, domains, enums and exclusions. Contracts that hold
    have no row. One plan each, put together; what is counted is rows or, of keys, keys."""
    found: list[DataFrame] = []

    def add(table: str, contract: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(contract).alias("contract"), "n"))

    for key, df in tables.items():
        for c in catalog.of("column", key):
            if not c.attrs["nullable"]:
                add(key, f"not null {c.name}", df.where(F.col(c.name).isNull()))
            kind = c.attrs["data_type"]
            domain, enum = catalog.get("domain", kind), catalog.get("enum", kind)
            if enum is not None:
                add(key, f"enum {c.name}", df.where(F.col(c.name).isNotNull() & ~F.col(c.name).isin(*enum.attrs["values"])))
            if domain is not None:
                value = df.select(F.col(c.name).alias("value"))
                checks = {x["name"] or f"check {n}": expression(x["expression"]) for n, x in enumerate(domain.attrs["checks"])}
                add(key, f"domain {c.name}", C.domain_violations(value, "value", domain.attrs["not_null"], checks))
        for o in catalog.of("primary_key", key):
            add(key, "primary key", C.primary_key_violations(df, o.attrs["columns"]))
        for o in catalog.of("index", key):
            if o.attrs["unique"]:
                rows = df.where(expression(o.attrs["predicate"])) if o.attrs.get("predicate") else df
                keyed = rows.select(*(expression(x).alias(f"k{n}") for n, x in enumerate(o.attrs["columns"])))
                add(key, f"unique {o.name}", C.unique_violations(keyed, keyed.columns))
        for o in catalog.of("foreign_key", key):
            if o.attrs["ref_table"] in tables:
                add(key, f"foreign key {o.name}", C.foreign_key_orphans(df, tables[o.attrs["ref_table"]], o.attrs["columns"], o.attrs["ref_columns"]))
        for o in catalog.of("check", key):
            add(key, f"check {o.name}", C.check_violations(df, {o.name: expression(o.attrs["expression"])}))
        for o in catalog.of("exclusion", key):
            add(key, f"exclusion {o.name}", exclusion_violations(df, o.attrs["elements"], o.attrs.get("where")))
    out = spark.createDataFrame([], "table string, contract string, n long")
    for rows in found:
        out = out.unionByName(rows)
    return out.where("n > 0")


def declared_policies(catalog: Catalog, table: str) -> list[dict]:
    """A table's policies as apply_policies() takes them."""
    side = lambda o, a: expression(o.attrs[a]) if o.attrs.get(a) else None
    return [{"command": o.attrs["command"], "roles": o.attrs["roles"], "permissive": o.attrs.get("permissive", True), "using": side(o, "using"), "check": side(o, "check")} for o in catalog.of("policy", table)]


def visible(df: DataFrame, catalog: Catalog, table: str, command: str, role: str, written: bool = False) -> DataFrame:
    """The rows that a table's declared row security lets a role read or write; all where it is off."""
    own = catalog.get("table", table)
    return C.apply_policies(df, declared_policies(catalog, table), command, role, bool(own and own.attrs["rls"]), written)


def partition_of(catalog: Catalog, table: str, df: DataFrame) -> Column:
    """The name of the partition that each row of a partitioned table goes to, by declared bounds;
    NULL where none takes it. Range and list bounds are literals; hash partitions go by xxhash64."""
    by = catalog.get("table", table).attrs["partition_by"]
    parts = [o for o in catalog.of("partition") if o.attrs["parent"] == table]
    keys = [expression(c) for c in by["columns"]]
    kinds = df.select(*(k.alias(f"k{n}") for n, k in enumerate(keys))).schema
    value = lambda text, n: F.expr(to_spark(text)).cast(kinds[n].dataType)
    default = next((o.name for o in parts if o.attrs["bound"]["kind"] == "default"), None)
    out = F.lit(default).cast("string")
    for o in parts:
        b = o.attrs["bound"]
        if b["kind"] == "range":
            # bounds of several columns compare as rows: from <= key < to, MINVALUE and MAXVALUE at the ends
            test = row_compare(keys, b["from"], value, lower=True) & row_compare(keys, b["to"], value, lower=False)
            for k in keys:
                test = test & k.isNotNull()
        elif b["kind"] == "list":
            plain = [v for v in b["values"] if v.lower() != "null"]
            test = F.coalesce(keys[0].isin(*(value(v, 0) for v in plain)), F.lit(False)) if plain else F.lit(False)
            test = test | keys[0].isNull() if len(plain) < len(b["values"]) else test
        elif b["kind"] == "hash":
            test = F.pmod(F.xxhash64(*keys), F.lit(b["modulus"])) == b["remainder"]
        else:
            continue
        out = F.when(test, F.lit(o.name)).otherwise(out)
    return out


def row_compare(keys: list[Column], bound: list[str], value, lower: bool) -> Column:
    """Whether a row of keys is at or above a lower bound, or below an upper one."""
    test = F.lit(lower)  # equal all through: inside a lower bound, outside an upper one
    for n, text in reversed(list(enumerate(bound))):
        if text.lower() in ("minvalue", "maxvalue"):
            test = F.lit((text.lower() == "minvalue") == lower)
            continue
        v = value(text, n)
        test = (keys[n] > v if lower else keys[n] < v) | ((keys[n] == v) & test)
    return test


def with_declared_columns(df: DataFrame, catalog: Catalog, table: str) -> DataFrame:
    """A table's declared columns in order: what df has in the declared types, absent ones by their
    default or generated value (which may use any other column), else NULL."""
    columns = catalog.of("column", table)
    out = df
    for c in columns:
        if not c.attrs.get("generated"):
            given = F.col(c.name) if c.name in df.columns else expression(c.attrs["default"]) if c.attrs.get("default") and "nextval" not in c.attrs["default"] else F.lit(None)
            out = out.withColumn(c.name, given.cast(spark_type(c.attrs["data_type"])))
    for c in columns:
        if c.attrs.get("generated"):
            out = out.withColumn(c.name, expression(c.attrs["generated"]).cast(spark_type(c.attrs["data_type"])))
    return out.select(*(c.name for c in columns))
