"""Safety rules and lock hazards: small relations joined to the operations."""

from __future__ import annotations

import os
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpact.sources.catalog import local_relation

# Rule ids with what they look at: op, kind, severity, message. Destructive rules are
# errors unless destructive changes are allowed.
RULES = [
    ("deny_drop_column", "drop", "column", "error", True, "dropping a column loses its data"),
    ("deny_drop_table", "drop", "table", "error", True, "dropping a table loses its data"),
    ("deny_drop_table_in_prod", "drop", "table", "error", False, "tables are never dropped in production"),
    ("deny_drop_partition", "drop", "partition", "error", True, "dropping a partition loses its rows"),
    ("warn_type_narrowing", "alter", "column", "warning", False, "the new type may not hold every value"),
    ("warn_set_not_null", "alter", "column", "warning", False, "SET NOT NULL fails where NULLs exist, and scans the table"),
    ("deny_drop_view", "drop", "view", "error", True, "dropping a view breaks its readers"),
    ("deny_drop_materialized_view", "drop", "view", "error", True, "dropping a materialized view loses its contents"),
    ("deny_drop_enum", "drop", "enum", "error", True, "dropping an enum breaks its columns"),
    ("deny_drop_trigger", "drop", "trigger", "error", True, "dropping a trigger stops what it enforced"),
    ("deny_drop_sequence", "drop", "sequence", "error", True, "dropping a sequence loses its position"),
    ("deny_drop_unique_constraint", "drop", "index", "error", True, "dropping a unique constraint lets duplicates in"),
    ("warn_sequence_restart", "alter", "sequence", "warning", False, "restarting a sequence may repeat values"),
    ("deny_drop_schema", "drop", "schema", "error", True, "dropping a schema drops what it holds"),
    ("deny_drop_extension", "drop", "extension", "error", True, "dropping an extension drops what it defines"),
    ("deny_drop_domain", "drop", "domain", "error", True, "dropping a domain breaks its columns"),
]
# The lock that each operation takes on its table.
LOCKS = {
    ("create", "index"): "SHARE", ("drop", "index"): "ACCESS EXCLUSIVE", ("create", "column"): "ACCESS EXCLUSIVE", ("drop", "column"): "ACCESS EXCLUSIVE", ("drop", "table"): "ACCESS EXCLUSIVE", ("alter", "table"): "ACCESS EXCLUSIVE", ("create", "primary_key"): "ACCESS EXCLUSIVE", ("drop", "primary_key"): "ACCESS EXCLUSIVE",
    ("create", "foreign_key"): "SHARE ROW EXCLUSIVE", ("drop", "foreign_key"): "ACCESS EXCLUSIVE", ("create", "check"): "ACCESS EXCLUSIVE", ("drop", "check"): "ACCESS EXCLUSIVE", ("create", "exclusion"): "ACCESS EXCLUSIVE", ("drop", "exclusion"): "ACCESS EXCLUSIVE", ("create", "trigger"): "SHARE ROW EXCLUSIVE", ("drop", "trigger"): "SHARE ROW EXCLUSIVE",
    ("alter", "trigger"): "SHARE ROW EXCLUSIVE", ("create", "policy"): "ACCESS EXCLUSIVE", ("drop", "policy"): "ACCESS EXCLUSIVE", ("alter", "policy"): "ACCESS EXCLUSIVE", ("create", "partition"): "ACCESS EXCLUSIVE", ("drop", "partition"): "ACCESS EXCLUSIVE", ("drop", "view"): "ACCESS EXCLUSIVE", ("alter", "view"): "ACCESS EXCLUSIVE",
}
#: Levels that the compatible mode knows: it reports index creation as the strongest.
COMPAT = {("create", "index"): "ACCESS EXCLUSIVE", ("create", "foreign_key"): "ACCESS EXCLUSIVE"}
NARROW_TARGETS = ("smallint", "integer", "character varying(")
WIDTH = {"smallint": 2, "integer": 4, "bigint": 8}


def production() -> bool:
    return os.environ.get("SPARKPACT_PROD") == "1"


def narrows(old: str, new: str, compat: bool = False) -> bool:
    """Whether a type change can lose values. compat: judge by the new type alone."""
    if compat:
        return new.startswith(NARROW_TARGETS)
    if old == new:
        return False
    if new in WIDTH:
        return WIDTH.get(old, 99) > WIDTH[new]
    if new.startswith("character varying("):
        size = lambda t: int(t[t.index("(") + 1 : -1]) if t.startswith(("character varying(", "character(")) else 1 << 30
        return size(old) > size(new)
    return new in ("real",) and old == "double precision"


def lint_ops(ops: DataFrame, allow_destructive: bool = False, in_production: bool | None = None, compat: bool = False) -> DataFrame:
    """(rule, severity, op, kind, key, message) of operations (the diff's relation) that break a rule."""
    spark = ops.sparkSession
    prod = production() if in_production is None else in_production
    rules = F.broadcast(local_relation(spark, RULES, "rule string, op string, kind string, severity string, destructive boolean, message string"))
    old, new = F.coalesce("old", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), F.coalesce("new", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    old_type, new_type = F.try_element_at(old, F.lit("data_type")), F.try_element_at(new, F.lit("data_type"))
    width = lambda t: F.when(t == "smallint", 2).when(t == "integer", 4).when(t == "bigint", 8).otherwise(99)
    chars = lambda t: F.when(t.rlike(r"^character( varying)?\("), F.regexp_extract(t, r"\((\d+)\)", 1).cast("int")).otherwise(1 << 30)
    narrower = F.array_contains("changed", "data_type") & (
        new_type.isin("smallint", "integer") | new_type.startswith("character varying(") if compat else (new_type.isin("smallint", "integer", "bigint") & (width(old_type) > width(new_type))) | (new_type.startswith("character varying(") & (chars(old_type) > chars(new_type)))
    )
    material = F.coalesce(F.try_element_at(old, F.lit("materialized")), F.lit("false")) == "true"
    tests = (
        F.when(F.col("rule") == "deny_drop_table_in_prod", F.lit(prod))
        .when(F.col("rule") == "deny_drop_table", F.lit(not prod))
        .when(F.col("rule") == "warn_type_narrowing", narrower)
        .when(F.col("rule") == "warn_set_not_null", F.array_contains("changed", "nullable") & (F.try_element_at(new, F.lit("nullable")) == "false"))
        .when(F.col("rule") == "deny_drop_view", ~material)
        .when(F.col("rule") == "deny_drop_materialized_view", material)
        .when(F.col("rule") == "deny_drop_unique_constraint", F.coalesce(F.try_element_at(old, F.lit("is_constraint")), F.lit("false")) == "true")
        .when(F.col("rule") == "warn_sequence_restart", F.array_contains("changed", "start"))
        .otherwise(True)
    )
    found = ops.join(rules, ["op", "kind"]).where(tests)
    if allow_destructive:
        found = found.where("not destructive")
    return found.select("rule", "severity", "op", "kind", "key", "message")


def has_errors(found: DataFrame) -> bool:
    return bool(found.where("severity = 'error'").head(1))


def lock_of(op: dict, compat: bool = False) -> str | None:
    """The lock of one operation. A column's default change takes none that blocks reads for long."""
    at = (op["op"], op["kind"])
    if at == ("alter", "column"):
        return "ACCESS EXCLUSIVE" if {"data_type", "nullable"} & {*(op.get("changed") or [])} else None
    return (COMPAT.get(at) if compat else None) or LOCKS.get(at)


def lock_hazards(ops: DataFrame, compat: bool = False) -> DataFrame:
    """(op, kind, key, lock) of operations that lock a table, as a join with the table of locks."""
    table = [(a, b, (COMPAT.get((a, b)) if compat else None) or lock) for (a, b), lock in LOCKS.items()]
    locks = F.broadcast(local_relation(ops.sparkSession, table, "op string, kind string, lock string"))
    column = ops.where("op = 'alter' and kind = 'column' and arrays_overlap(changed, array('data_type', 'nullable'))").select("op", "kind", "key", F.lit("ACCESS EXCLUSIVE").alias("lock"))
    return ops.join(locks, ["op", "kind"]).select("op", "kind", "key", "lock").unionByName(column)

