"""Planned operations over DataFrames: what a migration does to data, without a server.

Tables are DataFrames by key. Operations that change rows or columns are applied as plans;
operations that would fail on the data (NOT NULL, keys, foreign keys, checks) raise with the number
of violations; everything else is a matter of the catalog only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.functions.translate import to_spark
from sparkpact.functions.types import spark_type
from sparkpact.operators import contracts as C
from sparkpact.plans.references import relation_references


class ContractViolation(ValueError):
    pass


def _guard(found: DataFrame, what: str) -> None:
    n = found.count()
    if n:
        raise ContractViolation(f"{what}: {n} violations")


def translated(expression: str) -> str:
    """A server expression in Spark SQL."""
    return to_spark(expression)


def run_query(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A server query over tables by key. Each relation it names becomes a common table of its own
    name, so that it may stand wherever a relation may, with or without an alias."""
    found = {t: t.removeprefix("public.").replace(".", "__") for t in sorted(relation_references(query)) if t in tables}
    text = to_spark(query, found.get).replace("{", "{{").replace("}", "}}")  # braces name frames
    shared = ", ".join(f"`{name}` AS (SELECT * FROM {{r{k}}})" for k, name in enumerate(found.values()))
    if shared:
        head, rest = ("WITH RECURSIVE", text[15:]) if text[:15].lower() == "with recursive " else ("WITH", text[5:]) if text[:5].lower() == "with " else ("WITH", "")
        text = f"{head} {shared}, {rest}" if rest else f"{head} {shared} {text}"
    return spark.sql(text, **{f"r{k}": tables[t] for k, t in enumerate(found)})


def apply_operation(spark: SparkSession, tables: dict[str, DataFrame], op: dict) -> dict[str, DataFrame]:
    """The tables after one operation."""
    kind, what, key, parent, name = op["kind"], op["op"], op["key"], op["parent"], op["name"]
    new, changed = op["new"] or {}, op.get("changed") or []
    out = dict(tables)
    own = tables.get(parent) if parent else tables.get(key)
    if kind == "table":
        if what == "create":
            out.setdefault(key, spark.createDataFrame([], ""))
        elif what == "drop":
            out.pop(key, None)
        return out
    if own is None and kind not in ("view",):
        return out
    if kind == "column":
        if what == "create":
            cast = spark_type(new["data_type"])
            value = F.expr(translated(new["generated"])) if new.get("generated") else F.expr(translated(new["default"])) if new.get("default") and "nextval" not in new["default"] else F.lit(None)
            out[parent] = own.withColumn(name, value.cast(cast)) if own.columns else spark.createDataFrame([], f"`{name}` {cast.simpleString()}")
            if not new.get("nullable", True):
                _guard(out[parent].where(F.col(name).isNull()), f"{key} is NOT NULL")
        elif what == "drop":
            out[parent] = own.drop(name)
        else:
            if "data_type" in changed:
                cast = spark_type(new["data_type"])
                moved = own.withColumn("_new", F.col(name).try_cast(cast))
                _guard(moved.where(F.col(name).isNotNull() & F.col("_new").isNull()), f"{key} to {new['data_type']}")
                out[parent] = moved.withColumn(name, F.col("_new")).drop("_new")
            if "nullable" in changed and not new.get("nullable", True):
                _guard(out[parent].where(F.col(name).isNull()), f"{key} is NOT NULL")
        return out
    if what == "backfill":
        if new.get("default") and "nextval" not in new["default"]:
            out[parent] = own.withColumn(name, F.coalesce(F.col(name), F.expr(translated(new["default"])).cast(spark_type(new["data_type"]))))
        return out
    if what == "create":
        if kind == "primary_key":
            _guard(C.primary_key_violations(own, new["columns"]), f"primary key of {parent}")
        elif kind == "index" and new.get("unique"):
            cut = own.where(F.expr(translated(new["predicate"]))) if new.get("predicate") else own
            keyed = cut.select(*(F.expr(translated(c)).alias(f"k{i}") for i, c in enumerate(new["columns"])))
            _guard(C.unique_violations(keyed, keyed.columns), f"unique index {key}")
        elif kind == "foreign_key" and new["ref_table"] in tables:
            _guard(C.foreign_key_orphans(own, tables[new["ref_table"]], new["columns"], new["ref_columns"]), f"foreign key {key}")
        elif kind == "exclusion":
            _guard(exclusion_violations(own, new["elements"], new.get("where")), f"exclusion constraint {key}")
        elif kind == "check":
            _guard(C.check_violations(own, {name: F.expr(translated(new["expression"]))}), f"check {key}")
    if kind == "view":
        if what == "drop":
            out.pop(key, None)
        else:
            view = run_query(spark, new["query"], tables)
            out[key] = view.toDF(*new["columns"]) if new.get("columns") else view
    return out


def exclusion_violations(df: DataFrame, elements: list[dict], where: str | None) -> DataFrame:
    """Pairs of rows that an exclusion constraint forbids: equal in its = elements, and overlapping in
    its && element (a range column: a struct with lower and upper, open where NULL)."""
    rows = df.where(F.expr(translated(where))) if where else df
    equal = [e["expr"] for e in elements if e["op"] == "="]
    over = [e["expr"] for e in elements if e["op"] == "&&"]
    if len(equal) + len(over) != len(elements) or len(over) > 1:
        raise ValueError(f"exclusion operators {[e['op'] for e in elements]}")
    keyed = rows.select(*(F.expr(translated(e)).alias(f"k{n}") for n, e in enumerate(equal)), *(F.expr(translated(e)).alias("span") for e in over), F.monotonically_increasing_id().alias("row"))
    names = [f"k{n}" for n in range(len(equal))]
    if not over:
        return C.unique_violations(keyed, names)
    bound = lambda side: F.col(f"span.{side}").cast("timestamp").cast("double") if dict(rows.select(F.expr(translated(over[0])).alias("s")).select("s.lower").dtypes)["lower"] in ("date", "timestamp", "timestamp_ntz") else F.col(f"span.{side}").cast("double")
    return C.exclusion_conflicts(keyed.where("span is not null"), "row", names, bound("lower"), bound("upper"), 1.0)


def apply_migration(spark: SparkSession, tables: dict[str, DataFrame], ops: Iterable[dict]) -> dict[str, DataFrame]:
    """All or nothing: the tables after every operation; a violation leaves the caller's tables as they were."""
    for op in ops:
        tables = apply_operation(spark, tables, op)
    return tables


def validate(spark: SparkSession, tables: dict[str, DataFrame], ops: Iterable[dict]) -> list[str]:
    """What would go wrong, operation by operation; those that fail are passed over."""
    errors = []
    for op in ops:
        try:
            tables = apply_operation(spark, tables, op)
        except (ContractViolation, ValueError, PySparkException) as e:
            errors.append(f"{op['op']} {op['kind']} {op['key']}: {str(e).splitlines()[0]}" if not isinstance(e, ContractViolation) else str(e))
    return errors
