"""Declared routines in Spark: SQL functions as temporary functions, aggregates as folds."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.functions.types import spark_type
from sparkpact.plans.references import is_procedural
from sparkpact.sources.catalog import Catalog, Obj


def function_sql(o: Obj) -> str:
    """CREATE TEMPORARY FUNCTION for a function in SQL: scalar, or a table function for SETOF and TABLE.

    Positional parameters become names; procedural bodies are refused.
    """
    a = o.attrs
    if a["language"] != "sql" or is_procedural(a["body"]):
        raise ValueError(f"{o.key} is not an SQL function")
    names = [p["name"] or f"arg{k + 1}" for k, p in enumerate(a["args"]) if p["mode"] != "OUT"]
    kinds = [spark_type(p["type"]).simpleString() for p in a["args"] if p["mode"] != "OUT"]
    defaults = [p["default"] for p in a["args"] if p["mode"] != "OUT"]
    body = re.sub(r"\$(\d+)", lambda m: names[int(m[1]) - 1], a["body"].strip().rstrip(";").strip())
    body = re.sub(r"(?i)^return\s+", "", body)
    args = ", ".join(f"`{n}` {k}" + (f" DEFAULT {d}" if d else "") for n, k, d in zip(names, kinds, defaults, strict=True))
    returns = a["return_type"]
    name = o.name.partition("(")[0]
    if returns.startswith("TABLE("):
        cells = ", ".join(f"`{c.split()[0]}` {spark_type(c.split(None, 1)[1]).simpleString()}" for c in returns[6:-1].split(", "))
        return f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({args}) RETURNS TABLE ({cells}) RETURN {body}"
    if returns.startswith("SETOF "):
        return f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({args}) RETURNS TABLE (value {spark_type(returns[6:]).simpleString()}) RETURN {body}"
    query = f"({body})" if re.match(r"(?i)(select|with)\b", body) else body
    return f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({args}) RETURNS {spark_type(returns).simpleString()} RETURN {query}"


def register_functions(spark: SparkSession, catalog: Catalog) -> tuple[list[str], list[str]]:
    """Register every SQL function of a catalog; (registered, left out)."""
    done, left = [], []
    for o in sorted(catalog.of("function"), key=lambda o: o.key):
        try:
            spark.sql(function_sql(o))
            done.append(o.key)
        except ValueError:
            left.append(o.key)
    return done, left


def fold(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, initial: Column, step: Callable[[Column, Column], Column], name: str, final: Callable[[Column], Column] | None = None) -> DataFrame:
    """A user aggregate: a transition function over a group's values in a stated order, NULLs
    included, then a final function. The order makes a group's values one list: it is for groups
    that fit a task; associative aggregates should use Spark's own."""
    items = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), value.alias("v"))))
    listed = df.groupBy(*group).agg(items.alias("_items"))
    folded = F.aggregate("_items", initial, lambda acc, x: step(acc, x["v"]), final if final is not None else (lambda acc: acc))
    return listed.select(*group, folded.alias(name))


def refresh_materialized(view: DataFrame, path: str) -> DataFrame:
    """Write a materialized view's rows anew and read them back; readers keep the old rows until then."""
    view.write.mode("overwrite").parquet(path)
    return view.sparkSession.read.parquet(path)
