"""Static checks of one schema: references that lead nowhere, as anti joins over its relation."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.sources.catalog import Catalog, local_relation

LIST = "array<string>"


def check_relation(objects: DataFrame) -> DataFrame:
    """(rule, severity, key, detail) over a catalog relation; the cycle check is apart."""
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    of = lambda *kinds: objects.where(F.col("kind").isin(*kinds))
    tables = of("table", "partition").select(F.col("key").alias("t")).distinct()
    columns = of("column").select(F.col("key").alias("c")).distinct()
    types = of("enum", "domain").select(F.col("key").alias("u")).distinct()
    functions = of("function").select(F.split_part("key", F.lit("("), F.lit(1)).alias("f")).distinct()
    finding = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "key", "detail")
    fks = of("foreign_key").withColumn("detail", attr("ref_table"))
    orphans = fks.join(tables, F.col("detail") == F.col("t"), "left_anti")
    fk_columns = fks.join(tables, F.col("detail") == F.col("t"), "left_semi").select("key", F.explode(F.from_json(attr("ref_columns"), LIST)).alias("col"), "detail").withColumn("detail", F.concat_ws(".", "detail", "col")).join(columns, F.col("detail") == F.col("c"), "left_anti")
    typed = of("column").withColumn("detail", F.regexp_replace(attr("data_type"), r"(\[\])+$", "")).where(F.col("detail").rlike(r"^\w+\.\w+$")).join(types, F.col("detail") == F.col("u"), "left_anti")
    triggers = of("trigger")
    relations = tables.unionByName(of("view").select(F.col("key").alias("t")))
    no_table = triggers.withColumn("detail", F.col("parent")).join(relations, F.col("detail") == F.col("t"), "left_anti")
    no_function = triggers.withColumn("detail", attr("function")).where(~F.col("detail").startswith("pg_catalog.")).join(functions, F.col("detail") == F.col("f"), "left_anti")
    no_parent = of("partition").withColumn("detail", attr("parent")).join(tables, F.col("detail") == F.col("t"), "left_anti")
    owned = of("sequence").withColumn("column", attr("owned_by")).where("column is not null").withColumn("detail", F.regexp_extract("column", r"^(.*)\.[^.]+$", 1))
    no_owner = owned.join(tables, F.col("detail") == F.col("t"), "left_anti")
    no_column = owned.join(tables, F.col("detail") == F.col("t"), "left_semi").withColumn("detail", F.col("column")).join(columns, F.col("detail") == F.col("c"), "left_anti")
    out = None
    for df, rule in (
        (orphans, "fk_references_missing_table"), (fk_columns, "fk_references_missing_column"), (typed, "column_references_missing_enum"), (no_table, "trigger_references_missing_table"), (no_function, "trigger_references_missing_function"), (no_parent, "partition_references_missing_parent"), (no_owner, "sequence_owner_missing_table"), (no_column, "sequence_owner_missing_column"),
    ):
        out = finding(df, rule) if out is None else out.unionByName(finding(df, rule))
    return out


def circular_foreign_keys(catalog: Catalog) -> list[str]:
    """Tables that foreign keys tie into a ring or that only such tables refer to; self-references do not count."""
    needs: dict[str, set[str]] = defaultdict(set)
    for o in catalog.of("foreign_key"):
        if o.attrs["ref_table"] != o.parent:
            needs[o.parent].add(o.attrs["ref_table"])
    left = {t for t in needs} | {r for rs in needs.values() for r in rs}
    again = True
    while again:
        free = {t for t in left if not needs[t] & left}
        again = bool(free)
        left -= free
    return sorted(left)


def check(spark: SparkSession, catalog: Catalog) -> DataFrame:
    cycles = [("circular_foreign_keys", "warning", t, "") for t in circular_foreign_keys(catalog)]
    return check_relation(catalog.to_df(spark)).unionByName(local_relation(spark, cycles, "rule string, severity string, key string, detail string"))
