"""Schema differences as keyed joins of catalog relations.

One null-safe full outer join on (kind, key) compares every kind of object. Expressions are
compared by canonical form: the canonical text is made when the relation is built, so the join
compares plain columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkpact.functions.normalize import canonical, same_body
from sparkpact.functions.types import canonical_type
from sparkpact.sources.catalog import KINDS, TABLE_PARTS, Catalog, Obj, local_relation, parsed

OP_SCHEMA = "op string, kind string, key string, schema string, parent string, name string, changed array<string>, old map<string,string>, new map<string,string>"


def compared(o: Obj, compat: bool = False) -> dict[str, str]:
    """The attributes that count for equality, in canonical form."""
    spec, text = KINDS[o.kind], o.text_attrs()
    out = {a: text[a] for a in spec.compare if a in text}
    for a in ("deferrable", "initially_deferred"):
        if a in spec.compare:
            out.setdefault(a, "false")
    if o.kind == "function" and o.attrs.get("args"):
        out["args"] = json.dumps([{**x, "default": canonical(x["default"]) if x.get("default") else None} for x in o.attrs["args"]], sort_keys=True)
    for a in spec.expressions:
        if a in text:
            if o.kind == "function":
                out[a] = " ".join(text[a].split())
            elif isinstance(o.attrs[a], list):
                out[a] = json.dumps([canonical(x, compat) if isinstance(x, str) else {k: canonical(v, compat) for k, v in sorted(x.items())} for x in o.attrs[a]])
            else:
                out[a] = json.dumps(canonical(text[a], compat))
    return out


def relation(spark: SparkSession, catalog: Catalog, compat: bool = False) -> DataFrame:
    """(kind, key, schema, parent, name, attrs, compared)."""
    rows = [(o.kind, o.key, o.schema, o.parent, o.name, o.text_attrs(), compared(o, compat)) for o in catalog.objects.values()]
    return local_relation(spark, rows, "kind string, key string, schema string, parent string, name string, attrs map<string,string>, compared map<string,string>")


#: What the compatible mode compares of a kind, where that is less: foreign keys by name only, no
#: extension versions, partition bounds, domain types or policy commands.
COMPAT_FIELDS = {"foreign_key": (), "extension": (), "partition": (), "table": ("rls", "force_rls"), "domain": ("default", "not_null"), "policy": ("roles", "using", "check")}


def spec_relation(spark: SparkSession, compat: bool = False) -> DataFrame:
    fields = lambda k: list(COMPAT_FIELDS[k.name]) if compat and k.name in COMPAT_FIELDS else [*k.compare, *k.expressions]
    rows = [(k.name, k.on_change, k.tier, fields(k), list(k.optional)) for k in KINDS.values()]
    return local_relation(spark, rows, "kind string, on_change string, tier int, fields array<string>, optional array<string>")


def diff_relations(current: DataFrame, target: DataFrame, specs: DataFrame) -> DataFrame:
    """Operations (OP_SCHEMA) that turn current into target, unordered.

    A kind's spec says what a change means: alter gives one operation, recreate a drop and a
    create, ignore none. Optional attributes count only where the target states them.
    """
    side = lambda df, p: df.select("kind", "key", *(F.col(c).alias(f"{p}_{c}") for c in ("schema", "parent", "name", "attrs", "compared")))
    both = side(current, "c").join(side(target, "t"), ["kind", "key"], "full_outer").join(F.broadcast(specs), "kind")
    in_c, in_t = F.col("c_name").isNotNull(), F.col("t_name").isNotNull()

    def differs(f: Column) -> Column:
        old, new = F.try_element_at("c_compared", f), F.try_element_at("t_compared", f)
        return ~old.eqNullSafe(new) & ~(F.array_contains("optional", f) & new.isNull())

    changed = F.filter("fields", differs)
    rows = both.withColumn("changed", F.when(in_c & in_t, changed).otherwise(F.array().cast("array<string>")))
    ops = (
        F.when(~in_c, F.array(F.lit("create")))
        .when(~in_t, F.array(F.lit("drop")))
        .when((F.size("changed") == 0) | (F.col("on_change") == "ignore"), F.array().cast("array<string>"))
        .when((F.col("on_change") == "recreate") | ((F.col("kind") == "column") & F.array_contains("changed", "generated")) | ((F.col("kind") == "function") & F.arrays_overlap("changed", F.array(F.lit("return_type"), F.lit("args")))), F.array(F.lit("drop"), F.lit("create")))
        .otherwise(F.array(F.lit("alter")))
    )
    # a trigger that differs in its mode only is altered
    ops = F.when((F.col("kind") == "trigger") & F.col("changed").eqNullSafe(F.array(F.lit("enabled"))), F.array(F.lit("alter"))).otherwise(ops)
    pick = lambda c: F.coalesce(f"t_{c}", f"c_{c}").alias(c)
    return rows.select(F.explode(ops).alias("op"), "kind", "key", pick("schema"), pick("parent"), pick("name"), "changed", F.col("c_attrs").alias("old"), F.col("t_attrs").alias("new"))


def diff(spark: SparkSession, current: Catalog, target: Catalog, **flags) -> DataFrame:
    """Operations from current to target, as a relation; flags as in diff_rows()."""
    return operations(spark, diff_rows(spark, current, target, **flags))


def operations(spark: SparkSession, rows: Iterable[Row]) -> DataFrame:
    """Operations as a relation, for the joins with rules and locks."""
    return local_relation(spark, [tuple(r) for r in rows], OP_SCHEMA)


def diff_rows(spark: SparkSession, current: Catalog, target: Catalog, manage_ownership: bool = True, manage_grants: bool = True, excluded_roles: Sequence[str] = (), compat: bool = False) -> list[Row]:
    """Operations from current to target, with what dropped or altered objects force along. The
    schemas are compared by a join; the operations, which are ordered one by one anyway, come to the
    driver once.

    compat: compare only what COMPAT_FIELDS says, and of enums only values that were added.
    """
    skip = (() if manage_ownership else ("owner",)) + (() if manage_grants else ("grant", "default_privilege"))
    ops = diff_relations(relation(spark, current, compat), relation(spark, target, compat), spec_relation(spark, compat)).where(~F.col("kind").isin(*skip, ""))
    if compat:
        values = lambda side: F.from_json(F.col(side)["values"], "array<string>")
        ops = ops.where(~((F.col("kind") == "enum") & (F.col("op") == "alter")) | (F.size(F.array_except(values("new"), values("old"))) > 0))
    if excluded_roles:
        ops = ops.where(~((F.col("kind") == "grant") & F.lower(F.coalesce(F.col("new")["grantee"], F.col("old")["grantee"])).isin([r.lower() for r in excluded_roles])))
    # who owns what nobody declares an owner of is no matter of the declaration
    ops = ops.where("not (kind = 'owner' and op = 'drop')")
    rows = ops.collect()
    # what a table holds goes with the table
    gone = {r["key"] for r in rows if r["op"] == "drop" and r["kind"] in ("table", "partition")}
    kept = [r for r in rows if not (r["op"] == "drop" and r["kind"] in TABLE_PARTS and r["parent"] in gone)]
    return with_recreations(kept, current, target)


def reference_relation(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """(kind, owner, target): what each view, policy, trigger, function, check … refers to."""
    from sparkpact.plans.references import catalog_references

    return local_relation(spark, sorted(catalog_references(catalog)), "kind string, owner string, target string")


def reaching(pairs: Iterable[tuple[str, str]], roots: Iterable[str]) -> set[str]:
    """Owners that reach one of the roots through (owner, target) pairs, by frontiers: each owner is
    met once, however long the chains and however many the paths; cycles end where they were."""
    owners: dict[str, set[str]] = {}
    for owner, target in pairs:
        owners.setdefault(target, set()).add(owner)
    found: set[str] = set()
    frontier = set(roots)
    while frontier:
        frontier = {o for t in frontier for o in owners.get(t, ())} - found
        found |= frontier
    return found


def dependent_closure(references: DataFrame, roots: Iterable[str]) -> DataFrame:
    """(owner) of those that reach one of the roots through references (owner, target), transitively.
    References are metadata, a row for each name that a declaration holds, and are walked on the driver."""
    pairs = [tuple(r) for r in references.select("owner", "target").distinct().collect()]
    return local_relation(references.sparkSession, [(o,) for o in sorted(reaching(pairs, roots))], "owner string")


def with_recreations(ops: list[Row], current: Catalog, target: Catalog) -> list[Row]:
    """Add the drop and create of views, policies, triggers and foreign keys that stand in the way
    of a type change or a dropped column, and take out the alters they replace."""
    from sparkpact.plans.references import catalog_references

    columns = [r for r in ops if r["kind"] == "column" and (r["op"] == "drop" or r["op"] == "alter" and "data_type" in r["changed"])]
    touched = {r["parent"] for r in columns}
    typed = {(r["parent"], r["name"]) for r in columns if r["op"] == "alter"}
    dropped_functions = {r["key"].partition("(")[0] for r in ops if r["kind"] == "function" and r["op"] == "drop"}
    if not touched and not dropped_functions:
        return ops
    references = catalog_references(current)
    forced = {("view", o) for o in reaching([(o, t) for kind, o, t in references if kind == "view"], touched)}
    forced |= {(o.kind, o.key) for o in [*current.of("policy"), *current.of("trigger")] if o.parent in touched}
    for o in current.of("foreign_key"):
        ends = {(o.parent, c) for c in o.attrs["columns"]} | {(o.attrs["ref_table"], c) for c in o.attrs["ref_columns"]}
        if ends & typed:
            forced.add((o.kind, o.key))
    forced |= {(kind, o) for kind, o, t in references if kind in ("policy", "view") and t in dropped_functions}
    fields = Row(*(c.split(" ")[0] for c in OP_SCHEMA.split(", ")))
    more = []
    for kind, key in sorted(forced):
        old, new = current.get(kind, key), target.get(kind, key)
        for op, o in (("drop", old), ("create", new)):
            if o is not None:
                more.append(fields(op, kind, key, o.schema, o.parent, o.name, [], old and old.text_attrs(), new and new.text_attrs()))
    replaced = {(r["kind"], r["key"]) for r in more}
    return [r for r in ops if (r["kind"], r["key"]) not in replaced] + more


def apply_ops(current: Catalog, ops: Iterable) -> Catalog:
    """The catalog after operations: the model behind the law apply(a, diff(a, b)) = b."""
    out = current.copy()
    rows = [r.asDict() if hasattr(r, "asDict") else r for r in ops]
    for r in sorted(rows, key=lambda r: {"drop": 0, "alter": 1, "create": 1}[r["op"]]):
        if r["op"] == "drop":
            out.remove(r["kind"], r["key"])
        else:
            out.add(Obj(r["kind"], r["schema"] or "", r["name"], r["parent"] or "", parsed(r["new"])), replace=True)
    return out


def grant_changes(current: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, grantee, op, privileges): what to grant and to revoke, by set difference for each grantee.

    Where the relations have a column grantable (the privileges held with grant option), also op
    grant option and revoke option, for privileges that stay. What is granted anew with the option
    comes as grant option only.
    """
    on = [*keys, "grantee"]
    none = F.array().cast("array<string>")
    gather = lambda df, p: df.groupBy(*on).agg(*(F.array_distinct(F.flatten(F.collect_list(c if c in df.columns else none))).alias(f"{p}_{c}") for c in ("privileges", "grantable")))
    both = gather(current, "c").join(gather(target, "t"), on, "full_outer")
    have, want, could, can = (F.coalesce(c, none) for c in ("c_privileges", "t_privileges", "c_grantable", "t_grantable"))
    steps = {"grant": F.array_except(F.array_except(want, have), can), "revoke": F.array_except(have, want), "grant option": F.array_except(can, could), "revoke option": F.array_except(F.array_intersect(could, want), can)}
    pairs = F.array(*(F.struct(F.lit(op).alias("op"), privileges.alias("privileges")) for op, privileges in steps.items()))
    return both.select(*on, F.explode(pairs).alias("p")).select(*on, "p.op", F.array_sort("p.privileges").alias("privileges")).where("size(privileges) > 0")


def new_enum_values(spark: SparkSession, current: Sequence[str], target: Sequence[str]) -> DataFrame:
    """(value, position, before, after): added enum values, AFTER the one before, or BEFORE the next if first."""
    have = local_relation(spark, [(v,) for v in current], "value string")
    want = local_relation(spark, [(v, k, target[k - 1] if k else None, target[1] if not k and len(target) > 1 else None) for k, v in enumerate(target)], "value string, position int, after string, before string")
    return want.join(have, "value", "left_anti").orderBy("position")


def same_type(a: str, b: str) -> bool:
    return canonical_type(a) == canonical_type(b)


__all__ = ["apply_ops", "compared", "dependent_closure", "diff", "diff_relations", "grant_changes", "new_enum_values", "reaching", "relation", "same_body", "same_type"]
