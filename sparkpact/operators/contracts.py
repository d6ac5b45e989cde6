"""Declared contracts as plans over data: each function returns violations or transformed rows.

All are built-in DataFrame operations. Keys are compared as SQL does: a key with any NULL is no
duplicate (UNIQUE) and no orphan (FOREIGN KEY), a CHECK that is NULL passes. Where one key may
hold many rows, aggregation combines before the shuffle, and joins are left to Spark, which
broadcasts a side only under its size threshold and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkpact.operators.pinned import pinned


def _all_set(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_nulls) of columns that hold NULL. One pass over the data, whatever the number of columns."""
    counts = df.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "column", "n_nulls").where("n_nulls > 0")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_nulls) of every column."""
    counts = df.select(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot(["_rows"], list(columns), "column", "n_nulls").select("column", F.col("_rows").alias("n_rows"), "n_nulls")


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold NULL, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~_all_set(keys))


def unique_violations(df: DataFrame, keys: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Duplicate keys of a (partial) unique index; NULLs are distinct."""
    rows = df if predicate is None else df.where(predicate)
    return rows.where(_all_set(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_orphans(child: DataFrame, parent: DataFrame, columns: Sequence[str], ref_columns: Sequence[str]) -> DataFrame:
    """Child rows without a parent (MATCH SIMPLE: a key with any NULL passes). The parent is cut to its key."""
    names = [f"_ref_{k}" for k in range(len(ref_columns))]
    keys = parent.select(*(F.col(c).alias(n) for c, n in zip(ref_columns, names, strict=True)))
    on = [F.col(c) == F.col(n) for c, n in zip(columns, names, strict=True)]
    return child.where(_all_set(columns)).join(keys, on, "left_anti")


def apply_delete(child: DataFrame, deleted: DataFrame, columns: Sequence[str], ref_columns: Sequence[str], action: str, default: dict[str, Column] | None = None) -> DataFrame:
    """Child rows after parents were deleted: CASCADE, SET NULL, SET DEFAULT, or the rows in the way
    of RESTRICT and NO ACTION."""
    names = [f"_ref_{k}" for k in range(len(ref_columns))]
    keys = deleted.select(*(F.col(c).alias(n) for c, n in zip(ref_columns, names, strict=True)))
    on = [F.col(c) == F.col(n) for c, n in zip(columns, names, strict=True)]
    action = action.upper().replace("_", " ")
    if action == "CASCADE":
        return child.join(keys, on, "left_anti")
    if action in ("RESTRICT", "NO ACTION"):
        return child.join(keys, on, "left_semi")
    if action not in ("SET NULL", "SET DEFAULT"):
        raise ValueError(f"unknown referential action {action}")
    hit = child.join(keys.distinct().withColumn("_hit", F.lit(True)), on, "left")
    new = {c: (default or {}).get(c, F.lit(None)) if action == "SET DEFAULT" else F.lit(None) for c in columns}
    return hit.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in child.columns))


def check_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with the names of the checks they fail; a check that is NULL passes."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in sorted(checks.items()))), lambda x: x.isNotNull())
    return df.withColumn("failed_checks", failed).where(F.size("failed_checks") > 0)


def domain_violations(df: DataFrame, column: str, not_null: bool = False, checks: dict[str, Column] | None = None) -> DataFrame:
    """Rows whose value is outside the domain of a column."""
    all_checks = dict(checks or {})
    if not_null:
        all_checks["not_null"] = F.col(column).isNotNull()
    return check_violations(df, all_checks)


def enum_violations(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the enum and their row counts; NULL passes."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def enum_position(column: str, values: Sequence[str]) -> Column:
    """Sort key of an enum value: its place in the declaration; NULL if it has none."""
    return F.nullif(F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column)), F.lit(0))


#: Level of ranges that are open on a side: one bin holds them all.
OPEN_LEVEL = 1 << 10


def exclusion_conflicts(df: DataFrame, id_col: str, equal: Sequence[str], low: Column, high: Column, bin_width: float) -> DataFrame:
    """Pairs of rows with equal keys whose half-open ranges [low, high) overlap; a bound that is NULL
    is open. Empty ranges and NULL keys conflict with nothing.

    A range join without comparing all pairs of a key: a range's level is the number of doublings of
    bin_width that make a bin as long as it is, so at its own level it touches two bins at most, and
    at coarser levels no more. Two ranges meet in a bin of the coarser one's level, and each pair is
    reported in the bin where the later of the two begins. Ranges of any length make a few rows each
    (two for each level that occurs). Choose bin_width near the typical length of a range.
    """
    row = df.where((low < high) | low.isNull() | high.isNull()).select(F.col(id_col).alias("id"), *(F.col(c).alias(f"_k{k}") for k, c in enumerate(equal)), low.alias("low"), high.alias("high"))
    level = F.when(F.col("low").isNull() | F.col("high").isNull(), F.lit(OPEN_LEVEL)).otherwise(F.greatest(F.lit(0), F.ceil(F.log2((F.col("high") - F.col("low")) / bin_width)))).cast("int")
    row = row.withColumn("level", level)
    levels = [r[0] for r in row.select("level").distinct().orderBy("level").collect()]  # some sixty at most
    width = F.when(F.col("bin_level") < OPEN_LEVEL, F.lit(float(bin_width)) * F.pow(F.lit(2.0), F.col("bin_level")))
    first = F.when(F.col("bin_level") < OPEN_LEVEL, F.floor(F.col("low") / width)).otherwise(0).cast("long")
    last = F.when(F.col("bin_level") < OPEN_LEVEL, F.ceil(F.col("high") / width) - 1).otherwise(0).cast("long")

    def binned(at: Column) -> DataFrame:
        placed = row.withColumn("bin_level", at)
        return placed.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))

    all_levels = F.array(*(F.lit(x) for x in levels)).cast("array<int>")
    home = binned(F.col("level"))
    visitor = binned(F.explode(F.filter(all_levels, lambda x: x >= F.col("level"))))
    keys = [*(f"_k{k}" for k in range(len(equal))), "bin_level", "bin"]
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("id", "low", "high", "level")))
    before = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.lit(True))
    both = side(home, "a").join(side(visitor, "b"), keys)
    once = (F.col("b_level") < F.col("a_level")) | (F.col("a_id") < F.col("b_id"))
    begin = F.greatest("a_low", "b_low")
    own_bin = (F.col("bin_level") == OPEN_LEVEL) | (F.col("bin") == F.floor(begin / width))
    found = both.where(once & before("a_low", "b_high") & before("b_low", "a_high") & own_bin)
    return found.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))


def route_range(column: Column, bounds: Sequence[tuple[str, object, object]], default: str | None = None) -> Column:
    """Partition name by half-open bounds [from, to); None is MINVALUE or MAXVALUE. NULL goes to the default."""
    out = F.lit(default) if default else F.lit(None).cast("string")
    for name, low, high in reversed(bounds):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (column >= F.lit(low))
        if high is not None:
            inside = inside & (column < F.lit(high))
        out = F.when(column.isNotNull() & inside, F.lit(name)).otherwise(out)
    return out


def route_list(column: Column, lists: dict[str, Sequence[object]], default: str | None = None) -> Column:
    """Partition name by value lists; a list may hold None."""
    out = F.lit(default) if default else F.lit(None).cast("string")
    for name, values in lists.items():
        hit = column.isin(*[v for v in values if v is not None])
        if None in values:
            hit = hit | column.isNull()
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def route_hash(keys: Sequence[Column], parts: Sequence[tuple[str, int, int]], hashed: Column | None = None) -> Column:
    """Partition name by hash modulo modulus = remainder; the hash is xxhash64(keys) unless another
    whole number is given. The server's own hash differs."""
    value = F.xxhash64(*keys) if hashed is None else hashed
    out = F.lit(None).cast("string")
    for name, modulus, remainder in parts:
        out = F.when(F.pmod(value, F.lit(modulus)) == remainder, F.lit(name)).otherwise(out)
    return out


def apply_policies(df: DataFrame, policies: Sequence[dict], command: str, role: str, enabled: bool = True, written: bool = False) -> DataFrame:
    """Rows that a role may see (SELECT, UPDATE, DELETE: USING) or, with written=True or for INSERT,
    may write (WITH CHECK, else USING): an UPDATE passes its old rows and then its new ones.

    Permissive policies are OR-ed, restrictive ones (permissive False) AND-ed; row security without
    a permissive policy for the role lets nothing through. A policy may give, in place of using,
    exists: (relation, [(column, its column), …]), which holds where the relation has such a row.
    """
    if not enabled:
        return df
    allowed, required, columns = F.lit(False), F.lit(True), df.columns
    writes = written or command.upper() == "INSERT"
    for k, p in enumerate(policies):
        roles = p.get("roles", ["public"])
        if p.get("command", "ALL").upper() not in ("ALL", command.upper()) or role not in roles and "public" not in roles:
            continue
        test = p.get("check") if writes and p.get("check") is not None else p.get("using")
        if test is None and p.get("exists") is not None:
            relation, on = p["exists"]
            known = relation.select(*(F.col(r).alias(f"_policy_{k}_{n}") for n, (_, r) in enumerate(on))).dropna().distinct().withColumn(f"_policy_{k}", F.lit(True))
            df = df.join(known, [F.col(c) == F.col(f"_policy_{k}_{n}") for n, (c, _) in enumerate(on)], "left")
            test = F.col(f"_policy_{k}").isNotNull()
        test = F.coalesce(test if test is not None else F.lit(True), F.lit(False))
        if p.get("permissive", True):
            allowed = allowed | test
        else:
            required = required & test
    return df.where(allowed & required).select(*columns)


def generated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Stored generated columns, in the given order; a later one may use an earlier."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that are absent get their default; explicit NULLs stay."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def version_view(df: DataFrame, mappings: Sequence[tuple[str, str]]) -> DataFrame:
    """A version view: (virtual name, physical name)."""
    return df.select(*(F.col(physical).alias(virtual) for virtual, physical in mappings))


def assign_sequence(df: DataFrame, order: Sequence[Column | str], name: str = "seq", start: int = 1, increment: int = 1, low: int | None = None, high: int | None = None, cycle: bool = False) -> DataFrame:
    """Sequence values in a given order, without one task that sees all rows: rows are sorted into
    ranges, each range is numbered by itself, and a small table of range sizes gives the offsets.
    Ranges are drawn by sampling, so the numbered rows are written once and used twice. A value
    beyond high (or below low, counting down) is an error when it is read, unless the sequence cycles."""
    parts = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_at")
    value = F.lit(start) + number * increment
    if cycle and low is not None and high is not None:
        length = (high - low) // abs(increment) + 1
        origin = start - low if increment > 0 else high - start
        step = F.pmod(F.lit(origin // abs(increment)) + number, F.lit(length))
        value = F.lit(low) + step * increment if increment > 0 else F.lit(high) + step * increment
    elif (limit := high if increment > 0 else low) is not None:
        beyond = value > F.lit(limit) if increment > 0 else value < F.lit(limit)
        value = F.when(beyond, F.raise_error(F.lit(f"sequence {name} has reached its limit {limit}")).cast("long")).otherwise(value)
    # one row for each range
    return parts.join(F.broadcast(before), "_part").withColumn(name, value.cast("long")).drop("_part", "_at", "_before")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Keyed snapshot diff: key, op (create, update, drop) and changed_fields. Compares null-safely, keys too."""
    columns = list(columns if columns is not None else [c for c in new.columns if c not in keys])
    side = lambda df, p: df.select(*(F.col(c).alias(f"_{p}_{k}") for k, c in enumerate(keys)), F.struct(*(F.col(c) for c in columns)).alias(f"_{p}"), F.lit(True).alias(f"_in_{p}"))
    same = [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in range(len(keys))]
    both = side(old, "old").join(side(new, "new"), same, "full_outer")
    both = both.select(*(F.when(F.col("_in_new"), F.col(f"_new_{k}")).otherwise(F.col(f"_old_{k}")).alias(c) for k, c in enumerate(keys)), "_old", "_in_old", "_new", "_in_new")
    changed = F.filter(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    op = F.when(F.col("_in_old").isNull(), F.lit("create")).when(F.col("_in_new").isNull(), F.lit("drop")).when(F.size(changed) > 0, F.lit("update"))
    return both.withColumn("op", op).where("op is not null").withColumn("changed_fields", F.when(F.col("op") == "update", changed).otherwise(F.array().cast("array<string>")))


def audit(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What an AFTER UPDATE trigger with IS DISTINCT FROM would log: (key, field, old_value, new_value)."""
    found = changes(old, new, keys, columns).where("op = 'update'")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_old.{c}").cast("string").alias("old_value"), F.col(f"_new.{c}").cast("string").alias("new_value")) for c in columns))
    return found.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def row_fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values as text, each after its length, so that no value runs into the next
    and NULL is like no text."""
    text = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("~")) for c in columns)), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_rows and an order-free digest in which repeated rows count: the sums of two 60-bit pieces of
    the rows' hashes."""
    hashed = df.select(row_fingerprint(df, columns).alias("h"))
    lane = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)"))
    digest = lambda at: F.coalesce(lane(at).cast("string"), F.lit("0"))
    return hashed.agg(F.count("*").alias("n_rows"), F.concat(digest(1), F.lit("-"), digest(16)).alias("fingerprint"))


def ordered_aggregate(df: DataFrame, group: Sequence[str], order: Column, value: Column, separator: str, name: str) -> DataFrame:
    """A user aggregate with a concatenating transition function, fed in a stated order. The order
    makes a group's values one list, as its text is one value: it is for groups that fit a task."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(items, lambda x: x["v"]), separator).alias(name))


def narrowing_safe(df: DataFrame, ranges: dict[str, tuple[float, float]], lengths: dict[str, int] | None = None) -> DataFrame:
    """(column, lowest, highest, safe): whether every value fits the narrower type, before a type change."""
    cells = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for c, (a, b) in ranges.items()]
    cells += [F.struct(F.lit(c).alias("column"), F.min(F.length(c)).cast("double").alias("lowest"), F.max(F.length(c)).cast("double").alias("highest"), F.lit(0.0).alias("a"), F.lit(float(n)).alias("b")) for c, n in (lengths or {}).items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.column", "c.lowest", "c.highest", F.coalesce((F.col("c.lowest") >= F.col("c.a")) & (F.col("c.highest") <= F.col("c.b")), F.lit(True)).alias("safe"))
