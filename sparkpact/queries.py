"""Queries of the schema and contract engine over the driver's tables, and their SQL.

Each entry pairs a plan built from the package's operators with the SQL that DuckDB runs over the
same tables. Sums of doubles are rounded, so that their order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.operators import contracts as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def declared_views(spark: SparkSession, sf_dir: str, ddl: str, tables: str) -> dict[str, DataFrame]:
    """Tables and views after the views of some DDL text were made over the driver's tables."""
    from sparkpact.operators.apply import apply_migration
    from sparkpact.plans.lifecycle import creations
    from sparkpact.plans.planner import dump_order
    from sparkpact.sources.ddl import parse_ddl

    frames = {f"public.{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
    return apply_migration(spark, frames, dump_order(creations(parse_ddl(ddl))))


def sql_view(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A declared view over the named tables: its DDL is read, planned, translated and run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return declared_views(spark, sf_dir, f"CREATE VIEW {name} AS {text};", tables)[f"public.{name}"]

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle if oracle is not None else text


# -- keyed differences -----------------------------------------------------------------------------


def later_orders(orders: DataFrame) -> DataFrame:
    """A later snapshot: some orders gone, some repriced, some with another status, some new."""
    kept = orders.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return kept.unionByName(orders.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


LATER = """later AS (
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority
    FROM orders WHERE o_orderkey % 17 <> 0
    UNION ALL
    SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 13 = 0
)"""
COMPARED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(f"""WITH {LATER}
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
           CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN n.o_orderkey IS NULL THEN 'drop' ELSE 'update' END AS op,
           CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
             CASE WHEN o.o_custkey IS DISTINCT FROM n.o_custkey THEN 'o_custkey' END,
             CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END,
             CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END,
             CASE WHEN o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'o_orderpriority' END) END AS changed_fields
    FROM orders o FULL OUTER JOIN later n ON o.o_orderkey = n.o_orderkey
    WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_custkey IS DISTINCT FROM n.o_custkey
       OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice
       OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority""")
def snapshot_diff_orders(t, spark):
    found = C.changes(t("orders"), later_orders(t("orders")), ["o_orderkey"], COMPARED)
    return found.select("o_orderkey", "op", F.array_join("changed_fields", ",").alias("changed_fields"))


@query(f"""WITH {LATER}, c AS (
      SELECT CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN n.o_orderkey IS NULL THEN 'drop'
                  WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice
                    OR o.o_custkey IS DISTINCT FROM n.o_custkey OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority THEN 'update' END AS op
      FROM orders o FULL OUTER JOIN later n ON o.o_orderkey = n.o_orderkey)
    SELECT op, count(*) AS n FROM c WHERE op IS NOT NULL GROUP BY op""")
def snapshot_diff_summary(t, spark):
    return C.changes(t("orders"), later_orders(t("orders")), ["o_orderkey"], COMPARED).groupBy("op").agg(F.count("*").alias("n"))


@query(f"""WITH {LATER}
    SELECT o.o_orderkey, f.field, f.old_value, f.new_value FROM orders o JOIN later n USING (o_orderkey),
    LATERAL (VALUES ('o_custkey', o.o_custkey::VARCHAR, n.o_custkey::VARCHAR), ('o_orderstatus', o.o_orderstatus, n.o_orderstatus)) f(field, old_value, new_value)
    WHERE f.old_value IS DISTINCT FROM f.new_value""")
def trigger_audit_orders(t, spark):
    return C.audit(t("orders"), later_orders(t("orders")), ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("""WITH cur(object, grantee, privilege) AS (VALUES ('t1','app','SELECT'),('t1','app','INSERT'),('t1','ro','SELECT'),('t2','app','SELECT')),
    tgt(object, grantee, privilege) AS (VALUES ('t1','app','SELECT'),('t1','app','UPDATE'),('t2','app','SELECT'),('t3','ro','SELECT'))
    SELECT object, grantee, 'grant' AS op, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM (SELECT * FROM tgt EXCEPT SELECT * FROM cur) GROUP BY 1, 2
    UNION ALL
    SELECT object, grantee, 'revoke', string_agg(privilege, ',' ORDER BY privilege) FROM (SELECT * FROM cur EXCEPT SELECT * FROM tgt) GROUP BY 1, 2""")
def grant_set_difference(t, spark):
    from sparkpact.operators.diff import grant_changes

    kinds = "object string, grantee string, privileges array<string>"
    cur = spark.createDataFrame([("t1", "app", ["SELECT", "INSERT"]), ("t1", "ro", ["SELECT"]), ("t2", "app", ["SELECT"])], kinds)
    tgt = spark.createDataFrame([("t1", "app", ["SELECT", "UPDATE"]), ("t2", "app", ["SELECT"]), ("t3", "ro", ["SELECT"])], kinds)
    return grant_changes(cur, tgt, ["object"]).select("object", "grantee", "op", F.array_join("privileges", ",").alias("privileges"))


# -- keys ------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 50 <> 0)""")
def fk_orphans_lineitem(t, spark):
    return C.foreign_key_orphans(t("lineitem"), t("orders").where("o_orderkey % 50 <> 0"), ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def fk_orphans_orders(t, spark):
    return C.foreign_key_orphans(t("orders"), t("customer").where("c_acctbal > 0"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey, p_partkey % 100 + 1 AS s FROM part) k WHERE k.p_partkey = l.l_partkey AND k.s = l.l_suppkey)""")
def fk_orphans_composite(t, spark):
    parent = t("part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("s"))
    return C.foreign_key_orphans(t("lineitem"), parent, ["l_partkey", "l_suppkey"], ["p_partkey", "s"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def fk_cascade_delete(t, spark):
    gone = t("customer").where("c_mktsegment = 'BUILDING'")
    return C.apply_delete(t("orders"), gone, ["o_custkey"], ["c_custkey"], "CASCADE").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_null(t, spark):
    gone = t("customer").where("c_mktsegment = 'BUILDING'")
    return C.apply_delete(t("orders"), gone, ["o_custkey"], ["c_custkey"], "SET NULL").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 0 ELSE o_custkey END AS o_custkey FROM orders")
def fk_set_default(t, spark):
    return C.apply_delete(t("orders"), t("customer").where("c_acctbal < 0"), ["o_custkey"], ["c_custkey"], "SET DEFAULT", {"o_custkey": F.lit(0).cast("long")}).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def fk_restrict(t, spark):
    return C.apply_delete(t("supplier"), t("nation").where("n_regionkey = 1"), ["s_nationkey"], ["n_nationkey"], "RESTRICT").select("s_suppkey")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_partkey IS NULL")
def pk_violations_lineitem(t, spark):
    return C.primary_key_violations(t("lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def unique_partial_violations(t, spark):
    return C.unique_violations(t("orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "O")


@query("SELECT lower(p_name) AS k, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_expression_violations(t, spark):
    return C.unique_violations(t("part").select(F.lower("p_name").alias("k")), ["k"])


# -- values ----------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT coalesce(l_discount <= 0.05, true) THEN 'discount_cap' END, CASE WHEN NOT coalesce(l_quantity < 45, true) THEN 'quantity_cap' END) AS failed
    FROM lineitem WHERE NOT coalesce(l_discount <= 0.05, true) OR NOT coalesce(l_quantity < 45, true)""")
def check_violations_lineitem(t, spark):
    found = C.check_violations(t("lineitem"), {"discount_cap": F.col("l_discount") <= 0.05, "quantity_cap": F.col("l_quantity") < 45})
    return found.select("l_orderkey", "l_linenumber", F.array_join("failed_checks", ",").alias("failed"))


@query("SELECT event_id FROM events WHERE NOT coalesce(nullif(value, 0) > 10, true)")
def check_null_passes(t, spark):
    return C.check_violations(t("events"), {"v": F.nullif(F.col("value"), F.lit(0.0)) > 10}).select("event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR NOT (c_acctbal > 0)")
def domain_violations_customer(t, spark):
    return C.domain_violations(t("customer"), "c_acctbal", not_null=True, checks={"positive": F.col("c_acctbal") > 0}).select("c_custkey", "c_acctbal")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def enum_membership_orders(t, spark):
    return C.enum_violations(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("""SELECT c_mktsegment, count(*) AS n, list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE'], c_mktsegment)::INTEGER AS position FROM customer GROUP BY 1""")
def enum_order_sort(t, spark):
    values = ["MACHINERY", "BUILDING", "AUTOMOBILE"]
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("position", C.enum_position("c_mktsegment", values).cast("int"))


@query("SELECT 'props' AS \"column\", count(*) AS n_rows, count(*) FILTER (props IS NULL) AS n_nulls FROM events UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL) FROM events UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id IS NULL) FROM events")
def null_profile_columns(t, spark):
    return C.null_profile(t("events"), ["props", "value", "user_id"])


@query("""SELECT 'l_linenumber' AS "column", min(l_linenumber)::DOUBLE AS lowest, max(l_linenumber)::DOUBLE AS highest, min(l_linenumber) >= -128 AND max(l_linenumber) <= 127 AS safe FROM lineitem
    UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey), min(l_partkey) >= 0 AND max(l_partkey) <= 500 FROM lineitem
    UNION ALL SELECT 'l_returnflag', min(length(l_returnflag)), max(length(l_returnflag)), max(length(l_returnflag)) <= 1 FROM lineitem""")
def type_narrowing_safe(t, spark):
    return C.narrowing_safe(t("lineitem"), {"l_linenumber": (-128, 127), "l_partkey": (0, 500)}, {"l_returnflag": 1})


# -- partitions, generated columns, row security, versions, sequences --------------------------------


@query("""SELECT p, count(*) AS n FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'p_old' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'p_1996' ELSE 'p_default' END AS p FROM orders) GROUP BY p""")
def partition_route_range_orders(t, spark):
    from datetime import datetime

    route = C.route_range(F.col("o_orderdate"), [("p_old", None, datetime(1996, 1, 1)), ("p_1996", datetime(1996, 1, 1), datetime(1998, 1, 1))], "p_default")
    return t("orders").select(route.alias("p")).groupBy("p").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'p_web' WHEN event_type = 'purchase' THEN 'p_sales' ELSE 'p_default' END AS p FROM events""")
def partition_route_list_events(t, spark):
    return t("events").select("event_id", C.route_list(F.col("event_type"), {"p_web": ["click", "view"], "p_sales": ["purchase"]}, "p_default").alias("p"))


@query("SELECT o_orderkey, 'p' || (('0x' || substr(md5(o_custkey::VARCHAR), 1, 15))::BIGINT % 4)::VARCHAR AS p FROM orders")
def partition_route_hash_orders(t, spark):
    digest = F.conv(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 15), 16, 10).cast("long")
    return t("orders").select("o_orderkey", C.route_hash([F.col("o_custkey")], [(f"p{k}", 4, k) for k in range(4)], digest).alias("p"))


@query("SELECT count(*) AS n, count(*) AS routed, 4::BIGINT AS partitions, true AS even FROM orders")
def partition_route_hash_spread(t, spark):
    """The default hash: every row has one partition, and no partition has over half of what it should have more."""
    routed = t("orders").select(C.route_hash([F.col("o_orderkey")], [(f"p{k}", 4, k) for k in range(4)]).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return routed.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p").isNotNull(), F.col("n"))).alias("routed"), F.count("p").alias("partitions"), (F.max("n") < 1.5 * F.sum("n") / 4).alias("even"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def generated_columns_lineitem(t, spark):
    df = C.generated(t("lineitem"), {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("net") * (1 + F.col("l_tax"))})
    return df.select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT r_regionkey, r_name, 'active' AS status FROM region")
def default_columns_region(t, spark):
    return C.with_defaults(t("region"), {"status": F.lit("active"), "r_name": F.lit("?")}).select("r_regionkey", "r_name", "status")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
def rls_customer_policy(t, spark):
    policies = [
        {"command": "SELECT", "roles": ["sales"], "using": F.col("c_mktsegment") == "BUILDING"},
        {"command": "ALL", "roles": ["public"], "using": F.col("c_acctbal") > 9000},
        {"command": "SELECT", "roles": ["audit"], "using": F.lit(True)},
    ]
    return C.apply_policies(t("customer"), policies, "SELECT", "sales").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def rls_subquery_policy(t, spark):
    own = {"command": "SELECT", "exists": (t("customer").where("c_nationkey = 3"), [("o_custkey", "c_custkey")])}
    return C.apply_policies(t("orders"), [own], "SELECT", "sales").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_acctbal - 500 > -100""")
def rls_update_with_check(t, spark):
    """An UPDATE by 500 less: USING lets the old row through, WITH CHECK the new one; a restrictive policy binds both."""
    policies = [
        {"command": "UPDATE", "roles": ["sales"], "using": F.col("c_acctbal") > 0, "check": F.col("c_acctbal") > -100},
        {"command": "ALL", "roles": ["public"], "using": F.col("c_mktsegment") == "BUILDING", "permissive": False},
    ]
    old = C.apply_policies(t("customer"), policies, "UPDATE", "sales")
    return C.apply_policies(old.withColumn("c_acctbal", F.col("c_acctbal") - 500), policies, "UPDATE", "sales", written=True).select("c_custkey")


@query("SELECT count(*) AS n FROM customer WHERE false")
def rls_no_policy(t, spark):
    return C.apply_policies(t("customer"), [], "SELECT", "sales").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS full_name, c_acctbal AS balance FROM customer")
def version_view_customer(t, spark):
    return C.version_view(t("customer"), [("id", "c_custkey"), ("full_name", "c_name"), ("balance", "c_acctbal")])


@query("SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_name, c_custkey) - 1) AS seq FROM customer")
def sequence_assign_customers(t, spark):
    return C.assign_sequence(t("customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], start=100, increment=5).select("c_custkey", "seq")


@query("SELECT s_suppkey, 10 + (row_number() OVER (ORDER BY s_suppkey) - 1) % 7 AS seq FROM supplier")
def sequence_cycle_suppliers(t, spark):
    return C.assign_sequence(t("supplier").select("s_suppkey"), ["s_suppkey"], start=10, low=10, high=16, cycle=True).select("s_suppkey", "seq")


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS lo, epoch(ts) + 3600.0 AS hi FROM events)
    SELECT a.event_id AS id_a, b.event_id AS id_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi""")
def exclusion_overlap_events(t, spark):
    low = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return C.exclusion_conflicts(t("events").withColumn("low", low), "event_id", ["user_id"], F.col("low"), F.col("low") + 3600.0, 3600.0)


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def user_aggregate_group_concat(t, spark):
    return C.ordered_aggregate(t("nation"), ["n_regionkey"], F.col("n_name"), F.col("n_name"), ", ", "names")


ROW_HASH = "sha256(concat({}))"


def row_hash(*columns: str) -> str:
    """A row's fingerprint in SQL."""
    return ROW_HASH.format(", ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '~')" for c in columns))


@query(f"SELECT r_regionkey, {row_hash('r_regionkey', 'r_name')} AS fingerprint FROM region")
def fingerprint_rows(t, spark):
    return t("region").select("r_regionkey", C.row_fingerprint(t("region"), ["r_regionkey", "r_name"]).alias("fingerprint"))


def table_hash(rows: str, *columns: str) -> str:
    lane = "sum(('0x' || substr(h, {}, 15))::BIGINT::HUGEINT)::VARCHAR"
    return f"SELECT count(*) AS n_rows, {lane.format(1)} || '-' || {lane.format(16)} AS fingerprint FROM (SELECT {row_hash(*columns)} AS h FROM {rows})"


@query(table_hash("nation", "n_nationkey", "n_name", "n_regionkey"))
def fingerprint_tables(t, spark):
    return C.table_fingerprint(t("nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query(table_hash("(SELECT n_regionkey, nullif(n_regionkey, 2) AS k FROM nation UNION ALL SELECT n_regionkey, NULL FROM nation WHERE n_regionkey < 2)", "n_regionkey", "k"))
def fingerprint_repeated_rows(t, spark):
    """Rows that stand many times, and NULLs: an even number of equal rows does not cancel."""
    rows = t("nation").select("n_regionkey", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    return C.table_fingerprint(rows.unionByName(t("nation").where("n_regionkey < 2").select("n_regionkey", F.lit(None).cast("int").alias("k"))), ["n_regionkey", "k"])


@query("""WITH o AS (SELECT nullif(o_custkey % 50, 7) AS k, max(o_totalprice) AS v FROM orders GROUP BY 1), n AS (SELECT nullif(o_custkey % 60, 7) AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT CASE WHEN o_in THEN ok ELSE nk END AS k, CASE WHEN NOT o_in THEN 'create' WHEN NOT n_in THEN 'drop' ELSE 'update' END AS op FROM
    (SELECT o.k AS ok, n.k AS nk, o.v AS ov, n.v AS nv, o.p IS NOT NULL AS o_in, n.p IS NOT NULL AS n_in FROM (SELECT *, 1 AS p FROM o) o FULL OUTER JOIN (SELECT *, 1 AS p FROM n) n ON o.k IS NOT DISTINCT FROM n.k) x
    WHERE NOT o_in OR NOT n_in OR ov IS DISTINCT FROM nv""")
def snapshot_diff_null_keys(t, spark):
    side = lambda m: t("orders").groupBy(F.nullif(F.col("o_custkey") % m, F.lit(7)).alias("k")).agg(F.max("o_totalprice").alias("v"))
    return C.changes(side(50), side(60), ["k"], ["v"]).select("k", "op")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE epoch(ts)::DOUBLE END AS lo, CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN epoch(ts) + 9e5 ELSE epoch(ts) + 60.0 END AS hi FROM events WHERE event_id < 3000)
    SELECT a.event_id AS id_a, b.event_id AS id_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND coalesce(a.lo < b.hi, true) AND coalesce(b.lo < a.hi, true)""")
def exclusion_open_ranges(t, spark):
    """Ranges that are open on a side, and ranges 15,000 times as long as the others."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    key = F.col("event_id")
    low = F.when(key % 97 != 0, at)
    high = F.when(key % 89 == 0, F.lit(None).cast("double")).when(key % 83 == 0, at + 9e5).otherwise(at + 60.0)
    rows = t("events").where("event_id < 3000").withColumn("low", low).withColumn("high", high)
    return C.exclusion_conflicts(rows, "event_id", ["user_id"], F.col("low"), F.col("high"), 60.0)


@query("""WITH RECURSIVE refs(a, b) AS (SELECT 'v' || i, 'v' || (i - 1) FROM range(1, 161) t(i) UNION ALL SELECT 'w' || i, 'v' || (i * 3) FROM range(1, 50) t(i) UNION ALL SELECT 'v1', 'v160'),
    c(v) AS (SELECT a FROM refs WHERE b = 'v20' UNION SELECT refs.a FROM refs JOIN c ON refs.b = c.v) SELECT DISTINCT v AS view FROM c""")
def view_closure_long_chain(t, spark):
    """A chain of 160 views that closes into a cycle, with branches."""
    from sparkpact.operators.diff import dependent_closure

    refs = [(f"v{k}", f"v{k - 1}") for k in range(1, 161)] + [(f"w{k}", f"v{3 * k}") for k in range(1, 50)] + [("v1", "v160")]
    return dependent_closure(spark.createDataFrame(refs, "owner string, target string"), ["v20"]).select(F.col("owner").alias("view"))


@query("""WITH c(object, grantee, privilege, opt) AS (SELECT 'n' || n_nationkey, 'r' || (n_nationkey % 3), p, (n_nationkey + i) % 2 = 0 FROM nation, (VALUES ('SELECT', 0), ('INSERT', 1), ('UPDATE', 2)) v(p, i) WHERE (n_nationkey + i) % 4 <> 0),
    g(object, grantee, privilege, opt) AS (SELECT 'n' || n_nationkey, 'r' || (n_nationkey % 3), p, (n_nationkey + i) % 3 = 0 FROM nation, (VALUES ('SELECT', 0), ('INSERT', 1), ('UPDATE', 2)) v(p, i) WHERE (n_nationkey + i) % 5 <> 0)
    SELECT object, grantee, op, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM (
      SELECT coalesce(c.object, g.object) AS object, coalesce(c.grantee, g.grantee) AS grantee, coalesce(c.privilege, g.privilege) AS privilege,
             CASE WHEN g.object IS NULL THEN 'revoke' WHEN g.opt AND NOT coalesce(c.opt, false) THEN 'grant option' WHEN c.object IS NULL THEN 'grant' WHEN c.opt AND NOT g.opt THEN 'revoke option' END AS op
      FROM c FULL OUTER JOIN g ON c.object = g.object AND c.grantee = g.grantee AND c.privilege = g.privilege) WHERE op IS NOT NULL GROUP BY 1, 2, 3""")
def grant_options_by_privilege(t, spark):
    """Grants of generated DDL on both sides; the option is a matter of each privilege."""
    from sparkpact.operators.diff import grant_changes
    from sparkpact.sources.ddl import parse_ddl

    def side(skip: int, option: int) -> DataFrame:
        text = []
        for (k,) in t("nation").select("n_nationkey").collect():
            text.append(f"CREATE TABLE n{k} (id int);")
            for i, p in enumerate(("SELECT", "INSERT", "UPDATE")):
                if (k + i) % skip:
                    text.append(f"GRANT {p} ON n{k} TO r{k % 3}{' WITH GRANT OPTION' if (k + i) % option == 0 else ''};")
        grants = parse_ddl("\n".join(text)).of("grant")
        return spark.createDataFrame([(g.attrs["on"].split(".")[-1], g.attrs["grantee"], g.attrs["privileges"], g.attrs["grantable"]) for g in grants], "object string, grantee string, privileges array<string>, grantable array<string>")

    return grant_changes(side(4, 2), side(5, 3), ["object"]).select("object", "grantee", "op", F.array_join("privileges", ",").alias("privileges"))


# -- contracts as they are declared ------------------------------------------------------------------

SHOP_DDL = """
    CREATE TYPE priority AS ENUM ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW');
    CREATE DOMAIN balance AS numeric(15,2) CONSTRAINT floor CHECK (VALUE > -500);
    CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text NOT NULL, c_nationkey int, c_acctbal balance, c_mktsegment text, CONSTRAINT segment CHECK (c_mktsegment = ANY (ARRAY['BUILDING', 'MACHINERY']) OR c_acctbal::numeric > 0));
    CREATE UNIQUE INDEX one_rich ON customer (c_nationkey) WHERE c_acctbal > 9000;
    CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint REFERENCES customer (c_custkey), o_orderstatus varchar(1), o_totalprice double precision, o_orderdate timestamp, o_orderpriority priority);
    ALTER TABLE orders ENABLE ROW LEVEL SECURITY;
    CREATE POLICY own ON orders FOR SELECT TO sales USING (o_custkey % 7 = 3 AND o_orderstatus !~~ 'P%');
    CREATE POLICY cheap ON orders USING (o_totalprice < 20000::numeric);
    CREATE TABLE ledger (day timestamp, kind text, amount double precision, fee double precision GENERATED ALWAYS AS (amount * 0.5) STORED, note text DEFAULT 'none') PARTITION BY RANGE (day, kind);
    CREATE TABLE ledger_old PARTITION OF ledger FOR VALUES FROM (MINVALUE, MINVALUE) TO ('1996-01-01', 'F');
    CREATE TABLE ledger_mid PARTITION OF ledger FOR VALUES FROM ('1996-01-01', 'F') TO ('1998-01-01', MINVALUE);
    CREATE TABLE ledger_rest PARTITION OF ledger DEFAULT;
    CREATE FUNCTION with_tax(price double precision, rate double precision DEFAULT 0.25) RETURNS double precision LANGUAGE sql IMMUTABLE AS 'SELECT price * (1 + rate)';
    CREATE FUNCTION orders_of(customer bigint) RETURNS TABLE (k bigint, price double precision) LANGUAGE sql AS 'SELECT o_orderkey, o_totalprice FROM shop_orders WHERE o_custkey = customer';
"""


def shop_catalog():
    from sparkpact.sources.ddl import parse_ddl

    return parse_ddl(SHOP_DDL)


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0)
    SELECT * FROM (SELECT 'public.customer' AS "table", 'domain c_acctbal' AS contract, count(*) AS n FROM c WHERE NOT c_acctbal > -500
    UNION ALL SELECT 'public.customer', 'unique one_rich', count(*) FROM (SELECT c_nationkey FROM c WHERE c_acctbal > 9000 AND c_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'public.customer', 'check segment', count(*) FROM c WHERE NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal > 0)
    UNION ALL SELECT 'public.orders', 'foreign key orders_o_custkey_fkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM c)
    UNION ALL SELECT 'public.orders', 'enum o_orderpriority', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) WHERE n > 0""")
def contract_report_shop(t, spark):
    from sparkpact.operators.declared import contract_report

    return contract_report(spark, shop_catalog(), {"public.customer": t("customer").where("c_custkey % 10 <> 0"), "public.orders": t("orders")})


@query("SELECT o_orderkey, role FROM orders, (VALUES ('sales'), ('guest')) v(role) WHERE o_totalprice < 20000 OR role = 'sales' AND o_custkey % 7 = 3 AND o_orderstatus NOT LIKE 'P%'")
def rls_declared_policies(t, spark):
    from sparkpact.operators.declared import visible

    seen = [visible(t("orders"), shop_catalog(), "public.orders", "SELECT", role).select("o_orderkey", F.lit(role).alias("role")) for role in ("sales", "guest")]
    return seen[0].unionByName(seen[1])


LEDGER = "(SELECT o_orderdate AS day, o_orderstatus AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT NULL, 'F', 1.0)"


@query(f"""SELECT CASE WHEN day IS NULL THEN 'ledger_rest' WHEN day < TIMESTAMP '1996-01-01' OR day = TIMESTAMP '1996-01-01' AND kind < 'F' THEN 'ledger_old' WHEN day < TIMESTAMP '1998-01-01' THEN 'ledger_mid' ELSE 'ledger_rest' END AS p, count(*) AS n FROM {LEDGER} GROUP BY 1""")
def partition_route_declared(t, spark):
    from sparkpact.operators.declared import partition_of

    rows = ledger_rows(t)
    return rows.select(partition_of(shop_catalog(), "public.ledger", rows).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


def ledger_rows(t) -> DataFrame:
    rows = t("orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("amount"))
    return rows.unionByName(rows.limit(1).select(F.lit(None).cast("timestamp_ntz").alias("day"), F.lit("F").alias("kind"), F.lit(1.0).alias("amount")))


@query(f"SELECT day, kind, amount, amount * 0.5 AS fee, 'none' AS note FROM {LEDGER}")
def declared_columns_ledger(t, spark):
    from sparkpact.operators.declared import with_declared_columns

    return with_declared_columns(ledger_rows(t), shop_catalog(), "public.ledger")


@query("SELECT o_orderkey, o_totalprice * 1.25 AS a, o_totalprice * 1.5 AS b FROM orders")
def routine_scalar(t, spark):
    """A declared SQL function, with and without its default."""
    from sparkpact.functions.routines import register_functions

    t("orders").createOrReplaceTempView("shop_orders")
    register_functions(spark, shop_catalog())
    return t("orders").select("o_orderkey", F.expr("with_tax(o_totalprice)").alias("a"), F.expr("with_tax(o_totalprice, 0.5D)").alias("b"))


@query("SELECT c_custkey, o_orderkey AS k, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey < 30")
def routine_table(t, spark):
    """A declared table function, called for each row of another table."""
    from sparkpact.functions.routines import register_functions

    t("orders").createOrReplaceTempView("shop_orders")
    register_functions(spark, shop_catalog())
    return spark.sql("SELECT c.c_custkey, o.k, o.price FROM {c} c, LATERAL orders_of(c.c_custkey) o", c=t("customer").where("c_custkey < 30"))


@query("SELECT c_nationkey, sum(power(c_custkey % 4, 2))::BIGINT AS squares FROM customer GROUP BY 1")
def routine_fold(t, spark):
    """A user aggregate: a transition function over a group's values."""
    from sparkpact.functions.routines import fold

    value = (F.col("c_custkey") % 4).cast("long")
    return fold(t("customer"), ["c_nationkey"], [F.col("c_custkey")], value, F.lit(0).cast("long"), lambda total, x: total + x * x, "squares")


@query("""SELECT o_orderkey, o_custkey::INTEGER AS o_custkey, round(o_totalprice)::BIGINT AS cents, 'new' AS tag FROM orders""")
def apply_column_changes(t, spark):
    """A type change, a new column with a default and a dropped one, over the data."""
    from sparkpact.operators.apply import apply_migration
    from sparkpact.plans.lifecycle import migration
    from sparkpact.sources.ddl import parse_ddl

    before = parse_ddl("CREATE TABLE orders (o_orderkey bigint, o_custkey bigint, cents double precision, gone text);")
    after = parse_ddl("CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey integer, cents bigint NOT NULL, tag text NOT NULL DEFAULT 'new', CONSTRAINT positive CHECK (cents > 0));")
    rows = t("orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").alias("cents"), F.col("o_orderstatus").alias("gone"))
    return apply_migration(spark, {"public.orders": rows}, migration(spark, before, after, allow_destructive=True)["ops"])["public.orders"]


# -- contracts on streams ----------------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str, table: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming plan gives for a table that comes as a stream, written and read back."""
    import os

    from sparkpact.operators.pinned import fresh_folder

    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*").parquet(sf_dir) if os.path.isfile(f"{sf_dir}/{table}.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet")
    folder = fresh_folder(spark, "stream")
    out = plan(stream)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def stream_query(name: str, table: str, plan: Callable[[SparkSession, str, DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: streamed(spark, sf_dir, table, lambda s: plan(spark, sf_dir, s))
    ORACLE_SQL[name] = sql


def stream_checks(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    from sparkpact.streaming.contracts import stream_check_violations

    return stream_check_violations(s, {"small": F.col("value") < 50, "known": F.col("event_type") != "view"}).select("event_id", F.array_join("failed_checks", ",").alias("failed"))


def stream_once(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    from sparkpact.streaming.contracts import stream_unique

    return stream_unique(s.withColumn("at", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "at", "3650 days").select("user_id", "event_type")


def stream_missing(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    from sparkpact.streaming.contracts import stream_orphans

    users = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0")
    return stream_orphans(s, users, ["user_id"], ["c_custkey"]).select("event_id")


stream_query("stream_check_violations_events", "events", stream_checks, "SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(event_type <> 'view', true) THEN 'known' END, CASE WHEN NOT coalesce(value < 50, true) THEN 'small' END) AS failed FROM events WHERE NOT coalesce(event_type <> 'view', true) OR NOT coalesce(value < 50, true)")
stream_query("stream_unique_events", "events", stream_once, "SELECT DISTINCT user_id, event_type FROM events")
stream_query("stream_orphans_events", "events", stream_missing, "SELECT event_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")


# -- view surface ----------------------------------------------------------------------------------

sql_view("view_filter_agg", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_custkey) AS n_cust FROM orders GROUP BY o_orderpriority", "orders")
sql_view("view_cte_left_join", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) SELECT c.c_custkey, c.c_name, coalesce(b.n, 0) AS n FROM customer c LEFT JOIN big b ON b.o_custkey = c.c_custkey", "orders customer")
sql_view("view_window_frame", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_qty FROM lineitem", "lineitem")
sql_view("view_ranked", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part", "part")
sql_view("view_qualify_top", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) x WHERE rn <= 3", "customer")
sql_view("view_lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", "events")
sql_view("view_union_all", "SELECT s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer", "supplier customer")
sql_view("view_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2", "customer supplier nation", "SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
sql_view("view_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", "customer orders")
sql_view("view_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", "customer orders")
sql_view("view_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", "part lineitem")
sql_view("view_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM orders)", "orders")
sql_view("view_correlated_distinct", "SELECT n.n_name, (SELECT count(DISTINCT c.c_mktsegment) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS segments FROM nation n", "nation customer")
sql_view("view_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
sql_view("view_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem", )
sql_view("view_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
sql_view("view_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15", "orders")
sql_view("view_case_concat_cast", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'ok' END AS band, c_name || '-' || CAST(c_nationkey AS VARCHAR(10)) AS tag FROM customer", "customer")
sql_view("view_lateral", "SELECT n.n_name, x.n FROM nation n, LATERAL (SELECT count(*) AS n FROM supplier s WHERE s.s_nationkey = n.n_nationkey) x", "nation supplier")
sql_view("view_five_way_join", "SELECT r.r_name, n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name", "lineitem orders customer nation region")
sql_view("view_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
sql_view("view_full_outer", "SELECT c.c_nationkey AS a, s.s_nationkey AS b, c.n AS nc, s.n AS ns FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey", "customer supplier")
sql_view("view_like_ilike", "SELECT p_partkey FROM part WHERE p_name ~~ '%a%' AND p_type ~~* '%e%' AND p_brand !~~ '%1'", "part", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%e%' AND p_brand NOT LIKE '%1'")
sql_view("view_distinct_from", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus", "orders")


def materialized_monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A materialized view: declared, planned, written to the shared folder and read back."""
    from sparkpact.functions.routines import refresh_materialized
    from sparkpact.operators.pinned import fresh_folder

    ddl = "CREATE MATERIALIZED VIEW monthly AS SELECT to_char(date_trunc('month', o_orderdate), 'YYYY-MM-DD') AS month, count(*) AS n FROM orders GROUP BY 1;"
    return refresh_materialized(declared_views(spark, sf_dir, ddl, "orders")["public.monthly"], fresh_folder(spark, "monthly"))


QUERIES["materialized_monthly_orders"] = materialized_monthly_orders
ORACLE_SQL["materialized_monthly_orders"] = "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n FROM orders GROUP BY 1"


@query("""WITH RECURSIVE refs(a, b) AS (VALUES ('v1','t1'),('v2','v1'),('v3','v2'),('v4','t2'),('v5','v4'),('v5','v1')),
    c(v) AS (SELECT a FROM refs WHERE b = 't1' UNION SELECT refs.a FROM refs JOIN c ON refs.b = c.v) SELECT DISTINCT v AS view FROM c""")
def view_closure(t, spark):
    from sparkpact.operators.diff import dependent_closure

    refs = spark.createDataFrame([("v1", "t1"), ("v2", "v1"), ("v3", "v2"), ("v4", "t2"), ("v5", "v4"), ("v5", "v1")], "owner string, target string")
    return dependent_closure(refs, ["t1"]).select(F.col("owner").alias("view"))


# -- schema engine over small relations --------------------------------------------------------------

DESIRED_ORDERS = """
    CREATE TABLE orders (
        o_orderkey bigint, o_custkey integer, o_orderstatus varchar(1), o_totalprice numeric(15,2),
        o_orderdate timestamp NOT NULL, o_clerk text
    );
"""


def orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must change for the live orders table to have the desired columns."""
    from sparkpact.operators.diff import diff
    from sparkpact.sources.ddl import parse_ddl
    from sparkpact.sources.loader import parquet_tables

    return diff(spark, parquet_tables(spark, sf_dir, ["orders"]), parse_ddl(DESIRED_ORDERS))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of orders must change, by what operation, and what is unsafe about it."""
    from sparkpact.plans.lint import lint_ops

    ops = orders_changes(spark, sf_dir)
    found = lint_ops(ops).groupBy("op", "kind", "key").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("findings"))
    return ops.join(found, ["op", "kind", "key"], "left").select("op", "key", F.array_join(F.array_sort("changed"), ",").alias("changed"), F.coalesce("findings", F.lit("")).alias("findings"))


QUERIES["schema_diff_orders"] = entry
ORACLE_SQL["schema_diff_orders"] = """
    WITH cur AS (
      SELECT 'public.orders.' || column_name AS key,
             CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double precision' WHEN 'INTEGER' THEN 'integer' ELSE 'timestamp without time zone' END AS data_type, true AS nullable
      FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name,
                   unnest([typeof(o_orderkey), typeof(o_custkey), typeof(o_orderstatus), typeof(o_totalprice), typeof(o_orderdate), typeof(o_orderpriority)]) AS data_type
            FROM (SELECT * FROM orders LIMIT 1))),
    tgt(key, data_type, nullable) AS (VALUES
      ('public.orders.o_orderkey', 'bigint', true), ('public.orders.o_custkey', 'integer', true), ('public.orders.o_orderstatus', 'character varying(1)', true),
      ('public.orders.o_totalprice', 'numeric(15,2)', true), ('public.orders.o_orderdate', 'timestamp without time zone', false), ('public.orders.o_clerk', 'text', true)),
    d AS (
      SELECT coalesce(c.key, t.key) AS key, CASE WHEN c.key IS NULL THEN 'create' WHEN t.key IS NULL THEN 'drop' ELSE 'alter' END AS op,
             CASE WHEN c.key IS NULL OR t.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c.data_type <> t.data_type THEN 'data_type' END, CASE WHEN c.nullable <> t.nullable THEN 'nullable' END) END AS changed,
             c.data_type AS old_type, t.data_type AS new_type, t.nullable AS n
      FROM cur c FULL OUTER JOIN tgt t ON c.key = t.key
      WHERE c.key IS NULL OR t.key IS NULL OR c.data_type <> t.data_type OR c.nullable <> t.nullable)
    SELECT op, key, changed,
           CASE WHEN op = 'drop' THEN 'deny_drop_column'
                ELSE concat_ws(',', CASE WHEN changed LIKE '%nullable%' AND NOT n THEN 'warn_set_not_null' END,
                                    CASE WHEN changed LIKE '%data_type%' AND (new_type = 'integer' AND old_type = 'bigint' OR new_type LIKE 'character varying(%') THEN 'warn_type_narrowing' END) END AS findings
    FROM d
"""

SHOP = """
    CREATE TYPE state AS ENUM ('new', 'paid');
    CREATE TABLE a (id bigint PRIMARY KEY, b_id bigint REFERENCES b (id), s state);
    CREATE TABLE b (id bigint PRIMARY KEY, a_id bigint REFERENCES a (id), x missing_type);
    CREATE TABLE c (id bigint PRIMARY KEY, z bigint REFERENCES nowhere (id), w bigint REFERENCES a (absent));
    CREATE TRIGGER t AFTER INSERT ON c FOR EACH ROW EXECUTE FUNCTION gone();
    CREATE SEQUENCE q OWNED BY c.lost;
"""


@query("""SELECT * FROM (VALUES
    ('fk_references_missing_table', 'error', 'public.c.c_z_fkey', 'public.nowhere'), ('fk_references_missing_column', 'error', 'public.c.c_w_fkey', 'public.a.absent'),
    ('column_references_missing_enum', 'error', 'public.b.x', 'public.missing_type'), ('trigger_references_missing_function', 'error', 'public.c.t', 'public.gone'),
    ('sequence_owner_missing_column', 'error', 'public.q', 'public.c.lost'), ('circular_foreign_keys', 'warning', 'public.a', ''), ('circular_foreign_keys', 'warning', 'public.b', ''), ('circular_foreign_keys', 'warning', 'public.c', '')
    ) t(rule, severity, key, detail)""")
def check_catalog(t, spark):
    from sparkpact.plans.checks import check
    from sparkpact.sources.ddl import parse_ddl

    return check(spark, parse_ddl(SHOP))


OPS = [
    ("drop", "table", "public.t", [], {}, None), ("drop", "column", "public.u.c", [], {}, None), ("alter", "column", "public.u.d", ["data_type"], {"data_type": "bigint"}, {"data_type": "integer"}),
    ("alter", "column", "public.u.e", ["nullable"], {"nullable": "true"}, {"nullable": "false"}), ("create", "index", "public.u.i", [], None, {}), ("drop", "view", "public.v", [], {"materialized": "true"}, None), ("alter", "sequence", "public.s", ["start"], {"start": "1"}, {"start": "5"}),
]


def ops_relation(spark: SparkSession) -> DataFrame:
    from sparkpact.operators.diff import OP_SCHEMA

    return spark.createDataFrame([(op, kind, key, "public", "", key.split(".")[-1], changed, old, new) for op, kind, key, changed, old, new in OPS], OP_SCHEMA)


@query("""SELECT * FROM (VALUES ('deny_drop_table', 'error', 'public.t'), ('deny_drop_column', 'error', 'public.u.c'), ('warn_type_narrowing', 'warning', 'public.u.d'),
    ('warn_set_not_null', 'warning', 'public.u.e'), ('deny_drop_materialized_view', 'error', 'public.v'), ('warn_sequence_restart', 'warning', 'public.s')) t(rule, severity, key)""")
def lint_operations(t, spark):
    from sparkpact.plans.lint import lint_ops

    return lint_ops(ops_relation(spark)).select("rule", "severity", "key")


@query("""SELECT * FROM (VALUES ('drop', 'public.t', 'ACCESS EXCLUSIVE'), ('drop', 'public.u.c', 'ACCESS EXCLUSIVE'), ('alter', 'public.u.d', 'ACCESS EXCLUSIVE'),
    ('alter', 'public.u.e', 'ACCESS EXCLUSIVE'), ('create', 'public.u.i', 'SHARE'), ('drop', 'public.v', 'ACCESS EXCLUSIVE')) t(op, key, lock)""")
def lock_hazards(t, spark):
    from sparkpact.plans.lint import lock_hazards as hazards

    return hazards(ops_relation(spark)).select("op", "key", "lock")


@query("""SELECT * FROM (VALUES (1, 'expand', 'create', 'public.t.b'), (2, 'backfill', 'backfill', 'public.t.b'), (3, 'contract', 'alter', 'public.t.b'), (4, 'contract', 'drop', 'public.t.c')) t(step, phase, op, key)""")
def expand_contract_phases(t, spark):
    from sparkpact.plans.lifecycle import migration
    from sparkpact.sources.ddl import parse_ddl

    ops = migration(spark, parse_ddl("CREATE TABLE t (a int, c int);"), parse_ddl("CREATE TABLE t (a int, b int NOT NULL);"), zero_downtime=True, check=False)["ops"]
    return spark.createDataFrame([(k + 1, o["phase"], o["op"], o["key"]) for k, o in enumerate(ops)], "step int, phase string, op string, key string")


@query("""SELECT * FROM (VALUES ('archived', 3, 'paid', NULL), ('draft', 0, NULL, 'new')) t(value, position, after, before)""")
def enum_value_changes(t, spark):
    from sparkpact.operators.diff import new_enum_values

    return new_enum_values(spark, ["new", "paid"], ["draft", "new", "paid", "archived"]).select("value", "position", "after", "before")


@query("""SELECT * FROM (VALUES (1, 'create', 'table', 'public.child'), (2, 'create', 'table', 'public.parent'), (3, 'create', 'foreign_key', 'public.child.child_id_fkey'), (4, 'create', 'view', 'public.v')) t(step, op, kind, key)""")
def plan_order(t, spark):
    from sparkpact.plans.lifecycle import migration
    from sparkpact.sources.catalog import Catalog
    from sparkpact.sources.ddl import parse_ddl

    target = parse_ddl("CREATE VIEW v AS SELECT c.id FROM child c JOIN parent p ON p.id = c.id; CREATE TABLE parent (id int PRIMARY KEY); CREATE TABLE child (id int REFERENCES parent (id));")
    ops = [o for o in migration(spark, Catalog(), target)["ops"] if o["kind"] in ("table", "view", "foreign_key")]
    return spark.createDataFrame([(k + 1, o["op"], o["kind"], o["key"]) for k, o in enumerate(ops)], "step int, op string, kind string, key string")


def _more() -> None:
    from sparkpact import dialect_queries, live_queries, schema_queries

    for module in (live_queries, schema_queries, dialect_queries):
        QUERIES.update(module.QUERIES)
        ORACLE_SQL.update(module.ORACLE_SQL)


_more()
