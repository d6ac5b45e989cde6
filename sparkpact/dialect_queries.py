"""Queries of the dialect: canonical forms, type names, and built-in functions in Spark.

Canonical forms are held against data: two texts that the engine takes for the same must give the
same on every row, and pairs that it keeps apart are chosen so that they do not. Functions are held
against the same text run by another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkpact.functions.normalize import same, same_body
from sparkpact.functions.types import canonical_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Pair = tuple[str, str]


def pairs(name: str, found: list[Pair], same_text: Callable[[str, str], bool], sql: list[str]) -> None:
    rows = [(k, same_text(a, b)) for k, (a, b) in enumerate(found)]
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(rows, "pair int, same boolean")
    ORACLE_SQL[name] = "\nUNION ALL ".join(sql)


def expressions(name: str, table: str, *found: Pair) -> None:
    """Pairs of expressions over a table."""
    pairs(name, [*found], same, [f"SELECT {k}::INTEGER AS pair, count(*) FILTER (({a}) IS DISTINCT FROM ({b})) = 0 AS same FROM {table}".replace("public.", "") for k, (a, b) in enumerate(found)])


def queries(name: str, *found: Pair) -> None:
    """Pairs of queries: the same rows, in any order."""
    each = "SELECT {k}::INTEGER AS pair, (SELECT count(*) FROM (SELECT * FROM ({a}) EXCEPT ALL SELECT * FROM ({b}))) + (SELECT count(*) FROM (SELECT * FROM ({b}) EXCEPT ALL SELECT * FROM ({a}))) = 0 AS same"
    pairs(name, [*found], same, [each.format(k=k, a=a, b=b).replace("public.", "") for k, (a, b) in enumerate(found)])


queries(
    "same_query_parts", ("WITH c AS (SELECT o_orderkey AS k FROM public.orders) SELECT k FROM c ORDER BY k LIMIT 3", "with c as (select o_orderkey k from orders) select k from c order by k limit 3"), ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4"),
    ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3"), ("SELECT n_name FROM nation ORDER BY n_name OFFSET 2", "SELECT n_name FROM nation ORDER BY n_name OFFSET 3"),
)
queries("same_set_operations", ("SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_regionkey FROM public.nation UNION ALL SELECT r_regionkey FROM public.region"), ("SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region"), ("SELECT n_nationkey FROM nation INTERSECT SELECT r_regionkey FROM region", "SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region"))
expressions("same_identifiers", "orders", ('"o_custkey" + 1', "O_CUSTKEY + 1"), ("orders.o_custkey", "public.orders.o_custkey".replace("public.", "")), ("o_custkey", "o_orderkey"))
expressions("same_function_calls", "orders", ("coalesce(o_orderstatus, 'x'::text)", "COALESCE(o_orderstatus, 'x')"), ("pg_catalog.lower(o_orderpriority)".replace("pg_catalog.", ""), "lower(o_orderpriority)"), ("lower(o_orderpriority)", "upper(o_orderpriority)"), ("substr(o_orderpriority, 1, 2)", "substr(o_orderpriority, 1, 3)"))
queries("same_aggregate_filters", ("SELECT count(*) FILTER (WHERE (o_orderstatus = 'F'::text)) AS n FROM orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders"), ("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders"))
queries(
    "same_window_specs", ("SELECT sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM part", "SELECT sum(p_size) over (partition by p_brand order by p_partkey rows between 2 preceding and current row) s FROM public.part"), ("SELECT sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS s FROM part", "SELECT sum(p_size) OVER (ORDER BY p_partkey) AS s FROM part"),
    ("SELECT sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM part", "SELECT sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM part"),
)
queries("same_table_factors", ("SELECT x.k FROM (SELECT n_nationkey AS k FROM nation) AS x", "SELECT x.k FROM (SELECT n_nationkey AS k FROM public.nation) x"), ("SELECT n.n_name, x.c FROM nation n, LATERAL (SELECT count(*) AS c FROM supplier s WHERE s.s_nationkey = n.n_nationkey) x", "SELECT n.n_name, x.c FROM nation n, LATERAL (SELECT count(*) AS c FROM supplier s WHERE s.s_nationkey = n.n_regionkey) x"))
JOIN = "SELECT c.c_custkey, o.o_orderkey FROM customer c {} orders o ON {}"
queries("same_joins", (JOIN.format("JOIN", "(c.c_custkey = o.o_custkey)"), JOIN.format("INNER JOIN", "c.c_custkey = o.o_custkey")), (JOIN.format("LEFT JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9"), JOIN.format("LEFT OUTER JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9")), (JOIN.format("LEFT JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9"), JOIN.format("JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9")), (JOIN.format("FULL JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9"), JOIN.format("RIGHT JOIN", "c.c_custkey = o.o_custkey AND o.o_orderkey < 9")))
queries("same_join_constraints", ("SELECT a.n_name FROM nation a JOIN nation b USING (n_regionkey)", "SELECT a.n_name FROM nation a INNER JOIN nation b USING (n_regionkey)"), ("SELECT a.n_name FROM nation a JOIN nation b USING (n_regionkey)", "SELECT a.n_name FROM nation a JOIN nation b USING (n_nationkey)"))
expressions("same_type_synonyms", "part", ("p_size::int8 / 7", "p_size::bigint / 7"), ("CAST(p_retailprice AS int4)", "p_retailprice::integer"), ("p_retailprice::float4::text", "p_retailprice::real::text"), ("p_retailprice::int4", "p_retailprice::numeric(12,1)"))
expressions("same_scalar_subqueries", "orders", ("(SELECT lower(o_orderstatus) AS x)", "lower(o_orderstatus)"), ("o_totalprice > (SELECT max(o_totalprice) / 2 FROM orders)", "o_totalprice > (SELECT min(o_totalprice) / 2 FROM orders)"))
queries(
    "same_select_clauses", ("SELECT DISTINCT o_orderstatus AS o_orderstatus FROM public.orders WHERE (o_custkey > 5) GROUP BY o_orderstatus HAVING (count(*) > 1)", "select distinct o_orderstatus from orders where o_custkey > 5 group by o_orderstatus having count(*) > 1"), ("SELECT DISTINCT o_orderstatus FROM orders", "SELECT o_orderstatus FROM orders"),
    ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12"), ("SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders QUALIFY (r < 5)", "SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders QUALIFY r < 5"),
)
expressions("same_parentheses", "orders", ("((o_custkey > 5) AND (o_orderkey < 100))", "o_custkey > 5 AND o_orderkey < 100"), ("(o_custkey + 2) * 3", "o_custkey + 2 * 3"), ("(o_custkey > 5 OR o_orderkey < 100) AND o_orderstatus = 'F'", "o_custkey > 5 OR o_orderkey < 100 AND o_orderstatus = 'F'"), ("NOT (o_custkey > 5 AND o_orderkey < 100)", "NOT o_custkey > 5 AND o_orderkey < 100"))
expressions("same_like_operators", "part", ("p_name ~~ '%a%'::text", "p_name LIKE '%a%'"), ("p_name !~~ '%a%'", "p_name NOT LIKE '%a%'"), ("p_type ~~* '%E%'", "p_type ILIKE '%E%'"), ("p_name ~~ '%a%'", "p_name !~~ '%a%'"))
expressions("same_casts", "orders", ("o_orderstatus::text = 'F'::text", "o_orderstatus = 'F'"), ("o_custkey::numeric > 5", "o_custkey > 5"), ("o_totalprice::numeric(12,0) > 1000.4", "o_totalprice::bigint / 1000 > 1000.4"), ("o_orderdate::date = o_orderdate", "o_orderdate = o_orderdate + INTERVAL 1 DAY"), ("o_custkey / 2::numeric", "o_custkey / 2"), ("o_totalprice::integer", "o_totalprice"))
expressions("same_exists_and_in", "customer", ("EXISTS (SELECT 1 FROM public.orders o WHERE (o.o_custkey = c_custkey))", "exists (select 1 from orders o where o.o_custkey = c_custkey)"), ("NOT (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F'))", "NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F')"), ("c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"))
expressions(
    "same_predicates", "orders", ("CASE WHEN (o_custkey > 5) THEN 'a'::text ELSE 'b'::text END", "CASE WHEN o_custkey > 5 THEN 'a' ELSE 'b' END"), ("((o_custkey >= 5) AND (o_custkey <= 9))", "o_custkey >= 5 AND o_custkey <= 9"), ("o_custkey BETWEEN 5 AND 9", "o_custkey NOT BETWEEN 5 AND 9"), ("(o_custkey IS NOT NULL)", "o_custkey IS NOT NULL"), ("o_orderstatus IS DISTINCT FROM 'F'::text", "o_orderstatus IS DISTINCT FROM 'F'"), ("o_orderstatus IS DISTINCT FROM 'F'", "o_orderstatus IS NOT DISTINCT FROM 'F'"),
    ("- o_custkey", "-o_custkey"), ("o_custkey != 5", "o_custkey <> 5"),
)
expressions("same_any_all", "orders", ("o_orderstatus = ANY (ARRAY['F'::text, 'O'::text])", "o_orderstatus IN ('F', 'O')"), ("o_orderstatus <> ALL (ARRAY['F'::text, 'O'::text])", "o_orderstatus NOT IN ('F', 'O')"), ("o_orderstatus IN ('F', 'O')", "o_orderstatus IN ('F')"), ("o_custkey IN (1, 2)", "o_custkey NOT IN (1, 2)"))
expressions("same_array_literals", "nation", ("ARRAY['a'::text, n_name]", "ARRAY['a', n_name]"), ("ARRAY[n_nationkey, 1]", "ARRAY[1, n_nationkey]"))
pairs("same_nextval", [("nextval('public.s'::regclass)", "nextval('s'::regclass)"), ("nextval('a.s'::regclass)", "nextval('s'::regclass)")], same, ["SELECT 0::INTEGER AS pair, true AS same", "SELECT 1::INTEGER, false"])
BODIES = [("SELECT 1", "\n  SELECT   1 "), ("SELECT 1", "SELECT 2"), ("BEGIN\n RETURN NEW;\nEND", "BEGIN RETURN NEW; END"), ("SELECT 'a b'", "SELECT 'ab'")]
pairs("same_function_bodies", BODIES, same_body, ["SELECT {}::INTEGER AS pair, trim(regexp_replace('{}', '\\s+', ' ', 'g')) = trim(regexp_replace('{}', '\\s+', ' ', 'g')) AS same".format(k, *(x.replace("'", "''") for x in p)) for k, p in enumerate(BODIES)])
TYPES = [("int", "integer"), ("int4", "INTEGER"), ("int2", "smallint"), ("int8", "bigint"), ("float8", "double precision"), ("float4", "real"), ("bool", "boolean"), ("decimal(10,2)", "numeric(10, 2)"), ("varchar", "character varying"), ("timestamptz", "timestamp with time zone"), ("timestamp", "timestamp without time zone"), ("int[]", "integer[]"), ("int", "bigint"), ("numeric(10,2)", "numeric(10,3)"), ("real", "double precision"), ("timestamp", "timestamptz"), ("int[]", "int")]
pairs("same_types", TYPES, lambda a, b: canonical_type(a) == canonical_type(b), [f"SELECT {k}::INTEGER AS pair, typeof(CAST(NULL AS {a})) = typeof(CAST(NULL AS {b.replace('varying', 'varying').replace('character varying', 'varchar').replace('without time zone', '').replace('timestamp with time zone', 'timestamptz')})) AS same" for k, (a, b) in enumerate(TYPES)])

# -- functions ---------------------------------------------------------------------------------------


def functions(name: str, select: str, tables: str, oracle: str | None = None) -> None:
    """A view in the server's dialect over the driver's tables; oracle: where the other engine's differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sparkpact.queries import declared_views

        return declared_views(spark, sf_dir, f"CREATE VIEW v AS {select};", tables)["public.v"]

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or select


functions("functions_aggregates", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS c, sum(o_custkey) AS s, min(o_orderdate) AS lo, max(o_totalprice) AS hi, round(avg(o_custkey), 6) AS a, bool_and(o_custkey > 0) AS every_one, bool_or(o_custkey > 100) AS any_one, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS list, bit_and(o_custkey) AS b1, bit_or(o_custkey) AS b2, round(stddev(o_custkey), 4) AS sd, round(corr(o_custkey, o_orderkey), 4) AS r FROM orders GROUP BY o_orderstatus", "orders")
functions("functions_ordered_aggregates", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name), '|') AS names, percentile_cont(0.5) WITHIN GROUP (ORDER BY n_nationkey) AS middle FROM nation GROUP BY n_regionkey", "nation")
functions("functions_window", "SELECT p_partkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(p_size) OVER w AS lg, lead(p_size, 2, 0) OVER w AS ld, first_value(p_size) OVER w AS f, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)", "part")
functions(
    "functions_datetime", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, date_part('month', o_orderdate) AS m, date_trunc('month', o_orderdate) AS t, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS c, o_orderdate::date AS d, make_date(2024, 2, 29) AS md, o_orderdate + interval '1 day' AS next, to_date('03/2020/15', 'MM/YYYY/DD') AS parsed FROM orders", "orders",
    "SELECT o_orderkey, extract(year FROM o_orderdate)::INTEGER AS y, date_part('month', o_orderdate)::INTEGER AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c, o_orderdate::DATE AS d, make_date(2024, 2, 29) AS md, o_orderdate + INTERVAL 1 DAY AS next, DATE '2020-03-15' AS parsed FROM orders",
)
functions(
    "functions_math", "SELECT p_partkey, abs(p_size - 20) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, mod(p_size, 7) AS m, power(p_size, 2) AS p, round(sqrt(p_size), 9) AS s, round(ln(p_size + 1), 9) AS l, round(log(10), 9) AS l10, round(log(2, 8), 9) AS lb, sign(p_size - 20) AS g, trunc(p_retailprice) AS t0, trunc(-p_retailprice) AS tn, trunc(p_retailprice, 1) AS t1, round(sin(p_size), 9) AS si, round(atan2(p_size, 3), 9) AS at, round(pi(), 9) AS pi, round(cbrt(27), 9) AS cb, round(degrees(1), 9) AS dg, p_size % 5 AS r FROM part", "part",
    "SELECT p_partkey, abs(p_size - 20) AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, mod(p_size, 7) AS m, power(p_size, 2) AS p, round(sqrt(p_size), 9) AS s, round(ln(p_size + 1), 9) AS l, round(log(10), 9) AS l10, round(log(2, 8), 9) AS lb, sign(p_size - 20)::DOUBLE AS g, trunc(p_retailprice) AS t0, trunc(-p_retailprice) AS tn, trunc(p_retailprice, 1) AS t1, round(sin(p_size), 9) AS si, round(atan2(p_size, 3), 9) AS at, round(pi(), 9) AS pi, round(cbrt(27), 9) AS cb, round(degrees(1), 9) AS dg, p_size % 5 AS r FROM part",
)
functions(
    "functions_string", "SELECT p_partkey, length(p_name) AS l, lower(p_name) AS lo, upper(p_name) AS up, initcap(p_type) AS ic, concat(p_name, NULL, p_size) AS cc, concat_ws('-', p_brand, p_size) AS cw, substring(p_name FROM 2 FOR 3) AS sb, substr(p_name, 3) AS ss, position('a' IN p_name) AS po, strpos(p_name, 'r') AS sp, ltrim('xxay', 'x') AS lt, rtrim('ayxx', 'x') AS rt, trim(both 'x' from 'xax') AS tr, btrim('xax', 'x') AS bt, lpad(p_name, 30, '*') AS lp, rpad(p_name, 30, '*') AS rp, repeat('ab', 3) AS re, reverse(p_name) AS rv, replace(p_name, 'a', 'bb') AS rl, split_part(p_name, ' ', 2) AS spl, left(p_name, 3) AS lf, left(p_name, -2) AS lf2, right(p_name, 2) AS rg, right(p_name, -2) AS rg2, ascii(p_name) AS an, chr(65) AS ch, md5(p_name) AS md, translate(p_name, 'ab', 'xy') AS tl, regexp_replace(p_name, '[aeiou]', '#') AS r1, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS rgx, to_hex(p_size) AS hx, format('%s is %L', p_brand, p_size) AS fm, quote_literal('it''s') AS ql FROM part", "part",
    "SELECT p_partkey, length(p_name)::INTEGER AS l, lower(p_name) AS lo, upper(p_name) AS up, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic, concat(p_name, NULL, p_size) AS cc, concat_ws('-', p_brand, p_size) AS cw, substring(p_name FROM 2 FOR 3) AS sb, substr(p_name, 3) AS ss, position('a' IN p_name)::INTEGER AS po, strpos(p_name, 'r')::INTEGER AS sp, ltrim('xxay', 'x') AS lt, rtrim('ayxx', 'x') AS rt, trim('xax', 'x') AS tr, trim('xax', 'x') AS bt, lpad(p_name, 30, '*') AS lp, rpad(p_name, 30, '*') AS rp, repeat('ab', 3) AS re, reverse(p_name) AS rv, replace(p_name, 'a', 'bb') AS rl, split_part(p_name, ' ', 2) AS spl, left(p_name, 3) AS lf, left(p_name, -2) AS lf2, right(p_name, 2) AS rg, right(p_name, -2) AS rg2, ascii(p_name) AS an, chr(65) AS ch, md5(p_name) AS md, translate(p_name, 'ab', 'xy') AS tl, regexp_replace(p_name, '[aeiou]', '#') AS r1, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS rgx, lower(to_hex(p_size)) AS hx, p_brand || ' is ''' || p_size || '''' AS fm, '''it''''s''' AS ql FROM part",
)
functions("functions_conversion", "SELECT p_partkey, p_size::text AS a, CAST(p_retailprice AS integer) AS b, '12'::int + 1 AS c, p_size::numeric(10,2) AS d, 't'::boolean AS e, '2024-05-06'::date AS f, p_name::varchar(5) AS g, to_number('12,345', '99G999') AS h, encode('ab'::bytea, 'hex') AS i FROM part", "part", "SELECT p_partkey, p_size::VARCHAR AS a, trunc(p_retailprice)::INTEGER AS b, 13 AS c, p_size::DECIMAL(10,2) AS d, true AS e, DATE '2024-05-06' AS f, left(p_name, 5) AS g, 12345::DECIMAL(5,0) AS h, '6162' AS i FROM part")
functions("functions_conditional", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, greatest(c_acctbal, 0, c_nationkey) AS b, least(c_acctbal, 0) AS c, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS d, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS e FROM customer", "customer")
functions("functions_null_counting", "SELECT event_id, num_nulls(props, nullif(event_type, 'click'), value) AS a, num_nonnulls(props, nullif(event_type, 'click')) AS b FROM events", "events", "SELECT event_id, (props IS NULL)::INTEGER + (event_type = 'click')::INTEGER + (value IS NULL)::INTEGER AS a, (props IS NOT NULL)::INTEGER + (event_type <> 'click')::INTEGER AS b FROM events")
functions(
    "functions_array", "SELECT n_nationkey, array_to_string(ARRAY['a', n_name, 'c'], '-') AS a, array_length(ARRAY[1, 2, n_nationkey], 1) AS b, array_position(ARRAY['x', n_name], n_name) AS c, array_to_string(array_append(ARRAY['x'], n_name), ',') AS d, array_to_string(array_prepend('x', ARRAY[n_name]), ',') AS e, array_to_string(array_cat(ARRAY['p'], ARRAY[n_name]), ',') AS f, array_to_string(array_remove(ARRAY['x', n_name, 'x'], 'x'), ',') AS g, array_to_string(array_replace(ARRAY['x', n_name], 'x', 'y'), ',') AS h, cardinality(string_to_array('a,b,c', ',')) AS i, n_name = ANY (ARRAY['CHINA', 'NATION_3']) AS j, (ARRAY['a', n_name])[2] AS k FROM nation", "nation",
    "SELECT n_nationkey, 'a-' || n_name || '-c' AS a, 3 AS b, 2::BIGINT AS c, 'x,' || n_name AS d, 'x,' || n_name AS e, 'p,' || n_name AS f, n_name AS g, 'y,' || n_name AS h, 3 AS i, n_name IN ('CHINA', 'NATION_3') AS j, n_name AS k FROM nation",
)
functions(
    "functions_json", "SELECT event_id, json_build_object('id', event_id, 'kind', event_type, 'none', NULL) AS a, json_build_array(event_id, event_type, NULL) AS b, json_array_length('[1, 2, 3]') AS c FROM events", "events",
    "SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"none\":null}' AS a, '[' || event_id || ',\"' || event_type || '\",null]' AS b, 3::INTEGER AS c FROM events",
)
functions("functions_set_returning", "SELECT n_nationkey, generate_series(1, 3) AS i FROM nation", "nation", "SELECT n_nationkey, unnest(range(1, 4))::INTEGER AS i FROM nation")
functions("functions_unnest", "SELECT n_nationkey, unnest(ARRAY['a', n_name]) AS x FROM nation", "nation")
functions("functions_operators", "SELECT p_partkey FROM part WHERE p_name ~ '^[a-m]' AND p_type !~ 'z' AND p_brand ~~ 'Brand%' AND NOT (p_size <> ALL (ARRAY[1, 2, 3, 5, 8, 13, 21, 34])) AND p_retailprice::int % 2 = 0", "part", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m]') AND NOT regexp_matches(p_type, 'z') AND p_brand LIKE 'Brand%' AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34) AND trunc(p_retailprice)::INTEGER % 2 = 0")


def functions_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls have a counterpart in Spark, and which are refused rather than guessed at."""
    from sparkpact.functions.builtins import spark_call

    rows = []
    for name in ("nextval", "currval", "pg_sleep", "txid_current", "set_config", "to_tsvector", "pg_get_viewdef", "json_populate_record", "lower", "now", "current_user", "version", "current_database", "gen_random_uuid"):
        try:
            rows.append((name, bool(spark_call(name, ["x"] if name == "lower" else []))))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, known boolean")


QUERIES["functions_known"] = functions_known
ORACLE_SQL["functions_known"] = "SELECT name, name IN (SELECT function_name FROM duckdb_functions() UNION ALL SELECT 'current_user') AND name NOT IN ('nextval', 'currval', 'txid_current', 'set_config', 'pg_sleep', 'pg_get_viewdef') AS known FROM (VALUES ('nextval'), ('currval'), ('pg_sleep'), ('txid_current'), ('set_config'), ('to_tsvector'), ('pg_get_viewdef'), ('json_populate_record'), ('lower'), ('now'), ('current_user'), ('version'), ('current_database'), ('gen_random_uuid')) v(name)"
