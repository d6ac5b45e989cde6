"""Queries of the schema engine over schemas that are generated from the rows of nation.

Each nation gives the DDL of some objects; the engine reads, compares, plans, renders or checks
them, and the SQL works out the same result from the nations' keys. In templates {k} stands for a
nation's key; cat() makes an SQL expression of a template.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.operators.diff import diff
from sparkpact.plans import filters, lifecycle
from sparkpact.plans.render import sql_of
from sparkpact.sources.catalog import Catalog, DuplicateObject
from sparkpact.sources.ddl import parse_ddl, unrecognised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The keys as k, for the SQL.
KEYS = "(SELECT n_nationkey AS k FROM nation)"


def keys_of(spark: SparkSession, sf_dir: str) -> list[int]:
    return sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect())


def cat(template: str) -> str:
    """An SQL expression of the text that a template gives for k."""
    return " || k || ".join("'" + part.replace("'", "''") + "'" for part in template.split("{k}"))


def fill(template: str, k: int) -> str:
    return template.replace("{k}", str(k))


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


# -- reading: DDL to catalog rows ------------------------------------------------------------------


def parse(name: str, ddl: str, kinds: str, expected: list[tuple[str, str, dict[str, str]]], once: str = "") -> None:
    """Objects of some kinds that DDL gives, as (kind, key, attribute, value); once: DDL that comes first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = parse_ddl(once + "\n".join(fill(ddl, k) for k in keys_of(spark, sf_dir)))
        rows = [(o.kind, o.key, a, v) for o in catalog.objects.values() if o.kind in kinds.split() for a, v in (o.text_attrs() or {"": ""}).items()]
        return spark.createDataFrame(rows, "kind string, key string, attribute string, value string")

    parts = [f"SELECT '{kind}' AS kind, {cat(key)} AS key, '{a}' AS attribute, {cat(v)} AS value FROM {KEYS}" for kind, key, attrs in expected for a, v in (attrs or {"": ""}).items()]
    register(name, run, "\nUNION ALL ".join(parts))


parse(
    "parse_table_inline_constraints", "CREATE TABLE t_{k} (id serial PRIMARY KEY, a varchar({k}0) NOT NULL DEFAULT 'x{k}' UNIQUE, b numeric(10,2) CHECK (b > {k}));", "table column primary_key index check sequence",
    [
        ("table", "public.t_{k}", {"rls": "false", "force_rls": "false"}), ("column", "public.t_{k}.id", {"data_type": "integer", "nullable": "false", "default": "nextval('public.t_{k}_id_seq'::regclass)"}), ("column", "public.t_{k}.a", {"data_type": "character varying({k}0)", "nullable": "false", "default": "'x{k}'"}),
        ("column", "public.t_{k}.b", {"data_type": "numeric(10,2)", "nullable": "true"}), ("primary_key", "public.t_{k}.primary_key", {"columns": '["id"]', "constraint": "t_{k}_pkey"}), ("index", "public.t_{k}.t_{k}_a_key", {"columns": '["a"]', "unique": "true", "method": "btree", "is_constraint": "true"}),
        ("check", "public.t_{k}.t_{k}_b_check", {"expression": "b > {k}"}), ("sequence", "public.t_{k}_id_seq", {"data_type": "integer", "start": "1", "increment": "1", "min": "1", "max": "2147483647", "cycle": "false", "cache": "1", "owned_by": "public.t_{k}.id"}),
    ],
)
parse("parse_table_like", "CREATE TABLE base_{k} (a int DEFAULT {k}, b text NOT NULL); CREATE TABLE copy_{k} (LIKE base_{k} INCLUDING DEFAULTS, c date);", "column", [("column", f"public.{t}_{{k}}.{c}", a) for t in ("base", "copy") for c, a in (("a", {"data_type": "integer", "nullable": "true", "default": "{k}"}), ("b", {"data_type": "text", "nullable": "false"}))] + [("column", "public.copy_{k}.c", {"data_type": "date", "nullable": "true"})])
parse(
    "parse_partitions", "CREATE TABLE r_{k} PARTITION OF m FOR VALUES FROM ({k}) TO (MAXVALUE); CREATE TABLE l_{k} PARTITION OF m FOR VALUES IN ('a{k}', 'b'); CREATE TABLE h_{k} PARTITION OF m FOR VALUES WITH (MODULUS 25, REMAINDER {k}); CREATE TABLE d_{k} PARTITION OF m DEFAULT;", "partition",
    [("partition", "public.r_{k}", {"parent": "public.m", "bound": '{"from": ["{k}"], "kind": "range", "to": ["MAXVALUE"]}'}), ("partition", "public.l_{k}", {"parent": "public.m", "bound": "{\"kind\": \"list\", \"values\": [\"'a{k}'\", \"'b'\"]}"}), ("partition", "public.h_{k}", {"parent": "public.m", "bound": '{"kind": "hash", "modulus": 25, "remainder": {k}}'}), ("partition", "public.d_{k}", {"parent": "public.m", "bound": '{"kind": "default"}'})],
    "CREATE TABLE m (a int) PARTITION BY RANGE (a);",
)
parse("parse_index", "CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS i_{k} ON ONLY s.t USING gin (lower(a), (b + {k})) INCLUDE (c) WHERE a > {k};", "index", [("index", "s.t.i_{k}", {"columns": '["lower(a)", "(b + {k})"]', "unique": "true", "method": "gin", "is_constraint": "false", "include": '["c"]', "predicate": "a > {k}"})])
parse("parse_enum", "CREATE TYPE e_{k} AS ENUM ('a', 'it''s {k}');", "enum", [("enum", "public.e_{k}", {"values": '["a", "it\'s {k}"]'})])
parse("parse_alter_type", "CREATE TYPE e_{k} AS ENUM ('b'); ALTER TYPE e_{k} ADD VALUE 'a{k}' BEFORE 'b'; ALTER TYPE e_{k} ADD VALUE IF NOT EXISTS 'b'; ALTER TYPE e_{k} ADD VALUE 'c' AFTER 'b'; ALTER TYPE e_{k} OWNER TO o_{k};", "enum owner", [("enum", "public.e_{k}", {"values": '["a{k}", "b", "c"]'}), ("owner", "enum public.e_{k}", {"on": "enum public.e_{k}", "owner": "o_{k}"})])
parse("parse_policy", "CREATE TABLE t_{k} (a int); CREATE POLICY p ON t_{k} FOR INSERT TO z, app_{k} WITH CHECK (a > {k}); CREATE POLICY q ON t_{k} USING (a = {k});", "policy", [("policy", "public.t_{k}.p", {"command": "INSERT", "roles": '["app_{k}", "z"]', "check": "a > {k}"}), ("policy", "public.t_{k}.q", {"command": "ALL", "roles": '["public"]', "using": "a = {k}"})])
parse(
    "parse_alter_table", "CREATE TABLE t_{k} (a int, b int, gone int); ALTER TABLE ONLY t_{k} ENABLE ROW LEVEL SECURITY, FORCE ROW LEVEL SECURITY; ALTER TABLE t_{k} ADD COLUMN IF NOT EXISTS c text DEFAULT '{k}', DROP COLUMN gone; ALTER TABLE t_{k} ALTER COLUMN a TYPE bigint, ALTER b SET NOT NULL, ALTER c DROP DEFAULT; ALTER TABLE t_{k} RENAME COLUMN b TO bb; ALTER TABLE t_{k} ADD CONSTRAINT old CHECK (a > {k}); ALTER TABLE t_{k} RENAME CONSTRAINT old TO new; ALTER TABLE t_{k} RENAME TO u_{k};", "table column check",
    [("table", "public.u_{k}", {"rls": "true", "force_rls": "true"}), ("column", "public.u_{k}.a", {"data_type": "bigint", "nullable": "true"}), ("column", "public.u_{k}.bb", {"data_type": "integer", "nullable": "false"}), ("column", "public.u_{k}.c", {"data_type": "text", "nullable": "true"}), ("check", "public.u_{k}.new", {"expression": "a > {k}"})],
)
parse("parse_attach_detach", "CREATE TABLE x_{k} (a int); CREATE TABLE y_{k} PARTITION OF m DEFAULT; ALTER TABLE m ATTACH PARTITION x_{k} FOR VALUES IN ({k}); ALTER TABLE m DETACH PARTITION y_{k};", "partition", [("partition", "public.x_{k}", {"parent": "public.m", "bound": '{"kind": "list", "values": ["{k}"]}'})], "CREATE TABLE m (a int) PARTITION BY LIST (a);")
parse("parse_default_privileges", "ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} IN SCHEMA s GRANT ALL ON SEQUENCES TO app WITH GRANT OPTION; ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} IN SCHEMA s REVOKE GRANT OPTION FOR SELECT ON SEQUENCES FROM app; ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} IN SCHEMA s REVOKE UPDATE ON SEQUENCES FROM app;", "default_privilege", [("default_privilege", "r_{k} in s on sequences to app", {"role": "r_{k}", "in_schema": "s", "object_type": "sequences", "grantee": "app", "privileges": '["SELECT", "USAGE"]', "grantable": '["USAGE"]'})])
parse("parse_function", "CREATE FUNCTION f_{k}(a int, OUT b text, VARIADIC c int[] DEFAULT ARRAY[{k}]) LANGUAGE sql STABLE SECURITY DEFINER SET work_mem = '{k}MB' AS $x$SELECT 'y{k}'$x$;", "function", [("function", "public.f_{k}(integer, integer[])", {"args": '[{"default": null, "mode": "IN", "name": "a", "type": "integer"}, {"default": null, "mode": "OUT", "name": "b", "type": "text"}, {"default": "ARRAY[{k}]", "mode": "VARIADIC", "name": "c", "type": "integer[]"}]', "language": "sql", "volatility": "STABLE", "security": "DEFINER", "config": '[["work_mem", "\'{k}MB\'"]]', "body": "SELECT 'y{k}'", "return_type": "text"})])
parse("parse_views", "CREATE OR REPLACE VIEW v_{k} (x) AS SELECT {k} AS a; CREATE MATERIALIZED VIEW m_{k} AS SELECT count(*) FROM t WHERE a = {k} WITH NO DATA;", "view", [("view", "public.v_{k}", {"materialized": "false", "columns": '["x"]', "query": "SELECT {k} AS a"}), ("view", "public.m_{k}", {"materialized": "true", "query": "SELECT count(*) FROM t WHERE a = {k}"})])
parse("parse_extension_schema_domain", "CREATE SCHEMA s_{k} AUTHORIZATION o_{k}; CREATE EXTENSION IF NOT EXISTS x_{k} WITH SCHEMA s_{k} VERSION '{k}'; CREATE DOMAIN s_{k}.d AS numeric(8,{k}) DEFAULT {k} NOT NULL CONSTRAINT c CHECK (VALUE > {k});", "schema extension domain owner", [("schema", "s_{k}", {}), ("owner", "schema s_{k}", {"on": "schema s_{k}", "owner": "o_{k}"}), ("extension", "x_{k}", {"schema": "s_{k}", "version": "{k}"}), ("domain", "s_{k}.d", {"data_type": "numeric(8,{k})", "not_null": "true", "default": "{k}", "checks": '[{"expression": "VALUE > {k}", "name": "c"}]'})])
TRIGGER = {"timing": "AFTER", "events": '["UPDATE"]', "for_each_row": "true", "args": "[]", "enabled": "ORIGIN", "constraint": "false", "update_columns": "[]", "deferrable": "false", "initially_deferred": "false", "function": "public.f"}
parse(
    "parse_trigger", "CREATE TRIGGER a_{k} BEFORE INSERT OR UPDATE OF x, y ON t FOR EACH ROW WHEN (NEW.x > {k}) EXECUTE FUNCTION f('{k}'); CREATE TRIGGER b_{k} AFTER UPDATE ON t REFERENCING OLD TABLE AS o NEW TABLE AS n FOR EACH STATEMENT EXECUTE PROCEDURE s.g(); CREATE CONSTRAINT TRIGGER c_{k} AFTER UPDATE ON t DEFERRABLE INITIALLY DEFERRED FOR EACH ROW EXECUTE FUNCTION f(); ALTER TABLE t DISABLE TRIGGER a_{k};", "trigger",
    [("trigger", "public.t.a_{k}", TRIGGER | {"timing": "BEFORE", "events": '["INSERT", "UPDATE"]', "args": "[\"'{k}'\"]", "enabled": "DISABLED", "update_columns": '["x", "y"]', "when": "NEW.x > {k}"}), ("trigger", "public.t.b_{k}", TRIGGER | {"for_each_row": "false", "function": "s.g", "old_table": "o", "new_table": "n"}), ("trigger", "public.t.c_{k}", TRIGGER | {"constraint": "true", "deferrable": "true", "initially_deferred": "true"})],
    "CREATE TABLE t (x int, y int);",
)
parse("parse_sequence", "CREATE SEQUENCE s_{k} AS integer INCREMENT BY 2 MINVALUE {k} START WITH 3{k} CACHE 5 CYCLE OWNED BY t.a;", "sequence", [("sequence", "public.s_{k}", {"data_type": "integer", "start": "3{k}", "increment": "2", "min": "{k}", "max": "2147483647", "cycle": "true", "cache": "5", "owned_by": "public.t.a"})])
parse("parse_drops", "CREATE TABLE t_{k} (a int); CREATE VIEW v_{k} AS SELECT 1; CREATE TYPE e_{k} AS ENUM ('a'); CREATE DOMAIN d_{k} AS int; CREATE SEQUENCE s_{k}; CREATE FUNCTION f_{k}(int) RETURNS int LANGUAGE sql AS 'SELECT 1'; CREATE INDEX i_{k} ON t_{k} (a); CREATE TABLE keep_{k} (a int); DROP TABLE IF EXISTS t_{k} CASCADE; DROP VIEW v_{k}; DROP TYPE e_{k}; DROP DOMAIN d_{k}; DROP SEQUENCE s_{k}; DROP FUNCTION f_{k}(int);", "table view enum domain sequence function index column", [("table", "public.keep_{k}", {"rls": "false", "force_rls": "false"}), ("column", "public.keep_{k}.a", {"data_type": "integer", "nullable": "true"})])
parse("parse_index_rename", "CREATE TABLE t_{k} (a int); CREATE INDEX i_{k} ON t_{k} (a); ALTER INDEX i_{k} RENAME TO j_{k};", "index", [("index", "public.t_{k}.j_{k}", {"columns": '["a"]', "unique": "false", "method": "btree", "is_constraint": "false"})])
parse("parse_server_aggregate", "CREATE SERVER s_{k} TYPE 'x' FOREIGN DATA WRAPPER w OPTIONS (host 'h{k}'); CREATE AGGREGATE a_{k}(int) (SFUNC = add, STYPE = int, INITCOND = '{k}', FINALFUNC = s.done); ALTER AGGREGATE a_{k}(int) OWNER TO o_{k};", "server aggregate owner", [("server", "s_{k}", {"type": "x", "fdw": "w", "options": '{"host": "h{k}"}'}), ("aggregate", "public.a_{k}(integer)", {"sfunc": "public.add", "stype": "integer", "initcond": "{k}", "finalfunc": "s.done", "parallel": "UNSAFE"}), ("owner", "aggregate public.a_{k}(integer)", {"on": "aggregate public.a_{k}(integer)", "owner": "o_{k}"})])
COMMENTED = ["schema s_{k}", "table public.t_{k}", "column public.t_{k}.a", "view public.v_{k}", "type public.e_{k}", "domain public.d_{k}", "sequence public.q_{k}", "index public.i_{k}", "function public.f_{k}(integer)", "extension x_{k}"]
COMMENTED_ON = ["TRIGGER g ON t_{k}", "POLICY p ON t_{k}", "CONSTRAINT c ON t_{k}", "CONSTRAINT c ON DOMAIN d_{k}"]
COMMENT_KEYS = ["trigger public.t_{k}.g", "policy public.t_{k}.p", "constraint public.t_{k}.c", "constraint domain public.d_{k}.c"]
parse("parse_comments", "".join(f"COMMENT ON {c.partition(' ')[0].upper()} {c.partition(' ')[2]} IS 'about {{k}}'; " for c in COMMENTED) + "".join(f"COMMENT ON {c} IS 'about {{k}}'; " for c in COMMENTED_ON) + "COMMENT ON TABLE gone_{k} IS 'x'; COMMENT ON TABLE gone_{k} IS NULL;", "comment", [("comment", c, {"on": c, "comment": "about {k}"}) for c in [*COMMENTED, *COMMENT_KEYS]])
parse("parse_grants", "CREATE TABLE t_{k} (a int); GRANT ALL ON t_{k} TO a; GRANT SELECT, UPDATE ON TABLE t_{k} TO b, c WITH GRANT OPTION; REVOKE GRANT OPTION FOR UPDATE ON t_{k} FROM b; REVOKE SELECT ON t_{k} FROM c; GRANT USAGE ON SCHEMA s_{k} TO a; GRANT EXECUTE ON FUNCTION f_{k}(int) TO a; GRANT a TO b;", "grant", [("grant", f"{on} to {to}", {"on": on, "grantee": to, "privileges": p, "grantable": g}) for on, to, p, g in (("table public.t_{k}", "a", '["DELETE", "INSERT", "REFERENCES", "SELECT", "TRIGGER", "TRUNCATE", "UPDATE"]', "[]"), ("table public.t_{k}", "b", '["SELECT", "UPDATE"]', '["SELECT"]'), ("table public.t_{k}", "c", '["UPDATE"]', '["UPDATE"]'), ("schema s_{k}", "a", '["USAGE"]', "[]"), ("function public.f_{k}(integer)", "a", '["EXECUTE"]', "[]"))])
parse("parse_owners", "CREATE TABLE t_{k} (a int); CREATE VIEW v_{k} AS SELECT 1; CREATE SEQUENCE s_{k}; CREATE FUNCTION f_{k}() RETURNS int LANGUAGE sql AS 'SELECT 1'; ALTER TABLE t_{k} OWNER TO o_{k}; ALTER VIEW v_{k} OWNER TO o_{k}; ALTER SEQUENCE s_{k} OWNER TO o_{k}; ALTER FUNCTION f_{k}() OWNER TO o_{k};", "owner", [("owner", on, {"on": on, "owner": "o_{k}"}) for on in ("table public.t_{k}", "view public.v_{k}", "sequence public.s_{k}", "function public.f_{k}()")])
parse("parse_preprocessing", "/* a /* nested */ comment */ CREATE TABLE \"T {k}\" (\"a;b\" text DEFAULT ';--{k}'); -- CREATE TABLE no_{k} (a int);\nDO $$ BEGIN CREATE TABLE no_{k} (a int); END $$; INSERT INTO x VALUES ({k}); SET x = {k}; SELECT 1; VACUUM t_{k};", "table column", [("table", "public.T {k}", {"rls": "false", "force_rls": "false"}), ("column", "public.T {k}.a;b", {"data_type": "text", "nullable": "true", "default": "';--{k}'"})])
parse("parse_ignored_alters", "CREATE TABLE t_{k} (a int); ALTER TABLE t_{k} CLUSTER ON x; ALTER TABLE t_{k} SET TABLESPACE z; ALTER TABLE t_{k} ALTER COLUMN a SET STATISTICS {k}; CREATE PUBLICATION p_{k} FOR ALL TABLES; CREATE RULE r AS ON INSERT TO t_{k} DO NOTHING;", "table column", [("table", "public.t_{k}", {"rls": "false", "force_rls": "false"}), ("column", "public.t_{k}.a", {"data_type": "integer", "nullable": "true"})])


def parse_unrecognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that declare nothing known and are not ignored by design, and what strict mode says."""
    text = "\n".join(fill("CREATE TABLE t_{k} (a int); CREATE RULE r_{k} AS ON INSERT TO t DO NOTHING; INSERT INTO t VALUES (1); CREATE PUBLICATION p_{k};", k) for k in keys_of(spark, sf_dir))
    rows = [(line, kind, True) for line, kind, _ in unrecognised(text)]
    try:
        parse_ddl(text, strict=True)
        rows = [(*r[:2], False) for r in rows]
    except ValueError:
        pass
    return spark.createDataFrame(rows, "line int, kind string, strict boolean")


register("parse_unrecognised", parse_unrecognised, "SELECT (row_number() OVER (ORDER BY n_nationkey))::INTEGER AS line, kind, true AS strict FROM nation, (VALUES ('create rule'), ('create publication')) v(kind) QUALIFY true".replace("(row_number() OVER (ORDER BY n_nationkey))::INTEGER", "(dense_rank() OVER (ORDER BY n_nationkey))::INTEGER"))

# -- comparing: two generations of a schema ----------------------------------------------------------

#: Which nations have the object now and shall have it, and in which of two variants.
GENERATIONS = "SELECT n_nationkey AS k, n_nationkey % 3 <> 0 AS in_c, n_nationkey % 5 <> 0 AS in_t, n_nationkey % 2 = 0 AS v_c, n_nationkey % 4 = 0 AS v_t FROM nation"


def generations(spark: SparkSession, sf_dir: str, base: str, first: str, second: str) -> tuple[Catalog, Catalog]:
    """The schema as it is and as it shall be; base is there on both sides."""
    keys = keys_of(spark, sf_dir)
    common = "\n".join(fill(base, k) for k in (keys if "{k}" in base else keys[:1]))
    now = [fill(first if k % 2 == 0 else second, k) for k in keys if k % 3]
    then = [fill(first if k % 4 == 0 else second, k) for k in keys if k % 5]
    return parse_ddl("\n".join([common, *now])), parse_ddl("\n".join([common, *then]))


def compare(name: str, kind: str, key: str, first: str, second: str, changed: str = "alter", base: str = "", drops: bool = True) -> None:
    """Operations on one kind of object. changed: what a change of variant is (drop and create: "drop create")."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff(spark, *generations(spark, sf_dir, base, first, second)).where(F.col("kind") == kind).select("op", "key")

    steps = "[" + ", ".join(f"'{c}'" for c in changed.split()) + "]::VARCHAR[]"
    register(
        name, run, f"""SELECT unnest(CASE WHEN in_t AND NOT in_c THEN ['create'] WHEN in_c AND NOT in_t THEN {"['drop']" if drops else "[]::VARCHAR[]"} WHEN in_c AND in_t AND v_c <> v_t THEN {steps} ELSE []::VARCHAR[] END) AS op, {cat(key)} AS key FROM ({GENERATIONS})""",
    )


TABLE = "CREATE TABLE t_{k} (a int, b int);"
compare("diff_schemas", "schema", "s_{k}", "CREATE SCHEMA s_{k};", "CREATE SCHEMA s_{k} AUTHORIZATION x;", "")
compare("diff_extensions", "extension", "x_{k}", "CREATE EXTENSION x_{k} WITH VERSION '1';", "CREATE EXTENSION x_{k} WITH VERSION '2';")
compare("diff_servers", "server", "s_{k}", "CREATE SERVER s_{k} FOREIGN DATA WRAPPER w OPTIONS (host 'a');", "CREATE SERVER s_{k} FOREIGN DATA WRAPPER w OPTIONS (host 'b');")
compare("diff_enums", "enum", "public.e_{k}", "CREATE TYPE e_{k} AS ENUM ('a', 'b');", "CREATE TYPE e_{k} AS ENUM ('b', 'a');")
compare("diff_domains", "domain", "public.d_{k}", "CREATE DOMAIN d_{k} AS int CHECK (VALUE > 0);", "CREATE DOMAIN d_{k} AS int CHECK (VALUE > 1);")
compare("diff_tables", "table", "public.t_{k}", "CREATE TABLE t_{k} (a int) PARTITION BY RANGE (a);", "CREATE TABLE t_{k} (a int) PARTITION BY LIST (a);")
compare("diff_partitions", "partition", "public.p_{k}", "CREATE TABLE p_{k} PARTITION OF m FOR VALUES IN ({k});", "CREATE TABLE p_{k} PARTITION OF m FOR VALUES IN ({k}, 99);", "drop create", "CREATE TABLE m (a int) PARTITION BY LIST (a);")
compare("diff_function_bodies", "function", "public.f_{k}()", "CREATE FUNCTION f_{k}() RETURNS int LANGUAGE sql AS 'SELECT 1';", "CREATE FUNCTION f_{k}() RETURNS int LANGUAGE sql AS 'SELECT 2';")
compare("diff_function_results", "function", "public.f_{k}()", "CREATE FUNCTION f_{k}() RETURNS int LANGUAGE sql AS 'SELECT 1';", "CREATE FUNCTION f_{k}() RETURNS bigint LANGUAGE sql AS 'SELECT 1';", "drop create")
compare("diff_function_defaults", "function", "public.f_{k}(text)", "CREATE FUNCTION f_{k}(a text DEFAULT 'x') RETURNS int LANGUAGE sql AS 'SELECT 1';", "CREATE FUNCTION f_{k}(a text DEFAULT 'x'::text) RETURNS int LANGUAGE sql AS 'SELECT 1';", "")
compare("diff_aggregates", "aggregate", "public.a_{k}(integer)", "CREATE AGGREGATE a_{k}(int) (SFUNC = f, STYPE = int, INITCOND = '0');", "CREATE AGGREGATE a_{k}(int) (SFUNC = f, STYPE = int, INITCOND = '1');", "drop create")
compare("diff_views", "view", "public.v_{k}", "CREATE VIEW v_{k} AS SELECT 1 AS a;", "CREATE VIEW v_{k} AS SELECT 2 AS a;")
compare("diff_triggers", "trigger", "public.t_{k}.g", "CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f();", "CREATE TRIGGER g AFTER INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f();", "drop create", TABLE)
compare("diff_trigger_modes", "trigger", "public.t_{k}.g", "CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f();", "CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f(); ALTER TABLE t_{k} DISABLE TRIGGER g;", "alter", TABLE)
compare("diff_sequences", "sequence", "public.s_{k}", "CREATE SEQUENCE s_{k} INCREMENT 1;", "CREATE SEQUENCE s_{k} INCREMENT 2;")
compare("diff_owners", "owner", "table public.t_{k}", "ALTER TABLE t_{k} OWNER TO a;", "ALTER TABLE t_{k} OWNER TO b;", "alter", TABLE, drops=False)
compare("diff_column_types", "column", "public.t_{k}.c", "ALTER TABLE t_{k} ADD COLUMN c int;", "ALTER TABLE t_{k} ADD COLUMN c bigint;", "alter", TABLE)
compare("diff_column_nulls_defaults", "column", "public.t_{k}.c", "ALTER TABLE t_{k} ADD COLUMN c int NOT NULL DEFAULT 1;", "ALTER TABLE t_{k} ADD COLUMN c int DEFAULT 2;", "alter", TABLE)
compare("diff_columns_generated", "column", "public.t_{k}.c", "ALTER TABLE t_{k} ADD COLUMN c int GENERATED ALWAYS AS (a + 1) STORED;", "ALTER TABLE t_{k} ADD COLUMN c int GENERATED ALWAYS AS (a + 2) STORED;", "drop create", TABLE)
compare("diff_columns_identity", "column", "public.t_{k}.c", "ALTER TABLE t_{k} ADD COLUMN c int GENERATED ALWAYS AS IDENTITY;", "ALTER TABLE t_{k} ADD COLUMN c int GENERATED BY DEFAULT AS IDENTITY;", "alter", TABLE)
compare("diff_primary_keys", "primary_key", "public.t_{k}.primary_key", "ALTER TABLE t_{k} ADD PRIMARY KEY (a);", "ALTER TABLE t_{k} ADD PRIMARY KEY (b);", "drop create", TABLE)
compare("diff_indexes", "index", "public.t_{k}.i_{k}", "CREATE INDEX i_{k} ON t_{k} (a) WHERE a > 1;", "CREATE INDEX i_{k} ON t_{k} (a) WHERE a > 2;", "drop create", TABLE)
compare("diff_unique_constraints", "index", "public.t_{k}.u", "ALTER TABLE t_{k} ADD CONSTRAINT u UNIQUE (a);", "ALTER TABLE t_{k} ADD CONSTRAINT u UNIQUE (a, b);", "drop create", TABLE)
compare("diff_foreign_keys", "foreign_key", "public.t_{k}.f", "ALTER TABLE t_{k} ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES t_{k} (b) ON DELETE CASCADE;", "ALTER TABLE t_{k} ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES t_{k} (b) ON DELETE SET NULL;", "drop create", TABLE)
compare("diff_foreign_keys_deferrable", "foreign_key", "public.t_{k}.f", "ALTER TABLE t_{k} ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES t_{k} (b);", "ALTER TABLE t_{k} ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES t_{k} (b) DEFERRABLE;", "drop create", TABLE)
compare("diff_checks", "check", "public.t_{k}.c", "ALTER TABLE t_{k} ADD CONSTRAINT c CHECK (a > 1);", "ALTER TABLE t_{k} ADD CONSTRAINT c CHECK (a >= 1);", "drop create", TABLE)
compare("diff_checks_same_meaning", "check", "public.t_{k}.c", "ALTER TABLE t_{k} ADD CONSTRAINT c CHECK (a IN (1, 2));", "ALTER TABLE t_{k} ADD CONSTRAINT c CHECK ((a = ANY (ARRAY[1, 2])));", "", TABLE)
compare("diff_exclusions", "exclusion", "public.t_{k}.x", "ALTER TABLE t_{k} ADD CONSTRAINT x EXCLUDE USING gist (a WITH =);", "ALTER TABLE t_{k} ADD CONSTRAINT x EXCLUDE USING gist (a WITH =, b WITH &&);", "drop create", TABLE)
compare("diff_row_security", "table", "public.t_{k}", "CREATE TABLE t_{k} (a int); ALTER TABLE t_{k} ENABLE ROW LEVEL SECURITY;", "CREATE TABLE t_{k} (a int); ALTER TABLE t_{k} FORCE ROW LEVEL SECURITY;")
compare("diff_policies", "policy", "public.t_{k}.p", "CREATE POLICY p ON t_{k} FOR SELECT TO x USING (a > 1);", "CREATE POLICY p ON t_{k} FOR SELECT TO y USING (a > 1);", "alter", TABLE)
compare("diff_grants", "grant", "table public.t_{k} to app", "GRANT SELECT ON t_{k} TO app;", "GRANT SELECT ON t_{k} TO app WITH GRANT OPTION;", "alter", TABLE)
compare("diff_default_privileges", "default_privilege", "CURRENT_ROLE in s_{k} on tables to app", "ALTER DEFAULT PRIVILEGES IN SCHEMA s_{k} GRANT SELECT ON TABLES TO app;", "ALTER DEFAULT PRIVILEGES IN SCHEMA s_{k} GRANT INSERT ON TABLES TO app;")
compare("diff_comments", "comment", "table public.t_{k}", "COMMENT ON TABLE t_{k} IS 'x';", "COMMENT ON TABLE t_{k} IS 'y';", "alter", TABLE)
compare("diff_constraint_comments", "comment", "constraint public.t_{k}.c", "COMMENT ON CONSTRAINT c ON t_{k} IS 'x';", "COMMENT ON CONSTRAINT c ON t_{k} IS 'y';", "alter", "CREATE TABLE t_{k} (a int, CONSTRAINT c CHECK (a > 0));")


def recreations(name: str, both: str, changed: str, unchanged: str, kinds: str, expected: list[tuple[str, str]]) -> None:
    """What a change that only even nations make forces along. expected: kind and key of what is
    dropped and created where there is a change."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = keys_of(spark, sf_dir)
        now = parse_ddl("\n".join(fill(unchanged, k) + fill(both, k) for k in keys))
        then = parse_ddl("\n".join(fill(unchanged if k % 2 else changed, k) + fill(both, k) for k in keys))
        return diff(spark, now, then).where(F.col("kind").isin(*kinds.split())).select("op", "kind", "key")

    register(name, run, "\nUNION ALL ".join(f"SELECT op, '{kind}' AS kind, {cat(key)} AS key FROM {KEYS}, (VALUES ('drop'), ('create')) v(op) WHERE k % 2 = 0" for kind, key in expected))


WIDE, NARROW = "CREATE TABLE t_{k} (a bigint, b int); ", "CREATE TABLE t_{k} (a int, b int); "
recreations("recreate_views_transitively", "CREATE VIEW v_{k} AS SELECT a FROM t_{k}; CREATE VIEW w_{k} AS SELECT a FROM v_{k}; CREATE MATERIALIZED VIEW x_{k} AS SELECT a FROM w_{k};", WIDE, NARROW, "view", [("view", "public.v_{k}"), ("view", "public.w_{k}"), ("view", "public.x_{k}")])
recreations("recreate_policies", "CREATE POLICY p ON t_{k} USING (a > 1);", WIDE, NARROW, "policy", [("policy", "public.t_{k}.p")])
recreations("recreate_triggers", "CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f();", WIDE, NARROW, "trigger", [("trigger", "public.t_{k}.g")])
recreations("recreate_foreign_keys", "CREATE TABLE c_{k} (x bigint REFERENCES t_{k} (a), y int REFERENCES t_{k} (b));", WIDE, NARROW, "foreign_key", [("foreign_key", "public.c_{k}.c_{k}_x_fkey")])
recreations("recreate_for_dropped_columns", "CREATE VIEW v_{k} AS SELECT a FROM t_{k};", "CREATE TABLE t_{k} (a int); ", NARROW, "view", [("view", "public.v_{k}")])
recreations("recreate_policies_of_functions", "CREATE TABLE t_{k} (a int); CREATE POLICY p ON t_{k} USING (f_{k}(a));", "CREATE FUNCTION f_{k}(x int) RETURNS boolean LANGUAGE sql AS 'SELECT true'; ".replace("x int", "x bigint"), "CREATE FUNCTION f_{k}(x int) RETURNS boolean LANGUAGE sql AS 'SELECT true'; ", "policy", [("policy", "public.t_{k}.p")])


def conflicting_alters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that changes and stands in the way of a type change is dropped and created, not altered;
    the plan holds nothing both dropped and altered."""
    keys = keys_of(spark, sf_dir)
    now = parse_ddl("\n".join(fill(NARROW + "CREATE VIEW v_{k} AS SELECT a FROM t_{k};", k) for k in keys))
    then = parse_ddl("\n".join(fill((NARROW if k % 2 else WIDE) + "CREATE VIEW v_{k} AS SELECT a, b FROM t_{k};", k) for k in keys))
    ops = lifecycle.migration(spark, now, then, allow_destructive=True)["ops"]
    return spark.createDataFrame([(o["op"], o["key"]) for o in ops if o["kind"] == "view"], "op string, key string")


register("conflicting_alters", conflicting_alters, f"SELECT unnest(CASE WHEN k % 2 = 0 THEN ['drop', 'create'] ELSE ['alter'] END) AS op, {cat('public.v_{k}')} AS key FROM {KEYS}")

# -- planning ----------------------------------------------------------------------------------------

APP = """CREATE SCHEMA s_{k}; CREATE EXTENSION x_{k}; CREATE TYPE e_{k} AS ENUM ('a'); CREATE DOMAIN d_{k} AS int; CREATE FUNCTION f_{k}() RETURNS trigger LANGUAGE plpgsql AS $$BEGIN RETURN NEW; END$$;
CREATE TABLE t_{k} (a int PRIMARY KEY, b int, CONSTRAINT c CHECK (a > 0)); ALTER TABLE t_{k} ADD CONSTRAINT f FOREIGN KEY (b) REFERENCES t_{n} (a); CREATE INDEX i_{k} ON t_{k} (b); CREATE VIEW v_{k} AS SELECT a FROM t_{k}; CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f_{k}(); CREATE POLICY p ON t_{k} USING (a > 0);
GRANT SELECT ON t_{k} TO app; COMMENT ON TABLE t_{k} IS 'x';"""
#: Order in which kinds are made, and that in which they go.
MADE = ["schema", "extension", "enum", "domain", "function", "table", "column", "primary_key", "index", "foreign_key", "check", "view", "trigger", "policy", "grant", "comment"]
GONE = ["comment", "grant", "policy", "trigger", "view", "check", "foreign_key", "index", "primary_key", "table", "function", "domain", "enum", "extension", "schema"]


def app(keys: list[int]) -> Catalog:
    """Tables whose foreign keys make one cycle."""
    return parse_ddl("\n".join(fill(APP, k).replace("{n}", str(keys[(at + 1) % len(keys)])) for at, k in enumerate(keys)))


def tiers(spark: SparkSession, ops: list[dict]) -> DataFrame:
    """(kind, first, last): the steps between which the operations on a kind stand."""
    rows = [(o["kind"], n + 1) for n, o in enumerate(ops)]
    return spark.createDataFrame(rows, "kind string, step int").groupBy("kind").agg(F.min("step").alias("first"), F.max("step").alias("last"))


def tiers_sql(kinds: list[str], each: dict[str, int]) -> str:
    values = ", ".join(f"({n}, '{kind}', {each.get(kind, 1)})" for n, kind in enumerate(kinds))
    return f"SELECT kind, (sum(size) OVER (ORDER BY n) - size + 1)::INTEGER AS first, (sum(size) OVER (ORDER BY n))::INTEGER AS last FROM (SELECT n, kind, each * (SELECT count(*) FROM nation) AS size FROM (VALUES {values}) v(n, kind, each))"


register("plan_create_tiers", lambda spark, sf_dir: tiers(spark, lifecycle.migration(spark, Catalog(), app(keys_of(spark, sf_dir)))["ops"]), tiers_sql(MADE, {"column": 2}))
register("plan_drop_tiers", lambda spark, sf_dir: tiers(spark, [o for o in lifecycle.migration(spark, app(keys_of(spark, sf_dir)), Catalog(), allow_destructive=True)["ops"]]), tiers_sql([k for k in GONE if k not in ("policy", "trigger", "check", "foreign_key", "index", "primary_key")], {}))
register("plan_reverse", lambda spark, sf_dir: tiers(spark, lifecycle.migration(spark, app(keys_of(spark, sf_dir)), Catalog(), reverse=True)["ops"]), tiers_sql(MADE, {"column": 2}))


def plan_sequence_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OWNED BY comes as an alter of its own after the table."""
    ops = lifecycle.migration(spark, Catalog(), parse_ddl("\n".join(fill("CREATE TABLE t_{k} (id serial);", k) for k in keys_of(spark, sf_dir))))["ops"]
    at = {(o["op"], o["kind"], o["key"]): n for n, o in enumerate(ops)}
    rows = [(key, at["create", "sequence", key] < at["create", "table", key.removesuffix("_id_seq")] < n) for (op, kind, key), n in at.items() if (op, kind) == ("alter", "sequence")]
    return spark.createDataFrame(rows, "key string, in_order boolean")


register("plan_sequence_owners", plan_sequence_owners, f"SELECT {cat('public.t_{k}_id_seq')} AS key, true AS in_order FROM {KEYS}")


def plan_functions_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that a table's default calls comes before it, one that returns rows of a table after it."""
    text = "CREATE FUNCTION early_{k}() RETURNS int LANGUAGE sql AS 'SELECT 1'; CREATE TABLE t_{k} (a int DEFAULT early_{k}()); CREATE FUNCTION late_{k}() RETURNS SETOF t_{k} LANGUAGE sql AS 'SELECT * FROM t_{k}';"
    ops = lifecycle.migration(spark, Catalog(), parse_ddl("\n".join(fill(text, k) for k in keys_of(spark, sf_dir))))["ops"]
    at = {o["key"]: n for n, o in enumerate(ops)}
    rows = [(k, at[f"public.early_{k}()"] < at[f"public.t_{k}.a"], at[f"public.t_{k}"] < at[f"public.late_{k}()"]) for k in keys_of(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, early boolean, late boolean")


register("plan_functions_and_tables", plan_functions_and_tables, f"SELECT k, true AS early, true AS late FROM {KEYS}")


def plan_type_change_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views go before a column's type changes and come back after it; the steps of one chain by rank."""
    keys = keys_of(spark, sf_dir)
    views = "CREATE VIEW v_{k} AS SELECT a FROM t_{k}; CREATE VIEW w_{k} AS SELECT a FROM v_{k};"
    now, then = (parse_ddl("\n".join(fill(t + views, k) for k in keys)) for t in (NARROW, WIDE))
    ops = lifecycle.migration(spark, now, then, allow_destructive=True)["ops"]
    chain: dict[str, list[str]] = {}
    for o in ops:
        own = o["key"].split(".")[1]
        chain.setdefault(own.split("_")[1], []).append(f"{o['op']} {own.split('_')[0]}")
    return spark.createDataFrame([(int(k), ", ".join(steps)) for k, steps in chain.items()], "k int, steps string")


register("plan_type_change_sandwich", plan_type_change_sandwich, f"SELECT k, 'drop w, drop v, alter t, create v, create w' AS steps FROM {KEYS}")


def plan_dump_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump makes a view after those it reads: v_k reads v_(k - 1), so the views come in order of k."""
    keys = keys_of(spark, sf_dir)
    text = "\n".join(f"CREATE VIEW v_{k} AS SELECT 1 AS a{f' FROM v_{keys[n - 1]}' if n else ''};" for n, k in reversed(list(enumerate(keys))))
    statements = lifecycle.dump(parse_ddl(text))
    return spark.createDataFrame([(n + 1, s.split('"')[3]) for n, s in enumerate(statements)], "step int, view string")


register("plan_dump_order", plan_dump_order, f"SELECT (row_number() OVER (ORDER BY k))::INTEGER AS step, {cat('v_{k}')} AS view FROM {KEYS}")


def plan_expand_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New NOT NULL columns are added, filled and constrained; drops come last."""
    keys = keys_of(spark, sf_dir)
    now = parse_ddl("\n".join(fill("CREATE TABLE t_{k} (a int, gone int);", k) for k in keys))
    then = parse_ddl("\n".join(fill("CREATE TABLE t_{k} (a int, b int NOT NULL DEFAULT {k});", k) for k in keys))
    ops = lifecycle.migration(spark, now, then, zero_downtime=True, allow_destructive=True)["ops"]
    return spark.createDataFrame([(o["phase"], o["op"], o["key"]) for o in ops], "phase string, op string, key string")


register("plan_expand_contract", plan_expand_contract, f"SELECT phase, op, 'public.t_' || k || c AS key FROM {KEYS}, (VALUES ('expand', 'create', '.b'), ('backfill', 'backfill', '.b'), ('contract', 'alter', '.b'), ('contract', 'drop', '.gone')) v(phase, op, c)")

# -- rendering ---------------------------------------------------------------------------------------


def render(name: str, kind: str, before: str, after: str, expected: list[str], base: str = "", op: str | None = None) -> None:
    """The statements of the operations on one kind that lead from one DDL text to another."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = keys_of(spark, sf_dir)
        ops = lifecycle.migration(spark, *(parse_ddl("\n".join(fill(base + t, k) for k in keys)) for t in (before, after)), allow_destructive=True)["ops"]
        return spark.createDataFrame([(s,) for o in ops if o["kind"] == kind and op in (None, o["op"]) for s in sql_of(o)], "statement string")

    register(name, run, "\nUNION ALL ".join(f"SELECT {cat(e)} AS statement FROM {KEYS}" for e in expected))


render("render_schema", "schema", "", "CREATE SCHEMA s_{k};", ['CREATE SCHEMA IF NOT EXISTS "s_{k}";'])
render("render_drop_schema", "schema", "CREATE SCHEMA s_{k};", "", ['DROP SCHEMA IF EXISTS "s_{k}" CASCADE;'])
render("render_extension", "extension", "CREATE EXTENSION x_{k} VERSION '1';", "CREATE EXTENSION x_{k} VERSION '2'; CREATE EXTENSION y_{k} WITH SCHEMA s;", ['ALTER EXTENSION "x_{k}" UPDATE TO \'2\';', 'CREATE EXTENSION IF NOT EXISTS "y_{k}" WITH SCHEMA "s";'])
render("render_server", "server", "CREATE SERVER s_{k} FOREIGN DATA WRAPPER w OPTIONS (host 'a', port '1');", "CREATE SERVER s_{k} FOREIGN DATA WRAPPER w OPTIONS (host 'b', db '{k}');", ['ALTER SERVER "s_{k}" OPTIONS (ADD db \'{k}\', SET host \'b\', DROP port);'])
render("render_enum_values", "enum", "CREATE TYPE e_{k} AS ENUM ('b');", "CREATE TYPE e_{k} AS ENUM ('a', 'b', 'c{k}');", ["ALTER TYPE \"public\".\"e_{k}\" ADD VALUE 'a' BEFORE 'b';", "ALTER TYPE \"public\".\"e_{k}\" ADD VALUE 'c{k}' AFTER 'b';"])
render("render_domain", "domain", "CREATE DOMAIN d_{k} AS int DEFAULT 1 CONSTRAINT c CHECK (VALUE > 0);", "CREATE DOMAIN d_{k} AS int NOT NULL CONSTRAINT c CHECK (VALUE > {k}0);", ['ALTER DOMAIN "public"."d_{k}" DROP DEFAULT;', 'ALTER DOMAIN "public"."d_{k}" SET NOT NULL;', 'ALTER DOMAIN "public"."d_{k}" DROP CONSTRAINT "c";', 'ALTER DOMAIN "public"."d_{k}" ADD CONSTRAINT "c" CHECK (VALUE > {k}0);'])
render("render_partition", "partition", "CREATE TABLE p_{k} PARTITION OF m_{k} DEFAULT;", "CREATE TABLE p_{k} PARTITION OF m_{k} FOR VALUES FROM ({k}) TO (MAXVALUE);", ['DROP TABLE "public"."p_{k}";', 'CREATE TABLE "public"."p_{k}" PARTITION OF "public"."m_{k}" FOR VALUES FROM ({k}) TO (MAXVALUE);'], "CREATE TABLE m_{k} (a int) PARTITION BY RANGE (a);")
render("render_column_changes", "column", "CREATE TABLE t_{k} (a int, b int NOT NULL, c int DEFAULT 1, d int);", "CREATE TABLE t_{k} (a bigint, b int, c int DEFAULT {k}, e text NOT NULL);", ['ALTER TABLE "public"."t_{k}" ALTER COLUMN "a" TYPE bigint USING "a"::bigint;', 'ALTER TABLE "public"."t_{k}" ALTER COLUMN "b" DROP NOT NULL;', 'ALTER TABLE "public"."t_{k}" ALTER COLUMN "c" SET DEFAULT {k}0;'.replace("{k}0", "{k}"), 'ALTER TABLE "public"."t_{k}" DROP COLUMN "d" CASCADE;', 'ALTER TABLE "public"."t_{k}" ADD COLUMN "e" text NOT NULL;'])
ORACLE_SQL["render_column_changes"] = ORACLE_SQL["render_column_changes"].replace("SET DEFAULT ' || k || ';' AS statement FROM (SELECT n_nationkey AS k FROM nation)", "SET DEFAULT ' || k || ';' AS statement FROM (SELECT n_nationkey AS k FROM nation) WHERE k <> 1")
render("render_identity", "column", "CREATE TABLE t_{k} (a int NOT NULL, b int GENERATED ALWAYS AS IDENTITY);", "CREATE TABLE t_{k} (a int GENERATED ALWAYS AS IDENTITY, b int GENERATED BY DEFAULT AS IDENTITY);", ['ALTER TABLE "public"."t_{k}" ALTER COLUMN "a" ADD GENERATED ALWAYS AS IDENTITY;', 'ALTER TABLE "public"."t_{k}" ALTER COLUMN "b" SET GENERATED BY DEFAULT;'])
render("render_unique_constraint", "index", "ALTER TABLE t_{k} ADD CONSTRAINT u_{k} UNIQUE (a);", "CREATE UNIQUE INDEX i_{k} ON t_{k} (b);", ['ALTER TABLE "public"."t_{k}" DROP CONSTRAINT "u_{k}";', 'CREATE UNIQUE INDEX "i_{k}" ON "public"."t_{k}" USING btree (b);'], TABLE)
render("render_function", "function", "CREATE FUNCTION f_{k}(int) RETURNS int LANGUAGE sql AS 'SELECT 1';", "", ['DROP FUNCTION "public"."f_{k}"(integer);'])
render("render_view_kinds", "view", "CREATE MATERIALIZED VIEW v_{k} AS SELECT 1 AS a;", "CREATE VIEW v_{k} AS SELECT {k} AS b;", ['DROP MATERIALIZED VIEW "public"."v_{k}";', 'CREATE OR REPLACE VIEW "public"."v_{k}" AS SELECT {k} AS b;'])
render("render_owner", "owner", "", "ALTER TABLE t_{k} OWNER TO o_{k};", ['ALTER TABLE "public"."t_{k}" OWNER TO o_{k};'], TABLE)
render("render_default_privileges", "default_privilege", "ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} GRANT SELECT, INSERT ON TABLES TO app;", "ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} GRANT SELECT ON TABLES TO app WITH GRANT OPTION;", ['ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} REVOKE INSERT ON TABLES FROM app;', 'ALTER DEFAULT PRIVILEGES FOR ROLE r_{k} GRANT SELECT ON TABLES TO app WITH GRANT OPTION;'])
render("render_comment", "comment", "COMMENT ON COLUMN t_{k}.a IS 'x'; COMMENT ON TABLE t_{k} IS 'x';", "COMMENT ON TABLE t_{k} IS 'it''s {k}';", ['COMMENT ON COLUMN "public"."t_{k}"."a" IS NULL;', "COMMENT ON TABLE \"public\".\"t_{k}\" IS 'it''s {k}';"], TABLE)
render("render_grant", "grant", "GRANT SELECT, INSERT ON t_{k} TO app WITH GRANT OPTION;", "GRANT SELECT, UPDATE ON t_{k} TO app;", ['REVOKE INSERT ON TABLE "public"."t_{k}" FROM app;', 'REVOKE GRANT OPTION FOR SELECT ON TABLE "public"."t_{k}" FROM app;', 'GRANT UPDATE ON TABLE "public"."t_{k}" TO app;'], TABLE)
render("render_table", "table", "", "CREATE TABLE t_{k} (a int) PARTITION BY LIST (a); ALTER TABLE t_{k} ENABLE ROW LEVEL SECURITY;", ['CREATE TABLE "public"."t_{k}" () PARTITION BY LIST (a);', 'ALTER TABLE "public"."t_{k}" ENABLE ROW LEVEL SECURITY;'])

# -- rules, checks, filters, round trips --------------------------------------------------------------


def lint(name: str, ddl: str, key: str, rule: str, kind: str) -> None:
    """A rule that the drop of some objects (of even nations) breaks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sparkpact.plans.lint import lint_ops

        keys = keys_of(spark, sf_dir)
        now, then = parse_ddl("\n".join(fill(TABLE + ddl, k) for k in keys)), parse_ddl("\n".join(fill(TABLE + (ddl if k % 2 else ""), k) for k in keys))
        return lint_ops(diff(spark, now, then)).where(F.col("kind") == kind).select("rule", "severity", "key")

    register(name, run, f"SELECT '{rule}' AS rule, 'error' AS severity, {cat(key)} AS key FROM {KEYS} WHERE k % 2 = 0")


lint("lint_drop_enum", "CREATE TYPE e_{k} AS ENUM ('a');", "public.e_{k}", "deny_drop_enum", "enum")
lint("lint_drop_trigger", "CREATE TRIGGER g BEFORE INSERT ON t_{k} FOR EACH ROW EXECUTE FUNCTION f();", "public.t_{k}.g", "deny_drop_trigger", "trigger")
lint("lint_drop_sequence", "CREATE SEQUENCE s_{k};", "public.s_{k}", "deny_drop_sequence", "sequence")
lint("lint_drop_unique_constraint", "ALTER TABLE t_{k} ADD CONSTRAINT u UNIQUE (a); ", "public.t_{k}.u", "deny_drop_unique_constraint", "index")
lint("lint_drop_schema", "CREATE SCHEMA s_{k};", "s_{k}", "deny_drop_schema", "schema")
lint("lint_drop_extension", "CREATE EXTENSION x_{k};", "x_{k}", "deny_drop_extension", "extension")
lint("lint_drop_domain", "CREATE DOMAIN d_{k} AS int;", "public.d_{k}", "deny_drop_domain", "domain")
lint("lint_drop_partition", "CREATE TABLE p_{k} PARTITION OF t_{k} DEFAULT;", "public.p_{k}", "deny_drop_partition", "partition")


def lint_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In production no table is dropped, allowed or not."""
    from sparkpact.plans.lint import lint_ops

    now = parse_ddl("\n".join(fill(TABLE, k) for k in keys_of(spark, sf_dir)))
    found = [lint_ops(diff(spark, now, Catalog()), allow, production).select(F.lit(allow).alias("allowed"), F.lit(production).alias("production"), "rule", "key") for allow in (False, True) for production in (False, True)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


register("lint_production", lint_production, f"SELECT allowed, production, CASE WHEN production THEN 'deny_drop_table_in_prod' ELSE 'deny_drop_table' END AS rule, {cat('public.t_{k}')} AS key FROM {KEYS}, (VALUES (false, false), (false, true), (true, true)) v(allowed, production)")


def check_partition_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpact.plans.checks import check

    text = "\n".join(fill("CREATE TABLE p_{k} PARTITION OF " + ("gone_{k}" if k % 3 else "m") + " DEFAULT;", k) for k in keys_of(spark, sf_dir))
    return check(spark, parse_ddl("CREATE TABLE m (a int) PARTITION BY LIST (a);" + text)).select("rule", "key", "detail")


register("check_partition_parents", check_partition_parents, f"SELECT 'partition_references_missing_parent' AS rule, {cat('public.p_{k}')} AS key, {cat('public.gone_{k}')} AS detail FROM {KEYS} WHERE k % 3 <> 0")


def kept(name: str, run_filter: Callable[[Catalog], Catalog], ddl: str, sql: str, once: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = run_filter(parse_ddl(once + "\n".join(fill(ddl, k) for k in keys_of(spark, sf_dir))))
        return spark.createDataFrame([(o.kind, o.key) for o in left.objects.values()], "kind string, key string")

    register(name, run, sql)


kept("filter_names", lambda c: filters.filtered(c, ["t_1*", "public.t_2*"], ["*_13"]), "CREATE TABLE t_{k} (a int); CREATE VIEW v_{k} AS SELECT 1;", f"SELECT kind, {cat('public.t_{k}')} || suffix AS key FROM {KEYS}, (VALUES ('table', ''), ('column', '.a')) v(kind, suffix) WHERE (k::VARCHAR LIKE '1%' OR k::VARCHAR LIKE '2%') AND k <> 13")
kept("filter_target_schemas", lambda c: filters.filtered(c, target_schemas=["a"]), "CREATE TABLE a.t_{k} (x int); CREATE TABLE b.t_{k} (x int);", f"SELECT kind, {cat('a.t_{k}')} || suffix AS key FROM {KEYS}, (VALUES ('table', ''), ('column', '.x')) v(kind, suffix)")


PARTS = "CREATE TABLE t_{k} (a int, CONSTRAINT c CHECK (a > 0)); CREATE INDEX i_{k} ON t_{k} (a); CREATE VIEW v_{k} AS SELECT 1; CREATE TYPE e_{k} AS ENUM ('a'); CREATE POLICY p ON t_{k} USING (a > 1); COMMENT ON VIEW v_{k} IS 'x'; COMMENT ON TABLE t_{k} IS 'x'; GRANT SELECT ON v_{k} TO app;"
kept("filter_types", lambda c: filters.filtered(c, exclude_types=["views", "policies", "enums"]), PARTS, f"SELECT kind, {cat('public.t_{k}')} || suffix AS key FROM {KEYS}, (VALUES ('table', ''), ('column', '.a'), ('check', '.c')) v(kind, suffix) UNION ALL SELECT 'index', {cat('public.t_{k}.i_{k}')} FROM {KEYS} UNION ALL SELECT 'comment', {cat('table public.t_{k}')} FROM {KEYS}")
kept("filter_comments_follow", lambda c: filters.filtered(c, include=["v_*"]), PARTS, f"SELECT 'view' AS kind, {cat('public.v_{k}')} AS key FROM {KEYS} UNION ALL SELECT 'comment', {cat('view public.v_{k}')} FROM {KEYS} UNION ALL SELECT 'grant', {cat('table public.v_{k} to app')} FROM {KEYS}")
kept("filter_unmanaged_partitions", lambda c: filters.filtered(c, managed_partitions=False), "CREATE TABLE p_{k} PARTITION OF m DEFAULT; CREATE TABLE q_{k} PARTITION OF elsewhere DEFAULT;", f"SELECT 'partition' AS kind, {cat('public.q_{k}')} AS key FROM {KEYS} UNION ALL SELECT 'table', 'public.m' UNION ALL SELECT 'column', 'public.m.a'", "CREATE TABLE m (a int) PARTITION BY LIST (a);")


def plan_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recreated is dropped first; new objects are made before old tables go."""
    keys = keys_of(spark, sf_dir)
    now = parse_ddl("\n".join(fill("CREATE TABLE old_{k} (a int); CREATE TABLE t_{k} (a int, CONSTRAINT c CHECK (a > 1)); CREATE INDEX i_{k} ON t_{k} (a);", k) for k in keys))
    then = parse_ddl("\n".join(fill("CREATE TABLE new_{k} (a int); CREATE TABLE t_{k} (a int, CONSTRAINT c CHECK (a > 2)); CREATE UNIQUE INDEX i_{k} ON t_{k} (a);", k) for k in keys))
    ops = lifecycle.migration(spark, now, then, allow_destructive=True)["ops"]
    at = {(o["op"], o["key"]): n for n, o in enumerate(ops)}
    pairs = [("check", ("drop", "public.t_{k}.c"), ("create", "public.t_{k}.c")), ("index", ("drop", "public.t_{k}.i_{k}"), ("create", "public.t_{k}.i_{k}")), ("table", ("create", "public.new_{k}"), ("drop", "public.old_{k}"))]
    return spark.createDataFrame([(k, what, at[a, fill(x, k)] < at[b, fill(y, k)]) for k in keys for what, (a, x), (b, y) in pairs], "k int, what string, in_order boolean")


register("plan_modification", plan_modification, f"SELECT k, what, true AS in_order FROM {KEYS}, (VALUES ('check'), ('index'), ('table')) v(what)")


def operation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations have keys of their own, whatever their kinds share: names, tables, signatures."""
    from sparkpact.plans.planner import op_key

    text = "CREATE TABLE t_{k} (t_{k} int, CONSTRAINT x_{k} CHECK (t_{k} > 0)); CREATE INDEX x_{k} ON t_{k} (t_{k}); CREATE FUNCTION t_{k}(int) RETURNS int LANGUAGE sql AS 'SELECT 1'; CREATE FUNCTION t_{k}(text) RETURNS int LANGUAGE sql AS 'SELECT 1'; CREATE SEQUENCE s.t_{k}; CREATE TYPE e.t_{k} AS ENUM ('a');"
    ops = lifecycle.creations(parse_ddl("\n".join(fill(text, k) for k in keys_of(spark, sf_dir))))
    return spark.createDataFrame([(op_key(o),) for o in ops], "key string")


register("operation_keys", operation_keys, "\nUNION ALL ".join(f"SELECT {cat('create ' + key)} AS key FROM {KEYS}" for key in ("table public.t_{k}", "column public.t_{k}.t_{k}", "check public.t_{k}.x_{k}", "index public.t_{k}.x_{k}", "function public.t_{k}(integer)", "function public.t_{k}(text)", "sequence s.t_{k}", "enum e.t_{k}")))


def references_of_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and relations that bodies name, without built-ins, common tables and strings."""
    from sparkpact.plans.references import function_references, relation_references, rowtype_references

    body = "WITH c AS (SELECT lower(x) FROM t_{k}) SELECT f_{k}(a), count(*), s.g_{k}('h_{k}()') FROM c JOIN s.u_{k} ON true, lateral_{k} WHERE EXISTS (SELECT 1 FROM \"w_{k}\")"
    rows = []
    for k in keys_of(spark, sf_dir):
        rows += [("function", n) for n in function_references(fill(body, k))] + [("relation", n) for n in relation_references(fill(body, k))] + [("rowtype", n) for n in rowtype_references(fill("DECLARE x t_{k}%ROWTYPE; y s.u_{k} %rowtype;", k))]
    return spark.createDataFrame(rows, "what string, name string")


register("references_of_bodies", references_of_bodies, "\nUNION ALL ".join(f"SELECT '{what}' AS what, {cat(name)} AS name FROM {KEYS}" for what, name in (("function", "public.f_{k}"), ("function", "s.g_{k}"), ("relation", "public.t_{k}"), ("relation", "s.u_{k}"), ("relation", "public.lateral_{k}"), ("relation", "public.w_{k}"), ("rowtype", "public.t_{k}"), ("rowtype", "s.u_{k}"))))


def procedural_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkpact.plans.references import is_procedural

    bodies = ["BEGIN RETURN {k}; END", " DECLARE x int; BEGIN END", "<<outer>> begin end", "SELECT {k}", "RETURN begin_{k}", "WITH declare AS (SELECT 1) SELECT 1"]
    return spark.createDataFrame([(k, n, is_procedural(fill(b, k))) for k in keys_of(spark, sf_dir) for n, b in enumerate(bodies)], "k int, body int, procedural boolean")


register("procedural_bodies", procedural_bodies, f"SELECT k, body::INTEGER AS body, body < 3 AS procedural FROM {KEYS}, range(6) r(body)")


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the nations that are no multiple of three, and whether fingerprints tell."""
    keys = keys_of(spark, sf_dir)
    make = lambda wide: parse_ddl("\n".join(fill("CREATE TABLE t_{k} (a " + ("bigint" if wide(k) else "int") + ");", k) for k in keys))
    report, none = lifecycle.drift(spark, make(lambda k: False), make(lambda k: k % 3)), lifecycle.drift(spark, make(lambda k: True), make(lambda k: True))
    rows = [(d, report["has_drift"], report["expected_fingerprint"] == report["actual_fingerprint"]) for d in report["differences"]] + [("none", none["has_drift"], none["expected_fingerprint"] == none["actual_fingerprint"])]
    return spark.createDataFrame(rows, "difference string, has_drift boolean, same_fingerprint boolean")


register("drift_report", drift_report, f"SELECT {cat('alter column public.t_{k}.a')} AS difference, true AS has_drift, false AS same_fingerprint FROM {KEYS} WHERE k % 3 <> 0 UNION ALL SELECT 'none', false, true")


def baseline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that is read back is the schema that was dumped: counts by kind, and no difference."""
    found = lifecycle.baseline(spark, app(keys_of(spark, sf_dir)))
    return spark.createDataFrame([(kind, n, len(found["differences"]), found["fingerprints_equal"]) for kind, n in found["counts"].items()], "kind string, n long, differences int, same boolean")


register("baseline_round_trip", baseline_round_trip, f"SELECT kind, n * (SELECT count(*) FROM nation) AS n, 0::INTEGER AS differences, true AS same FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {2 if k == 'column' else 1})' for k in MADE)}) v(kind, n)")


def verify_after_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after all operations but those on even nations were applied."""
    from sparkpact.operators.diff import apply_ops

    keys = keys_of(spark, sf_dir)
    now, then = parse_ddl("\n".join(fill(TABLE, k) for k in keys)), parse_ddl("\n".join(fill("CREATE TABLE t_{k} (a int, b int, c int);", k) for k in keys))
    ops = lifecycle.migration(spark, now, then)["ops"]
    as_text = [{**o, "new": then.get(o["kind"], o["key"]).text_attrs()} for o in ops if int(o["parent"].split("_")[1]) % 2]
    return spark.createDataFrame([(d,) for d in lifecycle.verify(spark, apply_ops(now, as_text), then)], "left_to_do string")


register("verify_after_apply", verify_after_apply, f"SELECT {cat('create column public.t_{k}.c')} AS left_to_do FROM {KEYS} WHERE k % 2 = 0")


def validate_on_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a migration would run into on the data, operation by operation."""
    from sparkpact.operators.apply import validate

    ddl = """CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL, o_orderstatus text, o_totalprice double precision, o_orderdate timestamp, o_orderpriority text,
      CONSTRAINT cheap CHECK (o_totalprice < 100000), CONSTRAINT known CHECK (o_orderstatus = ANY (ARRAY['F', 'O', 'P'])), CONSTRAINT once UNIQUE (o_custkey));"""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    errors = validate(spark, {"public.orders": orders}, [o for o in lifecycle.creations(parse_ddl(ddl)) if o["kind"] in ("primary_key", "check", "index")])
    return spark.createDataFrame([(e,) for e in errors], "error string")


register("validate_on_data", validate_on_data, "SELECT 'check public.orders.cheap: ' || count(*) || ' violations' AS error FROM orders WHERE NOT o_totalprice < 100000 HAVING count(*) > 0 UNION ALL SELECT 'unique index public.orders.once: ' || count(*) || ' violations' FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")

# -- sources -------------------------------------------------------------------------------------------


def load_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder, a glob and a file that overlap, loaded once each, in whatever order objects need."""
    import tempfile
    from pathlib import Path

    from sparkpact.sources.loader import load

    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        for k in keys_of(spark, sf_dir):
            at = Path(folder) / ("even" if k % 2 == 0 else "odd")
            at.mkdir(exist_ok=True)
            (at / f"n_{k}.sql").write_text(fill("CREATE VIEW v_{k} AS SELECT a FROM t_{k}; COMMENT ON TABLE t_{k} IS 'x'; CREATE TABLE t_{k} (a int);", k))
        catalog = load([f"sql:{folder}/even", f"sql:{folder}/odd/*.sql", f"sql:{folder}/odd/n_1.sql"])
    return spark.createDataFrame([(o.kind, o.key) for o in catalog.objects.values()], "kind string, key string")


register("load_files", load_files, f"SELECT 'table' AS kind, {cat('public.t_{k}')} AS key FROM {KEYS} UNION ALL SELECT 'column', {cat('public.t_{k}.a')} FROM {KEYS} UNION ALL SELECT 'view', {cat('public.v_{k}')} FROM {KEYS} UNION ALL SELECT 'comment', {cat('table public.t_{k}')} FROM {KEYS}")


def load_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that define the same table: the error names the object and both."""
    rows = []
    for k in keys_of(spark, sf_dir):
        parts = [("a.sql", parse_ddl(f"CREATE TABLE t_{k} (a int);")), ("b.sql", parse_ddl(f"CREATE TABLE t_{k if k % 3 == 0 else 'other'} (a int);"))]
        try:
            rows.append((k, f"{len(Catalog.merged(parts).objects)} objects"))
        except DuplicateObject as e:
            rows.append((k, str(e)))
    return spark.createDataFrame(rows, "k int, said string")


register("load_duplicates", load_duplicates, f"SELECT k, CASE WHEN k % 3 = 0 THEN {cat('table public.t_{k} is defined in a.sql and in b.sql')} ELSE '4 objects' END AS said FROM {KEYS}")
