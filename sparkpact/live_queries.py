"""Queries of the scans over a small live schema, and the SQL that DuckDB runs over the same relations.

The system relations stand here as rows; both sides get them from RELATIONS, the SQL as VALUES.
Attributes are compared as one text: name=value in order of names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.sources.catalog import local_relation
from sparkpact.sources.introspect import introspect, to_catalog, unsupported_objects

#: Relations of a live schema: columns with their types, and rows.
RELATIONS: dict[str, tuple[str, list[tuple]]] = {
    "namespaces": ("oid long, nspname string, acl array<string>, owner string", [(1, "public", ["o=UC/o", "app=U/o", "=U/o"], "o"), (2, "pg_catalog", None, "o"), (3, "audit", None, "boss")]),
    "classes": (
        "oid long, relname string, relnamespace long, relkind string, relrowsecurity boolean, relforcerowsecurity boolean, relispartition boolean, bound string, partkey string, viewdef string, acl array<string>, owner string",
        [
            (10, "users", 1, "r", True, False, False, None, None, None, ["o=arwdDxt/o", "app=r*a/o", "=r/o"], "o"), (11, "posts", 1, "r", False, True, False, None, None, None, None, "o"), (12, "v", 1, "v", False, False, False, None, None, " SELECT users.id FROM users;", ["ro=r/o"], "o"),
            (13, "users_mail_key", 1, "i", False, False, False, None, None, None, None, "o"), (14, "ext_table", 1, "r", False, False, False, None, None, None, None, "o"), (15, "s", 1, "S", False, False, False, None, None, None, ["app=rU/o"], "o"), (16, "pair", 1, "c", False, False, False, None, None, None, None, "o"),
            (17, "events", 1, "p", False, False, False, None, "RANGE (at)", None, None, "o"), (18, "events_2024", 1, "r", False, False, True, "FOR VALUES FROM ('2024-01-01') TO ('2025-01-01')", None, None, None, "o"), (19, "events_rest", 1, "r", False, False, True, "DEFAULT", None, None, None, "o"),
            (20, "bookings", 1, "r", False, False, False, None, None, None, None, "boss"), (21, "bookings_excl", 1, "i", False, False, False, None, None, None, None, "boss"), (22, "totals", 1, "m", False, False, False, None, None, " SELECT count(*) AS n FROM posts;", None, "o"),
            (23, "remote", 1, "f", False, False, False, None, None, None, None, "o"), (24, "log", 3, "r", False, False, False, None, None, None, None, "boss"), (25, "users_low_idx", 1, "i", False, False, False, None, None, None, None, "o"), (26, "child", 1, "r", False, False, False, None, None, None, None, "o"), (90, "pg_x", 2, "r", False, False, False, None, None, None, None, "o"),
        ],
    ),
    "attributes": (
        "attrelid long, attname string, attnum int, attnotnull boolean, attgenerated string, attidentity string, type string, expr string",
        [
            (10, "id", 1, True, "", "", "bigint", None), (10, "mail", 2, False, "", "", "character varying(40)", "'x'::text"), (10, "low", 3, False, "s", "", "text", "lower(mail)"), (11, "user_id", 1, True, "", "", "bigint", None), (11, "n", 2, True, "", "a", "integer", None),
            (17, "at", 1, True, "", "", "timestamp without time zone", None), (17, "kind", 2, False, "", "", "text", None), (20, "room", 1, True, "", "", "integer", None), (20, "during", 2, True, "", "", "tsrange", None), (24, "line", 1, False, "", "", "text", None), (26, "x", 1, False, "", "", "integer", None),
        ],
    ),
    "indexes": (
        "indexrelid long, indrelid long, indisunique boolean, indisprimary boolean, amname string, predicate string, columns array<string>",
        [(13, 10, True, False, "btree", None, ["mail"]), (21, 20, False, False, "gist", None, ["room", "during"]), (25, 10, False, False, "btree", "(id > 5)", ["lower(mail)", "id"])],
    ),
    "constraints": (
        "oid long, conname string, conrelid long, contypid long, contype string, conkey array<int>, confrelid long, confkey array<int>, confupdtype string, confdeltype string, conindid long, expr string, condeferrable boolean, condeferred boolean, definition string",
        [
            (40, "users_pkey", 10, 0, "p", [1], 0, None, "a", "a", 0, None, False, False, None), (41, "users_mail_key", 10, 0, "u", [2], 0, None, "a", "a", 13, None, False, False, None), (42, "posts_user_id_fkey", 11, 0, "f", [1], 10, [1], "a", "c", 0, None, True, False, None),
            (43, "pos", 10, 0, "c", [1], 0, None, "a", "a", 0, "(id > 0)", False, False, None), (44, "mail_check", 0, 31, "c", None, 0, None, "a", "a", 0, "(VALUE ~ '@'::text)", False, False, None), (45, "posts_pkey", 11, 0, "p", [2, 1], 0, None, "a", "a", 0, None, False, False, None),
            (46, "bookings_excl", 20, 0, "x", [1, 2], 0, None, "a", "a", 21, None, False, False, "EXCLUDE USING gist (room WITH =, during WITH &&)"),
        ],
    ),
    "types": ("oid long, typname string, typnamespace long, typtype string, basetype string, typnotnull boolean, typdefault string, acl array<string>, owner string", [(30, "state", 1, "e", None, False, None, ["=U/o", "app=U/o"], "o"), (31, "email", 1, "d", "text", True, None, None, "o"), (32, "amount", 1, "d", "numeric(15,2)", False, "0", None, "boss")]),
    "enum_labels": ("enumtypid long, enumsortorder double, enumlabel string", [(30, 2.0, "done"), (30, 1.0, "open"), (30, 1.5, "busy")]),
    "inherits": ("inhrelid long, inhparent long", [(18, 17), (19, 17), (26, 11)]),
    "policies": ("oid long, polname string, polrelid long, polcmd string, roles array<string>, using_expr string, check_expr string", [(50, "own", 10, "r", [], "(id = 1)", None), (51, "write", 10, "w", ["b", "a"], "(id > 1)", "(id > 2)")]),
    "triggers": (
        "oid long, tgname string, tgrelid long, tgtype int, tgenabled string, function string, columns array<int>, args array<string>, when_expr string, old_table string, new_table string, is_constraint boolean, tgdeferrable boolean, tginitdeferred boolean",
        [(55, "t", 10, 1 | 2 | 16, "O", "public.touch", [2, 1], ["it's"], "old.mail IS DISTINCT FROM new.mail", None, None, False, False, False), (56, "log", 11, 4 | 8, "D", "public.touch", [], None, None, "gone", "came", False, False, False), (57, "later", 11, 1 | 4, "A", "public.touch", None, None, None, None, None, True, True, True)],
    ),
    "procedures": (
        "oid long, proname string, pronamespace long, prokind string, types string, arguments string, result string, lanname string, prosrc string, provolatile string, prosecdef boolean, config array<string>, proparallel string, acl array<string>, owner string",
        [
            (60, "touch", 1, "f", "", "", "trigger", "plpgsql", "BEGIN RETURN NEW; END", "v", False, None, "u", None, "o"), (61, "add", 1, "f", "integer, text", "a integer, b text DEFAULT 'x'::text", "integer", "sql", "SELECT a", "i", True, ["search_path=public"], "s", ["=X/o", "app=X*/o"], "boss"),
            (62, "join_text", 1, "a", "text", "text", "text", "internal", "aggregate_dummy", "i", False, None, "s", None, "o"), (63, "tidy", 1, "p", "", "", None, "sql", "SELECT 1", "v", False, None, "u", None, "o"),
        ],
    ),
    "aggregates": ("oid long, sfunc string, stype string, finalfunc string, initcond string", [(62, "public.glue", "text", None, "")]),
    "sequences": ("seqrelid long, type string, seqstart long, seqincrement long, seqmin long, seqmax long, seqcycle boolean, seqcache long", [(15, "bigint", 1, 1, 1, 9223372036854775807, False, 1)]),
    "sequence_owners": ("seqrelid long, relid long, attnum int", [(15, 10, 1)]),
    "extensions": ("oid long, extname string, extversion string, nspname string", [(70, "pgcrypto", "1.3", "public")]),
    "servers": ("oid long, srvname string, srvtype string, srvversion string, fdwname string, options array<string>, owner string", [(75, "far", None, "9", "postgres_fdw", ["host=db", "dbname=a=b"], "o")]),
    "default_acls": ("role string, nspname string, objtype string, acl array<string>", [("boss", "public", "r", ["app=rw*/boss", "boss=arwd/boss"]), ("boss", None, "f", ["=X/boss", "ro=X/boss"]), ("boss", "pg_catalog", "r", ["x=r/boss"])]),
    "rules": ("rulename string, ev_class long", [("protect", 10)]),
    "owned_by_extensions": ("objid long", [(14,)]),
    "comments": (
        "objoid long, catalog string, objsubid int, description string",
        [(10, "pg_class", 0, "people"), (10, "pg_class", 2, "address"), (12, "pg_class", 0, "ids"), (43, "pg_constraint", 0, "positive"), (44, "pg_constraint", 0, "has an at"), (60, "pg_proc", 0, "touches"), (62, "pg_proc", 0, "joins"), (31, "pg_type", 0, "mail"), (30, "pg_type", 0, "states"), (1, "pg_namespace", 0, "standard"), (55, "pg_trigger", 0, "on change"), (50, "pg_policy", 0, "own rows"), (70, "pg_extension", 0, "crypto"), (75, "pg_foreign_server", 0, "other"), (14, "pg_class", 0, "not ours"), (15, "pg_class", 0, "numbers")],
    ),
}
SCHEMAS = ["public", "audit"]

#: The same schema as a declaration.
DECLARED = """
CREATE SCHEMA public; CREATE SCHEMA audit;
CREATE EXTENSION pgcrypto WITH SCHEMA public VERSION '1.3';
CREATE SERVER far VERSION '9' FOREIGN DATA WRAPPER postgres_fdw OPTIONS (host 'db', dbname 'a=b');
CREATE TYPE state AS ENUM ('open', 'busy', 'done');
CREATE DOMAIN email AS text NOT NULL CONSTRAINT mail_check CHECK (VALUE ~ '@');
CREATE DOMAIN amount AS numeric(15,2) DEFAULT 0;
CREATE TABLE users (id bigint PRIMARY KEY, mail varchar(40) DEFAULT 'x' UNIQUE, low text GENERATED ALWAYS AS (lower(mail)) STORED, CONSTRAINT pos CHECK (id > 0));
CREATE INDEX users_low_idx ON users (lower(mail), id) WHERE id > 5;
CREATE TABLE posts (user_id bigint NOT NULL REFERENCES users (id) ON DELETE CASCADE DEFERRABLE, n integer GENERATED ALWAYS AS IDENTITY, PRIMARY KEY (n, user_id));
ALTER TABLE posts FORCE ROW LEVEL SECURITY;
CREATE TABLE child (x integer);
CREATE TABLE events (at timestamp NOT NULL, kind text) PARTITION BY RANGE (at);
CREATE TABLE events_2024 PARTITION OF events FOR VALUES FROM ('2024-01-01') TO ('2025-01-01');
CREATE TABLE events_rest PARTITION OF events DEFAULT;
CREATE TABLE bookings (room integer NOT NULL, during tsrange NOT NULL, CONSTRAINT bookings_excl EXCLUDE USING gist (room WITH =, during WITH &&));
CREATE TABLE audit.log (line text);
CREATE VIEW v AS SELECT users.id FROM users;
CREATE MATERIALIZED VIEW totals AS SELECT count(*) AS n FROM posts;
CREATE SEQUENCE s OWNED BY users.id;
CREATE FUNCTION touch() RETURNS trigger LANGUAGE plpgsql AS $$BEGIN RETURN NEW; END$$;
CREATE FUNCTION add(a integer, b text DEFAULT 'x') RETURNS integer LANGUAGE sql IMMUTABLE SECURITY DEFINER SET search_path = public AS $$SELECT a$$;
CREATE AGGREGATE join_text(text) (SFUNC = glue, STYPE = text, INITCOND = '', PARALLEL = safe);
CREATE TRIGGER t BEFORE UPDATE OF mail, id ON users FOR EACH ROW WHEN (OLD.mail IS DISTINCT FROM NEW.mail) EXECUTE FUNCTION touch('it''s');
CREATE TRIGGER log AFTER INSERT OR DELETE ON posts REFERENCING OLD TABLE AS gone NEW TABLE AS came FOR EACH STATEMENT EXECUTE FUNCTION touch();
ALTER TABLE posts DISABLE TRIGGER log;
CREATE CONSTRAINT TRIGGER later AFTER INSERT ON posts DEFERRABLE INITIALLY DEFERRED FOR EACH ROW EXECUTE FUNCTION touch();
ALTER TABLE posts ENABLE ALWAYS TRIGGER later;
CREATE POLICY own ON users FOR SELECT USING (id = 1);
CREATE POLICY write ON users FOR UPDATE TO a, b USING (id > 1) WITH CHECK (id > 2);
GRANT SELECT, INSERT ON users TO app; GRANT SELECT ON users TO app WITH GRANT OPTION; GRANT SELECT ON users TO public;
GRANT SELECT ON v TO ro; GRANT SELECT, USAGE ON SEQUENCE s TO app; GRANT USAGE ON SCHEMA public TO app, public;
GRANT USAGE ON TYPE state TO app; GRANT EXECUTE ON FUNCTION add(integer, text) TO app WITH GRANT OPTION;
ALTER DEFAULT PRIVILEGES FOR ROLE boss IN SCHEMA public GRANT SELECT, UPDATE ON TABLES TO app;
ALTER DEFAULT PRIVILEGES FOR ROLE boss IN SCHEMA public GRANT UPDATE ON TABLES TO app WITH GRANT OPTION;
ALTER DEFAULT PRIVILEGES FOR ROLE boss GRANT EXECUTE ON FUNCTIONS TO ro;
COMMENT ON TABLE users IS 'people'; COMMENT ON COLUMN users.mail IS 'address'; COMMENT ON VIEW v IS 'ids'; COMMENT ON SEQUENCE s IS 'numbers';
COMMENT ON CONSTRAINT pos ON users IS 'positive'; COMMENT ON CONSTRAINT mail_check ON DOMAIN email IS 'has an at';
COMMENT ON FUNCTION touch() IS 'touches'; COMMENT ON AGGREGATE join_text(text) IS 'joins'; COMMENT ON DOMAIN email IS 'mail'; COMMENT ON TYPE state IS 'states';
COMMENT ON SCHEMA public IS 'standard'; COMMENT ON TRIGGER t ON users IS 'on change'; COMMENT ON POLICY own ON users IS 'own rows'; COMMENT ON EXTENSION pgcrypto IS 'crypto'; COMMENT ON SERVER far IS 'other';
"""


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: local_relation(spark, rows, schema) for name, (schema, rows) in RELATIONS.items()}


def literal(value: object, kind: str) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        inner = kind.removeprefix("array<").removesuffix(">")
        return "[" + ", ".join(literal(x, inner) for x in value) + "]::" + {"string": "VARCHAR[]", "int": "INTEGER[]"}[inner]
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(*names: str) -> str:
    """The relations as common table expressions, with rel, typ and fun cut to the managed schemas."""
    out = []
    for name in names:
        schema, rows = RELATIONS[name]
        columns = [c.split() for c in schema.split(", ")]
        out.append(f"{name}({', '.join(c for c, _ in columns)}) AS (VALUES " + ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows) + ")")
    managed = "JOIN (SELECT oid AS space, nspname AS schema FROM namespaces WHERE nspname IN ('public', 'audit')) m ON m.space = x.{} WHERE x.oid NOT IN (SELECT objid FROM owned_by_extensions)"
    for name, source, column in (("rel", "classes", "relnamespace"), ("typ", "types", "typnamespace"), ("fun", "procedures", "pronamespace")):
        if source in names:
            out.append(f"{name} AS (SELECT x.*, m.schema FROM {source} x " + managed.format(column) + ")")
    return "WITH " + ",\n".join(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def scan(name: str, scans: str, relations: str, sql: str) -> None:
    """A query of some scans. sql gives kind, key and attrs over the relations' common tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = introspect(spark, frames(spark), SCHEMAS, only=scans.split())
        text = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
        return found.select("kind", "key", text.alias("attrs"))

    QUERIES[name] = run
    ORACLE_SQL[name] = values("namespaces", "owned_by_extensions", *relations.split()) + "\n" + sql


scan("introspect_namespaces", "schemas", "", "SELECT 'schema' AS kind, nspname AS key, '' AS attrs FROM namespaces WHERE nspname IN ('public', 'audit')")
scan("introspect_extensions", "extensions", "extensions", "SELECT 'extension' AS kind, extname AS key, concat('schema=', nspname, '; version=', extversion) AS attrs FROM extensions")
scan("introspect_servers", "servers", "servers", """SELECT 'server' AS kind, srvname AS key, concat_ws('; ', 'fdw=' || fdwname, 'options=' || '{' || (SELECT string_agg('"' || split_part(o, '=', 1) || '":"' || substr(o, strpos(o, '=') + 1) || '"', ',') FROM unnest(options) u(o)) || '}', 'type=' || srvtype, 'version=' || srvversion) AS attrs FROM servers""")
scan("introspect_enums", "enums", "types enum_labels", "SELECT 'enum' AS kind, schema || '.' || typname AS key, 'values=' || to_json(list(enumlabel ORDER BY enumsortorder))::VARCHAR AS attrs FROM typ JOIN enum_labels ON enumtypid = oid GROUP BY schema, typname")
scan(
    "introspect_domains", "domains", "types constraints",
    """SELECT 'domain' AS kind, t.schema || '.' || t.typname AS key, concat_ws('; ', 'checks=' || coalesce(to_json(list(struct_pack(name := c.conname, expression := c.expr) ORDER BY c.conname) FILTER (c.oid IS NOT NULL))::VARCHAR, '[]'), 'data_type=' || basetype, 'default=' || typdefault, 'not_null=' || typnotnull::VARCHAR) AS attrs
    FROM typ t LEFT JOIN constraints c ON c.contypid = t.oid AND c.contype = 'c' WHERE typtype = 'd' GROUP BY t.schema, t.typname, basetype, typdefault, typnotnull""",
)
scan("introspect_tables", "tables", "classes", "SELECT 'table' AS kind, schema || '.' || relname AS key, concat_ws('; ', 'force_rls=' || relforcerowsecurity::VARCHAR, 'partkey=' || partkey, 'rls=' || relrowsecurity::VARCHAR) AS attrs FROM rel WHERE relkind IN ('r', 'p') AND NOT relispartition")
scan("introspect_partitions", "partitions", "classes inherits", "SELECT 'partition' AS kind, c.schema || '.' || c.relname AS key, concat('bound=', c.bound, '; parent=', p.schema, '.', p.relname) AS attrs FROM rel c JOIN inherits ON inhrelid = c.oid JOIN rel p ON p.oid = inhparent WHERE c.relispartition")
scan(
    "introspect_columns", "columns", "classes attributes",
    """SELECT 'column' AS kind, schema || '.' || relname || '.' || attname AS key, concat_ws('; ', 'data_type=' || type, CASE WHEN attgenerated = '' THEN 'default=' || expr END, CASE WHEN attgenerated = 's' THEN 'generated=' || expr END, 'identity=' || CASE attidentity WHEN 'a' THEN 'always' WHEN 'd' THEN 'by default' END, 'nullable=' || (NOT attnotnull)::VARCHAR) AS attrs
    FROM attributes JOIN rel ON oid = attrelid WHERE relkind IN ('r', 'p') AND NOT relispartition""",
)
scan("introspect_primary_keys", "primary_keys", "classes attributes constraints", "SELECT 'primary_key' AS kind, schema || '.' || relname || '.primary_key' AS key, concat('columns=', to_json(list(attname ORDER BY pos))::VARCHAR, '; constraint=', conname) AS attrs FROM (SELECT conrelid, conname, unnest(conkey) AS num, generate_subscripts(conkey, 1) AS pos FROM constraints WHERE contype = 'p') c JOIN rel ON oid = conrelid JOIN attributes ON attrelid = conrelid AND attnum = num GROUP BY schema, relname, conname")
scan(
    "introspect_indexes", "indexes", "classes indexes constraints",
    """SELECT 'index' AS kind, t.schema || '.' || t.relname || '.' || n.relname AS key, concat_ws('; ', 'columns=' || to_json(i.columns)::VARCHAR, 'is_constraint=' || EXISTS (SELECT 1 FROM constraints c WHERE c.conindid = i.indexrelid AND contype = 'u')::VARCHAR, 'method=' || amname, 'predicate=' || predicate, 'unique=' || indisunique::VARCHAR) AS attrs
    FROM indexes i JOIN rel t ON t.oid = indrelid JOIN rel n ON n.oid = indexrelid WHERE NOT indisprimary AND NOT EXISTS (SELECT 1 FROM constraints c WHERE c.conindid = i.indexrelid AND contype = 'x')""",
)
ACTION = "CASE {} WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' ELSE 'SET DEFAULT' END"
scan(
    "introspect_foreign_keys", "foreign_keys", "classes attributes constraints",
    f"""SELECT 'foreign_key' AS kind, r.schema || '.' || r.relname || '.' || conname AS key, concat('columns=', to_json(list(a.attname ORDER BY pos))::VARCHAR, '; deferrable=', condeferrable::VARCHAR, '; initially_deferred=', condeferred::VARCHAR, '; on_delete=', {ACTION.format('confdeltype')}, '; on_update=', {ACTION.format('confupdtype')}, '; ref_columns=', to_json(list(b.attname ORDER BY pos))::VARCHAR, '; ref_table=', f.schema, '.', f.relname) AS attrs
    FROM (SELECT *, unnest(conkey) AS num, unnest(confkey) AS ref_num, generate_subscripts(conkey, 1) AS pos FROM constraints WHERE contype = 'f') c JOIN rel r ON r.oid = conrelid JOIN rel f ON f.oid = confrelid JOIN attributes a ON a.attrelid = conrelid AND a.attnum = num JOIN attributes b ON b.attrelid = confrelid AND b.attnum = ref_num
    GROUP BY r.schema, r.relname, conname, condeferrable, condeferred, confdeltype, confupdtype, f.schema, f.relname""",
)
scan("introspect_checks", "checks", "classes constraints", "SELECT 'check' AS kind, schema || '.' || relname || '.' || conname AS key, 'expression=' || expr AS attrs FROM constraints c JOIN rel r ON r.oid = conrelid WHERE contype = 'c'")
scan("introspect_exclusions", "exclusions", "classes constraints", "SELECT 'exclusion' AS kind, schema || '.' || relname || '.' || conname AS key, 'definition=' || definition AS attrs FROM constraints c JOIN rel r ON r.oid = conrelid WHERE contype = 'x'")
scan("introspect_views", "views", "classes", "SELECT 'view' AS kind, schema || '.' || relname AS key, concat('materialized=', (relkind = 'm')::VARCHAR, '; query=', rtrim(viewdef, ';')) AS attrs FROM rel WHERE relkind IN ('v', 'm')")
scan(
    "introspect_policies", "policies", "classes policies",
    """SELECT 'policy' AS kind, schema || '.' || relname || '.' || polname AS key, concat_ws('; ', 'check=' || check_expr, 'command=' || CASE polcmd WHEN '*' THEN 'ALL' WHEN 'r' THEN 'SELECT' WHEN 'a' THEN 'INSERT' WHEN 'w' THEN 'UPDATE' ELSE 'DELETE' END, 'roles=' || CASE WHEN len(roles) = 0 THEN '["public"]' ELSE to_json(list_sort(roles))::VARCHAR END, 'using=' || using_expr) AS attrs
    FROM policies JOIN rel r ON r.oid = polrelid""",
)
scan(
    "introspect_triggers", "triggers", "classes attributes triggers",
    """SELECT 'trigger' AS kind, schema || '.' || relname || '.' || tgname AS key, concat_ws('; ', 'args=' || coalesce(to_json(list_transform(args, lambda x: '''' || replace(x, '''', '''''') || ''''))::VARCHAR, '[]'), 'constraint=' || is_constraint::VARCHAR, 'deferrable=' || tgdeferrable::VARCHAR,
      'enabled=' || CASE tgenabled WHEN 'O' THEN 'ORIGIN' WHEN 'D' THEN 'DISABLED' WHEN 'R' THEN 'REPLICA' ELSE 'ALWAYS' END, 'events=' || to_json(list_sort(list_filter([CASE WHEN tgtype & 4 > 0 THEN 'INSERT' END, CASE WHEN tgtype & 8 > 0 THEN 'DELETE' END, CASE WHEN tgtype & 16 > 0 THEN 'UPDATE' END, CASE WHEN tgtype & 32 > 0 THEN 'TRUNCATE' END], lambda e: e IS NOT NULL)))::VARCHAR,
      'for_each_row=' || (tgtype & 1 > 0)::VARCHAR, 'function=' || function, 'initially_deferred=' || tginitdeferred::VARCHAR, 'new_table=' || new_table, 'old_table=' || old_table, 'timing=' || CASE WHEN tgtype & 64 > 0 THEN 'INSTEAD OF' WHEN tgtype & 2 > 0 THEN 'BEFORE' ELSE 'AFTER' END,
      'update_columns=' || coalesce((SELECT to_json(list(a.attname ORDER BY list_position(t.columns, a.attnum)))::VARCHAR FROM attributes a WHERE a.attrelid = t.tgrelid AND list_contains(t.columns, a.attnum)), '[]'), 'when=' || when_expr) AS attrs
    FROM triggers t JOIN rel r ON r.oid = tgrelid""",
)
scan(
    "introspect_functions", "functions", "procedures",
    """SELECT 'function' AS kind, schema || '.' || proname || '(' || types || ')' AS key, concat_ws('; ', 'arguments=' || arguments, 'body=' || prosrc, 'config=' || coalesce(to_json(list_transform(config, lambda c: [split_part(c, '=', 1), substr(c, strpos(c, '=') + 1)]))::VARCHAR, '[]'), 'language=' || lanname, 'return_type=' || result, 'security=' || CASE WHEN prosecdef THEN 'DEFINER' ELSE 'INVOKER' END, 'volatility=' || CASE provolatile WHEN 'i' THEN 'IMMUTABLE' WHEN 's' THEN 'STABLE' ELSE 'VOLATILE' END) AS attrs
    FROM fun WHERE prokind = 'f'""",
)
scan("introspect_aggregates", "aggregates", "procedures aggregates", "SELECT 'aggregate' AS kind, schema || '.' || proname || '(' || types || ')' AS key, concat_ws('; ', 'finalfunc=' || finalfunc, 'initcond=' || initcond, 'parallel=' || CASE proparallel WHEN 'u' THEN 'UNSAFE' WHEN 'r' THEN 'RESTRICTED' ELSE 'SAFE' END, 'sfunc=' || sfunc, 'stype=' || stype) AS attrs FROM fun p JOIN aggregates a ON a.oid = p.oid")
scan(
    "introspect_sequences", "sequences", "classes attributes sequences sequence_owners",
    """SELECT 'sequence' AS kind, r.schema || '.' || r.relname AS key, concat_ws('; ', 'cache=' || seqcache::VARCHAR, 'cycle=' || seqcycle::VARCHAR, 'data_type=' || s.type, 'increment=' || seqincrement::VARCHAR, 'max=' || seqmax::VARCHAR, 'min=' || seqmin::VARCHAR, 'owned_by=' || t.schema || '.' || t.relname || '.' || a.attname, 'start=' || seqstart::VARCHAR) AS attrs
    FROM sequences s JOIN rel r ON r.oid = s.seqrelid LEFT JOIN sequence_owners o ON o.seqrelid = s.seqrelid LEFT JOIN rel t ON t.oid = o.relid LEFT JOIN attributes a ON a.attrelid = o.relid AND a.attnum = o.attnum""",
)
LETTER = "CASE substr(p, 1, 1) WHEN 'r' THEN 'SELECT' WHEN 'a' THEN 'INSERT' WHEN 'w' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' WHEN 'D' THEN 'TRUNCATE' WHEN 'x' THEN 'REFERENCES' WHEN 't' THEN 'TRIGGER' WHEN 'U' THEN 'USAGE' WHEN 'C' THEN 'CREATE' WHEN 'X' THEN 'EXECUTE' END"


def access(family: str, rows: str) -> str:
    """Grants of rows (subject, acl, owner, implied), in SQL."""
    return f"""SELECT 'grant' AS kind, '{family} ' || subject || ' to ' || grantee AS key, concat('grantable=', to_json(list_sort(list(DISTINCT privilege) FILTER (option)))::VARCHAR, '; grantee=', grantee, '; on={family} ', subject, '; privileges=', to_json(list_sort(list(DISTINCT privilege)))::VARCHAR) AS attrs
    FROM (SELECT subject, owner, implied, grantee, {LETTER} AS privilege, ends_with(p, '*') AS option FROM (SELECT subject, owner, implied, CASE WHEN item LIKE '=%' THEN 'public' ELSE split_part(item, '=', 1) END AS grantee, unnest(regexp_extract_all(split_part(split_part(item, '=', 2), '/', 1), '[a-zA-Z][*]?')) AS p FROM (SELECT subject, owner, implied, unnest(acl) AS item FROM ({rows}))))
    WHERE grantee <> owner AND NOT (grantee = 'public' AND coalesce(privilege = implied, false)) GROUP BY subject, grantee"""


NO_LIST = ("grantable=', to_json(list_sort(list(DISTINCT privilege) FILTER (option)))::VARCHAR", "grantable=', coalesce(to_json(list_sort(list(DISTINCT privilege) FILTER (option)))::VARCHAR, '[]')")
for _name, _scan, _family, _relations, _rows in (
    ("introspect_table_grants", "table_grants", "table", "classes", "SELECT schema || '.' || relname AS subject, acl, owner, NULL AS implied FROM rel WHERE relkind IN ('r', 'p', 'v', 'm')"), ("introspect_sequence_grants", "sequence_grants", "sequence", "classes", "SELECT schema || '.' || relname AS subject, acl, owner, NULL AS implied FROM rel WHERE relkind = 'S'"),
    ("introspect_function_grants", "function_grants", "function", "procedures", "SELECT schema || '.' || proname || '(' || types || ')' AS subject, acl, owner, 'EXECUTE' AS implied FROM fun WHERE prokind = 'f'"), ("introspect_schema_grants", "schema_grants", "schema", "", "SELECT nspname AS subject, acl, owner, NULL AS implied FROM namespaces WHERE nspname IN ('public', 'audit')"),
    ("introspect_type_grants", "type_grants", "type", "types", "SELECT schema || '.' || typname AS subject, acl, owner, 'USAGE' AS implied FROM typ"),
):
    scan(_name, _scan, _relations, access(_family, _rows).replace(*NO_LIST))
scan(
    "introspect_default_privileges", "default_privileges", "default_acls",
    f"""SELECT 'default_privilege' AS kind, role || ' in ' || coalesce(nspname, '*') || ' on ' || object || ' to ' || grantee AS key, concat_ws('; ', 'grantable=' || coalesce(to_json(list_sort(list(DISTINCT privilege) FILTER (option)))::VARCHAR, '[]'), 'grantee=' || grantee, 'in_schema=' || nspname, 'object_type=' || object, 'privileges=' || to_json(list_sort(list(DISTINCT privilege)))::VARCHAR, 'role=' || role) AS attrs
    FROM (SELECT role, nspname, objtype, CASE objtype WHEN 'r' THEN 'tables' WHEN 'S' THEN 'sequences' WHEN 'f' THEN 'functions' WHEN 'T' THEN 'types' ELSE 'schemas' END AS object, grantee, {LETTER} AS privilege, ends_with(p, '*') AS option FROM (SELECT role, nspname, objtype, CASE WHEN item LIKE '=%' THEN 'public' ELSE split_part(item, '=', 1) END AS grantee, unnest(regexp_extract_all(split_part(split_part(item, '=', 2), '/', 1), '[a-zA-Z][*]?')) AS p FROM (SELECT *, unnest(acl) AS item FROM default_acls WHERE nspname IS NULL OR nspname IN ('public', 'audit'))))
    WHERE grantee <> role AND NOT (grantee = 'public' AND nspname IS NULL AND (objtype = 'f' AND privilege = 'EXECUTE' OR objtype = 'T' AND privilege = 'USAGE')) GROUP BY role, nspname, object, grantee""",
)


def said(on: str, joins: str, where: str) -> str:
    return f"SELECT 'comment' AS kind, {on} AS key, concat('comment=', d.description, '; on=', {on}) AS attrs FROM comments d {joins} WHERE {where}"


scan(
    "introspect_relation_comments", "relation_comments column_comments", "classes attributes comments",
    said("CASE WHEN r.relkind IN ('r', 'p') THEN 'table ' WHEN r.relkind = 'S' THEN 'sequence ' WHEN r.relkind = 'i' THEN 'index ' ELSE 'view ' END || r.schema || '.' || r.relname", "JOIN rel r ON r.oid = d.objoid", "d.catalog = 'pg_class' AND d.objsubid = 0")
    + " UNION ALL "
    + said("'column ' || r.schema || '.' || r.relname || '.' || a.attname", "JOIN rel r ON r.oid = d.objoid JOIN attributes a ON a.attrelid = r.oid AND a.attnum = d.objsubid", "d.catalog = 'pg_class' AND d.objsubid > 0"),
)
scan(
    "introspect_constraint_comments", "constraint_comments domain_constraint_comments", "classes types constraints comments",
    said("'constraint ' || r.schema || '.' || r.relname || '.' || c.conname", "JOIN constraints c ON c.oid = d.objoid JOIN rel r ON r.oid = c.conrelid", "d.catalog = 'pg_constraint'") + " UNION ALL " + said("'constraint domain ' || t.schema || '.' || t.typname || '.' || c.conname", "JOIN constraints c ON c.oid = d.objoid JOIN typ t ON t.oid = c.contypid", "d.catalog = 'pg_constraint'"),
)
scan(
    "introspect_other_comments", "type_comments routine_comments schema_comments trigger_comments policy_comments extension_comments server_comments", "classes types procedures triggers policies extensions servers comments",
    " UNION ALL ".join(
        [
            said("CASE WHEN t.typtype = 'd' THEN 'domain ' ELSE 'type ' END || t.schema || '.' || t.typname", "JOIN typ t ON t.oid = d.objoid", "d.catalog = 'pg_type'"), said("CASE WHEN p.prokind = 'a' THEN 'aggregate ' ELSE 'function ' END || p.schema || '.' || p.proname || '(' || p.types || ')'", "JOIN fun p ON p.oid = d.objoid", "d.catalog = 'pg_proc'"),
            said("'schema ' || n.nspname", "JOIN namespaces n ON n.oid = d.objoid", "d.catalog = 'pg_namespace'"), said("'trigger ' || r.schema || '.' || r.relname || '.' || t.tgname", "JOIN triggers t ON t.oid = d.objoid JOIN rel r ON r.oid = t.tgrelid", "d.catalog = 'pg_trigger'"),
            said("'policy ' || r.schema || '.' || r.relname || '.' || p.polname", "JOIN policies p ON p.oid = d.objoid JOIN rel r ON r.oid = p.polrelid", "d.catalog = 'pg_policy'"), said("'extension ' || x.extname", "JOIN extensions x ON x.oid = d.objoid", "d.catalog = 'pg_extension'"), said("'server ' || x.srvname", "JOIN servers x ON x.oid = d.objoid", "d.catalog = 'pg_foreign_server'"),
        ]
    ),
)
scan(
    "introspect_owners", "relation_owners routine_owners type_owners schema_owners server_owners", "classes types procedures servers",
    """SELECT 'owner' AS kind, subject AS key, concat('on=', subject, '; owner=', owner) AS attrs FROM (
      SELECT CASE WHEN relkind IN ('r', 'p') THEN 'table ' WHEN relkind = 'S' THEN 'sequence ' ELSE 'view ' END || schema || '.' || relname AS subject, owner FROM rel WHERE relkind IN ('r', 'p', 'v', 'm', 'S') AND NOT relispartition
      UNION ALL SELECT CASE WHEN prokind = 'a' THEN 'aggregate ' ELSE 'function ' END || schema || '.' || proname || '(' || types || ')', owner FROM fun WHERE prokind IN ('f', 'a')
      UNION ALL SELECT CASE WHEN typtype = 'd' THEN 'domain ' ELSE 'enum ' END || schema || '.' || typname, owner FROM typ
      UNION ALL SELECT 'schema ' || nspname, owner FROM namespaces WHERE nspname IN ('public', 'audit') UNION ALL SELECT 'server ' || srvname, owner FROM servers)""",
)


def introspect_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unsupported_objects(frames(spark))


QUERIES["introspect_unsupported"] = introspect_unsupported
ORACLE_SQL["introspect_unsupported"] = (
    values("namespaces", "owned_by_extensions", "classes", "inherits", "rules", "procedures")
    + """ SELECT CASE relkind WHEN 'c' THEN 'composite type' ELSE 'foreign table' END AS kind, relname AS name FROM classes WHERE relkind IN ('c', 'f')
    UNION ALL SELECT 'inherited table', relname FROM classes WHERE NOT relispartition AND oid IN (SELECT inhrelid FROM inherits) UNION ALL SELECT 'rule', rulename FROM rules UNION ALL SELECT 'procedure', proname FROM procedures WHERE prokind = 'p'"""
)


def introspect_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts of each kind each table has, once rows are put together."""
    catalog = to_catalog(introspect(spark, frames(spark), SCHEMAS))
    rows = [(t.key, kind, len(catalog.of(kind, t.key))) for t in catalog.of("table") for kind in ("column", "primary_key", "index", "foreign_key", "check", "exclusion", "trigger", "policy") if catalog.of(kind, t.key)]
    return spark.createDataFrame(rows, "key string, kind string, n long")


QUERIES["introspect_assembly"] = introspect_assembly
ORACLE_SQL["introspect_assembly"] = (
    values("namespaces", "owned_by_extensions", "classes", "attributes", "indexes", "constraints", "triggers", "policies")
    + """ SELECT r.schema || '.' || r.relname AS key, x.kind, count(*) AS n FROM rel r JOIN (
      SELECT attrelid AS oid, 'column' AS kind FROM attributes UNION ALL SELECT conrelid, CASE contype WHEN 'p' THEN 'primary_key' WHEN 'f' THEN 'foreign_key' WHEN 'c' THEN 'check' ELSE 'exclusion' END FROM constraints WHERE contype IN ('p', 'f', 'c', 'x')
      UNION ALL SELECT indrelid, 'index' FROM indexes WHERE indexrelid NOT IN (SELECT conindid FROM constraints WHERE contype = 'x') UNION ALL SELECT tgrelid, 'trigger' FROM triggers UNION ALL SELECT polrelid, 'policy' FROM policies) x ON x.oid = r.oid
    WHERE r.relkind IN ('r', 'p') AND NOT r.relispartition GROUP BY ALL"""
)


def introspect_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, objects, differences): how many live objects of each kind there are, and in how many a
    diff with the declaration differs: in none."""
    from collections import Counter

    from sparkpact.operators.diff import diff_rows
    from sparkpact.sources.ddl import parse_ddl

    live = to_catalog(introspect(spark, frames(spark), SCHEMAS))
    differ = Counter(r["kind"] for r in diff_rows(spark, live, parse_ddl(DECLARED)))
    objects = Counter(kind for kind, _ in live.objects)
    return spark.createDataFrame([(k, objects[k], differ[k]) for k in {*objects, *differ}], "kind string, objects long, differences long")


QUERIES["introspect_convergence"] = introspect_convergence
COUNTED = {
    "schema": "namespaces WHERE nspname IN ('public', 'audit')", "extension": "extensions", "server": "servers", "enum": "typ WHERE typtype = 'e'", "domain": "typ WHERE typtype = 'd'", "table": "rel WHERE relkind IN ('r', 'p') AND NOT relispartition", "partition": "rel WHERE relispartition", "view": "rel WHERE relkind IN ('v', 'm')",
    "column": "attributes JOIN rel ON oid = attrelid WHERE relkind IN ('r', 'p') AND NOT relispartition", "primary_key": "constraints WHERE contype = 'p'", "foreign_key": "constraints WHERE contype = 'f'", "check": "constraints WHERE contype = 'c' AND conrelid > 0", "exclusion": "constraints WHERE contype = 'x'",
    "index": "indexes WHERE indexrelid NOT IN (SELECT conindid FROM constraints WHERE contype = 'x')", "trigger": "triggers", "policy": "policies", "function": "fun WHERE prokind = 'f'", "aggregate": "fun WHERE prokind = 'a'", "sequence": "sequences", "default_privilege": "default_acls WHERE nspname IS NULL OR nspname = 'public'",
    "comment": "comments WHERE NOT (catalog = 'pg_class' AND objoid IN (SELECT objid FROM owned_by_extensions))", "owner": "(SELECT oid FROM rel WHERE relkind IN ('r', 'p', 'v', 'm', 'S') AND NOT relispartition UNION ALL SELECT oid FROM fun WHERE prokind IN ('f', 'a') UNION ALL SELECT oid FROM typ UNION ALL SELECT oid FROM namespaces WHERE nspname IN ('public', 'audit') UNION ALL SELECT oid FROM servers)",
    "grant": "(" + " UNION ALL ".join(f"SELECT key FROM ({access(family, rows).replace(*NO_LIST)})" for family, rows in (("table", "SELECT schema || '.' || relname AS subject, acl, owner, NULL AS implied FROM rel"), ("schema", "SELECT nspname AS subject, acl, owner, NULL AS implied FROM namespaces WHERE nspname IN ('public', 'audit')"), ("function", "SELECT proname AS subject, acl, owner, 'EXECUTE' AS implied FROM fun"), ("type", "SELECT typname AS subject, acl, owner, 'USAGE' AS implied FROM typ"))) + ")",
}
ORACLE_SQL["introspect_convergence"] = values("namespaces", "owned_by_extensions", *(r for r in RELATIONS if r not in ("namespaces", "owned_by_extensions"))) + "\n" + "\nUNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS objects, 0::BIGINT AS differences FROM {rows}" for kind, rows in COUNTED.items())
