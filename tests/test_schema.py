"""DDL, diff, planner, renderer, rules: the laws that hold for any schema, and the details."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpact.functions.builtins import spark_call
from sparkpact.functions.normalize import same, same_body
from sparkpact.functions.tokens import SqlError
from sparkpact.functions.types import canonical_type, spark_type
from sparkpact.operators.diff import apply_ops, diff, grant_changes, new_enum_values
from sparkpact.plans import filters, lifecycle
from sparkpact.plans.checks import circular_foreign_keys
from sparkpact.plans.lint import has_errors, lint_ops, lock_of, narrows
from sparkpact.plans.planner import CycleError, edges, expand_contract, plan, split_ops
from sparkpact.plans.references import function_references, relation_references, rowtype_references
from sparkpact.plans.render import body, sql_of, to_json
from sparkpact.sources.catalog import Catalog, DuplicateObject, Obj
from sparkpact.sources.ddl import parse_ddl, unrecognised
from sparkpact.sources.loader import database_url, expand, load, scrubbed

APP = """
CREATE SCHEMA auth;
CREATE EXTENSION IF NOT EXISTS pgcrypto WITH SCHEMA public VERSION '1.3';
CREATE TYPE state AS ENUM ('open', 'done');
CREATE DOMAIN email AS text NOT NULL CHECK (VALUE ~ '@');
CREATE TABLE orgs (id bigserial PRIMARY KEY, slug varchar(40) NOT NULL UNIQUE, name text NOT NULL DEFAULT 'x''y');
CREATE TABLE members (id bigint PRIMARY KEY, org_id bigint NOT NULL REFERENCES orgs (id) ON DELETE CASCADE, mail email, s state DEFAULT 'open'::state, total numeric(15,2) CHECK (total >= 0),
  low text GENERATED ALWAYS AS (lower(mail)) STORED, CONSTRAINT pos CHECK (id > 0), UNIQUE (org_id, mail));
CREATE INDEX members_open ON members USING btree (org_id, lower(mail)) WHERE s = 'open';
CREATE FUNCTION total_of(o bigint, OUT t numeric) LANGUAGE sql STABLE SECURITY DEFINER SET search_path = public AS $$ SELECT sum(total) FROM members WHERE org_id = o $$;
CREATE FUNCTION touch() RETURNS trigger LANGUAGE plpgsql AS $body$ BEGIN RETURN NEW; END $body$;
CREATE AGGREGATE glue(text) (SFUNC = textcat, STYPE = text, INITCOND = '');
CREATE VIEW open_members AS SELECT m.id, o.slug FROM members m JOIN orgs o ON m.org_id = o.id WHERE m.s = 'open';
CREATE VIEW open_ids AS SELECT id FROM open_members;
CREATE MATERIALIZED VIEW sums AS SELECT org_id, count(*) FILTER (WHERE s = 'done') AS n FROM members GROUP BY org_id;
CREATE TRIGGER touched BEFORE UPDATE OF mail, total ON members FOR EACH ROW WHEN (OLD.mail IS DISTINCT FROM NEW.mail) EXECUTE FUNCTION touch();
CREATE SEQUENCE tickets AS integer START WITH 10 INCREMENT BY 5 MAXVALUE 1000 CYCLE OWNED BY members.id;
ALTER TABLE members ENABLE ROW LEVEL SECURITY;
CREATE POLICY own ON members FOR SELECT TO app USING (org_id IN (SELECT id FROM orgs));
CREATE TABLE events (id bigint, at date) PARTITION BY RANGE (at);
CREATE TABLE events_2020 PARTITION OF events FOR VALUES FROM ('2020-01-01') TO ('2021-01-01');
CREATE TABLE events_rest PARTITION OF events DEFAULT;
CREATE TABLE rooms (id int, during tstzrange, EXCLUDE USING gist (id WITH =, during WITH &&));
GRANT SELECT, INSERT ON members TO app; GRANT ALL ON orgs TO admin WITH GRANT OPTION; GRANT USAGE ON SCHEMA auth TO app;
ALTER DEFAULT PRIVILEGES FOR ROLE boss IN SCHEMA public GRANT SELECT ON TABLES TO ro;
COMMENT ON TABLE members IS 'who'; COMMENT ON COLUMN members.mail IS 'it''s'; COMMENT ON FUNCTION touch() IS 'f'; COMMENT ON POLICY own ON members IS 'p';
ALTER TABLE members OWNER TO boss;
"""


def ops_of(spark, a, b):
    return plan(diff(spark, parse_ddl(a), parse_ddl(b)).collect())


def sql(spark, a, b):
    return [s for o in ops_of(spark, a, b) for s in sql_of(o)]


def test_reader_keeps_what_is_declared():
    c = parse_ddl(APP, strict=True)
    assert c.get("column", "public.orgs.id").attrs["default"] == "nextval('public.orgs_id_seq'::regclass)"
    assert c.get("column", "public.members.total").attrs["data_type"] == "numeric(15,2)"
    assert c.get("column", "public.members.low").attrs["generated"] == "lower(mail)"
    assert c.get("index", "public.members.members_org_id_mail_key").attrs["is_constraint"]
    assert c.get("index", "public.members.members_open").attrs["predicate"] == "s = 'open'"
    assert c.get("foreign_key", "public.members.members_org_id_fkey").attrs["on_delete"] == "CASCADE"
    assert c.get("function", "public.total_of(bigint)").attrs["return_type"] == "numeric"
    assert c.get("partition", "public.events_2020").attrs["bound"]["from"] == ["'2020-01-01'"]
    assert c.get("exclusion", "public.rooms.rooms_excl").attrs["elements"] == [{"expr": "id", "op": "="}, {"expr": "during", "op": "&&"}]
    assert c.get("table", "public.members").attrs["rls"] is True
    assert c.get("grant", "table public.orgs to admin").attrs["privileges"] == ["DELETE", "INSERT", "REFERENCES", "SELECT", "TRIGGER", "TRUNCATE", "UPDATE"]
    assert c.get("trigger", "public.members.touched").attrs["update_columns"] == ["mail", "total"]
    assert c.get("comment", "column public.members.mail").attrs["comment"] == "it's"
    assert unrecognised(APP) == []


def test_alter_statements_fold():
    c = parse_ddl("""CREATE TABLE t (a int, b text); ALTER TABLE t ADD COLUMN c date, DROP COLUMN b, ALTER COLUMN a SET NOT NULL, ALTER a TYPE bigint;
        ALTER TABLE t RENAME COLUMN a TO z; ALTER TABLE t RENAME TO u; CREATE TYPE e AS ENUM ('a', 'c'); ALTER TYPE e ADD VALUE 'b' BEFORE 'c'; ALTER TYPE e ADD VALUE IF NOT EXISTS 'b';
        CREATE TABLE gone (x int); DROP TABLE gone; GRANT SELECT, UPDATE ON u TO r; REVOKE UPDATE ON u FROM r; CREATE INDEX i ON u (z); ALTER INDEX i RENAME TO j;""", strict=True)
    assert sorted(k for k in c.objects if k[0] == "column") == [("column", "public.u.c"), ("column", "public.u.z")]
    assert c.get("column", "public.u.z").attrs == {"nullable": False, "data_type": "bigint"}
    assert c.get("enum", "public.e").attrs["values"] == ["a", "b", "c"]
    assert c.get("table", "public.gone") is None
    assert c.get("grant", "table public.u to r").attrs["privileges"] == ["SELECT"]
    assert c.get("index", "public.u.j")


@pytest.mark.parametrize(
    "text",
    [
        "CREATE INDEX ON t (a)", "CREATE TABLE t (a int); CREATE INDEX i ON t USING nosuch (a)", "CREATE TRIGGER x INSTEAD OF INSERT ON v FOR EACH STATEMENT EXECUTE FUNCTION f()", "CREATE TRIGGER x BEFORE INSERT ON v REFERENCING NEW TABLE AS n EXECUTE FUNCTION f()",
        "CREATE TABLE t (a int GENERATED ALWAYS AS (1) VIRTUAL)", "CREATE TABLE t (a int REFERENCES u)", "CREATE POLICY p ON nowhere USING (true)", "CREATE FUNCTION f() LANGUAGE sql AS 'select 1'", "CREATE TABLE t (a 'x')", "CREATE TABLE t (a int", "SELECT 'open",
        "CREATE TYPE e AS ENUM ('a'); ALTER TYPE e ADD VALUE 'b' AFTER 'z'",
    ],
)
def test_errors(text):
    with pytest.raises((SqlError, ValueError)):
        parse_ddl(text)


def test_strict_mode_and_unrecognised():
    assert [u[1] for u in unrecognised("CREATE TABLE t (a int); CREATE OPERATOR x (y); SELECT 1;")] == ["create operator"]
    with pytest.raises(SqlError):
        parse_ddl("CREATE OPERATOR x (y);", strict=True)


def test_laws(spark):
    a, b = parse_ddl(APP), Catalog()
    assert diff(spark, a, a).count() == 0
    made, gone = diff(spark, b, a).collect(), diff(spark, a, b).collect()
    assert {r["op"] for r in made} == {"create"} and {r["op"] for r in gone} == {"drop"}
    assert diff(spark, apply_ops(b, made), a).count() == 0
    assert apply_ops(a, gone).objects == {}
    first = plan(made)
    assert [o["key"] for o in first] == [o["key"] for o in plan(list(reversed(made)))]
    assert len(first) == len(split_ops(made_ops := [r.asDict() for r in made])) and len(made_ops) == len(made)
    assert all(x < y for x, y in edges(first))


def test_dump_is_stable(spark):
    a = parse_ddl(APP)
    text = "\n".join(lifecycle.dump(a))
    again = parse_ddl(text, strict=True)
    assert diff(spark, again, a).collect() == []
    assert "\n".join(lifecycle.dump(again)) == text
    out = lifecycle.baseline(spark, a)
    assert out["differences"] == [] and out["counts"]["table"] == 4
    parts = lifecycle.split_dump(a)
    assert sorted(s for p in parts.values() for s in p) == sorted(lifecycle.dump(a))


def test_changes(spark):
    one = "CREATE TABLE t (a int, b text); CREATE VIEW v AS SELECT a FROM t; CREATE VIEW w AS SELECT a FROM v;"
    two = "CREATE TABLE t (a bigint, b text NOT NULL DEFAULT 'x'); CREATE VIEW v AS SELECT a FROM t; CREATE VIEW w AS SELECT a FROM v;"
    found = sql(spark, one, two)
    assert found.index('DROP VIEW "public"."w";') < found.index('DROP VIEW "public"."v";') < found.index('ALTER TABLE "public"."t" ALTER COLUMN "a" TYPE bigint USING "a"::bigint;')
    assert found.index('ALTER TABLE "public"."t" ALTER COLUMN "a" TYPE bigint USING "a"::bigint;') < found.index('CREATE OR REPLACE VIEW "public"."v" AS SELECT a FROM t;') < found.index('CREATE OR REPLACE VIEW "public"."w" AS SELECT a FROM v;')
    assert 'ALTER TABLE "public"."t" ALTER COLUMN "b" SET NOT NULL;' in found
    assert sql(spark, "CREATE TYPE e AS ENUM ('b');", "CREATE TYPE e AS ENUM ('a', 'b', 'c');") == ["ALTER TYPE \"public\".\"e\" ADD VALUE 'a' BEFORE 'b';", "ALTER TYPE \"public\".\"e\" ADD VALUE 'c' AFTER 'b';"]
    fk = "CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (p int REFERENCES p (id){});"
    assert [o["op"] for o in ops_of(spark, fk.format(""), fk.format(" ON DELETE CASCADE"))] == ["drop", "create"]
    trigger = "CREATE TABLE t (a int); CREATE TRIGGER x AFTER INSERT ON t EXECUTE FUNCTION f(); ALTER TABLE t {} TRIGGER x;"
    assert sql(spark, trigger.format("ENABLE"), trigger.format("DISABLE")) == ['ALTER TABLE "public"."t" DISABLE TRIGGER "x";']
    policy = "CREATE TABLE t (a int); CREATE POLICY p ON t USING (a > 0){};"
    assert sql(spark, policy.format(" WITH CHECK (a > 1)"), policy.format(""))[0].startswith("DROP POLICY")
    assert sql(spark, "CREATE TABLE t (a int); GRANT SELECT, INSERT ON t TO r;", "CREATE TABLE t (a int); GRANT SELECT, UPDATE ON t TO r;") == ['REVOKE INSERT ON TABLE "public"."t" FROM r;', 'GRANT UPDATE ON TABLE "public"."t" TO r;']
    assert sql(spark, "CREATE VIEW v AS SELECT a FROM t WHERE (a = ANY (ARRAY[1, 2]));", "CREATE VIEW v AS select a from public.t where a in (1, 2);") == []


def test_compatible_mode_sees_less(spark):
    one = parse_ddl("CREATE TYPE e AS ENUM ('a', 'b'); CREATE DOMAIN d AS text; CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (p int REFERENCES p (id)); CREATE POLICY x ON p FOR SELECT USING (true);")
    two = parse_ddl("CREATE TYPE e AS ENUM ('b', 'a'); CREATE DOMAIN d AS integer; CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (p int REFERENCES p (id) ON DELETE CASCADE); CREATE POLICY x ON p FOR UPDATE USING (true);")
    assert {r["kind"] for r in diff(spark, one, two).collect()} == {"enum", "domain", "foreign_key", "policy"}
    assert diff(spark, one, two, compat=True).count() == 0
    three = parse_ddl("CREATE TYPE e AS ENUM ('a', 'c', 'b');")
    assert diff(spark, parse_ddl("CREATE TYPE e AS ENUM ('a', 'b');"), three, compat=True).count() == 1


def test_cycles(spark):
    ring = parse_ddl("CREATE TABLE a (id int PRIMARY KEY); CREATE TABLE b (id int PRIMARY KEY, a int REFERENCES a (id)); ALTER TABLE a ADD COLUMN b int REFERENCES b (id);")
    assert circular_foreign_keys(ring) == ["public.a", "public.b"]
    assert [o["kind"] for o in plan(diff(spark, Catalog(), ring).collect())][-2:] == ["foreign_key", "foreign_key"]
    with pytest.raises(CycleError):
        plan(diff(spark, Catalog(), parse_ddl("CREATE VIEW a AS SELECT 1 FROM b; CREATE VIEW b AS SELECT 1 FROM a;")).collect())


def test_migration_and_drift(spark):
    a, b = parse_ddl("CREATE TABLE t (a int, b int);"), parse_ddl("CREATE TABLE t (a int, c int NOT NULL);")
    with pytest.raises(lifecycle.LintError):
        lifecycle.migration(spark, a, b)
    out = lifecycle.migration(spark, a, b, allow_destructive=True)
    assert {f["lock"] for f in out["locks"]} == {"ACCESS EXCLUSIVE"}
    back = lifecycle.migration(spark, a, b, reverse=True, allow_destructive=True)
    assert {(o["op"], o["name"]) for o in back["ops"]} == {("create", "b"), ("drop", "c")}
    assert [o["phase"] for o in expand_contract(out["ops"])] == ["expand", "backfill", "contract", "contract"]
    assert json.loads(to_json(out["ops"]))[0]["lock"]
    report = lifecycle.drift(spark, a, b)
    assert report["has_drift"] and report["expected_fingerprint"] != report["actual_fingerprint"]
    assert not lifecycle.drift(spark, a, a)["has_drift"]
    assert lifecycle.verify(spark, a, a) == []


def test_lint(spark):
    ops = diff(spark, parse_ddl("CREATE TABLE t (a bigint, b varchar(20)); CREATE TABLE u (x int UNIQUE);"), parse_ddl("CREATE TABLE t (a int, b varchar(40)); CREATE TABLE u (x int);"))
    found = {(r["rule"], r["key"]) for r in lint_ops(ops).collect()}
    assert found == {("warn_type_narrowing", "public.t.a"), ("deny_drop_unique_constraint", "public.u.u_x_key")}
    assert {r["rule"] for r in lint_ops(ops, compat=True).collect()} == {"warn_type_narrowing", "deny_drop_unique_constraint"}
    assert has_errors(lint_ops(ops)) and not has_errors(lint_ops(ops, allow_destructive=True))
    drop = diff(spark, parse_ddl("CREATE TABLE t (a int);"), Catalog())
    assert [r["rule"] for r in lint_ops(drop, allow_destructive=True, in_production=True).collect()] == ["deny_drop_table_in_prod"]
    assert narrows("bigint", "integer") and not narrows("integer", "bigint") and narrows("integer", "integer", compat=True)
    assert lock_of({"op": "alter", "kind": "column", "changed": ["default"]}) is None


def test_filters():
    c = parse_ddl(APP)
    kept = filters.filtered(c, include=["members"])
    assert {k for k, _ in kept.objects} >= {"table", "column", "policy", "trigger", "grant", "comment", "owner"} and kept.get("table", "public.orgs") is None
    assert filters.filtered(c, exclude=["public.ev*"]).get("table", "public.events") is None
    assert {o.kind for o in filters.filtered(c, include_types=["enums"]).objects.values()} == {"enum"}
    assert filters.filtered(c, include_types=["policies"]).get("table", "public.members")
    assert filters.filtered(c, managed_partitions=False).of("partition") == []
    assert {o.schema for o in filters.filtered(c, target_schemas=["auth"]).of("table")} == set()
    with pytest.raises(ValueError):
        filters.kinds_of(["nosuch"])


def test_name_condition(spark):
    df = parse_ddl(APP).to_df(spark).where("kind = 'table'")
    assert [r["name"] for r in df.where(filters.name_condition(["mem*", "public.or?s"], ["orgs"])).collect()] == ["members"]


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [
        ("(a > 0)", "a > 0", True), ("((a > 0) AND (b < 1))", "a>0 and b<1", True), ("s = ANY (ARRAY['x'::text, 'y'::text])", "s IN ('x','y')", True), ("(n ~~ 'a%'::text)", "n like 'a%'", True), ("(a or b) and c", "a or (b and c)", False), ("a.id = 1", "b.id = 1", False),
        ("SELECT id FROM public.users u INNER JOIN t ON ((u.id = t.id))", "select id from users as u join t on u.id=t.id", True), ("(SELECT auth.uid() AS uid)", "auth.uid()", True), ("now() - '1 day'::interval", "now() - interval '1 day'", True), ("(a + b) * c", "a + b * c", False),
        ("NOT (EXISTS ( SELECT 1 FROM t))", "not exists (select 1 from t)", True), ("CAST(a AS text)", "a", True), ("NULL::text", "null", True), ("x::jsonb", "x", False), ("a <> 1", "a != 1", True), ('"a" = 1', "a = 1", True), ('"A" = 1', "a = 1", False), ("nextval('public.s'::regclass)", "nextval('s'::regclass)", True),
    ],
)
def test_equivalence(a, b, equal):
    assert same(a, b) is equal and same(b, a) is equal


def test_references():
    assert relation_references("WITH x AS (SELECT 1 FROM a.b) SELECT * FROM x, t1 u JOIN ONLY t2 ON true WHERE EXISTS (SELECT 1 FROM t3)") == {"a.b", "public.t1", "public.t2", "public.t3"}
    assert function_references("SELECT f(lower(x)), s.g(1), count(*) FROM t WHERE a IN (1)") == {"public.f", "s.g"}
    assert rowtype_references("DECLARE r orders%ROWTYPE;") == {"public.orders"}


def test_types():
    from pyspark.sql import types as T

    assert canonical_type("INT4") == "integer" and canonical_type("varchar( 10 )") == "character varying(10)" and canonical_type("timestamptz[]") == "timestamp with time zone[]"
    assert canonical_type("mood") == "public.mood" and canonical_type("TABLE(a int, b varchar)") == "TABLE(a integer, b character varying)" and canonical_type("SETOF int") == "SETOF integer"
    assert spark_type("numeric(10,2)") == T.DecimalType(10, 2) and spark_type("int[]") == T.ArrayType(T.IntegerType()) and spark_type("vector(3)") == T.ArrayType(T.FloatType())


def test_builtin_mapping(spark):
    run = lambda e: spark.sql(f"SELECT {e} AS x").first()[0]
    assert run(spark_call("log", ["100.0D"])) == 2.0
    assert run(spark_call("array_position", ["array(1, 2)", "9"])) is None
    assert run(spark_call("left", ["'hello'", "-2"])) == "hel"
    assert run(spark_call("concat", ["'a'", "NULL", "'b'"])) == "ab"
    assert run(spark_call("regexp_replace", ["'aaa'", "'a'", "'b'"])) in ("baa", "bbb")
    with pytest.raises(ValueError):
        spark_call("pg_sleep", ["1"])


def test_loader(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.sql").write_text("CREATE POLICY p ON t USING (true); COMMENT ON TABLE t IS 'x';")
    (tmp_path / "sub" / "a.sql").write_text("CREATE TABLE t (a int); CREATE AGGREGATE g(text) (SFUNC = f, STYPE = text);")
    c = load([f"sql:{tmp_path}"])
    assert c.get("policy", "public.t.p") and c.get("aggregate", "public.g(text)") and c.get("comment", "table public.t")
    (tmp_path / "c.sql").write_text("CREATE TABLE t (b int);")
    with pytest.raises(DuplicateObject, match="a.sql.*c.sql|c.sql.*a.sql"):
        load([f"sql:{tmp_path}"])
    assert len(expand(f"{tmp_path}/*.sql")) == 2
    assert scrubbed("postgres://u:secret@h/d") == "postgres://u:***@h/d" and database_url("db:postgres://h") == "postgres://h" and database_url("x.sql") is None
    with pytest.raises(ValueError):
        load(["drizzle:x"])


def test_files(tmp_path):
    assert lifecycle.write_migration(str(tmp_path), "Add users!", ["SELECT 1;"]).endswith("0001_add_users.sql")
    assert lifecycle.next_migration_name(str(tmp_path), "x") == "0002_x.sql"
    assert body("a $$ b") == "$body1$a $$ b$body1$"


def test_grants_and_enums(spark):
    kinds = "object string, grantee string, privileges array<string>"
    out = grant_changes(spark.createDataFrame([("t", "a", ["S"]), ("t", "a", ["I"])], kinds), spark.createDataFrame([("t", "a", ["S", "U"])], kinds), ["object"]).collect()
    assert {(r["op"], tuple(r["privileges"])) for r in out} == {("grant", ("U",)), ("revoke", ("I",))}
    assert [(r["value"], r["after"]) for r in new_enum_values(spark, [], ["x", "y"]).collect()] == [("x", None), ("y", "x")]
    assert same_body(" a\n b", "a b") and not same_body("a", None)


names = st.sampled_from(["a", "b", "c", "d", "e"])
columns = st.dictionaries(names, st.tuples(st.sampled_from(["integer", "bigint", "text", "varchar(10)", "numeric(8,2)", "timestamptz", "boolean[]"]), st.booleans()), min_size=1, max_size=4)
schemas = st.dictionaries(st.sampled_from(["t", "u", "v"]), columns, max_size=3)


def ddl_of(schema):
    return "".join(f"CREATE TABLE {t} ({', '.join(f'{c} {k}' + (' NOT NULL' if n else '') for c, (k, n) in cs.items())});" for t, cs in schema.items())


@settings(max_examples=4, deadline=None)
@given(schemas, schemas)
def test_any_change_converges(spark, a, b):
    one, two = parse_ddl(ddl_of(a)), parse_ddl(ddl_of(b))
    ops = diff(spark, one, two).collect()
    assert diff(spark, apply_ops(one, ops), two).collect() == []
    assert len(plan(ops)) == len(ops)


@settings(max_examples=30, deadline=None)
@given(schemas)
def test_dump_round_trip(a):
    c = parse_ddl(ddl_of(a))
    assert parse_ddl("\n".join(lifecycle.dump(c))).fingerprint() == c.fingerprint()


def test_equal_canonical_forms_mean_the_same():
    """Random conditions, with parentheses where they are needed and where they are not: texts with
    one canonical form have one truth table, and needless parentheses around the whole, around
    comparisons and around parentheses never make a difference."""
    import itertools
    import random

    from sparkpact.functions.normalize import canonical

    rng = random.Random(17)
    names = ["a", "b", "c"]

    def tree(depth):
        if not depth or rng.random() < 0.25:
            return ("cmp", rng.choice(names), rng.choice([">", "<", "="]), rng.choice([0, 1]))
        kind = rng.choice(["and", "or", "not"])
        return (kind, tree(depth - 1)) if kind == "not" else (kind, tree(depth - 1), tree(depth - 1))

    def truth(t, row):
        if t[0] == "cmp":
            x = row[t[1]]
            return x > t[3] if t[2] == ">" else x < t[3] if t[2] == "<" else x == t[3]
        return not truth(t[1], row) if t[0] == "not" else (all if t[0] == "and" else any)([truth(t[1], row), truth(t[2], row)])

    rank = {"or": 0, "and": 1, "not": 2, "cmp": 3}

    def text(t, extra):
        if t[0] == "cmp":
            out = f"{t[1]} {t[2]} {t[3]}"
        elif t[0] == "not":
            inner = text(t[1], extra)
            out = f"NOT {inner}" if t[1][0] in ("cmp", "not") and rng.random() < 0.5 else f"NOT ({inner})"
        else:
            sides = [f"({text(x, extra)})" if rank[x[0]] < rank[t[0]] or rank[x[0]] == rank[t[0]] and k else text(x, extra) for k, x in enumerate(t[1:])]
            out = f" {t[0].upper()} ".join(sides)
        return f"({out})" if rng.random() < extra else out

    rows = [dict(zip(names, v, strict=True)) for v in itertools.product((-1, 0, 1, 2), repeat=3)]
    seen = {}
    for _ in range(3_000):
        t = tree(3)
        table = tuple(truth(t, r) for r in rows)
        for extra in (0.0, 0.4, 1.0):
            form = canonical(text(t, extra))
            assert seen.setdefault(form, table) == table, form
        plain = text(t, 0.0)
        assert canonical(f"(({plain}))") == canonical(plain)


CORPUS = {
    "shop": """CREATE TABLE artist (artist_id serial PRIMARY KEY, name varchar(120)); CREATE TABLE album (album_id serial PRIMARY KEY, title varchar(160) NOT NULL, artist_id int NOT NULL REFERENCES artist (artist_id) ON DELETE CASCADE);
        CREATE TABLE track (track_id serial PRIMARY KEY, name varchar(200) NOT NULL, album_id int REFERENCES album, milliseconds int NOT NULL CHECK (milliseconds > 0), unit_price numeric(10,2) NOT NULL DEFAULT 0.99); CREATE TABLE list_track (list_id int, track_id int REFERENCES track, PRIMARY KEY (list_id, track_id)); CREATE INDEX track_album ON track (album_id) WHERE album_id IS NOT NULL;""",
    "service": """CREATE TYPE plan AS ENUM ('free', 'pro'); CREATE DOMAIN email AS text CHECK (VALUE ~ '^[^@]+@[^@]+$'); CREATE TABLE org (id bigint GENERATED ALWAYS AS IDENTITY PRIMARY KEY, slug text UNIQUE NOT NULL, plan plan NOT NULL DEFAULT 'free'); CREATE TABLE member (id bigserial PRIMARY KEY, org_id bigint NOT NULL REFERENCES org (id), mail email NOT NULL, created_at timestamptz NOT NULL DEFAULT now());
        ALTER TABLE member ENABLE ROW LEVEL SECURITY; CREATE POLICY own ON member USING (org_id IN (SELECT o.id FROM org o WHERE o.plan = 'pro')); CREATE VIEW active AS WITH m AS (SELECT org_id, count(*) FILTER (WHERE mail IS NOT NULL) AS n FROM member GROUP BY org_id) SELECT o.slug, coalesce(m.n, 0) AS n FROM org o LEFT JOIN m ON m.org_id = o.id; CREATE MATERIALIZED VIEW monthly AS SELECT date_trunc('month', created_at) AS month, count(*) AS n FROM member GROUP BY 1;
        GRANT SELECT ON member TO reader WITH GRANT OPTION; COMMENT ON TABLE org IS 'it''s a customer';""",
    "events": """CREATE TABLE ev (id bigserial, kind text NOT NULL, payload jsonb, at timestamp NOT NULL) PARTITION BY RANGE (at); CREATE TABLE ev_1 PARTITION OF ev FOR VALUES FROM ('2024-01-01') TO ('2024-02-01'); CREATE TABLE ev_rest PARTITION OF ev DEFAULT; CREATE TABLE note (channel text) PARTITION BY LIST (channel); CREATE TABLE note_a PARTITION OF note FOR VALUES IN ('a', 'b');
        CREATE TABLE booking (id int PRIMARY KEY, room int NOT NULL, during tstzrange NOT NULL, CONSTRAINT once EXCLUDE USING gist (room WITH =, during WITH &&)); CREATE TABLE price (cents int NOT NULL, rate numeric(5,4) NOT NULL, gross numeric(12,2) GENERATED ALWAYS AS (round(cents * (1 + rate) / 100, 2)) STORED);""",
    "audit": """CREATE SCHEMA app; CREATE SEQUENCE app.invoice_no START 1000 INCREMENT 5 CACHE 10; CREATE TABLE app.account (id bigint PRIMARY KEY, status text NOT NULL DEFAULT 'new', balance numeric(15,2) CHECK (balance >= 0)); CREATE TABLE app.log (account_id bigint, old_value text, new_value text);
        CREATE FUNCTION app.note() RETURNS trigger LANGUAGE plpgsql AS $$BEGIN IF OLD.status IS DISTINCT FROM NEW.status THEN INSERT INTO app.log VALUES (NEW.id, OLD.status, NEW.status); END IF; RETURN NEW; END$$; CREATE TRIGGER note AFTER UPDATE OF status ON app.account FOR EACH ROW WHEN (OLD.status IS DISTINCT FROM NEW.status) EXECUTE FUNCTION app.note();
        CREATE FUNCTION app.glue(a text, b text) RETURNS text LANGUAGE sql IMMUTABLE AS 'SELECT concat(a, b)'; CREATE AGGREGATE app.glue_all(text) (SFUNC = app.glue, STYPE = text, INITCOND = ''); ALTER DEFAULT PRIVILEGES IN SCHEMA app GRANT SELECT ON TABLES TO reader; ALTER TABLE app.account OWNER TO boss;""",
}


@pytest.mark.parametrize("name", sorted(CORPUS))
def test_corpora_converge(spark, name):
    """A schema that is dumped, read back and compared leaves nothing to do; so does a plan from
    nothing, and the way back from the plan to nothing."""
    declared = parse_ddl(CORPUS[name])
    found = lifecycle.baseline(spark, declared)
    assert found["differences"] == [] and found["fingerprints_equal"]
    there = lifecycle.migration(spark, Catalog(), declared)["ops"]
    as_text = [{**o, "new": o["new"] and Obj(o["kind"], "", "", "", o["new"]).text_attrs()} for o in there]
    assert lifecycle.verify(spark, apply_ops(Catalog(), as_text), declared) == []
    back = lifecycle.migration(spark, declared, Catalog(), allow_destructive=True)["ops"]
    assert not apply_ops(declared, back).objects.keys() - {("schema", "app"), ("owner", "table app.account")}
