"""Introspection, migrations over data, version schemas, streams, contracts on edge cases, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sparkpact import live_queries as L
from sparkpact.__main__ import main
from sparkpact.functions.tokens import SqlError
from sparkpact.functions.translate import to_spark
from sparkpact.operators import contracts as C
from sparkpact.operators.apply import ContractViolation, apply_migration, validate
from sparkpact.operators.diff import diff
from sparkpact.plans.lifecycle import LintError, migration
from sparkpact.plans.versions import drop_version_sql, version_sql
from sparkpact.sources.catalog import from_dataframes
from sparkpact.sources.ddl import parse_ddl
from sparkpact.sources.introspect import introspect, to_catalog
from sparkpact.sources.live import execute, jdbc_address
from sparkpact.streaming.contracts import stream_check_violations, stream_unique


def test_introspection_meets_the_declaration(spark):
    live = to_catalog(introspect(spark, L.frames(spark), L.SCHEMAS))
    assert live.get("table", "public.ext_table") is None and live.get("table", "pg_catalog.pg_x") is None
    assert live.get("grant", "table public.users to app").attrs["grantable"] == ["SELECT"]
    assert live.get("partition", "public.events_2024").attrs["bound"] == {"kind": "range", "from": ["'2024-01-01'"], "to": ["'2025-01-01'"]}
    assert live.get("function", "public.add(integer, text)").attrs["args"][1]["name"] == "b"
    declared = parse_ddl(L.DECLARED)
    assert diff(spark, live, declared).collect() == []
    # and the other way round, with what nobody declares an owner of left out
    assert {(r["op"], r["kind"]) for r in diff(spark, declared, live, manage_ownership=False).collect()} == set()


def test_a_changed_partition_is_seen_by_the_rules(spark):
    live = to_catalog(introspect(spark, L.frames(spark), L.SCHEMAS))
    other = parse_ddl(L.DECLARED.replace("'2025-01-01'", "'2026-01-01'"))
    with pytest.raises(LintError, match="deny_drop_partition"):
        migration(spark, live, other)


def test_migration_over_data(spark):
    people = spark.createDataFrame([(1, "10", None), (2, "20", "b")], "id long, age string, name string")
    tables = {"public.p": people}
    old = parse_ddl("CREATE TABLE p (id bigint, age text, name text);")
    new = parse_ddl("CREATE TABLE p (id bigint PRIMARY KEY, age integer, tag text DEFAULT 'x', CONSTRAINT c CHECK (age > 5)); CREATE VIEW v AS SELECT q.id, tag FROM p q WHERE age > 15;")
    ops = migration(spark, old, new, check=False)["ops"]
    out = apply_migration(spark, tables, ops)
    assert {c: t for c, t in out["public.p"].dtypes} == {"id": "bigint", "age": "int", "tag": "string"}
    assert [tuple(r) for r in out["public.v"].collect()] == [(2, "x")]
    bad = migration(spark, old, parse_ddl("CREATE TABLE p (id bigint, age text, name text NOT NULL, CONSTRAINT c CHECK (age > 15));"), check=False)["ops"]
    with pytest.raises(ContractViolation):
        apply_migration(spark, tables, bad)
    assert len(validate(spark, tables, bad)) == 2


def test_versions():
    c = parse_ddl("CREATE TABLE users (id int, name text);")
    assert version_sql(c, "public", "v2", {"users": {"full_name": "name"}})[1] == 'CREATE OR REPLACE VIEW "public_v2"."users" WITH (security_invoker = true) AS SELECT "id", "name" AS "full_name" FROM "public"."users";'
    assert drop_version_sql("public", "v2") == ['DROP SCHEMA IF EXISTS "public_v2" CASCADE;']


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 5, "2024-01-01 00:00:00"), (2, -1, "2024-01-01 00:00:01"), (1, 7, "2024-01-01 00:00:02")], "k int, v int, at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v int, at string").parquet(str(tmp_path / "in")).withColumn("at", F.col("at").cast("timestamp"))
    for name, df in (("bad", stream_check_violations(stream, {"pos": F.col("v") > 0})), ("once", stream_unique(stream, ["k"], "at", "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [r["k"] for r in spark.table("bad").collect()] == [2] and sorted(r["k"] for r in spark.table("once").collect()) == [1, 2]


def test_contracts_on_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "a int, b string")
    assert [tuple(r) for r in C.unique_violations(df, ["a", "b"]).collect()] == [(1, "a", 2)]
    assert C.primary_key_violations(df, ["a", "b"]).count() == 3
    parent = spark.createDataFrame([(1,)], "id int")
    assert C.foreign_key_orphans(df, parent.where("id > 1"), ["a"], ["id"]).count() == 3
    assert {(r["column"], r["n_nulls"]) for r in C.not_null_violations(df, ["a", "b"]).collect()} == {("a", 2), ("b", 1)}
    routes = df.select(C.route_list(F.col("b"), {"p": ["a", None]}, "rest").alias("r"), C.route_range(F.col("a"), [("low", None, 1), ("high", 1, None)], "rest").alias("s")).collect()
    assert [tuple(r) for r in routes] == [("p", "high"), ("p", "high"), ("p", "high"), ("rest", "rest"), ("rest", "rest")]
    seq = C.assign_sequence(spark.range(50).withColumnRenamed("id", "k"), ["k"], start=5, increment=-2).orderBy("k").collect()
    assert [r["seq"] for r in seq] == [5 - 2 * k for k in range(50)]
    wide = C.assign_sequence(spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.lit("x").alias("extra")).repartition(8), ["k"])
    assert wide.where("seq <> k + 1").count() == 0 and wide.count() == 20_000
    spans = spark.createDataFrame([(1, "r", 0.0, 10.0), (2, "r", 9.0, 12.0), (3, "r", 10.0, 11.0), (4, "q", 0.0, 50.0)], "id int, room string, lo double, hi double")
    assert sorted(tuple(r) for r in C.exclusion_conflicts(spans, "id", ["room"], F.col("lo"), F.col("hi"), 4.0).collect()) == [(1, 2), (2, 3)]
    assert C.apply_policies(df, [{"command": "SELECT", "using": F.col("a") == 1}], "INSERT", "x").count() == 0
    assert C.apply_policies(df, [], "SELECT", "x", enabled=False).count() == 5


def test_catalog_of_dataframes(spark):
    df = spark.createDataFrame([], "a int, b array<string>, c decimal(8,2), d timestamp_ntz")
    c = from_dataframes({"t": df})
    assert [o.attrs["data_type"] for o in c.of("column")] == ["integer", "text[]", "numeric(8,2)", "timestamp without time zone"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.sql").write_text("CREATE TABLE t (a int, b int);")
    (tmp_path / "b.sql").write_text("CREATE TABLE t (a int); CREATE TABLE u (x int REFERENCES nowhere (id));")
    a, b = f"sql:{tmp_path}/a.sql", f"sql:{tmp_path}/b.sql"
    assert main(["diff", "--from", a, "--to", b]) == 0 and 'DROP COLUMN "b"' in capsys.readouterr().out
    assert main(["lint", "--from", a, "--to", b, "--json"]) == 1 and json.loads(capsys.readouterr().out)[0]["rule"] == "deny_drop_column"
    assert main(["drift", "--from", a, "--to", b, "--json"]) == 1
    capsys.readouterr()
    assert main(["check", "--to", b]) == 1 and "fk_references_missing_table" in capsys.readouterr().out
    assert main(["dump", "--to", a, "--output", str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "04_tables.sql").read_text().startswith("CREATE TABLE")
    assert main(["migrate", "--from", a, "--to", b, "--allow-destructive", "--output", str(tmp_path / "m"), "--name", "x"]) == 0


def test_addresses_and_secrets():
    assert jdbc_address("db:postgres://me:p%40ss@h:6432/shop?sslmode=require") == ("jdbc:postgresql://h:6432/shop", {"sslmode": "require", "user": "me", "password": "p@ss"})
    assert jdbc_address("postgresql://h") == ("jdbc:postgresql://h:5432/postgres", {}) and jdbc_address("jdbc:derby:memory:x")[0] == "jdbc:derby:memory:x"
    for bad in ("mysql://me:secret@h/x", "postgres://"):
        with pytest.raises(ValueError) as e:
            jdbc_address(bad)
        assert "secret" not in str(e.value)


def test_live_server_by_its_system_relations(spark, monkeypatch, capsys, tmp_path):
    """The command line over a live server, whose system relations are given."""
    from sparkpact.sources import live

    monkeypatch.setattr(live, "read_sources", lambda spark, url, **options: L.frames(spark))
    (tmp_path / "a.sql").write_text(L.DECLARED)
    (tmp_path / "b.sql").write_text(L.DECLARED + "CREATE TABLE extra (a int);")
    args = ["--from", "postgres://me:secret@h/x", "--schema", "public", "--schema", "audit"]
    assert main(["drift", *args, "--to", f"sql:{tmp_path}/a.sql"]) == 0
    capsys.readouterr()
    ran = []
    monkeypatch.setattr(live, "execute", lambda spark, address, statements: ran.extend(statements) or len(ran))
    assert main(["apply", *args, "--to", f"sql:{tmp_path}/b.sql", "--dry-run"]) == 0 and not ran
    assert main(["apply", *args, "--to", f"sql:{tmp_path}/b.sql", "--json"]) == 1  # the server is as it was: verification says so
    said = capsys.readouterr().out
    assert [s.split("(")[0] for s in ran] == ['CREATE TABLE "public"."extra" '] and "create table public.extra" in said and "secret" not in said


def test_statements_run_in_one_transaction(spark):
    """A server in this process stands for one over there."""
    url = "jdbc:derby:memory:pact;create=true"
    assert execute(spark, url, ["CREATE TABLE t (a INT);", "-- a note", "INSERT INTO t VALUES (1);"]) == 2
    with pytest.raises(RuntimeError, match="nowhere"):
        execute(spark, url, ["INSERT INTO t VALUES (2)", "INSERT INTO nowhere VALUES (3)"])
    assert [r[0] for r in spark.read.format("jdbc").option("url", url).option("query", "SELECT a FROM t").load().collect()] == [1]


def test_exclusion_and_backfill_over_data(spark):
    from sparkpact.operators.apply import exclusion_violations

    rows = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 9, None), (3, 1, None, -5), (4, 2, 0, 1)], "id int, room int, lo int, hi int").selectExpr("id", "room", "struct(lo AS lower, hi AS upper) AS during")
    elements = [{"expr": "room", "op": "="}, {"expr": "during", "op": "&&"}]
    assert exclusion_violations(rows, elements, None).count() == 1 and exclusion_violations(rows, elements, "id > 1").count() == 0
    old, new = parse_ddl("CREATE TABLE p (id int);"), parse_ddl("CREATE TABLE p (id int, tag text NOT NULL DEFAULT 'x');")
    ops = migration(spark, old, new, zero_downtime=True)["ops"]
    out = apply_migration(spark, {"public.p": spark.range(2).selectExpr("cast(id AS int) AS id")}, ops)
    assert [r["tag"] for r in out["public.p"].collect()] == ["x", "x"]


def test_sequences_stop_at_their_limit(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert C.assign_sequence(df, ["k"], high=5).count() == 5
    with pytest.raises(Exception, match="limit 4"):
        C.assign_sequence(df, ["k"], high=4).collect()


def test_what_cannot_be_read_is_refused():
    for bad in ("CREATE TABLE a (x int) INHERITS (b);", "CREATE TABLE a (LIKE nowhere);"):
        with pytest.raises(SqlError):
            parse_ddl(bad)
    for bad in ("pg_sleep(1)", "x #> 'a'", "to_char(x, fmt)"):
        with pytest.raises(ValueError):
            to_spark(bad)


def test_exported_schemas(tmp_path, monkeypatch):
    from sparkpact.sources.loader import load

    tool = tmp_path / "npx"
    tool.write_text("#!/bin/sh\n[ \"$4\" = good.ts ] && echo 'CREATE TABLE t (a int);' || { echo 'postgres://me:secret@h failed' >&2; exit 1; }\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path), prepend=":")
    (tmp_path / "a.sql").write_text("CREATE TABLE u (a int);")
    assert sorted(o.key for o in load(["drizzle:good.ts", f"sql:{tmp_path}/a.sql"]).of("table")) == ["public.t", "public.u"]
    with pytest.raises(ValueError, match="failed") as e:
        load(["drizzle:bad.ts"])
    assert "secret" not in str(e.value)
    monkeypatch.setenv("PATH", str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="not installed"):
        load(["drizzle:good.ts"])
