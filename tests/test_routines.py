from pyspark.sql import functions as F

from sparkpact.functions.routines import fold, register_functions, refresh_materialized
from sparkpact.sources.ddl import parse_ddl


def test_sql_functions(spark):
    c = parse_ddl("""CREATE FUNCTION twice(a int) RETURNS int LANGUAGE sql AS $$ SELECT a * 2 $$;
        CREATE FUNCTION plus(int, b int DEFAULT 5) RETURNS int LANGUAGE sql RETURN $1 + b;
        CREATE FUNCTION pairs(n int) RETURNS TABLE(k int, v text) LANGUAGE sql AS $$ SELECT n, 'x' $$;
        CREATE FUNCTION p() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN RETURN NEW; END $$;""")
    done, left = register_functions(spark, c)
    assert left == ["public.p()"] and len(done) == 3
    assert spark.sql("SELECT twice(4), plus(1), plus(1, 1)").first()[:] == (8, 6, 2)
    assert spark.sql("SELECT * FROM pairs(3)").first()[:] == (3, "x")


def test_user_aggregate_and_materialized_view(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, None), ("b", 1, "z")], "g string, k int, v string")
    out = fold(df, ["g"], [F.col("k")], F.col("v"), F.lit(""), lambda acc, v: F.concat(acc, F.coalesce(v, F.lit("-"))), "s", lambda acc: F.upper(acc))
    again = refresh_materialized(out, str(tmp_path / "m"))
    assert {r["g"]: r["s"] for r in again.collect()} == {"a": "XY-", "b": "Z"}
