"""Live servers: their schema as a catalog, and statements run on them, both through JDBC.

Connections are made by the driver's JVM; the server's JDBC driver must be on its class path.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import SparkSession

from sparkpact.plans import lifecycle
from sparkpact.sources.catalog import Catalog
from sparkpact.sources.introspect import introspect, read_sources, to_catalog
from sparkpact.sources.loader import database_url, scrubbed


def jdbc_address(address: str) -> tuple[str, dict[str, str]]:
    """The JDBC address and properties of db:…, postgres://, postgresql:// or jdbc:… addresses."""
    address = database_url(address) or address
    if address.startswith("jdbc:"):
        return address, {}
    parts = urlsplit(address)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname:
        raise ValueError(f"not a database address: {scrubbed(address)}")
    options = dict(parse_qsl(parts.query))
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}/{parts.path.lstrip('/') or 'postgres'}", options


def live_catalog(spark: SparkSession, address: str, schemas: Iterable[str] = ("public",), include_extension_objects: bool = False) -> Catalog:
    """The schema of a live server. Errors do not tell its password."""
    url, options = jdbc_address(address)
    try:
        return to_catalog(introspect(spark, read_sources(spark, url, **options), schemas, include_extension_objects), options.get("user"))
    except Exception as e:
        raise ConnectionError(scrubbed(str(e).splitlines()[0])) from None


def execute(spark: SparkSession, address: str, statements: Iterable[str]) -> int:
    """Run statements in one transaction; a failure rolls all of them back and names the statement.
    Comments are passed over. New enum values come first and by themselves: a transaction may not
    use a value that it has added."""
    url, options = jdbc_address(address)
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    todo = [s.rstrip().rstrip(";") for s in statements if not s.lstrip().startswith("--")]
    alone = [s for s in todo if s.startswith("ALTER TYPE") and " ADD VALUE " in s]
    current = "the connection"
    connection = None
    try:
        connection = jvm.java.sql.DriverManager.getConnection(url, properties)
        for group in ([s] for s in alone):
            current = group[0]
            run(connection, group)
        connection.setAutoCommit(False)
        for current in [s for s in todo if s not in alone]:
            run(connection, [current])
        connection.commit()
    except Exception as e:
        if connection is not None and not connection.getAutoCommit():
            connection.rollback()
        cause = getattr(e, "java_exception", None)
        raise RuntimeError(f"{scrubbed(current)}: {scrubbed((cause.getMessage() or str(cause)) if cause is not None else str(e))}") from None
    finally:
        if connection is not None:
            connection.close()
    return len(todo)


def run(connection, statements: Iterable[str]) -> None:
    for s in statements:
        statement = connection.createStatement()
        try:
            statement.execute(s)
        finally:
            statement.close()


def apply_live(spark: SparkSession, address: str, target: Catalog, schemas: Iterable[str] = ("public",), allow_destructive: bool = False, dry_run: bool = False) -> dict:
    """Bring a live server to a declared schema: plan, check, run and look again.

    Returns the statements, how many ran, and what is still to do afterwards (nothing if it took).
    """
    current = live_catalog(spark, address, schemas)
    plan = lifecycle.migration(spark, current, target, allow_destructive=allow_destructive)
    if dry_run:
        return {"sql": plan["sql"], "applied": 0, "left": [f"{o['op']} {o['kind']} {o['key']}" for o in plan["ops"]]}
    done = execute(spark, address, plan["sql"])
    return {"sql": plan["sql"], "applied": done, "left": lifecycle.verify(spark, live_catalog(spark, address, schemas), target)}
