"""Sources of schemas: SQL files, folders and globs, live tables, connection addresses."""

from __future__ import annotations

import glob
import os
import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkpact.sources.catalog import Catalog, from_dataframes
from sparkpact.sources.ddl import Reader, parse_ddl


def expand(source: str) -> list[str]:
    """SQL files of a path, folder (with what is below it) or glob: sorted, each once."""
    if os.path.isdir(source):
        found = glob.glob(os.path.join(source, "**", "*.sql"), recursive=True)
    elif any(c in source for c in "*?["):
        found = [f for f in glob.glob(source, recursive=True) if os.path.isfile(f)]
    else:
        found = [source]
    once = {os.path.realpath(f): f for f in sorted(found, reverse=True)}
    if not once:
        raise FileNotFoundError(f"no SQL files at {source}")
    return sorted(once.values())


def load_files(paths: Iterable[str]) -> Catalog:
    """One catalog of several files, in any order: declarations of all files are read first, and
    what names other objects (policies, owners, grants, comments) is attached at the end."""
    files: dict[str, str] = {}
    for source in paths:
        for f in expand(source):
            files.setdefault(os.path.realpath(f), f)
    readers: list[tuple[str, Reader]] = []
    for f in files.values():
        reader = Reader()
        with open(f, encoding="utf-8") as text:
            content = text.read()
        from sparkpact.functions.tokens import SqlError, statements

        try:
            for tokens in statements(content):
                reader.statement(tokens)
        except SqlError as e:
            raise SqlError(f"{f}: {e}") from e
        readers.append((f, reader))
    whole = Reader()
    whole.catalog = Catalog.merged((f, r.catalog) for f, r in readers)
    whole.later = [x for _, r in readers for x in r.later]
    whole.finish()
    return whole.catalog


def load(sources: Iterable[str]) -> Catalog:
    """Sources of the form sql:path, or drizzle:path of an ORM's configuration, which is exported first."""
    paths, exported = [], []
    for s in sources:
        kind, _, rest = s.partition(":")
        if kind == "sql":
            paths.append(rest)
        elif kind == "drizzle":
            exported.append((s, parse_ddl(export_schema(rest))))
        else:
            raise ValueError(f"unknown source {scrubbed(s)}; use sql:path, db:address, postgres:// or postgresql://")
    return load_files(paths) if not exported else Catalog.merged([*exported, *([("files", load_files(paths))] if paths else [])])


def export_schema(config: str) -> str:
    """The SQL that the ORM's own command line exports for a configuration file; it must be installed."""
    try:
        done = subprocess.run(["npx", "drizzle-kit", "export", "--config", config], capture_output=True, text=True, timeout=300, check=True)
    except FileNotFoundError:
        raise ValueError("npx is not installed; export the schema as SQL and give it as sql:path") from None
    except subprocess.CalledProcessError as e:
        raise ValueError(f"export of {config} failed: {scrubbed(e.stderr.strip()[-500:])}") from None
    return done.stdout


def load_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of the SQL files below a folder in any store that Spark reads."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").selectExpr("_metadata.file_path AS path", "value")


def live_tables(spark: SparkSession, database: str = "default") -> Catalog:
    """The catalog of a database's tables and views in Spark."""
    frames = {t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database) if not t.isTemporary}
    return from_dataframes(frames, database)


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> Catalog:
    return from_dataframes({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})


def database_url(text: str) -> str | None:
    """The connection address in db:…, postgres:// or postgresql://, or None."""
    if text.startswith("db:"):
        return text[3:]
    return text if text.startswith(("postgres://", "postgresql://")) else None


def scrubbed(text: str) -> str:
    """Text without the passwords of connection addresses."""
    text = re.sub(r"(\w+://[^:/?#\s]+):[^@\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)(password\s*=\s*)('[^']*'|\S+)", r"\1***", text)


def jdbc_relation(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A catalog query on a live server through JDBC (the driver jar must be on the class path)."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
