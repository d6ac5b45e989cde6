"""python -m sparkpact COMMAND: diff, plan, lint, check, drift, dump, describe, migrate and apply over
SQL sources (sql:path) and live servers (db:address, postgres://…, postgresql://…)."""

from __future__ import annotations

import argparse
import json
import sys

from sparkpact.plans import filters, lifecycle
from sparkpact.plans.checks import check
from sparkpact.plans.render import to_json
from sparkpact.sources.live import apply_live, live_catalog
from sparkpact.sources.loader import database_url, load


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkpact", description=__doc__)
    parser.add_argument("command", choices=["diff", "plan", "lint", "check", "drift", "dump", "describe", "migrate", "apply"])
    parser.add_argument("--from", dest="old", action="append", default=[], help="current schema: sql:path or db:address (repeat)")
    parser.add_argument("--to", dest="new", action="append", default=[], help="target schema: sql:path or db:address (repeat)")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--reverse", action="store_true")
    parser.add_argument("--zero-downtime", action="store_true")
    parser.add_argument("--allow-destructive", action="store_true")
    parser.add_argument("--include", action="append", default=[])
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--schema", action="append")
    parser.add_argument("--output", help="migrate: folder of numbered files; dump: folder of a split dump")
    parser.add_argument("--name", default="migration")
    parser.add_argument("--dry-run", action="store_true", help="apply: only say what would run")
    a = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from sparkpact.sources.catalog import Catalog

    spark = SparkSession.builder.appName("sparkpact").config("spark.ui.enabled", "false").getOrCreate()

    def side(sources: list[str]) -> Catalog:
        files, servers = [s for s in sources if not database_url(s)], [s for s in sources if database_url(s)]
        parts = [(s, live_catalog(spark, s, a.schema or ["public"])) for s in servers] + ([("files", load(files))] if files else [])
        return filters.filtered(Catalog.merged(parts), a.include, a.exclude, target_schemas=a.schema) if parts else Catalog()

    if a.command == "apply":
        if len(a.old) != 1 or not database_url(a.old[0]):
            parser.error("apply takes one live server as --from")
        out = apply_live(spark, a.old[0], side(a.new), a.schema or ["public"], a.allow_destructive, a.dry_run)
        print(json.dumps(out, indent=2) if a.json else "\n".join([*out["sql"], f"{out['applied']} statements run, {len(out['left'])} operations left"]))
        return int(bool(out["left"]) and not a.dry_run)
    old, new = side(a.old), side(a.new)
    if a.command in ("diff", "plan", "lint", "migrate"):
        out = lifecycle.migration(spark, old, new, a.reverse, a.zero_downtime, a.allow_destructive, check=a.command in ("plan", "migrate"))
        if a.command == "lint":
            print(json.dumps(out["lint"], indent=2) if a.json else "\n".join(f"{f['severity']}: {f['rule']} {f['key']}: {f['message']}" for f in out["lint"]))
            return int(any(f["severity"] == "error" for f in out["lint"]))
        if a.command == "migrate":
            print(lifecycle.write_migration(a.output or "migrations", a.name, out["sql"]))
        else:
            print(to_json(out["ops"]) if a.json else "\n".join(out["sql"]))
        return 0
    if a.command == "drift":
        report = lifecycle.drift(spark, new, old)
        print(json.dumps(report, indent=2) if a.json else "\n".join(report["differences"]) or "no drift")
        return int(report["has_drift"])
    if a.command == "check":
        found = [r.asDict() for r in check(spark, new).orderBy("rule", "key").collect()]
        print(json.dumps(found, indent=2) if a.json else "\n".join(f"{f['severity']}: {f['rule']} {f['key']} {f['detail']}" for f in found))
        return int(any(f["severity"] == "error" for f in found))
    if a.command == "describe":
        print(json.dumps([list(r) for r in new.rows()], indent=2))
        return 0
    if a.output:
        from pathlib import Path

        Path(a.output).mkdir(parents=True, exist_ok=True)
        for k, (name, statements) in enumerate(lifecycle.split_dump(new).items()):
            (Path(a.output) / f"{k:02d}_{name}.sql").write_text("\n".join(statements) + "\n")
    else:
        print("\n".join(lifecycle.dump(new)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
