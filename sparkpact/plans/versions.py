"""Version schemas: views of one version's names over the physical tables."""

from __future__ import annotations

from sparkpact.plans.planner import version_mappings
from sparkpact.plans.render import ident, role
from sparkpact.sources.catalog import Catalog


def version_sql(catalog: Catalog, schema: str, version: str, renames: dict[str, dict[str, str]] | None = None, security_invoker: bool = True, owner: str | None = None) -> list[str]:
    """CREATE SCHEMA schema_version and a view for each table; renames: {table: {virtual: physical}}."""
    name = f"{schema}_{version}"
    out = [f"CREATE SCHEMA IF NOT EXISTS {ident(name)};"]
    for t in sorted(catalog.of("table"), key=lambda o: o.key):
        if t.schema != schema:
            continue
        mapped = version_mappings([c.name for c in catalog.of("column", t.key)], (renames or {}).get(t.name, {}))
        cells = ", ".join(ident(p) if v == p else f"{ident(p)} AS {ident(v)}" for v, p in mapped)
        options = " WITH (security_invoker = true)" if security_invoker else ""
        out.append(f"CREATE OR REPLACE VIEW {ident(name)}.{ident(t.name)}{options} AS SELECT {cells} FROM {ident(schema)}.{ident(t.name)};")
        if owner:
            out.append(f"ALTER VIEW {ident(name)}.{ident(t.name)} OWNER TO {role(owner)};")
    return out


def drop_version_sql(schema: str, version: str) -> list[str]:
    return [f"DROP SCHEMA IF EXISTS {ident(f'{schema}_{version}')} CASCADE;"]
