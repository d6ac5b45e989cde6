"""Operations as SQL text and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

SIMPLE_ROLE = re.compile(r"[a-z_][a-z0-9_]*\Z")
TYPE_NAME = re.compile(r"^(SETOF )?([a-z_]\w*)\.(\w+)((?:\[\])*)$")


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def path(key: str) -> str:
    return ".".join(ident(p) for p in key.split("."))


def role(name: str) -> str:
    return name if SIMPLE_ROLE.match(name) or name in ("public", "CURRENT_ROLE") else ident(name)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def type_sql(name: str) -> str:
    m = TYPE_NAME.match(name)
    return f"{m[1] or ''}{ident(m[2])}.{ident(m[3])}{m[4]}" if m else name


def signature(key: str) -> str:
    """schema.name(types) with the name quoted."""
    name, _, types = key.partition("(")
    return f"{path(name)}({types}"


def columns(names: Iterable[str]) -> str:
    return ", ".join(map(ident, names))


def body(text: str) -> str:
    """A dollar-quoted body, with a tag that the body does not hold."""
    tag, k = "$$", 0
    while tag in text:
        k += 1
        tag = f"$body{k}$"
    return f"{tag}{text}{tag}"


def column_sql(name: str, a: dict) -> str:
    out = f"{ident(name)} {type_sql(a['data_type'])}"
    if a.get("collation"):
        out += f" COLLATE {path(a['collation'].lstrip('.'))}"
    if a.get("generated"):
        return out + f" GENERATED ALWAYS AS ({a['generated']}) STORED" + ("" if a.get("nullable", True) else " NOT NULL")
    if a.get("identity"):
        return out + f" GENERATED {a['identity'].upper()} AS IDENTITY"
    if a.get("default") is not None:
        out += f" DEFAULT {a['default']}"
    return out + ("" if a.get("nullable", True) else " NOT NULL")


def bound_sql(b: dict) -> str:
    if b["kind"] == "default":
        return "DEFAULT"
    if b["kind"] == "list":
        return f"FOR VALUES IN ({', '.join(b['values'])})"
    if b["kind"] == "range":
        return f"FOR VALUES FROM ({', '.join(b['from'])}) TO ({', '.join(b['to'])})"
    return f"FOR VALUES WITH (MODULUS {b['modulus']}, REMAINDER {b['remainder']})"


def sequence_options(a: dict) -> str:
    out = []
    if a.get("data_type"):
        out.append(f"AS {a['data_type']}")
    for key, word in (("start", "START WITH"), ("increment", "INCREMENT BY"), ("min", "MINVALUE"), ("max", "MAXVALUE"), ("cache", "CACHE")):
        if a.get(key) is not None:
            out.append(f"{word} {a[key]}")
    out.append("CYCLE" if a.get("cycle") else "NO CYCLE")
    return " ".join(out)


def function_sql(key: str, a: dict) -> str:
    args = ", ".join(" ".join(x for x in ("" if p["mode"] == "IN" else p["mode"], ident(p["name"]) if p["name"] else "", type_sql(p["type"]), f"DEFAULT {p['default']}" if p["default"] else "") if x) for p in a["args"])
    lines = [f"CREATE OR REPLACE FUNCTION {path(key.partition('(')[0])}({args})", f"RETURNS {type_sql(a['return_type'])}", f"LANGUAGE {a['language']} {a['volatility']} SECURITY {a['security']}"]
    lines += [f"SET {k} = {v}" for k, v in a.get("config") or []]
    return "\n".join([*lines, f"AS {body(a['body'])};"])


def trigger_sql(name: str, table: str, a: dict) -> str:
    events = " OR ".join(f"UPDATE OF {columns(a['update_columns'])}" if e == "UPDATE" and a.get("update_columns") else e for e in a["events"])
    out = f"CREATE {'CONSTRAINT ' if a.get('constraint') else ''}TRIGGER {ident(name)} {a['timing']} {events} ON {path(table)}"
    if a.get("constraint"):
        out += f" {'DEFERRABLE' if a.get('deferrable') else 'NOT DEFERRABLE'} INITIALLY {'DEFERRED' if a.get('initially_deferred') else 'IMMEDIATE'}"
    tables = [f"{side.upper()} TABLE AS {ident(a[f'{side}_table'])}" for side in ("old", "new") if a.get(f"{side}_table")]
    if tables:
        out += " REFERENCING " + " ".join(tables)
    out += f" FOR EACH {'ROW' if a['for_each_row'] else 'STATEMENT'}"
    if a.get("when"):
        out += f" WHEN ({a['when']})"
    return out + f" EXECUTE FUNCTION {path(a['function'])}({', '.join(a.get('args') or [])});"


ENABLE = {"ORIGIN": "ENABLE TRIGGER", "DISABLED": "DISABLE TRIGGER", "REPLICA": "ENABLE REPLICA TRIGGER", "ALWAYS": "ENABLE ALWAYS TRIGGER"}


def policy_sql(name: str, table: str, a: dict) -> str:
    out = f"CREATE POLICY {ident(name)} ON {path(table)} FOR {a['command']} TO {', '.join(map(role, a['roles']))}"
    if a.get("using"):
        out += f" USING ({a['using']})"
    return out + (f" WITH CHECK ({a['check']})" if a.get("check") else "") + ";"


def enum_steps(key: str, old: list[str], new: list[str]) -> list[str]:
    """New values, AFTER the one before, or BEFORE the next if first. Values that went or moved
    cannot be altered in place: a comment says so."""
    out = []
    for k, v in enumerate(new):
        if v not in old:
            place = f" AFTER {literal(new[k - 1])}" if k else (f" BEFORE {literal(new[1])}" if len(new) > 1 and new[1] in old else "")
            out.append(f"ALTER TYPE {path(key)} ADD VALUE {literal(v)}{place};")
    if [v for v in old if v in new] != [v for v in new if v in old] or set(old) - set(new):
        out.append(f"-- values of {key} were removed or reordered: {', '.join(old)} -> {', '.join(new)}; the type must be rebuilt")
    return out


def option_steps(old: dict, new: dict, head: str, on: str, grantee: str) -> list[str]:
    """GRANT and REVOKE GRANT OPTION FOR, privilege by privilege."""
    have, want, could, can = (set(side.get(k) or []) for k in ("privileges", "grantable") for side in (old, new))
    out = []
    for privileges, verb, tail in ((could & want - can, f"{head}REVOKE GRANT OPTION FOR", f"{on} FROM {grantee};"), (want - have - can, f"{head}GRANT", f"{on} TO {grantee};"), (can - could, f"{head}GRANT", f"{on} TO {grantee} WITH GRANT OPTION;")):
        if privileges:
            out.append(f"{verb} {', '.join(sorted(privileges))}{tail}")
    return out


def sql_of(op: dict) -> list[str]:
    """The statements of one operation."""
    kind, key, name, parent = op["kind"], op["key"], op["name"], op["parent"] or ""
    a, old, changed = op["new"] or {}, op["old"] or {}, op.get("changed") or []
    table = f"ALTER TABLE {path(parent)}" if parent else ""
    what = op["op"]
    if what == "backfill":
        return [f"-- backfill {key} before it becomes NOT NULL"]
    if kind == "schema":
        return [f"CREATE SCHEMA IF NOT EXISTS {ident(name)};"] if what == "create" else [f"DROP SCHEMA IF EXISTS {ident(name)} CASCADE;"]
    if kind == "extension":
        options = (f" SCHEMA {ident(a['schema'])}" if a.get("schema") else "") + (f" VERSION {literal(str(a['version']))}" if a.get("version") else "")
        return [f"CREATE EXTENSION IF NOT EXISTS {ident(name)}{' WITH' if options else ''}{options};"] if what == "create" else [f"DROP EXTENSION IF EXISTS {ident(name)};"] if what == "drop" else [f"ALTER EXTENSION {ident(name)} UPDATE" + (f" TO {literal(str(a['version']))}" if a.get("version") else "") + ";"]
    if kind == "server":
        options = ", ".join(f"{k} {literal(v)}" for k, v in (a.get("options") or {}).items())
        if what == "create":
            return [f"CREATE SERVER {ident(name)}" + (f" TYPE {literal(a['type'])}" if a.get("type") else "") + (f" VERSION {literal(str(a['version']))}" if a.get("version") else "") + f" FOREIGN DATA WRAPPER {ident(a['fdw'])}" + (f" OPTIONS ({options})" if options else "") + ";"]
        if what == "drop":
            return [f"DROP SERVER {ident(name)};"]
        was = old.get("options") or {}
        steps = [f"{'SET' if k in was else 'ADD'} {k} {literal(v)}" for k, v in (a.get("options") or {}).items() if was.get(k) != v] + [f"DROP {k}" for k in was if k not in (a.get("options") or {})]
        return [f"ALTER SERVER {ident(name)}" + (f" VERSION {literal(str(a['version']))}" if "version" in changed and a.get("version") else "") + (f" OPTIONS ({', '.join(steps)})" if steps else "") + ";"]
    if kind == "enum":
        return [f"CREATE TYPE {path(key)} AS ENUM ({', '.join(map(literal, a['values']))});"] if what == "create" else [f"DROP TYPE {path(key)};"] if what == "drop" else enum_steps(key, old["values"], a["values"])
    if kind == "domain":
        if what == "drop":
            return [f"DROP DOMAIN {path(key)};"]
        if what == "create":
            checks = "".join((f" CONSTRAINT {ident(c['name'])}" if c.get("name") else "") + f" CHECK ({c['expression']})" for c in a.get("checks") or [])
            return [f"CREATE DOMAIN {path(key)} AS {type_sql(a['data_type'])}" + (f" DEFAULT {a['default']}" if a.get("default") else "") + (" NOT NULL" if a.get("not_null") else "") + checks + ";"]
        head, out = f"ALTER DOMAIN {path(key)}", []
        if "default" in changed:
            out.append(f"{head} SET DEFAULT {a['default']};" if a.get("default") else f"{head} DROP DEFAULT;")
        if "not_null" in changed:
            out.append(f"{head} {'SET' if a.get('not_null') else 'DROP'} NOT NULL;")
        if "checks" in changed:
            have, want = old.get("checks") or [], a.get("checks") or []
            out += [f"{head} DROP CONSTRAINT {ident(c['name'])};" for c in have if c not in want and c.get("name")]
            out += [f"{head} ADD" + (f" CONSTRAINT {ident(c['name'])}" if c.get("name") else "") + f" CHECK ({c['expression']});" for c in want if c not in have]
        if {"data_type", "collation"} & {*changed}:
            out.append(f"-- the base type of {key} cannot be altered in place: {old.get('data_type')} -> {a.get('data_type')}")
        return out
    if kind == "sequence":
        if what == "create":
            return [f"CREATE SEQUENCE {path(key)} {sequence_options(a)};"]
        if what == "drop":
            return [f"DROP SEQUENCE {path(key)};"]
        out = []
        if changed == ["owned_by"] or "owned_by" in changed:
            out.append(f"ALTER SEQUENCE {path(key)} OWNED BY {path(a['owned_by']) if a.get('owned_by') else 'NONE'};")
        if {*changed} - {"owned_by"}:
            out.insert(0, f"ALTER SEQUENCE {path(key)} {sequence_options({k: a.get(k) for k in changed} | {'cycle': a.get('cycle')})};")
        return out
    if kind == "function":
        return [f"DROP FUNCTION {signature(key)};"] if what == "drop" else [function_sql(key, a)]
    if kind == "aggregate":
        if what == "drop":
            return [f"DROP AGGREGATE {signature(key) if not key.endswith('()') else signature(key[:-1] + '*)')};"]
        parts = [f"SFUNC = {path(a['sfunc'])}", f"STYPE = {a['stype']}"] + ([f"FINALFUNC = {path(a['finalfunc'])}"] if a.get("finalfunc") else []) + ([f"INITCOND = {literal(str(a['initcond']))}"] if a.get("initcond") is not None else []) + ([f"PARALLEL = {a['parallel']}"] if a.get("parallel", "UNSAFE") != "UNSAFE" else [])
        return [f"CREATE AGGREGATE {signature(key) if not key.endswith('()') else signature(key[:-1] + '*)')} ({', '.join(parts)});"]
    if kind == "table":
        if what == "drop":
            return [f"DROP TABLE {path(key)};"]
        out = []
        if what == "create":
            by = a.get("partition_by")
            cells = ",\n  ".join(column_sql(n, c) for n, c in op.get("columns") or [])
            out.append(f"CREATE TABLE {path(key)} (" + (f"\n  {cells}\n" if cells else "") + ")" + (f" PARTITION BY {by['strategy'].upper()} ({', '.join(by['columns'])})" if by else "") + ";")
        elif "partition_by" in changed:
            out.append(f"-- how {key} is partitioned cannot be altered in place")
        for attr, words in (("rls", "ROW LEVEL SECURITY"), ("force_rls", "ROW LEVEL SECURITY")):
            if bool(a.get(attr)) != bool(old.get(attr)):
                verb = ("ENABLE" if a.get(attr) else "DISABLE") if attr == "rls" else ("FORCE" if a.get(attr) else "NO FORCE")
                out.append(f"ALTER TABLE {path(key)} {verb} {words};")
        return out
    if kind == "partition":
        return [f"DROP TABLE {path(key)};"] if what == "drop" else [f"CREATE TABLE {path(key)} PARTITION OF {path(a['parent'])} {bound_sql(a['bound'])};"]
    if kind == "column":
        if what == "create":
            return [f"{table} ADD COLUMN {column_sql(name, a)};"]
        if what == "drop":
            return [f"{table} DROP COLUMN {ident(name)} CASCADE;"]
        out, head = [], f"{table} ALTER COLUMN {ident(name)}"
        if "data_type" in changed:
            if old.get("default") is not None:
                out.append(f"{head} DROP DEFAULT;")
            out.append(f"{head} TYPE {type_sql(a['data_type'])} USING {ident(name)}::{type_sql(a['data_type'])};")
        if "default" in changed or "data_type" in changed and a.get("default") is not None:
            out.append(f"{head} SET DEFAULT {a['default']};" if a.get("default") is not None else f"{head} DROP DEFAULT;")
        if "nullable" in changed:
            out.append(f"{head} {'DROP' if a.get('nullable', True) else 'SET'} NOT NULL;")
        if "identity" in changed:
            now, was = a.get("identity"), old.get("identity")
            out.append(f"{head} DROP IDENTITY;" if not now else f"{head} SET GENERATED {now.upper()};" if was else f"{head} ADD GENERATED {now.upper()} AS IDENTITY;")
        return out
    if kind == "primary_key":
        constraint = (a or old).get("constraint") or f"{parent.split('.')[-1]}_pkey"
        return [f"{table} DROP CONSTRAINT {ident(constraint)};"] if what == "drop" else [f"{table} ADD CONSTRAINT {ident(constraint)} PRIMARY KEY ({columns(a['columns'])});"]
    if kind == "index":
        own = a or old
        if what == "drop":
            return [f"{table} DROP CONSTRAINT {ident(name)};"] if own.get("is_constraint") else [f"DROP INDEX {ident(op['schema'])}.{ident(name)};"]
        if own.get("is_constraint"):
            return [f"{table} ADD CONSTRAINT {ident(name)} UNIQUE ({columns(a['columns'])});"]
        return [f"CREATE {'UNIQUE ' if a.get('unique') else ''}INDEX {ident(name)} ON {path(parent)} USING {a['method']} ({', '.join(a['columns'])})" + (f" INCLUDE ({columns(a['include'])})" if a.get("include") else "") + (f" WHERE {a['predicate']}" if a.get("predicate") else "") + ";"]
    if kind in ("foreign_key", "check", "exclusion"):
        if what == "drop":
            return [f"{table} DROP CONSTRAINT {ident(name)};"]
        head = f"{table} ADD CONSTRAINT {ident(name)}"
        if kind == "check":
            return [f"{head} CHECK ({a['expression']});"]
        later = (" DEFERRABLE" if a.get("deferrable") else "") + (" INITIALLY DEFERRED" if a.get("initially_deferred") else "")
        if kind == "foreign_key":
            actions = "".join(f" ON {e.upper()} {a[f'on_{e}']}" for e in ("delete", "update") if a.get(f"on_{e}", "NO ACTION") != "NO ACTION")
            return [f"{head} FOREIGN KEY ({columns(a['columns'])}) REFERENCES {path(a['ref_table'])} ({columns(a['ref_columns'])}){actions}{later};"]
        elements = ", ".join(f"{e['expr']} WITH {e['op']}" for e in a["elements"])
        return [f"{head} EXCLUDE USING {a['method']} ({elements})" + (f" WHERE ({a['where']})" if a.get("where") else "") + later + ";"]
    if kind == "view":
        material = "MATERIALIZED " if (a or old).get("materialized") else ""
        was = "MATERIALIZED " if old.get("materialized") else ""
        if what == "drop":
            return [f"DROP {was}VIEW {path(key)};"]
        names = f" ({columns(a['columns'])})" if a.get("columns") else ""
        if material:
            return ([f"DROP {was}VIEW {path(key)};"] if what == "alter" else []) + [f"CREATE MATERIALIZED VIEW {path(key)}{names} AS {a['query']};"]
        return ([f"DROP {was}VIEW {path(key)};"] if was and what == "alter" else []) + [f"CREATE OR REPLACE VIEW {path(key)}{names} AS {a['query']};"]
    if kind == "trigger":
        if what == "drop":
            return [f"DROP TRIGGER {ident(name)} ON {path(parent)};"]
        mode = [f"{table} {ENABLE[a.get('enabled', 'ORIGIN')]} {ident(name)};"]
        return mode if what == "alter" else [trigger_sql(name, parent, a)] + (mode if a.get("enabled", "ORIGIN") != "ORIGIN" else [])
    if kind == "policy":
        if what == "drop":
            return [f"DROP POLICY {ident(name)} ON {path(parent)};"]
        gone = [k for k in ("using", "check") if k in changed and not a.get(k)]
        if what == "create":
            return [policy_sql(name, parent, a)]
        if gone or "command" in changed:  # neither can be altered: the policy is made anew
            return [f"DROP POLICY {ident(name)} ON {path(parent)};", policy_sql(name, parent, a)]
        out = f"ALTER POLICY {ident(name)} ON {path(parent)}" + (f" TO {', '.join(map(role, a['roles']))}" if "roles" in changed else "")
        out += f" USING ({a['using']})" if "using" in changed else ""
        return [out + (f" WITH CHECK ({a['check']})" if "check" in changed else "") + ";"]
    if kind == "owner":
        if what == "drop":
            return []
        on_kind, _, on_key = a["on"].partition(" ")
        word = {"enum": "TYPE", "partition": "TABLE"}.get(on_kind, on_kind.upper())
        return [f"ALTER {word} {signature(on_key) if '(' in on_key else path(on_key)} OWNER TO {role(a['owner'])};"]
    if kind == "grant":
        own = a or old
        on_kind, _, on_key = own["on"].partition(" ")
        word = {"table": "TABLE", "view": "TABLE", "partition": "TABLE", "enum": "TYPE", "domain": "TYPE"}.get(on_kind, on_kind.upper())
        target = f"{word} {signature(on_key) if '(' in on_key else path(on_key)}"
        have, want, out = set(old.get("privileges") or []), set(a.get("privileges") or []), []
        if have - want:
            out.append(f"REVOKE {', '.join(sorted(have - want))} ON {target} FROM {role(own['grantee'])};")
        return out + option_steps(old, a, "", f" ON {target}", role(own["grantee"]))
    if kind == "default_privilege":
        own = a or old
        head = "ALTER DEFAULT PRIVILEGES" + ("" if own["role"] == "CURRENT_ROLE" else f" FOR ROLE {role(own['role'])}") + (f" IN SCHEMA {ident(own['in_schema'])}" if own.get("in_schema") else "")
        have, want = set(old.get("privileges") or []), set(a.get("privileges") or [])
        out = [f"{head} REVOKE {', '.join(sorted(have - want))} ON {own['object_type'].upper()} FROM {role(own['grantee'])};"] if have - want else []
        return out + option_steps(old, a, f"{head} ", f" ON {own['object_type'].upper()}", role(own["grantee"]))
    if kind == "comment":
        on_kind, _, on_key = (a or old)["on"].partition(" ")
        if on_kind in ("trigger", "policy", "constraint"):
            domain = on_key.startswith("domain ")
            host, _, own_name = on_key.removeprefix("domain ").rpartition(".")
            target = f"{ident(own_name)} ON {'DOMAIN ' if domain else ''}{path(host)}"
        else:
            target = signature(on_key) if "(" in on_key else path(on_key)
        return [f"COMMENT ON {on_kind.upper()} {target} IS {literal(a['comment']) if what != 'drop' else 'NULL'};"]
    raise ValueError(f"cannot render {what} {kind}")


def with_inline_columns(ops: list[dict]) -> list[dict]:
    """Columns of new tables become part of CREATE TABLE."""
    new = {o["key"] for o in ops if o["op"] == "create" and o["kind"] == "table"}
    inline: dict[str, list] = {k: [] for k in new}
    rest = []
    for o in ops:
        if o["op"] == "create" and o["kind"] == "column" and o["parent"] in new:
            inline[o["parent"]].append((o["name"], o["new"]))
        else:
            rest.append(o)
    return [{**o, "columns": inline[o["key"]]} if o["op"] == "create" and o["kind"] == "table" else o for o in rest]


def to_sql(ops: list[dict]) -> list[str]:
    return [s for o in with_inline_columns(ops) for s in sql_of(o)]


def to_json(ops: list[dict], locks: bool = True) -> str:
    from sparkpact.plans.lint import lock_of

    return json.dumps([{k: o[k] for k in ("op", "kind", "key", "changed")} | {"sql": sql_of(o)} | ({"lock": lock_of(o)} if locks else {}) for o in with_inline_columns(ops)], indent=2)
