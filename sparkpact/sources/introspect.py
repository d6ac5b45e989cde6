"""Introspection: catalog rows out of a live server's system relations, as Spark plans.

The system relations (pg_class, pg_attribute, …) are DataFrames, read through JDBC or from files,
with server-rendered expressions as text columns (SOURCES says which). Each scan joins them into
rows of the catalog relation, so that what is live and what is declared meet in one diff. What an
extension owns is left out by an anti join; schemas are filtered before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.functions.tokens import text_of, tokenize
from sparkpact.functions.types import canonical_type
from sparkpact.sources.catalog import SCHEMA, Catalog, Obj, parsed
from sparkpact.sources.ddl import Cursor, Reader
from sparkpact.sources.loader import jdbc_relation

#: Types of a routine's arguments, as its signature lists them.
SIGNATURE = "(SELECT coalesce(string_agg(format_type(u.t, NULL), ', ' ORDER BY u.o), '') FROM unnest(p.proargtypes) WITH ORDINALITY u(t, o))"

#: What is read from the server for each relation: names, with expressions rendered as text.
SOURCES = {
    "namespaces": "SELECT oid, nspname, nspacl::text[] AS acl, pg_get_userbyid(nspowner) AS owner FROM pg_namespace",
    "classes": "SELECT oid, relname, relnamespace, relkind::text AS relkind, relrowsecurity, relforcerowsecurity, relispartition, pg_get_expr(relpartbound, oid) AS bound, pg_get_partkeydef(oid) AS partkey, CASE WHEN relkind IN ('v', 'm') THEN pg_get_viewdef(oid) END AS viewdef, relacl::text[] AS acl, pg_get_userbyid(relowner) AS owner FROM pg_class",
    "attributes": "SELECT a.attrelid, a.attname, a.attnum, a.attnotnull, a.attgenerated::text AS attgenerated, a.attidentity::text AS attidentity, format_type(a.atttypid, a.atttypmod) AS type, pg_get_expr(d.adbin, d.adrelid) AS expr FROM pg_attribute a LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum WHERE a.attnum > 0 AND NOT a.attisdropped",
    "indexes": "SELECT i.indexrelid, i.indrelid, i.indisunique, i.indisprimary, m.amname, pg_get_expr(i.indpred, i.indrelid) AS predicate, ARRAY(SELECT pg_get_indexdef(i.indexrelid, k, true) FROM generate_series(1, i.indnkeyatts) k) AS columns FROM pg_index i JOIN pg_class c ON c.oid = i.indexrelid JOIN pg_am m ON m.oid = c.relam",
    "constraints": "SELECT oid, conname, conrelid, contypid, contype::text AS contype, conkey, confrelid, confkey, confupdtype::text AS confupdtype, confdeltype::text AS confdeltype, conindid, pg_get_expr(conbin, conrelid) AS expr, condeferrable, condeferred, CASE contype WHEN 'x' THEN pg_get_constraintdef(oid) END AS definition FROM pg_constraint",
    "types": "SELECT t.oid, t.typname, t.typnamespace, t.typtype::text AS typtype, format_type(t.typbasetype, t.typtypmod) AS basetype, t.typnotnull, t.typdefault, t.typacl::text[] AS acl, pg_get_userbyid(t.typowner) AS owner FROM pg_type t",
    "enum_labels": "SELECT enumtypid, enumsortorder, enumlabel FROM pg_enum",
    "inherits": "SELECT inhrelid, inhparent FROM pg_inherits",
    "policies": "SELECT oid, polname, polrelid, polcmd::text AS polcmd, ARRAY(SELECT rolname::text FROM pg_roles WHERE oid = ANY (polroles)) AS roles, pg_get_expr(polqual, polrelid) AS using_expr, pg_get_expr(polwithcheck, polrelid) AS check_expr FROM pg_policy",
    "triggers": "SELECT t.oid, t.tgname, t.tgrelid, t.tgtype, t.tgenabled::text AS tgenabled, n.nspname || '.' || p.proname AS function, t.tgattr::int2[]::int[] AS columns, CASE WHEN t.tgnargs > 0 THEN (string_to_array(encode(t.tgargs, 'escape'), '\\000'))[1:t.tgnargs] END AS args, substring(pg_get_triggerdef(t.oid) FROM 'WHEN \\((.*)\\) EXECUTE') AS when_expr, t.tgoldtable AS old_table, t.tgnewtable AS new_table, t.tgconstraint <> 0 AS is_constraint, t.tgdeferrable, t.tginitdeferred FROM pg_trigger t JOIN pg_proc p ON p.oid = t.tgfoid JOIN pg_namespace n ON n.oid = p.pronamespace WHERE NOT t.tgisinternal",
    "procedures": f"SELECT p.oid, p.proname, p.pronamespace, p.prokind::text AS prokind, {SIGNATURE} AS types, pg_get_function_arguments(p.oid) AS arguments, pg_get_function_result(p.oid) AS result, l.lanname, p.prosrc, p.provolatile::text AS provolatile, p.prosecdef, p.proconfig AS config, p.proparallel::text AS proparallel, p.proacl::text[] AS acl, pg_get_userbyid(p.proowner) AS owner FROM pg_proc p JOIN pg_language l ON l.oid = p.prolang",
    "aggregates": "SELECT a.aggfnoid::oid AS oid, tn.nspname || '.' || t.proname AS sfunc, format_type(a.aggtranstype, NULL) AS stype, fn.nspname || '.' || f.proname AS finalfunc, a.agginitval AS initcond FROM pg_aggregate a JOIN pg_proc t ON t.oid = a.aggtransfn JOIN pg_namespace tn ON tn.oid = t.pronamespace LEFT JOIN pg_proc f ON f.oid = a.aggfinalfn LEFT JOIN pg_namespace fn ON fn.oid = f.pronamespace",
    "sequences": "SELECT seqrelid, format_type(seqtypid, NULL) AS type, seqstart, seqincrement, seqmin, seqmax, seqcycle, seqcache FROM pg_sequence",
    "extensions": "SELECT e.oid, e.extname, e.extversion, n.nspname FROM pg_extension e JOIN pg_namespace n ON n.oid = e.extnamespace",
    "servers": "SELECT s.oid, s.srvname, s.srvtype, s.srvversion, f.fdwname, s.srvoptions AS options, pg_get_userbyid(s.srvowner) AS owner FROM pg_foreign_server s JOIN pg_foreign_data_wrapper f ON f.oid = s.srvfdw",
    "default_acls": "SELECT r.rolname AS role, n.nspname, d.defaclobjtype::text AS objtype, d.defaclacl::text[] AS acl FROM pg_default_acl d JOIN pg_roles r ON r.oid = d.defaclrole LEFT JOIN pg_namespace n ON n.oid = d.defaclnamespace",
    "rules": "SELECT rulename, ev_class FROM pg_rewrite WHERE rulename <> '_RETURN'",
    "owned_by_extensions": "SELECT objid FROM pg_depend WHERE deptype = 'e'",
    "comments": "SELECT objoid, classoid::regclass::text AS catalog, objsubid, description FROM pg_description",
    "sequence_owners": "SELECT objid AS seqrelid, refobjid AS relid, refobjsubid AS attnum FROM pg_depend WHERE deptype = 'a' AND refobjsubid > 0",
}

# Letters of access lists, referential actions, volatility, policy commands and the like.
PRIVILEGES = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "D": "TRUNCATE", "x": "REFERENCES", "t": "TRIGGER", "U": "USAGE", "C": "CREATE", "X": "EXECUTE"}
ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
VOLATILITY = {"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}
PARALLEL = {"u": "UNSAFE", "r": "RESTRICTED", "s": "SAFE"}
COMMANDS = {"*": "ALL", "r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE"}
MODES = {"O": "ORIGIN", "D": "DISABLED", "R": "REPLICA", "A": "ALWAYS"}
DEFAULT_KINDS = {"r": "tables", "S": "sequences", "f": "functions", "T": "types", "n": "schemas"}
RELATION_KINDS = {"r": "table", "p": "table", "v": "view", "m": "view", "S": "sequence", "i": "index"}
#: Bits of a trigger's type.
EVENT_BITS = ((4, "INSERT"), (8, "DELETE"), (16, "UPDATE"), (32, "TRUNCATE"))


def lookup(values: dict[str, str], column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def read_sources(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    return {name: jdbc_relation(spark, url, query, **options) for name, query in SOURCES.items()}


ROW = "'{kind}' AS kind, {key} AS key, {schema} AS schema, {parent} AS parent, {name} AS name, map_filter(map({attrs}), (k, v) -> v IS NOT NULL) AS attrs"


def row(row_kind: str, row_schema: str, row_name: str, row_parent: str = "''", /, **attrs: str) -> str:
    key = f"concat({row_parent}, '.', {row_name})" if row_parent != "''" else f"concat({row_schema}, '.', {row_name})" if row_schema != "''" else row_name
    cells = ", ".join(f"'{k}', cast({v} AS string)" for k, v in attrs.items()) or "'', cast(NULL AS string)"
    return ROW.format(kind=row_kind, key=key, schema=row_schema, parent=row_parent, name=row_name, attrs=cells)


def privileges_of(rows: str) -> str:
    """(subject, grantee, privileges, grantable) of rows (subject, acl, owner, implied): items of
    access lists by grantee. Left out: the owner's own, and what everybody has by default (implied)."""
    letters = "regexp_extract_all(split_part(split_part(item, '=', 2), '/', 1), '([a-zA-Z][*]?)', 1)"
    grantee = "coalesce(nullif(replace(split_part(item, '=', 1), '\"', ''), ''), 'public')"
    each = f"SELECT subject, {grantee} AS grantee, owner, implied, {lookup(PRIVILEGES, 'substring(p, 1, 1)')} AS privilege, substring(p, 2, 1) = '*' AS option FROM ({rows}) LATERAL VIEW explode(acl) x AS item LATERAL VIEW explode({letters}) y AS p"
    return f"SELECT subject, grantee, array_sort(collect_set(privilege)) AS privileges, array_sort(collect_set(if(option, privilege, NULL))) AS grantable FROM ({each}) WHERE grantee <> owner AND privilege IS NOT NULL AND NOT (grantee = 'public' AND privilege <=> implied AND NOT option) GROUP BY subject, grantee"


def grants(family: str, rows: str) -> str:
    on = f"concat('{family} ', subject)"
    return "SELECT " + row("grant", "''", f"concat({on}, ' to ', grantee)", on=on, grantee="grantee", privileges="to_json(privileges)", grantable="to_json(grantable)") + f" FROM ({privileges_of(rows)})"


def comments(on: str, source: str, catalog: str, where: str = "true") -> str:
    return "SELECT " + row("comment", "''", on, on=on, comment="d.description") + f" FROM {{comments}} d JOIN {source} WHERE d.catalog = '{catalog}' AND {where}"


def owners(on: str, source: str) -> str:
    return "SELECT " + row("owner", "''", on, on=on, owner="owner") + f" FROM {source}"


SIGNED = "concat(schema, '.', proname, '(', types, ')')"

#: Scans over the sources; rel, typ and fun are the relations, types and routines of managed schemas.
SCANS = {
    "schemas": f"SELECT {row('schema', chr(39) * 2, 'nspname')} FROM {{namespaces}} WHERE array_contains({{schemas}}, nspname)",
    "extensions": f"SELECT {row('extension', chr(39) * 2, 'extname', version='extversion', schema='nspname')} FROM {{extensions}}",
    "servers": f"SELECT {row('server', chr(39) * 2, 'srvname', fdw='fdwname', type='srvtype', version='srvversion', options='''to_json(map_from_entries(transform(coalesce(options, array()), o -> struct(split_part(o, '=', 1), substring(o, instr(o, '=') + 1)))))''')} FROM {{servers}}",
    "enums": "SELECT "
    + row("enum", "schema", "typname", values="to_json(values)")
    + " FROM (SELECT t.schema, t.typname, transform(array_sort(collect_list(struct(e.enumsortorder, e.enumlabel))), x -> x.enumlabel) AS values FROM {typ} t JOIN {enum_labels} e ON e.enumtypid = t.oid WHERE t.typtype = 'e' GROUP BY t.schema, t.typname)",
    "domains": "SELECT "
    + row("domain", "schema", "typname", data_type="basetype", not_null="typnotnull", default="typdefault", checks="to_json(checks)")
    + " FROM (SELECT t.schema, t.typname, t.basetype, t.typnotnull, t.typdefault, transform(array_sort(collect_list(if(c.oid IS NULL, NULL, struct(c.conname, c.expr)))), x -> struct(x.conname AS name, x.expr AS expression)) AS checks FROM {typ} t LEFT JOIN {constraints} c ON c.contypid = t.oid AND c.contype = 'c' WHERE t.typtype = 'd' GROUP BY ALL)",
    "tables": "SELECT " + row("table", "schema", "relname", rls="relrowsecurity", force_rls="relforcerowsecurity", partkey="partkey") + " FROM {rel} WHERE relkind IN ('r', 'p') AND NOT relispartition",
    "partitions": "SELECT " + row("partition", "c.schema", "c.relname", parent="concat(p.schema, '.', p.relname)", bound="c.bound") + " FROM {rel} c JOIN {inherits} i ON i.inhrelid = c.oid JOIN {rel} p ON p.oid = i.inhparent WHERE c.relispartition AND c.relkind IN ('r', 'p')",
    "columns": "SELECT "
    + row("column", "r.schema", "a.attname", "concat(r.schema, '.', r.relname)", data_type="a.type", nullable="NOT a.attnotnull", default="if(a.attgenerated = '', a.expr, NULL)", generated="if(a.attgenerated = 's', a.expr, NULL)", identity="CASE a.attidentity WHEN 'a' THEN 'always' WHEN 'd' THEN 'by default' END")
    + " FROM {attributes} a JOIN {rel} r ON r.oid = a.attrelid WHERE r.relkind IN ('r', 'p') AND NOT r.relispartition",
    "primary_keys": "SELECT "
    + row("primary_key", "schema", "'primary_key'", "concat(schema, '.', relname)", columns="to_json(columns)", constraint="conname")
    + " FROM (SELECT r.schema, r.relname, c.conname, transform(array_sort(collect_list(struct(c.pos, a.attname))), x -> x.attname) AS columns FROM (SELECT conrelid, conname, posexplode(conkey) AS (pos, num) FROM {constraints} WHERE contype = 'p') c JOIN {rel} r ON r.oid = c.conrelid JOIN {attributes} a ON a.attrelid = c.conrelid AND a.attnum = c.num WHERE NOT r.relispartition GROUP BY ALL)",
    "indexes": "SELECT "
    + row("index", "t.schema", "n.relname", "concat(t.schema, '.', t.relname)", columns="to_json(i.columns)", unique="i.indisunique", method="i.amname", predicate="i.predicate", is_constraint="coalesce(c.contype = 'u', false)")
    + " FROM {indexes} i JOIN {rel} t ON t.oid = i.indrelid JOIN {rel} n ON n.oid = i.indexrelid LEFT JOIN (SELECT conindid, contype FROM {constraints} WHERE contype IN ('u', 'x')) c ON c.conindid = i.indexrelid WHERE NOT i.indisprimary AND NOT t.relispartition AND NOT c.contype <=> 'x'",
    "foreign_keys": "SELECT "
    + row("foreign_key", "schema", "conname", "concat(schema, '.', relname)", columns="to_json(columns)", ref_table="ref_table", ref_columns="to_json(ref_columns)", on_delete=lookup(ACTIONS, "confdeltype"), on_update=lookup(ACTIONS, "confupdtype"), deferrable="condeferrable", initially_deferred="condeferred")
    + " FROM (SELECT r.schema, r.relname, c.conname, concat(f.schema, '.', f.relname) AS ref_table, c.confdeltype, c.confupdtype, c.condeferrable, c.condeferred, transform(array_sort(collect_list(struct(c.pos, a.attname))), x -> x.attname) AS columns, transform(array_sort(collect_list(struct(c.pos, b.attname))), x -> x.attname) AS ref_columns"
    " FROM (SELECT *, posexplode(arrays_zip(conkey, confkey)) AS (pos, pair) FROM {constraints} WHERE contype = 'f') c JOIN {rel} r ON r.oid = c.conrelid JOIN {rel} f ON f.oid = c.confrelid JOIN {attributes} a ON a.attrelid = c.conrelid AND a.attnum = c.pair.conkey JOIN {attributes} b ON b.attrelid = c.confrelid AND b.attnum = c.pair.confkey WHERE NOT r.relispartition GROUP BY ALL)",
    "checks": "SELECT " + row("check", "r.schema", "c.conname", "concat(r.schema, '.', r.relname)", expression="c.expr") + " FROM {constraints} c JOIN {rel} r ON r.oid = c.conrelid WHERE c.contype = 'c' AND NOT r.relispartition",
    "exclusions": "SELECT " + row("exclusion", "r.schema", "c.conname", "concat(r.schema, '.', r.relname)", definition="c.definition") + " FROM {constraints} c JOIN {rel} r ON r.oid = c.conrelid WHERE c.contype = 'x' AND NOT r.relispartition",
    "views": "SELECT " + row("view", "schema", "relname", query="rtrim(';', viewdef)", materialized="relkind = 'm'") + " FROM {rel} WHERE relkind IN ('v', 'm')",
    "policies": "SELECT "
    + row("policy", "r.schema", "p.polname", "concat(r.schema, '.', r.relname)", command=lookup(COMMANDS, "p.polcmd"), roles="to_json(if(size(p.roles) = 0, array('public'), array_sort(p.roles)))", using="p.using_expr", check="p.check_expr")
    + " FROM {policies} p JOIN {rel} r ON r.oid = p.polrelid",
    "triggers": "SELECT "
    + row(
        "trigger", "schema", "tgname", "concat(schema, '.', relname)", timing="CASE WHEN tgtype & 64 > 0 THEN 'INSTEAD OF' WHEN tgtype & 2 > 0 THEN 'BEFORE' ELSE 'AFTER' END", events="to_json(array_sort(filter(array(" + ", ".join(f"if(tgtype & {b} > 0, '{e}', NULL)" for b, e in EVENT_BITS) + "), e -> e IS NOT NULL)))", for_each_row="tgtype & 1 > 0", enabled=lookup(MODES, "tgenabled"), function="function",
        args="to_json(transform(coalesce(args, array()), a -> concat('''', replace(a, '''', ''''''), '''')))", update_columns="to_json(names)", when="when_expr", old_table="old_table", new_table="new_table", constraint="is_constraint", deferrable="tgdeferrable", initially_deferred="tginitdeferred",
    )
    + " FROM (SELECT r.schema, r.relname, t.tgname, t.tgtype, t.tgenabled, t.function, t.args, t.when_expr, t.old_table, t.new_table, t.is_constraint, t.tgdeferrable, t.tginitdeferred, transform(array_sort(collect_list(if(a.attname IS NULL, NULL, struct(t.pos, a.attname)))), x -> x.attname) AS names"
    " FROM (SELECT * FROM {triggers} LATERAL VIEW OUTER posexplode(columns) p AS pos, num) t JOIN {rel} r ON r.oid = t.tgrelid LEFT JOIN {attributes} a ON a.attrelid = t.tgrelid AND a.attnum = t.num GROUP BY ALL)",
    "functions": "SELECT "
    + row("function", "schema", "concat(proname, '(', types, ')')", arguments="arguments", return_type="result", language="lanname", body="prosrc", volatility=lookup(VOLATILITY, "provolatile"), security="if(prosecdef, 'DEFINER', 'INVOKER')", config="to_json(transform(coalesce(config, array()), c -> array(split_part(c, '=', 1), substring(c, instr(c, '=') + 1))))")
    + " FROM {fun} WHERE prokind = 'f'",
    "aggregates": "SELECT "
    + row("aggregate", "p.schema", "concat(p.proname, '(', p.types, ')')", sfunc="a.sfunc", stype="a.stype", finalfunc="a.finalfunc", initcond="a.initcond", parallel=lookup(PARALLEL, "p.proparallel"))
    + " FROM {fun} p JOIN {aggregates} a ON a.oid = p.oid WHERE p.prokind = 'a'",
    "sequences": "SELECT "
    + row("sequence", "r.schema", "r.relname", data_type="s.type", start="s.seqstart", increment="s.seqincrement", min="s.seqmin", max="s.seqmax", cycle="s.seqcycle", cache="s.seqcache", owned_by="concat(t.schema, '.', t.relname, '.', a.attname)")
    + " FROM {sequences} s JOIN {rel} r ON r.oid = s.seqrelid LEFT JOIN {sequence_owners} o ON o.seqrelid = s.seqrelid LEFT JOIN {rel} t ON t.oid = o.relid LEFT JOIN {attributes} a ON a.attrelid = o.relid AND a.attnum = o.attnum WHERE a.attidentity IS NULL OR a.attidentity = ''",
    "table_grants": grants("table", "SELECT concat(schema, '.', relname) AS subject, acl, owner, cast(NULL AS string) AS implied FROM {rel} WHERE relkind IN ('r', 'p', 'v', 'm')"),
    "sequence_grants": grants("sequence", "SELECT concat(schema, '.', relname) AS subject, acl, owner, cast(NULL AS string) AS implied FROM {rel} WHERE relkind = 'S'"),
    "function_grants": grants("function", f"SELECT {SIGNED} AS subject, acl, owner, 'EXECUTE' AS implied FROM {{fun}} WHERE prokind = 'f'"),
    "schema_grants": grants("schema", "SELECT nspname AS subject, acl, owner, cast(NULL AS string) AS implied FROM {namespaces} WHERE array_contains({schemas}, nspname)"),
    "type_grants": grants("type", "SELECT concat(schema, '.', typname) AS subject, acl, owner, 'USAGE' AS implied FROM {typ} WHERE typtype IN ('e', 'd')"),
    "default_privileges": "SELECT "
    + row("default_privilege", "''", "concat(subject.role, ' in ', coalesce(subject.nspname, '*'), ' on ', subject.kind, ' to ', grantee)", role="subject.role", in_schema="subject.nspname", object_type="subject.kind", grantee="grantee", privileges="to_json(privileges)", grantable="to_json(grantable)")
    + f" FROM ({privileges_of('SELECT struct(role, nspname, ' + lookup(DEFAULT_KINDS, 'objtype') + ' AS kind) AS subject, acl, role AS owner, CASE WHEN nspname IS NULL THEN CASE objtype WHEN ' + chr(39) + 'f' + chr(39) + ' THEN ' + chr(39) + 'EXECUTE' + chr(39) + ' WHEN ' + chr(39) + 'T' + chr(39) + ' THEN ' + chr(39) + 'USAGE' + chr(39) + ' END END AS implied FROM {default_acls} WHERE nspname IS NULL OR array_contains({schemas}, nspname)')})",
    "relation_comments": comments(f"concat({lookup(RELATION_KINDS, 'r.relkind')}, ' ', r.schema, '.', r.relname)", "{rel} r ON r.oid = d.objoid", "pg_class", "d.objsubid = 0 AND r.relkind IN ('r', 'p', 'v', 'm', 'S', 'i')"),
    "column_comments": comments("concat('column ', r.schema, '.', r.relname, '.', a.attname)", "{rel} r ON r.oid = d.objoid JOIN {attributes} a ON a.attrelid = d.objoid AND a.attnum = d.objsubid", "pg_class", "d.objsubid > 0"),
    "constraint_comments": comments("concat('constraint ', r.schema, '.', r.relname, '.', c.conname)", "{constraints} c ON c.oid = d.objoid JOIN {rel} r ON r.oid = c.conrelid", "pg_constraint"),
    "domain_constraint_comments": comments("concat('constraint domain ', t.schema, '.', t.typname, '.', c.conname)", "{constraints} c ON c.oid = d.objoid JOIN {typ} t ON t.oid = c.contypid", "pg_constraint"),
    "type_comments": comments("concat(if(t.typtype = 'd', 'domain ', 'type '), t.schema, '.', t.typname)", "{typ} t ON t.oid = d.objoid", "pg_type", "t.typtype IN ('e', 'd')"),
    "routine_comments": comments("concat(if(p.prokind = 'a', 'aggregate ', 'function '), p.schema, '.', p.proname, '(', p.types, ')')", "{fun} p ON p.oid = d.objoid", "pg_proc", "p.prokind IN ('f', 'a')"),
    "schema_comments": comments("concat('schema ', n.nspname)", "{namespaces} n ON n.oid = d.objoid", "pg_namespace", "array_contains({schemas}, n.nspname)"),
    "trigger_comments": comments("concat('trigger ', r.schema, '.', r.relname, '.', t.tgname)", "{triggers} t ON t.oid = d.objoid JOIN {rel} r ON r.oid = t.tgrelid", "pg_trigger"),
    "policy_comments": comments("concat('policy ', r.schema, '.', r.relname, '.', p.polname)", "{policies} p ON p.oid = d.objoid JOIN {rel} r ON r.oid = p.polrelid", "pg_policy"),
    "extension_comments": comments("concat('extension ', x.extname)", "{extensions} x ON x.oid = d.objoid", "pg_extension"),
    "server_comments": comments("concat('server ', x.srvname)", "{servers} x ON x.oid = d.objoid", "pg_foreign_server"),
    "relation_owners": owners(f"concat({lookup(RELATION_KINDS, 'relkind')}, ' ', schema, '.', relname)", "{rel} WHERE relkind IN ('r', 'p', 'v', 'm', 'S') AND NOT relispartition"),
    "routine_owners": owners(f"concat(if(prokind = 'a', 'aggregate ', 'function '), {SIGNED})", "{fun} WHERE prokind IN ('f', 'a')"),
    "type_owners": owners("concat(if(typtype = 'd', 'domain ', 'enum '), schema, '.', typname)", "{typ} WHERE typtype IN ('e', 'd')"),
    "schema_owners": owners("concat('schema ', nspname)", "{namespaces} WHERE array_contains({schemas}, nspname)"),
    "server_owners": owners("concat('server ', srvname)", "{servers}"),
}


def introspect(spark: SparkSession, sources: dict[str, DataFrame], schemas: Iterable[str], include_extension_objects: bool = False, only: Iterable[str] | None = None) -> DataFrame:
    """The catalog relation of the managed schemas: the union of all scans (or only some) whose
    sources are given. Parts that the server renders as text (bounds, partition keys, arguments,
    exclusion constraints) are read by to_catalog()."""
    names = list(schemas)
    spaces = sources["namespaces"].where(F.col("nspname").isin(names)).select(F.col("oid").alias("space"), F.col("nspname").alias("schema"))

    def managed(df: DataFrame, column: str) -> DataFrame:
        own = df.join(spaces, F.col(column) == F.col("space")).drop("space")
        if include_extension_objects or "owned_by_extensions" not in sources:
            return own
        return own.join(sources["owned_by_extensions"].select(F.col("objid").alias("oid")).distinct(), "oid", "left_anti")

    frames = dict(sources)
    for name, (source, column) in {"rel": ("classes", "relnamespace"), "typ": ("types", "typnamespace"), "fun": ("procedures", "pronamespace")}.items():
        if source in sources:
            frames[name] = managed(sources[source], column)
    literal = "array(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"
    out = None
    for text in SCANS.values() if only is None else [SCANS[k] for k in only]:
        used = {n for n in [*SOURCES, "rel", "typ", "fun"] if "{" + n + "}" in text}
        if used <= frames.keys():
            found = spark.sql(text.replace("{schemas}", literal), **{n: frames[n] for n in used})
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def read_text(o: Obj) -> None:
    """Put what the server renders as text into the form that declarations have."""
    a = o.attrs
    cursor = lambda text: Cursor([*tokenize(text)])
    for k in ("data_type", "return_type", "stype"):
        if a.get(k):
            a[k] = canonical_type(a[k])
    if o.kind == "partition" and isinstance(a.get("bound"), str):
        a["bound"] = Reader().bound(cursor(a["bound"]))
    elif o.kind == "table" and a.get("partkey"):
        c = cursor(a.pop("partkey"))
        a["partition_by"] = {"strategy": c.name(), "columns": [text_of(part) for part in c.parts()]}
    elif o.kind == "function":
        text = a.pop("arguments", None) or ""
        a["args"] = Reader().arguments(cursor(f"({text})")) if text else []
        a["config"] = [[k, "''" if v == '""' else v] for k, v in a.get("config") or []]
    elif o.kind == "aggregate":
        for k in ("sfunc", "finalfunc"):
            if a.get(k):  # a name without schema is read as public in declarations
                a[k] = a[k].replace("pg_catalog.", "public.", 1)
    elif o.kind == "exclusion":
        reader, table = Reader(), Obj("table", o.schema, o.parent.removeprefix(o.schema + "."))
        reader.constraint(cursor(f"CONSTRAINT x {a.pop('definition')}"), table)
        a.update(reader.catalog.get("exclusion", f"{table.key}.x").attrs)


def to_catalog(relation: DataFrame, current_role: str | None = None) -> Catalog:
    """The relation's rows on the driver, in the form of declarations. Default privileges of
    current_role are those that declarations give to no role by name."""
    out = Catalog()
    for r in relation.collect():
        o = Obj(r["kind"], r["schema"], r["name"], r["parent"], parsed(r["attrs"]))
        if o.kind == "default_privilege" and o.attrs["role"] == current_role:
            o.attrs["role"], o.name = "CURRENT_ROLE", "CURRENT_ROLE" + o.name.removeprefix(current_role)
        read_text(o)
        out.add(o)
    return out


def unsupported_objects(sources: dict[str, DataFrame]) -> DataFrame:
    """(kind, name) of what the catalog does not model: composite types, foreign tables, inherited
    tables, rules, and procedures."""
    classes = sources["classes"]
    kinds = F.create_map(F.lit("c"), F.lit("composite type"), F.lit("f"), F.lit("foreign table"))
    out = classes.where(F.col("relkind").isin("c", "f")).select(kinds[F.col("relkind")].alias("kind"), F.col("relname").alias("name"))
    if "inherits" in sources:
        out = out.unionByName(classes.where("not relispartition").join(sources["inherits"], F.col("oid") == F.col("inhrelid"), "left_semi").select(F.lit("inherited table").alias("kind"), F.col("relname").alias("name")))
    if "rules" in sources:
        out = out.unionByName(sources["rules"].select(F.lit("rule").alias("kind"), F.col("rulename").alias("name")))
    if "procedures" in sources:
        out = out.unionByName(sources["procedures"].where("prokind = 'p'").select(F.lit("procedure").alias("kind"), F.col("proname").alias("name")))
    return out
