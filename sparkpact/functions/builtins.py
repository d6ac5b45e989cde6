"""The function surface of schema text: built-in names, and what stands for each in Spark.

A name is the same in Spark under its own name (SAME), maps to a template (MAPPED: {0}, {1} … are
the arguments and {*} all of them; one template for each number of arguments where they differ), is
made by a rule from literal arguments (RULES), or is refused (UNSUPPORTED) rather than guessed at.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Built-in function names that mean the same in Spark.
SAME = frozenset(
    "count sum avg min max array_agg bool_and bool_or every bit_and bit_or corr stddev variance percentile_cont percentile_disc mode grouping row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value now current_timestamp current_date extract date_trunc make_date abs ceil ceiling floor round mod power sqrt cbrt exp ln log10 sign pi degrees radians sin cos tan asin acos atan atan2 "
    "length char_length character_length bit_length octet_length lower upper initcap concat_ws substring substr overlay position btrim trim lpad rpad repeat reverse replace translate split_part ascii chr md5 coalesce nullif greatest least cast array_append array_remove cardinality current_database current_schema current_user session_user user version exists".split()
)
JSON = "map('ignoreNullFields', 'false')"
#: Where a pattern is found first, and what it finds.
FIRST, FOUND = "regexp_instr({0}, {1})", "regexp_substr({0}, {1})"
#: Rows of JSON text, as an array of JSON texts.
LIST = "from_json({0}, 'array<string>')"
# What other built-in functions are in Spark.
MAPPED: dict[str, str | dict[int, str]] = {
    "string_agg": "listagg({0}, {1})", "random": "rand()", "log": {1: "log10({0})", 2: "log({0}, {1})"}, "trunc": {1: "(sign({0}) * floor(abs({0})))", 2: "(sign({0}) * floor(abs({0}) * pow(10, {1})) / pow(10, {1}))"}, "localtimestamp": "localtimestamp()", "clock_timestamp": "current_timestamp()", "statement_timestamp": "current_timestamp()",
    "transaction_timestamp": "current_timestamp()", "make_timestamptz": "make_timestamp_ltz({*})", "make_timestamp": "make_timestamp_ntz({*})", "make_interval": "make_interval({*})", "concat": "concat_ws('', {*})", "strpos": "instr({0}, {1})", "ltrim": {1: "ltrim({0})", 2: "trim(LEADING {1} FROM {0})"}, "rtrim": {1: "rtrim({0})", 2: "trim(TRAILING {1} FROM {0})"},
    "regexp_split_to_array": "split({0}, {1})", "regexp_split_to_table": "explode(split({0}, {1}))", "left": "if({1} >= 0, left({0}, {1}), left({0}, greatest(0, length({0}) + {1})))", "right": "if({1} >= 0, right({0}, {1}), right({0}, greatest(0, length({0}) + {1})))",
    "to_hex": "lower(hex({0}))", "quote_literal": r"concat('\'', replace({0}, '\'', '\'\''), '\'')", "quote_ident": "if({0} RLIKE '^[a-z_][a-z0-9_]*$', {0}, concat('\"', replace({0}, '\"', '\"\"'), '\"'))", "quote_nullable": r"coalesce(concat('\'', replace({0}, '\'', '\'\''), '\''), 'NULL')",
    "array_prepend": "array_prepend({1}, {0})", "array_length": "nullif(size({0}), 0)", "array_upper": "nullif(size({0}), 0)", "array_lower": "if(size({0}) > 0, 1, NULL)", "array_cat": "concat({0}, {1})", "array_to_string": {2: "array_join({0}, {1})", 3: "array_join({0}, {1}, {2})"},
    "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "unnest": "explode({0})", "array_position": "nullif(array_position({0}, {1}), 0)", "array_replace": "transform({0}, x -> if(x <=> {1}, {2}, x))", "array_positions": "filter(sequence(1, size({0})), i -> element_at({0}, i) <=> {1})", "array_ndims": "if(size({0}) > 0, 1, NULL)", "array_fill": "array_repeat({0}, {1}[0])",
    "json_agg": "to_json(collect_list({0}))", "jsonb_agg": "to_json(collect_list({0}))", "to_json": "to_json({0})", "to_jsonb": "to_json({0})", "row_to_json": "to_json({0})", "array_to_json": "to_json({0})", "json_array_length": "json_array_length({0})", "jsonb_array_length": "json_array_length({0})", "json_object_keys": "explode(json_object_keys({0}))", "jsonb_object_keys": "explode(json_object_keys({0}))",
    "json_array_elements": f"explode({LIST})", "jsonb_array_elements": f"explode({LIST})", "json_array_elements_text": f"explode({LIST})", "jsonb_array_elements_text": f"explode({LIST})", "json_extract_path_text": "get_json_object({0}, concat_ws('.', '$', {1+}))", "jsonb_extract_path_text": "get_json_object({0}, concat_ws('.', '$', {1+}))", "json_extract_path": "get_json_object({0}, concat_ws('.', '$', {1+}))", "jsonb_extract_path": "get_json_object({0}, concat_ws('.', '$', {1+}))",
    "generate_series": "explode(sequence({*}))", "generate_subscripts": "explode(sequence(1, size({0})))", "date_part": "date_part({0}, {1})", "make_time": "make_time({*})", "current_time": "current_time()", "timeofday": "date_format(now(), 'EEE MMM dd HH:mm:ss yyyy')", "age": {2: "make_dt_interval(datediff({0}, {1}))"}, "gen_random_uuid": "uuid()",
    "convert": "decode(encode({0}, {1}), {2})", "setseed": "rand({0})", "row": "struct({*})", "not": "(NOT {0})", "to_timestamp": {1: "timestamp_micros(CAST({0} * 1000000 AS BIGINT))"},
}
# Pieces of the server's date patterns, longest first, and of Spark's.
DATE_PIECES = [("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("Month", "MMMM"), ("Mon", "MMM"), ("Day", "EEEE"), ("DDD", "DDD"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("Dy", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("TZ", "z"), ("Q", "q")]


def text_of(argument: str) -> str:
    """The value of a literal argument; ValueError for anything else."""
    if not re.fullmatch(r"'(?:[^'\\]|\\.|'')*'", argument, re.S):
        raise ValueError(f"{argument} is no literal, and its meaning depends on the value")
    return re.sub(r"\\(.)", r"\1", argument[1:-1].replace("''", "'"))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def date_pattern(argument: str) -> str:
    """A date pattern of the server as one of Spark."""
    text, out = text_of(argument), []
    while text:
        piece = next((p for p in DATE_PIECES if text.startswith(p[0])), None)
        if piece:
            out.append(piece[1])
            text = text[len(piece[0]) :]
        elif text[0].isalpha():
            raise ValueError(f"date pattern {argument}")
        else:
            out.append(text[0])
            text = text[1:]
    return quoted("".join(out))


def regexp_replace(args: list[str]) -> str:
    """The first match only, or all with the flag g; \\1 is a group."""
    subject, pattern, new = args[:3]
    new = quoted(re.sub(r"\\(\d)", r"$\1", text_of(new).replace("$", "\\$"))) if new.startswith("'") else new
    flags = text_of(args[3]) if len(args) > 3 else ""
    if set(flags) - {"g", "i"}:
        raise ValueError(f"flags {flags} of regexp_replace()")
    if "i" in flags:
        pattern = f"concat('(?i)', {pattern})"
    if "g" in flags:
        return f"regexp_replace({subject}, {pattern}, {new})"
    at, found = FIRST.format(subject, pattern), FOUND.format(subject, pattern)
    return f"if({at} > 0, concat(left({subject}, {at} - 1), regexp_replace({found}, concat('^(?:', {pattern}, ')$'), {new}), substring({subject}, {at} + length({found}))), {subject})"


def regexp_match(args: list[str]) -> str:
    """The groups of the first match, or the whole match of a pattern without groups."""
    n = re.compile(text_of(args[1])).groups
    groups = ", ".join(f"regexp_extract({args[0]}, {args[1]}, {k})" for k in (range(1, n + 1) if n else (0,)))
    return f"if({args[0]} RLIKE {args[1]}, array({groups}), NULL)"


def json_object(args: list[str]) -> str:
    """An object of values of any types; keys are literals, NULLs stay."""
    if len(args) % 2:
        raise ValueError("json_build_object() needs pairs")
    return f"to_json(named_struct({', '.join(quoted(text_of(a)) if not k % 2 else a for k, a in enumerate(args))}), {JSON})" if args else "'{}'"


def json_list(args: list[str]) -> str:
    """A list of values of any types: each value as the only field of an object, without that field's name."""
    each = [f"regexp_extract(to_json(named_struct('v', {a}), {JSON}), '(?s)^.....(.*).$', 1)" for a in args]
    return "concat('[', " + ", ',', ".join(each) + ", ']')" if args else "'[]'"


def binary(name: str) -> Callable[[list[str]], str]:
    def make(args: list[str]) -> str:
        found = {("encode", "hex"): "lower(hex({0}))", ("encode", "base64"): "base64({0})", ("decode", "hex"): "unhex({0})", ("decode", "base64"): "unbase64({0})"}.get((name, text_of(args[1])))
        if found is None:
            raise ValueError(f"{name}() with {args[1]}")
        return found.format(args[0])

    return make


def sprintf(args: list[str]) -> str:
    """format() with %s, %I, %L and %%."""
    out, rest, values = [], text_of(args[0]), list(args[1:])
    for piece in re.split(r"(%.)", rest):
        if piece == "%%":
            out.append("'%'")
        elif piece in ("%s", "%I", "%L"):
            value = values.pop(0)
            out.append({"%s": f"coalesce(CAST({value} AS STRING), '')", "%I": spark_call("quote_ident", [value]), "%L": spark_call("quote_nullable", [value])}[piece])
        elif piece.startswith("%"):
            raise ValueError(f"format() with {piece}")
        elif piece:
            out.append(quoted(piece))
    return f"concat({', '.join(out)})" if out else "''"


def counted(test: str) -> Callable[[list[str]], str]:
    """How many arguments, of any types, pass a test."""
    return lambda args: "(" + " + ".join(f"CAST(({a}) {test} AS INT)" for a in args) + ")" if args else "0"


RULES: dict[str, Callable[[list[str]], str]] = {
    "regexp_replace": regexp_replace, "regexp_match": regexp_match, "json_build_object": json_object, "jsonb_build_object": json_object, "json_build_array": json_list, "jsonb_build_array": json_list, "encode": binary("encode"), "decode": binary("decode"), "format": sprintf, "num_nulls": counted("IS NULL"), "num_nonnulls": counted("IS NOT NULL"),
    "to_char": lambda a: f"date_format({a[0]}, {date_pattern(a[1])})", "to_date": lambda a: f"to_date({a[0]}, {date_pattern(a[1])})", "to_number": lambda a: f"to_number({a[0]}, {quoted(text_of(a[1]).replace('G', ',').replace('D', '.'))})",
}
TWO_ARGUMENTS = {"to_timestamp": lambda a: f"to_timestamp({a[0]}, {date_pattern(a[1])})"}
# Built-in names of the server that have no counterpart in a query of Spark.
UNSUPPORTED = frozenset(
    "localtime regexp_matches array_dims json_each jsonb_each json_each_text jsonb_each_text json_object jsonb_object json_populate_record jsonb_populate_record json_populate_recordset jsonb_populate_recordset json_typeof jsonb_typeof truncate "
    "json_strip_nulls jsonb_strip_nulls jsonb_set jsonb_insert jsonb_pretty jsonb_path_query jsonb_path_query_array jsonb_path_query_first jsonb_path_exists jsonb_path_match json_to_record jsonb_to_record json_to_recordset jsonb_to_recordset json_object_agg jsonb_object_agg current_schemas current_setting set_config pg_get_userbyid pg_typeof pg_table_is_visible pg_get_viewdef pg_get_functiondef pg_get_expr pg_get_constraintdef pg_get_indexdef has_table_privilege has_schema_privilege "
    "nextval currval setval lastval pg_sleep pg_sleep_for pg_sleep_until txid_current txid_snapshot_xmin txid_snapshot_xmax txid_visible_in_snapshot to_tsvector to_tsquery plainto_tsquery ts_rank setweight".split()
)
BUILTINS = SAME | MAPPED.keys() | RULES.keys() | UNSUPPORTED


def spark_call(name: str, args: list[str]) -> str:
    """A call of a built-in function in Spark SQL; ValueError for one without counterpart."""
    name = name.lower()
    if name in SAME:
        return f"{name}({', '.join(args)})"
    if name in TWO_ARGUMENTS and len(args) == 2:
        return TWO_ARGUMENTS[name](args)
    if name in RULES:
        return RULES[name](args)
    if name not in MAPPED:
        raise ValueError(f"no Spark counterpart for {name}()")
    template = MAPPED[name]
    if isinstance(template, dict):
        if len(args) not in template:
            raise ValueError(f"{name}() with {len(args)} arguments")
        template = template[len(args)]
    if "{0}" in template and not args or "{1}" in template and len(args) < 2 or "{2}" in template and len(args) < 3:
        raise ValueError(f"too few arguments for {name}()")
    values = {"*": ", ".join(args), "1+": ", ".join(args[1:])}
    return re.sub(r"\{(\*|1\+|\d)\}", lambda m: values[m[1]] if m[1] in values else args[int(m[1])], template)
