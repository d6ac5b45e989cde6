"""Declared column types: canonical names, and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Other names of types.
ALIASES = {
    "int": "integer", "int4": "integer", "int2": "smallint", "int8": "bigint", "float8": "double precision", "float": "double precision", "float4": "real",
    "bool": "boolean", "decimal": "numeric", "varchar": "character varying", "char": "character", "bpchar": "character", "string": "text",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "timetz": "time with time zone", "time": "time without time zone",
}
SERIALS = {"serial": "integer", "serial4": "integer", "bigserial": "bigint", "serial8": "bigint", "smallserial": "smallint", "serial2": "smallint"}
KNOWN = frozenset(
    "smallint integer bigint real text boolean date interval bytea uuid inet cidr macaddr macaddr8 xml json jsonb point geometry geography vector numeric name oid regclass money bit tsvector tsquery line lseg box path polygon circle hstore citext ltree void trigger record "
    "int4range int8range numrange tsrange tstzrange daterange int4multirange int8multirange nummultirange tsmultirange tstzmultirange datemultirange".split()
) | {"double precision", "character varying", "character", "bit varying", "timestamp with time zone", "timestamp without time zone", "time with time zone", "time without time zone"}

PARTS = re.compile(r"^\s*(?P<base>(?:\"[^\"]+\"|[^(\[])+?)\s*(?:\((?P<args>[^)]*)\))?(?P<tail>\s+with(?:out)?\s+time\s+zone)?\s*(?P<array>(?:\[\d*\])*|\s+array)\s*$", re.I)


def canonical_type(text: str, default_schema: str = "public") -> str:
    """One name for each type: lower case, aliases resolved, arguments kept; user types carry their schema."""
    low = text.strip()
    if re.match(r"(?i)setof\s", low):
        return "SETOF " + canonical_type(low[6:], default_schema)
    if re.match(r"(?i)table\s*\(", low):
        inner = low[low.index("(") + 1 : low.rindex(")")]
        cells = [c.strip().split(None, 1) for c in split_top(inner)]
        return "TABLE(" + ", ".join(f"{c[0].lower()} {canonical_type(c[1], default_schema)}" for c in cells) + ")"
    m = PARTS.match(low)
    if not m:
        raise ValueError(f"not a type: {text!r}")
    base = " ".join(m["base"].split())
    name = base.lower() if '"' not in base else base
    name = name.removeprefix("pg_catalog.")
    args = ",".join(a.strip() for a in m["args"].split(",")) if m["args"] else ""
    if m["tail"]:
        name += " " + " ".join(m["tail"].lower().split())
    name = ALIASES.get(name, name)
    if name == "character" and not args:
        args = "1"
    short = name.removeprefix("public.") if name.startswith("public.") else name
    if short in KNOWN or name.startswith("interval "):
        name = short
    elif "." not in name:
        name = f"{default_schema}.{name.strip(chr(34))}"
    else:
        name = name.replace('"', "")
    array = m["array"].strip()
    dims = array.count("[") or (1 if array else 0)
    return name + (f"({args})" if args else "") + "[]" * dims


def split_top(text: str, separator: str = ",") -> list[str]:
    """Split at separators outside parentheses and quotes."""
    out, depth, at, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == separator and not depth:
            out.append(text[at:k])
            at = k + 1
    return [x for x in [*out, text[at:]] if x.strip()]


def spark_type(text: str) -> T.DataType:
    """The Spark type that holds a declared type; user types (enums, domains over text) are strings."""
    name = canonical_type(text)
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    base, _, rest = name.partition("(")
    args = [int(a) for a in rest.rstrip(")").split(",") if a.strip().isdigit()]
    plain = {
        "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "real": T.FloatType(), "double precision": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "bytea": T.BinaryType(), "oid": T.LongType(),
        "timestamp without time zone": T.TimestampNTZType(), "timestamp with time zone": T.TimestampType(), "interval": T.DayTimeIntervalType(), "geometry": T.BinaryType(), "geography": T.BinaryType(),
        "point": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]), "vector": T.ArrayType(T.FloatType()), "tsvector": T.ArrayType(T.StringType()),
    }
    if base in plain:
        return plain[base]
    if base == "numeric":
        return T.DecimalType(min(38, args[0]), args[1] if len(args) > 1 else 0) if args else T.DecimalType(38, 18)
    if base == "character varying" and args:
        return T.VarcharType(args[0])
    if base == "character":
        return T.CharType(args[0] if args else 1)
    ranges = {"int4range": T.IntegerType(), "int8range": T.LongType(), "numrange": T.DecimalType(38, 18), "daterange": T.DateType(), "tsrange": T.TimestampNTZType(), "tstzrange": T.TimestampType()}
    if base in ranges:
        return T.StructType([T.StructField("lower", ranges[base]), T.StructField("upper", ranges[base]), T.StructField("lower_inc", T.BooleanType()), T.StructField("upper_inc", T.BooleanType())])
    if base.endswith("multirange"):
        return T.ArrayType(spark_type(base.replace("multirange", "range")))
    return T.StringType()


def declared_type(kind: T.DataType) -> str:
    """The declared type of a Spark column, for catalogs made from DataFrames."""
    if isinstance(kind, T.ArrayType):
        return declared_type(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    if isinstance(kind, T.VarcharType):
        return f"character varying({kind.length})"
    if isinstance(kind, T.CharType):
        return f"character({kind.length})"
    names = {T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.DateType: "date", T.BinaryType: "bytea", T.TimestampNTZType: "timestamp without time zone", T.TimestampType: "timestamp with time zone", T.StringType: "text", T.DayTimeIntervalType: "interval"}
    return names.get(type(kind), "jsonb")


#: Integer types by range, for the data-aware narrowing check.
INTEGER_RANGE = {"smallint": (-(1 << 15), (1 << 15) - 1), "integer": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}
