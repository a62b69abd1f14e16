"""SQL type names and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The spellings of each type.
SPELLINGS: dict[type[T.DataType], str] = {
    T.StringType: "string varchar nvarchar nvarchar2 nclob text longtext clob char",
    T.LongType: "long bigint",
    T.IntegerType: "int integer tinyint smallint",
    T.BinaryType: "bytea blob image",
    T.TimestampNTZType: "timestamp timestamptz datetime date time",
    T.DoubleType: "double float real",
    T.BooleanType: "boolean bool bit",
}
NAMES = {word: kind for kind, words in SPELLINGS.items() for word in words.split()}
VECTOR = T.ArrayType(T.FloatType())


def parse(name: str) -> T.DataType:
    """The type of a column declared with a SQL type name; lengths are accepted and not enforced.

    decimal(p, s) has no type of its own: with a scale it is double, without one int, or long if p is 0 or less."""
    m = re.fullmatch(r"\s*([a-z0-9 ]+?)\s*(?:\(\s*(-?\d+)\s*(?:,\s*(-?\d+)\s*)?\))?(?:\s+with(?:out)? time zone)?\s*", name.lower())
    if not m:
        raise ValueError(f"unknown type {name}")
    word, precision, scale = m[1].removesuffix(" precision").strip(), m[2], m[3]
    if word in ("floata", "float array"):
        return VECTOR
    if word in ("numeric", "decimal"):
        if precision is None or int(scale or 0) > 0:
            return T.DoubleType()
        return T.IntegerType() if int(precision) > 0 else T.LongType()
    if word not in NAMES:
        raise ValueError(f"unknown type {name}")
    return NAMES[word]()


def sql_name(kind: T.DataType) -> str:
    """The canonical spelling of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return "floata"
    for cls, words in SPELLINGS.items():
        if isinstance(kind, cls):
            return words.split()[0]
    return kind.simpleString()
