"""Vector functions as column expressions; no Python runs on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str | Sequence[float]


def vector(x: Vector) -> Column:
    """A column, the name of one, or numbers as an array of floats."""
    if isinstance(x, str):
        x = F.col(x)
    elif not isinstance(x, Column):
        x = F.array(*(F.lit(float(v)) for v in x))
    return x.cast("array<float>")


def _summed(a: Column, b: Column, f) -> Column:
    """Sum in single precision of f over pairs; lengths must agree, since zip_with would fill up with nulls."""
    total = F.aggregate(F.zip_with(a, b, f), F.lit(0.0).cast("float"), lambda s, x: s + x)
    differ = F.raise_error(F.concat(F.lit("vectors differ in length: "), F.size(a), F.lit(" and "), F.size(b))).cast("float")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("float")).when(F.size(a) == F.size(b), total).otherwise(differ)


def dot_product(a: Vector, b: Vector) -> Column:
    return _summed(vector(a), vector(b), lambda x, y: x * y)


def euclidean_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(_summed(vector(a), vector(b), lambda x, y: (x - y) * (x - y))).cast("float")


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """0 if a vector has no length."""
    a, b = vector(a), vector(b)
    norm = F.sqrt(_summed(a, a, lambda x, y: x * y)) * F.sqrt(_summed(b, b, lambda x, y: x * y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot_product(a, b) / norm).cast("float")


SQL = {
    "dot_product": "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as float) * cast(y as float)), cast(0 as float), (s, x) -> s + x)",
    "euclidean_distance": "cast(sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (cast(x as float) - cast(y as float)) * (cast(x as float) - cast(y as float))), cast(0 as float), (s, x) -> s + x)) as float)",
}
SQL["cosine_similarity"] = "cast(coalesce({dot} / nullif(sqrt({aa}) * sqrt({bb}), 0), 0) as float)"


def sql_call(name: str, a: str, b: str) -> str:
    """The call as plain SQL, for statements that name the function."""
    dot = SQL["dot_product"].format
    return SQL[name].format(a, b, dot=dot(a, b), aa=dot(a, a), bb=dot(b, b))
