"""Logical types: null, string, int, float, bool, date, datetime; other for what can only be projected."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BindError

NUMBERS = ("int", "float")
SPARK = {"null": T.StringType(), "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}


def logical(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    for name, t in (("string", T.StringType), ("bool", T.BooleanType), ("date", T.DateType), ("null", T.NullType)):
        if isinstance(kind, t):
            return name
    return "other"


def normalised(df: DataFrame) -> DataFrame:
    """Integers of any width as bigint, floats as double; a cast of a column doesn't stop filters from reaching the scan."""
    cast = {"int": "bigint", "float": "double"}
    columns = []
    for f in df.schema:
        name = logical(f.dataType)
        c = F.col(f"`{f.name}`")
        columns.append(c.cast(cast[name]).alias(f.name) if name in cast and f.dataType.simpleString() != cast[name] else c)
    return df.select(*columns)


def comparable(a: str, b: str) -> bool:
    return a == b and a != "other" or a in NUMBERS and b in NUMBERS or "null" in (a, b)


def common(kinds: list[str]) -> str:
    """The type that coalesce, CASE and IN give to mixed values."""
    seen = {k for k in kinds if k != "null"}
    if not seen:
        return "null"
    if seen <= set(NUMBERS):
        return "float" if "float" in seen else "int"
    if len(seen) == 1:
        return seen.pop()
    raise BindError(f"types don't fit together: {', '.join(sorted(seen))}")


def as_type(c: Column, kind: str, to: str) -> Column:
    if kind == to or to == "null":
        return c
    return c.cast(SPARK[to])
