"""Aggregate functions over bound arguments; all are Spark's own, with partial aggregation before the shuffle."""

from pyspark.sql import functions as F

from .. import types
from ..errors import BindError
from .scalar import Typed

AGGREGATES = frozenset(("count", "min", "max", "sum", "avg", "bool_and", "bool_or"))


def aggregate(name: str, args: list[Typed], distinct: bool) -> Typed:
    if len(args) != 1 and not (name == "count" and not args):
        raise BindError(f"{name}: takes one argument, not {len(args)}")
    if name == "count":
        if not args:
            return Typed(F.count(F.lit(1)), "int", False)
        return Typed(F.count_distinct(args[0].column) if distinct else F.count(args[0].column), "int", False)
    a = args[0]
    if name in ("min", "max"):
        if a.kind == "other":
            raise BindError(f"{name}: not for this type")
        return Typed(getattr(F, name)(a.column), a.kind)
    if name in ("sum", "avg"):
        if a.kind not in types.NUMBERS:
            raise BindError(f"{name}: takes numbers, not {a.kind}")
        if name == "sum":
            return Typed(F.sum_distinct(a.column) if distinct else F.sum(a.column), a.kind)
        # the distinct average is a quotient of two distinct aggregates: no text is built for the parser
        mean = F.sum_distinct(a.column).cast("double") / F.nullif(F.count_distinct(a.column), F.lit(0).cast("bigint")) if distinct else F.avg(a.column)
        return Typed(mean, "float")
    if a.kind not in ("bool", "null"):
        raise BindError(f"{name}: takes booleans, not {a.kind}")
    return Typed(getattr(F, name)(a.column), "bool")
