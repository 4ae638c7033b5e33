"""Scalar functions: a table of name, number of arguments, typing and Column builder. No UDFs: all stay in the JVM."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types
from ..errors import BindError


@dataclass(frozen=True)
class Typed:
    """A bound expression. literal: the value, if it is a literal; foldable literals check arguments at bind time."""

    column: Column
    kind: str
    nullable: bool = True
    literal: object = None
    is_literal: bool = False


@dataclass(frozen=True)
class Scalar:
    least: int
    most: int | None
    build: Callable[[list[Typed]], Typed]


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _kind(name: str, arg: Typed, *kinds: str) -> None:
    if arg.kind not in (*kinds, "null"):
        raise BindError(f"{name}: an argument is {arg.kind}, not {' or '.join(kinds)}")


def _math(name: str, f: Callable[[Column], Column]) -> Scalar:
    def build(args: list[Typed]) -> Typed:
        _kind(name, args[0], *types.NUMBERS)
        return Typed(finite(f(args[0].column.cast("double"))), "float")

    return Scalar(1, 1, build)


def _string(name: str, f: Callable[[Column], Column]) -> Scalar:
    def build(args: list[Typed]) -> Typed:
        _kind(name, args[0], "string")
        return Typed(f(args[0].column), "string", args[0].nullable)

    return Scalar(1, 1, build)


def _nullif(args: list[Typed]) -> Typed:
    a, b = args
    if b.kind == "null":
        return Typed(a.column, a.kind, True)
    if not types.comparable(a.kind, b.kind):
        raise BindError(f"nullif: {a.kind} and {b.kind} don't compare")
    x, y = (a.column.cast("double"), b.column.cast("double")) if a.kind != b.kind and a.kind in types.NUMBERS else (a.column, b.column)
    return Typed(F.when(F.coalesce(x == y, F.lit(False)), F.lit(None)).otherwise(a.column), a.kind, True)


def _coalesce(args: list[Typed]) -> Typed:
    kind = types.common([a.kind for a in args])
    return Typed(F.coalesce(*[types.as_type(a.column, a.kind, kind) for a in args]), kind, all(a.nullable for a in args))


def _round(args: list[Typed]) -> Typed:
    _kind("round", args[0], *types.NUMBERS)
    digits = 0
    if len(args) == 2:
        if not args[1].is_literal or args[1].kind != "int":
            raise BindError("round: the number of digits is an integer literal")
        digits = int(args[1].literal)
    x = args[0].column.cast("double")
    if args[0].kind == "int":
        return Typed(x, "float", args[0].nullable)
    scale = F.lit(10.0**digits)
    return Typed(F.round(x * scale) / scale, "float", args[0].nullable)


def _left(args: list[Typed]) -> Typed:
    _kind("left", args[0], "string")
    _kind("left", args[1], "int")
    n = args[1].column
    whole = F.substring(args[0].column, F.lit(1), F.least(F.greatest(n, F.lit(0)), F.lit(2**31 - 1)).cast("int"))
    return Typed(F.when(n.isNotNull(), whole), "string")


def _split_part(args: list[Typed]) -> Typed:
    _kind("split_part", args[0], "string")
    _kind("split_part", args[1], "string")
    _kind("split_part", args[2], "int")
    s, d, n = (a.column for a in args)
    if args[2].is_literal and args[2].literal is not None and int(args[2].literal) < 0:
        raise BindError("split_part: the part is not negative")
    negative = F.raise_error(F.lit("split_part: the part is not negative"))
    safe = F.when(n < 0, negative.cast("int")).when(n == 0, F.lit(1)).otherwise(F.least(n, F.lit(2**31 - 1)).cast("int"))
    whole = F.when(d == "", F.substring(s, safe, F.lit(1))).when(F.instr(s, d) == 0, F.lit("")).otherwise(F.split_part(s, d, safe))
    return Typed(F.when(s.isNull() | d.isNull() | n.isNull(), F.lit(None)).when(n == 0, F.lit("")).otherwise(whole), "string")


def version() -> str:
    from .. import __version__

    return __version__


SCALARS: dict[str, Scalar] = {
    "now": Scalar(0, 0, lambda a: Typed(F.localtimestamp(), "datetime", False)),
    "version": Scalar(0, 0, lambda a: Typed(F.lit(version()), "string", False)),
    "nullif": Scalar(2, 2, _nullif),
    "coalesce": Scalar(1, None, _coalesce),
    "round": Scalar(1, 2, _round),
    "left": Scalar(2, 2, _left),
    "split_part": Scalar(3, 3, _split_part),
    "exp2": _math("exp2", lambda c: F.pow(F.lit(2.0), c)),
    "log": _math("log", F.log),
    "trim": _string("trim", lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")),
    "lower": _string("lower", F.lower),
    "upper": _string("upper", F.upper),
}
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "sqrt", "exp", "log2", "log10"):
    SCALARS[_name] = _math(_name, getattr(F, _name))
