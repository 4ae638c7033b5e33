"""A query over a DataFrame, as a DataFrame: scan, filter, group, project, distinct, sort, limit. Catalyst does the rest."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import BindError
from ..operators.relational import ordering, uniquely
from .binder import Binder, Scope, children, has_aggregate
from .tree import Infix, Item, Join, Literal, Name, Order, Query, Source, Star, bare


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    nullable: bool


@dataclass(frozen=True)
class Answer:
    """The result, its schema, and for each column how it is ordered (asc, desc or None)."""

    df: DataFrame
    schema: list[Field]
    ordering: list[str | None]


def plan(spark: SparkSession, q: Query, source: DataFrame | None, others: Sequence[DataFrame] = ()) -> Answer:
    """others: the joins' sources, in their order."""
    if source is None:
        source = spark.range(1).select()
    first = Source(q.dataset, q.version, q.alias) if q.dataset else None
    source, plain = joined(source, first, q.joins, others) if q.joins else (source, Binder(source.schema, (scope(first, source),)))
    items = expand(q, plain)
    if q.where is not None:
        if has_aggregate(q.where):
            raise BindError("WHERE can't use aggregates")
        where = plain.bind(q.where)
        if where.kind not in ("bool", "null"):
            raise BindError(f"WHERE takes a boolean, not {where.kind}")
        source = source.filter(where.column.cast("boolean"))
    grouped = bool(q.group) or any(has_aggregate(i.x) for i in items) or q.having is not None
    if grouped:
        source, binder = group(source, q, items, plain)
    else:
        binder = plain
    bound = [binder.bind(i.x) for i in items]
    names = [i.label or str(i.x) for i in items]
    inner = [f"__p{i}" for i in range(len(items))]
    orders = [order_key(o, items, names, binder) for o in q.order]
    extra: list[tuple[str, Column]] = []
    sort: list[Column] = []
    marks: list[str | None] = [None] * len(items)
    for o, key in zip(q.order, orders):
        if isinstance(key, int):
            marks[key] = "desc" if o.down else "asc"
            sort.append(ordering(F.col(inner[key]), o.down, o.nulls_first))
        else:
            if q.distinct:
                raise BindError("with DISTINCT, ORDER BY takes what is selected")
            extra.append((f"__o{len(extra)}", key))
            sort.append(ordering(F.col(extra[-1][0]), o.down, o.nulls_first))
    if grouped:
        source = binder.finish(source)
        if q.having is not None:
            source = source.filter(binder.having.column.cast("boolean"))
    df = source.select(*[t.column.alias(n) for t, n in zip(bound, inner)], *[c.alias(n) for n, c in extra])
    if q.distinct:
        df = df.distinct()
    if sort:
        df = df.orderBy(*sort)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    df = uniquely(df.drop(*[n for n, _ in extra]) if extra else df, names)
    return Answer(df, [Field(n, t.kind, t.nullable) for n, t in zip(names, bound)], marks)


def scope(source: Source | None, df: DataFrame, prefix: str = "") -> Scope:
    """A source goes by its alias, and by its own name; in a join by its alias alone, if it has one."""
    names = [] if source is None else [source.alias or source.dataset] if prefix else [source.dataset, source.alias]
    return Scope(frozenset(n.lower() for n in names if n), {c: prefix + c for c in df.columns})


def conjuncts(x) -> list:
    x = bare(x)
    return conjuncts(x.a) + conjuncts(x.b) if isinstance(x, Infix) and x.op == "AND" else [x]


def named(x) -> list[Name]:
    return [x] if isinstance(x, Name) else [n for y in children(x) for n in named(y)]


def joined(source: DataFrame, first: Source, joins: Sequence[Join], others: Sequence[DataFrame]) -> tuple[DataFrame, Binder]:
    """The sources' columns side by side, each under a prefix of its own, and a binder that knows whose they are."""
    renamed = lambda df, prefix: df.toDF(*[prefix + c for c in df.columns])
    scopes = [scope(first, source, "s0.")]
    left = renamed(source, "s0.")
    for i, (j, other) in enumerate(zip(joins, others), 1):
        right, own = renamed(other, f"s{i}."), scope(j.source, other, f"s{i}.")
        if any(own.spaces & s.spaces for s in scopes):
            raise BindError(f"two sources are called {min(own.spaces)!r}")
        scopes.append(own)
        binder = Binder(StructType([*left.schema, *right.schema]), tuple(scopes))
        if has_aggregate(j.on):
            raise BindError("ON can't use aggregates")
        on = binder.bind(j.on)
        if on.kind != "bool":
            raise BindError(f"ON takes a boolean, not {on.kind}")
        sides = lambda x: {binder.resolve(n) in right.columns for n in named(x)}  # noqa: B023, E731
        if not any(isinstance(x, Infix) and x.op == "=" and sorted([sides(x.a), sides(x.b)], key=str) == [{False}, {True}] for x in conjuncts(j.on)):
            raise BindError("a join needs an equality between its two sides: without one every row would meet every other")
        left = left.join(right, on.column, j.kind)
    return left, Binder(left.schema, tuple(scopes))


def expand(q: Query, binder: Binder) -> list[Item]:
    out: list[Item] = []
    for i in q.select:
        if isinstance(i.x, Star):
            if q.dataset is None:
                raise BindError("* needs FROM")
            for s in binder.within(i.x.space):
                space = min(s.spaces) if len(binder.scopes) > 1 else None
                out += [Item(Name(name, name.lower() != name, space), name) for name in s.columns]
        else:
            out.append(i)
    return out


class Grouped(Binder):
    """Binds over the keys of a grouped source; finish() makes the aggregation once all aggregates are known."""

    having = None

    def finish(self, source: DataFrame) -> DataFrame:
        aggregates = [t.column.alias(n) for n, t in self.aggregates.values()]
        names = [n for n, _ in self.keys.values()]
        keyed = source.withColumns({n: t.column for n, t in self.keys.values()}) if names else source
        if not aggregates:
            return keyed.select(*names).distinct()
        return keyed.groupBy(*names).agg(*aggregates) if names else source.agg(*aggregates)


def group(source: DataFrame, q: Query, items: list[Item], plain: Binder) -> tuple[DataFrame, Grouped]:
    keys: dict = {}
    for x in q.group:
        x = bare(x)
        if isinstance(x, Literal) and x.kind == "int":
            if not 1 <= x.value <= len(items):
                raise BindError(f"GROUP BY position {x.value} is out of range")
            x = bare(items[x.value - 1].x)
        elif isinstance(x, Name) and not x.space and not plain.has(x):
            x = next((bare(i.x) for i in items if i.label and i.label.lower() == x.name.lower()), x)
        if has_aggregate(x):
            raise BindError("GROUP BY can't use aggregates")
        t = plain.bind(x)
        if t.kind == "other":
            raise BindError("GROUP BY takes scalar types")
        keys.setdefault(plain.text(x), (f"__k{len(keys)}", t))
    binder = Grouped(plain.schema, plain.scopes, keys)
    if q.having is not None:
        binder.having = binder.bind(q.having)
        if binder.having.kind not in ("bool", "null"):
            raise BindError("HAVING takes a boolean")
    return source, binder


def order_key(o: Order, items: list[Item], names: list[str], binder: Binder) -> int | Column:
    """The place of a selected column, or a Column over what is selected from."""
    x = bare(o.x)
    if isinstance(x, Literal):
        if x.kind != "int" or not 1 <= x.value <= len(items):
            raise BindError(f"ORDER BY position {x} is out of range")
        return x.value - 1
    if isinstance(x, Name) and not x.space:
        for i, item in enumerate(items):
            if item.label and (item.label == x.name or not x.quoted and item.label.lower() == x.name.lower()):
                return i
    text = binder.text(x)
    for i, item in enumerate(items):
        if binder.text(item.x) == text:
            return i
    return binder.bind(x).column
