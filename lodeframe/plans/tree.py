"""Syntax trees. str() gives the canonical text, which names output columns and can be parsed again."""

import re
from dataclasses import dataclass, field

from .lexer import KEYWORDS


def name_text(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.lower() not in KEYWORDS else '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Literal:
    kind: str
    value: object

    def __str__(self) -> str:
        if self.kind == "string":
            return "'" + str(self.value).replace("'", "''") + "'"
        if self.kind == "float":
            text = repr(self.value).replace("e+", "e")
            return text if "." in text or "e" in text else f"{text}.0"
        return {"null": "NULL", "bool": str(self.value).upper()}.get(self.kind, str(self.value))


@dataclass(frozen=True)
class Name:
    name: str
    quoted: bool = False
    space: str | None = None

    def __str__(self) -> str:
        own = name_text(self.name) if not self.quoted else '"' + self.name.replace('"', '""') + '"'
        return f"{name_text(self.space)}.{own}" if self.space else own


@dataclass(frozen=True)
class Star:
    space: str | None = None

    def __str__(self) -> str:
        return f"{name_text(self.space)}.*" if self.space else "*"


@dataclass(frozen=True)
class Prefix:
    op: str
    x: object

    def __str__(self) -> str:
        return f"NOT {self.x}" if self.op == "NOT" else f"{self.op}{self.x}"


@dataclass(frozen=True)
class Infix:
    op: str
    a: object
    b: object

    def __str__(self) -> str:
        gap = " " if self.op[0].isalpha() else ""
        return f"{self.a}{gap}{self.op}{gap}{self.b}"


@dataclass(frozen=True)
class Among:
    x: object
    items: tuple
    negated: bool = False

    def __str__(self) -> str:
        return f"{self.x} {'NOT ' if self.negated else ''}IN ({', '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.name}({'DISTINCT ' if self.distinct else ''}{', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: object | None = None

    def __str__(self) -> str:
        body = " ".join(f"WHEN {c} THEN {v}" for c, v in self.whens)
        return f"CASE {body}{'' if self.other is None else f' ELSE {self.other}'} END"


@dataclass(frozen=True)
class Paren:
    x: object

    def __str__(self) -> str:
        return f"({self.x})"


@dataclass(frozen=True)
class Item:
    x: object
    label: str | None = None

    def __str__(self) -> str:
        return f"{self.x} AS {name_text(self.label)}" if self.label else str(self.x)


@dataclass(frozen=True)
class Order:
    x: object
    down: bool = False
    nulls_first: bool = False

    def __str__(self) -> str:
        return f"{self.x} {'DESC' if self.down else 'ASC'} NULLS {'FIRST' if self.nulls_first else 'LAST'}"


@dataclass(frozen=True)
class Source:
    dataset: str
    version: str | None = None
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.dataset}{f'@v{self.version}' if self.version else ''}{f' AS {name_text(self.alias)}' if self.alias else ''}"


@dataclass(frozen=True)
class Join:
    """An inner or left join: rows of what stands before it, with those of a source that meet a condition."""

    kind: str
    source: Source
    on: object

    def __str__(self) -> str:
        return f"{self.kind.upper()} JOIN {self.source} ON {self.on}"


@dataclass(frozen=True)
class Query:
    select: tuple
    dataset: str | None = None
    version: str | None = None
    alias: str | None = None
    where: object | None = None
    group: tuple = ()
    having: object | None = None
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = field(default=False)
    joins: tuple = ()

    def __str__(self) -> str:
        out = f"SELECT {'DISTINCT ' if self.distinct else ''}{', '.join(map(str, self.select))}"
        if self.dataset:
            out += " ".join([f" FROM {Source(self.dataset, self.version, self.alias)}", *map(str, self.joins)])
        for word, x in (("WHERE", self.where), ("GROUP BY", ", ".join(map(str, self.group)) or None), ("HAVING", self.having), ("ORDER BY", ", ".join(map(str, self.order)) or None), ("LIMIT", self.limit), ("OFFSET", self.offset)):
            out += "" if x is None else f" {word} {x}"
        return out


def bare(x):
    """x without parentheses around it."""
    while isinstance(x, Paren):
        x = x.x
    return x
