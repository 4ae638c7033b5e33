"""Delimited text to typed DataFrames. All columns are read as text, one aggregate pass infers types, casts follow."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..errors import IngestError
from .sniff import Format, clean_all

#: The texts that are booleans, and the shapes of the other types.
TRUE, FALSE = ("t", "T", "true", "TRUE"), ("f", "F", "false", "FALSE")
INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{3}|\.[0-9]{6})?$"
KINDS = ("bool", "int", "float", "date", "datetime", "string")


def parsed(c: Column, kind: str) -> Column:
    """The typed value of a text, null if it has none. Empty texts are null, but stay texts in string columns."""
    if kind == "bool":
        return F.when(c.isin(*TRUE), F.lit(True)).when(c.isin(*FALSE), F.lit(False))
    if kind == "int":
        return F.when(c.rlike(INT), c.try_cast("bigint"))
    if kind == "float":
        return F.when(c.rlike(FLOAT), c.try_cast("double"))
    if kind == "date":
        return F.when(c.rlike(DATE), c.try_cast("date"))
    if kind == "datetime":
        return F.when(c.rlike(DATETIME), c.try_cast("timestamp_ntz"))
    return F.coalesce(c, F.lit("")) if kind == "string" else F.lit(None).cast("string")


#: A bit for each type, so that one aggregate gathers all that a column's texts are of.
BITS = {k: 1 << i for i, k in enumerate((*KINDS, "null"))}


def kind_of(c: Column) -> Column:
    """The bit of the first type that a text is of."""
    out = F.when(c.isNull() | (c == ""), F.lit(BITS["null"]))
    for k in KINDS[:-1]:
        fits = parsed(c, k).isNotNull()
        out = out.when(fits | c.rlike(NOT_FINITE) if k == "float" else fits, F.lit(BITS[k]))
    return out.otherwise(F.lit(BITS["string"]))


def decide(seen: set[str]) -> str:
    kinds = seen - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    return "float" if kinds == {"int", "float"} else "string"


def infer(texts: DataFrame) -> list[tuple[str, bool]]:
    """Type and nullability of each column, from all rows in one pass: values are judged one after the other, so that the
    generated code stays small whatever the number of columns."""
    values = texts.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in texts.columns])))
    found = {r["pos"]: r["bits"] for r in values.groupBy("pos").agg(F.bit_or(kind_of(F.col("col"))).alias("bits")).collect()}  # a row a column
    if not found:
        raise IngestError("no rows: types can't be inferred")
    out = []
    for i in range(len(texts.columns)):
        seen = {k for k, bit in BITS.items() if found[i] & bit}
        out.append((decide(seen), "null" in seen))
    return out


def typed(texts: DataFrame, kinds: list[str]) -> DataFrame:
    return texts.select(*[parsed(F.col(f"`{c}`"), k).cast(types.SPARK[k]).alias(c) for c, k in zip(texts.columns, kinds)])


def quoted_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may hold a line's end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).limit(1).count())


def read_texts(spark: SparkSession, path: str, fmt: Format, header: list[str]) -> DataFrame:
    """All columns as text. A row of another width than the header's is an error, raised when it is read.

    Tabs know no quoting. Only a file with line ends inside quotes is read as a whole; others are split among tasks."""
    names = clean_all(header)
    bad = "__bad"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    tabs = fmt.delimiter == "\t"
    quoting = {"quote": "", "escape": ""} if tabs else {"quote": '"', "escape": '"'}
    whole = not tabs and quoted_lines(spark, path)
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, multiLine=whole, sep=fmt.delimiter, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, encoding="UTF-8", **quoting)
    wrong = F.raise_error(F.concat(F.lit("row of another width than the header: "), F.col(bad)))
    first = F.when(F.col(bad).isNotNull(), wrong.cast("string")).otherwise(F.col(names[0]))
    return df.select(first.alias(names[0]), *names[1:])


def from_map(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    """Columns of texts, sorted by name, of equal lengths."""
    if len({len(v) for v in columns.values()}) > 1:
        raise IngestError("columns have different lengths")
    names = sorted(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in clean_all(names)])
    return spark.createDataFrame(list(zip(*[columns[n] for n in names])), schema)
