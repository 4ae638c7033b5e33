"""Small relational helpers on DataFrames."""

from pyspark.sql import Column, DataFrame


def ordering(c: Column, down: bool, nulls_first: bool) -> Column:
    """A sort key whose null placement is always explicit."""
    if down:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def uniquely(df: DataFrame, names: list[str]) -> DataFrame:
    """df with these output names, which may repeat."""
    return df.toDF(*names)


def storable(df: DataFrame) -> DataFrame:
    """df with repeated names told apart by a number, as files need."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if n == 1 else f"{c}_{n:02d}")
    return df.toDF(*names)
