"""The engine: a Spark session, a catalog, and queries of the dialect as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession

from . import types
from .plans.binder import Binder
from .plans.parser import parse_expression, parse_query
from .plans.planner import Answer, plan
from .plans.tree import Query
from .result import as_json
from .sources.catalog import Catalog


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark, folder)

    def run(self, q: Query) -> Answer:
        source = None if q.dataset is None else self.catalog.dataset(q.dataset, q.version)
        return plan(self.spark, q, source, [self.catalog.dataset(j.source.dataset, j.source.version) for j in q.joins])

    def sql(self, text: str) -> DataFrame:
        return self.run(parse_query(text)).df

    def json(self, text: str) -> str:
        return as_json(self.run(parse_query(text)))


def compile_expression(text: str, df: DataFrame) -> Column:
    """A Column over df (normalised) from an expression's text."""
    return Binder(types.normalised(df).schema).bind(parse_expression(text)).column


def over_parquet(spark: SparkSession, paths: dict[str, str]) -> Engine:
    """An engine whose datasets are Parquet files, read in place."""
    e = Engine(spark)
    for name, path in paths.items():
        e.catalog.view(name, spark.read.parquet(path))
    return e
