"""Shared helpers: tables, the shared folder, distributed ranks and prefix sums."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests, one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a folder that driver and executors share: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="lode-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Where tables made by stored() are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, *, plain: bool = False, by: str | None = None) -> DataFrame:
    """df, written to a new table in the shared folder and read again: computed once, lineage cut, survives lost executors.
    The table goes when the session's process ends, or with discard().

    plain: the columns are blobs that are compressed already. by: a column whose values are folders of their own, so that
    discard() can take one of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lode-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.enable.dictionary", "false").option("compression", "uncompressed") if plain else df.write
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Deletes stored tables that nothing will read again, or the part of each ("column=value") that nothing will."""
    for df in tables:
        path = f"{_paths[df]}/{part}" if part else _paths.pop(df)
        fs, p = _file_system(df.sparkSession, path)
        fs.delete(p, True)


def swept(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that have ended: Spark removes them when the driver collects garbage, which a
    driver with little to do puts off for half an hour."""
    spark._jvm.System.gc()


def scan_partitions(df: DataFrame) -> int:
    """Partitions of the scan under df: they follow the input's size."""
    return max(1, df.rdd.getNumPartitions())


def spread(df: DataFrame, least: int = 1) -> int:
    """How many parts to deal keys into: in proportion to the input, at least the session's shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * scan_partitions(df))


def met(rows: DataFrame, facts: DataFrame, on: str | tuple[str, ...], salts: int, how: str = "inner") -> DataFrame:
    """rows joined with facts on their key, however many rows one key has: a key's rows are dealt to `salts` places by a
    hash of all their columns, and the facts of a key are copied to those of its places that have rows."""
    on = [on] if isinstance(on, str) else list(on)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)))
    copies = facts.join(dealt.select(*on, "__salt").distinct(), on)
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def word_count(text: str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ (null: 0), without Python: white space folded to one space each side."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], bucket: Column, value: Column, out: str, facts: DataFrame | None = None) -> DataFrame:
    """df with the exclusive prefix sum `out` of value within group, in the order (bucket, *order), and with the columns
    of facts (one row a group), if given.

    bucket must not fall as the order rises. Groups are cut into buckets that are summed first; each bucket then starts
    from the sum of those before it, so that a hot group never meets in one task: a task holds one bucket of rows, or a
    group's bucket totals. Facts travel with the bucket totals, so df is dealt out once. The group columns hold no null.
    """
    b, start = "__bucket", "__start"
    d = df.withColumn(b, bucket)
    totals = d.groupBy(*group, b).agg(F.sum(value).alias(start))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    more = [] if facts is None else [c for c in facts.columns if c not in group]
    totals = totals if facts is None else totals.join(facts, group)
    within = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return d.join(totals, [*group, b]).select(*df.columns, *more, (F.col(out) + F.col(start)).alias(out))
