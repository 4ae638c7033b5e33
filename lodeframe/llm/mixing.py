"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, an exact cut.

Each document gets a hash-random key. Within a source documents are ordered by it, in ranges of the key; prefix sums of
their sizes are taken range by range (common.prefix_sums), so a source with a third of all rows spreads over all tasks.
A source whose budget is B and whose size is S gives floor(B / S) whole epochs, and from one more the first B mod S
words in key order, cut within a document.

Defined cases: null text has size 0; null source is a source of its own, last; repeated rows are taken like others; an
empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, spread, stored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Hex digits of the key that name its range: a source of n rows has about n / 16 ** RANGE_DIGITS in a range.
RANGE_DIGITS = 3


def source_key(column: str = "source") -> Column:
    """Sorts by code point, null last, and is never null."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source_size, target) from (skey, size): weights by the sources' order, in turn; no target above most times
    its source's size, the excess reshared by weight until none is above.

    The fixed point of resharing is target = min(most * size, level * weight) with one level for all; it rises to that
    level in steps, each one aggregate over the table of sources. Ranks come from range-partitioned counts.
    """
    spark = sized.sparkSession
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ordered = sizes.repartitionByRange(spread(sized), "skey").sortWithinPartitions("skey").withColumn("id", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("part", F.shiftright("id", 33)))
    parts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, start = {}, 0
    for p in sorted(parts):
        before[p], start = start, start + parts[p]
    first = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = first[F.col("part").cast("long" if before else "int")] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = stored(ordered.select("skey", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        r = t.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("c"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        level, full = max(level, (share * total - r["c"]) / r["w"]), r["n"]
    return spark.createDataFrame([], "skey string, source_size long, target double") if not total and not parts else t.select("skey", "source_size", F.least(cap, F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def take(sized: DataFrame, plan: DataFrame, order: list[str]) -> DataFrame:
    """sized (skey, size, key and more) with source_size, target, epochs (whole ones) and part (words of one more).

    order: columns that follow the key, so that rows with one key have an order."""
    at = prefix_sums(sized, ["skey"], [F.col(c) for c in ("key", *order)], F.substring("key", 1, RANGE_DIGITS), F.col("size"), "before", plan)
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return at.withColumn("epochs", epochs).withColumn("part", part)


def first_words(text: Column, words: Column) -> Column:
    """The start of a text, up to the end of so many words (at least one, fewer than it has); nothing else is changed."""
    blank = r"[\x20\x09-\x0D]+"
    rest = F.element_at(F.split(F.regexp_replace(text, "^" + blank, ""), blank, (words + 1).cast("int")), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), blank + "$", "")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each whole epoch, and once more, cut after its last
    word taken, for a part. A document of no words comes once if its source gives
    any epoch or part at all."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), source_key().alias("skey"), word_count("text").alias("size"), key().alias("key"), F.xxhash64("text").alias("hash"))
    sized = stored(rows.select("skey", "size"))
    t = take(rows, targets(sized), ["hash", "size"])
    whole = F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.when(F.col("target") > 0, F.lit(1)).otherwise(F.lit(0)))
    copies = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when((F.col("part") > 0) & (F.col("size") > 0), F.array("part")).otherwise(F.expr("array()").cast("array<bigint>")))
    t = t.withColumn("words", F.explode(copies))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    t = t.withColumn("text", text)
    out = {c: F.col("row").getField(c) for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("words") < F.col("size"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return t.select(*[e.alias(c) for c, e in out.items()])


def key(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", source_key().alias("skey"), word_count("text").alias("size"), key().alias("key")))
    out = take(sized, targets(sized), ["doc_id", "size"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, (ARRAY[5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY skey) - 1) % 3 AS INT) + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio,
             sum(2.0 * source_size) OVER o AS caps, sum(weight) OVER () - sum(weight) OVER o AS open_weight,
             lead(2.0 * source_size / weight) OVER (ORDER BY 2.0 * source_size / weight, skey) AS next_ratio
      FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, skey)),
lv AS (SELECT min(level) AS level FROM (
         SELECT 1.5 * (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM w) AS level
           WHERE (SELECT min(ratio) FROM r) > 1.5 * (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM w)
         UNION ALL
         SELECT (1.5 * (SELECT sum(source_size) FROM s) - caps) / open_weight FROM r
           WHERE open_weight > 0 AND (1.5 * (SELECT sum(source_size) FROM s) - caps) / open_weight >= ratio
             AND (1.5 * (SELECT sum(source_size) FROM s) - caps) / open_weight < next_ratio)),
t AS (SELECT skey, source_size, least(2.0 * source_size, weight * (SELECT level FROM lv))::DOUBLE AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CAST(floor(t.target + 1e-6) AS BIGINT) AS budget
      FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op3_source_mix": op3_source_mix}
SQL = {"op3_source_mix": OP3_SQL}
