"""Sharding by rendezvous hashing, in DataFrame functions only.

Every (record key, shard) pair has a hash; a record goes to the shard with the best score -ln(u) / weight (least wins; u
is the hash as a fraction), so a further shard only draws records to itself, and a shard's share follows its weight.
Slots within a shard come from prefix counts over ranges of a hash of the key, so no task holds a whole shard.

Defined cases: a null doc_id is a key like any other; null text has size 16 and CRC 0; repeated rows share a shard and
get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, stored, table

SHARDS = 40
#: Hex digits of the key's hash that name its range within a shard.
RANGE_DIGITS = 2


def pick(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a string key that is not null."""
    hashes = [F.md5(F.concat(key, F.lit(f"/{s}"))) for s in range(len(weights))]
    if len(set(weights)) == 1:  # -ln(u) / w falls as u rises: the greatest hash wins
        scored = [F.struct(h.alias("h"), F.lit(s).alias("s")) for s, h in enumerate(hashes)]
        return F.greatest(*scored)["s"] if len(scored) > 1 else F.lit(0)
    scored = [F.struct((-F.log((F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))) / F.lit(float(w))).alias("h"), F.lit(s).alias("s")) for s, (h, w) in enumerate(zip(hashes, weights))]
    return F.least(*scored)["s"]


def slots(df: DataFrame, shard: str = "shard") -> DataFrame:
    """df (with a string column key) with slot: gapless from 0 in each shard."""
    hashed = df.withColumn("__h", F.md5("key"))
    order = [F.col("__h"), *[F.col(c) for c in df.columns if c != shard]]
    return prefix_sums(hashed, [shard], order, F.substring("__h", 1, RANGE_DIGITS), F.lit(1).cast("long"), "slot").drop("__h")


def op6_rendezvous(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"),
    )
    kept = stored(docs.withColumn("shard", pick(F.col("key"), [1.0] * SHARDS)))
    grown = F.md5(F.concat(F.col("key"), F.lit(f"/{SHARDS}"))) > F.md5(F.concat_ws("/", F.col("key"), F.col("shard").cast("string")))
    out = slots(kept).withColumn("grown_shard", F.when(grown, F.lit(SHARDS)).otherwise(F.col("shard")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP6_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes
      FROM documents),
s AS (SELECT doc_id, key, CAST(len(bytes) + 16 AS BIGINT) AS size,
             CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS BIGINT) AS text_crc32,
             list_max(list_transform(range(40), lambda i: struct_pack(h := md5(key || '/' || i), i := i))).i AS shard,
             list_max(list_transform(range(41), lambda i: struct_pack(h := md5(key || '/' || i), i := i))).i AS grown
      FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM s
"""

QUERIES = {"op6_rendezvous": op6_rendezvous}
SQL = {"op6_rendezvous": OP6_SQL}
