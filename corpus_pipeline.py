"""A corpus from documents: toxicity, near duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes each one's result
to the shared folder and reads it again. All but the last return the columns of docs.

Defined cases: an empty table stays empty; null texts are kept as empty by filters and never rewritten; repeated rows are
copies of each other, so that one stays after near_duplicates; further columns pass through whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import jaccard, mixing, packing, secrets, toxicity
from lodeframe.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    return toxicity.keep_clean(docs, toxicity.model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id (a missing one last), of those the one with the
    least text hash. Rows of one id, or without one, are judged each by their text."""
    return jaccard.deduplicated(docs, jaccard.STAGE_SHINGLE, jaccard.STAGE_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding of the scan is replaced in its text."""
    return secrets.redacted(docs, secrets.network(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, documents repeated or cut as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token sequences."""
    return packing.place(stored(packing.pieces(docs)))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("pack", pack)]

#: SQL has neither the network nor the ordinal model: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
