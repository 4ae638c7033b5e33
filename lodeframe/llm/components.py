"""Connected components of a link table, without collecting it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, met, stored


def components(links: DataFrame, salts: int) -> DataFrame:
    """(node, label) of all nodes in links (a long, b long); label: the component's smallest node.

    Each round every node takes the least label among its neighbours', then its label's label (so paths halve); the table
    of labels is written to the shared folder each round. Stars end in two rounds. A node that a third of all links lead
    to, or a label that a third of all nodes have, is spread over `salts` places.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    first = label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = met(both, label.select(F.col("node").alias("b"), F.col("label").alias("l")), "b", salts).groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        low = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("low"))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("top"))
        new = stored(met(low, up, "low", salts).select("node", "old", F.least("low", "top").alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        discard(first)
        first, label = new, new.select("node", "label")
        if not changed:
            discard(both)
            return label
