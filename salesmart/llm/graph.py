"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) long. Returns (node, root) for every node of a link, root being the least
    node of its component. Every round takes the least label of the neighbours and then the label
    of that label (pointer jumping); a round's labels are written to the shared folder."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root"))
        new = stored(new, "labels")
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels
