"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node that can be reached.

    Each round takes the least label among the neighbours (sums travel after map-side combination, so a hub is no hot
    key) and then the label of the label, so paths shorten by half; only a count of changes reaches the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        spread = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("own"))
        own = labels.select("node", "comp", F.col("comp").alias("own"))
        low = spread.unionByName(own).groupBy("node").agg(F.min("comp").alias("comp"), F.max("own").alias("own"))
        far = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_far"))
        new = stored(low.join(far, F.col("comp") == F.col("_n")).select("node", F.least("comp", "_far").alias("comp"), "own"), "labels")
        labels = new.select("node", "comp")
        if not new.where("comp <> own").head(1):
            return labels
