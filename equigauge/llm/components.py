"""Connected components of a graph of links, by labels that spread and jump.

Each round a node takes the smallest label among its own and its neighbours', then the label of
its label, so that chains shorten by half. Labels are written to the shared folder each round; the
joins read both sides from there, so that a node with very many links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigauge.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node of ``links`` (a, b)."""
    ways = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = staged(ways.filter("a <> b").distinct(), "links")
    labels = staged(
        ways.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("label"), F.lit(True).alias("changed")
        ),
        "labels",
    )
    while labels.filter("changed").head(1):
        near = (
            ways.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("low"))
        )
        spread = staged(
            labels.join(near, F.col("node") == F.col("a")).select(
                "node", F.col("label").alias("old"), F.least("label", "low").alias("label")
            ),
            "labels",
        )
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = staged(
            spread.join(jump, "label").select(
                "node", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed")
            ),
            "labels",
        )
    return labels.select("node", "label")
