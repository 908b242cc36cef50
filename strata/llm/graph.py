"""Connected components of an edge table by minimum labels, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): of every node of ``edges`` (a, b), the smallest node that
    can be reached.  ``labels`` may give labels known from earlier edges, which
    must be smaller nodes of the same component.

    Each round takes the smallest label among a node and its neighbours, then
    follows the label's own label once, so paths shorten by half or better; it ends
    when a round changes nothing.  Rounds are written tables: lineage stays short.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct()
    both = common.materialize(both, "edges")
    now = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    if labels is not None:
        older = labels.select("node", F.col("label").alias("older"))
        now = now.join(older, "node", "full").select("node", F.least("label", "older").alias("label"))
    written = now = common.materialize(now, "labels")
    while True:
        of_other = now.select(F.col("node").alias("other"), F.col("label").alias("offer"))
        offers = both.join(of_other, "other").groupBy("node").agg(F.min("offer").alias("offer"))
        best = now.join(offers, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        of_label = now.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = best.join(of_label, "label", "left").select(
            "node", "old", F.least(F.col("label"), F.col("jump")).alias("label")
        )
        after = common.materialize(after, "labels")
        common.discard(written)
        written, now = after, after.select("node", "label")
        if after.filter("label < old").isEmpty():
            common.discard(both)
            return now
