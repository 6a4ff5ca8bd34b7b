"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import dropped, written


def components(links: DataFrame) -> DataFrame:
    """`id` and `component`, the smallest id reachable, of every id in the links (`a`, `b`).

    Every round each id takes the smallest label among its own and its neighbours', and
    then the label of that label, so paths shrink by more than half. Each round is
    written, so rounds don't pile up in the lineage. A hub meets its neighbours in a join
    whose large partitions can be split, and its label is a partial minimum.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("low"))
        of = labels.select(F.col("id").alias("of"), F.col("component").alias("next"))
        jumped = met.join(of, met["low"] == of["of"])
        new = written(jumped.select("id", F.least("low", "next").alias("component"), (F.least("low", "next") < F.col("component")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        dropped(labels)
        labels = new.select("id", "component")
        if not moved:
            return labels
