"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id that edges reach.

    Each round takes the smallest label among an id's neighbours, then the label of its label, so that a path of
    length n needs about log n rounds. Labels and edges stay distributed; a round's labels are checkpointed.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "id"))
    while True:
        near = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("near"))
        mine = labels.join(near, labels["id"] == near["u"]).select("id", "component", F.least("component", "near").alias("next"))
        # hook the old label to the new one, then jump: what the label's own label is now
        hooks = mine.filter("next < component").groupBy("component").agg(F.min("next").alias("hook")).select(F.col("component").alias("old"), "hook")
        moved = mine.join(hooks, mine["component"] == hooks["old"], "left").select("id", "component", F.least("next", F.coalesce("hook", "next")).alias("next"))
        top = moved.select(F.col("id").alias("top"), F.col("next").alias("further"))
        after = checkpointed(moved.join(top, moved["next"] == top["top"], "left").select("id", "component", F.least("next", F.coalesce("further", "next")).alias("next")))
        labels = after.select("id", F.col("next").alias("component"))
        if after.filter("next <> component").isEmpty():
            return labels
