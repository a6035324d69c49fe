"""Connected components of a graph given as a table of edges, with Spark joins.

Labels start as the node itself. Each round a node takes the smallest label among
its neighbours (a grouped minimum, combined in each task first, so a node with very
many neighbours is one row per task), and then its label's label. Rounds end when
nothing changes; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges``
    (``a, b``, long, not null, in any direction and number)."""
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    # the first round needs no labels: the smallest neighbour
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("m"))
        .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("low")
        )
        # hook: the whole old component may follow its best member; then jump to the label's label
        hooks = step.groupBy(F.col("old").alias("node")).agg(F.min("low").alias("hook"))
        moved = step.join(hooks.select(F.col("node").alias("old"), "hook"), "old").select(
            "node", "old", F.least("low", "hook").alias("low")
        )
        jump = hooks.select(F.col("node").alias("low"), F.col("hook").alias("far"))
        following = written(
            moved.join(jump, "low", "left").select(
                "node", F.least("low", F.coalesce("far", "low")).alias("component"), "old"
            ),
            "labels",
        )
        if not following.where("component <> old").limit(1).count():
            return following.select("node", "component")
        labels = following.select("node", "component")
