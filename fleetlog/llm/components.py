"""Connected components of a table of links, without leaving Spark."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.textkit import checkpointed, shared_folder


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of the links ``a, b``; the label is the
    smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, until none changes: the rounds grow with the logarithm
    of a component's diameter.  Minima are pre-aggregated, so a node with many
    links is one row a task.  Null ends are left out; no links give no rows.

    Rounds are written as Parquet, each over the one before the last, as a checkpoint keeps
    its plan's estimated size: a product over the joins, whose digits would double a round."""
    links = links.select("a", "b").dropna()
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    folder = f"{shared_folder(links.sparkSession)}/labels-{uuid.uuid4().hex}"
    for turn in itertools.count():
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = new.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old")
        path = f"{folder}/{turn % 2}"
        new.write.mode("overwrite").parquet(path)
        new = links.sparkSession.read.schema(new.schema).parquet(path)
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
