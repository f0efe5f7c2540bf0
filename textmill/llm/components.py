"""Connected components of a link table, by rounds of minima and pointer jumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.frames import remove, stored
from textmill.session import shared_folder


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that it is connected with.

    Each round takes the least label among a node and its neighbours, aggregated
    before it is shuffled, then the label of that label. Rounds end when none
    changes. Edges and each round's labels are small tables in the cluster's shared
    folder, so the plan stays short, a lost executor costs one round, and Spark knows
    their size: a few files are one task's, and small labels are broadcast. A
    checkpoint has as many tasks as the shuffle before it, in every round again. The
    last labels stay in the folder, the others are removed.
    """
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/components_{uuid.uuid4().hex}"
    pairs = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]
    both = stored(links.where("a <> b").select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").distinct(), f"{folder}/edges")
    labels, number = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), f"{folder}/labels_0"), 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = seen.groupBy("a").agg(F.min("label").alias("mid"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        number += 1
        moved = stored(near.join(jump, "mid").select(F.col("a").alias("node"), "old", F.least("mid", "far").alias("label")), f"{folder}/labels_{number}")
        remove(spark, f"{folder}/labels_{number - 1}")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            remove(spark, f"{folder}/edges")
            return labels
