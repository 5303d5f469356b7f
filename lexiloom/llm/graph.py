"""Written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: later plans start from the files, so a lost
    executor costs no recomputation, and joins see an unaggregated, splittable input."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by written() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_folder(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that stand for many are numbered in parts of so many.
PART = 1000


def numbered(counted: DataFrame, key: str, n: str = "n", part: int = PART) -> DataFrame:
    """One row for each of the `n` rows that a row of `counted` stands for, with its `number` from 0.
    Rows that stand for more than a part are dealt out part by part, by `key`, before they are
    multiplied, so that no task makes them all."""
    zero = F.lit(0).cast("long")
    few = counted.filter(F.col(n) <= part).withColumn("number", F.explode(F.sequence(zero, F.col(n) - 1)))
    parts = F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / part))).alias("__part")
    many = counted.filter(F.col(n) > part).select("*", parts).repartition(key, "__part")
    last = F.least(F.col(n), (F.col("__part") + 1) * part) - 1
    many = many.withColumn("number", F.explode(F.sequence(F.col("__part") * part, last))).drop("__part")
    return few.unionByName(many)


#: Edges up to this number (32 MB) are joined up inside one task.
IN_ONE_TASK = 2_000_000


def components(edges: DataFrame, tag: str = "cc", most: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Connected components of the undirected graph with long columns a, b: rows (node, root) for
    every node that isn't the smallest of its component; root is that smallest node.

    Up to `in_one_task` edges, counted first, one task on an executor does it. More go through
    alternating large-star and small-star steps (Kiveris et al. 2014) on written edge lists: the
    smallest neighbour is written before it is joined back, so a hub's edges can be dealt to many
    tasks. Self loops and repeated edges are harmless; no edges give no rows."""
    edges = written(edges.filter(F.col("a") != F.col("b")).select("a", "b"), tag)
    if edges.count() <= in_one_task:
        return written(edges.coalesce(1).mapInPandas(_joined_up, "node long, root long"), tag)
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        tag,
    )
    for _ in range(most):
        if _is_star(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # Large star: every larger neighbour of v moves to the smallest neighbour of v.
        least = written(e.groupBy("u").agg(F.min("v").alias("m")), tag)
        large = written(
            e.join(least.select(F.col("u").alias("v"), "m"), "v", "left")
            .select("u", F.coalesce("m", "v").alias("v"))
            .distinct(),
            tag,
        )
        # Small star: u and its smaller neighbours move to the smallest of them.
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), tag)
        for old in (e, least, large, least2):
            dropped(old)
        e = following
    raise RuntimeError(f"no convergence in {most} rounds")


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest node of every node's component, from all edges at once: labels run along edges and
    jump to their labels' labels until nothing changes."""
    parts = [pdf.to_numpy(np.int64) for pdf in batches]
    ends = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    i, j = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    yield pd.DataFrame({"node": nodes[other], "root": nodes[label[other]]})


def _is_star(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bad.filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0
