"""What the operators share: shared scratch tables, column checks, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer; a missing one is ignored."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of a batch that goes to a Python worker, unless the session says otherwise: texts may be long.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, str(ARROW_BYTES))


class Scratch:
    """Tables written to the shared folder, to cut lineage; ``drop`` deletes them.

    What is still there when the session's process ends is deleted then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count, self.paths = 0, {}
        bounded_batches(spark)
        atexit.register(self._quietly_drop)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write and read again: later jobs start from the files, whichever executors are lost."""
        path = self.path(name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *names: str) -> None:
        """Delete tables of these names that nothing will read again."""
        for name in names:
            for path in self.paths.pop(name, []):
                delete_path(self.spark, path)

    def drop(self) -> None:
        delete_path(self.spark, self.root)

    def _quietly_drop(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # noqa: BLE001  the JVM is already gone; nothing is left to tell
                pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    ``edges`` holds (a, b) long.  Each round, in plain DataFrame joins: every node takes the smallest
    label among its neighbours, and then the label of its label (pointer jumping), so chains shorten
    by a power each round.  Ends when no label changes.  The tables that a join reads come straight from
    files, so that Spark can split the rows of a hub.
    """
    both = scratch.write(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = scratch.write(
            both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near")), "near"
        )
        # what a node hears also goes to its present label, so whole trees move at once
        hear = labels.join(near, F.col("id") == F.col("nid")).select("id", "label", F.least("label", "near").alias("low"))
        hear = scratch.write(hear, "hear")
        root = scratch.write(hear.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("root_low")), "roots")
        moved = hear.join(root, F.col("label") == F.col("root"), "left").select("id", "label", F.least("low", "root_low").alias("low"))
        moved = scratch.write(moved, "moved")
        jump = moved.select(F.col("id").alias("jid"), F.col("low").alias("jump"))
        after = scratch.write(
            moved.join(jump, F.col("low") == F.col("jid"), "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("new"), "label"),
            "labels",
        )
        changed = after.where("new <> label").limit(1).count()
        scratch.discard("near", "hear", "roots", "moved")
        labels = after.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
