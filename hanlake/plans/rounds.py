"""Rounds of a fixpoint: each round's new rows are written to the shared folder, so no plan grows and no round runs twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="hanlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(rows: DataFrame) -> DataFrame:
    """rows as Parquet in the shared folder, read back. The files go when the JVM ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(rows.schema).parquet(path)


def sized(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows with a hint for joins: broadcast where they are at most ``most`` (counted), else merged by shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


#: Rounds after which a fixpoint that still finds new rows is taken to go round in circles.
ROUNDS = 512


def fixpoint(start: DataFrame, grown: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows that follow from start. grown(known, newest) gives what follows from the newest rows, beside the known ones.

    Rows whose keys are known are dropped; it ends when a round has nothing new, and is an error after ``ROUNDS`` rounds.
    """
    newest = written(start)
    parts = [newest]
    while not newest.isEmpty():
        if len(parts) > ROUNDS:
            raise ValueError(f"still new rows after {ROUNDS} rounds; the input may go round in circles")
        known = reduce(DataFrame.unionByName, parts)
        newest = written(grown(known, newest).dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti").select(start.columns))
        parts.append(newest)
    return reduce(DataFrame.unionByName, parts)
