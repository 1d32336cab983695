"""The library's column functions over streams: they keep no state, so a stream is a table that grows and needs no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import readings as rd


def read_texts(spark, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of lines of the text files that appear in a folder."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def convert_stream(rows: DataFrame, column: str, converter, out: str = "converted") -> DataFrame:
    """Adds the converted column and an error column."""
    return rows.withColumn("_x", rd.convert(F.col(column), converter)).withColumn(out, F.col("_x.value")).withColumn(f"{out}_error", F.col("_x.error")).drop("_x")


def lookup_stream(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Joins a stream with a table that stays as it is: the table is read once a batch, and a side is broadcast only if Spark finds it small."""
    return rows.join(table, on, "left")


def filter_stream(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(condition)


def write_parquet(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts the stream into a folder, exactly once a row; once: until what is there is worked off."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
