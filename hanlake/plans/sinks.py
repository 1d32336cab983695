"""Writing tables: keys checked, rows sorted inside their files, versions replaced, tables dropped and their files put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import assert_unique


def _path(spark: SparkSession, folder: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    path, files = _path(spark, folder, name)
    return files.exists(path)


def write_table(rows: DataFrame, folder: str, name: str, keys: Sequence[str] = (), sort_by: Sequence[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """Writes <folder>/<name>.parquet and reads it back.

    keys: no two rows may agree in these. sort_by: rows of a key range stand together and sorted, in place of an index: readers skip files and row
    groups by their least and greatest values. types: columns to cast.
    """
    rows = rows.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})
    rows = assert_unique(rows, keys) if keys else rows
    if sort_by:
        rows = rows.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return rows.sparkSession.read.parquet(f"{folder}/{name}.parquet")


def drop_table(spark: SparkSession, folder: str, name: str) -> bool:
    """Removes a table; whether there was one."""
    path, files = _path(spark, folder, name)
    return bool(files.exists(path) and files.delete(path, True))


def compact(spark: SparkSession, folder: str, name: str, file_rows: int = 1_000_000) -> int:
    """Puts the files of a table together, to about so many rows each; the number of files. The old ones go once the new ones are whole."""
    old = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = max(1, -(-old.count() // file_rows))
    old.coalesce(parts).write.mode("overwrite").parquet(f"{folder}/{name}-compact.parquet")
    drop_table(spark, folder, name)
    (new, files), (path, _) = _path(spark, folder, f"{name}-compact"), _path(spark, folder, name)
    if not files.rename(new, path):
        raise OSError(f"{folder}/{name}-compact.parquet can't be renamed")
    return parts


def install(rows: DataFrame, folder: str, name: str, released, sort_by: Sequence[str] = ()) -> bool:
    """Writes a table unless the folder's Version table has it in this release or a newer one; whether it was written.

    Version (TableName, ReleaseDate) then has the new release in place of the old one.
    """
    spark = rows.sparkSession
    new = spark.createDataFrame([(name, released)], "TableName string, ReleaseDate timestamp")
    versions = spark.read.parquet(f"{folder}/Version.parquet") if exists(spark, folder, "Version") else new.limit(0)
    current = versions.where(F.col("TableName") == name).agg(F.max("ReleaseDate")).first()[0]
    if current is not None and released is not None and released <= current and exists(spark, folder, name):
        return False
    write_table(rows, folder, name, sort_by=sort_by)
    kept = [tuple(r) for r in versions.where(F.col("TableName") != name).collect()]  # one row a table
    write_table(spark.createDataFrame([*kept, (name, released)], new.schema), folder, "Version", ["TableName"])
    return True
