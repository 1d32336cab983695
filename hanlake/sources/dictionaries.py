"""Bilingual dictionaries as tables: EDICT and CEDICT lines, records between *** lines, archives and other encodings."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDICT_LINE = r"^\s*(\S+)\s*(?:\[([^\]]*)\]\s*)?(/.*/)\s*$"
CEDICT_LINE = r"^\s*(\S+)(?:\s+(\S+))?\s*\[([^\]]*)\]\s*(/.*/)\s*$"


@dataclass(frozen=True)
class Format:
    """How a dictionary's file is read: columns three (headword) or four (traditional and simplified), encoding, lines to skip."""

    name: str
    four: bool = True
    encoding: str = "utf-8"
    skip: int = 0


FORMATS = {f.name: f for f in (Format("EDICT", False, "euc-jp", 1), Format("CEDICT"), Format("CEDICTGR", False, "big5hkscs"), Format("HanDeDict"), Format("CFDICT"))}


def unpack(raw: bytes, member: str | None = None) -> bytes:
    """The one file, or the named one, of a zip or (packed) tar archive; gzip and bzip2 files; other bytes as they are."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return z.read(member or z.namelist()[0])
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            names = [m for m in t.getmembers() if m.isfile() and (member is None or m.name == member)]
            return t.extractfile(names[0]).read()
    except tarfile.ReadError:
        pass
    if raw[:2] == b"\x1f\x8b":
        import gzip

        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        import bz2

        return bz2.decompress(raw)
    return raw


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8", member: str | None = None) -> DataFrame:
    """(line_no, value) of one text file. Plain UTF-8 is read by lines in parallel; archives and other encodings as a whole."""
    if encoding.lower().replace("-", "") == "utf8" and not re.search(r"\.(zip|tar|tgz|tbz2?|tar\.\w+)$", path):
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")

    @F.pandas_udf("array<string>")
    def lines(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: unpack(bytes(raw), member).decode(encoding, "replace").splitlines())

    return spark.read.format("binaryFile").load(path).select(F.posexplode(lines("content")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


def parse_edict(lines: DataFrame, skip: int = 0) -> DataFrame:
    """Headword, Reading (null if left out), Translation. Comments, blank and unreadable lines are left out."""
    rows = lines.where((F.col("line_no") >= skip) & ~F.col("value").startswith("#") & F.col("value").rlike(EDICT_LINE))
    part = lambda i: F.regexp_extract("value", EDICT_LINE, i)
    return rows.select(part(1).alias("Headword"), F.when(F.col("value").rlike(r"^\s*\S+\s*\["), part(2)).alias("Reading"), part(3).alias("Translation"))


def parse_cedict(lines: DataFrame, skip: int = 0) -> DataFrame:
    """HeadwordTraditional, HeadwordSimplified (null if left out), Reading, Translation."""
    rows = lines.where((F.col("line_no") >= skip) & ~F.col("value").startswith("#") & F.col("value").rlike(CEDICT_LINE))
    part = lambda i: F.regexp_extract("value", CEDICT_LINE, i)
    return rows.select(part(1).alias("HeadwordTraditional"), F.nullif(part(2), F.lit("")).alias("HeadwordSimplified"), part(3).alias("Reading"), part(4).alias("Translation"))


def read_dictionary(spark: SparkSession, path: str, format: str | Format, member: str | None = None) -> DataFrame:
    spec = FORMATS[format] if isinstance(format, str) else format
    lines = read_lines(spark, path, spec.encoding, member)
    return (parse_cedict if spec.four else parse_edict)(lines, spec.skip)


def newest_file(spark: SparkSession, folder: str, pattern: str = r"handedict-(\d{8})\..*") -> str | None:
    """The path of the file with the latest date in its name."""
    found = max(((m[1], path) for path in _listed(spark, folder) if (m := re.fullmatch(pattern, path.rpartition("/")[2]))), default=None)
    return found and found[1]


def _listed(spark: SparkSession, folder: str, step: int = 10_000) -> Iterator[str]:
    """The paths in a folder, fetched many at a time: calls for each file would take longer than the listing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
    for i in range(0, len(paths), step):
        n = min(step, len(paths) - i)
        some = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, n)
        jvm.java.lang.System.arraycopy(paths, i, some, 0, n)
        yield from jvm.org.apache.hadoop.util.StringUtils.join("\0", jvm.java.util.Arrays.asList(some)).split("\0")


def parse_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, fields): blocks between *** lines, each a map of its lines' keys and values; the last block counts too."""
    blocks = spark.read.option("lineSep", "***").text(path).select(F.monotonically_increasing_id().alias("record"), "value")
    pairs = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\s*\S+\s+\S"))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\S+)\s+(.*?)\s*$", 1), F.regexp_extract(x, r"^\s*(\S+)\s+(.*?)\s*$", 2))))
    return blocks.where(F.size(pairs) > 0).select("record", fields.alias("fields"))


def wenlin_entries(records: DataFrame) -> DataFrame:
    """HeadwordTraditional, HeadwordSimplified, Reading, Translation: numbered fields of a key are put together in order.

    A headword 简体[繁-] gives both forms; - in brackets is the same character.
    """
    values = lambda key: F.transform(F.array_sort(F.filter(F.map_entries("fields"), lambda e: e["key"].rlike(rf"^\d*{key}\d*$"))), lambda e: e["value"])
    head = F.try_element_at(values("char"), F.lit(1))
    simple, full = F.regexp_extract(head, r"^([^\[]*)", 1), F.regexp_extract(head, r"\[(.*)\]", 1)
    merged = F.array_join(F.transform(F.split(full, ""), lambda c, i: F.when(c == "-", F.substring(simple, i + 1, 1)).otherwise(c)), "")
    return records.select(
        F.when(full == "", simple).otherwise(merged).alias("HeadwordTraditional"), simple.alias("HeadwordSimplified"),
        F.try_element_at(values("pinyin"), F.lit(1)).alias("Reading"), F.concat(F.lit("/"), F.array_join(values("(?:df|def)"), "/"), F.lit("/")).alias("Translation"),
    ).where("HeadwordTraditional is not null")
