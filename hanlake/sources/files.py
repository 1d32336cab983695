"""Finding files and tables: search paths, links on pages, downloads, other databases, configured namespaces."""

from __future__ import annotations

import configparser
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def find_file(spark: SparkSession, names: str | Sequence[str], folders: Sequence[str]) -> str:
    """The first of the names (file names or patterns of them) in the first folder that has it."""
    names = [names] if isinstance(names, str) else list(names)
    for name in names:
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
            if found:
                return str(sorted(str(x.getPath()) for x in found)[-1])
    raise FileNotFoundError(f"none of {names} in {list(folders)}")


@dataclass(frozen=True)
class Release:
    """Where a dictionary is fetched from. link, date: patterns on the page, whose first group counts; without a page, link is the address."""

    link: str
    page: str | None = None
    date: str | None = None

    def on(self, text: str) -> tuple[str, str | None]:
        """The link and the date on a page's text."""
        link = re.search(self.link, text)
        if link is None:
            raise ValueError(f"nothing like {self.link!r} on the page")
        date = re.search(self.date, text) if self.date else None
        return link[1], date and date[1]


def fetch(release: Release, folder: str) -> tuple[str, str | None]:
    """Downloads a release; the file's path and its date as written (of the page, else of the answer's Last-Modified)."""
    link, date = release.link, None
    if release.page:
        with urllib.request.urlopen(release.page) as page:
            link, date = release.on(page.read().decode("utf-8", "replace"))
        link = urllib.parse.urljoin(release.page, link)
    with urllib.request.urlopen(link) as answer:
        path = Path(folder) / link.rpartition("/")[2]
        path.write_bytes(answer.read())
        return str(path), date or answer.headers.get("Last-Modified")


def jdbc_namespace(spark: SparkSession, url: str, tables: Sequence[str], **options) -> dict:
    """A namespace of tables of another database, each read when it is first asked for."""
    def one(name: str):
        return lambda: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()

    return {name: one(name) for name in tables}


def parquet_namespace(spark: SparkSession, folder: str) -> dict:
    """A namespace of the tables <folder>/<Table>.parquet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return {(p := str(x.getPath())).rpartition("/")[2].removesuffix(".parquet"): (lambda p=p: spark.read.parquet(p)) for x in found}


def configured(spark: SparkSession, config: str) -> list[dict]:
    """Namespaces as a configuration's text lists them: [Tables] folder = a b, then any [Database <name>] with url and tables."""
    parser = configparser.ConfigParser()
    parser.read_string(config)
    found = []
    if parser.has_option("Tables", "folder"):
        found += [parquet_namespace(spark, f) for f in parser["Tables"]["folder"].split()]
    for section in parser.sections():
        if section.startswith("Database"):
            options = dict(parser[section])
            found.append(jdbc_namespace(spark, options.pop("url"), options.pop("tables").split(), **options))
    return found


# ---------------------------------------------------------------- single rows


def first_row(rows: DataFrame) -> tuple | None:
    found = rows.limit(1).collect()
    return tuple(found[0]) if found else None


def first_value(rows: DataFrame):
    """The first column of the first row; null if there is no row."""
    row = first_row(rows)
    return row[0] if row else None


def iterate(rows: DataFrame) -> Iterator[tuple]:
    """Rows one after another, a partition at a time on the driver."""
    return (tuple(r) for r in rows.toLocalIterator())


def iterate_values(rows: DataFrame) -> Iterator:
    return (r[0] for r in rows.toLocalIterator())
