"""Release dates of dictionaries: reading them in several formats, and comparing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: How release dates are written: in headers of HTTP answers, on pages, in file names.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "dd MMM yyyy HH:mm:ss")


def release_date(c: str | Column, formats: Sequence[str] = FORMATS) -> Column:
    """A timestamp, midnight where no time is written; null where no format fits. A week day before it and a zone behind it are left out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(col(c), r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|Z)\s*$", ""))
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in formats))


def is_newer(newest: str | Column, current: str | Column) -> Column:
    """Whether there is a newer release than the current one; any is newer than none."""
    newest, current = col(newest), col(current)
    return F.when(newest.isNull(), F.lit(False)).otherwise(current.isNull() | (newest > current))
