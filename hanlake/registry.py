"""The table of registered queries, and what their modules share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CH = "ChineseCharacter"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def values(*rows: tuple) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


# ---------------------------------------------------------------- tables made of the driver's, in SQL that both engines read
#
# ⟦n⟧ is the character of code point n, as text.char_of() makes it; {part} is a driver's table.


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", re.sub("⟦(.*?)⟧", r"chr((\1)::INTEGER)", sql))


_CHARACTER = (
    r"CASE WHEN \1 BETWEEN 0 AND 55295 OR \1 BETWEEN 57344 AND 1114111 THEN decode(unhex('0000FEFF' || lpad(hex(CAST(\1 AS BIGINT)), 8, '0')), 'utf-32') "
    r"ELSE concat('⟦', hex(CAST(\1 AS BIGINT)), '⟧') END"
)


def made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(re.sub("⟦(.*?)⟧", _CHARACTER, sql), **{n: table(spark, d, n) for n in names})


def with_tables(tables: dict[str, str], sql: str) -> str:
    """sql over those of the made tables that it (or one that it needs) names, as common table expressions."""
    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in tables:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
                todo.append(tables[name])
    found = ", ".join(f"{n} AS ({duck(tables[n])})" for n in tables if n in need)
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"^\s*WITH( RECURSIVE)?\s", "", sql) if re.match(r"\s*WITH\s", sql) else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    return duck(head + found + (", " + rest if rest else " " + sql)) if found else duck(sql)
