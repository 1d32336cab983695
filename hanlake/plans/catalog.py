"""An ordered search path of namespaces: the first one that has a table gives it. Character domains are tables <Name>Set."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

CHARACTER = "ChineseCharacter"


class Catalog:
    def __init__(self, *namespaces: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.namespaces = list(namespaces) or [{}]

    def register(self, name: str, table: DataFrame | Callable[[], DataFrame], namespace: int = 0) -> None:
        self.namespaces[namespace][name] = table

    def attach(self, namespace: dict) -> None:
        """A further namespace, behind the others."""
        self.namespaces.append(namespace)

    def __contains__(self, name: str) -> bool:
        return any(name in n for n in self.namespaces)

    def __getitem__(self, name: str) -> DataFrame:
        for n in self.namespaces:
            if name in n:
                if not isinstance(n[name], DataFrame):
                    n[name] = n[name]()
                return n[name]
        raise KeyError(name)

    def names(self) -> list[str]:
        return sorted({x for n in self.namespaces for x in n})

    def domains(self) -> list[str]:
        """Character domains: Unicode, and all tables <Name>Set with a column of characters."""
        return ["Unicode", *(x[:-3] for x in self.names() if x.endswith("Set") and CHARACTER in self[x].columns)]

    def domain(self, name: str) -> DataFrame | None:
        """A domain's characters; null for Unicode, which restricts nothing that is stored."""
        if name == "Unicode":
            return None
        if f"{name}Set" not in self or CHARACTER not in self[f"{name}Set"].columns:
            raise ValueError(f"no character domain {name!r}")
        return self[f"{name}Set"].select(CHARACTER)

    def within(self, rows: DataFrame, domain: str, column: str = CHARACTER) -> DataFrame:
        """Rows whose character is in the domain."""
        chars = self.domain(domain)
        return rows if chars is None else rows.join(chars.select(F.col(CHARACTER).alias(column)), column, "left_semi").select(rows.columns)


def unicode_domain(spark) -> DataFrame:
    """All Han characters, from their code point ranges."""
    parts = [spark.range(low, high + 1) for low, high in text.HAN_RANGES]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.select(text.char_of("id").alias(CHARACTER))


def assert_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, if no two have the same keys; one aggregation that stops at the first clash."""
    clash = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"more than one row with {keys} = {tuple(clash[0])[:-1]}")
    return rows
