"""Ideographic description sequences: parsing, writing and checking, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NO_CHARACTER, col

BINARY, TRINARY = "⿰⿱⿴⿵⿶⿷⿸⿹⿺⿻", "⿲⿳"
_TOKEN = rf"([⿰-⿻]|#\d+|(?:{NO_CHARACTER}|.)(?:\[\d+\])?)"


def is_binary(c: str | Column) -> Column:
    return col(c).isin(*BINARY)


def is_trinary(c: str | Column) -> Column:
    return col(c).isin(*TRINARY)


def is_operator(c: str | Column) -> Column:
    return is_binary(c) | is_trinary(c)


def parse(ids: str | Column) -> Column:
    """array<struct<op, char, glyph>>: an operator, or a character and its glyph (0 unless written as X[g])."""
    def one(t: Column) -> Column:
        op = is_operator(t)
        return F.struct(
            F.when(op, t).alias("op"),
            F.when(~op, F.regexp_replace(t, r"\[\d+\]$", "")).alias("char"),
            F.when(~op, F.when(t.rlike(r"\[\d+\]$"), F.regexp_extract(t, r"\[(\d+)\]$", 1).cast("int")).otherwise(0)).alias("glyph"),
        )

    return F.transform(F.regexp_extract_all(col(ids), F.lit(_TOKEN), 1), one)


def write(parsed: str | Column, pure: bool = False) -> Column:
    """The sequence as text; pure: without glyphs."""
    glyph = lambda x: F.when((x["glyph"] == 0) | F.lit(pure), F.lit("")).otherwise(F.concat(F.lit("["), x["glyph"].cast("string"), F.lit("]")))
    return F.array_join(F.transform(col(parsed), lambda x: F.coalesce(x["op"], F.concat(x["char"], glyph(x)))), "")


def components(ids: str | Column) -> Column:
    """The characters and glyphs of a sequence, in order; not its operators, pseudo characters or unknown ones."""
    return F.filter(parse(ids), lambda x: x["char"].isNotNull() & ~x["char"].isin("？", "?") & ~x["char"].startswith("#"))


def is_valid(ids: str | Column) -> Column:
    """Whether a sequence is a whole prefix notation: each operator has its operands and nothing is left over."""
    def step(state: Column, t: Column) -> Column:
        more = F.when(is_binary(t["op"]), F.lit(1)).when(is_trinary(t["op"]), F.lit(2)).otherwise(F.lit(-1))
        return F.when(state <= 0, F.lit(-1)).otherwise(state + more)

    return F.aggregate(parse(ids), F.lit(1), step) == 0
