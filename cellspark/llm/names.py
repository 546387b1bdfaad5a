"""Columns of our own beside those of a user's table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], name: str) -> str:
    """name, or name after underscores: one that no column has, in either case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def own(name: str) -> Column:
    """The column of this very name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [own(c) for c in df.columns]


def plain(df: DataFrame, kept: Iterable[str] = ("text",)) -> DataFrame:
    """df with columns c0, c1, and so on, but for those of kept names: a Python function takes no name with a dot."""
    return df.toDF(*[c if c in kept else f"c{k}" for k, c in enumerate(df.columns)])
