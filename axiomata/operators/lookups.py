"""Lookups and listings: equality filters in which an absent value means any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where(rows: DataFrame, **equal: object) -> DataFrame:
    """F-01, F-04, F-05, F-07, F-09: the rows with the given values; None asks for nothing. The filter reaches the scan."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def touching(rows: DataFrame, entity: object, ends: tuple[str, str] = ("subject", "object")) -> DataFrame:
    """F-02, F-07: the rows with an entity at either end."""
    return rows.filter((F.col(ends[0]) == entity) | (F.col(ends[1]) == entity))


def adjacent(edges: DataFrame, node: object) -> DataFrame:
    """F-03: (direction, node): what a node depends on or cites, and what depends on or cites it."""
    down = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("node"))
    return down.union(edges.filter(F.col("dst") == node).select(F.lit("in"), "src")).distinct().orderBy("direction", "node")


def listing(rows: DataFrame, shown: list[str], order: list[str], page: int = 0, size: int = 50, **equal: object) -> DataFrame:
    """F-12, F-13: a page of the filtered rows in a total order."""
    return where(rows, **equal).orderBy(*order).select(*shown).offset(page * size).limit(size)
