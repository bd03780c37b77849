"""Sorting by a listed column, badges, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 50


def badge(flag: Column, danger: list[str], warning: list[str]) -> Column:
    return F.when(flag.isin(danger), "danger").when(flag.isin(warning), "warning").otherwise("success")


def with_badge(rows: DataFrame, badges: list[str], wanted: str = "all") -> DataFrame:
    """Rows one of whose badge columns is the wanted one."""
    if wanted == "all":
        return rows
    hit = F.lit(False)
    for b in badges:
        hit = hit | (F.col(b) == wanted)
    return rows.where(hit)


def ordered(rows: DataFrame, key: list[str], allowed: list[str], column: str | None = None, descending: bool = False) -> DataFrame:
    """By the column if it is allowed, else by the key; the key settles ties."""
    if column not in allowed:
        return rows.orderBy(*key)
    return rows.orderBy(F.desc(column) if descending else F.asc(column), *key)


def page(rows: DataFrame, number: int, size: int = PAGE) -> tuple[DataFrame, int, int]:
    """A page of ordered rows, all rows' number and the number of pages; beyond the last page it is that."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return rows.offset((number - 1) * size).limit(size), total, pages
