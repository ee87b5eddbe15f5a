"""Ordered output in pages: global ranks without a sort in one place, and pages that follow a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add ``name``: 0, 1, ... in ascending ``order`` (columns that tell all rows apart), nulls first.

    Rows are sorted inside ranges of the order; a rank is the place in the range after all rows of the ranges before. Only
    the sizes of the ranges, one row for each, come together.
    """
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    marked = cut_lineage(marked)  # places must not change
    part = F.shiftright("_at", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = marked.join(starts, part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def paged(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``rank`` and ``page`` (both from 0); written by ``page``, a reader opens only the pages it shows."""
    return ranked(df, order).withColumn("page", F.expr(f"rank div {size}"))


def following(df: DataFrame, order: list[str], after: dict | None, size: int) -> DataFrame:
    """The next ``size`` rows in ``order`` behind the row whose ``order`` columns are ``after`` (None: the first page)."""

    def behind(names: list[str]) -> Column:
        column, value = F.col(names[0]), after[names[0]]
        more = column.isNotNull() if value is None else column > F.lit(value)
        return more if len(names) == 1 else more | (column.eqNullSafe(F.lit(value)) & behind(names[1:]))

    rest = df if after is None else df.where(F.coalesce(behind(order), F.lit(False)))
    return rest.orderBy(*order).limit(size)


def nth(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """The rows at ``places`` (from 0) of the order, with their ``rank``: examples for a summary."""
    wanted = reduce(lambda a, b: a | b, [F.col("rank") == p for p in places], F.lit(False))
    return ranked(df, order).where(wanted)
