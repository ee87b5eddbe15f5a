"""Ordered aggregation that survives a key holding a large share of all rows.

A plain window puts a whole key into one task. Here the caller names a *chunk*: an expression that never decreases along
the order. Windows run per (key, chunk); one summary row per chunk is carried across chunks and joined back.

Chunks cost shuffles of their own. Where a caller names columns ``few`` of the key whose values rarely have many rows, rows
are first counted by a hash of these columns (one small aggregate), and only keys whose hash has more than ``MANY`` rows are
chunked; all others are ordered by one shuffle. The split steers the cost and never the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


# Rows of one hash above which its keys are chunked, and the number of hashes (what the driver gets back at most).
MANY, HASHES = 1 << 18, 1 << 14


def by_size(df: DataFrame, few: list[str] | None, plain: Callable[[DataFrame], DataFrame], chunked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` for the rows whose key cannot have more than ``MANY`` rows, ``chunked`` for the others (or all, without ``few``)."""
    if not few:
        return chunked(df)
    bucket = F.pmod(F.xxhash64(*few), F.lit(HASHES))
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").count()
    large = [row["_bucket"] for row in counts.where(F.col("count") > MANY).collect()]
    if not large:
        return plain(df)
    return plain(df.where(~bucket.isin(large))).unionByName(chunked(df.where(bucket.isin(large))))


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column | str], value: Column, chunk: Column, name: str, few: list[str] | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the key (0 for its first row)."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))

    return by_size(df, few, plain, lambda rows: _running_sum(rows, keys, order, value, chunk, name))


def _running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, chunk: Column, name: str) -> DataFrame:
    staged = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = staged.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.sum("_total").over(earlier).alias("_carry"),
    ).where("_carry IS NOT NULL")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_chunk") == F.col("_k_chunk")]
    joined = local.join(carried, match, "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce("_carry", F.lit(0))).cast("long").alias(name))


def with_island(df: DataFrame, keys: list[str], start: str, end: str, touch: bool = True, name: str = "_head") -> DataFrame:
    """Add ``name``: the start of the island of overlapping (and touching) intervals that a row lies in, a key in one task."""
    before = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    apart = F.col(start) > F.col("_reach") if touch else F.col(start) >= F.col("_reach")
    flagged = df.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | apart, F.col(start)))
    # Rows of one start have one island: where a later one of them opens it, so do the others.
    upto = Window.partitionBy(*keys).orderBy(start).rangeBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn(name, F.max("_new").over(upto)).drop("_reach", "_new")


def union_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, chunk_bits: int = 16, touch: bool = True, few: list[str] | None = None
) -> DataFrame:
    """Disjoint sorted cover of the intervals of each key (touching intervals join): ``keys, start, end``.

    Intervals are first merged inside chunks of their start coordinate. Across chunks only the running maximum of the
    ends is needed: a local island continues an earlier one iff that maximum reaches its start.
    """
    spans = df.select(*keys, F.col(start).alias("s"), F.col(end).alias("e"))

    def plain(rows: DataFrame) -> DataFrame:
        islands = with_island(rows, keys, "s", "e", touch)
        return islands.groupBy(*keys, "_head").agg(F.max("e").alias("end")).withColumnRenamed("_head", "start")

    return by_size(spans, few, plain, lambda rows: _union_intervals(rows, keys, chunk_bits, touch))


def _union_intervals(spans: DataFrame, keys: list[str], chunk_bits: int, touch: bool) -> DataFrame:
    apart = (lambda lo, hi: lo > hi) if touch else (lambda lo, hi: lo >= hi)
    islands = with_island(spans.withColumn("c", F.shiftright("s", chunk_bits)), [*keys, "c"], "s", "e", touch)
    islands = islands.groupBy(*keys, "c", "_head").agg(F.max("e").alias("e")).withColumnRenamed("_head", "s")
    # Reach of all earlier chunks, carried over one row per (key, chunk).
    reach = islands.groupBy(*keys, "c").agg(F.max("e").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("c").alias("_k_c"), F.max("_top").over(earlier).alias("_far")
    ).where(F.col("_far") >= F.shiftleft(F.col("_k_c"), chunk_bits))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("c") == F.col("_k_c")]
    linked = islands.join(reach, match, "left")
    linked = linked.withColumn(
        "_open", F.when(F.col("_far").isNull() | apart(F.col("s"), F.col("_far")), F.col("s"))
    )
    # A continuing island belongs to the latest island opened in an earlier chunk.
    opened = linked.groupBy(*keys, "c").agg(F.max("_open").alias("_last"))
    carried = opened.select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        F.col("c").alias("_h_c"),
        F.max("_last").over(earlier).alias("_anchor"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col("c") == F.col("_h_c")]
    named = linked.join(carried, match, "left").withColumn("_id", F.coalesce("_open", "_anchor"))
    return named.groupBy(*keys, "_id").agg(F.max("e").alias("end")).withColumnRenamed("_id", "start")


def consecutive_groups(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column, name: str = "island", few: list[str] | None = None
) -> DataFrame:
    """Add ``name``: 0, 1, ... per key, a new number whenever ``values`` differ from the previous row in ``order``."""
    along = Window.partitionBy(*keys).orderBy(*order)

    def plain(rows: DataFrame) -> DataFrame:
        staged = rows.withColumn("_v", F.struct(*values)).withColumn("_prev", F.lag("_v").over(along))
        staged = staged.withColumn("_new", F.when(F.col("_prev").isNull(), 0).when(F.col("_prev") != F.col("_v"), 1).otherwise(0))
        return staged.select(*df.columns, F.sum(F.col("_new").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(name))

    return by_size(df, few, plain, lambda rows: _consecutive_groups(rows, keys, order, values, chunk, name))


def _consecutive_groups(df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column, name: str) -> DataFrame:
    staged = df.withColumn("_chunk", chunk).withColumn("_v", F.struct(*values))
    ends = staged.groupBy(*keys, "_chunk").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = staged.withColumn("_row", F.row_number().over(inside)).withColumn("_prev", F.lag("_v").over(inside))
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_chunk") == F.col("_k_chunk")]
    joined = local.join(carried, match, "left")
    prev = F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.col("_prev"))
    flagged = joined.withColumn("_new", F.when(prev.isNull(), 0).when(prev != F.col("_v"), 1).otherwise(0))
    flagged = flagged.select(*df.columns, "_new")
    counted = _running_sum(flagged, keys, order, F.col("_new").cast("long"), chunk, "_earlier")
    return counted.select(*df.columns, (F.col("_earlier") + F.col("_new")).alias(name))


def _carried_by_chunk(df: DataFrame, keys: list[str], summary: Column, over: Callable[[Column, WindowSpec], Column], name: str) -> DataFrame:
    """One row per (key, ``_chunk``): ``summary`` of each chunk, taken over the earlier chunks of the key."""
    of_chunk = df.groupBy(*keys, "_chunk").agg(summary.alias("_summary"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk")
    return of_chunk.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), over(F.col("_summary"), earlier).alias(name)
    ).where(F.col(name).isNotNull())


def _with_chunk(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_chunk") == F.col("_k_chunk")]
    return df.join(carried, match, "left")


def running_max(df: DataFrame, keys: list[str], pos: str, value: str, name: str, bits: int = 16) -> DataFrame:
    """Add ``name``: the largest ``value`` among the rows of the key at smaller ``pos`` (null for none).

    Chunks are stretches of 2^bits positions, so a row's chunk says which rows lie before all of it.
    """
    staged = df.withColumn("_chunk", F.shiftright(pos, bits))
    before = lambda c, w: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = _carried_by_chunk(staged, keys, F.max(value), before, "_carry")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
    joined = _with_chunk(staged.withColumn("_local", F.max(value).over(inside)), carried, keys)
    return joined.select(*df.columns, F.greatest("_local", "_carry").alias(name))


def previous_row(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, name: str, few: list[str] | None = None) -> DataFrame:
    """Add ``name``: ``value`` of the row before, in ``order``, of the key (null for its first row)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return by_size(df, few, lambda rows: rows.withColumn(name, before), lambda rows: _previous_row(rows, keys, order, value, chunk, name))


def _previous_row(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, name: str) -> DataFrame:
    staged = df.withColumn("_chunk", chunk).withColumn("_value", value)
    carried = _carried_by_chunk(staged, keys, F.max_by("_value", F.struct(*order)), lambda c, w: F.lag(c).over(w), "_carry")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = staged.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_local", F.lag("_value").over(inside))
    joined = _with_chunk(local, carried, keys)
    return joined.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local")).alias(name))


def next_row(df: DataFrame, keys: list[str], pos: str, name: str, bits: int = 16, few: list[str] | None = None) -> DataFrame:
    """Add ``name``: the next larger ``pos`` of the key (null for the last); positions of a key are distinct."""
    after = F.lead(pos).over(Window.partitionBy(*keys).orderBy(pos))
    return by_size(df, few, lambda rows: rows.withColumn(name, after), lambda rows: _next_row(rows, keys, pos, name, bits))


def _next_row(df: DataFrame, keys: list[str], pos: str, name: str, bits: int) -> DataFrame:
    staged = df.withColumn("_chunk", F.shiftright(pos, bits))
    carried = _carried_by_chunk(staged, keys, F.min(pos), lambda c, w: F.lead(c).over(w), "_carry")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    joined = _with_chunk(staged.withColumn("_local", F.lead(pos).over(inside)), carried, keys)
    return joined.select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def carry_last(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], chunk: Column) -> DataFrame:
    """Add the columns of ``values``: for each, its last value that is not null, at the row or before it in ``order``.

    Chunks are splits of files: one row for each is sent to the rows, which a join by chunk would shuffle a second time.
    """
    marks = {f"_mark_{name}": column for name, column in values.items()}
    staged = df.withColumn("_chunk", chunk).withColumns(marks)
    place = F.struct(*order)
    summary = F.struct(*[F.max_by(m, F.when(F.col(m).isNotNull(), place)).alias(m) for m in marks])
    earlier = lambda c, w: F.struct(*[F.last(c[m], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(m) for m in marks])
    carried = _carried_by_chunk(staged, keys, summary, earlier, "_carry")
    upto = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({m: F.last(m, ignorenulls=True).over(upto) for m in marks})
    joined = _with_chunk(local, F.broadcast(carried), keys)
    return joined.select(*df.columns, *[F.coalesce(f"_mark_{name}", F.col("_carry")[f"_mark_{name}"]).alias(name) for name in values])


def carry_latest(df: DataFrame, keys: list[str], row: str, values: dict[str, Column], chunk: Column) -> DataFrame:
    """Add the columns of ``values``, whole numbers that never fall along ``row`` in a chunk: for each, its last one at the row
    or before it, as ``chunk, value`` (null for none).

    What ``carry_last`` does for any value costs a sort by chunk; the largest number is found by hashing.
    """
    marks = {f"_mark_{name}": column.cast("long") for name, column in values.items()}
    staged = df.withColumn("_chunk", chunk).withColumns(marks)
    at = lambda value: F.when(value.isNotNull(), F.struct(F.col("_chunk").alias("chunk"), value.alias("value")))
    summary = F.struct(*[F.max(m).alias(m) for m in marks])
    earlier = lambda c, w: F.struct(*[F.last(at(c[m]), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(m) for m in marks])
    carried = _carried_by_chunk(staged, keys, summary, earlier, "_carry")
    upto = Window.partitionBy(*keys, "_chunk").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({m: F.max(m).over(upto) for m in marks})
    joined = _with_chunk(local, F.broadcast(carried), keys)
    return joined.select(*df.columns, *[F.coalesce(at(F.col(f"_mark_{name}")), F.col("_carry")[f"_mark_{name}"]).alias(name) for name in values])
