"""One mapping out of several stores: blocks with equal images count once, however each store cuts them.

A block is a shift (or a turn) of a stretch, so all blocks of one source, target and strand that send a unit to the same
place lie on one line: ``tgt - src``, or ``src + tgt + len`` for turned ones. Refinement is then interval work per line. A
line shares a task with its blocks; lines of sources with very many blocks run in stretches of positions with carried state,
so a line that holds most blocks is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mapping import concat, invert
from .ordered import by_size, previous_row, running_sum, union_intervals, with_island
from .overlap import LADDER, overlap_join

LINE = ["src_ref", "tgt_ref", "rev", "_line"]
COLUMNS = ["edge_key", "ix", "src_ref", "src", "tgt_ref", "tgt", "len", "rev"]
CHUNK_BITS = 16


def on_lines(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``_line``, which blocks share that send a unit to the same place, and ``_stop``."""
    line = F.when(F.col("rev"), F.col("src") + F.col("tgt") + F.col("len")).otherwise(F.col("tgt") - F.col("src"))
    return blocks.withColumn("_line", line).withColumn("_stop", F.col("src") + F.col("len"))


def _target(start: Column, stop: Column) -> Column:
    return F.when(F.col("rev"), F.col("_line") - stop).otherwise(F.col("_line") + start)


def common_blocks(*mappings: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """``edge_key, ix, src_ref, src, tgt_ref, tgt, len, rev, n_blocks``: the longest blocks that ``mappings`` make up together.

    Blocks that overlap or touch on a line become one; it carries the edge and order of its first block, earlier mappings
    first, and the number of blocks in it. No two blocks of the result give a unit the same image.
    """
    blocks = on_lines(concat(*[m.select(*COLUMNS) for m in mappings]))
    named = by_size(blocks, ["src_ref"], _named_in_one_task, lambda rows: _named_in_stretches(rows, ladder))
    return named.select(
        F.col("_first.edge_key").alias("edge_key"), F.col("_first.ix").alias("ix"), "src_ref", F.col("start").alias("src"), "tgt_ref",
        _target(F.col("start"), F.col("end")).alias("tgt"), (F.col("end") - F.col("start")).alias("len"), "rev", "n_blocks",
    )


def _first_and_number() -> list[Column]:
    return [F.min(F.struct("ix", "edge_key")).alias("_first"), F.count("*").alias("n_blocks")]


def _named_in_one_task(blocks: DataFrame) -> DataFrame:
    """Unions of blocks with their first block and number, by one shuffle."""
    islands = with_island(blocks, LINE, "src", "_stop", name="start")
    return islands.groupBy(*LINE, "start").agg(F.max("_stop").alias("end"), *_first_and_number())


def _named_in_stretches(blocks: DataFrame, ladder: tuple[int, ...]) -> DataFrame:
    whole = union_intervals(blocks, LINE, "src", "_stop", CHUNK_BITS)
    # Every block lies in one of the unions, so this join returns each block once.
    keys = [F.col(c).alias(f"_{c}") for c in LINE]
    inside = overlap_join(
        blocks.select(*keys, "edge_key", "ix", "src", "_stop"), whole.select(*keys, "start", "end"), [f"_{c}" for c in LINE], ("src", "_stop"), ("start", "end"), ladder
    )
    named = inside.select(*[F.col(f"_{c}").alias(c) for c in LINE], "edge_key", "ix", "start", "end")
    return named.groupBy(*LINE, "start", "end").agg(*_first_and_number())


def shared_pieces(*mappings: DataFrame) -> DataFrame:
    """``src_ref, src, tgt_ref, tgt, len, rev, n_mappings``: the longest pieces that the same number of mappings hold."""
    marked = None
    for number, mapping in enumerate(mappings):
        rows = on_lines(mapping).select(*LINE, "src", "_stop", F.lit(number).alias("_m"))
        marked = rows if marked is None else marked.unionByName(rows)
    pieces = by_size(marked, ["src_ref"], _pieces_in_one_task, _pieces_in_stretches)
    return pieces.select(
        "src_ref", F.col("_from").alias("src"), "tgt_ref", _target(F.col("_from"), F.col("at")).alias("tgt"), (F.col("at") - F.col("_from")).alias("len"), "rev", "n_mappings"
    )


def _steps(spans: DataFrame) -> DataFrame:
    """Where on a line the number of mappings changes, and by how much."""
    ends = spans.select(*LINE, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    # Where as many mappings end as begin nothing changes.
    return ends.select(*LINE, "_e.at", "_e.d").groupBy(*LINE, "at").agg(F.sum("d").alias("d")).where("d <> 0")


def _pieces_in_one_task(marked: DataFrame) -> DataFrame:
    """Pieces between steps: one shuffle by line serves the unions, the steps and both windows."""
    of_mapping = [*LINE, "_m"]
    islands = with_island(marked.repartition(*LINE), of_mapping, "src", "_stop", name="start")
    steps = _steps(islands.groupBy(*of_mapping, "start").agg(F.max("_stop").alias("end")))
    along = Window.partitionBy(*LINE).orderBy("at")
    depth = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return steps.select(*LINE, "at", F.lag("at").over(along).alias("_from"), depth.alias("n_mappings")).where("n_mappings > 0")


def _pieces_in_stretches(marked: DataFrame) -> DataFrame:
    steps = _steps(union_intervals(marked, [*LINE, "_m"], "src", "_stop", CHUNK_BITS))
    chunk = F.shiftright("at", CHUNK_BITS)
    depth = running_sum(steps, LINE, ["at"], F.col("d"), chunk, "n_mappings")
    return previous_row(depth, LINE, [F.col("at")], F.col("at"), chunk, "_from").where("n_mappings > 0").select(*LINE, "at", "_from", "n_mappings")


def blocks_of_edges(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """The mapping of some edges: ``blocks`` whose ``edge_key`` is in ``edges``, each once."""
    return blocks.join(edges.select("edge_key").distinct(), "edge_key", "left_semi").select(blocks.columns)


def mapping_for(
    segments: DataFrame, mappings: Sequence[DataFrame], keys: list[str], direction: str = "both", edges: DataFrame | None = None,
    ladder: tuple[int, ...] = LADDER,
) -> DataFrame:
    """For every location (``keys``) the blocks that its segments meet in any of ``mappings``, equal images once.

    ``segments`` as from ``explode_locations``; a between-position meets the blocks of both units beside it. ``direction``:
    ``forward``, ``inverse`` or ``both``. ``edges`` keeps the blocks of those edges.
    """
    if direction not in ("forward", "inverse", "both"):
        raise ValueError(f"unknown direction {direction}")
    chosen = [blocks_of_edges(m, edges) if edges is not None else m for m in mappings]
    ways = {"forward": chosen, "inverse": [invert(m) for m in chosen], "both": [x for m in chosen for x in (m, invert(m))]}[direction]
    blocks = common_blocks(*ways, ladder=ladder).withColumn("_stop", F.col("src") + F.col("len"))
    between = F.col("start") == F.col("end")
    asked = segments.select(
        *keys, F.col("ref").alias("_ref"), F.when(between, F.col("start") - 1).otherwise(F.col("start")).alias("_from"),
        F.when(between, F.col("end") + 1).otherwise(F.col("end")).alias("_to"),
    ).distinct()
    met = overlap_join(asked, blocks.withColumn("_ref", F.col("src_ref")), ["_ref"], ("_from", "_to"), ("src", "_stop"), ladder)
    return met.select(*keys, *COLUMNS, "n_blocks").distinct()
