"""Hard negatives by bounds along spanning trees of anchors.

Anchors are sorted by the signs of fixed projections and cut into blocks; a block's anchors form a minimum spanning tree by
their distances. Rows are dealt into chunks, and every chunk sees the trees of all anchors (a stated query set) from the
root down: a child's score of a row lies within the parent's, or the parent's bounds, plus or minus the length of the edge
times the row's norm. Only rows whose bounds reach into what is asked for are scored again: the best of the anchor's label,
then, with those known, the windows below each of them. Chunks send on their best few per anchor and window, and these are
merged; no anchor's rows are gathered in one place.

Components are rounded down to integers, so scores are exact: in doubles where no sum can reach 2^53, else in 64-bit integers.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; a shorter
vector counts as filled up with zeros; repeated rows are rows of their own, so an id may come more than once; vectors whose
products could pass 63 bits are refused with an error; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

BLOCK = 128  # anchors of a tree
CHUNK_ROWS = 16384  # rows that a task compares at a time
LEAST_ROWS = 2048  # smaller chunks are not worth a task
SIGNS, SEED = 20, 12
FOUND = "a_row long, a_id long, window long, id long, score long"
TREE = "block long, pos int, parent int, edge double, until int, row long, id long, label long, q array<long>"


def usable_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``id, label, q``: rows that take part, with rounded components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"), fine.alias("fine"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND fine")
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def matrix(lists: pa.Array, width: int, kind: str) -> np.ndarray:
    """Lists of components as rows, filled up with zeros."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    flat = flat[offsets[0] : offsets[-1]].astype(kind)
    lengths = np.diff(offsets)
    if len(lists) and lengths.min() == lengths.max() == width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of visit from the first row, the parent's place in that order (-1: none), and the edges' lengths."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, by = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    at = 0
    for place in range(n):
        order[place], out[at] = at, False
        if place:
            parent[place], edge[place] = by[at], near[at]
        far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = out & (far < near)
        near[closer], by[closer] = far[closer], place
        if place + 1 < n:
            at = int(np.flatnonzero(out)[np.argmin(near[out])])
    return order, parent, edge


def anchor_trees(anchors: DataFrame, width: int, parts: int) -> DataFrame:
    """``TREE``: anchors (``row, id, label, q``) in blocks of near ones, each with its parent earlier in the block."""
    signs = np.where(np.random.default_rng(SEED).random((width, SIGNS)) < 0.5, -1.0, 1.0)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = matrix(batch.column("q"), width, "float64") @ signs > 0
            key = pa.array((bits * (1 << np.arange(SIGNS))).sum(axis=1), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "key"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 24, None

        def tree(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            rows = table.combine_chunks()
            order, parent, edge = spanning_tree(matrix(rows.column("q").chunk(0), width, "float64"))
            until = np.arange(len(order))
            np.maximum.at(until, parent[1:], np.arange(1, len(order)))
            rows = rows.take(pa.array(order))
            made += 1
            columns = [
                np.full(len(order), made - 1, np.int64), np.arange(len(order), dtype=np.int32), parent.astype(np.int32), edge, until.astype(np.int32),
            ]
            columns = [pa.array(c) for c in columns] + [rows.column(c).combine_chunks() for c in ("row", "id", "label", "q")]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in TREE.split(", ")])

        for batch in batches:
            more = pa.Table.from_batches([batch]).drop_columns(["key"])
            held = more if held is None else pa.concat_tables([held, more])
            while len(held) >= BLOCK:
                yield tree(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and len(held):
            yield tree(held)

    keyed = anchors.mapInArrow(near, "row long, id long, label long, q array<long>, key long")
    return keyed.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").mapInArrow(trees, TREE)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class _Chunk:
    """Rows of a chunk, and the bounds of their scores for the anchors that still have children to come."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, slack: float):
        self.x, self.rows, self.ids, self.labels, self.slack = x, rows, ids, labels, slack
        self.norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.open: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def bounds(self, anchor: np.ndarray, pos: int, parent: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        if parent < 0:
            self.open.clear()
            exact = (self.x @ anchor).astype(np.float64)
            return exact, exact.copy()
        low, high, until = self.open[parent]
        if until == pos:
            del self.open[parent]
        wide = self.norms * (edge * (1 + 1e-9)) + self.slack
        return low - wide, high + wide

    def exact(self, anchor: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Scores of the rows ``asked``; bounds close on them."""
        if len(asked) * 4 > len(self.x):
            scores = self.x @ anchor
            low[:] = scores
            high[:] = scores
            return scores[asked]
        scores = self.x[asked] @ anchor
        low[asked] = scores
        high[asked] = scores
        return scores

    def best_of_label(self, anchor, row, label, low, high, k) -> list[tuple[int, np.ndarray, np.ndarray]]:
        able = np.flatnonzero((self.labels == label) & (self.rows != row))
        if len(able) > k:
            sure = np.partition(low[able], len(able) - k)[len(able) - k]
            able = able[high[able] >= sure]
        scores = self.exact(anchor, able, low, high)
        top = _best(self.ids[able], scores, k)
        return [(0, self.ids[able[top]], scores[top])]

    def below(self, anchor, label, windows, share, low, high, k) -> list[tuple[int, np.ndarray, np.ndarray]]:
        able, asked, limits = self.labels != label, np.zeros(len(self.x), bool), []
        for window in windows:
            least, most = -(-share[0] * window // 100), share[1] * window // 100
            if least > most:
                continue
            inside = able & (high >= least) & (low <= most)
            certain = low[inside & (low >= least) & (high <= most)]
            if len(certain) > k:
                inside &= high >= np.partition(certain, len(certain) - k)[len(certain) - k]
            asked |= inside
            limits.append((window, least, most))
        if not limits:
            return []
        places = np.flatnonzero(asked)
        scores = self.exact(anchor, places, low, high)
        out = []
        for window, least, most in limits:
            own = np.flatnonzero((scores >= least) & (scores <= most))
            top = own[_best(self.ids[places[own]], scores[own], k)]
            out.append((window, self.ids[places[top]], scores[top]))
        return out


def meet(rows: DataFrame, trees: DataFrame, chunks: int, width: int, kind: str, slack: float, k: int, share: tuple[int, int] | None) -> DataFrame:
    """``FOUND``: the best ``k`` of every chunk for every anchor: of its label (``window`` 0), or below each of its ``windows``."""
    windows = "windows" if "windows" in trees.columns else "CAST(NULL AS ARRAY<BIGINT>)"
    names = ["chunk", "kind", "block", "pos", "parent", "edge", "until", "row", "id", "label", "q", "windows"]
    asked = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("kind", F.lit(1)).withColumn("windows", F.expr(windows))
    dealt = rows.withColumn("kind", F.lit(0)).withColumn("block", F.lit(-1).cast("long"))
    for name, type_ in (("pos", "int"), ("parent", "int"), ("edge", "double"), ("until", "int"), ("windows", "array<long>")):
        dealt = dealt.withColumn(name, F.lit(None).cast(type_))
    both = dealt.select(*names).unionByName(asked.select(*names)).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, chunk = -1, [], None
        for batch in batches:
            table = {c: batch.column(c) for c in names}
            at_chunk, kinds = table["chunk"].to_numpy(), table["kind"].to_numpy()
            out: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
            # Runs of one chunk and kind.
            edges = np.flatnonzero(np.diff(at_chunk * 2 + kinds)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
                if at_chunk[lo] != at:
                    at, parts, chunk = at_chunk[lo], [], None
                ids, row_ids, labels = (table[c].slice(lo, hi - lo).to_numpy() for c in ("id", "row", "label"))
                x = matrix(table["q"].slice(lo, hi - lo), width, kind)
                if kinds[lo] == 0:
                    parts.append((x, row_ids, ids, labels))
                    continue
                if not parts and chunk is None:
                    continue  # a chunk without rows
                if chunk is None:
                    chunk, parts = _Chunk(*(np.concatenate(p) for p in zip(*parts, strict=True)), slack), []
                poses, parents, untils = (table[c].slice(lo, hi - lo).to_numpy() for c in ("pos", "parent", "until"))
                lengths, wanted = table["edge"].slice(lo, hi - lo).to_numpy(), table["windows"].slice(lo, hi - lo)
                for i in range(hi - lo):
                    low, high = chunk.bounds(x[i], poses[i], parents[i], lengths[i])
                    if share is None:
                        found = chunk.best_of_label(x[i], row_ids[i], labels[i], low, high, k)
                    else:
                        found = chunk.below(x[i], labels[i], wanted[i].as_py() or [], share, low, high, k)
                    if untils[i] > poses[i]:
                        chunk.open[poses[i]] = (low, high, untils[i])
                    out += [(row_ids[i], ids[i], w, found_ids, scores) for w, found_ids, scores in found if len(found_ids)]
            if out:
                counts = [len(o[3]) for o in out]
                columns = [np.repeat(np.array([o[c] for o in out], np.int64), counts) for c in range(3)]
                columns += [np.concatenate([o[c] for o in out]).astype(np.int64) for c in (3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])

    return both.mapInArrow(run, FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | None = None, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, label, embedding``).

    ``is_anchor`` is a condition on ``id``; ``share``: hundredths of the positive's score that a negative's lies between.
    """
    spark = vectors.sparkSession
    made = keep(usable_rows(vectors).withColumn("row", F.monotonically_increasing_id()))
    facts = made.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width"),
        F.coalesce(F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))), F.lit(0.0)).alias("most"),
    ).first()
    width, top = facts["width"], facts["width"] * facts["most"] ** 2
    if top >= 2.0**63:
        raise ValueError("vectors have components so large that inner products pass 63 bits")
    kind, slack = "float64" if top < 2.0**53 else "int64", 1e-3 + top * 1e-12
    chunks = max(1, -(-facts["n"] // CHUNK_ROWS), min(-(-facts["n"] // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism))
    rows = made.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    anchors = made.where(F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    trees = keep(anchor_trees(anchors.select("row", "id", "label", "q"), width, max(1, -(-anchors.count() // (16 * BLOCK)))))
    near = meet(rows, trees, chunks, width, kind, slack, positives, None)
    pairs = keep(_first(near, ["a_row"], positives).select("a_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = pairs.groupBy(F.col("a_row").alias("_row")).agg(F.collect_set("positive_score").alias("windows"))  # at most ``positives``
    asked = trees.join(windows, F.col("row") == F.col("_row"), "left").drop("_row")
    found = _first(meet(rows, asked, chunks, width, kind, slack, negatives, share), ["a_row", "window"], negatives)
    of = pairs.select(F.col("a_row").alias("_row"), "positive_id", "positive_score")
    out = found.join(of, (F.col("a_row") == F.col("_row")) & (F.col("window") == F.col("positive_score")))
    return out.select(
        F.col("a_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mining_rows(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the labels of every seventh id moved on by one, as the query asks for."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")
