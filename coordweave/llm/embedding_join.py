"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors are turned onto their principal axes and sorted by the grid cells (as wide as the largest linking distance)
of the leading ones. Equal numbers of neighbours in that order make blocks. Pairs of blocks whose bounding boxes are
provably farther apart than the distance are left out; every other pair goes to one task, which halves the two sequences
again and again, skips distant halves, screens what is left on the leading axes and verifies the cosine in full.

A vector meets only the blocks near its own. Isotropic vectors have no distant blocks, and then the join does compare all
pairs; the compared numbers are those of the screen. Copies are compared once: equal vectors are one row with a weight.
Links are counted where they are found and only a spanning forest of a pair of blocks leaves its task, so a group of n
near copies gives n rows and not n * n.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id link
with nothing (0 links, a component and kept row of their own); shorter vectors count as padded with zeros; repeated rows
link with each other; different vectors under one id are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keep

AXES = 8  # leading axes that cells and boxes use
SCREEN = 16  # leading axes of the screen
LEAF = 1024
FIT_ROWS = 20_000  # vectors that the axes are fitted to, about; they change the cost and not the result
MIN_BLOCK, MAX_BLOCK, BLOCKS = 512, 8192, 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list array as rows of length one, in double precision."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.asarray(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, rows: int, width: int) -> np.ndarray:
    """Axes by falling variance, fitted to a bounded sample."""
    share = min(1.0, FIT_ROWS / max(rows, 1))
    sample = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").repartition(8)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = unit_rows(batch.column("v"), width)
            count, total, square = count + len(x), total + x.sum(axis=0), square + x.T @ x
        yield pa.RecordBatch.from_pylist([{"n": count, "s": total.tolist(), "q": square.ravel().tolist()}])

    parts = sample.mapInArrow(moments, "n long, s array<double>, q array<double>").collect()  # eight rows
    n = max(sum(p["n"] for p in parts), 1)
    mean = np.sum([p["s"] for p in parts], axis=0) / n
    square = np.sum([p["q"] for p in parts], axis=0).reshape(width, width) / n
    return np.linalg.eigh(square - np.outer(mean, mean))[1][:, ::-1]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return root


def join_intervals(x: np.ndarray, turned: np.ndarray, weight: np.ndarray, first: slice, second: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of links of every row, and the smallest row reachable, among links between two intervals."""
    limit = 2 - 2 * cosine + 1e-9
    found = np.zeros(len(x), dtype=np.int64)
    ends_a: list[np.ndarray] = []
    ends_b: list[np.ndarray] = []
    axes, screen = turned[:, :AXES], turned[:, :SCREEN]
    squares = (screen**2).sum(axis=1)

    def distant(a: slice, b: slice) -> bool:
        gap = np.maximum(axes[a].min(axis=0) - axes[b].max(axis=0), axes[b].min(axis=0) - axes[a].max(axis=0))
        return float((np.maximum(gap, 0) ** 2).sum()) > limit

    def compare(a: slice, b: slice) -> None:
        apart = squares[a, None] + squares[None, b] - 2 * (screen[a] @ screen[b].T)
        near = apart <= limit
        if a == b:
            near &= np.tri(len(near), k=-1, dtype=bool).T
        i, j = np.nonzero(near)
        if not len(i):
            return
        i, j = i + a.start, j + b.start
        good = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= cosine
        i, j = i[good], j[good]
        np.add.at(found, i, weight[j])
        np.add.at(found, j, weight[i])
        # Only a spanning forest of this leaf is remembered.
        names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        root = local_roots(len(names), at[: len(i)], at[len(i) :])
        ends_a.append(names)
        ends_b.append(names[root])

    def join(a: slice, b: slice) -> None:
        if a.stop <= a.start or b.stop <= b.start or distant(a, b):
            return
        if a.stop - a.start <= LEAF and b.stop - b.start <= LEAF:
            compare(a, b)
        elif a == b:
            middle = (a.start + a.stop) // 2
            left, right = slice(a.start, middle), slice(middle, a.stop)
            join(left, left)
            join(left, right)
            join(right, right)
        elif a.stop - a.start >= b.stop - b.start:
            middle = (a.start + a.stop) // 2
            join(slice(a.start, middle), b)
            join(slice(middle, a.stop), b)
        else:
            middle = (b.start + b.stop) // 2
            join(a, slice(b.start, middle))
            join(a, slice(middle, b.stop))

    join(first, second)
    if not ends_a:
        return found, np.arange(len(x))
    return found, local_roots(len(x), np.concatenate(ends_a), np.concatenate(ends_b))


def link_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``node, n_links`` and ``a, b`` links in one frame: rows of (``a``, ``b`` or null, ``n``). ``vectors``: ``id, w, v``."""
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    rows, width = facts["n"], facts["width"] or 1
    axes = principal_axes(vectors, rows, width)
    eps = float(np.sqrt(2 - 2 * cosine))
    k = min(AXES, width)
    cell_names = [f"c{n}" for n in range(k)]

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = unit_rows(batch.column("v"), width) @ axes[:, :k]
            cells = np.floor(turned / eps).astype(np.int32)
            columns = [batch.column(c) for c in ("id", "w", "v")]
            columns += [pa.array(cells[:, n].copy()) for n in range(k)]
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(turned.ravel()), k).cast(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "w", "v", *cell_names, "lead"])

    types = dict(vectors.dtypes)
    schema = f"id long, w long, v {types['v']}, " + ", ".join(f"{c} int" for c in cell_names) + ", lead array<double>"
    block = min(MAX_BLOCK, max(MIN_BLOCK, -(-rows // BLOCKS)))
    order = [*cell_names, "id"]
    ranged = vectors.mapInArrow(to_cells, schema).repartitionByRange(max(1, -(-rows // block)), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + len(batch), dtype=np.int64))
            at += len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(batch), part, dtype=np.int32)), places, *(batch.column(c) for c in ("id", "w", "v", "lead"))],
                names=["part", "place", "id", "w", "v", "lead"],
            )

    placed = keep(ranged.mapInArrow(number, f"part int, place long, id long, w long, v {types['v']}, lead array<double>"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = placed.groupBy("part").agg(F.count("*").alias("_n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    ranked = placed.join(starts, F.col("part") == F.col("_part")).withColumn("rank", F.col("_start") + F.col("place"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block)).select("block", "rank", "id", "w", "v", "lead")
    lead = lambda n: F.col("lead")[n]
    boxes = ranked.groupBy("block").agg(
        *[F.min(lead(n)).alias(f"lo{n}") for n in range(k)], *[F.max(lead(n)).alias(f"hi{n}") for n in range(k)]
    )
    # Boxes meet over the cells of the leading axis, each with its upper neighbour.
    cells = boxes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps) + 1)))
    cells = keep(cells)
    other = cells.select(*[F.col(c).alias(f"o_{c}") for c in cells.columns])
    gap = lambda n: F.greatest(F.col(f"lo{n}") - F.col(f"o_hi{n}"), F.col(f"o_lo{n}") - F.col(f"hi{n}"), F.lit(0.0))
    apart = sum((gap(n) * gap(n) for n in range(k)), F.lit(0.0))
    pairs = cells.join(other, (F.col("cell") == F.col("o_cell")) & (F.col("block") <= F.col("o_block"))).where(apart <= 2 - 2 * cosine + 1e-9)
    pairs = keep(pairs.select(F.col("block").alias("i"), F.col("o_block").alias("j")).distinct())
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("_block"))
    meeting = ranked.join(sides, F.col("block") == F.col("_block")).select("i", "j", "block", "rank", "id", "w", "v")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        x = unit_rows(table.column("v").combine_chunks(), width)
        ids, weight = table.column("id").to_numpy(), table.column("w").to_numpy()
        split = int((table.column("block").to_numpy() == key[0].as_py()).sum())
        whole = slice(0, len(x))
        own, others = slice(0, split), slice(split, len(x))
        found, root = join_intervals(x, x @ axes, weight, *((whole, whole) if key[0] == key[1] else (own, others)), cosine)
        counted, linked = np.flatnonzero(found), np.flatnonzero(root != np.arange(len(x)))
        return pa.table({
            "a": pa.array(np.concatenate([ids[counted], ids[linked]]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ids[root[linked]], pa.int64())]),
            "n": pa.array(np.concatenate([found[counted], np.zeros(len(linked), np.int64)]), pa.int64()),
        })

    return meeting.groupBy("i", "j").applyInArrow(join, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    good = usable(F.col("v")) & F.col("vec_id").isNotNull()
    distinct = keep(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).select("id", "w", "v"))
    found = keep(link_vectors(distinct, cosine))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("_n_id")).agg(F.sum("n").alias("_n"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    nodes = distinct.join(counts, F.col("id") == F.col("_n_id"), "left").join(labels, F.col("id") == F.col("node"), "left")
    nodes = nodes.select(F.col("v").alias("_v"), (F.coalesce("_n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id"))
    linked = rows.where(good).join(nodes, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
