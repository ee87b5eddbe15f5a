"""Packing documents into windows by non-negative least squares over combinations of lengths.

A document gives windows of its own and a rest. Rests are counted by length class (lengths rounded down to ``UNIT`` tokens).
Shallow combinations of classes that fill a window exactly are enumerated, how often each is used is the non-negative least
squares solution against the counts, weighed by tokens, rounded down and then topped up greedily while any combination still
fits the counts. As lengths were rounded down, such a window overflows by a little: what stands out is cut off. What was cut
off, and rests in no combination, are laid end to end and cut at the window's length. The last stretch, shorter than a
window, becomes sequences whose lengths are powers of two, which need no padding.

Only the counts (one number for each class and task) reach the driver, whatever the input. Identifiers are written once and
read again when the cuts are known.

Defined results: a null or empty text is its end mark alone (one token); repeated rows are packed once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from .common import keep
from .encoding import encoder

END_ID = 2
UNIT = 64
DEPTH = 4  # parts of a combination, or any number of one class and at most one part more
TEXTS_AT_ONCE = 128
ROWS_OF_A_CHUNK = 50_000
RESTS = "task long, row long, doc_id long, doc_tokens long, windows long, windows_before long, rest long, class int, rank long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """Every shallow combination of class sizes below ``units`` that sums to ``units``: a row of repeats per combination."""
    found = set()
    for n in range(2, depth + 1):
        for some in combinations_with_replacement(range(1, units), n - 1):
            last = units - sum(some)
            if last >= some[-1]:
                found.add((*some, last))
    for size in range(1, units):
        for n in range(1, units // size + 1):
            found.add(tuple(sorted([size] * n + [units - n * size] * (units > n * size))))
    out = np.zeros((len(found), units), np.int64)
    for row, parts in enumerate(sorted(found)):
        np.add.at(out[row], list(parts), 1)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x >= 0`` that minimises ``|a x - b|``, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * sum(a.shape)):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-14
            x[~free] = 0
    return x


def plan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations to use and how often, never more parts of a class than ``counts[class]``; class 0 takes no part."""
    units = len(counts)
    rows = combinations(units)
    total = max(1, int(counts[1:].sum()))
    weight = np.arange(1, units) / units
    solved = nonnegative_least_squares(rows[:, 1:].T * weight[:, None], counts[1:] * weight / total)
    times = np.floor(solved * total + 1e-6).astype(np.int64)
    left = counts.astype(np.int64) - times @ rows
    for size in range(1, units):  # a least squares solution may overshoot
        for row in np.flatnonzero((rows[:, size] > 0) & (times > 0)):
            if left[size] >= 0:
                break
            less = min(int(times[row]), int(-(left[size] // rows[row, size])))
            times[row] -= less
            left += less * rows[row]
    while True:
        fits = np.where(rows[:, 1:] > 0, left[1:] // np.maximum(rows[:, 1:], 1), np.iinfo(np.int64).max).min(axis=1)
        best = int(np.argmax(fits))
        if fits[best] <= 0:
            break
        times[best] += fits[best]
        left -= fits[best] * rows[best]
    used = times > 0
    return rows[used], times[used]


def tokenized(docs: DataFrame, path: str, size: int) -> DataFrame:
    """``RESTS``: identifiers of every document (compressed), its windows and its rest, numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, end = TaskContext.get().partitionId(), np.array([END_ID], "<u4").tobytes()
        made, windows, seen = 0, 0, np.zeros(size // UNIT + 1, np.int64)
        encode, press = encoder(path).encode, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                out = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    own, rest = divmod(n, size)
                    kind = rest // UNIT if rest else size // UNIT  # the last class: no rest
                    numbers = np.frombuffer(ids, "<u4")
                    data = numbers.astype("<u2").tobytes() if numbers.max() < 65536 else ids
                    out.append((task, (task << 33) + made, doc_id, n, own, windows, rest, kind, int(seen[kind]), press(data)))
                    made, windows = made + 1, windows + own
                    seen[kind] += 1
                types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in RESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESTS)


def last_sequences(tokens: int, size: int) -> np.ndarray:
    """Where the sequences of the laid-out rest end: whole windows, then powers of two (only the ends after the windows)."""
    base = tokens // size * size
    powers = [1 << k for k in reversed(range(size.bit_length())) if (tokens - base) >> k & 1]
    return base + np.cumsum(np.array(powers, np.int64))


def pack_windows(docs: DataFrame, path: str, size: int = 4096) -> DataFrame:
    """``PIECES``: every piece of every document in its sequence of at most ``size`` tokens.

    ``path`` is a vocabulary of the tokenizers library with word ends; every executor can open it. ``size`` must be a
    power of two above ``UNIT``.
    """
    units = size // UNIT
    rests = keep(tokenized(docs, path, size))
    of_task = keep(rests.groupBy("task", "class").agg(F.count("*").alias("n"), F.sum("windows").alias("windows")))
    counts = np.zeros(units + 1, np.int64)
    windows = 0
    for row in of_task.groupBy("class").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")).collect():  # a row per class
        counts[row["class"]] = row["n"]
        windows += row["windows"]
    used, times = plan(counts[:units])
    first_sequence = windows + np.concatenate([[0], np.cumsum(times)]).astype(np.int64)
    # For every class: from which rank on, which combination, how many of the class in it, after how many larger parts.
    runs = []
    for kind in range(1, units):
        rank = 0
        for i in np.flatnonzero(used[:, kind]):
            each = int(used[i, kind])
            runs.append((kind, rank, each, int(first_sequence[i]), int(used[i, kind + 1 :].sum())))
            rank += each * int(times[i])
        runs.append((kind, rank, 0, 0, 0))
    table = np.array([(0, 0, 0, 0, 0), *runs], np.int64)
    key = (table[:, 0] << 48) + table[:, 1]
    earlier = lambda by: Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_task.select(F.col("task").alias("_task"), F.col("class").alias("_class"), F.coalesce(F.sum("n").over(earlier(["class"])), F.lit(0)).alias("_start"))
    met = rests.where(F.col("class") < units).drop("ids").join(starts, (F.col("task") == F.col("_task")) & (F.col("class") == F.col("_class")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kind, rank = batch["class"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            run = table[np.searchsorted(key, (kind << 48) + rank, side="right") - 1]
            each = np.maximum(run[:, 2], 1)
            nth, within = np.divmod(rank - run[:, 1], each)
            inside = run[:, 2] > 0
            yield pd.DataFrame({
                "row": batch["row"], "start": batch["start"], "length": batch["rest"],
                "sequence_id": pd.array(np.where(inside, run[:, 3] + nth, 0), "Int64").copy(), "slot": np.where(inside, run[:, 4] + within, -1),
            })

    placed = met.select("row", (F.col("windows") * size).alias("start"), "rest", "class", (F.col("rank") + F.col("_start")).alias("rank"))
    placed = keep(placed.mapInPandas(place, "row long, start long, length long, sequence_id long, slot long"))
    upto = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most ``units`` rows
    combined = placed.where("slot >= 0").withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)))
    combined = keep(combined.withColumn("kept", F.greatest(F.lit(0), F.least("length", F.lit(size) - F.col("offset")))))
    tails = combined.where("kept < length").select("row", (F.col("start") + F.col("kept")).alias("start"), (F.col("length") - F.col("kept")).alias("length"))
    laid = placed.where("slot < 0").select("row", "start", "length").unionByName(tails)
    chunks = max(16, int(counts.sum()) // ROWS_OF_A_CHUNK)
    laid = laid.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    laid = keep(running_sum(laid, [], ["row", "start"], F.col("length"), F.col("_part"), "at"))
    tokens = laid.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    first_laid, ends = int(first_sequence[-1]), last_sequences(tokens, size)
    cuts = combined.where("kept > 0").select("row", "start", F.col("kept").alias("length"), "sequence_id", "offset", F.lit(None).cast("long").alias("at"))
    cuts = cuts.unionByName(laid.select("row", "start", "length", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), "at"))
    cuts = cuts.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "at")).alias("cuts"))  # three at most
    earlier_windows = of_task.groupBy("task").agg(F.sum("windows").alias("w")).select(
        F.col("task").alias("_task"), F.coalesce(F.sum("w").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_windows")
    )
    whole = rests.select("task", "row", "doc_id", "doc_tokens", "windows", "windows_before", "ids").join(cuts, F.col("row") == F.col("_row"), "left")
    whole = whole.join(earlier_windows, F.col("task") == F.col("_task"))
    base = tokens // size * size

    def lay(start: int, length: int, at: int) -> Iterator[tuple[int, int, int, int]]:
        while length:
            if at < base:
                sequence, low, high = first_laid + at // size, at // size * size, (at // size + 1) * size
            else:
                nth = int(np.searchsorted(ends, at, side="right"))
                sequence, low, high = first_laid + base // size + nth, base if not nth else int(ends[nth - 1]), int(ends[nth])
            some = min(length, high - at)
            yield start, some, sequence, at - low
            start, length, at = start + some, length - some, at + some

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                out = []
                for row in batch.slice(lo, 1024).to_pylist():
                    n, data = row["doc_tokens"], expand(row["ids"])
                    ids = np.frombuffer(data, "<u2").astype("<u4").tobytes() if len(data) == 2 * n else data
                    cut = [(k * size, size, row["_windows"] + row["windows_before"] + k, 0) for k in range(row["windows"])]
                    for c in row["cuts"] or ():
                        cut += [(c["start"], c["length"], c["sequence_id"], c["offset"])] if c["at"] is None else lay(c["start"], c["length"], c["at"])
                    out += [(row["doc_id"], a, m, zlib.crc32(ids[4 * a : 4 * (a + m)]), n, s, o) for a, m, s, o in cut]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return whole.drop("_row", "_task").mapInArrow(pieces, PIECES)
