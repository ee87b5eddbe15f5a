"""Removing long repeats by a run-length index.

A corpus has no single index that fits a machine, so the work is dealt out by content. Every window of ``length`` bytes
has an anchor: the smallest hash among its substrings of ``ANCHOR`` bytes. Neighbouring windows with one anchor make a
context. Equal windows have equal anchors, so whatever repeats meets under one anchor:

- a context that occurs twice as a whole is repeated as a whole, and its text never moves;
- a context whose anchor nobody else has is not repeated, and its text never moves;
- the distinct contexts that share an anchor go to a bucket by the anchor, where a run-length index finds their repeats.

A bucket's index is the Burrows-Wheeler transform of its contexts cut into runs, with the suffix array sampled at the run
ends. Matching statistics stream along the text: inside a run the match with the neighbouring suffix is one shorter than
that of the byte before, so only run heads compare text. A window is repeated if a neighbouring suffix matches it for
``length`` bytes or more. Repetitive text has few runs and few comparisons.

Anchors shared by more than ``HOT`` distinct contexts are not brought to one task: their windows are hashed and counted one
by one, which shuffles on the windows themselves.

Equality of whole contexts, and of windows under hot anchors, is that of 128 bits of hashes; inside buckets it is exact.

Defined results: a null or empty text has no bytes, and texts shorter than ``length`` no repeats; copies are repeats of
each other, so all of them lose their bytes; repeated rows are copies; null or repeated ids are allowed; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, numbered

LENGTH = 200
ANCHOR = 64
HOT = 20_000
BUCKET_BYTES = 1_000_000
ROWS_PER_TASK = 1_000_000
CHUNK_BITS = 20
END_MARK, NUMBER_BYTES = b"\xf7", 8
MASK = np.uint64((1 << CHUNK_BITS) - 1)
FACTOR = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)
FULL, ASKS, SHOWS = 0, 1, 2  # repeated as a whole; asks for its repeats; only shows its text to others
SINGLE, WITNESS = 3, 4  # met once in its batch; stands for all copies of a batch


class Hashes:
    """Polynomial hashes of substrings of one text, modulo 2^64 over random values of bytes."""

    table = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers = inverses = np.ones(1, dtype=np.uint64)

    @classmethod
    def reserve(cls, n: int) -> None:
        if len(cls.powers) < n:
            n = 1 << (n - 1).bit_length()
            steps = [np.full(n, f, dtype=np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64))]
            for step in steps:
                step[0] = 1
            cls.powers, cls.inverses = (np.multiply.accumulate(step) for step in steps)

    def __init__(self, data: np.ndarray):
        self.reserve(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= MIX
        return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(data: bytes, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, context hash, first and last window start of every context of a text, in pieces of bounded size."""
    whole = np.frombuffer(data, dtype=np.uint8)
    width = length - ANCHOR + 1
    out = []
    step = (1 << CHUNK_BITS) - 2 * length
    for origin in range(0, max(len(whole) - length + 1, 0), step):
        part = whole[origin : origin + step + length - 1]
        hashes = Hashes(part)
        places = np.arange(len(part) - ANCHOR + 1)
        anchors = hashes.of(places, places + ANCHOR)
        # The place in the low bits finds the leftmost of equal hashes.
        best = (sliding_min((anchors & ~MASK) | places.astype(np.uint64), width) & MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(best) - 1]])
        out.append((anchors[best[first]], hashes.of(first, last + length), first + origin, last + origin))
    return out


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, context, rid, first, last, state`` for every context of ``docs`` (``rid, text``).

    Copies inside a batch are met on the spot: each of them is repeated (``FULL``), and only one ``WITNESS`` of them goes on
    to meet the rest of the corpus. So a context that holds a third of all rows sends a row per batch.
    """
    names = ["anchor", "context", "rid", "first", "last", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts = batch.column("rid").to_pylist(), batch.column("text").cast(pa.large_binary())
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for rid, text in zip(rids, texts, strict=True):
                for anchor, context, first, last in contexts(text.as_py(), length):
                    for column, values in zip(columns, (anchor.view(np.int64), context.view(np.int64), np.full(len(first), rid), first, last), strict=True):
                        column.append(values)
            if not columns[0]:
                continue
            joined = [np.concatenate(c) for c in columns]
            order = np.lexsort((joined[1], joined[0]))
            new = np.concatenate([[True], (np.diff(joined[0][order]) != 0) | (np.diff(joined[1][order]) != 0)])
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            rows = np.concatenate([order, order[new & several]])
            state = np.concatenate([np.where(several, FULL, SINGLE), np.full((new & several).sum(), WITNESS)]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in joined), pa.array(state)], names=names)

    return docs.mapInArrow(run, "anchor long, context long, rid long, first long, last long, state byte")


def sort_out(rows: DataFrame, count: int) -> DataFrame:
    """``rid, first, last, kind, anchor, hot``: contexts that are repeated as a whole, and those that have to be compared."""
    names = ["rid", "first", "last", "kind", "anchor", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        anchor, context, rid, first, last, state = (table.column(c).to_numpy() for c in ("anchor", "context", "rid", "first", "last", "state"))
        order = np.lexsort((context, anchor))
        anchor, context, rid, first, last, state = (x[order] for x in (anchor, context, rid, first, last, state))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        group = np.cumsum(new) - 1
        times = np.bincount(group, weights=np.where(state == WITNESS, 2, 1))[group]  # a witness stands for two or more
        of_anchor = np.cumsum(new_anchor) - 1
        variety = np.bincount(of_anchor[new])[of_anchor]  # distinct contexts with this anchor
        full = times > 1
        shown = new & (variety > 1)  # one row per distinct context
        for rows_of, kind in ((full & (state == SINGLE), FULL), (shown & ~full, ASKS), (shown & full, SHOWS)):
            at = np.flatnonzero(rows_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[at]), pa.array(first[at]), pa.array(last[at]), pa.array(np.full(len(at), kind, dtype=np.int8)), pa.array(anchor[at]), pa.array(variety[at] > HOT)],
                names=names,
            )

    dealt = rows.repartition(max(1, -(-count // ROWS_PER_TASK)), "anchor")
    return dealt.mapInArrow(run, "rid long, first long, last long, kind byte, anchor long, hot boolean")


def requested_texts(docs: DataFrame, requests: DataFrame, length: int) -> DataFrame:
    """``rid, first, asks, anchor, hot, data``: the text of every context that has to be compared."""
    by_text = requests.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("first", "last", "kind", "anchor", "hot")).alias("_asked"))
    joined = docs.join(by_text, F.col("rid") == F.col("_rid")).select("rid", "text", "_asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("_asked")
            sizes = np.asarray(asked.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = asked.flatten()
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for k in range(0, len(rows), 20_000):
                part = slice(k, k + 20_000)
                data = [texts[r][f : e + length] for r, f, e in zip(rows[part].tolist(), first[part].tolist(), last[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").take(pa.array(rows[part])), pa.array(first[part]), pa.array(flat.field("kind").to_numpy()[part] == ASKS),
                        flat.field("anchor")[k : k + 20_000], flat.field("hot")[k : k + 20_000], pa.array(data, pa.binary()),
                    ],
                    names=["rid", "first", "asks", "anchor", "hot", "data"],
                )

    return joined.mapInArrow(run, "rid long, first long, asks boolean, anchor long, hot boolean, data binary")


class RunIndex:
    """Run-length index of a list of texts, none longer than ``longest``."""

    def __init__(self, texts: list[bytes], longest: int):
        # A mark and the number of the text end each one, so no two suffixes are equal and none matches far beyond its text.
        # Both are spelled with bytes that UTF-8 never uses, so they match no text.
        ends = [END_MARK + bytes(0xF8 | n >> 3 * k & 7 for k in range(NUMBER_BYTES)) for n in range(len(texts))]
        self.text = np.frombuffer(b"".join(x for pair in zip(texts, ends, strict=True) for x in pair), dtype=np.uint8)
        self.starts = np.cumsum([0, *(len(t) + len(ends[0]) for t in texts)])[:-1]
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[k : n + k]
        # Prefix doubling up to beyond the longest text; the ranks of every depth stay for comparisons.
        self.depths: list[tuple[int, np.ndarray]] = []
        depth = 8
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, dtype=np.uint32)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            self.depths.append((depth, rank))
            if depth > longest + 2 * len(ends[0]):  # a suffix that starts in the number of a text differs within the next text
                break
            later = np.zeros(n, dtype=np.uint64)
            later[: max(n - depth, 0)] = rank[depth:].astype(np.uint64) + np.uint64(1)
            key = rank.astype(np.uint64) << np.uint64(32) | later
            depth *= 2
        self.order = order
        self.bwt = self.text[order - 1].astype(np.int16)
        self.bwt[order == 0] = -1  # nothing stands before the first byte
        self.heads = np.concatenate([[0], np.flatnonzero(self.bwt[1:] != self.bwt[:-1]) + 1])  # first rows of the runs
        self.at_heads = order[self.heads]  # suffix array sampled at both ends of the runs
        self.at_ends = order[np.concatenate([self.heads[1:] - 1, [n - 1]])]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``, by halves of falling depth (and single bytes)."""
        length = np.zeros(len(a), dtype=np.int64)
        n = len(self.text)
        for depth, rank in reversed(self.depths):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < n
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            length += depth * (inside & (rank[x] == rank[y]))
        for _ in range(7):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < n
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            length += inside & (self.text[x] == self.text[y])
            # (a byte that differs stays where it is, so further rounds change nothing)
        return length

    def statistics(self) -> np.ndarray:
        """For every place of the text, the longest match of its suffix with any other."""
        n = len(self.text)
        head_match = np.zeros(len(self.heads), dtype=np.int64)
        head_match[1:] = self.common(self.at_ends[:-1], self.at_heads[1:])
        # Streaming along the text: a place that is no run head matches one byte less than the place before it.
        known = np.full(n, -1, dtype=np.int64)
        known[self.at_heads] = head_match + self.at_heads
        source = np.where(known >= 0, np.arange(n), 0)
        source = np.maximum.accumulate(source)
        before = np.maximum(known[source] - np.arange(n), 0)
        in_order = before[self.order]
        best = np.empty(n, dtype=np.int64)
        best[self.order] = np.maximum(in_order, np.concatenate([in_order[1:], [0]]))
        return best


def bucket_repeats(length: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rid, first, asks = table.column("rid").to_numpy(), table.column("first").to_numpy(), table.column("asks").to_numpy()
        texts = table.column("data").to_pylist()
        index = RunIndex(texts, max(map(len, texts)))
        repeated = index.statistics() >= length
        windows = np.array([len(t) for t in texts]) - length + 1
        rows = np.repeat(np.arange(len(texts)), np.where(asks, windows, 0))
        within = np.arange(len(rows)) - np.repeat(np.cumsum(np.where(asks, windows, 0)) - np.where(asks, windows, 0), np.where(asks, windows, 0))
        hit = repeated[index.starts[rows] + within]
        # Maximal runs of repeated windows of one context.
        rows, within = rows[hit], within[hit]
        begins = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (within[1:] != within[:-1] + 1)])) if len(rows) else np.empty(0, np.int64)
        ends = np.concatenate([begins[1:] - 1, [len(rows) - 1]]) if len(rows) else begins
        return pa.table({
            "rid": pa.array(rid[rows[begins]], pa.int64()), "first": pa.array(first[rows[begins]] + within[begins], pa.int64()),
            "last": pa.array(first[rows[begins]] + within[ends], pa.int64()),
        })

    return run


def counted_windows(texts: DataFrame, length: int) -> DataFrame:
    """``rid, first, last``: repeated windows under hot anchors, counted one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, first, asks, anchor, data in zip(*(batch.column(c).to_pylist() for c in ("rid", "first", "asks", "anchor", "data")), strict=True):
                places = np.arange(len(data) - length + 1)
                hashes = Hashes(np.frombuffer(data, dtype=np.uint8)).of(places, places + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), v)) for v in (anchor, rid, asks)] + [pa.array(hashes), pa.array(places + first)],
                    names=["anchor", "rid", "asks", "window", "at"],
                )

    windows = keep(texts.select("rid", "first", "asks", "anchor", "data").mapInArrow(run, "anchor long, rid long, asks boolean, window long, at long"))
    twice = windows.groupBy("anchor", "window").count().where("count > 1").select(F.col("anchor").alias("_anchor"), F.col("window").alias("_window"))
    hit = windows.where("asks").join(twice, (F.col("anchor") == F.col("_anchor")) & (F.col("window") == F.col("_window")))
    return hit.select("rid", F.col("at").alias("first"), F.col("at").alias("last"))


def mark_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rid, spans``: for every text of ``docs`` (``rid, text``) with repeats, its runs ``(first, last)`` of repeated windows."""
    rows = keep(context_rows(docs, length))
    open_rows = rows.where(F.col("state") != FULL)
    sorted_out = keep(sort_out(open_rows, open_rows.count()))
    asked = sorted_out.where(F.col("kind") != FULL)
    facts = asked.agg(F.sum(F.when(~F.col("hot"), F.col("last") - F.col("first") + length)).alias("bytes"), F.count(F.when(F.col("hot"), 1)).alias("hot")).first()
    spans = sorted_out.where(F.col("kind") == FULL).select("rid", "first", "last")
    spans = spans.unionByName(rows.where(F.col("state") == FULL).select("rid", "first", "last"))
    if facts["bytes"] or facts["hot"]:
        texts = requested_texts(docs, asked, length)
        texts = keep(texts) if facts["hot"] else texts
        buckets = max(1, -(-(facts["bytes"] or 0) // BUCKET_BYTES))
        compared = texts.where("NOT hot").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        found = compared.select("bucket", "rid", "first", "asks", "data").groupBy("bucket").applyInArrow(bucket_repeats(length), "rid long, first long, last long")
        spans = spans.unionByName(found)
        if facts["hot"]:
            spans = spans.unionByName(counted_windows(texts.where("hot"), length))
    return spans.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def removed_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by the windows."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    named = numbered(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    marks = mark_repeats(named.select(F.col("_llm_rid").alias("rid"), "text"), length)
    marks = marks.select(F.col("rid").alias("_llm_marked"), F.col("spans").alias("_llm_spans"))
    return named.join(marks, F.col("_llm_rid") == F.col("_llm_marked"), "left")


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests = [], [], [], []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans"), strict=True):
                kept, start, end = cut_spans(text.as_py(), spans, length)
                sizes.append(len(text.as_py()))
                removed.append(int((end - start).sum()))
                counts.append(len(start))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, counts)), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    marked = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), length).select("doc_id", "text", F.col("_llm_spans").alias("spans"))
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_spans(data: bytes, spans: pa.Scalar, length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What is left of a text, and the byte spans that went."""
    if not spans.is_valid:
        return data, np.empty(0, np.int64), np.empty(0, np.int64)
    values = spans.values
    start, end = removed_spans(values.field("first").to_numpy(), values.field("last").to_numpy(), length)
    edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(data)]
    return b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)), start, end


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes of every text removed; halves of characters at the cuts go too."""

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, s in zip(text, spans, strict=True):
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            pairs = None if s is None else [{"first": x["first"], "last": x["last"]} for x in s]
            out.append(cut_spans(t.encode(), pa.scalar(pairs, kind), length)[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    names = docs.columns
    marked = _with_spans(docs.select(*names), length)
    changed = F.when(F.col("_llm_spans").isNull(), F.col("text")).otherwise(cut("text", "_llm_spans"))
    return marked.withColumn("text", changed).select(*names)
