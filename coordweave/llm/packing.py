"""Packing documents into training sequences by hierarchical residual packing.

Token pieces, sorted by length, are dealt to leaves in turn, so every leaf holds a fair mix whatever the order of the input. A
leaf packs its pieces by best fit, longest first. Of its sequences, those at most half full - one at most, or two would have
shared a sequence - and the roomiest others go up a tree as items: a node gets those of ``FANOUT`` children, packs them by best
fit, and passes on its own. The ``FANOUT`` roomiest are as good as all of them: sequences above half cannot share, and a node has
at most one smaller item of each child, so nobody asks for more. All else is done where it is. No task holds more than a leaf
or a node's few items.

Defined results: a null or empty text is its end mark alone (one token); repeated rows are packed once each; a document
longer than a sequence is cut, its first piece taking the remainder; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

END_ID = 0
LEAF = 1 << 15  # pieces that a task packs, about
FANOUT = 8
BIN_BITS = 20  # sequences of a leaf are fewer
TEXTS_AT_ONCE = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

# Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Scripts up to U+07FF and general punctuation: here two libraries agree on every character class.
RARE = re.compile("[^\\x00-\\u07ff\\u2010-\\u2027\\u2030-\\u205e]")
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Identifiers of a text under the vocabulary at ``path``; texts in common scripts take the faster library.

    A worker loads the other one when a text first asks for it.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in content["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    exact = []

    def encode(text: str) -> list[int]:
        if not RARE.search(text):
            return fast.encode(text, allowed_special="all")
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(path))
        return exact[0].encode(text, add_special_tokens=False).ids

    return _ENCODERS.setdefault(path, encode)


def cut_pieces(docs: DataFrame, path: str, size: int) -> DataFrame:
    """Token pieces of every text (``doc_id, text``): where they start, how long they are, and a checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for first in range(0, len(batch), TEXTS_AT_ONCE):
                rows = batch.slice(first, TEXTS_AT_ONCE)
                out = []
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = encode(text)
                    ids.append(END_ID)
                    data = np.array(ids, dtype="<u4")
                    start, length, piece = 0, (len(ids) - 1) % size + 1, 0
                    while start < len(ids):
                        out.append((doc_id, piece, start, length, zlib.crc32(data[start : start + length])))
                        start, length, piece = start + length, size, piece + 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sequence and place in it for every item, longest first; and how far each sequence is filled."""
    at = np.zeros(len(lengths), dtype=np.int64)
    place = np.zeros(len(lengths), dtype=np.int64)
    filled: list[int] = []
    open_with: list[list[int]] = [[] for _ in range(size + 1)]  # numbers of the sequences with so much room
    rooms = 0  # bit r: there is one with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = open_with[room].pop()
            if not open_with[room]:
                rooms ^= 1 << room
        else:
            room, number = size, len(filled)
            filled.append(0)
        at[i], place[i] = number, size - room
        filled[number] += length
        if room > length:
            open_with[room - length].append(number)
            rooms |= 1 << (room - length)
    return at, place, np.array(filled, dtype=np.int64)


def passed_up(filled: np.ndarray, size: int) -> np.ndarray:
    """Places of the sequences that go up: those at most half full, and the roomiest others that are not full."""
    small = np.flatnonzero(filled <= size // 2)
    others = np.flatnonzero((filled > size // 2) & (filled < size))
    return np.concatenate([small, others[np.argsort(filled[others], kind="stable")[:FANOUT]]])


def pack_leaves(pieces: DataFrame, leaves: int, size: int) -> DataFrame:
    """``PACKED`` and ``leaf, filled``: all pieces in their sequences; rows with ``filled`` are sequences that go up."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        at, place, filled = best_fit(table.column("length").to_numpy(), size)
        up = passed_up(filled, size)
        first = leaf << BIN_BITS
        schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in [*names, "sequence_id", "offset", "leaf", "filled"]])
        items = [*(table.column(n) for n in names), pa.array(first + at), pa.array(place), pa.array(np.full(len(at), leaf)), pa.nulls(len(at), pa.int64())]
        none = [pa.nulls(len(up), schema.field(n).type) for n in [*names, "offset"]]
        sent = [*none[:-1], pa.array(first + up), none[-1], pa.array(np.full(len(up), leaf)), pa.array(filled[up])]
        return pa.concat_tables([pa.table(items, schema=schema), pa.table(sent, schema=schema)])

    numbered = keep(pieces.withColumn("_number", F.monotonically_increasing_id()))  # written once: numbers must not change
    sorted_ = numbered.repartitionByRange("length", "_number").sortWithinPartitions("length", "_number").withColumn("_place", F.monotonically_increasing_id())
    turn = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright("_place", 33)
    dealt = sorted_.withColumn("leaf", F.pmod(turn, F.lit(leaves))).drop("_number", "_place")
    return dealt.groupBy("leaf").applyInArrow(pack, PACKED + ", leaf long, filled long")


def merge_up(items: DataFrame, leaves: int, size: int) -> DataFrame | None:
    """``seq, target, shift``: sequences that end up in others, and how far their pieces move; ``items``: ``node, seq, filled``."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seq, lengths = rows["seq"].to_numpy(np.int64), rows["filled"].to_numpy(np.int64)
        order = np.lexsort((seq, -lengths))
        seq, lengths = seq[order], lengths[order]
        at, place, filled = best_fit(lengths, size)
        base = np.zeros(len(filled), np.int64)
        base[at[place == 0]] = seq[place == 0]
        moved = place > 0
        up = passed_up(filled, size)
        return pd.DataFrame({
            "node": np.full(moved.sum() + len(up), key[0]), "seq": np.concatenate([seq[moved], base[up]]),
            "filled": pd.array([None] * int(moved.sum()) + filled[up].tolist(), "Int64"),
            "target": np.concatenate([base[at[moved]], base[up]]), "shift": np.concatenate([place[moved], np.zeros(len(up), np.int64)]),
        })

    moves = None
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        up = items.withColumn("node", F.floor(F.col("node") / FANOUT))
        met = keep(up.groupBy("node").applyInPandas(merge, "node long, seq long, filled long, target long, shift long"))
        items = met.where("filled IS NOT NULL").select("node", "seq", "filled")
        new = met.where("filled IS NULL").select("seq", "target", "shift")
        if moves is not None:
            then = new.select(F.col("seq").alias("_seq"), F.col("target").alias("_target"), F.col("shift").alias("_shift"))
            further = moves.join(then, F.col("target") == F.col("_seq"), "left")
            moves = further.select("seq", F.coalesce("_target", "target").alias("target"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")).unionByName(new)
            moves = keep(moves)
        else:
            moves = new
    return moves


def pack_pieces(pieces: DataFrame, size: int = 2048, leaf: int = LEAF) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``PIECES``), none longer than ``size``."""
    pieces = keep(pieces)  # texts are not read again
    leaves = max(1, -(-pieces.count() // leaf))
    packed = keep(pack_leaves(pieces, leaves, size))
    moves = merge_up(packed.where("filled IS NOT NULL").select(F.col("leaf").alias("node"), F.col("sequence_id").alias("seq"), "filled"), leaves, size)
    out = packed.where("filled IS NULL").drop("leaf", "filled")
    if moves is None:
        return out
    met = out.join(moves, F.col("sequence_id") == F.col("seq"), "left")
    return met.select(
        *[f.split()[0] for f in PIECES.split(", ")], F.coalesce("target", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece of every document in its sequence.

    ``path`` is a vocabulary of the tokenizers library that every executor can open.
    """
    return pack_pieces(cut_pieces(docs, path, size), size)
