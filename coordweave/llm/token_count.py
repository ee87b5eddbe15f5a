"""Token counts by heap-and-linked-list byte-pair merging.

A chunk of text starts with one symbol per UTF-8 byte. A heap holds the rank of every adjacent pair that can merge and a
linked list holds the symbols that are left; the lowest-ranked pair (the leftmost on ties) is merged again and again. The
count is the initial symbols minus the merges: no identifier is ever produced.

Merges never cross the chunks of the vocabulary's pre-tokenizer, and chunks never cross the border between white space
and other characters. So a worker remembers the count of each white-space-delimited run it has met (a bounded memory that
only saves time); memory does not depend on the input.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows stay repeated; the marks of special tokens
inside a text count as one token each, as the tokenizers library does by default; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the pre-tokenizer, and its pattern for runs without white space.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+| "
REMEMBERED = 1_000_000
SYMBOL_BITS = 24
POSITION_BITS = 32
POSITION_MASK = (1 << POSITION_BITS) - 1


def read_merges(path: str) -> tuple[dict[int, int], list[str]]:
    """Rank of each mergeable pair ``left << SYMBOL_BITS | right`` of symbols, and the texts of the special tokens.

    A symbol is a byte, or 256 and the rank of the merge that makes it.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    # The byte alphabet of such vocabularies: printable bytes stand for themselves, the others follow from U+0100.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    letter_of = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    symbol_of = {letter_of[b]: b for b in range(256)}
    ranks = {}
    for rank, pair in enumerate(content["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[symbol_of[left] << SYMBOL_BITS | symbol_of[right]] = rank
        symbol_of.setdefault(left + right, rank + 256)
    return ranks, [t["content"] for t in content["added_tokens"] if t["special"]]


def merged_length(data: bytes, ranks: dict[int, int]) -> int:
    """Symbols left of ``data`` when no adjacent pair can merge."""
    count = end = len(data)
    heap = []
    for at in range(end - 1):
        rank = ranks.get(data[at] << SYMBOL_BITS | data[at + 1])
        if rank is not None:
            heap.append(rank << POSITION_BITS | at)
    if not heap:
        return count
    heapq.heapify(heap)
    symbols = list(data)
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    while heap:
        top = heapq.heappop(heap)
        rank, at = top >> POSITION_BITS, top & POSITION_MASK
        right = after[at]
        if symbols[at] < 0 or right >= end or ranks.get(symbols[at] << SYMBOL_BITS | symbols[right]) != rank:
            continue  # one of the two has merged meanwhile
        made = rank + 256
        symbols[at], symbols[right] = made, -1
        after[at] = following = after[right]
        count -= 1
        if following < end:
            before[following] = at
            new = ranks.get(made << SYMBOL_BITS | symbols[following])
            if new is not None:
                heapq.heappush(heap, new << POSITION_BITS | at)
        previous = before[at]
        if previous >= 0:
            new = ranks.get(symbols[previous] << SYMBOL_BITS | made)
            if new is not None:
                heapq.heappush(heap, new << POSITION_BITS | previous)
    return count


_COUNTERS: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; made once per worker and vocabulary."""
    if path in _COUNTERS:
        return _COUNTERS[path]
    import regex

    ranks, specials = read_merges(path)
    chunk = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    blank = re.compile(f"[{SPACE}]*")
    inner = regex.compile(RUN_PATTERN)
    special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    known: dict[str, int] = {}

    def count_piece(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = merged_length(piece.encode(), ranks)
            if len(piece) <= 64:
                known[piece] = n
        return n

    def count_run(run: str) -> int:
        if run.isalpha() or run[1:].isalpha() and run[0] == " " or blank.fullmatch(run):
            return merged_length(run.encode(), ranks)
        return sum(map(count_piece, inner.findall(run)))

    def count_plain(text: str) -> int:
        total = 0
        for run in chunk.findall(text):
            n = known.get(run)
            if n is None:
                n = count_run(run)
                if len(run) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[run] = n
            total += n
        return total

    def count(text: str) -> int:
        if special is None:
            return count_plain(text)
        parts = special.split(text)
        return sum(map(count_plain, parts)) + len(parts) - 1

    return _COUNTERS.setdefault(path, count)


def token_count(text: Column, path: str) -> Column:
    """Tokens of every text under the byte-level vocabulary at ``path`` (a path that every executor can open)."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for batch in batches:
            yield pd.Series([count(text) for text in batch], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id, text``; more columns are ignored)."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
