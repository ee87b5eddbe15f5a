"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

A fingerprint has 64 bits, and fingerprints link at three differing bits or fewer. Half of three is one and a half: every
fingerprint emits its ball of radius one, and the odd bit is left to one of four masked blocks of 16 bits, so a row stands
for all variants inside the masked block. Two fingerprints within three bits differ outside some block in two at most, so
their balls meet there: 4 x 49 rows per distinct fingerprint instead of the 2,081 of radius two. Rows are shuffled on
(mask, variant outside the mask); colliding ones are deduplicated and verified.

Groups of copies: equal fingerprints are one row. Where many fingerprints collide, each links to the first with the same
whole variant (they all lie within two bits of each other), and those whole variants link to their neighbours inside the
mask. So links grow with the rows, not with pairs, and reachability is that of all links.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; repeated rows share a
component; an id of null takes part with its fingerprint but names no component; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keep, numbered

BITS, BLOCK = 64, 16
MAX_DISTANCE = 3
SEED = 42
SHINGLE = 3
ROWS_PER_TASK = 1_500_000
CHUNK = 1 << 15

# (mask number, bit that is flipped or none) of every row of a ball, in order of its code
VARIANTS = [(m, bit) for m in range(BITS // BLOCK) for bit in [None, *(b for b in range(BITS) if b // BLOCK != m)]]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


FLIPS = [0 if bit is None else 1 << bit for _, bit in VARIANTS]
KEEPS = [((1 << BITS) - 1) ^ (((1 << BLOCK) - 1) << (m * BLOCK)) for m, _ in VARIANTS]


def fingerprint(text: bytes) -> int:
    """SimHash of the three-word shingles of a text, repeats included."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), *[b""] * (SHINGLE - 1)]
        shingles = [words[0]]
    else:
        shingles = list(map(b" ".join, zip(*(words[n:] for n in range(SHINGLE)), strict=False)))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(shingles), CHUNK):
        part = shingles[first : first + CHUNK]
        hashes = np.fromiter((digest(s, SEED) for s in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _linked(fp: np.ndarray, flip: np.ndarray, mask: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of one mask: fingerprints and the bits flipped in them."""
    keeps = np.uint64(KEEPS[mask * len(VARIANTS) // (BITS // BLOCK)])
    whole = fp ^ flip
    outside = whole & keeps
    order = np.argsort(outside, kind="stable")
    outside, whole, fp, flip = outside[order], whole[order], fp[order], flip[order]
    same = outside[1:] == outside[:-1]
    colliding = np.zeros(len(fp), dtype=bool)
    colliding[1:] |= same
    colliding[:-1] |= same
    whole, fp, flip = whole[colliding], fp[colliding], flip[colliding]
    if not len(fp):
        return []
    variants, first, of = np.unique(whole, return_index=True, return_inverse=True)
    links = [(fp, fp[first[of]])]

    def near(values: np.ndarray, owners: np.ndarray, change: int) -> None:
        other = values ^ np.uint64(change)
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        hit = (values[at] == other) & (values < other)
        links.append((owners[hit], owners[at[hit]]))

    inside = [1 << (mask * BLOCK + b) for b in range(BLOCK)]
    for bit in inside:
        near(variants, fp[first], bit)
    # Three bits inside the mask and none outside: no other mask brings those together.
    plain = np.unique(fp[flip == 0])
    if len(plain) > 1:
        for a, b, c in combinations(inside, 3):
            near(plain, plain, a | b | c)
    return links


def ball_links(fps: DataFrame, rows: int) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``fp``, distinct, ``rows`` of them) within three bits."""
    pick = lambda values, code: F.element_at(F.array(*[F.lit(_signed(v)) for v in values]), code + 1)
    code = F.col("code").cast("int")
    variant: Column = F.col("fp").bitwiseXOR(pick(FLIPS, code)).bitwiseAND(pick(KEEPS, code))
    balls = fps.select("fp", F.explode(F.array(*[F.lit(n).cast("short") for n in range(len(VARIANTS))])).alias("code"))
    tasks = max(1, -(-rows * len(VARIANTS) // ROWS_PER_TASK))
    per_mask = len(VARIANTS) // (BITS // BLOCK)
    dealt = balls.repartition(tasks, F.floor(code / per_mask), variant)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("fp").to_numpy(zero_copy_only=False), b.column("code").to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        fp = np.concatenate([p[0] for p in parts]).view(np.uint64)
        codes = np.concatenate([p[1] for p in parts])
        flips = np.array(FLIPS, dtype=np.uint64)
        for mask in range(BITS // BLOCK):
            own = codes // per_mask == mask
            for a, b in _linked(fp[own], flips[codes[own]], mask):
                differing = np.bitwise_count(a ^ b)
                good = (differing > 0) & (differing <= MAX_DISTANCE)
                pairs = np.unique(np.stack([a[good], b[good]], axis=1), axis=0).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``)."""
    marked = keep(fingerprints(docs))
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(ball_links(distinct.select("fp"), distinct.count()))
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_label")
    named = labelled.join(smallest, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id, where ids are unique."""
    rows = numbered(docs)
    marks = near_duplicates(rows.select(F.col("_llm_rid").alias("doc_id"), "text"))
    lost = marks.where("doc_id <> component_id").select(F.col("doc_id").alias("_llm_lost"))
    return rows.join(lost, F.col("_llm_rid") == F.col("_llm_lost"), "left_anti").select(*docs.columns)
