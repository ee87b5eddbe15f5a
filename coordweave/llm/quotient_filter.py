"""Counting quotient filters over integer keys, as compact byte strings.

A key of ``bits`` bits is permuted invertibly, so that keys spread evenly over ranges and slots. The leading bits (the
quotient) name a slot, and only the run length of every slot is stored; the remaining bits are stored in full. Nothing is
lost: ``decode`` gives back every key with its exact count. Filters of one range merge by merging their sorted contents.
"""

from __future__ import annotations

import struct

import numpy as np

# Odd multipliers of a published 64-bit mixing function.
_FIRST, _SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_HEAD = "<QBBQ"


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one mixing of ``bits``-bit keys."""
    mask, half = _mask(bits), np.uint64((bits + 1) // 2)
    x = (keys.astype(np.uint64) * np.uint64(_FIRST)) & mask
    x ^= x >> half
    x = (x * np.uint64(_SECOND)) & mask
    return x ^ (x >> half)


def restore(values: np.ndarray, bits: int) -> np.ndarray:
    """The keys that ``permute`` gave ``values`` for."""
    mask, half = _mask(bits), np.uint64((bits + 1) // 2)
    x = values ^ (values >> half)
    x = (x * np.uint64(pow(_SECOND, -1, 1 << 64))) & mask
    x ^= x >> half
    return (x * np.uint64(pow(_FIRST, -1, 1 << 64))) & mask


def encode(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct ``values`` below 2^bits with their counts."""
    n = len(values)
    quotient = min(bits, max(0, n.bit_length() - 1))
    rest = bits - quotient
    slots = (values >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
    runs = np.bincount(slots, minlength=1 << quotient)
    wide = int(runs.max(initial=0) > 255)
    kept = (values & _mask(rest)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-rest // 8)]
    large = np.flatnonzero(counts > 254)
    small = counts.astype(np.int64).copy()
    small[large] = 255
    return b"".join((
        struct.pack(_HEAD, n, bits, wide, len(large)), runs.astype("<u4" if wide else np.uint8).tobytes(), kept.T.tobytes(),
        small.astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes(),
    ))


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and counts of a filter."""
    n, bits, wide, many = struct.unpack_from(_HEAD, data)
    quotient = min(bits, max(0, n.bit_length() - 1))
    rest, at = bits - quotient, struct.calcsize(_HEAD)
    runs = np.frombuffer(data, "<u4" if wide else np.uint8, 1 << quotient, at)
    at += runs.nbytes
    width = -(-rest // 8)
    kept = np.zeros((n, 8), np.uint8)
    kept[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    at += n * width
    values = kept.view("<u8").ravel().astype(np.uint64)
    if rest < 64:
        values |= np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs) << np.uint64(rest)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", many, at + n)
    return values, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted values and total counts of several filters, and for every entry of theirs in turn its place among them."""
    parts = [decode(f) for f in filters]
    values = np.concatenate([v for v, _ in parts])
    distinct, place = np.unique(values, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate([c for _, c in parts]))
    return distinct, total, place
