"""Phrase collocations, hard negatives and window packing against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from coordweave.llm import quotient_filter as qf
from coordweave.llm.collocations import mine_phrases
from coordweave.llm.encoding import WordEndEncoder
from coordweave.llm.hard_negatives import hard_negatives, mining_rows, spanning_tree
from coordweave.llm.window_packing import combinations, nonnegative_least_squares, pack_windows, plan

from .brute import AWKWARD, LOWER, SCHEMA, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- phrases -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 7, 34, 63, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, 1 << bits, 5000, dtype=np.uint64)) if bits < 64 else np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    values = qf.permute(keys, bits)
    assert len(np.unique(values)) == len(keys)
    assert (qf.restore(values, bits) == keys).all()
    values = np.sort(values)
    counts = rng.integers(1, 400, len(values))
    back, same = qf.decode(qf.encode(values, counts, bits))
    assert (back == values).all() and (same == counts).all()
    total, sums, place = qf.merge([qf.encode(values, counts, bits), qf.encode(values[::2], counts[::2], bits)])
    assert (total[place] == np.concatenate([values, values[::2]])).all() and sums.sum() == counts.sum() + counts[::2].sum()


def plain_phrases(rows, least, absorbed, top, scale=2_000_000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found, longer = [], {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        for p, a in longer.items():
            if any(len(q) > len(p) and c * 100 >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in longer.items()):
                continue
            cuts = [(scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_phrases_equal_counting(spark):
    rng = random.Random(3)
    some = ["Alpha", "beta", "Gaä", "delta x", "e'", "\x1cz", "eta"]
    rows = [(rng.choice(["en", "en", None, "und", "fr"]), "".join(rng.choice(some) + rng.choice([" ", "  ", " ", "\t", ". ", "\n", ",\x0b"]) for _ in range(rng.randint(0, 120)))) for _ in range(60)]
    rows += [(rng.choice(["en", None]), t) for t in AWKWARD] + [("en", "of the of the of the of the " * 900)] * 2
    data = [(n, t, lang, None, None, "r", "s", "x", "l", "f") for n, (lang, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    for least, absorbed, top in ((4, 80, 2000), (30, 80, 7)):
        got = sorted(tuple(r) for r in mine_phrases(docs, least, absorbed, top).collect())
        assert got == plain_phrases(rows, least, absorbed, top)
    assert mine_phrases(docs.limit(0)).collect() == []
    assert mine_phrases(docs.where("doc_id < 3"), 10**6).collect() == []


# ---- hard negatives ----------------------------------------------------------------------------------------------------


def plain_negatives(rows, step=100):
    used = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(x * 256)) for x in v]))
    out = []
    for i, (anchor, label, a) in enumerate(used):
        if anchor % step:
            continue
        scored = [(-sum(x * y for x, y in zip(a, q)), vec_id, other == label) for j, (vec_id, other, q) in enumerate(used) if j != i]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fit = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(anchor, positive, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_equal_scoring(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(n, int(rng.integers(0, 3)), (centres[n % 6] + rng.normal(size=8) * 0.2).tolist()) for n in range(900)]
    rows += [(900 + n, 1, centres[0].tolist()) for n in range(20)]  # ties
    rows += [(1000, None, [1.0] * 8), (1001, 1, None), (1002, 1, [None] * 8), (1003, 1, [float("nan")] * 8), (1004, 2, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    rows += [(1100, 1, []), (1101, 2, [1.0, 2.0]), (1200, 1, [0.0] * 8), *rows[200:202], *rows[200:202]]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], "vec_id long, embedding array<double>, label int, row string, id long")
    got = sorted(tuple(r) for r in hard_negatives(mining_rows(df)).collect())
    assert got == plain_negatives(rows) and len(got) > 300
    assert hard_negatives(mining_rows(df.limit(0))).collect() == []
    huge = [(n, n % 2, [float(2**30) * (1 + n), 3.0]) for n in range(6)]
    df = spark.createDataFrame([(i, v, label) for i, label, v in huge], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives(mining_rows(df))
    wide = [(n, n % 2, [float(2**20) * (1 + n) + 1 / 256, 3.0]) for n in range(6)]  # beyond 2^53, exact in integers
    df = spark.createDataFrame([(i, v, label) for i, label, v in wide], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives(mining_rows(df)).collect()) == plain_negatives(wide)


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(5).normal(size=(40, 3))
    order, parent, edge = spanning_tree(x)
    assert sorted(order) == list(range(40)) and (parent[1:] < np.arange(1, 40)).all()
    assert np.allclose(edge[1:], [np.linalg.norm(x[order[i]] - x[order[parent[i]]]) for i in range(1, 40)])
    far = sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in range(40) for j in range(i))
    root, length = list(range(40)), 0.0
    for d, i, j in far:  # edges from the shortest
        a, b = root[i], root[j]
        if a != b:
            root, length = [a if r == b else r for r in root], length + d
    assert np.isclose(edge.sum(), length)


# ---- windows -----------------------------------------------------------------------------------------------------------


def test_combinations_fill_the_window():
    rows = combinations(16)
    assert (rows @ np.arange(16) == 16).all() and len(np.unique(rows, axis=0)) == len(rows)
    assert rows[:, 0].sum() == 0


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(6)
    for _ in range(5):
        a, b = rng.integers(0, 4, (12, 40)).astype(float), rng.random(12) * 10 - 2
        x = nonnegative_least_squares(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_keeps_to_the_counts():
    rng = np.random.default_rng(7)
    for counts in (rng.integers(0, 1000, 64), np.zeros(64, np.int64), np.eye(64, dtype=np.int64)[40] * 77, np.arange(64)):
        used, times = plan(counts)
        left = counts - times @ used if len(used) else counts
        assert (left >= 0).all() and (times > 0).all()
    used, times = plan(rng.integers(500, 1000, 64))
    assert times.sum() > 0


def test_word_ends_encode_as_the_library():
    library, mine, rng = Tokenizer.from_file(WORDS), WordEndEncoder(WORDS), random.Random(8)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "'s", "'LL", "'", "a", "É", "é", "́", "7", "२", "Σ", "<|endoftext|>", "<|", "\U0001f600", "\x00", "\x0b", "\x1c",
             "\x85", "-", "word", "漢", "ß", "ÿ", "µ", "×", "İ", "aaa", "http", "²", "_"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in AWKWARD] + [prose(9, 400)]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIéèüöñß '-.,;0123456789\n"
    texts += ["".join(rng.choices(letters, [6] * 26 + [1] * 9 + [2] * 6 + [12] + [1] * 16, k=rng.randint(1, 300))) for _ in range(3000)]
    texts += [chr(c) + "a" + chr(c) + " " + chr(c) + "7" for c in range(1, 0x250)]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [128, 4096])
def test_windows_hold_every_token_once(spark, size):
    texts = [*AWKWARD, *[prose(n, 3 + n * n % 700) for n in range(150)], prose(7, 9000), *[prose(3, 40)] * 12]
    docs = spark.createDataFrame([(n, t, None, "s", None, "r", "s", "x", None, "f") for n, t in enumerate(texts)], SCHEMA).repartition(4)
    rows = pack_windows(docs, WORDS, size).collect()
    library = Tokenizer.from_file(WORDS)
    ids = {n: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for n, t in enumerate(texts)}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert all(at[n] == len(ids[n]) for n in ids)
    filled = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= size and all(n & (n - 1) == 0 for n in filled.values())
    assert pack_windows(docs.limit(0), WORDS, size).collect() == []
