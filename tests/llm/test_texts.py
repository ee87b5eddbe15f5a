"""Token counts, packing, licence scans and quality rules."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from coordweave.llm.license_scan import scan_licenses, scan_sql
from coordweave.llm.packing import FANOUT, best_fit, encoder, pack_documents, pack_pieces, passed_up
from coordweave.llm.quality import quality_rules
from coordweave.llm.token_count import count_tokens, counter
from pyspark.sql import functions as F

from .brute import AWKWARD, TOKENIZER, VOCABULARY, prose, table, words

PIECES = ["a", "th", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "'s", "'ll", "12", "٣", "!", "...", "<|endoftext|>", "漢字", "😀", "́", "\r\n", "A", "_"]


def odd_texts(n):
    pick = random.Random(3)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 14))) for _ in range(n)]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_counts_are_those_of_the_library():
    count = counter(VOCABULARY)
    for text in [*odd_texts(3000), "x" * 5000, prose(1, 3000)]:
        assert count(text) == len(ids(text))


def test_fast_ids_are_those_of_the_library():
    texts = odd_texts(3000)
    assert [encoder(VOCABULARY)(t) for t in texts] == [ids(t) for t in texts]


def test_token_count_rows(spark):
    texts = [*AWKWARD, prose(2, 700)]
    got = {r["doc_id"]: r for r in count_tokens(table(spark, texts), VOCABULARY).collect()}
    for n, text in enumerate(texts):
        assert (got[n]["n_bytes"], got[n]["n_tokens"]) == (len((text or "").encode()), len(ids(text)))
        assert got[n]["over_limit"] == (len(ids(text)) > 512)
    assert count_tokens(table(spark, []), VOCABULARY).count() == 0


def check_packing(rows, texts, size):
    by_text, by_sequence = {}, {}
    for r in rows:
        by_text.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for n, text in enumerate(texts):
        want, at = [*ids(text), 0], 0
        for k, r in enumerate(sorted(by_text[n], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert k == 0 or r["length"] == size
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for rows_of in by_sequence.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing(spark):
    texts = [*AWKWARD, *(prose(n, 3 + n * 7 % 120) for n in range(60))]
    docs = table(spark, texts).repartition(12)
    used = check_packing(pack_documents(docs, VOCABULARY, 128).collect(), texts, 128)
    least = -(-sum(len(ids(t)) + 1 for t in texts) // 128)
    assert used <= least * 1.03 + 1
    assert pack_documents(table(spark, []), VOCABULARY).count() == 0


def test_best_fit():
    lengths = np.array([5, 3, 7, 2, 8, 1, 4, 2])
    at, place, filled = best_fit(lengths, 8)
    assert filled.tolist() == [8, 8, 8, 8]
    assert (place + lengths <= 8).all()


def test_what_goes_up_is_enough():
    rng = np.random.default_rng(8)
    for n in (1, 40, 3000):
        for most in (30, 100, 300):
            filled = best_fit(rng.integers(1, most + 1, n), 300)[2]
            up = passed_up(filled, 300)
            rest = np.delete(filled, up)
            assert (filled[up] <= 150).sum() <= 1 and len(up) <= FANOUT + 1 and (rest > 150).all()
            if len(up) > FANOUT:
                roomiest = np.sort(filled[up][filled[up] > 150])
                assert len(roomiest) == FANOUT and (rest >= roomiest[-1]).all()


@pytest.mark.parametrize("order", ["-length", "length", "ids_crc32"])
def test_packing_is_near_the_best_in_any_order(spark, order):
    """Long pieces of one source and short ones of another meet in every leaf, however the input is ordered."""
    rows = "id AS doc_id, 0 AS piece, 0L AS start, IF(id < 60000, 1500L, 500L) AS length, CRC32(CAST(CAST(id AS STRING) AS BINARY)) AS ids_crc32"
    pieces = spark.sql(f"SELECT {rows} FROM range(120000)")
    packed = pack_pieces(pieces.repartition(1).sortWithinPartitions(F.expr(order)), leaf=5000).cache()
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces")).collect()
    assert packed.select("doc_id").distinct().count() == packed.count() == 120_000
    assert 60_000 <= len(sums) <= 60_600 and all(r["n"] <= 2048 and r["places"] == r["pieces"] for r in sums)


@pytest.mark.parametrize("leaf", [7, 60, 100_000])
def test_packing_over_levels_of_the_tree(spark, leaf):
    """Any number of levels keeps every piece once and gapless, and stays near best fit over everything."""
    rng = np.random.default_rng(9)
    lengths = np.concatenate([rng.integers(1, 101, 900), np.full(300, 64), np.full(200, 100), rng.integers(1, 9, 400)])
    pieces = spark.createDataFrame([(None if n % 9 == 0 else n, 0, 0, int(m), n) for n, m in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack_pieces(pieces.repartition(5), 100, leaf).collect()
    assert sorted(r["ids_crc32"] for r in rows) == list(range(len(lengths)))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    whole = len(best_fit(lengths, 100)[2])
    assert len(by_sequence) <= whole * (1.01 if leaf > 7 else 1.2)


LICENCES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "text before. Licensed under the Apache License, Version 2.0.\nMIT LICENSE mit license",
    "licence: CC-BY 4.0",
    "Gnu general public",
    "GNU general\npublic license " + "x " * 200 + "released under the mit license " + "y " * 100,
    "permission is granted hereby free of charge to any person obtaining copies of this software and associated documentation files",
    "K license apache license",
]


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n",
    "mpl-2.0": "# This Source Code Form is subject to the terms of the\n# Mozilla Public License, v. 2.0. If a copy of the MPL\n",
    "gpl-2.0": "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published; either version 2\n",
}


def test_wrapped_notices_anywhere_in_a_text(spark):
    texts = [(label, "word " * before + "\n" + notice + "tail\n" * after) for label, notice in WRAPPED.items() for before in (0, 31, 45, 1000) for after in (0, 500)]
    docs = table(spark, [text for _, text in texts])
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, (label, _) in enumerate(texts):
        assert label in got[i].labels.split(",") and got[i].score >= 0.9, (label, got[i])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, got.values())) == sorted(con.sql(scan_sql()).fetchall())


def test_license_scan(spark):
    texts = [*AWKWARD, *LICENCES]
    docs = table(spark, texts)
    got = sorted(map(tuple, scan_licenses(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(scan_sql()).fetchall()
    plain = lambda rows: sorted(tuple(None if v != v else v for v in r) for r in rows)
    assert [tuple(map(str, r)) for r in plain(got)] == [tuple(map(str, r)) for r in plain(want)]
    by_id = {r[0]: r for r in got}
    assert "gpl" in by_id[len(AWKWARD)][5] and "gpl-3.0" in by_id[len(AWKWARD)][6]
    assert by_id[len(AWKWARD) + 1][2] == 3
    assert scan_licenses(table(spark, [])).count() == 0


def base(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_quality_rules(spark):
    good = [prose(n, 80) for n in range(30)]
    poor = [" ".join(f"{w}%%%" for w in ["the", "of", "and", *prose(n, 5).split()] * 3 + prose(n + 50, 60).split()) for n in range(30)]
    texts = [*AWKWARD, *good, *poor, "a b c a b c x " * 40, prose(5, 4000)]
    labels = spark.createDataFrame([(len(AWKWARD) + n, 1, 0, "x") for n in range(30)] + [(None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r["doc_id"]: r for r in quality_rules(table(spark, texts), labels).collect()}
    for n, text in enumerate(texts):
        assert tuple(rows[n][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text)
        assert not (rows[n]["kept"] and rows[n]["base_failed"])
    score = lambda first: np.mean([rows[n]["score"] for n in range(first, first + 30)])
    assert score(len(AWKWARD)) > score(len(AWKWARD) + 30)
    assert quality_rules(table(spark, []), labels).count() == 0
    neutral = quality_rules(table(spark, good), labels.where("false")).collect()
    assert all(r["score"] == 0 and r["kept"] for r in neutral)


@pytest.mark.parametrize("copies", [1, 3])
def test_quality_scores_follow_the_ratios(spark, copies):
    """Against a plain count of the same buckets, with Spark's own hash of words and pairs."""
    import math

    import xxhash
    from coordweave.llm import quality as q

    def bucket(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % q.BUCKETS

    texts = [prose(n, 20) for n in range(6)] * copies
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_rules(table(spark, texts), labels).collect()}
    features = [[bucket(w) for w in words(t)] + [bucket(*p) for p in zip(words(t), words(t)[1:], strict=False)] for t in texts]
    raw, trusted = Counter(b for f in features for b in f), Counter(b for f in features[:2] for b in f)
    share = sum(trusted.values()) / sum(raw.values())
    ratio = {b: math.log((trusted[b] + q.SMOOTHING) / (raw[b] * share + q.SMOOTHING)) for b in raw}
    for n, f in enumerate(features):
        assert got[n] == pytest.approx(sum(ratio[b] for b in f) / len(f), abs=1e-6)


def test_quality_counts_all_trusted_documents(spark):
    """More of them than were once sampled."""
    from coordweave.llm import quality as q

    docs = spark.range(44_000).selectExpr("id AS doc_id", "IF(id < 30000, 'alpha beta', 'gamma delta') AS text")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality")
    score = quality_rules(docs, labels).where("doc_id = 7").first()["score"]
    expected = 30_000 * 90_000 / 132_000  # two words and a pair in each text
    assert score == pytest.approx(np.log((30_000 + q.SMOOTHING) / (expected + q.SMOOTHING)), abs=1e-6)
