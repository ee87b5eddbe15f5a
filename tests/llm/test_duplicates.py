"""Near duplicates, repeated bytes and passages."""

import numpy as np
import pytest
import xxhash
from coordweave.llm import run_index
from coordweave.llm.common import components
from coordweave.llm.compact_windows import (
    LEAST, SIMILARITY, compact_windows, near_passages, packed, place_before, shared_enough, shingle_hashes, stretches, text_store, unpacked, verified,
)
from coordweave.llm.embedding_join import near_vectors
from coordweave.llm.run_index import RunIndex, drop_repeats, repeat_digests
from coordweave.llm.simhash import ball_links, drop_near_duplicates, near_duplicates

from .brute import AWKWARD, LOWER, labels_of, prose, removed_bytes, table, words


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def changed(text, at, word="changed"):
    w = text.split()
    w[at] = word
    return " ".join(w)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(n, n + 1) for n in range(1000, 1040)] + [(2000, 3000 + n) for n in range(50)]
    want = labels_of({x for a, b in edges if a != b for x in (a, b)}, edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_rows(spark):
    long = prose(7, 900)
    texts = [*AWKWARD, long, changed(long, 400), changed(long, 401, "Other"), long.upper(), prose(8, 60), prose(8, 60)]
    fps = [fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = labels_of(range(len(fps)), edges)
    rows = {r["doc_id"]: r for r in near_duplicates(table(spark, texts)).collect()}
    for n in range(len(texts)):
        assert (rows[n]["fingerprint"], rows[n]["component_id"]) == (f"{fps[n]:016x}", want[n])
    kept = drop_near_duplicates(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    doubled = table(spark, texts[-2:]).unionByName(table(spark, texts[-2:]))
    assert drop_near_duplicates(doubled).count() == 1
    assert near_duplicates(table(spark, [])).count() == 0


def test_balls_connect_all_within_three_bits(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    values = list(centres)
    for c in centres:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            values.append(np.uint64(int(c) ^ sum(1 << int(b) for b in flips)))
        values.append(np.uint64(int(c) ^ 0b111))  # three bits of one block
    values = np.unique(np.array(values, dtype=np.uint64))
    near = [(i, j) for i in range(len(values)) for j in range(i) if bin(int(values[i] ^ values[j])).count("1") <= 3]
    want = labels_of(range(len(values)), near)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    at = {int(v): n for n, v in enumerate(values.view(np.int64))}
    links = [(at[r["a"]], at[r["b"]]) for r in ball_links(fps, len(values)).collect()]
    assert set(links) <= {p for i, j in near for p in ((i, j), (j, i))}
    assert labels_of(range(len(values)), links) == want


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    rows = [(n, (base[n % 40] + (0.08 * rng.normal(size=12) if n >= 40 else 0)).tolist()) for n in range(400)]
    rows += [(1000 + n, base[0].tolist()) for n in range(5)] + [(2000, (base[0] * 3).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] * 12), (3004, [None] + [1.0] * 11), (3005, [float("inf")] * 12), (None, base[1].tolist())]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, w string")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 3000]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = np.argwhere((x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool))
    want = labels_of([i for i, _ in good], [(good[a][0], good[b][0]) for a, b in near])
    counts = np.bincount(near[:, 0], minlength=len(good))
    for k, (i, _) in enumerate(good):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (counts[k], want[i], want[i] == i)
    for i in range(3000, 3006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


REPEATS = [
    prose(1, 90) + " tail one", "head " + prose(1, 90), prose(2, 60) + " " + prose(1, 45), prose(3, 100), prose(3, 100), prose(4, 50) + "ß漢" + prose(4, 50) + "ß漢",
    changed(prose(1, 90), 40), "ab" * 300, prose(5, 40) + "\n" + prose(5, 40),
]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_bytes(spark, monkeypatch, hot):
    """Also with every shared anchor taken for a hot one."""
    monkeypatch.setattr(run_index, "HOT", hot)
    texts = [*AWKWARD, *REPEATS]
    want = removed_bytes(texts, 200)
    rows = {r["doc_id"]: r for r in repeat_digests(table(spark, texts)).collect()}
    for n, text in enumerate(texts):
        r = rows[n]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((text or "").encode()), *want[n]), n


def test_repeated_bytes_without_ids_and_rows(spark):
    docs = table(spark, [prose(1, 90), prose(2, 90)])
    twice = docs.unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:]))
    assert [r["n_removed"] == r["n_bytes"] for r in repeat_digests(twice).collect()] == [True] * 4
    assert repeat_digests(table(spark, [])).count() == 0
    kept = drop_repeats(table(spark, REPEATS))
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[3] == ""


def test_run_index_matches_every_suffix():
    texts = [b"abracadabra abracadabra", b"cadabra abr", b"zzzzzzzz", b"abracadabra abracadabrb"]
    index = RunIndex(texts, max(map(len, texts)))
    found = index.statistics()
    data = index.text.tobytes()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(data[a:], data[b:], strict=False)) if x != y), len(data) - max(a, b))
    for at in range(len(data)):
        assert found[at] == max(common(at, other) for other in range(len(data)) if other != at)


def test_compact_windows_are_the_nodes_of_the_tree():
    rng = np.random.default_rng(4)

    def nodes(values, lo, hi, least):
        if hi - lo < least:
            return []
        at = lo + int(values[lo:hi].argmin())
        return [(lo, at, hi - 1), *nodes(values, lo, at, least), *nodes(values, at + 1, hi, least)]

    for n in (3, 9, 50, 300):
        for most in (3, 1 << 40):
            values = rng.integers(1, most, n).astype(np.uint64)
            for least in (1, 4, 7):
                left, at, right = compact_windows(values, least)
                assert sorted(zip(left.tolist(), at.tolist(), right.tolist(), strict=True)) == sorted(nodes(values, 0, n, least))


def test_near_passages(spark):
    passage = prose(11, 120)
    near = changed(changed(passage, 30), 90)
    texts = [
        *AWKWARD, prose(20, 200) + " " + passage + " " + prose(21, 150), prose(22, 30) + " " + passage, near + " " + prose(23, 300), prose(24, 400), prose(25, 60), prose(25, 60),
        prose(26, 500), passage[: len(passage) // 4] + " " + prose(27, 100),
    ]
    first = len(AWKWARD)
    rows = near_passages(table(spark, texts)).collect()
    pairs = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in rows}
    assert {(first, first + 1), (first + 4, first + 5)} <= pairs
    assert {x for p in pairs for x in p} == {first, first + 1, first + 2, first + 4, first + 5}
    for r in rows:
        a, b = (texts[r[i]].translate(LOWER).split()[r[s] : r[e]] for i, s, e in (("doc_id", "start", "end"), ("other_id", "other_start", "other_end")))
        shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b)]
        assert len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) == pytest.approx(r["similarity"])
        assert r["similarity"] >= 0.8 and min(len(a), len(b)) >= LEAST + 4
    assert {r["class_id"] for r in rows} == {first, first + 4}
    assert near_passages(table(spark, [])).count() == 0


def family(seed, n, most):
    """Texts that hold one passage of 80 words with up to ``most`` replaced words, each between words of its own."""
    rng, passage = np.random.default_rng(seed), prose(seed, 80).split()
    texts = []
    for k in range(n):
        w = list(passage)
        for at in rng.choice(80, rng.integers(0, most + 1), replace=False):
            w[at] = f"new{seed}x{k}x{at}"
        texts.append(" ".join([prose(seed * 1000 + 2 * k, int(rng.integers(0, 60))), *w, prose(seed * 1000 + 2 * k + 1, int(rng.integers(0, 60)))]))
    return texts


@pytest.mark.parametrize("parts", [1, 7])
def test_near_passages_of_families(spark, parts):
    """Every two texts of a family that the verification joins are in one class, also where most do not join the first."""
    texts = [x for seed in (41, 42, 43, 44) for x in family(seed, 24, 5)]
    hashes = [shingle_hashes(x.encode()) for x in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if i // 24 == j // 24 and verified(hashes[i], hashes[j], LEAST, SIMILARITY)]
    want = labels_of(range(len(texts)), near)
    rows = near_passages(table(spark, texts).repartition(parts, "doc_id")).collect()
    assert {tuple(sorted((r["other_id"], r["doc_id"]), reverse=True)) for r in rows} <= set(near)
    got = labels_of(range(len(texts)), [(r["doc_id"], r["other_id"]) for r in rows])
    joined = [got[i] == got[j] for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert np.mean(joined) >= 0.98
    assert {r["doc_id"]: r["class_id"] for r in rows} == {n: got[n] for r in rows for n in [r["doc_id"]]}


def test_near_passages_at_two_places(spark):
    passage = prose(51, 70)
    twice = " ".join([prose(52, 80), passage, prose(53, 150), passage, prose(54, 80)])
    rows = near_passages(table(spark, [twice, prose(55, 40) + " " + passage])).collect()
    assert sorted(r["other_start"] // 10 for r in rows) == [8, 30]


def test_texts_are_shuffled_once(spark):
    """What is asked of texts goes to where they lie; a join that shuffles them again takes the disk of a run beyond its limit."""
    docs = table(spark, [prose(n, 80) for n in range(20)]).selectExpr("doc_id AS rid", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = text_store(docs, docs.where("rid <> 3").select("rid"), 3, LEAST)
        pairs = spark.createDataFrame([(0, 1, 0, 60, 2, 5, 70), (1, 4, 7, 60, 2, 0, 50)], "pair long, a long, a_from long, a_to long, b long, b_from long, b_to long")
        sides = stretches(texts, pairs, 3)
        plan = sides._jdf.queryExecution().executedPlan().toString()
        got = {(r["pair"], r["side"]): (r["start"], len(r["shingles"]) // 6) for r in sides.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert got == {(0, 0): (0, 60), (0, 1): (5, 65), (1, 0): (7, 53), (1, 1): (0, 50)}
    assert sorted(r["rid"] for r in texts.collect()) == [n for n in range(20) if n != 3]


def test_packed_columns():
    rng = np.random.default_rng(8)
    for n in (0, 1, 500):
        columns = [np.sort(rng.integers(-(1 << 63), 1 << 63, n)) // 7 * 7, rng.integers(0, 1 << 48, n), rng.integers(0, 1 << 31, n).astype(np.int32)]
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(columns, unpacked(packed(columns, [6, 4]), [6, 4]), strict=True))


def test_windows_stay_open_by_distinct_shingles():
    """A word that many texts repeat is one shingle: it keeps no window open, so its texts do not all meet."""
    rng, least = np.random.default_rng(9), 12
    found = []
    for _ in range(300):
        data = rng.integers(0, int(rng.integers(3, 40)), int(rng.integers(10, 40)))
        shared = rng.random(40) < 0.8
        left, place, right = sorted(rng.integers(0, len(data), 3).tolist())
        cuts = [np.unique(data[i : j + 1]) for i in range(left, place + 1) for j in range(max(place, i + least - 1), right + 1)]
        want = any(shared[x].mean() >= SIMILARITY - 1e-9 for x in cuts)
        _, inverse, times = np.unique(data, return_inverse=True, return_counts=True)
        assert shared_enough(shared[data], times[inverse] == 1, place_before(data), left, place, right, least, SIMILARITY) == want
        found.append(want)
    assert 20 < sum(found) < 280


def similar_intervals(a, b, least, similarity):
    """Whether any interval of ``a`` and any of ``b``, of ``least`` shingles or more, are similar enough."""
    cuts = lambda x: [set(x[lo:hi].tolist()) for lo in range(len(x)) for hi in range(lo + least, len(x) + 1)]
    right = cuts(b)
    return any(len(x & y) >= similarity * len(x | y) for x in cuts(a) for y in right)


@pytest.mark.parametrize("n, at", [(60, 14), (54, 0), (54, 2), (50, 24), (50, 2)])
def test_one_replaced_word_is_verified(n, at):
    a, b = (shingle_hashes(t.encode()) for t in (prose(31, n), changed(prose(31, n), at)))
    assert similar_intervals(a, b, LEAST, SIMILARITY)
    found = verified(a, b, LEAST, SIMILARITY)
    assert found
    for a_from, a_to, b_from, b_to, share in found:
        x, y = set(a[a_from:a_to].tolist()), set(b[b_from:b_to].tolist())
        assert min(a_to - a_from, b_to - b_from) >= LEAST and share == pytest.approx(len(x & y) / len(x | y)) and share >= SIMILARITY


def test_verification_against_all_intervals():
    rng = np.random.default_rng(6)
    outcomes = []
    for seed in range(150):
        least = 12
        w = prose(100 + seed, int(rng.integers(16, 30))).split()
        other = list(w)
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(0, len(other)))
            other[at : at + int(rng.integers(0, 2))] = prose(int(rng.integers(900, 999)), int(rng.integers(0, 3))).split()
        other = prose(500 + seed, int(rng.integers(0, 8))).split() + other
        a, b = (shingle_hashes(" ".join(x).encode()) for x in (w, other))
        want = similar_intervals(a, b, least, SIMILARITY)
        assert bool(verified(a, b, least, SIMILARITY)) == want, seed
        outcomes.append(want)
    assert 20 < sum(outcomes) < 130
