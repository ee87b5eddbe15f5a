"""Source mix, toxicity and the pipeline."""

import zlib
from unittest import mock

import corpus_pipeline
import numpy as np
import pytest
from coordweave.llm import mixing
from coordweave.llm.mixing import mix, mixed_documents, split_quotas, taken_words
import coordweave.llm.queries  # noqa: F401
from coordweave.llm.registry import QUERIES
from coordweave.llm.simhash import near_duplicates
from coordweave.llm.toxicity import drop_toxic, score_toxicity
from pyspark.ml.regression import IsotonicRegression

from .brute import AWKWARD, VOCABULARY, prose, removed_bytes, table, words


def plain_targets(sizes):
    """Water-filling, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if weight[s] * level >= 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    texts = [*AWKWARD, *(prose(n, 1 + n * 13 % 90) for n in range(150))]
    source = lambda n: [None, "b", "a", "é", "Z", ""][n % 6] if n > 20 else "hot"
    docs = table(spark, texts, source)
    rows = {r["doc_id"]: r for r in taken_words(docs, block_words=300).collect()}
    sizes = {}
    for n, text in enumerate(texts):
        assert rows[n]["size"] == len(words(text))
        sizes[source(n)] = sizes.get(source(n), 0) + len(words(text))
    targets = plain_targets(sizes)
    taken = {}
    for n in range(len(texts)):
        r = rows[n]
        assert r["source_size"] == sizes[source(n)] and r["target"] == pytest.approx(targets[source(n)])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source(n)] = taken.get(source(n), 0) + r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 1
    again = {r["doc_id"]: r["taken"] for r in taken_words(docs.repartition(7), block_words=300).collect()}
    assert again == {n: r["taken"] for n, r in rows.items()}
    out = mixed_documents(docs, block_words=300)
    assert out.columns == docs.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())
    assert taken_words(table(spark, [])).count() == 0
    assert taken_words(docs.unionByName(docs)).count() == 2 * len(texts)


def test_shards_are_disjoint_and_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRAWS_PER_SHARD", 4)
    docs = table(spark, [prose(n, 40) for n in range(200)])
    draws = [d for r in mix(docs, block_words=60).collect() for d in r["_mix_draws"]]
    shards = {d["shard"] for d in draws}
    assert len(shards) > 10
    quotas = spark.createDataFrame([("a", 700), ("b", 200), (None, 100)], "_mix_source string, draws long")
    rows = split_quotas(quotas, 100, 3).collect()
    by_shard = np.zeros(100, int)
    for r in rows:
        by_shard[r["shard"]] += r["_to"] - r["_from"]
    assert set(by_shard) == {10}
    for s, n in (("a", 700), ("b", 200), (None, 100)):
        runs = sorted((r["_from"], r["_to"]) for r in rows if r["_mix_source"] == s and r["_to"] > r["_from"])
        assert runs[0][0] == 0 and runs[-1][1] == n and all(x[1] == y[0] for x, y in zip(runs, runs[1:], strict=False))


def toxic_table(spark, n):
    insults = ["grobbel", "fnarkish", "dweezle"]
    texts, toxic = [], []
    for k in range(n):
        bad = k % 5 == 0
        w = prose(k + 1, 60).split()
        if bad:
            for at in (5, 20, 40):
                w[at] = ("you " if at == 20 else "") + insults[(k + at) % 3]
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = toxic_table(spark, 1200)
    docs = table(spark, [*texts, *AWKWARD])
    labels = spark.createDataFrame([(n, 1, t, "x") for n, t in enumerate(toxic)] + [(None, 1, 1, "x"), (5, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(rows) == len(texts) + len(AWKWARD)
    for n, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(n).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [n for n in range(len(texts)) if rows[n]["held_out"]]
    right = np.mean([rows[n]["predicted"] == toxic[n] for n in held])
    assert right > 0.98
    other = labels.where("toxic IS NOT NULL").selectExpr("doc_id", "quality", "IF(CRC32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    assert {r["doc_id"]: r["score"] for r in score_toxicity(docs, other).collect()} == {n: r["score"] for n, r in rows.items()}  # labels held out are not read
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {n for n, r in rows.items() if not r["predicted"]}
    assert {r["score"] for r in score_toxicity(docs.limit(5), labels.where("false")).collect()} == {0.0}
    assert score_toxicity(table(spark, []), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    texts, toxic = toxic_table(spark, 300)
    texts += [prose(7, 200), prose(7, 200), prose(9, 100) + " " + prose(7, 60), None, ""]
    docs = table(spark, texts)
    spark.createDataFrame([(n, 1, t) for n, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    step = stages["toxicity"](spark, docs, str(tmp_path))
    scored = {r["doc_id"] for r in score_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect() if not r["predicted"]}
    assert {r["doc_id"] for r in step.collect()} == scored
    step = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in step.collect()} == {r["doc_id"] for r in near_duplicates(docs).collect() if r["doc_id"] == r["component_id"]}
    step = stages["repeated_passages"](spark, docs, str(tmp_path))
    want = removed_bytes(texts, 200)
    for r in step.collect():
        assert len((r["text"] or "").encode()) == len((texts[r["doc_id"]] or "").encode()) - want[r["doc_id"]][0]
        assert r["n_chars"] == len(r["text"])
    mixed = stages["source_mix"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    filled = {}
    for r in rows:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 2048


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} >= {f"op{n}" for n in range(1, 11)}
    assert VOCABULARY


def test_training_rows_take_the_smallest_text_of_an_id(spark):
    from coordweave.llm.toxicity import training_rows

    docs = spark.createDataFrame([(n, t) for n in range(12) for t in (f"b{n}", f"a{n}", f"c{n}", f"a{n}")] + [(100, None), (100, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in (*range(12), 100)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.text, r.toxic) for r in training_rows(docs, labels).collect())
    learned = [n for n in (*range(12), 100) if zlib.crc32(str(n).encode()) % 4 != 2]
    assert got == sorted((f"a{n}" if n < 12 else "", n % 2) for n in learned)


def test_few_rows_are_calibrated_where_both_classes_occur(spark):
    from coordweave.llm.toxicity import training_rows

    rows = [(n, "you vile awful brute" if n % 2 else "a calm and pleasant day") for n in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, toxic int")
    classes = training_rows(docs, labels).where("calibrates").groupBy("toxic").count().collect()
    assert len(classes) == 2 and all(r["count"] < 10 for r in classes)
    with mock.patch("coordweave.llm.toxicity.IsotonicRegression", side_effect=IsotonicRegression) as used:
        got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert used.called and len(got) == 60 and all(0 <= r.score <= 1 for r in got.values())
