"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .collocations import mine_phrases, phrases_sql
from .compact_windows import near_passages
from .embedding_join import near_vectors
from .hard_negatives import hard_negatives, mining_rows
from .license_scan import scan_licenses, scan_sql
from .mixing import taken_words
from .packing import pack_documents
from .quality import quality_rules
from .registry import ORACLES, load, query
from .run_index import repeat_digests
from .simhash import near_duplicates
from .token_count import count_tokens
from .toxicity import score_toxicity
from .window_packing import pack_windows


def vocabulary() -> str:
    """The public byte-level vocabulary; every executor has it at this path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_token_counts(spark, sf):
    return count_tokens(load(spark, sf, "documents"), vocabulary())


@query
def op4_best_fit_packing(spark, sf):
    return pack_documents(load(spark, sf, "documents"), vocabulary())


@query
def op7_source_mix(spark, sf):
    return taken_words(load(spark, sf, "documents"))


@query
def op10_quality_rules(spark, sf):
    return quality_rules(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op5_license_scan(spark, sf):
    return scan_licenses(load(spark, sf, "documents"))


ORACLES["op5_license_scan"] = scan_sql()


@query
def op2_simhash_groups(spark, sf):
    return near_duplicates(load(spark, sf, "documents"))


@query
def op1_toxicity(spark, sf):
    return score_toxicity(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op3_embedding_groups(spark, sf):
    return near_vectors(load(spark, sf, "embeddings"))


ORACLES["op3_embedding_groups"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_inner_product(v, v) > 0),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM ok),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM e JOIN low ON low.a = e.vec_id LEFT JOIN links ON links.a = e.vec_id"""


@query
def op6_repeated_bytes(spark, sf):
    return repeat_digests(load(spark, sf, "documents"))


@query
def op9_near_passages(spark, sf):
    return near_passages(load(spark, sf, "documents"))


@query
def op11_phrases(spark, sf):
    return mine_phrases(load(spark, sf, "documents"))


ORACLES["op11_phrases"] = phrases_sql()


@query
def op12_hard_negatives(spark, sf):
    return hard_negatives(mining_rows(load(spark, sf, "embeddings")))


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
r AS (SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM r WHERE rank <= 10"""


@query
def op13_window_packing(spark, sf):
    import public_tokenizers

    return pack_windows(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
