"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

A lexicon is drawn from labelled documents: words, and beginnings of words, that mark toxic ones far more often than chance
allows. Features are lexicon densities, how close lexicon words stand to second-person words, capitals, punctuation and
obfuscation rates. Trees are fitted to three quarters of the training rows, isotonic regression to the rest. Only text is
read for a score: no label, language, source or id.

The training sample is bounded (``TRAINING_ROWS``, about), and so are the lexicon (``LEXICON``) and the trees; they go to
every task.

Defined results: a null or empty text has features of zero and gets a score; repeated rows get equal scores; without
labelled rows of both classes every score is the share of toxic rows (0 without any); where the calibrating rows are of one
class only, scores are those of the trees; of an id with several texts the smallest is learned from; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored
(those of ``drop_toxic`` are kept; names that begin with an underscore are reserved).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

TRAINING_ROWS = 20_000
LEXICON = 512
EVIDENCE = 25.0  # least likelihood-ratio statistic of a lexicon entry
PREFIXES = (4, 5, 6)
NEAR = 5  # words between a lexicon word and a second-person word
THRESHOLD = 0.3
SEED = 17
TREES, DEPTH = 20, 4
REMEMBERED = 200_000

# Second-person words, and characters that stand for letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou thee du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()
)
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FEATURES = [
    "log_words", "word_density", "prefix_density", "log_hits", "distinct_hits", "evidence", "near_second_person", "second_person", "capitals",
    "capital_words", "exclamations", "punctuation", "symbols", "digits", "obfuscated", "obfuscated_hits", "stretched", "word_length",
]
COLUMNS = [f"_toxicity_{name}" for name in FEATURES]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``text, toxic, calibrates`` of about ``rows`` labelled documents outside the held-out quarter (all, if fewer)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, rows / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 30))
    chosen = known.where(draw < int(share * (1 << 30))).withColumn("calibrates", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(4)) == 0)
    # The ids of the sample are bounded; a document given twice counts once, by its smallest text.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return joined.groupBy("_id", "toxic", "calibrates").agg(F.min("text").alias("text")).select("text", "toxic", "calibrates")


def draw_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words (as they are) and beginnings of words (ending in ``*``) that mark toxic rows, with their evidence."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: F.length(w) > 2))
    starts = [F.transform(F.filter("_w", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    terms = sample.select("toxic", words.alias("_w")).select("toxic", F.explode(F.array_distinct(F.concat("_w", *starts))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).first()
    if not totals["toxic"]:
        return {}
    rate = totals["toxic"] / totals["rows"]
    k, n = F.col("k"), F.col("n")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    evidence = 2 * (part(k, n * rate) + part(n - k, n * (1 - rate)))
    toxic = counts.where((k > 2 * n * rate) & (k * 2 > n)).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE)
    return {row["term"]: row["evidence"] for row in toxic.orderBy(F.desc("evidence"), "term").limit(size).collect()}


def featurize(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with the columns ``COLUMNS``: the features of every text."""

    @F.pandas_udf(", ".join(f"{name} double" for name in FEATURES))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        word = re.compile(WORD)
        mixed = re.compile(r"[^\W\d_]+[0-9@$!|*]+[^\W\d_]+")
        stretched = re.compile(r"([^\W\d_])\1\1")
        known: dict[str, tuple | None] = {}

        def look(w: str) -> tuple[float, float]:
            """Evidence of a word, and of its beginning."""
            return lexicon.get(w, 0.0), max((lexicon.get(w[:n] + "*", 0.0) for n in PREFIXES if len(w) > n), default=0.0)

        def judge(token: str) -> tuple | None:
            """(word hits, beginning hits, evidence, second person, obfuscated, obfuscated hits, stretched), None if all are zero."""
            lower = token.lower()
            found = [look(w) for w in word.findall(lower)]
            odd = bool(mixed.search(token))
            hidden = 0
            if odd and not any(a or b for a, b in found):
                hidden = int(any(look(w) != (0.0, 0.0) for w in word.findall(lower.translate(STANDS_FOR).replace("*", ""))))
            out = (
                sum(a > 0 for a, _ in found), sum(b > 0 for _, b in found), max((max(x) for x in found), default=0.0),
                int(any(w in SECOND_PERSON for w in word.findall(lower))), int(odd), hidden, int(bool(stretched.search(lower))),
            )
            return out if any(out) else None

        def features(text: str) -> tuple[float, ...]:
            tokens = text.split()
            n = max(len(tokens), 1)
            sums = [0.0] * 7
            hits = distinct = 0
            marks: set[str] = set()
            for token, count in Counter(tokens).items():
                if token in known:
                    seen = known[token]
                else:
                    seen = judge(token)
                    if len(token) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[token] = seen
                if seen is None:
                    continue
                for i, v in enumerate(seen):
                    sums[i] = max(sums[i], v) if i == 2 else sums[i] + v * count
                if seen[0] or seen[1] or seen[5]:
                    hits += count
                    distinct += 1
                    marks.add(token)
            near = 0
            if marks and sums[3]:
                last_hit = last_you = -NEAR - 1
                for at, token in enumerate(tokens):
                    if token in marks:
                        last_hit = at
                        near += at - last_you <= NEAR
                    elif word.findall(token.lower())[:1] and word.findall(token.lower())[0] in SECOND_PERSON:
                        last_you = at
                        near += at - last_hit <= NEAR
            data = text.encode("utf-8", "replace")
            size = max(len(data), 1)
            rate = lambda chars: (len(data) - len(data.translate(None, chars))) / size
            return (
                math.log1p(len(tokens)), sums[0] / n, sums[1] / n, math.log1p(hits), float(distinct), math.log1p(sums[2]), near / n, sums[3] / n,
                rate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(t.isupper() and len(t) > 1 for t in tokens) / n, rate(b"!?"), rate(b".,;:'\"()-"), rate(b"#*$%&|<>@^~"),
                rate(b"0123456789"), sums[4] / n, sums[5] / n, sums[6] / n, len(data) / n,
            )

        for batch in batches:
            yield pd.DataFrame([features(t) for t in batch], columns=FEATURES, dtype="float64")

    made = docs.withColumn("_toxicity", run(F.coalesce("text", F.lit(""))))
    return made.withColumns({column: F.col("_toxicity")[name] for column, name in zip(COLUMNS, FEATURES, strict=True)}).drop("_toxicity")


def fit(sample: DataFrame):
    """The lexicon, and a function that turns features into ``_score``."""
    lexicon = draw_lexicon(sample)
    rows = keep(featurize(sample, lexicon).select("toxic", "calibrates", *COLUMNS).coalesce(8))
    classes = {(r["toxic"], r["calibrates"]): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    total = sum(classes.values())
    if min(classes.get((c, False), 0) for c in (0, 1)) == 0:
        share = sum(n for (toxic, _), n in classes.items() if toxic) / max(total, 1)
        return lexicon, lambda features: features.withColumn("_score", F.lit(float(share))).drop(*COLUMNS)
    assembler = VectorAssembler(inputCols=COLUMNS, outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol="toxic", predictionCol="_class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8,
        minInstancesPerNode=5, seed=SEED,
    ).setProbabilityCol("_p").setRawPredictionCol("_raw")
    model = trees.fit(assembler.transform(rows.where("NOT calibrates")))
    boosted = PipelineModel(stages=[assembler, model])

    def chance(features: DataFrame) -> DataFrame:
        return boosted.transform(features).withColumn("_chance", vector_to_array("_p")[1]).drop("_features", "_class", "_p", "_raw", *COLUMNS)

    if min(classes.get((c, True), 0) for c in (0, 1)) == 0:  # one class alone says nothing about chances
        return lexicon, lambda features: chance(features).withColumnRenamed("_chance", "_score")
    isotonic = IsotonicRegression(featuresCol="_chance", labelCol="toxic", predictionCol="_calibrated")
    calibration = isotonic.fit(chance(rows.where("calibrates")))

    def score(features: DataFrame) -> DataFrame:
        # A thousandth of the trees' own value keeps order inside the steps of the calibration.
        out = calibration.transform(chance(features))
        return out.withColumn("_score", F.col("_calibrated") * 0.999 + F.col("_chance") * 0.001).drop("_calibrated", "_chance")

    return lexicon, score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``labels``: ``doc_id, toxic``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon, score = fit(keep(training_rows(docs, labels)))
    scored = score(featurize(docs, lexicon).drop("text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; every row is judged by itself."""
    lexicon, score = fit(keep(training_rows(docs, labels)))
    return score(featurize(docs, lexicon)).where(F.col("_score") < threshold).select(*docs.columns)
