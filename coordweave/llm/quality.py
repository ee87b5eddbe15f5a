"""Quality rules: a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Words and word pairs fall into ``BUCKETS`` hash buckets. One multinomial is counted over all documents, one over all trusted
ones; a document's score is the mean, over its words and pairs, of the log ratio of the two. A document
is kept if it passes the base rules and its score reaches a fixed threshold. Only DataFrame functions are used.

Buckets with too few trusted occurrences to judge count as neutral: ``SMOOTHING`` occurrences are added to both sides.

Defined results: a null, empty or blank text has no words, so it fails the base rules (score 0); lines without a word are
never repeated lines; repeated rows are judged one by one; without trusted rows every ratio is neutral; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 1 << 18  # the table of ratios is broadcast: 2^18 rows of (int, float) at most, whatever the corpus
SMOOTHING = 20.0
THRESHOLD = -0.05
MIN_WORDS = 50


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def repeated_window_words(words: Column, windows: Column) -> Column:
    """Words covered by windows (three words, as hashes in order) that occur twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(x: Column, i: Column, seen: Column) -> Column:
        before = F.get(seen, i - 1)["h"]
        after = F.get(seen, i + 1)["h"]
        return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

    # One-element arrays bind a step's result to a name, so that it is computed once.
    places = F.transform(
        F.array(ordered), lambda seen: F.array_sort(F.transform(F.filter(seen, lambda x, i: repeats(x, i, seen)), lambda x: x["i"]))
    )
    covered = F.transform(
        places,
        lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, n: a + n
        ),
    )
    return F.get(covered, F.lit(0))


def base_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, _words`` and the base figures of every document."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    words = text.select("doc_id", "_text", split_words(F.col("_text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = words.select(
        "doc_id", "_words", F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"),
        F.when(
            F.size("_words") > 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
        ).alias("_windows"),
    )
    repeated = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_window_words(F.col("_words"), F.col("_windows")))
    out = hashed.select(
        "doc_id", "_words", "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def features(words: DataFrame, keep: list[str]) -> DataFrame:
    """One row per word and per pair of neighbours: ``keep`` and ``bucket``. Rows without words keep one null bucket."""
    pairs = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1))).alias("b"))
    rows = words.select(*keep, F.explode_outer(pairs).alias("_p")).select(*keep, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))
    word = F.when(F.col("_a").isNotNull(), F.pmod(F.xxhash64("_a"), F.lit(BUCKETS)).cast("int"))
    pair = F.when(F.col("_b").isNotNull(), F.pmod(F.xxhash64("_a", "_b"), F.lit(BUCKETS)).cast("int"))
    return rows.select(*keep, F.explode(F.array(word, pair)).alias("bucket"))


def bucket_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``_bucket, _ratio``: log of the trusted over the raw rate of each bucket. At most ``BUCKETS`` rows.

    ``trusted``: ``doc_id`` of trusted documents, as many as there are; they meet the texts by a shuffle.
    """
    marks = trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_trusted")).distinct().hint("shuffle_hash")
    # Whole texts are smaller than their words, and a hash table of ids spares sorting them.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    met = texts.join(marks, F.col("doc_id") == F.col("_id"), "left")
    marked = met.select(F.coalesce("_trusted", F.lit(False)).alias("_trusted"), split_words(F.col("_text")).alias("_words"))
    counts = features(marked, ["_trusted"]).where("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count("*").alias("_raw"), F.sum(F.col("_trusted").cast("long")).alias("_of_trusted")
    )
    totals = counts.agg(F.sum("_raw").alias("_all_raw"), F.sum("_of_trusted").alias("_all_trusted"))
    expected = F.col("_raw") * F.col("_all_trusted") / F.col("_all_raw")
    ratio = F.log((F.col("_of_trusted") + SMOOTHING) / (expected + SMOOTHING))
    # The totals are one row.
    return counts.join(F.broadcast(totals)).select(F.col("bucket").alias("_bucket"), ratio.cast("float").alias("_ratio"))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Documents labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base figures, ``score`` and ``kept`` for every document (``doc_id, text``); ``labels``: ``doc_id, quality``."""
    docs = docs.select("doc_id", "text")
    ratios = F.broadcast(bucket_ratios(docs, trusted_documents(labels)))
    figures = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = base_columns(docs).withColumn("_row", F.monotonically_increasing_id())
    scored = features(base, figures).join(ratios, F.col("bucket") == F.col("_bucket"), "left")
    mean = F.coalesce(F.sum("_ratio") / F.count("bucket"), F.lit(0.0))
    # All rows of a document come from one task and meet before the shuffle.
    out = scored.groupBy(*figures).agg(mean.alias("score"))
    return out.select(*figures[1:], F.round("score", 9).alias("score")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
