"""Phrase collocations by counting quotient filters.

Texts become shards: numbers of words in a shard's own dictionary. The dictionaries are counted together, and every shard
gets back the numbers of its frequent words. Then level by level, for two to four words: a shard packs the number of a
frequent phrase and of the word that follows it into one integer, counts those integers in a counting quotient filter, and
cuts the filter into ranges; a task merges one range of all shards, numbers the phrases that are frequent in all, and tells
every shard which of its entries they are. A phrase can only be frequent if both phrases that lack its first or its last word
are, so a level looks only at places that passed the one before. No dictionary or filter of the whole corpus is ever in one
place, and nothing is broadcast by hand.

A phrase's score is that of its weakest cut, in exact decimals. A phrase goes if a longer one that holds it is nearly as
frequent. Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count once each; an
empty table gives no rows; other columns are ignored. Numbers of words and of phrases of a level must fit 32 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import keep

LONGEST = 4
SHARD_TOKENS = 2_000_000
RANGE_ENTRIES = 1_000_000  # entries of all shards that a merging task gets, about
# What ends a piece of text, and what stands between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TABLE = bytes.maketrans(ENDS + BLANKS, b"\n" * len(ENDS) + b" " * len(BLANKS))
_BLANK, _END = 0, 1  # numbers of what is no word


def packed(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(arrays, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shards_of(docs: DataFrame) -> DataFrame:
    """``shard, lang, data, words, counts``: the texts of a language in numbers of the shard's own dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId() << 24, 0, 0
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, (numbers, arrays) in open_.items():
                tokens = np.concatenate(arrays)
                counts = np.bincount(tokens, minlength=len(numbers))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part + made], pa.int64()), pa.array([lang], pa.string()), pa.array([packed(tokens[tokens != _BLANK])], pa.binary()),
                        pa.array([list(numbers)[2:]], pa.list_(pa.binary())), pa.array([counts[2:]], pa.list_(pa.int64())),
                    ],
                    names=["shard", "lang", "data", "words", "counts"],
                )
                made += 1
            open_.clear()
            held = 0

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, lang in enumerate(langs):
                text = texts[i].as_py().lower().translate(_TABLE)  # bytes: only A-Z change
                if lang not in open_:
                    open_[lang] = (_Numbers({b"": _BLANK, b"\n": _END}), [])
                numbers, arrays = open_[lang]
                words = text.replace(b"\n", b" \n ").split(b" ")
                words.append(b"\n")
                arrays.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                held += len(words)
                if held >= SHARD_TOKENS:
                    yield from flush()
        yield from flush()

    texts = docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    return texts.mapInArrow(run, "shard long, lang string, data binary, words array<binary>, counts array<long>")


def dense(df: DataFrame, name: str) -> DataFrame:
    """``df`` with numbers 0, 1, ... in ``name``."""
    marked = keep(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    joined = marked.join(starts, part == F.col("_part"))
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def _adjacent(places: np.ndarray) -> np.ndarray:
    """For every place, whether the next one follows it at once."""
    return np.append(places[1:] == places[:-1] + 1, False).astype(np.uint32)


def first_level(shards: DataFrame, known: DataFrame) -> DataFrame:
    """``shard, data, pairs``: numbers of frequent words, the last word's number, and whether the next place is the next word.

    ``known``: ``shard, found`` (array of ``ix, id``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                (tokens,) = unpacked(batch.column("data")[i].as_py(), 1)
                found = batch.column("found")[i].values
                ids = np.full(int(tokens.max(initial=1)) + 1, -1, np.int64)
                ids[found.field("ix").to_numpy() + 2] = found.field("id").to_numpy()
                numbers = ids[tokens]
                places = np.flatnonzero(numbers >= 0)
                follows = _adjacent(places)
                out.append((batch.column("shard")[i].as_py(), packed(numbers[places], numbers[places], follows), int(follows.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["shard", "data", "pairs"])

    return shards.select("shard", "data").join(known, "shard").mapInArrow(run, "shard long, data binary, pairs long")


def _candidates(data: bytes, word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places with a phrase and the next word, their packed numbers, which of those are distinct, and who has which."""
    phrase, last, follows = unpacked(data, 3)
    places = np.flatnonzero(follows)
    keys = (phrase[places].astype(np.uint64) << np.uint64(word_bits)) | last[places + 1]
    return places, last, keys, follows


def filters_of(level: DataFrame, word_bits: int, bits: int, range_bits: int) -> DataFrame:
    """``shard, part, filter``: the counting quotient filter of a shard's candidates, cut into 2^range_bits ranges."""
    rest = bits - range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = _candidates(batch.column("data")[i].as_py(), word_bits)[2]
                values, counts = np.unique(qf.permute(keys, bits), return_counts=True)
                ranges = (values >> np.uint64(rest)).astype(np.int64)
                parts, starts = np.unique(ranges, return_index=True)
                stops = np.append(starts[1:], len(values))
                low = values & np.uint64((1 << rest) - 1)
                data = [qf.encode(low[a:b], counts[a:b], rest) for a, b in zip(starts, stops, strict=True)]
                shard = batch.column("shard")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array(data, pa.binary())], names=["shard", "part", "filter"])

    return level.mapInArrow(run, "shard long, part long, filter binary")


def merged_ranges(filters: DataFrame, word_bits: int, bits: int, range_bits: int, least: int) -> DataFrame:
    """One row per range: ``part, n, phrase, word, f`` of the frequent candidates, and ``asked``: who has which of them.

    ``asked`` holds per shard a bit for each entry of its filter, and the places of the frequent ones in the range.
    """
    rest = bits - range_bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shards, filters = table.column("shard").to_pylist(), table.column("filter").to_pylist()
        values, counts, place = qf.merge(filters)
        frequent = counts >= least
        rank = np.cumsum(frequent) - 1
        keys = qf.restore(values[frequent] | np.uint64(key[0].as_py() << rest), bits)
        asked, at = [], 0
        for shard, one in zip(shards, filters, strict=True):
            own = place[at : at + qf.decode(one)[0].size]
            at += len(own)
            hit = frequent[own]
            asked.append({"shard": shard, "hit": np.packbits(hit).tobytes(), "rank": rank[own[hit]].astype("<u4").tobytes()})
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(frequent.sum())], pa.int64()),
            "phrase": pa.array([(keys >> np.uint64(word_bits)).astype(np.int64)], pa.list_(pa.int64())),
            "word": pa.array([(keys & np.uint64((1 << word_bits) - 1)).astype(np.int64)], pa.list_(pa.int64())),
            "f": pa.array([counts[frequent]], pa.list_(pa.int64())),
            "asked": pa.array([asked], pa.list_(pa.struct([("shard", pa.int64()), ("hit", pa.binary()), ("rank", pa.binary())]))),
        })

    schema = "part long, n long, phrase array<long>, word array<long>, f array<long>, asked array<struct<shard:long,hit:binary,rank:binary>>"
    return filters.groupBy("part").applyInArrow(run, schema)


def next_level(level: DataFrame, answers: DataFrame, word_bits: int, bits: int) -> DataFrame:
    """The level above: places of frequent longer phrases. ``answers``: ``shard, found`` (array of ``part, start, hit, rank``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                places, last, keys, _ = _candidates(batch.column("data")[i].as_py(), word_bits)
                values, whose = np.unique(qf.permute(keys, bits), return_inverse=True)
                hit, ids = [], []
                bounds = {}
                for answer in batch.column("found")[i].as_py():
                    bounds[answer["part"]] = answer
                ranges = (values >> np.uint64(bits - batch.column("range_bits")[i].as_py())).astype(np.int64)
                for part, n in zip(*np.unique(ranges, return_counts=True), strict=True):
                    answer = bounds[int(part)]
                    hit.append(np.unpackbits(np.frombuffer(answer["hit"], np.uint8), count=int(n)).astype(bool))
                    ids.append(np.frombuffer(answer["rank"], "<u4").astype(np.int64) + answer["start"])
                number = np.full(len(values), -1, np.int64)
                number[np.concatenate(hit)] = np.concatenate(ids)
                numbers = number[whose]
                good = numbers >= 0
                follows = _adjacent(places[good])
                out.append((batch.column("shard")[i].as_py(), packed(numbers[good], last[places[good] + 1], follows), int(follows.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["shard", "data", "pairs"])

    return level.select("shard", "data").join(answers, "shard").mapInArrow(run, "shard long, data binary, pairs long")


def _bits(n: int) -> int:
    bits = max(1, (n - 1).bit_length())
    if bits > 32:
        raise ValueError(f"{n} frequent words or phrases of one length: more than 32 bits can number")
    return bits


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` of every phrase of up to four words found ``least`` times or more, and ``lang, n``: all words."""
    shards = keep(shards_of(docs))
    listed = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("ix", "w"))
    counted = listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = keep(dense(counted.where(F.col("f") >= least), "id"))
    number = words.select(F.col("lang").alias("_lang"), F.col("word").alias("_word"), F.col("id").alias("_id"))
    known = listed.join(number, (F.col("lang") == F.col("_lang")) & (F.col("w.words") == F.col("_word")))
    known = known.groupBy("shard").agg(F.collect_list(F.struct("ix", F.col("_id").alias("id"))).alias("found"))
    level = keep(first_level(shards, known))
    word_bits = _bits(words.count())
    text = words.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("word").cast("string").alias("_word"))
    phrases = words.select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), "f")
    found, before = [phrases], 1 << word_bits
    for _ in range(2, LONGEST + 1):
        pairs = level.where("pairs > 0")
        entries = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).first()["n"]
        if not entries:
            break
        bits = _bits(before) + word_bits
        range_bits = min(bits - 1, max(5, (entries // RANGE_ENTRIES).bit_length()))
        merged = keep(merged_ranges(filters_of(pairs.select("shard", "data"), word_bits, bits, range_bits), word_bits, bits, range_bits, least))
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        starts = merged.select(F.col("part").alias("_part"), "n").select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        placed = merged.join(starts, F.col("part") == F.col("_part"))
        answers = placed.select("part", "start", F.explode("asked").alias("a")).groupBy("a.shard").agg(
            F.collect_list(F.struct("part", "start", F.col("a.hit").alias("hit"), F.col("a.rank").alias("rank"))).alias("found")
        ).withColumn("range_bits", F.lit(range_bits))
        level = keep(next_level(pairs, answers, word_bits, bits))
        grams = placed.select("start", F.posexplode(F.arrays_zip("phrase", "word", "f")).alias("ix", "g"))
        grams = grams.select((F.col("start") + F.col("ix")).alias("id"), F.col("g.phrase").alias("_phrase"), F.col("g.word").alias("_last"), F.col("g.f").alias("f"))
        shorter = phrases.select(F.col("id").alias("_pid"), "lang", F.col("words").alias("_words"))
        phrases = grams.join(shorter, F.col("_phrase") == F.col("_pid")).join(text.select("_id", "_word"), F.col("_last") == F.col("_id"))
        phrases = keep(phrases.select("id", "lang", F.concat("_words", F.array("_word")).alias("words"), "f"))
        found.append(phrases)
        before = merged.agg(F.sum("n").alias("n")).first()["n"]
        if not before:
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.select("lang", "words", "f"), total


def mine_phrases(docs: DataFrame, least: int = 30, absorbed: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of every language.

    ``docs``: ``text, lang``. A phrase goes if a longer one has at least ``absorbed`` hundredths of its count.
    """
    found, total = frequent_phrases(docs, least)
    found = keep(found)
    spoken = lambda words: F.array_join(words, " ")
    wide = lambda c: c.cast("decimal(20,0)")
    candidates = found.where("size(words) > 1").select("lang", "words", spoken(F.col("words")).alias("phrase"), F.col("f").alias("a"))
    counts = found.select(F.col("lang").alias("_lang"), spoken(F.col("words")).alias("_text"), F.col("f").alias("_f"))

    def looked_up(df: DataFrame, text: Column, name: str) -> DataFrame:
        of = counts.select("_lang", "_text", F.col("_f").alias(name))
        return df.join(of, (F.col("lang") == F.col("_lang")) & (text == F.col("_text"))).drop("_lang", "_text")

    cuts = candidates.select("lang", "words", "phrase", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = looked_up(cuts, spoken(F.expr("slice(words, 1, k)")), "l")
    cuts = looked_up(cuts, spoken(F.expr("slice(words, k + 1, size(words) - k)")), "r")
    cuts = cuts.withColumn("_a", wide(F.col("a")) * F.lit(scale)).withColumn("_lr", wide(F.col("l")) + wide(F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("_a div _lr").alias("score"), "k", "a", "l", "r")).alias("c"))
    # The most frequent longer phrase around every phrase.
    inner = "filter(flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n)))), w -> size(w) > 1)"
    around = candidates.where("size(words) > 2").select(F.col("lang").alias("_lang"), F.explode(F.expr(inner)).alias("_w"), F.col("a").alias("_f"))
    around = around.groupBy("_lang", spoken(F.col("_w")).alias("_text")).agg(F.max("_f").alias("_longer"))
    left = scored.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_text")), "left")
    left = left.where(F.col("_longer").isNull() | (wide(F.col("_longer")) * 100 < wide(F.col("c.a")) * absorbed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "c.score", "c.a", "c.l", "c.r").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = total.select(F.col("lang").alias("_lang"), "n")
    out = ranked.join(sums, F.col("lang") == F.col("_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases_sql(least: int = 30, absorbed: int = 80, top: int = 2000, scale: int = 2_000_000) -> str:
    """DuckDB SQL for the same rows."""
    sizes = " UNION ALL ".join(
        f"SELECT lang, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n} + 2)]) AS phrase, {n} AS size FROM p WHERE len(w) >= {n}" for n in range(1, LONGEST + 1)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, unnest([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, size - {n} + 2)]) AS phrase, a FROM c WHERE size > {n}" for n in range(2, LONGEST)
    )
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
g AS ({sizes}),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {least}),
places AS (SELECT *, unnest(range(1, size)) AS k FROM c),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM places),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * {scale} // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS longer FROM ({inner}) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase
  WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {absorbed}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {top}"""
