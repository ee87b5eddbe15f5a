"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a hash; a permutation of the blocks, again by a hash, says which of them the
source's quota covers (a quota above the source's size goes through all blocks more than once). A tree of exact
multivariate-hypergeometric draws splits the quotas of all sources among the output shards, so that every shard is a random
sample of the whole mix and the shares add up without rounding. A shard then takes its disjoint run of each source's
permuted draws and shuffles them locally.

Everything is seeded: reruns agree. Sources weigh by their place in code-point order, null last. Targets share the total
size by weight; none exceeds ``most`` times its source, and the excess goes to the others by weight.

Defined results: a null or empty text has size 0 and is never taken; an empty source has target 0; repeated rows count and
are drawn one by one; the last block of a quota is cut, and so is one document at most per source; an empty table gives no
rows. Columns named ``_mix...`` are reserved; all other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1 << 16
DRAWS_PER_SHARD = 128
SPLITS = 6  # levels of the tree that one group of rows goes through at once
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``_mix_source, source_size, target`` from rows of (``source, _mix_size``): one row per source."""
    sources = sized.groupBy(F.col("source").alias("_mix_source")).agg(F.sum("_mix_size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("_mix_source").isNull(), "_mix_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight).withColumn("_top", F.col("source_size") * most)
    # Water-filling: in order of top / weight, a source is full if its share of what is left reaches its top.
    upto = Window.orderBy(F.col("_top") / F.col("_weight"), F.col("_mix_source").isNull(), "_mix_source")
    before, rest = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_top").over(before), F.lit(0))
    leveled = ranked.withColumn("_full", F.col("_top") * F.sum("_weight").over(rest) <= F.col("_weight") * left)
    level = (F.sum("source_size").over(whole) - F.sum(F.when(F.col("_full"), F.col("_top")).otherwise(0)).over(whole)) / F.sum(
        F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))
    ).over(whole)
    target = F.when(F.col("_full"), F.col("_top").cast("double")).otherwise(level * F.col("_weight"))
    return leveled.select("_mix_source", "source_size", target.alias("target"))


def chosen_blocks(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Draws of every source: ``_mix_source, _mix_block, epoch, words`` (words of the block that the draw covers)."""
    blocks = sized.groupBy("_mix_source", "_mix_block").agg(F.sum("_mix_size").alias("words")).where("words > 0")
    order = F.xxhash64(F.lit(seed), F.lit("order"), "_mix_source", "_mix_block")
    blocks = blocks.withColumn("_order", order)
    chunk = F.shiftright("_order", 56)  # a hot source's blocks are summed in 256 parts
    placed = running_sum(blocks, ["_mix_source"], ["_order", "_mix_block"], F.col("words"), chunk, "_start")
    t = targets.select(F.col("_mix_source").alias("_t_source"), "source_size", F.round("target").cast("long").alias("_quota"))
    placed = placed.join(t, F.col("_mix_source").eqNullSafe(F.col("_t_source")))
    times = F.floor((F.col("_quota") - F.col("_start") - 1) / F.col("source_size"))
    drawn = placed.where("_quota > _start").withColumn("epoch", F.explode(F.sequence(F.lit(0), times.cast("int"))))
    left = F.col("_quota") - F.col("epoch") * F.col("source_size") - F.col("_start")
    return drawn.select("_mix_source", "_mix_block", "epoch", F.least("words", left).alias("words"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``_mix_source, shard, _from, _to``: the run of each source's draws that a shard takes, by the splitting tree.

    ``quotas``: ``_mix_source, draws``. A node of the tree holds a range of shards and one count per source; its draws are
    dealt to the two halves of the range by one multivariate-hypergeometric draw, seeded by the range.
    """
    schema = quotas.select(
        F.col("_mix_source"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("draws")
    ).schema

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_mix_source", na_position="last", ignore_index=True)
        done: list[pd.DataFrame] = []

        def part(lo: int, hi: int, first: np.ndarray, draws: np.ndarray, depth: int) -> None:
            if depth == 0 or hi - lo == 1:
                done.append(pd.DataFrame({"_mix_source": rows["_mix_source"], "lo": lo, "hi": hi, "first": first, "draws": draws}))
                return
            middle = (lo + hi) // 2
            total = int(draws.sum())
            taken = total * (middle - lo) // (hi - lo)
            rng = np.random.default_rng([seed, lo, hi])
            # numpy draws from up to 10^9 blocks; far beyond that the exact shares are as good
            left = rng.multivariate_hypergeometric(draws, taken, method="marginals") if total < 10**9 else draws * (middle - lo) // (hi - lo)
            part(lo, middle, first, left, depth - 1)
            part(middle, hi, first + left, draws - left, depth - 1)

        part(int(key[0]), int(key[1]), rows["first"].to_numpy(np.int64), rows["draws"].to_numpy(np.int64), SPLITS)
        return pd.concat(done, ignore_index=True)

    nodes = quotas.select("_mix_source", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.lit(0).cast("long").alias("first"), F.col("draws").cast("long"))
    width = shards
    while width > 1:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(split, schema)
        width = -(-width >> SPLITS)  # rounded up
    return nodes.select("_mix_source", F.col("lo").alias("shard"), F.col("first").alias("_from"), (F.col("first") + F.col("draws")).alias("_to"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``docs`` (``doc_id, text, source`` and more) with ``_mix_size, _mix_source_size, _mix_target, _mix_draws``.

    ``_mix_draws``: one ``(epoch, shard, words)`` for each time the mix takes the document; ``words`` is its size but for the
    one document where a source's quota ends.
    """
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    facts = cut_lineage(sized.select("doc_id", "source", "_mix_size"))
    targets = cut_lineage(source_targets(facts, weights, most))
    counts = targets.select(
        F.col("_mix_source").alias("_t_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
        F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).alias("_mix_blocks"),
    )

    def with_blocks(df: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_mix_size"), F.col("_mix_blocks"))
        joined = df.join(counts, F.col("source").eqNullSafe(F.col("_t_source"))).drop("_t_source")
        return joined.withColumn("_mix_block", block).drop("_mix_blocks")

    in_blocks = with_blocks(facts).withColumn("_mix_source", F.col("source"))
    draws = cut_lineage(chosen_blocks(in_blocks, targets, seed))
    shards = max(1, -(-draws.count() // DRAWS_PER_SHARD))
    shuffled = draws.withColumn("_order", F.xxhash64(F.lit(seed), F.lit("draw"), "_mix_source", "_mix_block", "epoch"))
    numbered = running_sum(
        shuffled, ["_mix_source"], ["_order", "_mix_block", "epoch"], F.lit(1), F.shiftright("_order", 56), "_nth"
    )
    runs = split_quotas(draws.groupBy("_mix_source").agg(F.count("*").alias("draws")), shards, seed).where("_to > _from")
    runs = runs.withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    runs = runs.select(F.col("_mix_source").alias("_r_source"), F.col("_nth").alias("_r_nth"), "shard")
    assigned = numbered.join(runs, F.col("_mix_source").eqNullSafe(F.col("_r_source")) & (F.col("_nth") == F.col("_r_nth")))
    # At most ``most`` draws of a block: the list is as short.
    by_block = assigned.groupBy("_mix_source", "_mix_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "words"))).alias("_mix_of_block"))
    by_block = by_block.select(F.col("_mix_source").alias("_b_source"), F.col("_mix_block").alias("_b_block"), "_mix_of_block")
    rows = with_blocks(sized)
    inside = Window.partitionBy("source", "_mix_block").orderBy(F.xxhash64(F.lit(seed), F.lit("inside"), "doc_id", "_mix_size"), "doc_id", "_mix_size")
    start = F.coalesce(F.sum("_mix_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_mix_start", start)
    joined = rows.join(by_block, F.col("source").eqNullSafe(F.col("_b_source")) & (F.col("_mix_block") == F.col("_b_block")), "left")
    each = F.transform(
        "_mix_of_block",
        lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.least(F.col("_mix_size"), d["words"] - F.col("_mix_start")).alias("words")),
    )
    taken = F.filter(F.coalesce(each, F.array().cast("array<struct<epoch:int,shard:int,words:bigint>>")), lambda d: d["words"] > 0)
    return joined.select(*docs.columns, "_mix_size", "_mix_source_size", "_mix_target", taken.alias("_mix_draws"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document of the mix."""
    mixed = mix(docs.select("doc_id", "text", "source"), **options)
    return mixed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        F.aggregate("_mix_draws", F.lit(0).cast("long"), lambda total, d: total + d["words"]).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` once for each time a document is taken, shard by shard, shuffled inside.

    The document where a source's quota ends keeps the words taken, joined by single blanks.
    """
    names = docs.columns
    draws = mix(docs, **options).withColumn("_mix_draw", F.explode("_mix_draws"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_mix_draw.words") < F.col("_mix_size"), F.array_join(F.slice(words, F.lit(1), F.col("_mix_draw.words").cast("int")), " ")).otherwise(F.col("text"))
    seed = options.get("seed", SEED)
    out = draws.withColumn("text", text).withColumn("_mix_order", F.xxhash64(F.lit(seed), F.lit("local"), "doc_id", "_mix_draw.epoch"))
    out = out.repartition(F.col("_mix_draw.shard")).sortWithinPartitions("_mix_draw.shard", "_mix_order")
    return out.select(*names)
