"""Coordinates derived from the star-schema tables: orders are features, their line items exons, suppliers the axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sum

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items laid end to end along their order: ``f, t, src, len, tgt, rev`` and the line's flags."""
    items = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("f"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_returnflag") == "R").alias("rev"),
        "l_returnflag", "l_linestatus", *LINE_ORDER,
    )
    # A hot order is split by (line number, part range): both lead the order of the sum.
    chunk = F.struct("l_linenumber", F.shiftright("l_partkey", 20).alias("part"))
    laid = running_sum(items, ["f"], LINE_ORDER, F.col("len"), chunk, "src", few=["f"])
    # What follows from a column is added behind the shuffle.
    return laid.select(
        "f", F.col("l_suppkey").alias("t"), "len", (F.col("l_partkey") * 20).alias("tgt"), "rev", "l_returnflag", "l_linestatus", *LINE_ORDER, "src"
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order axis -> supplier axis, one block per line item. ``ix`` is unique and grows along an order."""
    return layout(spark, sf_dir).select(
        F.col("f").alias("edge_key"), F.struct("f", "src").alias("ix"), F.col("f").alias("src_ref"),
        "src", F.col("t").alias("tgt_ref"), "tgt", "len", "rev",
    )


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a multi-segment location on the supplier axes, in long form."""
    return layout(spark, sf_dir).select(
        F.col("f").alias("query_id"), F.lit("join").alias("kind"), F.col("src").alias("seg_ix"), F.col("t").alias("ref"),
        F.col("tgt").alias("start"), (F.col("tgt") + F.col("len")).alias("end"),
        F.when(F.col("rev"), -1).otherwise(1).alias("strand"), (F.col("len") % 7 == 0).alias("fuzzy_low"),
        (F.col("len") % 5 == 0).alias("fuzzy_high"), (F.col("len") % 11 == 0).alias("uncertain"), F.lit(0).alias("run"),
    )


def part_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around every part a supplier sold: one window per (supplier, part), minus where any such line is finished."""
    sold = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_linestatus") == "F").alias("minus"))
    at = F.col("l_partkey") * 20
    return sold.select(
        F.concat_ws(":", "l_suppkey", "l_partkey").alias("query_id"), F.lit("join").alias("kind"),
        F.lit(0).cast("long").alias("seg_ix"), F.col("l_suppkey").alias("ref"),
        F.greatest(at - 30, F.lit(0)).alias("start"), (at + 60).alias("end"),
        F.when(F.col("minus"), -1).otherwise(1).alias("strand"), F.lit(False).alias("fuzzy_low"),
        F.lit(True).alias("fuzzy_high"), F.lit(False).alias("uncertain"), F.lit(0).alias("run"),
    )


def seconds(column: str):
    """Whole seconds since 2024-01-01 of a timestamp, independent of the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nucleotide sequences, one base per character: ASCII letters folded onto A, C, G, T, all others A."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", "-"))
    folded = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", "ACGTACGTACGTACGTACGTACGTACA")
    return load(spark, sf_dir, "documents").select(F.col("doc_id"), folded.alias("residues"))
