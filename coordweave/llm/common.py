"""Steps shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder: lost executors cost no recomputation of what led to it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_llm_rid``: the id if it is one, else a number written with the rows."""
    facts = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if facts["n"] == facts["ids"] and dict(docs.dtypes)["doc_id"] in ("bigint", "int"):
        return docs.withColumn("_llm_rid", F.col("doc_id").cast("long"))
    return keep(docs.withColumn("_llm_rid", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable from every node of ``edges`` (``a, b``).

    Alternating large and small stars: every round links the neighbours of a node to the smallest of them, so the number
    of rounds grows with the logarithm of a chain. A node's neighbours are never gathered: a minimum per node is joined
    back, and skewed joins are split.
    """
    state = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        facts = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts == before or facts[0] == 0:
            break
        before = facts
        # Large star: every larger neighbour goes to the smallest node around.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m")).withColumnRenamed("a", "_a")
        large = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
        joined = large.join(least, F.col("a") == F.col("_a"))
        small = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
        state = keep(small.where("a <> b").distinct())
    # Stars now: every edge leads to its component's smallest node.
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
