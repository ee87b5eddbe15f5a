"""A corpus pipeline of five stages: toxicity, near duplicates, repeated passages, source mix, packed sequences.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``: toxic documents go, one document
of each group of near duplicates stays, repeated bytes go (a document may become empty, but stays), and documents come as
often as the mix takes them. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordweave.llm.common import keep
from coordweave.llm.mixing import mixed_documents
from coordweave.llm.packing import pack_documents
from coordweave.llm.queries import vocabulary
from coordweave.llm.registry import load
from coordweave.llm.run_index import drop_repeats
from coordweave.llm.simhash import drop_near_duplicates
from coordweave.llm.toxicity import drop_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows a changed text."""
    types = dict(docs.dtypes)
    return docs.withColumn("n_chars", F.length("text").cast(types["n_chars"])) if "n_chars" in types else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(drop_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The trained classifier and the seeded mix have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs)
    return docs
