"""Conversion of a stream of locations against a static block table: stateless, so no watermark and no state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.location import parse_locations
from ..functions.namespaces import Registry
from ..operators.convert import map_locations


def convert_stream(texts: DataFrame, blocks: DataFrame, path: str, checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Write ``query_id, id, orientation`` of every text (``query_id, text``) to Parquet, one batch at a time.

    Each micro-batch is a bounded DataFrame, so the ordinary batch operators apply unchanged. A batch is written to its
    own folder, which makes a repeated batch overwrite itself instead of adding rows twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        targets, _ = map_locations(parse_locations(df, registry=registry), blocks, registry=registry)
        targets.select("query_id", "id", "orientation").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
