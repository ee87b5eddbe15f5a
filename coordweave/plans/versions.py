"""Tables that grow by merging: versioned folders of key ranges under a manifest.

A table is cut into ranges of its key. Every version writes only the ranges that an update changes, into folders of its own, and
then one small manifest of all ranges (first key, folder, rows); readers follow the newest manifest, so a run that is lost
before it leaves the table as it was. One writer at a time.

``fill`` tables hold one row per key: a known value stays, a missing one is filled, new keys are added. ``keep`` tables hold
any number of rows per key: keys that are there stay as they are, new keys come with all their rows.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dims import first_per_key

MANIFEST = "low string, folder string, rows long, columns string"
RANGE_ROWS = 4_000_000


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _hadoop(spark, path)
    return files.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    at, files = _hadoop(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


class VersionedTable:
    """A table under ``path``. The manifest has a row per range: one for every ``RANGE_ROWS`` rows, about."""

    def __init__(self, spark: SparkSession, path: str, key: str, mode: str = "fill", range_rows: int = RANGE_ROWS):
        if mode not in ("fill", "keep"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.path, self.key, self.mode, self.range_rows = spark, path, key, mode, range_rows

    def version(self) -> int:
        """The newest version; 0 for a table that was never written."""
        names = [n for n in listed(self.spark, f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return max((int(n.split("=")[1]) for n in names), default=0)

    def ranges(self, version: int | None = None) -> list:
        """Rows of a version's manifest, by first key."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}")
        return rows.orderBy("low").collect()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version (the newest one); None before the first."""
        ranges = self.ranges(version)
        return self._rows(ranges, _schema(ranges)) if ranges else None

    def _rows(self, ranges: list, schema: StructType) -> DataFrame:
        if not ranges:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{r.folder}" for r in ranges])

    def _range_of(self, lows: list[str]) -> Column:
        """The last range whose first key is not above a row's key; looked up in groups of about the square root of all."""
        width = math.isqrt(len(lows)) + 1
        groups = [lows[k : k + width] for k in range(0, len(lows), width)]
        key = F.col(self.key)
        not_above = lambda values: F.size(F.filter(values, lambda low: low <= key))
        heads = F.array(*[F.lit(g[0]) for g in groups])
        table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        group = F.greatest(not_above(heads) - 1, F.lit(0))
        return group * width + F.greatest(not_above(F.get(table, group)) - 1, F.lit(0))

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Merge ``rows``; the version that holds them. Nothing is written if they change nothing.

        Several rows of a key in a ``fill`` table: the first one in ``order`` counts (the smallest row, without). Rows
        without a key are refused. Columns must be those of the table; both sides are read twice, once to find the ranges.
        """
        before = self.version()
        held_ranges = self.ranges(before)
        if rows.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"rows without {self.key}")
        if self.mode == "fill":
            rest = [c for c, t in rows.dtypes if c != self.key and "map<" not in t]  # maps have no order
            rows = first_per_key(rows, [self.key], order or rest)
        if not held_ranges:
            return self._write(rows.withColumn("_range", F.lit(0)), [], {0: ""}, before, rows.count())
        schema = _schema(held_ranges)
        if sorted(rows.columns) != sorted(schema.names):
            raise ValueError(f"columns {sorted(rows.columns)} are not those of the table, {sorted(schema.names)}")
        lows = [r.low for r in held_ranges]
        placed = rows.select(schema.names).withColumn("_range", self._range_of(lows))
        touched = sorted(r[0] for r in placed.select("_range").distinct().collect())
        met = self._rows([held_ranges[k] for k in touched], schema)
        changed = sorted(r[0] for r in self._news(placed, met, schema).select("_range").distinct().collect())
        if not changed:
            return before
        held = self._rows([held_ranges[k] for k in changed], schema).withColumn("_range", self._range_of(lows))
        news = placed.where(F.col("_range").isin(changed))
        most = sum(held_ranges[k].rows for k in changed) + news.count()
        others = [r for k, r in enumerate(held_ranges) if k not in set(changed)]
        return self._write(self._merged(news, held, schema), others, {k: lows[k] for k in changed}, before, most)

    def _news(self, placed: DataFrame, held: DataFrame, schema: StructType) -> DataFrame:
        """Rows that would change the table."""
        if self.mode == "keep":
            return placed.join(held.select(self.key).distinct(), self.key, "left_anti")
        values = [c for c in schema.names if c != self.key]
        known = held.select(self.key, *[F.col(c).isNotNull().alias(f"_has_{c}") for c in values], F.lit(True).alias("_there"))
        fills = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~F.col(f"_has_{c}") for c in values], F.lit(False))
        return placed.join(known, self.key, "left").where(F.col("_there").isNull() | fills)

    def _merged(self, placed: DataFrame, held: DataFrame, schema: StructType) -> DataFrame:
        if self.mode == "keep":
            return held.unionByName(placed.join(held.select(self.key).distinct(), self.key, "left_anti"))
        values = [c for c in [*schema.names, "_range"] if c != self.key]
        new = placed.select(self.key, *[F.col(c).alias(f"_new_{c}") for c in values])
        return held.join(new, self.key, "full").select(self.key, *[F.coalesce(c, f"_new_{c}").alias(c) for c in values])

    def _write(self, rows: DataFrame, others: list, lows: dict[int, str], before: int, most: int) -> int:
        """Write ``rows``, ``most`` at most, by ``_range``, splitting ranges that have grown; then a manifest with ``others``."""
        if not most:
            return before
        version = before + 1
        data = f"data/version={version}"
        names = [c for c in rows.columns if c != "_range"]
        parts = max(len(lows), -(-most // self.range_rows))
        # Ranges come first in the order, so a part of one folder never reaches into another.
        sorted_rows = rows.repartitionByRange(parts, "_range", self.key).sortWithinPartitions("_range", self.key)
        sorted_rows.withColumn("_part", F.spark_partition_id()).write.mode("overwrite").partitionBy("_range", "_part").parquet(f"{self.path}/{data}")
        written = self.spark.read.parquet(f"{self.path}/{data}")
        found = written.groupBy("_range", "_part").agg(F.min(self.key).alias("low"), F.count("*").alias("rows")).orderBy("_range", "low").collect()
        columns = rows.select(names).schema.json()
        manifest = [(r.low, r.folder, r.rows, columns) for r in others]
        seen: set[int] = set()
        for r in found:
            # The first part of a range starts where the range did, so that no key falls between two.
            manifest.append((r.low if r["_range"] in seen else lows[r["_range"]], f"{data}/_range={r['_range']}/_part={r['_part']}", r["rows"], columns))
            seen.add(r["_range"])
        # The manifest comes last: from here on readers see the version.
        self.spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version


def _schema(ranges: list) -> StructType:
    return StructType.fromJson(json.loads(ranges[0].columns))
