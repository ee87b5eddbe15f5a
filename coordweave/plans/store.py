"""Parquet stores: one folder per source with the tables of a bundle, and sets of stores read as one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import first_per_key
from ..operators.overlap import LADDER, level_of
from ..operators.search import placed_blocks
from ..sources.lines import Bundle
from .versions import VersionedTable, exists

VERSION = "1"
GRAPH = "placed_block"
PLACE = "place"
TABLES = ("sequence", "edge", "block", "annotation", "mismatch", "warning")
META = (
    "store string, label string, taxon long, organism string, assembly string, species_taxon long, released string, ucsc string, accession string, "
    "aliases map<string,string>, id_namespace string, link string, version string, rungs array<int>, inputs map<string,string>"
)


def _sorted(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    """Range-partitioned and sorted, so that Parquet min / max skip files and row groups outside an interval."""
    split = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return split.sortWithinPartitions(*by)


def write_store(bundle: Bundle, path: str, spark: SparkSession, overwrite: bool = False, partitions: int | None = None, **meta) -> None:
    """Write a bundle and its metadata. An existing store is refused unless ``overwrite``."""
    mode = "overwrite" if overwrite else "errorifexists"
    parts = {
        "sequence": bundle.sequences, "edge": bundle.edges, "block": bundle.blocks, "annotation": bundle.annotations,
        "mismatch": bundle.mismatches, "warning": bundle.warnings,
    }
    order = {"block": ["src_ref", "src"], "mismatch": ["ref", "pos"]}
    for name, df in parts.items():
        if df is not None:
            (_sorted(df, order[name], partitions) if name in order else df).write.mode(mode).parquet(f"{path}/{name}")
    rungs: list[int] = []
    if bundle.blocks is not None:
        # Bin widths in use, at most one row per rung; later joins need not measure again.
        levels = spark.read.parquet(f"{path}/block").select(level_of(F.lit(0), F.col("len"), LADDER).alias("r")).distinct()
        rungs = sorted(row.r for row in levels.limit(len(LADDER)).collect())
        if bundle.edges is not None:
            # What a search reads: made once with the store, so that sessions write nothing.
            placed = placed_blocks(spark.read.parquet(f"{path}/block"), spark.read.parquet(f"{path}/edge"))
            _sorted(placed, ["bucket", "src_ref", "src"], partitions).write.mode(mode).partitionBy("bucket").parquet(f"{path}/{GRAPH}")
    _write_meta(spark, path, mode, {"rungs": rungs, **meta})


def _write_meta(spark: SparkSession, path: str, mode: str, meta: dict) -> None:
    row = {"version": VERSION, **meta}
    names = [c.split()[0] for c in META.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], META).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def _row_digest(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("annotation_ix", "warning_ix")])))


#: Tables of a store that grows: how rows merge, and the key that orders their ranges (what lies together on a sequence first).
GROWING = {
    "sequence": ("fill", lambda df: F.col("ref")),
    "edge": ("keep", lambda df: F.concat_ws("|", "from_ref", "edge_key")),
    "block": ("keep", lambda df: F.concat_ws("|", "src_ref", "edge_key")),
    "annotation": ("keep", lambda df: F.concat_ws("|", "location", _row_digest(df))),
    "mismatch": ("keep", lambda df: F.concat_ws("|", "ref", "edge_key")),
    "warning": ("keep", _row_digest),
}


def upsert_store(bundle: Bundle, path: str, spark: SparkSession, range_rows: int | None = None, **meta) -> dict[str, int]:
    """Merge a bundle into the store at ``path`` (a new one, if there is none); the version of every table.

    Fields of sequences that are missing are filled, known ones stay; edges, blocks, annotations and mismatches that are
    there stay, new ones are added. Only key ranges that change are written; what is there already changes nothing. The
    metadata of the first bundle stays. Searches place the blocks of such a store themselves.
    """
    if exists(spark, f"{path}/meta") and any(exists(spark, f"{path}/{n}") and not exists(spark, f"{path}/{n}/manifest") for n in TABLES):
        raise ValueError(f"{path} was written as a whole; only stores made by upsert_store grow")
    parts = {
        "sequence": bundle.sequences, "edge": bundle.edges, "block": bundle.blocks, "annotation": bundle.annotations,
        "mismatch": bundle.mismatches, "warning": bundle.warnings,
    }
    versions = {}
    for name, df in parts.items():
        if df is not None:
            mode, key = GROWING[name]
            table = VersionedTable(spark, f"{path}/{name}", PLACE, mode, **({"range_rows": range_rows} if range_rows else {}))
            versions[name] = table.upsert(df.withColumn(PLACE, F.coalesce(key(df), F.lit(""))))
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        _write_meta(spark, path, "overwrite", {"rungs": [], **meta})
    return versions


def input_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """MD5 of every input file, computed where the file is read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.md5("content").alias("md5"), "length")


class StoreSet:
    """Stores in order of precedence; each table carries ``store_ord``. Absent tables are None."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths
        metas = [spark.read.parquet(f"{p}/meta").withColumn("store_ord", F.lit(i)) for i, p in enumerate(paths)]
        self.meta = _union(metas)
        found = {(r.version,) for r in self.meta.select("version").distinct().collect()}
        if found != {(VERSION,)}:
            raise ValueError(f"store versions {sorted(v for v, in found)}; this reader accepts {VERSION}")

    def graph(self) -> DataFrame | None:
        """The placed blocks of all stores; None if a store with blocks was written without them."""
        blocks, placed = self._held("block"), self._held(GRAPH)
        return _union([self.spark.read.parquet(f"{p}/{GRAPH}").withColumn("store_ord", F.lit(i)) for i, p in placed]) if placed and placed == blocks else None

    def _held(self, name: str) -> list[tuple[int, str]]:
        """(order, path) of the stores that have a table."""
        return [(i, p) for i, p in enumerate(self.paths) if exists(self.spark, f"{p}/{name}")]

    def table(self, name: str) -> DataFrame | None:
        read = [(i, self._read(f"{path}/{name}")) for i, path in self._held(name)]
        parts = [df.withColumn("store_ord", F.lit(i)) for i, df in read if df is not None]
        return _union(parts) if parts else None

    def _read(self, path: str) -> DataFrame | None:
        if not exists(self.spark, f"{path}/manifest"):
            return self.spark.read.parquet(path)
        grown = VersionedTable(self.spark, path, PLACE).read()
        return None if grown is None else grown.drop(PLACE)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def annotation_ids(annotations: DataFrame, meta: DataFrame) -> DataFrame:
    """``id_namespace, id`` -> annotation: the first annotation of an ID in a store wins, then the first store."""
    ids = annotations.join(meta.where("id_namespace IS NOT NULL").select("store_ord", F.lower("id_namespace").alias("id_namespace"), "link"), "store_ord")
    ids = ids.withColumn("id", F.get(F.try_element_at("attributes", F.lit("ID")), F.lit(0))).where("id IS NOT NULL")
    kept = first_per_key(ids.select("id_namespace", "id", "store_ord", "annotation_ix", "type", "location", "link"), ["id_namespace", "id"], ["store_ord", "annotation_ix"])
    # Percent-encode as in a URL path: a space is %20.
    encoded = F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20"))
    return kept.withColumn("link", F.replace("link", F.lit("{id}"), encoded)).drop("annotation_ix")


def summary(sequences: DataFrame, edges: DataFrame, blocks: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Long form counts: ``what, name, n`` for molecule types, edge kinds, taxa, blocks and annotations."""
    count = lambda df, what, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    out = count(sequences, "moltype", F.coalesce("moltype", F.lit("unknown")))
    out = out.unionByName(count(edges, "kind", F.col("kind"))).unionByName(count(sequences.where("taxon IS NOT NULL"), "taxon", F.col("taxon").cast("string")))
    out = out.unionByName(count(blocks, "blocks", F.lit("all")))
    return out.unionByName(count(annotations, "annotations", F.lit("all"))) if annotations is not None else out


def write_json(bundle: Bundle, path: str) -> None:
    """JSON Lines, one folder per record type."""
    for name, df in (("sequence", bundle.sequences), ("edge", bundle.edges), ("annotation", bundle.annotations), ("warning", bundle.warnings)):
        if df is not None:
            df.withColumn("record", F.lit(name)).write.mode("errorifexists").json(f"{path}/{name}")


def describe_meta(row) -> str:
    return json.dumps(row.asDict(recursive=True), default=str)
