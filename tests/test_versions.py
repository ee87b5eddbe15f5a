"""Stores that grow: ranges rewritten only where they change, known values kept."""

import pytest
from coordweave.plans.store import StoreSet, upsert_store, write_store
from coordweave.plans.versions import VersionedTable
from coordweave.sources.lines import Bundle
from pyspark.sql import functions as F

ROW = "ref string, taxon long, gene string"


def sequences(spark, numbers, gene=None, taxon=None):
    return spark.createDataFrame([(f"r:{n:05d}", taxon, gene) for n in numbers], ROW)


def plain(table):
    return sorted(map(tuple, table.read().select("ref", "taxon", "gene").collect()), key=str)


def test_half_a_file_rewrites_half_and_a_rerun_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "ref", range_rows=100)
    assert table.read() is None and table.upsert(sequences(spark, [])) == 0
    assert table.upsert(sequences(spark, range(1000), taxon=9606)) == 1
    first = table.ranges()
    assert len(first) >= 8 and first[0].low == "" and sum(r.rows for r in first) == 1000
    # Nothing new: the same rows, and other values for what is known.
    assert table.upsert(sequences(spark, range(1000), taxon=9606)) == 1
    assert table.upsert(sequences(spark, range(1000), taxon=1)) == 1
    # Genes for the second half only.
    assert table.upsert(sequences(spark, range(500, 1000), gene="g", taxon=1)) == 2
    kept = {r.folder for r in first} & {r.folder for r in table.ranges()}
    assert abs(len(kept) - len(first) / 2) <= 1
    assert plain(table) == [(f"r:{n:05d}", 9606, "g" if n >= 500 else None) for n in range(1000)]
    assert table.upsert(sequences(spark, range(500, 1000), gene="h")) == 2
    # The version before is still there.
    assert table.read(1).where("gene IS NOT NULL").count() == 0


def test_new_keys_anywhere_and_growing_ranges(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "ref", range_rows=50)
    for step, start in enumerate((500, 0, 900, 501), 1):
        numbers = range(start, start + 300, 3)
        assert table.upsert(sequences(spark, numbers, gene=str(start))) == step
    want = {}
    for start in (500, 0, 900, 501):
        for n in range(start, start + 300, 3):
            want.setdefault(f"r:{n:05d}", str(start))
    assert {r[0]: r[2] for r in plain(table)} == want and len(plain(table)) == len(want)
    lows = [r.low for r in table.ranges()]
    assert lows == sorted(lows) and len(lows) >= 6
    for row, above in zip(table.ranges(), [*lows[1:], None]):
        edge = table._rows([row], table.read().schema).agg(F.min("ref"), F.max("ref")).first()
        assert edge[0] >= row.low and (above is None or edge[1] < above)


def test_several_rows_of_a_key(spark, tmp_path):
    fill = VersionedTable(spark, str(tmp_path / "fill"), "ref")
    fill.upsert(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", None, None)], ROW), ["taxon"])
    assert plain(fill) == [("a", 1, "x"), ("b", None, None)]
    keep = VersionedTable(spark, str(tmp_path / "keep"), "ref", "keep", range_rows=2)
    rows = spark.createDataFrame([("a", n, None) for n in range(9)] + [("b", 1, None)], ROW)
    assert keep.upsert(rows) == 1 and keep.upsert(rows) == 1
    assert keep.upsert(spark.createDataFrame([("a", 77, None), ("c", 5, None), ("c", 5, None)], ROW)) == 2
    assert plain(keep) == [("a", n, None) for n in range(9)] + [("b", 1, None), ("c", 5, None), ("c", 5, None)]
    with pytest.raises(ValueError):
        keep.upsert(spark.createDataFrame([(None, 1, None)], ROW))
    with pytest.raises(ValueError):
        keep.upsert(rows.drop("gene"))


def test_a_lost_run_leaves_the_table_as_it_was(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "ref")
    table.upsert(sequences(spark, range(10), taxon=1))
    sequences(spark, range(3)).write.parquet(str(tmp_path / "t" / "data" / "version=2" / "_range=0" / "_part=0"))  # no manifest
    assert table.version() == 1 and table.read().count() == 10
    assert table.upsert(sequences(spark, range(10, 12))) == 2 and table.read().count() == 12


def test_growing_store(spark, tmp_path):
    path = str(tmp_path / "store")
    blocks = spark.createDataFrame([("e1", 0, "a", 0, "b", 5, 10, False), ("e1", 1, "a", 20, "b", 15, 10, False)], "edge_key string, ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    bundle = Bundle(sequences=sequences(spark, range(3)), blocks=blocks)
    assert upsert_store(bundle, path, spark, store="s", taxon=9606) == {"sequence": 1, "block": 1}
    assert upsert_store(bundle, path, spark, store="other") == {"sequence": 1, "block": 1}
    more = Bundle(sequences=sequences(spark, range(2, 5), gene="g"), blocks=blocks.withColumn("edge_key", F.lit("e2")))
    assert upsert_store(more, path, spark) == {"sequence": 2, "block": 2}
    held = StoreSet(spark, [path])
    assert held.meta.first().store == "s" and held.table("block").count() == 4 and held.table("edge") is None and held.graph() is None
    assert sorted((r.ref, r.gene) for r in held.table("sequence").collect()) == [("r:00000", None), ("r:00001", None), ("r:00002", "g"), ("r:00003", "g"), ("r:00004", "g")]
    whole = str(tmp_path / "whole")
    write_store(bundle, whole, spark, store="w")
    with pytest.raises(ValueError):
        upsert_store(bundle, whole, spark)
