"""One mapping over several stores, against units mapped one by one."""

import random

import pytest
from coordweave.operators.images import blocks_of_edges, common_blocks, mapping_for, shared_pieces
from coordweave.operators.mapping import BLOCK

SEGMENT = "q long, ref string, start long, end long"


def images(rows):
    """Images of every unit: (source, unit, target, image, turned)."""
    out = []
    for r in rows:
        for k in range(r["len"]):
            out.append((r["src_ref"], r["src"] + k, r["tgt_ref"], r["tgt"] + (r["len"] - 1 - k if r["rev"] else k), r["rev"]))
    return out


def random_stores(spark, seed):
    """Three stores that cut the same correspondences differently, and add some of their own."""
    pick = random.Random(seed)
    stores = []
    for n in range(3):
        rows = []
        for k in range(12):
            src, length, rev, shift = pick.randrange(60), pick.randrange(1, 25), k % 3 == 0, 200 if k % 2 else 70_000
            tgt = shift * 2 - src - length if rev else shift + src
            rows.append((f"e{n}.{k}", k, "x:A", src, "x:B", tgt, length, rev))
        stores.append(spark.createDataFrame(rows, BLOCK))
    return stores


def test_shifted_cuts_give_one_image(spark):
    one = spark.createDataFrame([("a", 0, "x:A", 0, "x:B", 100, 50, False), ("t", 1, "x:A", 0, "x:C", 100, 50, True)], BLOCK)
    two = spark.createDataFrame(
        [("b", 0, "x:A", 0, "x:B", 100, 20, False), ("b", 1, "x:A", 20, "x:B", 120, 30, False), ("u", 2, "x:A", 0, "x:C", 117, 33, True), ("u", 3, "x:A", 33, "x:C", 100, 17, True)], BLOCK
    )
    got = sorted(tuple(r[c] for c in ("edge_key", "src", "tgt_ref", "tgt", "len", "rev", "n_blocks")) for r in common_blocks(one, two).collect())
    assert got == [("a", 0, "x:B", 100, 50, False, 3), ("t", 0, "x:C", 100, 50, True, 3)]
    assert sorted((r.tgt_ref, r.src, r.len, r.n_mappings) for r in shared_pieces(one, two).collect()) == [("x:B", 0, 50, 2), ("x:C", 0, 50, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_unit_keeps_its_images_once(spark, seed):
    stores = random_stores(spark, seed)
    held = [set(images(s.collect())) for s in stores]
    got = images(common_blocks(*stores).collect())
    assert len(got) == len(set(got)) and set(got) == set().union(*held)
    pieces = shared_pieces(*stores).collect()
    depth = {image: r["n_mappings"] for r in pieces for image in images([r])}
    assert depth == {image: sum(image in h for h in held) for image in set(got)}


def test_long_lines_cross_stretches_of_positions(spark):
    """A line of many chunks of positions, its blocks overlapping across their borders."""
    step = 40_000
    rows = [("e", k, "x:A", k * step, "x:B", k * step + 5, step + (7 if k % 2 else 0), False) for k in range(40)]
    mapping = spark.createDataFrame(rows, BLOCK)
    (whole,) = common_blocks(mapping, mapping).collect()
    assert (whole["src"], whole["tgt"], whole["len"], whole["n_blocks"]) == (0, 5, 40 * step + 7, 80)
    (piece,) = shared_pieces(mapping, mapping).collect()
    assert (piece["src"], piece["len"], piece["n_mappings"]) == (0, 40 * step + 7, 2)


def test_mapping_of_locations(spark):
    one = spark.createDataFrame([("a", 0, "x:A", 10, "x:B", 100, 10, False), ("c", 1, "x:A", 40, "x:D", 0, 10, False)], BLOCK)
    two = spark.createDataFrame([("b", 0, "x:A", 15, "x:B", 105, 10, False), ("r", 1, "x:E", 0, "x:A", 18, 5, False)], BLOCK)
    asked = spark.createDataFrame([(1, "x:A", 18, 19), (1, "x:A", 20, 22), (2, "x:A", 25, 25), (3, "x:A", 30, 31), (4, "x:A", 40, 40)], SEGMENT)
    rows = lambda **given: sorted((r["q"], r["tgt_ref"], r["src"], r["len"]) for r in mapping_for(asked, [one, two], ["q"], **given).collect())
    assert rows() == [(1, "x:B", 10, 15), (1, "x:E", 18, 5), (2, "x:B", 10, 15), (4, "x:D", 40, 10)]
    assert rows(direction="forward") == [(1, "x:B", 10, 15), (2, "x:B", 10, 15), (4, "x:D", 40, 10)]
    assert rows(direction="inverse") == [(1, "x:E", 18, 5)]
    only = spark.createDataFrame([("b",), ("b",)], "edge_key string")
    assert rows(edges=only) == [(1, "x:B", 15, 10), (2, "x:B", 15, 10)] and blocks_of_edges(two, only).count() == 1
    with pytest.raises(ValueError):
        mapping_for(asked, [one], ["q"], direction="sideways")
    assert common_blocks(one.limit(0), two.limit(0)).count() == 0
