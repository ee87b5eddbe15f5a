"""What large inputs cost: shuffles of a plan, and that both ways of ordering a key give one result."""

import random

import pytest
from pyspark.sql import functions as F

from coordweave.operators import convert as cv
from coordweave.operators import mapping as mp
from coordweave.operators import ordered
from coordweave.operators.images import common_blocks, shared_pieces
from coordweave.operators.verify import round_trips
from coordweave.plans import tables as tb
from coordweave.session import cut_lineage
from coordweave.sources import features, tabular

from test_images import random_stores


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


@pytest.fixture(params=["few rows a key", "many rows a key", "some keys"])
def limit(request, monkeypatch):
    monkeypatch.setattr(ordered, "MANY", {"few rows a key": 1 << 18, "many rows a key": 0, "some keys": 60}[request.param])


def test_both_ways_of_ordering_agree(spark, limit):
    pick = random.Random(4)
    rows = [(pick.choice(["a", "a", "b", None]), i, pick.randint(1, 5), pick.choice("xyz"), s := pick.randrange(300), s + pick.choice([1, 4, 30])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long, c string, s long, e long")
    chunk, key = F.expr("i div 9"), ["k"]
    said = lambda make: sorted(map(repr, make(key).collect())) == sorted(map(repr, make(None).collect()))
    assert said(lambda few: ordered.running_sum(df, key, ["i"], F.col("v"), chunk, "n", few=few))
    assert said(lambda few: ordered.consecutive_groups(df, key, ["i"], ["c"], chunk, few=few))
    assert said(lambda few: ordered.previous_row(df, key, ["i"], F.col("v"), chunk, "n", few=few))
    assert said(lambda few: ordered.next_row(df, key, "i", "n", 3, few=few))
    for touch in (True, False):
        assert said(lambda few: ordered.union_intervals(df, key, "s", "e", 4, touch, few=few))  # noqa: B023


def test_images_agree_for_sources_of_any_size(spark, monkeypatch):
    stores = random_stores(spark, 7)
    found = []
    for many in (1 << 18, 0):
        monkeypatch.setattr(ordered, "MANY", many)
        found.append([sorted(map(repr, make(*stores).collect())) for make in (common_blocks, shared_pieces)])
    assert found[0] == found[1] and all(found[0])


def test_orders_are_laid_out_by_one_shuffle(spark):
    assert shuffles(tb.layout(spark, "/root/testdata/sf0.001")) == 1


def test_images_of_three_stores_need_few_shuffles(spark):
    stores = random_stores(spark, 3)
    assert shuffles(common_blocks(*stores)) <= 2
    assert shuffles(shared_pieces(*stores)) <= 2


def lines_of(spark, values):
    rows = [("f", i // 2, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file string, split long, row long, value string").select("file", F.struct("split", "row").alias("place"), "value")


def test_lines_of_a_file_are_not_brought_together(spark):
    gff = lines_of(spark, ["NC_1.1\tx\tgene\t1\t2\t.\t+\t.\tID=a", "##FASTA", ">x"])
    assert shuffles(features.parse_gff3(gff)[0]) == 1  # the ends of the files
    sifts = lines_of(spark, ["PDB\tCHAIN", "1abc\tA"])
    assert shuffles(tabular.with_header(sifts)) <= 2  # their first lines
    assert [r["row"] for r in tabular.with_header(sifts).collect()] == [{"PDB": "1abc", "CHAIN": "A"}]


def test_rows_cut_from_their_lineage_are_packed(spark, tmp_path):
    df = spark.range(20_000).select("id", F.lit("the same words in every row " * 4).alias("text"), F.create_map(F.lit("k"), F.array("id")).alias("m"))
    kept = cut_lineage(df)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))
    assert "parquet" in kept._jdf.queryExecution().executedPlan().toString().lower()


def test_cells_of_a_line_are_made_once(spark):
    """A filter on the cells does not split the line again."""
    lines = lines_of(spark, ["NC_1.1\tx\tgene\t1\t2\t.\t+\t.\tID=a%3Db;ID=c=d,e;k="])
    plan = features.parse_gff3(lines)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1
    assert features.parse_gff3(lines)[0].first()["attributes"] == {"ID": ["c=d", "e"], "k": [""]}
    names = spark.createDataFrame([("chr1", "refseq:NC_1")], "alias string, ref string")
    bed = tabular.ingest_bed(lines_of(spark, ["chr1\t1\t9\tn"]), names).annotations
    assert bed._jdf.queryExecution().optimizedPlan().toString().count("split(value") <= 2  # for the names, and for the rows
    assert bed.first()["location"] == "refseq:NC_1:2..9"


def test_hits_without_between_positions_are_joined_once(spark):
    segments = tb.order_segments(spark, "/root/testdata/sf0.001")
    blocks = mp.invert(tb.blocks(spark, "/root/testdata/sf0.001"))
    found = cv.target_segments(cv.hits(segments, blocks, ["query_id"], ladder=(6,)), ["query_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    one = spark.createDataFrame([(1, "join", 0, "x", 5, 5, 1, False, False, False, 0)], "query_id long, kind string, seg_ix int, ref string, start long, end long, strand int, fuzzy_low boolean, fuzzy_high boolean, uncertain boolean, run int")
    block = spark.createDataFrame([(0, "x", 0, "y", 100, 9, False)], "ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    (at,) = cv.target_segments(cv.hits(one, block, ["query_id"]), ["query_id"]).collect()
    assert (at["start"], at["end"]) == (105, 105)


def test_round_trips_count_images_without_a_shuffle_of_their_own(spark):
    blocks = tb.blocks(spark, "/root/testdata/sf0.001").withColumn("edge_key", F.concat_ws(":", "src_ref", "tgt_ref"))
    plan = round_trips(blocks, ["edge_key"], ladder=(6,))._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan


def test_lines_with_a_carried_state_are_shuffled_once(spark):
    lines = lines_of(spark, ["LOCUS x", "a", "b", "LOCUS y", "c"])
    marks = {"rec": F.when(F.col("value").startswith("LOCUS"), F.col("value"))}
    told = ordered.carry_last(lines, ["file"], ["place"], marks, F.col("place.split"))
    assert shuffles(told) <= 3  # the lines, and twice a row per split
    assert [r["rec"] for r in told.orderBy("place").collect()] == ["LOCUS x"] * 3 + ["LOCUS y"] * 2


def test_flat_file_features_are_put_together_once(spark, monkeypatch):
    """The state of a line is found without sorting all lines by split, and features are read from where they were written."""
    text = ["LOCUS       NC_1   9 bp    DNA     linear   PRI 01-JAN-2024", "DEFINITION  One", "            line.", "VERSION     NC_1.1", "COMMENT     x", "     gene            9", "FEATURES             Location/Qualifiers"]
    text += ["     source          1..9", "                     /organism=\"A", "                     b\"", "     gene            2..", "                     3\r", "                     /pseudo", "ORIGIN", "        1 acg tac", "//", "     gene            4"]
    plans, found, cut = [], [], features.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(features, "cut_lineage", seen)
    for many in (1 << 18, 0):
        monkeypatch.setattr(ordered, "MANY", many)
        made = features.parse_genbank(lines_of(spark, text * 2))
        assert "SortAggregate" not in plans[0 if many else len(plans) // 2] and shuffles(made.features) == 0
        found.append([sorted(map(repr, df.drop("file", "rec").collect())) for df in (made.records, made.features, made.residues)])
    records, listed, residues = found[0]
    assert found[0] == found[1] and len(records) == 2 and len(residues) == 2
    assert sorted(set(listed)) == [
        "Row(key='gene', location='2..3', qualifiers=[Row(name='pseudo', value='')], f_ix=1)", "Row(key='source', location='1..9', qualifiers=[Row(name='organism', value='A b')], f_ix=0)",
    ]


def test_round_trips_shuffle_two_flags_a_unit(spark):
    blocks = [("e", 0, "a", 0, "x", 0, 3, False), ("e", 1, "a", 3, "x", 0, 3, False), ("e", 2, "a", 6, "x", 9, 3, True), ("e", 3, "a", 6, "x", 9, 3, True), ("e", 4, "b", 6, "y", 9, 2, True)]
    df = spark.createDataFrame(blocks, "edge_key string, ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    found = round_trips(df, ["edge_key"], ladder=(6,))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # Two blocks share an image and come back twice, one stands there twice and comes back as itself.
    assert [tuple(r) for r in found.collect()] == [("e", 14, 14, 8)]
