import random
import time

import numpy as np
from pyspark.sql import functions as F

from coordweave.functions import sequences as seqs
from coordweave.operators import dims
from coordweave.operators.ordered import consecutive_groups, running_sum, union_intervals
from coordweave.operators.overlap import measured_ladder, overlap_join
from coordweave.operators.pages import following, nth, paged
from coordweave.operators.residues import alignment_identity, block_mismatches, slices, tiles
from coordweave.operators.validate import align_pair, fill
from coordweave.operators.verify import round_trips
from coordweave.sources.alignments import one_to_one


def test_overlap_join_over_mixed_lengths_and_a_hot_key(spark):
    rng = random.Random(5)
    spans = lambda n, tag: [(tag + i, "hot" if rng.random() < 0.5 else f"r{rng.randrange(3)}", s := rng.randrange(5000), s + rng.choice([0, 1, 7, 90, 3000])) for i in range(n)]
    left, right = spans(300, 0), spans(300, 1000)
    a = spark.createDataFrame(left, "x long, ref string, start long, end long")
    b = spark.createDataFrame(right, "y long, ref string, r_start long, r_end long")
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[2] < max(q[3], q[2] + 1) and q[2] < max(p[3], p[2] + 1))
    for options in (dict(), dict(ladder=(6,)), dict(ladder=(3, 8)), dict(salts=3), dict(ladder=measured_ladder((a, "start", "end"), (b, "r_start", "r_end")))):
        got = sorted((r.x, r.y) for r in overlap_join(a, b, ["ref"], **options).collect())
        assert got == want, options


def test_ordered_aggregates_across_chunks(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), i, rng.randint(1, 5), rng.choice("xyz")) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long, c string")
    for width in (1, 7, 1000):
        chunk = F.floor(F.col("i") / width)
        sums = {(r.k, r.i): r.s for r in running_sum(df, ["k"], ["i"], F.col("v"), chunk, "s").collect()}
        runs = {(r.k, r.i): r.island for r in consecutive_groups(df, ["k"], ["i"], ["c"], chunk).collect()}
        for key in "ab":
            total, island, last = 0, 0, None
            for k, i, v, c in rows:
                if k != key:
                    continue
                island += last is not None and c != last
                assert sums[(k, i)] == total and runs[(k, i)] == island
                total, last = total + v, c


def test_union_of_intervals_across_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), s := rng.randrange(400), s + rng.choice([1, 3, 9, 120])) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for bits in (1, 4, 12):
        got = sorted((r.k, r.start, r.end) for r in union_intervals(df, ["k"], "s", "e", chunk_bits=bits).collect())
        want = []
        for k in "ab":
            units = sorted({u for x, s, e in rows if x == k for u in range(s, e)})
            at = 0
            for i, u in enumerate(units):
                if i + 1 == len(units) or units[i + 1] != u + 1:
                    want.append((k, units[at], u + 1))
                    at = i + 1
        assert got == sorted(want), bits


def test_greedy_one_to_one(spark):
    rng = random.Random(4)
    rows = [("q", f"r{i}", f"{i:04d}", s := rng.randrange(3000), s + rng.randint(1, 200), rng.randrange(50), float(rng.randrange(20))) for i in range(150)]
    df = spark.createDataFrame(rows, "qname string, rec string, place string, qstart long, qend long, nmatch long, score double")
    taken, want = set(), []
    for r in sorted(rows, key=lambda r: (-r[6], -r[5], r[2])):
        free = [u for u in range(r[3], r[4]) if u not in taken]
        want += [(r[1], u) for u in free]
        taken |= set(free)
    for bits in (4, 16):
        got = [(r.rec, u) for r in one_to_one(df, bits).collect() for u in range(r.free_start, r.free_end)]
        assert sorted(got) == sorted(want)


def test_one_to_one_under_deep_cover(spark):
    """As many alignments over one stretch as it has units: rows grow with the logarithm of the axis, not with the cover."""
    n, width = 20_000, 1 << 16
    start = F.pmod(F.xxhash64("id"), F.lit(width)).cast("long")
    stop = start + 1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(width)).cast("long")
    df = spark.range(n).select(F.lit("q").alias("qname"), F.concat(F.lit("r"), "id").alias("rec"), F.col("id").alias("place"), start.alias("qstart"), stop.alias("qend"),
                               F.lit(1).cast("long").alias("nmatch"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10**6)).cast("double").alias("score")).cache()
    got = one_to_one(df).collect()
    owner = [None] * (2 * width + 2)
    for r in sorted(df.collect(), key=lambda r: (r.score, -r.place)):
        owner[r.qstart : r.qend] = [r.rec] * (r.qend - r.qstart)
    out = [None] * len(owner)
    for r in got:
        assert all(x is None for x in out[r.free_start : r.free_end])
        out[r.free_start : r.free_end] = [r.rec] * (r.free_end - r.free_start)
    assert out == owner


def test_sequence_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(seqs.digest(F.lit("acgt"))) == "SQ.aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2"
    assert value(seqs.reverse_complement(F.lit("ACGTRYUN!"))) == "NNARYACGT"
    assert value(seqs.translate(F.lit("atgTGAtaaNNNggc"), 1)) == "M**XG" and value(seqs.translate(F.lit("ATGUGAAGA"), 2)) == "MW*"
    assert value(seqs.translate(F.lit("ATGTGA"), F.lit(2))) == "MW" and value(seqs.is_start_codon(F.lit("gug"), 2)) and not value(seqs.is_start_codon(F.lit("GTG"), 1))
    assert value(seqs.amino_acid_code(F.lit("SEC"))) == "U" and value(seqs.amino_acid_code(F.lit("nope"))) is None
    assert value(seqs.infer_protein_length(F.lit(12), F.lit(1), F.lit(False))) == 3 and value(seqs.infer_protein_length(F.lit(11), F.lit(1), F.lit(False))) == 3


def test_tiles_slices_and_identity(spark):
    rng = random.Random(6)
    text = {r: "".join(rng.choice("ACGT") for _ in range(n)) for r, n in (("a", 103), ("b", 95))}
    table = tiles(spark.createDataFrame(list(text.items()), "ref string, residues string"), size=16)
    shifted = tiles(spark.createDataFrame([("c", text["a"][20:], 20)], "ref string, residues string, at long"), offset="at", size=16)
    wanted = spark.createDataFrame([(1, "a", 3, 80, 1), (2, "b", 10, 40, -1), (3, "b", 90, 96, 1), (4, "c", 25, 60, 1), (5, "c", 10, 30, 1)], "q int, ref string, start long, end long, strand int")
    got = {r.q: r.residues for r in slices(wanted, table.unionByName(shifted), ["q"], strand="strand", size=16).collect()}
    comp = str.maketrans("ACGT", "TGCA")
    assert got == {1: text["a"][3:80], 2: text["b"][10:40][::-1].translate(comp), 3: None, 4: text["a"][25:60], 5: None}
    blocks = spark.createDataFrame([("e", 0, "a", 5, "b", 9, 70, False), ("e", 1, "a", 80, "b", 2, 13, True)], "edge_key string, ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    pairs = list(zip(range(5, 75), text["a"][5:75], text["b"][9:79])) + list(zip(range(80, 93), text["a"][80:93], text["b"][2:15][::-1].translate(comp)))
    row = alignment_identity(blocks, table, ["edge_key"], size=16).first()
    assert (row.identical, row.aligned) == (sum(x == y for _, x, y in pairs), 83)
    found = sorted((r.pos, r.a, r.b) for r in block_mismatches(blocks, table, ["edge_key"], size=16).collect())
    assert found == sorted(p for p in pairs if p[1] != p[2])


def test_protein_alignment():
    rng = random.Random(1)
    a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(189))
    b = a[:50] + ("W" if a[50] != "W" else "Y") + a[51:100] + a[105:]
    blocks, identical, aligned, changed = align_pair(a, b)
    assert blocks[0][:2] == (0, 0) and blocks[-1][0] + blocks[-1][2] == 189 and aligned == 184 and changed[0].startswith("51/51:")
    assert align_pair(a, a) == ([(0, 0, 189)], 189, 189, []) and align_pair("AAAA", "CCCC") is None


def test_isolated_changes_take_no_scores():
    """Two changes in sides of one length are aligned along the diagonal, and a long stretch costs no square."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 3, rng.integers(1, 12)).astype(np.uint8)
        y = x.copy()
        y[rng.integers(0, len(x), 2)] = 7
        assert fill(x, y, False, False).tolist() == [[i, i] for i in range(len(x))]
    x = rng.integers(0, 20, 40_000).astype(np.uint8)
    y = x.copy()
    y[[100, 30_000]] = 77
    begin = time.process_time()
    assert len(fill(x, y, False, False)) == len(x) and time.process_time() - begin < 1


def test_long_stretches_are_scored_near_the_diagonal():
    """No worse than with an end that needs all scores, and a long stretch of many changes costs no square."""
    rng = np.random.default_rng(4)
    for _ in range(100):
        x = rng.integers(0, 3, 60).astype(np.uint8)
        y = x.copy()
        y[20:24] = np.roll(y[20:24], 1)
        y[rng.integers(0, 60, 4)] = 7
        i, j = fill(x, y, False, False).T
        k, m = fill(np.append(x, 9), np.append(y, [9, 9]), False, False)[:-1].T
        score = lambda p, q: 3 * int((x[p] == y[q]).sum()) - len(p) - 4 * (60 - len(p))
        inside = m < 60
        assert score(i, j) >= score(k[inside], m[inside])
    x = np.zeros(20_000, np.uint8)
    y = x.copy()
    y[49::500] = 7
    begin = time.process_time()
    assert len(fill(x, y, False, False)) == len(x) and time.process_time() - begin < 4


def test_records_merge_in_store_order(spark):
    rows = [("r", 1, 0, "protein", 0, ["b"], None), ("r", 0, 0, None, 0, ["a"], "SQ.x"), ("r", 2, 0, "DNA", 9, ["a", "c"], "SQ.y"), ("s", 0, 1, "DNA", 5, [], "SQ.x"), ("t", 0, 2, "DNA", 5, [], "SQ.x")]
    df = spark.createDataFrame(rows, "ref string, store_ord int, rec_ord long, moltype string, length long, tags array<string>, digest string")
    merged = {r.ref: r for r in dims.merge_records(df).collect()}
    assert (merged["r"].moltype, merged["r"].length, merged["r"].tags, merged["r"].digest) == ("protein", 9, ["a", "b", "c"], "SQ.x")
    star = {r.ref: (r.same_as, r.copies) for r in dims.digest_groups(dims.merge_records(df)).collect()}
    assert star == {"r": ("r", 3), "s": ("r", 3), "t": ("r", 3)}


def test_species_and_assemblies(spark):
    schema = "store_ord int, taxon long, organism string, assembly string, species_taxon long, released string, ucsc string, accession string, aliases map<string,string>"
    meta = spark.createDataFrame([
        (0, 9606, "Homo sapiens", "GRCh37.p13", None, "2013-06-28", "hg19", "GCF_1", {"1": "NC_000001.10"}),
        (1, 9606, "Homo sapiens (human)", "GRCh38.p14", None, "2022-02-03", "hg38", "GCF_2", {"1": "refseq:NC_000001.11"}),
        (2, 1480154, "Marchantia polymorpha subsp. ruderalis", None, None, None, None, None, None),
        (3, 3197, "Marchantia polymorpha", None, None, None, None, None, None),
    ], schema)
    records = spark.createDataFrame([("refseq:NC_000001.10", None, None, 0, 0, "DNA", None), ("refseq:NM_1.1", 1480154, None, 2, 0, "RNA", None)], "ref string, taxon long, organism string, store_ord int, rec_ord long, moltype string, unit string")
    edges = spark.createDataFrame([(0, "annotation")], "store_ord int, kind string")
    folding = dims.species_folding(meta, records)
    assert [(r.taxon, r.species) for r in folding.collect()] == [(1480154, 3197)]
    table = {r.taxon: r for r in dims.species(meta, records, edges).collect()}
    assert table[9606].default_assembly == "GRCh37.p13" and table[9606].organism == "Homo sapiens" and table[9606].assemblies == ["GRCh37.p13", "GRCh38.p14"]
    assert table[3197].taxa == [1480154]
    names = spark.createDataFrame([("grch38",), ("hg19",), ("gcf_2",), ("zzz",)], "n string")
    found = {r.n: r.assembly for r in dims.find_assembly(names, "n", dims.assemblies(meta, edges, folding)).collect()}
    assert found == {"grch38": "GRCh38.p14", "hg19": "GRCh37.p13", "gcf_2": "GRCh38.p14", "zzz": None}
    scope = {r.ref: (r.taxon, r.assembly, r.category) for r in dims.sequence_scope(records.withColumn("length", F.lit(0)).withColumn("digest", F.lit(None).cast("string")).withColumn("tags", F.array().cast("array<string>")), meta).collect()}
    assert scope == {"refseq:NC_000001.10": (9606, "GRCh37.p13", "genome"), "refseq:NM_1.1": (3197, None, "transcript")}


def test_pages_are_the_ordered_whole(spark):
    rows = [(n * 7919 % 1000 if n % 50 else None, "ab"[n % 2], n) for n in range(2500)]
    df = spark.createDataFrame(rows, "start int, ref string, id int").repartition(7)
    order = ["ref", "start", "id"]
    want = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[2]))
    got = [tuple(r) for r in paged(df, order, 400).orderBy("rank").collect()]
    assert got == [(*r, k, k // 400) for k, r in enumerate(want)]
    turned, after = [], None
    for _ in range(4):
        page = following(df, order, after, 700).collect()
        turned += [tuple(r) for r in page]
        after = page[-1].asDict()
    assert turned == want and following(df, order, after, 700).collect() == []
    assert [tuple(r)[:3] for r in nth(df, order, [0, 100, 2499]).orderBy("rank").collect()] == [want[0], want[100], want[2499]]
    assert paged(df.limit(0), order, 3).count() == 0


def test_round_trips_count_units_that_come_back(spark):
    blocks = spark.createDataFrame(
        [("e", 0, "a", 0, "b", 100, 10, False), ("e", 1, "a", 10, "b", 105, 10, True), ("f", 0, "a", 0, "c", 0, 1, False)],
        "edge_key string, ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean",
    )
    got = {r.edge_key: (r.units, r.returned, r.alone) for r in round_trips(blocks, ["edge_key"], samples=10).collect()}
    assert got == {"e": (20, 20, 10), "f": (1, 1, 1)}
