import random

import pytest

from pyspark.sql import functions as F

from coordweave.functions.location import parse_locations
from coordweave.functions.namespaces import Namespace, Registry
from coordweave.operators import convert as cv
from coordweave.operators.mapping import cds_error, cds_mapping, compose, concat, from_location, invert, residue_blocks

REGISTRY = Registry().register(Namespace("test", r"^[A-Za-z0-9_]+$", "nt", r"^PROT|^STRUCT"))
CODING = [
    ("refseq:YP_009724389.1", "refseq:NC_045512.2:join(266..13468,13468..21555)", 1, 7096),
    ("refseq:YP_003024037.1", "refseq:NC_012920.1:complement(14149..14673)", 1, 174),
    ("test:PROT2", "test:CHR2:complement(join(11..20,31..40,51..60))", 1, 8),
]
FORWARD = [
    ("refseq:YP_009724389.1:4401..4402", [("refseq:NC_045512.2:join(13466..13468,13468..13470)", "forward")], None),
    ("test:DLOOP:570..580", [("refseq:NC_012920.1:complement(join(16566..16569,1..7))", "reverse")], None),
    ("test:PROT3:200..215", [("test:STRUCT3:join(198..>201,<205..209)", "forward")], "test:PROT3:204..210"),
    ("test:A:1..8", [("test:X:24..30", "forward")], "test:A:7"),
    ("test:PROT2:4", [("test:CHR2:complement(join(39..40,51))", "reverse")], None),
]
INVERSE = [
    ("refseq:NC_045512.2:13468", [("refseq:YP_009724389.1:join(4401c3,4402c1)", "forward")], None),
    ("refseq:NC_045512.2:1..300", [("refseq:YP_009724389.1:<1..12c2", "forward")], "refseq:NC_045512.2:1..265"),
    ("refseq:NC_012920.1:14150..14160", [("refseq:YP_003024037.1:172..>174", "reverse")], "refseq:NC_012920.1:14150..14151"),
]


def _blocks(spark):
    texts = spark.createDataFrame([(p, t, c, n) for p, t, c, n in CODING], "protein string, text string, codon_start int, aa_length int")
    coding = cds_mapping(parse_locations(texts, "text", "protein", REGISTRY))
    loop = parse_locations(spark.createDataFrame([("test:DLOOP", "refseq:NC_012920.1:complement(join(16024..16569,1..576))")], "feature_ref string, text string"), "text", "feature_ref", REGISTRY)
    residues = residue_blocks(
        spark.createDataFrame([(0, "test:PROT3", 196, "test:STRUCT3", 190 + 4, 8), (1, "test:PROT3", 211, "test:STRUCT3", 205, 10)], "ix long, src_ref string, sb int, tgt_ref string, tb int, n int"), "sb", "tb", "n"
    )
    plain = spark.createDataFrame([(0, "test:A", 0, "test:X", 23, 6, False), (1, "test:A", 7, "test:X", 29, 1, False)], "ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    return concat(*[p.select("ix", "src_ref", "src", "tgt_ref", "tgt", "len", "rev") for p in (coding, from_location(loop), residues, plain)])


def _convert(spark, blocks, cases):
    asked = parse_locations(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query_id long, text string"), registry=REGISTRY)
    targets, rest = cv.map_locations(asked, blocks, registry=REGISTRY)
    got = {i: [] for i in range(len(cases))}
    for row in targets.orderBy("query_id", "ord").collect():
        got[row.query_id].append((row.id, row.orientation))
    return got, {r.query_id: r.id for r in rest.collect()}


def test_worked_examples(spark):
    blocks = _blocks(spark).cache()
    got, rest = _convert(spark, blocks, FORWARD)
    for i, (text, want, unmapped) in enumerate(FORWARD):
        assert got[i] == want and rest.get(i) == unmapped, (text, got[i], rest.get(i))
    got, rest = _convert(spark, invert(blocks), INVERSE)
    for i, (text, want, unmapped) in enumerate(INVERSE):
        assert got[i] == want and rest.get(i) == unmapped, (text, got[i], rest.get(i))


def test_coding_location_must_fit(spark):
    rows = [(1, "refseq:NC_1:1..9", 1, 3, False), (2, "refseq:NC_1:1..9", 2, 3, False), (3, "refseq:NC_1:1..9", 4, 1, False), (4, "refseq:NC_1:1..9", 1, 1, True)]
    df = parse_locations(spark.createDataFrame(rows, "query_id long, text string, c int, n int, lead boolean"))
    got = {r.query_id: r.e for r in df.select("query_id", cds_error(F.col("segments"), F.col("c"), F.col("n"), F.col("lead")).alias("e")).collect()}
    assert got[1] is None and "do not fit in a 9 nt CDS" in got[2] and got[3].startswith("codon_start must be") and got[4].startswith("leadingPartialCodon")


def _random_cases(n, seed):
    rng = random.Random(seed)
    for q in range(n):
        blocks = [dict(ix=i, src=rng.randrange(40), tgt=rng.randrange(40), len=rng.randint(1, 12), rev=rng.random() < 0.4, tgt_ref=f"test:T{q}_{rng.randrange(2)}") for i in range(rng.randint(0, 8))]
        segments = []
        for _ in range(rng.randint(1, 4)):
            start = rng.randrange(50)
            size = rng.randint(0, 15)
            segments.append(dict(ref=f"test:S{q}", start=start, end=start + size, strand=rng.choice([1, -1]), fuzzy_low=size > 0 and rng.random() < 0.3, fuzzy_high=size > 0 and rng.random() < 0.3, uncertain=size > 0 and rng.random() < 0.2, unit="nt"))
        yield q, rng.choice(["join", "order"]), segments, blocks


def _image(block, unit):
    off = unit - block["src"]
    return block["tgt"] + (block["len"] - 1 - off if block["rev"] else off)


def _sequential(kind, segments, blocks):
    """Plain restatement: walk the hits in traversal order, extend the open group of the target or start another."""
    out, open_groups, unmapped = [], {}, []
    for i, s in enumerate(segments):
        if s["start"] == s["end"]:
            open_groups, k, found = {}, s["start"], False
            for ref in dict.fromkeys(b["tgt_ref"] for b in blocks):
                sides = [[_image(b, u) for b in blocks if b["tgt_ref"] == ref and b["src"] <= u < b["src"] + b["len"]] for u in (k - 1, k)]
                if k > 0 and len(sides[0]) == len(sides[1]) == 1 and abs(sides[1][0] - sides[0][0]) == 1:
                    at = max(sides[0][0], sides[1][0])
                    out.append((ref, at, at, s["strand"] * (1 if sides[1][0] > sides[0][0] else -1), False, False))
                    found = True
            if not found:
                unmapped.append((i, k, k))
            continue
        hits = []
        for b in blocks:
            a, e = max(s["start"], b["src"]), min(s["end"], b["src"] + b["len"])
            if a < e:
                ends = sorted((_image(b, a), _image(b, e - 1)))
                hits.append((a, e, ends[0], ends[1] + 1, b["tgt_ref"], s["strand"] * (-1 if b["rev"] else 1), b["ix"]))
        hits.sort(key=lambda h: (h[0] if s["strand"] == 1 else -h[1], h[6]))
        gaps, at = [], None
        for u in range(s["start"], s["end"] + 1):
            free = u < s["end"] and not any(h[0] <= u < h[1] for h in hits)
            if free and at is None:
                at = u
            if not free and at is not None:
                gaps.append((i, at, u))
                at = None
        unmapped += gaps if s["strand"] == 1 else gaps[::-1]
        on = lambda u, ref: any(h[0] <= u < h[1] and h[4] == ref for h in hits)
        for a, e, ta, tb, ref, strand, _ in hits:
            low = s["fuzzy_low"] if a == s["start"] else not on(a - 1, ref)
            high = s["fuzzy_high"] if e == s["end"] else not on(e, ref)
            first, last = (low, high) if s["strand"] == 1 else (high, low)
            g = open_groups.get(ref)
            joins = g and g["strand"] == strand and (ta == g["tb"] if strand == 1 else tb == g["ta"])
            if joins and g["seg"] == i:
                joins = a >= g["e"] if s["strand"] == 1 else e <= g["a"]
            elif joins:
                joins = kind == "join" and not s["uncertain"] and not segments[g["seg"]]["uncertain"]
            if joins:
                g.update(ta=min(g["ta"], ta), tb=max(g["tb"], tb), last=last, seg=i, a=a, e=e)
            else:
                g = open_groups[ref] = dict(ref=ref, ta=ta, tb=tb, strand=strand, first=first, last=last, seg=i, a=a, e=e)
                out.append(g)
    flat = [g if isinstance(g, tuple) else (g["ref"], g["ta"], g["tb"], g["strand"], *((g["first"], g["last"]) if g["strand"] == 1 else (g["last"], g["first"]))) for g in out]
    return flat, unmapped


@pytest.mark.parametrize("bits", [16, 3, 0])
def test_windows_equal_a_sequential_walk(spark, monkeypatch, bits):
    monkeypatch.setattr(cv, "CHUNK_BITS", bits)  # 3: most inputs are swept in stretches; 0: all
    cases = list(_random_cases(400, 7))
    block_rows = [(b["ix"], f"test:S{q}", b["src"], b["tgt_ref"], b["tgt"], b["len"], b["rev"]) for q, _, _, bs in cases for b in bs]
    blocks = spark.createDataFrame(block_rows, "ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    schema = "query_id long, outer string, kind string, segments array<struct<ref:string,start:long,end:long,strand:int,fuzzy_low:boolean,fuzzy_high:boolean,uncertain:boolean,unit:string>>"
    locations = spark.createDataFrame([(q, f"test:S{q}", kind, [tuple(s.values()) for s in segs]) for q, kind, segs, _ in cases], schema)
    segments = cv.explode_locations(locations, ["query_id"]).cache()
    found = cv.hits(segments, blocks, ["query_id"]).cache()
    got = {q: [] for q, *_ in cases}
    for r in cv.target_segments(found, ["query_id"]).orderBy("query_id", "seg_ix", "p", "ix").collect():
        got[r.query_id].append((r.tgt_ref, r.start, r.end, r.strand, r.fuzzy_low, r.fuzzy_high))
    rest = {q: [] for q, *_ in cases}
    for r in cv.unmapped(segments, found, ["query_id"]).orderBy("query_id", "seg_ix", "p").collect():
        rest[r.query_id].append((r.seg_ix, r.start, r.end))
    for q, kind, segs, bs in cases:
        want, missing = _sequential(kind, segs, bs)
        assert got[q] == want, (q, kind, segs, bs)
        assert rest[q] == missing, (q, segs, bs)


def test_compose_is_composition_of_units(spark):
    rng = random.Random(3)
    row = lambda i, s, t: (i, s, rng.randrange(60), t, rng.randrange(60), rng.randint(1, 20), rng.random() < 0.5)
    ab, bc = [row(i, "a", "b") for i in range(12)], [row(i, "b", "c") for i in range(12)]
    schema = "ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean"
    out = compose(spark.createDataFrame(ab, schema), spark.createDataFrame(bc, schema), reindex=True).collect()
    as_dict = lambda r: dict(src=r[2], tgt=r[4], len=r[5], rev=r[6])
    pairs = lambda rows: [(u, _image(b, u)) for b in map(as_dict, rows) for u in range(b["src"], b["src"] + b["len"])]
    want = sorted((x, z) for x, y in pairs(ab) for y2, z in pairs(bc) if y == y2)
    got = sorted((u, _image(b, u)) for b in (r.asDict() for r in out) for u in range(b["src"], b["src"] + b["len"]))
    assert got == want and [r.ix for r in sorted(out, key=lambda r: r.ix)] == list(range(len(out)))


def test_one_long_input_is_swept_in_stretches(spark, monkeypatch):
    """Tens of thousands of hits of one input: the plan in stretches gives what one task gives, and no window has the bare key."""
    n = 20_000
    at = F.col("id") * 97
    gap = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    blocks = spark.range(n).select(
        F.col("id").alias("ix"), F.lit("test:LONG").alias("src_ref"), at.alias("src"), F.when(F.col("id") % 5000 < 2500, "test:T1").otherwise("test:T2").alias("tgt_ref"),
        (at + F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, 3).otherwise(0)).alias("tgt"),
        F.when(gap, 90).when(F.col("id") % 11 == 0, 400).otherwise(97).cast("long").alias("len"), (F.col("id") % 401 == 0).alias("rev"),
    ).cache()
    asked = parse_locations(spark.createDataFrame([(1, f"test:LONG:51..{97 * n - 30}"), (2, f"test:LONG:complement(1001..{60 * n})")], "query_id long, text string"), registry=REGISTRY)
    found = {}
    for bits in (16, 40):
        monkeypatch.setattr(cv, "CHUNK_BITS", bits)
        segments = cv.explode_locations(asked, ["query_id"])
        met = cv.hits(segments, blocks, ["query_id"])
        found[bits] = [
            sorted(map(tuple, df.collect()))
            for df in (cv.target_segments(met, ["query_id"]), cv.unmapped(segments, met, ["query_id"]), cv.pieces(met, ["query_id"]))
        ]
    assert found[16] == found[40] and all(len(rows) > 3000 for rows in found[16])
