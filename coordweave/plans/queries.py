"""Registered queries: the operators run over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as seqs
from ..functions.location import format_location, parse_locations
from ..functions.namespaces import Registry, complete_versions
from ..operators import convert as cv
from ..operators import mapping as mp
from ..operators.dims import digest_groups
from ..operators.ordered import consecutive_groups, union_intervals
from ..operators.overlap import overlap_join
from ..operators.residues import alignment_identity, block_mismatches, slices, tiles
from . import tables as tb

Query = Callable[[SparkSession, str], DataFrame]
# Line items are at most 50 units long and windows 90: one or two bin widths hold every interval.
SHORT = (6,)
WINDOWS = (7,)
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def feature_layout(spark, sf):
    return tb.layout(spark, sf).select("f", "t", "src", "len", "tgt", "rev")


@query
def mapping_invert(spark, sf):
    return mp.invert(tb.blocks(spark, sf)).select("src_ref", "src", "tgt_ref", "tgt", "len", "rev")


@query
def mapping_concat(spark, sf):
    forward = tb.blocks(spark, sf)
    both = mp.concat(forward, mp.invert(forward))
    return both.groupBy("src_ref").agg(
        F.count("*").alias("n"), F.sum("len").alias("units"), F.countDistinct("ix").alias("distinct_ix")
    )


@query
def block_validation(spark, sf):
    items = tb.load(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_partkey").alias("src"), (F.col("l_suppkey") - 50).alias("tgt"),
        (F.col("l_quantity").cast("long") - 5).alias("len"),
    )
    checked = items.withColumn("bad", mp.block_error().isNotNull())
    return checked.groupBy("l_returnflag", "bad").agg(F.count("*").alias("n"))


@query
def residue_blocks(spark, sf):
    items = tb.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src_ref"), F.col("l_suppkey").alias("tgt_ref"),
        (F.col("l_linenumber").cast("long") + 1).alias("sb"), (F.col("l_partkey") + 1).alias("tb"),
        F.col("l_quantity").cast("long").alias("n"),
    )
    return mp.residue_blocks(items, "sb", "tb", "n")


@query
def coding_blocks(spark, sf):
    placed = tb.blocks(spark, sf)
    coding = placed.groupBy("src_ref").agg(F.sum("len").alias("total"))
    start = F.col("src_ref") % 3 + 1
    joined = placed.join(coding, "src_ref")
    aa = F.floor((F.col("total") - (start - 1)) / 3).cast("long")
    joined = joined.withColumn("codon_start", start).withColumn("aa", aa).where("aa >= 1")
    return mp.clip_to_coding(joined, F.col("codon_start"), F.col("aa"), F.lit(False), []).drop("ix")


@query
def overlap_pairs(spark, sf):
    b = tb.blocks(spark, sf).select(F.col("tgt_ref").alias("t"), F.col("src_ref").alias("f"), "tgt", (F.col("tgt") + F.col("len")).alias("stop"))
    other = b.select("t", F.col("f").alias("f2"), F.col("tgt").alias("tgt2"), F.col("stop").alias("stop2"))
    pairs = overlap_join(b, other, ["t"], ("tgt", "stop"), ("tgt2", "stop2"), SHORT)
    return pairs.where("f < f2").select("t", "f", "f2", F.greatest("tgt", "tgt2").alias("lo"), F.least("stop", "stop2").alias("hi"))


@query
def project_interval(spark, sf):
    b = tb.blocks(spark, sf)
    a, e = F.col("src") + F.expr("len div 4"), F.col("src") + F.expr("len - len div 4")
    lo, hi = mp.project(F.col("rev"), F.col("src"), F.col("tgt"), F.col("len"), a, e)
    return b.select("src_ref", "src", lo.alias("lo"), hi.alias("hi"))


@query
def mapping_compose(spark, sf):
    b = tb.blocks(spark, sf)
    return mp.compose(b, mp.invert(b), SHORT).select("src_ref", "src", "tgt_ref", "tgt", "len", "rev")


def _hits(spark, sf):
    return cv.hits(tb.order_segments(spark, sf), mp.invert(tb.blocks(spark, sf)), ["query_id"], ladder=SHORT)


@query
def map_pieces(spark, sf):
    return _hits(spark, sf).select("query_id", "seg_ix", "tgt_ref", "a", "b", "ta", "tb", "strand")


@query
def map_targets(spark, sf):
    out = cv.target_segments(_hits(spark, sf), ["query_id"])
    return out.select(
        "query_id", "tgt_ref", "seg_ix", "start", "end", "strand", "fuzzy_low", "fuzzy_high", "uncertain", "split_one_of"
    )


@query
def map_unmapped(spark, sf):
    segments = tb.part_windows(spark, sf)
    found = cv.hits(segments, mp.invert(tb.blocks(spark, sf)), ["query_id"], ladder=WINDOWS)
    return cv.unmapped(segments, found, ["query_id"]).select("query_id", "ref", "start", "end", "strand", "fuzzy_low", "fuzzy_high")


@query
def group_targets(spark, sf):
    registry = Registry()
    found = _hits(spark, sf).withColumn("tgt_ref", F.concat(F.lit("order:"), F.col("tgt_ref")))
    grouped = cv.group_targets(cv.target_segments(found, ["query_id"]), ["query_id"], registry)
    text = format_location(F.col("outer"), F.col("kind"), F.col("segments"))
    return grouped.select("query_id", "outer", "orientation", text.alias("location"))


@query
def coverage(spark, sf):
    segments = tb.order_segments(spark, sf)
    total = segments.groupBy("query_id").agg(F.sum(F.col("end") - F.col("start")).alias("units"))
    mapped = cv.target_segments(_hits(spark, sf), ["query_id"]).groupBy("query_id", "tgt_ref").agg(
        F.sum(F.col("end") - F.col("start")).alias("mapped")
    )
    share = F.least(F.lit(1.0), F.floor(F.col("mapped") / F.col("units") * 1000 + 0.5) / 1000)
    return mapped.join(total, "query_id").select("query_id", "tgt_ref", F.col("mapped").cast("long").alias("mapped"), share.alias("coverage"))


@query
def between_map(spark, sf):
    b = tb.blocks(spark, sf)
    at = b.select(F.col("tgt_ref").alias("ref"), (F.col("tgt") + 1).alias("start")).distinct()
    segments = at.select(
        F.concat_ws(":", "ref", "start").alias("query_id"), F.lit("join").alias("kind"), F.lit(0).cast("long").alias("seg_ix"),
        "ref", "start", F.col("start").alias("end"), F.lit(1).alias("strand"), F.lit(False).alias("fuzzy_low"),
        F.lit(False).alias("fuzzy_high"), F.lit(False).alias("uncertain"), F.lit(0).alias("run"),
    )
    found = cv.hits(segments, mp.invert(b), ["query_id"], ladder=SHORT)
    return cv.between(found, ["query_id"]).select("query_id", "tgt_ref", "start", "strand")


@query
def interval_union(spark, sf):
    b = tb.blocks(spark, sf).select(F.col("tgt_ref").alias("t"), "tgt", (F.col("tgt") + F.col("len")).alias("stop"))
    return union_intervals(b, ["t"], "tgt", "stop", chunk_bits=12, few=["t"])


@query
def version_resolver(spark, sf):
    known = tb.load(spark, sf, "lineitem").select(F.format_string("feature:F%d.%d", "l_orderkey", "l_linenumber").alias("ref"))
    asked = tb.load(spark, sf, "orders").select("o_orderkey", F.format_string("feature:F%d", "o_orderkey").alias("ref"))
    return complete_versions(asked, "ref", known)


@query
def consecutive_runs(spark, sf):
    items = tb.load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", *tb.LINE_ORDER)
    chunk = F.struct("l_linenumber", F.shiftright("l_partkey", 20).alias("part"))
    runs = consecutive_groups(items, ["l_orderkey"], tb.LINE_ORDER, ["l_returnflag"], chunk, few=["l_orderkey"])
    return runs.groupBy("l_orderkey", "island", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("units")
    )


@query
def reverse_complement(spark, sf):
    r = tb.residues(spark, sf)
    return r.select("doc_id", F.length("residues").cast("long").alias("n"), F.md5(seqs.reverse_complement(F.col("residues"))).alias("rc_md5"))


@query
def translate(spark, sf):
    r = tb.residues(spark, sf)
    return r.select("doc_id", F.md5(seqs.translate(F.col("residues"), 1)).alias("aa_md5"))


@query
def sequence_digest(spark, sf):
    """Checksums of all documents; the digest is held by its form and by whom it brings together."""
    r = tb.residues(spark, sf).select("doc_id", seqs.digest(F.col("residues")).alias("digest"), seqs.checksum_md5(F.col("residues")).alias("md5"))
    groups = digest_groups(r, key="doc_id").select(F.col("doc_id").alias("_id"), "same_as", "copies")
    form = F.col("digest").rlike("^SQ\\.[A-Za-z0-9_-]{32}$")
    return r.join(groups, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "md5", form.alias("well_formed"), F.coalesce("same_as", "doc_id").alias("same_as"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


@query
def identity_groups(spark, sf):
    """Records with the same residues, linked to one representative each (a star, never all pairs)."""
    r = tb.load(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return digest_groups(r, key="doc_id").select("doc_id", "digest", "same_as", "copies")


def _neighbour_blocks(spark, sf):
    """Every document aligned without gaps to the one before it, as far as the shorter reaches."""
    r = tb.residues(spark, sf).select("doc_id", F.length("residues").alias("n"))
    before = r.select((F.col("doc_id") + 1).alias("doc_id"), F.col("n").alias("m"))
    both = r.join(before, "doc_id").where("n > 0 AND m > 0")
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("doc_id").alias("edge_key"), F.col("doc_id").alias("src_ref"), zero.alias("src"),
        (F.col("doc_id") - 1).alias("tgt_ref"), zero.alias("tgt"), F.least("n", "m").cast("long").alias("len"),
        F.lit(False).alias("rev"),
    )


@query
def sequence_identity(spark, sf):
    table = tiles(tb.residues(spark, sf), "doc_id", size=4096)
    return alignment_identity(_neighbour_blocks(spark, sf), table, ["edge_key"], size=4096).select(
        "edge_key", F.col("identical").cast("long").alias("identical"), F.col("aligned").cast("long").alias("aligned")
    )


@query
def base_mismatches(spark, sf):
    table = tiles(tb.residues(spark, sf), "doc_id", size=4096)
    found = block_mismatches(_neighbour_blocks(spark, sf), table, ["edge_key"], size=4096)
    return found.groupBy("edge_key", "a", "b").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query
def residue_slices(spark, sf):
    table = tiles(tb.residues(spark, sf), "doc_id", size=1024)
    wanted = tb.residues(spark, sf).select(
        "doc_id", F.expr("CAST(length(residues) div 3 AS BIGINT)").alias("start"),
        F.expr("CAST(length(residues) - length(residues) div 4 AS BIGINT)").alias("end"),
        F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1).alias("strand"),
    ).where("end > start")
    cut = slices(wanted, table, ["doc_id"], "doc_id", strand="strand", size=1024)
    return cut.select("doc_id", "start", "end", F.md5("residues").alias("slice_md5"))


LOCATION_TEXT = """CASE l_linenumber
  WHEN 1 THEN concat(l_partkey + 1)
  WHEN 2 THEN concat(l_partkey + 1, '..', l_partkey + 1 + CAST(l_quantity AS BIGINT))
  WHEN 3 THEN concat('complement(<', l_partkey + 1, '..>', l_partkey + 1 + CAST(l_quantity AS BIGINT), ')')
  WHEN 4 THEN concat('complement(join(', l_suppkey + 1, '..', l_suppkey + 3, ', ', l_partkey + 9000, '))')
  WHEN 5 THEN concat('join(complement(', l_partkey + 1, '..', l_partkey + 5, '),complement(', l_suppkey + 1, '))')
  WHEN 6 THEN concat(l_partkey + 1, '^', l_partkey + 2 + l_suppkey % 2)
  ELSE concat('order(', l_partkey + 1, '.', l_partkey + 1 + CAST(l_quantity AS BIGINT), ',', l_suppkey + 1, '..',
              l_suppkey + CAST(l_quantity AS BIGINT), ')') END"""


def _location_texts(spark, sf):
    items = tb.load(spark, sf, "lineitem")
    key = F.xxhash64(*items.columns)
    return items.select(key.alias("query_id"), "l_linenumber", "l_partkey", "l_suppkey", F.expr(f"concat('refseq:NC_', l_orderkey, ':', {LOCATION_TEXT})").alias("text"))


@query
def location_canonical(spark, sf):
    parsed = parse_locations(_location_texts(spark, sf))
    text = format_location(F.col("outer"), F.col("kind"), F.col("segments"))
    return parsed.select("l_linenumber", "outer", text.alias("canonical"), F.col("error").isNotNull().alias("bad"))


@query
def location_segments(spark, sf):
    parsed = parse_locations(_location_texts(spark, sf)).where("error IS NULL")
    flat = parsed.select("outer", "kind", F.posexplode_outer("segments").alias("seg_ix", "s"))
    return flat.groupBy("outer", "kind").agg(
        F.count("*").alias("n"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends"),
        F.sum(F.col("s.strand").cast("long")).alias("strands"), F.sum(F.col("seg_ix").cast("long")).alias("places"),
    )
