"""Mappings as tables of ungapped blocks: ``edge_key, ix, src_ref, src, tgt_ref, tgt, len, rev``.

A mapping is a bag of blocks; ``ix`` is its registration order, used only to break ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlap import LADDER, overlap_join

BLOCK = "edge_key string, ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean"
MAX_INTEGER = 2**53 - 1


def block_error(src: str = "src", tgt: str = "tgt", length: str = "len") -> Column:
    """Why a block is invalid, NULL for a good one."""
    too_big = F.greatest(src, tgt, length) > MAX_INTEGER
    bad = F.col(src).isNull() | F.col(tgt).isNull() | F.col(length).isNull()
    bad = bad | (F.col(src) < 0) | (F.col(tgt) < 0) | (F.col(length) <= 0) | too_big
    return F.when(
        F.coalesce(bad, F.lit(True)),
        F.concat(F.lit("invalid block "), F.to_json(F.struct(src, tgt, F.col(length).alias("len")))),
    )


def split_valid(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid blocks, quarantined blocks with ``error``)."""
    checked = blocks.withColumn("error", block_error())
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def project(rev: Column, src: Column, tgt: Column, length: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Target interval of the source sub-interval [a, b) of a block."""
    lo = F.when(rev, tgt + length - (b - src)).otherwise(tgt + (a - src))
    hi = F.when(rev, tgt + length - (a - src)).otherwise(tgt + (b - src))
    return lo, hi


def invert(blocks: DataFrame) -> DataFrame:
    swap = {"src_ref": "tgt_ref", "tgt_ref": "src_ref", "src": "tgt", "tgt": "src"}
    swap |= {"src_unit": "tgt_unit", "tgt_unit": "src_unit"}
    return blocks.select(*[F.col(swap.get(c, c) if swap.get(c, c) in blocks.columns else c).alias(c) for c in blocks.columns])


def concat(*mappings: DataFrame) -> DataFrame:
    """All blocks, each later mapping ordered after the earlier ones: ``ix`` becomes the pair (mapping, ix)."""
    placed = [m.withColumn("ix", F.struct(F.lit(n).alias("mapping"), F.col("ix").alias("ix"))) for n, m in enumerate(mappings)]
    return reduce(DataFrame.unionByName, placed)


def compose(
    ab: DataFrame, bc: DataFrame, ladder: tuple[int, ...] = LADDER, by: list[str] | None = None, reindex: bool = False
) -> DataFrame:
    """Blocks a->c through every overlap of an a->b target with a b->c source, ordered by (a_ix, b_ix).

    ``by`` adds equality columns (e.g. the edge) that both mappings must share. ``reindex`` numbers the result per
    ``src_ref``; without it the two source indices stay as they are and no further shuffle happens.
    """
    by = by or []
    a = ab.select(
        *by, F.col("ix").alias("a_ix"), F.col("src_ref").alias("a_ref"), F.col("src").alias("a_src"),
        F.col("tgt_ref").alias("via"), F.col("tgt").alias("a_tgt"), (F.col("tgt") + F.col("len")).alias("a_stop"),
        F.col("rev").alias("a_rev"),
    )
    b = bc.select(
        *by, F.col("ix").alias("b_ix"), F.col("src_ref").alias("via"), F.col("src").alias("b_src"),
        (F.col("src") + F.col("len")).alias("b_stop"), F.col("tgt_ref").alias("b_ref"), F.col("tgt").alias("b_tgt"),
        F.col("rev").alias("b_rev"),
    )
    pairs = overlap_join(a, b, [*by, "via"], ("a_tgt", "a_stop"), ("b_src", "b_stop"), ladder)
    lo, hi = F.greatest("a_tgt", "b_src"), F.least("a_stop", "b_stop")
    out = pairs.select(
        *by,
        "a_ix",
        "b_ix",
        F.col("a_ref").alias("src_ref"),
        (F.col("a_src") + F.when(F.col("a_rev"), F.col("a_stop") - hi).otherwise(lo - F.col("a_tgt"))).alias("src"),
        F.col("b_ref").alias("tgt_ref"),
        (F.col("b_tgt") + F.when(F.col("b_rev"), F.col("b_stop") - hi).otherwise(lo - F.col("b_src"))).alias("tgt"),
        (hi - lo).alias("len"),
        (F.col("a_rev") != F.col("b_rev")).alias("rev"),
    )
    if not reindex:
        return out
    order = Window.partitionBy(*by, "src_ref").orderBy("a_ix", "b_ix")
    return out.withColumn("ix", F.row_number().over(order).cast("long") - 1).drop("a_ix", "b_ix")


def segment_offsets(segments: Column) -> Column:
    """Segments with ``ix`` and ``off``, their offset along the location (one pass over the array)."""
    empty = F.array().cast("array<struct<ix:int,off:bigint,seg:struct<ref:string,start:bigint,end:bigint,strand:int>>>")
    narrow = F.transform(
        segments,
        lambda s: F.struct(
            s["ref"].alias("ref"), s["start"].alias("start"), s["end"].alias("end"), s["strand"].cast("int").alias("strand")
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        item = F.struct(F.size(acc["out"]).alias("ix"), acc["at"].alias("off"), s.alias("seg"))
        return F.struct((acc["at"] + s["end"] - s["start"]).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(narrow, start, step, lambda acc: acc["out"])


def from_location(df: DataFrame, feature: str = "feature_ref", segments: str = "segments", keep: list[str] | None = None) -> DataFrame:
    """Feature axis 0..L -> the sequences of its location. Between-positions make ``error`` (they have no length)."""
    keep = keep or []
    placed = df.select(*keep, F.col(feature).alias("src_ref"), F.explode_outer(segment_offsets(F.col(segments))).alias("x"))
    return placed.where("x IS NOT NULL").select(
        *keep,
        F.col("x.ix").cast("long").alias("ix"),
        "src_ref",
        F.col("x.off").alias("src"),
        F.col("x.seg.ref").alias("tgt_ref"),
        F.col("x.seg.start").alias("tgt"),
        (F.col("x.seg.end") - F.col("x.seg.start")).alias("len"),
        (F.col("x.seg.strand") == -1).alias("rev"),
        F.when(
            F.col("x.seg.end") == F.col("x.seg.start"), "a feature location cannot contain between-positions"
        ).alias("error"),
    )


def location_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def cds_error(segments: Column, codon_start: Column, aa_length: Column, leading: Column) -> Column:
    """Why a coding location cannot map its protein, NULL when it fits."""
    phase = codon_start - 1
    skip = F.when(leading, 3 - phase).otherwise(0)
    need = F.when(leading, 0).otherwise(phase) + 3 * aa_length - skip
    text = lambda c: c.cast("string")
    return (
        F.when(~codon_start.isin(1, 2, 3), F.concat(F.lit("codon_start must be 1, 2 or 3 (got "), text(codon_start), F.lit(")")))
        .when(aa_length.isNull() | (aa_length < 1), F.concat(F.lit("invalid aaLength "), F.coalesce(text(aa_length), F.lit("NaN"))))
        .when(leading & (codon_start == 1), "leadingPartialCodon needs codon_start 2 or 3")
        .when(
            need > location_length(segments),
            F.concat(
                text(aa_length), F.lit(" aa (codon_start "), text(codon_start), F.lit(") do not fit in a "),
                text(location_length(segments)), F.lit(" nt CDS"),
            ),
        )
    )


def clip_to_coding(placed: DataFrame, codon_start: Column, aa_length: Column, leading: Column, keep: list[str]) -> DataFrame:
    """Blocks ``src_ref, ix, src (offset), tgt_ref, tgt, len, rev`` of a coding location -> blocks of its protein units.

    A leading partial codon is the protein's first residue, of which only the last ``codon_start - 1`` units exist.
    """
    phase = (codon_start - 1).cast("long")
    skip = F.when(leading, 3 - phase).otherwise(0).cast("long")
    begin = F.when(leading, F.lit(0)).otherwise(phase).cast("long")
    staged = placed.withColumn("_skip", skip).withColumn("_begin", begin)
    staged = staged.withColumn("_lo", F.greatest("src", "_begin"))
    staged = staged.withColumn("_hi", F.least(F.col("src") + F.col("len"), F.col("_begin") + 3 * aa_length - F.col("_skip")))
    kept = staged.where("_lo < _hi")
    tgt = F.when(F.col("rev"), F.col("tgt") + F.col("src") + F.col("len") - F.col("_hi")).otherwise(
        F.col("tgt") + F.col("_lo") - F.col("src")
    )
    return kept.select(
        *keep, "ix", "src_ref", (F.col("_skip") + F.col("_lo") - F.col("_begin")).cast("long").alias("src"), "tgt_ref",
        tgt.cast("long").alias("tgt"), (F.col("_hi") - F.col("_lo")).cast("long").alias("len"), "rev",
    )


def cds_mapping(
    df: DataFrame,
    protein: str = "protein",
    segments: str = "segments",
    codon_start: str = "codon_start",
    aa_length: str = "aa_length",
    leading: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Protein codon units -> nucleotides of its coding location. Rows must have passed ``cds_error``."""
    keep = keep or []
    lead = F.col(leading) if leading else F.lit(False)
    options = df.withColumn("_start", F.col(codon_start)).withColumn("_aa", F.col(aa_length)).withColumn("_lead", lead)
    placed = from_location(options, protein, segments, [*keep, "_start", "_aa", "_lead"])
    return clip_to_coding(placed, F.col("_start"), F.col("_aa"), F.col("_lead"), keep)


def residue_blocks(df: DataFrame, src_begin: str, tgt_begin: str, length: str) -> DataFrame:
    """1-based residue numbering -> codon-unit blocks (adds src, tgt, len, rev)."""
    three = F.lit(3).cast("long")
    return df.select(
        *[c for c in df.columns if c not in (src_begin, tgt_begin, length)],
        (three * (F.col(src_begin) - 1)).alias("src"),
        (three * (F.col(tgt_begin) - 1)).alias("tgt"),
        (three * F.col(length)).alias("len"),
        F.lit(False).alias("rev"),
    )


def oriented(blocks: DataFrame, directional: str = "directional") -> DataFrame:
    """Blocks readable from either end: each as stored, plus its inverse unless the edge is directional."""
    forward = blocks.withColumn("inverse", F.lit(False))
    backward = invert(blocks.where(~F.col(directional))).withColumn("inverse", F.lit(True))
    return forward.unionByName(backward)
