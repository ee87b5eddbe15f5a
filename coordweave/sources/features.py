"""Annotated records: GFF3 and GenBank / GenPept, from text to edges and annotations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.location import SEGMENT, extent, format_location_id, parse_locations
from ..functions.namespaces import Registry
from ..functions.sequences import checksum_md5, digest, infer_protein_length, three_prime_partial
from ..operators.mapping import cds_error, cds_mapping, from_location, location_length, segment_offsets
from ..operators.ordered import by_size, carry_latest, running_sum
from ..operators.residues import TILE, alignment_identity, checksums_of_parts, extract_locations, tiles_of_parts
from ..operators.validate import expected, validate_cds, validate_transcript, verdict
from ..session import cut_lineage
from .alignments import gap_runs
from .fasta import line_tiles
from .lines import EDGE_COLUMNS, Bundle, attributes, edge_key, edge_order, provenance, with_once

# Feature types with a special reading.
RNA_TYPES = ("mRNA", "ncRNA", "rRNA", "tRNA", "misc_RNA", "precursor_RNA", "tmRNA", "lnc_RNA", "primary_transcript", "transcript")
ALIGNMENT_TYPES = ("cDNA_match", "EST_match", "match", "nucleotide_match", "translated_nucleotide_match", "protein_match")
TRANSCRIPT_PARTS = (
    "exon", "CDS", "five_prime_UTR", "three_prime_UTR", "start_codon", "stop_codon", "intron", "polyA_signal_sequence",
    "polyA_site", "transcription_start_site", "mature_protein_region_of_CDS", "signal_peptide_region_of_CDS",
)


def uri_decode(text: Column) -> Column:
    """Percent-decoding only: a plus sign stays a plus sign."""
    return F.when(text.contains("%"), F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)


# ---- GFF3 ------------------------------------------------------------------------------------------------------------


def parse_gff3(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, regions, errors) of GFF3 lines ``file, place, value``; a ``##FASTA`` section ends the rows of its file."""
    end = lines.where("startswith(value, '##FASTA')").groupBy("file").agg(F.min("place").alias("_end"))
    # A row per file: sent to the lines, as a join by file would bring all lines of a file to one task.
    used = lines.join(F.broadcast(end), "file", "left").where("_end IS NULL OR place < _end")
    words = F.split(F.trim("value"), r"\s+")
    regions = used.where("startswith(value, '##sequence-region')").select(
        uri_decode(F.get(words, F.lit(1))).alias("seqid"), F.get(words, F.lit(3)).try_cast("long").alias("length")
    )
    regions = regions.groupBy("seqid").agg(F.max("length").alias("length"))
    cells = with_once(used.where("value <> '' AND NOT startswith(value, '#')"), "f", F.split("value", "\t", -1))
    errors = cells.where("size(f) <> 9").select("file", "place", F.concat(F.lit("expected 9 columns, found "), F.size("f")).alias("message"))
    c = lambda i: F.get("f", F.lit(i))
    malformed = (F.size("f") == 9) & (c(3).try_cast("long").isNull() | c(4).try_cast("long").isNull())
    errors = errors.unionByName(cells.where(malformed).select("file", "place", F.concat(F.lit("malformed coordinates: "), c(3), F.lit(", "), c(4)).alias("message")))
    pairs = F.filter(F.split(c(8), ";"), lambda p: p.contains("="))
    named = F.transform(
        pairs,
        lambda p: F.struct(
            uri_decode(F.substring_index(p, "=", 1)).alias("key"),
            F.transform(F.split(F.substr(p, F.locate("=", p) + 1), F.lit(","), F.lit(-1)), uri_decode).alias("value"),
        ),
    )
    rows = cells.where((F.size("f") == 9) & ~malformed).withColumn("_a", named)
    # The last value of a repeated name wins.
    last = F.filter("_a", lambda p, i: ~F.exists(F.slice("_a", i + 2, F.size("_a") + 1), lambda q: q["key"] == p["key"]))
    rows = rows.select(
        "file", "place", uri_decode(c(0)).alias("seqid"), c(1).alias("source"), c(2).alias("type"), c(3).try_cast("long").alias("start"),
        c(4).try_cast("long").alias("end"), F.when(c(5) != ".", c(5).try_cast("double")).alias("score"),
        F.when(c(6).isin("+", "-", ".", "?"), c(6)).otherwise(".").alias("strand"), F.when(c(7).isin("0", "1", "2"), c(7).cast("int")).alias("phase"),
        F.map_from_entries(last).alias("attributes"), F.md5("value").alias("line"),
    )
    return rows, regions, errors


def embedded_fasta(lines: DataFrame, registry: Registry | None = None, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(headers, tiles) of the ``##FASTA`` sections of GFF3 lines."""
    begin = lines.where("startswith(value, '##FASTA')").groupBy("file").agg(F.min("place").alias("_begin"))
    return line_tiles(lines.join(F.broadcast(begin), "file").where("place > _begin").drop("_begin"), registry, size)


def first_attribute(name: str, column: str = "attributes") -> Column:
    return F.get(F.try_element_at(F.col(column), F.lit(name)), F.lit(0))


def group_features(rows: DataFrame) -> DataFrame:
    """Rows sharing (seqid, ID) form one feature wherever they stand; rows without an ID stand alone."""
    # A row without an ID is named by its line (and its number among equal lines), which no split of the file can change.
    named = rows.withColumn("id", first_attribute("ID"))
    alone = named.where("id IS NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("file", "line").orderBy("place")))
    alone = alone.withColumn("key", F.concat(F.lit("\x00"), "line", F.lit("."), "_nth")).drop("_nth")
    keyed = named.where("id IS NOT NULL").withColumn("key", F.col("id")).unionByName(alone)
    row = F.struct("place", "start", "end", "strand", "phase", first_attribute("start_range").alias("from_mark"), F.get(F.try_element_at("attributes", F.lit("end_range")), F.lit(1)).alias("to_mark"), first_attribute("Target").alias("target"), first_attribute("Gap").alias("gap"))
    return keyed.groupBy("file", "seqid", "key").agg(
        F.first("id", ignorenulls=True).alias("id"), F.min_by("type", "place").alias("type"), F.min_by("attributes", "place").alias("attributes"),
        F.min("place").alias("place"), F.array_sort(F.collect_list(row)).alias("rows"),
    )


def rows_to_segments(rows: Column, ref: Column, length: Column, circular: Column) -> Column:
    """Rows to segments in traversal order. Both strands (trans-splicing): as in the file; else by position, reversed on minus.

    On a circular molecule, rows past the end wrap around.
    """
    strands = F.size(F.array_distinct(F.transform(rows, lambda r: r["strand"])))
    sorted_rows = F.array_sort(rows, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["place"] < y["place"], -1).when(x["place"] > y["place"], 1).otherwise(0))
    minus = F.get(rows, F.lit(0))["strand"] == "-"
    ordered = F.when(strands > 1, rows).when(minus, F.reverse(sorted_rows)).otherwise(sorted_rows)

    def segment(r: Column, start: Column, end: Column, low: Column, high: Column) -> Column:
        strand = F.when(r["strand"] == "-", -1).otherwise(1)
        return F.struct(ref.alias("ref"), start.alias("start"), end.alias("end"), strand.alias("strand"), low.alias("fuzzy_low"), high.alias("fuzzy_high"), F.lit(False).alias("uncertain"), F.lit("nt").alias("unit")).cast(SEGMENT)

    def wrapped(r: Column) -> Column:
        low, high = F.coalesce(r["from_mark"] == ".", F.lit(False)), F.coalesce(r["to_mark"] == ".", F.lit(False))
        start, end = r["start"] - 1, r["end"]
        plain = F.array(segment(r, start, end, low, high))
        moved = F.array(segment(r, start - length, end - length, low, high))
        head, tail = segment(r, start, length, low, F.lit(False)), segment(r, F.lit(0).cast("long"), end - length, F.lit(False), high)
        both = F.when(r["strand"] == "-", F.array(tail, head)).otherwise(F.array(head, tail))
        return F.when(circular & (end > length), F.when(start >= length, moved).otherwise(both)).otherwise(plain)

    return F.flatten(F.transform(ordered, wrapped))


def _attribute_ref(id_: Column, version: Column, registry: Registry) -> Column:
    versioned = F.when(version.isNotNull() & ~id_.rlike(r"\.\d+$"), F.concat(id_, F.lit("."), version)).otherwise(id_)
    return registry.accession_ref(versioned)


def ingest_gff3(
    lines: DataFrame, registry: Registry | None = None, names: DataFrame | None = None, tile_table: DataFrame | None = None,
    proteins: DataFrame | None = None, transcripts: DataFrame | None = None, exclude: tuple[str, ...] = ("exon",), tile_size: int = TILE,
) -> Bundle:
    """Edges (CDS, transcripts, alignments), annotations and molecule / protein records of GFF3 lines.

    ``names`` (alias, ref) reads seqids; ``tile_table`` holds residues; ``proteins`` / ``transcripts`` (ref, residues)
    the published sequences to check against.
    """
    registry = registry or Registry()
    rows, regions, errors = parse_gff3(lines)
    if names is not None:
        keyed = rows.join(names.select(F.col("alias").alias("_al"), F.col("ref").alias("_named")), rows["seqid"] == F.col("_al"), "left").drop("_al")
    else:
        keyed = rows.withColumn("_named", registry.accession_ref(F.col("seqid")))
    unknown = keyed.where("_named IS NULL").select(F.concat(F.lit("seqid '"), "seqid", F.lit("' is not a known accession")).alias("message")).distinct()
    molecules = keyed.where("type = 'region' AND _named IS NOT NULL").groupBy(F.col("seqid").alias("_seqid")).agg(
        F.max(F.coalesce(first_attribute("Is_circular") == "true", F.lit(False))).alias("circular"),
        F.min_by(F.get(F.filter(F.try_element_at("attributes", F.lit("Dbxref")), lambda x: x.startswith("taxon:")), F.lit(0)), "place").alias("_tx"),
        F.min_by(first_attribute("mol_type"), "place").alias("mol_type"), F.min_by("end", "place").alias("region_end"),
    )
    molecules = molecules.withColumn("taxon", F.regexp_extract("_tx", r"^taxon:(\d+)", 1).try_cast("long")).drop("_tx")
    held = keyed.where("_named IS NOT NULL").select(F.col("seqid").alias("_seqid"), F.col("_named").alias("ref")).distinct()
    held = held.join(regions.withColumnRenamed("seqid", "_seqid"), "_seqid", "left").join(molecules, "_seqid", "left")
    held = held.withColumn("circular", F.coalesce("circular", F.lit(False)))
    features = group_features(keyed.where("_named IS NOT NULL AND type <> 'region'").drop("_named"))
    features = features.join(held, features["seqid"] == held["_seqid"]).drop("_seqid")
    aligned_type = F.col("type").isin(*ALIGNMENT_TYPES) | first_attribute("Target").isNotNull()
    alignments, located = features.where(aligned_type), features.where(~aligned_type)

    # Transcripts stand where their exons stand.
    names_transcript = first_attribute("transcript_id").isNotNull() & ~F.col("type").isin(*TRANSCRIPT_PARTS)
    is_transcript = F.col("id").isNotNull() & (F.col("type").isin(*RNA_TYPES) | names_transcript)
    located = located.withColumn("is_transcript", is_transcript)
    exons = located.where("type = 'exon'").select("file", "seqid", F.explode(F.try_element_at("attributes", F.lit("Parent"))).alias("id"), F.explode("rows").alias("r"))
    exons = exons.groupBy("file", "seqid", "id").agg(F.array_sort(F.collect_list("r")).alias("exon_rows"))
    # Rows without an ID (most parts of transcripts) would all meet in one task of the join; only transcripts need it.
    none = F.lit(None).cast(dict(exons.dtypes)["exon_rows"]).alias("exon_rows")
    joined = located.where("is_transcript").join(exons, ["file", "seqid", "id"], "left")
    located = joined.unionByName(located.where("NOT is_transcript").select("*", none))
    used = F.when(F.col("is_transcript") & F.col("exon_rows").isNotNull(), F.col("exon_rows")).otherwise(F.col("rows"))
    located = located.withColumn("segments", rows_to_segments(used, F.col("ref"), F.col("length"), F.col("circular")))
    beyond = ~F.col("circular") & F.exists("segments", lambda s: s["end"] > F.col("length"))
    located = located.withColumn("_beyond", F.coalesce(beyond, F.lit(False)))
    label = F.concat(F.col("type"), F.lit(" "), F.coalesce("id", F.lit("line")))
    too_long = located.where("_beyond").select(F.concat("seqid", F.lit(": "), label, F.lit(": extends past the end of a linear sequence; feature skipped")).alias("message"))
    located = located.where("NOT _beyond").withColumn("location", format_location_id(F.col("ref"), F.lit("join"), F.col("segments")))
    located = located.withColumn("provenance", provenance("gff3", F.col("seqid"), F.col("file"), label))
    annotations = located.where(~F.col("type").isin(*exclude)).select(
        F.col("place").alias("annotation_ix"), "type", "location", "segments", "attributes", extent(F.col("ref"), F.col("segments")).alias("extent"), "provenance"
    )

    exception = first_attribute("exception")
    t = located.where("is_transcript").withColumn("from_ref", _attribute_ref(first_attribute("transcript_id"), first_attribute("version"), registry)).where("from_ref IS NOT NULL")
    t = t.withColumn("edge_key", edge_key(F.lit("gff3"), "file", "from_ref", "ref", "location", F.coalesce("id", F.lit(""))))
    t_edges = _transcript_edges(t, tile_table, transcripts, exception, tile_size)
    t_blocks = from_location(t, "from_ref", "segments", ["edge_key"]).drop("error")

    c = located.where("type = 'CDS'").withColumn("from_ref", _attribute_ref(first_attribute("protein_id"), first_attribute("version"), registry))
    no_protein = c.where("from_ref IS NULL").where(~F.coalesce(first_attribute("pseudo") == "true", F.lit(False))).select(F.concat("seqid", F.lit(": CDS "), F.coalesce("id", F.lit("")), F.lit(": no protein_id; no protein edge")).alias("message"))
    c = c.where("from_ref IS NOT NULL").withColumn("edge_key", edge_key(F.lit("gff3"), "file", "from_ref", "ref", "location", F.coalesce("id", F.lit(""))))
    first = F.get("segments", F.lit(0))
    leading_row = F.get(F.filter("rows", lambda r: F.when(first["strand"] == 1, r["start"] - 1 == first["start"]).otherwise(r["end"] == first["end"])), F.lit(0))
    c = c.withColumn("codon_start", F.coalesce(leading_row["phase"], F.get("rows", F.lit(0))["phase"], F.lit(0)) + 1)
    c = c.select(
        "edge_key", "from_ref", F.col("ref").alias("to_ref"), "segments", "location", "provenance", "codon_start", "taxon",
        first_attribute("transl_table").try_cast("int").alias("given_table"), F.try_element_at("attributes", F.lit("transl_except")).alias("transl_except"),
        exception.alias("exception"), first_attribute("gene").alias("gene"), first_attribute("product").alias("product"), F.lit(False).alias("slippage"),
        F.lit(None).cast("long").alias("own_length"), F.lit(None).cast("string").alias("translation"),
    )
    cds = _cds_edges(c, tile_table, proteins, ("protein sequence", "inferred"), guess_table=True, tile_size=tile_size)
    a = _target_edges(alignments, registry, tile_table, tile_size)
    moltype = F.when(F.col("mol_type").rlike("(?i)RNA"), "RNA").otherwise("DNA")
    molecule_records = held.select(
        "ref", moltype.alias("moltype"), F.lit("nt").alias("unit"), F.coalesce("length", "region_end", F.lit(0).cast("long")).alias("length"),
        F.when(F.col("circular"), "circular").otherwise("linear").alias("topology"), "taxon", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("md5"),
        provenance("gff3", F.col("_seqid")).alias("provenance"),
    )
    warnings = errors.select("message").unionByName(unknown).unionByName(too_long).unionByName(no_protein).unionByName(cds.warnings).unionByName(a.warnings)
    return Bundle(
        sequences=molecule_records.unionByName(cds.sequences), edges=t_edges.unionByName(cds.edges).unionByName(a.edges),
        blocks=t_blocks.unionByName(cds.blocks).unionByName(a.blocks), annotations=annotations, warnings=warnings,
    )


def _edges(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("kind", F.lit(kind)).withColumn("directional", F.lit(False)).withColumn("edge_ord", edge_order(F.col("edge_key"))).select(*EDGE_COLUMNS)


def _transcript_edges(t: DataFrame, tile_table, transcripts, exception: Column, tile_size: int) -> DataFrame:
    base = t.select("edge_key", "from_ref", F.col("ref").alias("to_ref"), "segments", "location", "provenance", F.col("type").alias("_type"), exception.alias("_exc"))
    if tile_table is not None and transcripts is not None:
        base = extract_locations(base, tile_table, ["edge_key"], tile_size, "_model")
        base = base.join(transcripts.select(F.col("ref").alias("from_ref"), F.upper("residues").alias("_own")), "from_ref", "left")
    else:
        base = base.withColumn("_model", F.lit(None).cast("string")).withColumn("_own", F.lit(None).cast("string"))
    base = base.withColumn("_len", location_length(F.col("segments")))
    check = validate_transcript(F.col("_model"), F.col("_own"), F.col("from_ref"), F.col("_len"), F.col("location"))
    base = base.withColumn("_v", check)
    return _edges(base.withColumn("validation", expected(F.col("_v"), F.col("_exc"))).withColumn("attributes", attributes(type=F.col("_type"), exception=F.col("_exc"))), "annotation")


def _cds_edges(c: DataFrame, tile_table, proteins, sources: tuple[str, str], guess_table: bool, tile_size: int) -> Bundle:
    """CDS rows (location, codon start, table, ...) to protein edges. A published protein decides length and check."""
    if proteins is not None:
        c = c.join(proteins.select(F.col("ref").alias("from_ref"), F.upper("residues").alias("_published")), "from_ref", "left")
        c = c.withColumn("translation", F.coalesce("translation", "_published")).drop("_published")
    if tile_table is not None:
        c = extract_locations(c, tile_table, ["edge_key"], tile_size, "_nt")
    else:
        c = c.withColumn("_nt", F.lit(None).cast("string"))
    known = F.coalesce(F.length("translation").cast("long"), F.col("own_length"))
    leading = F.lit(guess_table) & (F.col("codon_start") > 1) & F.coalesce(F.substring("translation", 1, 1) == "X", F.lit(False))
    c = c.withColumn("_known", known).withColumn("_lead", leading).withColumn("_table", F.coalesce("given_table", F.lit(1)))
    inferred = infer_protein_length(location_length(F.col("segments")), F.col("codon_start"), three_prime_partial(F.col("segments")))
    needs = F.when(F.col("_lead"), 3 * F.col("_known") - 3 + F.col("codon_start") - 1).otherwise(3 * F.col("_known") + F.col("codon_start") - 1)
    fits = F.coalesce(needs <= location_length(F.col("segments")), F.lit(False)) if guess_table else F.col("_known").isNotNull()
    c = c.withColumn("aa_length", F.when(fits, F.col("_known")).otherwise(inferred))
    c = c.withColumn("_error", cds_error(F.col("segments"), F.col("codon_start"), F.col("aa_length"), F.col("_lead")))
    warnings = c.where("_error IS NOT NULL").select(F.concat(F.col("provenance.record"), F.lit(": "), F.coalesce("provenance.feature", F.lit("CDS")), F.lit(": "), "_error").alias("message"))
    good = c.where("_error IS NULL").withColumn("_off", segment_offsets(F.col("segments")))
    check = validate_cds(
        F.col("_nt"), F.col("segments"), F.col("_off"), F.col("codon_start"), F.col("_table"), F.col("aa_length"), F.col("translation"), F.col("transl_except"),
        F.col("_lead"), F.col("given_table").isNotNull() if guess_table else F.lit(True), F.col("exception"),
    )
    good = good.withColumn("_v", check)
    own = F.coalesce(F.col("aa_length") == F.col("_known"), F.lit(False)) & F.col("_known").isNotNull()
    facts = good.withColumn("validation", verdict(F.col("_v.status"), F.col("_v.detail"), F.col("_v.basis"))).withColumn(
        "attributes",
        attributes(
            codonStart=F.col("codon_start"), translTable=F.coalesce("_v.table", "_table"), aaLength=F.col("aa_length"), aaLengthSource=F.when(own, sources[0]).otherwise(sources[1]),
            leadingPartialCodon=F.when(F.col("_lead"), "true"), gene=F.col("gene"), product=F.col("product"), exception=F.col("exception"), ribosomalSlippage=F.when(F.col("slippage"), "true"),
        ),
    )
    records = good.select(
        F.col("from_ref").alias("ref"), F.lit("protein").alias("moltype"), F.lit("aa").alias("unit"), F.coalesce("_known", "aa_length").alias("length"), F.lit(None).cast("string").alias("topology"),
        F.col("taxon"), digest(F.col("translation")).alias("digest"), checksum_md5(F.col("translation")).alias("md5"), "provenance",
    )
    blocks = cds_mapping(good, "from_ref", "segments", "codon_start", "aa_length", "_lead", ["edge_key"])
    return Bundle(sequences=records, edges=_edges(facts, "annotation"), blocks=blocks, warnings=warnings)


def target_blocks(alignments: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(checked features, blocks) of Target / Gap rows. Gaps follow the genome along the row's strand; one bad row drops
    the whole feature."""
    keys = ["file", "seqid", "key"]
    flat = alignments.select(*keys, F.col("ref").alias("tgt_ref"), F.posexplode("rows").alias("row_ix", "r"))
    words = F.split(F.coalesce(F.col("r.target"), F.lit("")), r"\s+")
    flat = flat.withColumn("tid", F.get(words, F.lit(0))).withColumn("ts", F.get(words, F.lit(1)).try_cast("long")).withColumn("te", F.get(words, F.lit(2)).try_cast("long"))
    flat = flat.withColumn("tstrand", F.coalesce(F.get(words, F.lit(3)), F.lit("+"))).withColumn("src_ref", registry.accession_ref(F.col("tid")))
    whole = F.concat(F.lit("M"), (F.col("r.end") - F.col("r.start") + 1).cast("string"))
    flat = flat.withColumn("g", gap_runs(F.coalesce(F.col("r.gap"), whole)))
    error = (
        F.when(F.expr("src_ref IS NULL OR ts IS NULL OR te IS NULL"), "unusable Target")
        .when(~F.col("r.strand").isin("+", "-") | ~F.col("tstrand").isin("+", "-"), "unstranded alignment rows are not supported")
        .when(F.col("g.bad").isNotNull(), F.concat(F.lit("Gap operation '"), "g.bad", F.lit("' is not supported")))
        .when(F.col("g.g") != F.col("r.end") - F.col("r.start") + 1, "Gap does not span the row")
        .when(F.col("g.t") != F.col("te") - F.col("ts") + 1, "Gap does not span the Target range")
    )
    flat = flat.withColumn("error", error)
    checked = flat.groupBy(*keys).agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_ix"))).alias("error"), F.min("src_ref").alias("from_ref"), F.max("src_ref").alias("_other")
    )
    checked = checked.withColumn("error", F.coalesce("error", F.when(F.col("from_ref") != F.col("_other"), "rows target different sequences"))).drop("_other")
    up, along = F.col("r.strand") == "+", F.col("tstrand") == "+"
    runs = flat.select("*", F.posexplode("g.runs").alias("run_ix", "m"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("row_ix", "run_ix")) - 1
    blocks = runs.select(
        *keys, nth.cast("long").alias("ix"), "src_ref",
        F.when(along, F.col("ts") - 1 + F.col("m.t")).otherwise(F.col("te") - F.col("m.t") - F.col("m.n")).alias("src"), "tgt_ref",
        F.when(up, F.col("r.start") - 1 + F.col("m.g")).otherwise(F.col("r.end") - F.col("m.g") - F.col("m.n")).alias("tgt"), F.col("m.n").alias("len"), (up != along).alias("rev"),
    )
    return checked, blocks


def _target_edges(alignments: DataFrame, registry: Registry, tile_table, tile_size: int) -> Bundle:
    keys = ["file", "seqid", "key"]
    checked, raw = target_blocks(alignments, registry)
    joined = alignments.join(checked, keys)
    label = F.concat("seqid", F.lit(": "), "type", F.lit(" "), F.coalesce("id", F.lit("")), F.lit(": "), "error")
    warnings = joined.where("error IS NOT NULL").select(label.alias("message"))
    good = joined.where("error IS NULL").withColumn("edge_key", edge_key(F.lit("gff3"), *keys, "from_ref", "ref"))
    blocks = raw.join(good.select(*keys, "edge_key"), keys).select("edge_key", "ix", "src_ref", "src", "tgt_ref", "tgt", "len", "rev")
    kept = {n: first_attribute(n) for n in ("identity", "pct_coverage", "pct_identity_gap", "num_mismatch", "gap_count")}
    facts = good.select(
        "edge_key", "from_ref", F.col("ref").alias("to_ref"), F.lit(None).cast("string").alias("location"), attributes(type=F.col("type"), **kept).alias("attributes"),
        provenance("gff3", F.col("seqid"), F.col("file"), F.concat("type", F.lit(" "), F.coalesce("id", F.lit("line")))).alias("provenance"), kept["num_mismatch"].try_cast("long").alias("_said"),
    )
    if tile_table is not None:
        facts = facts.join(alignment_identity(blocks, tile_table, ["edge_key"], 1, tile_size), "edge_key", "left")
        differing = F.col("aligned") - F.col("identical")
        said = F.when(F.col("_said").isNull(), "").otherwise(F.concat(F.lit("; num_mismatch="), "_said", F.when(F.col("_said") != differing, F.concat(F.lit(" (counted "), differing, F.lit(")"))).otherwise("")))
        detail = F.concat("identical", F.lit("/"), "aligned", F.lit(" aligned bases identical"), said)
        status = F.when(F.col("identical") >= F.col("aligned") * 0.5, "ok").otherwise("mismatch")
        check = F.when(F.col("identical").isNull(), verdict("skipped", "sequences not available")).otherwise(verdict(status, detail, "full"))
    else:
        check = verdict("skipped", "sequences not available")
    return Bundle(edges=_edges(facts.withColumn("validation", check), "alignment"), blocks=blocks, warnings=warnings)


# ---- GenBank / GenPept -----------------------------------------------------------------------------------------------

#: Words that open a section whose lines are used; a line belongs to the last one before it. 0 is the end of a record.
_SECTIONS = ("//", "LOCUS", "DEFINITION", "ACCESSION", "VERSION", "FEATURES", "ORIGIN")
_HEADER, _TABLE, _SEQUENCE = 0, 1, 2

_QUALIFIER = r'\n {21}/([^=\n"]+)(?:=("[^"]*+(?:""[^"]*+)*+"|[^\n]*))?'


def _qualifier_value(raw: Column, name: Column) -> Column:
    glue = F.when(name == "translation", F.regexp_replace(raw, r"\s*\n\s*", "")).otherwise(F.regexp_replace(raw, r"\s*\n\s*", " "))
    quoted = glue.startswith('"') & glue.endswith('"') & (F.length(glue) > 1)
    return F.when(quoted, F.regexp_replace(glue.substr(F.lit(2), F.length(glue) - 2), '""', '"')).otherwise(glue)


def _qualifier(q: Column) -> Column:
    name = F.trim(F.regexp_extract(q, r"^\n {21}/([^=\n]+)", 1))
    raw = F.trim(F.regexp_extract(q, r"(?s)^\n {21}/[^=\n]+=(.*)$", 1))
    return F.struct(name.alias("name"), _qualifier_value(raw, name).alias("value"))


@dataclass
class FlatFile:
    """What the lines of flat-file records hold; ``rec`` (the place of a LOCUS line) and ``file`` name a record.

    ``records``: what stands before the features. ``features``: ``f_ix, key, location, qualifiers`` in order, flags as ''.
    ``residues``: ``place, text`` of the sequence lines.
    """

    records: DataFrame
    features: DataFrame
    residues: DataFrame


def parse_genbank(lines: DataFrame) -> FlatFile:
    """Flat-file records from their lines (``file, place, value``); no row holds more than a line or a feature.

    What a line belongs to follows from the latest LOCUS line, section word and feature key at or before it: a state that is
    carried along the lines, per split of the file. Lines before the first LOCUS and after a ``//`` belong to nothing.
    """
    value, row = F.col("value"), F.col("place.row")
    # The number of a line, and with it the number of its section word: both grow along the lines.
    known, first = len(_SECTIONS), F.substring(value, 1, 1)
    word = F.when(value.startswith("//"), F.lit("//")).when((first >= "A") & (first <= "Z"), F.regexp_extract(value, "^([A-Z]+)", 1))
    code = F.when(word.isNotNull(), F.coalesce(*[F.when(word == w, F.lit(i)) for i, w in enumerate(_SECTIONS)], F.lit(known)))
    named_feature = value.startswith("     ") & ~F.substring(value, 6, 1).isin("", " ", "\t", "\n", "\x0b", "\f", "\r")
    marks = {"rec": F.when(word == "LOCUS", row), "section": row * (known + 1) + code, "f_place": F.when(named_feature, row)}
    plain = lines.select("file", "place", F.replace(F.col("value"), F.lit("\r"), F.lit("")).alias("value"))
    told = carry_latest(plain, ["file"], "place.row", marks, F.col("place.split"))
    place_of = lambda name, n: F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.chunk").alias("split"), n.alias("row")))
    state = F.struct(
        place_of("rec", F.col("rec.value")).alias("rec"), place_of("f_place", F.col("f_place.value")).alias("f_place"),
        place_of("section", F.expr(f"section.value div {known + 1}")).alias("section"), (F.col("section.value") % (known + 1)).alias("code"),
    )
    told = with_once(told, "_state", state).select("file", "place", "value", "_state.*").where("rec IS NOT NULL AND section >= rec")
    table, sequence, header = (F.col("code") == _SECTIONS.index("FEATURES")), (F.col("code") == _SECTIONS.index("ORIGIN")), F.col("code").between(1, 4)
    part = F.when(header, _HEADER).when(table & (F.col("f_place") > F.col("section")), _TABLE).when(sequence & (F.col("place") > F.col("section")), _SEQUENCE)
    told = cut_lineage(told.select("file", "place", "value", "rec", F.when(table, F.col("f_place")).alias("f_place"), part.alias("part")).where("part IS NOT NULL"))
    record = ["file", "rec"]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    header = told.where(F.col("part") == _HEADER).groupBy(*record).agg(F.concat(F.lit("\n"), whole).alias("_t"))
    locus = F.split(F.regexp_extract("_t", r"\nLOCUS\s+([^\n]*)", 1), r"\s+")
    rest = F.slice(locus, 4, 100)
    pick = lambda test: F.get(F.filter(rest, test), F.lit(0))
    named = lambda head: F.nullif(F.regexp_extract("_t", rf"\n{head}\s+(\S+)", 1), F.lit(""))
    definition = F.regexp_replace(F.regexp_extract("_t", r"\nDEFINITION\s+([^\n]*(?:\n[^A-Z\n][^\n]*)*+)", 1), r"\s*\n\s*", " ")
    records = header.select(
        *record, F.get(locus, F.lit(0)).alias("name"), F.get(locus, F.lit(1)).try_cast("long").alias("length"),
        F.when(F.get(locus, F.lit(2)) == "aa", "aa").otherwise("bp").alias("unit"), pick(lambda x: x.rlike("(?i)(?:DNA|RNA)$")).alias("moltype"),
        pick(lambda x: x.isin("linear", "circular")).alias("topology"), pick(lambda x: x.rlike("^[A-Z]{3}$")).alias("division"), named("ACCESSION").alias("accession"),
        named("VERSION").alias("version"), F.nullif(definition, F.lit("")).alias("definition"),
    )
    blocks = lambda rows: rows.groupBy(*record, "f_place").agg(whole.alias("_block"))
    # The lines of a record with few of them are moved once, for its features and for their numbers.
    within = Window.partitionBy(*record).orderBy("f_place")
    numbered = by_size(
        told.where(F.col("part") == _TABLE), record,
        lambda rows: blocks(rows.repartition(*record)).withColumn("f_ix", (F.row_number().over(within) - 1).cast("long")),
        lambda rows: running_sum(blocks(rows), record, ["f_place"], F.lit(1), F.col("f_place.split"), "f_ix"),
    )
    body = F.concat(F.lit("\n"), F.lit(" " * 21), F.substring("_block", F.lit(22), F.length("_block")))
    place = F.regexp_replace(F.regexp_extract(body, r"(?s)^(.*?)(?:\n {21}/|$)", 1), r"\s+", "")
    found = F.transform(F.regexp_extract_all(body, F.lit(f"({_QUALIFIER})"), F.lit(1)), _qualifier)
    features = cut_lineage(numbered.select(*record, F.trim(F.substring("_block", 6, 16)).alias("key"), place.alias("location"), found.alias("qualifiers"), "f_ix"))
    text = F.upper(F.regexp_replace("value", "[^A-Za-z]", ""))
    residues = told.where(F.col("part") == _SEQUENCE).select(*record, "place", text.alias("text")).where("text <> ''")
    return FlatFile(records, features, residues)


def _q(name: str) -> Column:
    return F.get(F.filter("qualifiers", lambda q: q["name"] == name), F.lit(0))["value"]


def _qs(name: str) -> Column:
    return F.transform(F.filter("qualifiers", lambda q: q["name"] == name), lambda q: q["value"])


def ingest_genbank(lines: DataFrame, registry: Registry | None = None, tile_table: DataFrame | None = None, transcripts: DataFrame | None = None, exclude: tuple[str, ...] = ("exon",), tile_size: int = TILE) -> Bundle:
    """Edges, annotations and records of flat-file records; their own residues serve the checks."""
    registry = registry or Registry()
    flat_file, record = parse_genbank(lines), ["file", "rec"]
    acc = F.coalesce("version", "accession", "name")
    parsed = flat_file.records.withColumn("acc", acc).withColumn("ref", registry.accession_ref(F.col("acc")))
    skipped = parsed.where("ref IS NULL").select(F.concat("acc", F.lit(": not an INSDC/RefSeq accession; record skipped")).alias("message"))
    parsed = parsed.where("ref IS NOT NULL").withColumn("_unit", F.when(F.col("unit") == "aa", "aa").otherwise("nt"))
    source = flat_file.features.where("key = 'source'").groupBy(*record).agg(F.min_by("qualifiers", "f_ix").alias("_source"))
    value = lambda test: F.get(F.filter("_source", test), F.lit(0))["value"]
    taxon = F.regexp_extract(value(lambda q: (q["name"] == "db_xref") & q["value"].startswith("taxon:")), r"^taxon:(\d+)", 1).try_cast("long")
    parsed = parsed.join(source, record, "left").withColumn("taxon", taxon).withColumn("organism", value(lambda q: q["name"] == "organism")).drop("_source")
    parsed = cut_lineage(parsed)
    moltype = F.when(F.col("unit") == "aa", "protein").when(F.col("moltype").rlike("(?i)RNA"), "RNA").otherwise("DNA")
    id_ = F.concat_ws("|", "file", F.col("rec.split"), F.col("rec.row"))
    sums = checksums_of_parts(flat_file.residues.withColumn("id", id_)).select(F.col("id").alias("_id"), "digest", "md5")
    own = parsed.join(sums, id_ == F.col("_id"), "left").select(
        "ref", moltype.alias("moltype"), F.col("_unit").alias("unit"), "length", "topology", "taxon", "digest", "md5", provenance("gbff", F.col("acc")).alias("provenance"), "organism",
    )
    of_record = flat_file.residues.join(parsed.select(*record, "ref", "unit"), record)
    residues = tiles_of_parts(of_record.where("unit <> 'aa'").select(*record, "ref", "place", "text"), [*record, "ref"], tile_size)
    residues = residues.select("ref", "tile_ix", F.lit(0).alias("tile_off"), "residues")
    known = residues if tile_table is None else residues.unionByName(tile_table)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    proteins = of_record.where("unit = 'aa'").groupBy(*record).agg(F.array_join(listed, "").alias("rec_sequence"))
    flat = flat_file.features.where("key <> 'source'").join(parsed.select(*record, "ref", "acc", "_unit", F.col("length").alias("rec_length"), "taxon", "organism"), record)
    flat = flat.withColumn("fid", F.concat_ws("|", "ref", "f_ix")).withColumn("text", F.concat("ref", F.lit(":"), "location")).withColumnRenamed("location", "raw_location")
    units = parsed.select("ref", F.col("_unit").alias("unit"), F.lit(0).cast("long").alias("length")).distinct()
    located = parse_locations(flat, "text", "fid", registry, units)
    label = F.concat("key", F.lit(" "), "raw_location")
    bad = located.where("error IS NOT NULL").select(F.concat("acc", F.lit(": "), label, F.lit(": "), "error").alias("message"))
    good = located.where("error IS NULL").withColumn("canonical", format_location_id(F.col("outer"), F.col("kind"), F.col("segments")))
    good = good.withColumn("provenance", provenance("gbff", F.col("acc"), None, label))
    multi = F.filter("qualifiers", lambda q: q["name"] != "translation")
    names = F.array_distinct(F.transform(multi, lambda q: q["name"]))
    as_map = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(multi, lambda q: q["name"] == n), lambda q: q["value"])))
    annotations = good.where(~F.col("key").isin(*exclude)).select(
        F.struct(F.crc32("ref").alias("split"), F.col("f_ix").cast("long").alias("row")).alias("annotation_ix"), F.col("key").alias("type"), F.col("canonical").alias("location"), "segments",
        as_map.alias("attributes"), extent(F.col("outer"), F.col("segments")).alias("extent"), "provenance",
    )
    exception = _q("exception")
    t = good.where(F.col("key").isin(*RNA_TYPES)).withColumn("from_ref", registry.accession_ref(_q("transcript_id"))).where("from_ref IS NOT NULL")
    t = t.withColumn("edge_key", edge_key(F.lit("gbff"), "from_ref", "ref", "canonical")).withColumn("location", F.col("canonical")).withColumn("type", F.col("key"))
    t_edges = _transcript_edges(t, known, transcripts, F.when(exception == "", "true").otherwise(exception), tile_size)
    t_blocks = from_location(t, "from_ref", "segments", ["edge_key"]).drop("error")

    coding = good.where("key = 'CDS'").where(_q("pseudo").isNull())
    columns = [
        F.coalesce(_q("codon_start").try_cast("int"), F.lit(1)).alias("codon_start"), "taxon", F.coalesce(_q("transl_table").try_cast("int"), F.lit(1)).alias("given_table"), _qs("transl_except").alias("transl_except"),
        F.when(exception == "", "true").otherwise(exception).alias("exception"), _q("gene").alias("gene"), _q("product").alias("product"), _q("ribosomal_slippage").isNotNull().alias("slippage"),
    ]
    nt = coding.where("_unit = 'nt'").withColumn("from_ref", registry.accession_ref(_q("protein_id")))
    unusable = nt.where("from_ref IS NULL").select(F.concat("acc", F.lit(": "), label, F.lit(": CDS without a usable /protein_id")).alias("message"))
    direct = nt.where("from_ref IS NOT NULL").select(
        edge_key(F.lit("gbff"), "from_ref", "ref", "canonical").alias("edge_key"), "from_ref", F.col("ref").alias("to_ref"), "segments", F.col("canonical").alias("location"), "provenance",
        F.lit(None).cast("long").alias("own_length"), F.upper(_q("translation")).alias("translation"), *columns,
    )
    # GenPept: the protein's record names the nucleotides that code for it.
    aa = coding.where("_unit = 'aa'").join(proteins, record, "left").withColumn("coded_by", F.regexp_replace(_q("coded_by"), r"\s+", ""))
    aa = aa.withColumn("coded_ref", registry.accession_ref(F.regexp_extract("coded_by", r"([A-Za-z0-9_]+\.\d+):", 1)))
    unusable = unusable.unionByName(aa.where("coded_ref IS NULL").select(F.concat("acc", F.lit(": CDS without a usable /coded_by")).alias("message")))
    back = aa.where("coded_ref IS NOT NULL").select(F.col("fid").alias("cid"), F.concat("coded_ref", F.lit(":"), "coded_by").alias("ctext"))
    back = parse_locations(back, "ctext", "cid", registry).where("error IS NULL").select("cid", F.col("outer").alias("c_outer"), F.col("kind").alias("c_kind"), F.col("segments").alias("c_segments"))
    coded = aa.join(back, aa["fid"] == back["cid"]).withColumn("c_text", format_location_id(F.col("c_outer"), F.col("c_kind"), F.col("c_segments"))).select(
        edge_key(F.lit("gbff"), "ref", "c_outer", "c_text").alias("edge_key"), F.col("ref").alias("from_ref"), F.col("c_outer").alias("to_ref"), F.col("c_segments").alias("segments"),
        F.col("c_text").alias("location"), provenance("gbff", F.col("acc"), None, F.concat(F.lit("CDS coded_by "), "coded_by")).alias("provenance"), F.col("rec_length").alias("own_length"),
        F.col("rec_sequence").alias("translation"), *columns,
    )
    cds = _cds_edges(direct.unionByName(coded), known, None, ("translation", "inferred"), guess_table=False, tile_size=tile_size)
    made = cds.sequences.join(own.select("ref"), "ref", "left_anti").join(direct.select(F.col("from_ref").alias("ref")).distinct(), "ref", "left_semi")
    made = made.withColumn("organism", F.lit(None).cast("string"))
    return Bundle(
        sequences=own.unionByName(made), edges=t_edges.unionByName(cds.edges), blocks=t_blocks.unionByName(cds.blocks), annotations=annotations,
        warnings=skipped.unionByName(bad).unionByName(unusable).unionByName(cds.warnings), residues=residues,
    )
