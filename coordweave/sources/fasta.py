"""FASTA: residues, sequence records with checksums, keys from headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.namespaces import Registry
from ..functions.sequences import checksum_md5, digest
from ..operators.ordered import running_sum
from ..operators.residues import TILE, tiles_of_parts
from .lines import provenance, read_records


def split_records(records: DataFrame) -> DataFrame:
    """Raw records (header line + residue lines) to ``header, id, residues`` (upper case, no white space)."""
    text = F.regexp_replace("value", r"\A>", "")
    header = F.trim(F.regexp_extract(text, r"\A([^\r\n]*)", 1))
    body = F.upper(F.regexp_replace(F.regexp_replace(text, r"\A[^\r\n]*", ""), r"\s+", ""))
    keep = [c for c in records.columns if c != "value"]
    out = records.select(*keep, header.alias("header"), F.regexp_extract(header, r"^(\S*)", 1).alias("id"), body.alias("residues"))
    return out.where("header <> '' OR residues <> ''")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return split_records(read_records(spark, path, "\n>"))


def line_tiles(lines: DataFrame, registry: Registry | None = None, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(headers, tiles) of FASTA lines ``file, place, value``: no row is longer than a tile, however long a record is.

    ``headers``: ``file, record_no, header, ref, length``. ``tiles``: ``ref, tile_ix, tile_off, residues``. A line belongs to
    the latest header before it (a running count per split of the file), and its residues start where the lines before it
    end (a running sum per split).
    """
    registry = registry or Registry()
    split = F.col("place.split")
    used = lines.withColumn("_head", F.col("value").startswith(">").cast("long"))
    numbered = running_sum(used, ["file"], ["place"], F.col("_head"), split, "_before").withColumn("record_no", F.col("_before") + F.col("_head"))
    named = numbered.where("_head = 1").withColumn("header", F.trim(F.substring("value", F.lit(2), F.length("value"))))
    named = named.select("file", "record_no", "header", header_ref(F.col("header"), registry).alias("ref"))
    data = numbered.where("_head = 0 AND record_no > 0").select("file", "record_no", "place", F.upper(F.regexp_replace("value", r"\s+", "")).alias("text"))
    joined = tiles_of_parts(data, ["file", "record_no"], size)
    sizes = joined.groupBy("file", "record_no").agg(F.sum(F.length("residues")).alias("length"))
    headers = named.join(sizes, ["file", "record_no"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    tiles = joined.join(named.where("ref IS NOT NULL").select("file", "record_no", "ref"), ["file", "record_no"])
    return headers, tiles.select("ref", "tile_ix", F.lit(0).alias("tile_off"), "residues")


def header_ref(header: Column, registry: Registry) -> Column:
    """Key from a header: UniProt entries, PDB chains (protein only), Ensembl, RefSeq / INSDC accessions."""
    first = F.regexp_extract(F.trim(header), r"^(\S*)", 1)
    uniprot = F.regexp_extract(first, r"^(?:sp|tr)\|([^|]+)\|", 1)
    entry, chain = F.regexp_extract(first, r"^([0-9][A-Za-z0-9]{3})_(\S+)$", 1), F.regexp_extract(first, r"^([0-9][A-Za-z0-9]{3})_(\S+)$", 2)
    namespace = F.when(uniprot != "", "uniprot").when(entry != "", "pdb").when(first.rlike(r"^ENS[A-Z]*[GTPER]\d{11}"), "ensembl").when(
        first.rlike(r"^[A-Z]{2}_"), "refseq"
    ).otherwise("insdc")
    accession = F.when(uniprot != "", uniprot).when(entry != "", F.concat_ws(".", entry, chain)).otherwise(first)
    protein_chain = (entry == "") | header.rlike(r"\bmol:protein\b")
    return F.when(protein_chain, registry.ref_key(namespace, accession))


def sequence_records(fasta: DataFrame, registry: Registry | None = None, unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sequence records, warnings). Residues are not kept: only length and checksums."""
    registry = registry or Registry()
    keyed = fasta.withColumn("ref", header_ref(F.col("header"), registry))
    units = F.lit(unit) if unit else F.coalesce(registry.default_unit(F.col("ref")), F.lit("aa"))
    keyed = keyed.withColumn("unit", units)
    transcript = F.col("ref").rlike(r"^(?:refseq:[NX][MR]_|ensembl:ENS[A-Z]*T\d)")
    moltype = F.when(F.col("unit") == "aa", "protein").when(transcript, "RNA").otherwise("DNA")
    taxon, organism = F.regexp_extract("header", r"\bOX=(\d+)", 1), F.regexp_extract("header", r"\bOS=(.+?)(?= [A-Z]{2}=|$)", 1)
    file = F.col("file") if "file" in fasta.columns else None
    records = keyed.where("ref IS NOT NULL").select(
        "ref", moltype.alias("moltype"), "unit", F.length("residues").cast("long").alias("length"),
        F.when(taxon != "", taxon.cast("long")).alias("taxon"), F.when(organism != "", organism).alias("organism"),
        digest(F.col("residues")).alias("digest"), checksum_md5(F.col("residues")).alias("md5"),
        provenance("fasta", F.col("ref"), file).alias("provenance"),
    )
    warnings = keyed.where("ref IS NULL").select(
        F.concat(F.lit("FASTA header '"), F.substring("header", 1, 60), F.lit("' has no recognised accession; skipped")).alias("message")
    )
    return records, warnings
