"""Reading a file by its name: which source it is, and its bundle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.namespaces import Registry
from .alignments import ingest_chains, ingest_paf
from .fasta import line_tiles, read_fasta, sequence_records
from .features import embedded_fasta, ingest_genbank, ingest_gff3
from .lines import Bundle, read_lines
from .tabular import assembly_report, ingest_bed, ingest_mane, ingest_sifts

# Endings of file names (before .gz) and the source they stand for.
ENDINGS = (
    (r"\.gff3?$", "gff3"),
    (r"\.(gb|gbk|gbff|gp|gpff|genbank)$", "genbank"),
    (r"\.(fa|fasta|fna|faa|ffn)$", "fasta"),
    (r"\.(over\.)?chain$", "chain"),
    (r"\.paf$", "paf"),
    (r"\.bed$", "bed"),
    (r"mane.*summary.*\.txt$", "mane"),
    (r"assembly_report.*\.txt$", "report"),
    (r"(sifts|uniprot).*\.tsv$", "sifts"),
)


def source_of(path: str) -> str:
    """The source of a file by its name; an unknown one is an error."""
    name = re.sub(r"\.b?gz$", "", path.rstrip("/").rsplit("/", 1)[-1].lower())
    for pattern, source in ENDINGS:
        if re.search(pattern, name):
            return source
    raise ValueError(f"cannot tell the format of '{path}' by its name")


def read_any(
    spark: SparkSession, path: str, names: DataFrame | None = None, to_names: DataFrame | None = None, tile_table: DataFrame | None = None,
    registry: Registry | None = None, **options,
) -> Bundle:
    """The bundle of one file. ``names`` (alias, ref) read its sequence names, ``to_names`` those of an alignment's other side."""
    registry, source = registry or Registry(), source_of(path)
    if source in ("chain", "paf", "bed") and names is None or source in ("chain", "paf") and to_names is None:
        raise ValueError(f"'{path}' needs the sequence names of its assemblies (an assembly report for each side)")
    if source == "fasta":
        records, warnings = sequence_records(read_fasta(spark, path), registry)
        return Bundle(sequences=records, warnings=warnings, residues=line_tiles(read_lines(spark, path), registry)[1])
    lines = read_lines(spark, path)
    if source == "genbank":
        return ingest_genbank(lines, registry, tile_table, **options)
    if source == "gff3":
        own = embedded_fasta(lines, registry)[1]
        bundle = ingest_gff3(lines, registry, names, tile_table if tile_table is not None else own, **options)
        bundle.residues = own
        return bundle
    if source == "chain":
        return ingest_chains(lines, names, to_names, tile_table, **options)
    if source == "paf":
        return ingest_paf(lines, names, to_names, tile_table, **options)
    if source == "bed":
        return ingest_bed(lines, names, **options)
    if source == "sifts":
        return ingest_sifts(lines, registry, tile_table, **options)
    if source == "mane":
        return ingest_mane(lines, registry)
    report = assembly_report(lines)
    return Bundle(sequences=report["sequences"].drop("file"), extra=report)
