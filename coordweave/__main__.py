"""python -m coordweave ingest FILE --out FOLDER: one file into one store."""

from __future__ import annotations

import argparse

from .plans.store import upsert_store, write_store
from .session import build_session
from .sources.dispatch import read_any
from .sources.fasta import line_tiles
from .sources.lines import read_lines
from .sources.tabular import assembly_report


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="coordweave")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="read a file by its name and write a store")
    ingest.add_argument("file")
    ingest.add_argument("--out", required=True, help="folder of the store")
    ingest.add_argument("--store", help="name of the store; the file's name if absent")
    ingest.add_argument("--report", help="assembly report whose names the file uses")
    ingest.add_argument("--to-report", help="assembly report of an alignment's other side")
    ingest.add_argument("--fasta", help="residues to check against")
    ingest.add_argument("--taxon", type=int)
    ingest.add_argument("--assembly")
    ingest.add_argument("--overwrite", action="store_true")
    ingest.add_argument("--grow", action="store_true", help="merge into the store that is there; only stores made this way can grow")
    given = parser.parse_args(arguments)

    spark = build_session()
    names = lambda path: assembly_report(read_lines(spark, path))["names"].drop("file") if path else None
    tiles = line_tiles(read_lines(spark, given.fasta))[1] if given.fasta else None
    bundle = read_any(spark, given.file, names(given.report), names(given.to_report), tiles)
    label = given.store or given.file.rstrip("/").rsplit("/", 1)[-1]
    meta = {"store": label, "label": label, "taxon": given.taxon, "assembly": given.assembly}
    if given.grow:
        upsert_store(bundle, given.out, spark, **meta)
    else:
        write_store(bundle, given.out, spark, given.overwrite, **meta)


if __name__ == "__main__":
    main()
