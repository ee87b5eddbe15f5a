"""Dimensions over an ordered set of stores: merged records, species, assemblies, scope of each sequence.

Inputs carry ``store_ord``; where stores disagree the first known value wins. Every merge is a partial aggregate
(``min_by`` over the order), never a window over one sequence's or one digest's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.namespaces import Registry, category, layer

# Database names of reference assemblies that their reports do not carry.
BROWSER_NAMES = {"GRCh38": "hg38", "GRCh37": "hg19", "GRCm39": "mm39", "GRCm38": "mm10", "T2T-CHM13v2.0": "hs1"}
# Ranks that mark a name as lying below its species.
BELOW_SPECIES = r"^([A-Z][a-z]+ [a-z][a-z-]+) (?:subsp\.|var\.|f\.|str\.|strain|substr\.|serovar|biovar|pv\.|cv\.)"
BINOMIAL = r"^[A-Z][a-z]+ [a-z][a-z-]+$"

RECORD_FIELDS = ("moltype", "unit", "length", "topology", "taxon", "organism", "digest", "md5", "gene")


def merge_records(records: DataFrame, key: str = "ref", fields: tuple[str, ...] = RECORD_FIELDS, order: tuple[str, ...] = ("store_ord", "rec_ord")) -> DataFrame:
    """One record per key: first known value per field (length 0 is unknown), tags united in order of appearance."""
    place = F.struct(*[o for o in order if o in records.columns])
    used = [f for f in fields if f in records.columns]

    def known(f: str) -> Column:
        test = F.col(f).isNotNull()
        return test & (F.col(f) != 0) if f == "length" else test

    merged = records.groupBy(key).agg(
        *[F.min_by(f, F.when(known(f), place)).alias(f) for f in used], F.min(place).alias("first_ord")
    )
    if "tags" not in records.columns:
        return merged
    tags = records.select(key, F.explode("tags").alias("_tag"), place.alias("_at")).groupBy(key, "_tag").agg(F.min("_at").alias("_at"))
    tags = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_tag"))).alias("_tags"))
    joined = merged.join(tags, key, "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("tags", F.coalesce(F.transform("_tags", lambda t: t["_tag"]), empty)).drop("_tags")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order`` (which must be unique per key)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def plain_name(name: Column) -> Column:
    """Organism name without a trailing common name in parentheses."""
    return F.trim(F.regexp_replace(name, r"\s*\(.*\)\s*$", ""))


def species_folding(meta: DataFrame, records: DataFrame) -> DataFrame:
    """``taxon, species``: taxa that are explicitly below a loaded species (by option, or by rank in the name)."""
    given = meta.where("taxon IS NOT NULL AND species_taxon IS NOT NULL").groupBy("taxon").agg(
        F.max_by("species_taxon", "store_ord").alias("species")
    )
    names = meta.select("taxon", "organism").unionByName(records.select("taxon", "organism"))
    names = names.where("taxon IS NOT NULL AND organism IS NOT NULL").select("taxon", plain_name(F.col("organism")).alias("name")).distinct()
    binomials = names.where(F.col("name").rlike(BINOMIAL)).groupBy("name").agg(F.max("taxon").alias("species"))
    below = names.withColumn("_sp", F.regexp_extract("name", BELOW_SPECIES, 1)).where("_sp <> ''")
    implied = below.join(binomials.withColumnRenamed("name", "_sp"), "_sp").where("species <> taxon")
    implied = implied.groupBy("taxon").agg(F.min("species").alias("species")).join(given, "taxon", "left_anti")
    return given.unionByName(implied)


def _fold(df: DataFrame, column: str, folding: DataFrame) -> DataFrame:
    pairs = folding.select(F.col("taxon").alias("_ft"), F.col("species").alias("_fs"))
    joined = df.join(pairs, df[column] == pairs["_ft"], "left")
    return joined.withColumn(column, F.coalesce("_fs", column)).drop("_ft", "_fs")


def assemblies(meta: DataFrame, edges: DataFrame | None = None, folding: DataFrame | None = None) -> DataFrame:
    """``name, taxon, ucsc, accession, released, annotated``: later stores of an assembly override earlier metadata."""
    rows = meta.where("assembly IS NOT NULL")
    if folding is not None:
        rows = _fold(rows, "taxon", folding)
    if edges is not None:
        counts = edges.where("kind = 'annotation'").groupBy("store_ord").agg(F.count("*").alias("_n"))
        rows = rows.join(counts, "store_ord", "left")
    else:
        rows = rows.withColumn("_n", F.lit(0))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("store_ord"))).alias(c)
    return rows.groupBy(F.col("assembly").alias("name")).agg(
        latest("taxon"), latest("ucsc"), latest("accession"), latest("released"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("annotated"), F.min("store_ord").alias("ord"),
    )


def assembly_aliases(meta: DataFrame) -> DataFrame:
    """``assembly, alias, ref``: the first store that names an alias decides; bare accessions are RefSeq."""
    flat = meta.where("assembly IS NOT NULL AND aliases IS NOT NULL").select("assembly", "store_ord", F.explode("aliases").alias("alias", "ref"))
    flat = flat.withColumn("ref", F.when(F.col("ref").contains(":"), F.col("ref")).otherwise(F.concat(F.lit("refseq:"), "ref")))
    return flat.groupBy("assembly", "alias").agg(F.min_by("ref", "store_ord").alias("ref"))


def default_assembly(table: DataFrame) -> DataFrame:
    """Per taxon: an annotated assembly, then the newest, then the most annotated; earliest loaded on ties."""
    best = F.struct(
        (F.col("annotated") > 0).alias("a"), F.coalesce("released", F.lit("")).alias("r"), F.col("annotated").alias("n"),
        (-F.col("ord")).alias("o"),
    )
    return table.where("taxon IS NOT NULL").groupBy("taxon").agg(
        F.max_by("name", best).alias("default_assembly"), F.count("*").alias("assemblies")
    )


def find_assembly(names: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Add ``assembly``: by name, name without patch level, browser name, or accession, in any case."""
    keys = table.select(
        "name", "ord",
        F.explode(F.array_distinct(F.array_compact(F.array(
            F.lower("name"), F.regexp_replace(F.lower("name"), r"\.p\d+$", ""), F.col("ucsc"), F.lower("accession"))))).alias("_key"),
    )
    keys = keys.groupBy("_key").agg(F.min_by("name", "ord").alias("assembly"))
    return names.join(keys, F.lower(names[column]) == keys["_key"], "left").drop("_key")


def species(meta: DataFrame, records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``taxon, organism (shortest name), names, taxa, assemblies, default_assembly``."""
    folding = species_folding(meta, records)
    seen = meta.select("taxon", "organism", "store_ord").unionByName(records.select("taxon", "organism", "store_ord"))
    seen = seen.where("taxon IS NOT NULL").groupBy("taxon", "organism").agg(F.min("store_ord").alias("store_ord"))
    seen = _fold(seen.withColumn("raw", F.col("taxon")), "taxon", folding)
    named = seen.groupBy("taxon").agg(
        F.min_by("organism", F.when(F.col("organism").isNotNull(), F.struct(F.length("organism").alias("l"), "store_ord", "organism"))).alias("organism"),
        F.sort_array(F.collect_set("organism")).alias("names"),
        F.sort_array(F.collect_set(F.when(F.col("raw") != F.col("taxon"), F.col("raw")))).alias("taxa"),
    )
    table = assemblies(meta, edges, folding)
    held = table.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("_a"))
    held = held.select("taxon", F.transform("_a", lambda a: a["name"]).alias("assemblies"))
    chosen = default_assembly(table).select("taxon", "default_assembly")
    return named.join(held, "taxon", "left").join(chosen, "taxon", "left")


def sequence_scope(records: DataFrame, meta: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Merged records plus ``category, layer, taxon (species), assembly, in_assemblies``.

    Taxon: own record, else the first holding store that names one, else the only taxon among identical sequences.
    """
    registry = registry or Registry()
    merged = merge_records(records)
    merged = merged.withColumn("unit", registry.unit(F.col("ref"), F.col("unit")))
    merged = merged.withColumn("category", category(F.col("ref"), F.col("unit"), F.col("moltype")))
    folding = species_folding(meta, records)
    stores = _fold(meta.select("store_ord", F.col("taxon"), F.col("assembly")), "taxon", folding)
    held = records.select("ref", "store_ord").distinct().join(stores.withColumnRenamed("taxon", "_st").withColumnRenamed("assembly", "_sa"), "store_ord")
    held = held.groupBy("ref").agg(
        F.min_by("_st", F.when(F.col("_st").isNotNull(), F.col("store_ord"))).alias("_store_taxon"),
        F.min_by("_sa", F.when(F.col("_sa").isNotNull(), F.col("store_ord"))).alias("_store_assembly"),
    )
    own = _fold(merged, "taxon", folding)
    twins = own.where("digest IS NOT NULL AND taxon IS NOT NULL").groupBy("digest").agg(
        F.min("taxon").alias("_lo"), F.max("taxon").alias("_hi")
    ).where("_lo = _hi").select("digest", F.col("_lo").alias("_twin_taxon"))
    named = assembly_aliases(meta).groupBy("ref").agg(F.sort_array(F.collect_set("assembly")).alias("_named"))
    scoped = own.join(held, "ref", "left").join(twins, "digest", "left").join(named, "ref", "left")
    genome = F.col("category") == "genome"
    empty = F.array().cast("array<string>")
    assembly = F.when(genome, F.coalesce("_store_assembly", F.get("_named", F.lit(0))))
    return scoped.withColumn("taxon", F.coalesce("taxon", "_store_taxon", "_twin_taxon")).withColumn("assembly", assembly).select(
        *merged.columns, "assembly", layer(F.col("category")).alias("layer"),
        F.array_distinct(F.concat(F.array_compact(F.array("assembly")), F.coalesce("_named", empty))).alias("in_assemblies"),
    )


def crossings(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Distinct species / assembly pairs that liftover edges connect."""
    ends = edges.where("kind = 'liftover'").select("from_ref", "to_ref").distinct()
    a = scope.select(F.col("ref").alias("from_ref"), F.col("taxon").alias("from_taxon"), F.col("assembly").alias("from_assembly"))
    b = scope.select(F.col("ref").alias("to_ref"), F.col("taxon").alias("to_taxon"), F.col("assembly").alias("to_assembly"))
    joined = ends.join(a, "from_ref", "left").join(b, "to_ref", "left")
    return joined.select("from_taxon", "to_taxon", "from_assembly", "to_assembly").distinct()


def tag_species(scope: DataFrame) -> DataFrame:
    """``tag, taxa``: species whose sequences carry a tag."""
    flat = scope.select(F.explode("tags").alias("tag"), "taxon").distinct()
    return flat.groupBy("tag").agg(F.sort_array(F.collect_set("taxon")).alias("taxa"))


def edges_of(edges: DataFrame) -> DataFrame:
    """Every edge under each of its ends (``ref``), a self-edge once."""
    outgoing = edges.select(F.col("from_ref").alias("ref"), "*")
    incoming = edges.where("from_ref <> to_ref").select(F.col("to_ref").alias("ref"), "*")
    return outgoing.unionByName(incoming)


def digest_groups(records: DataFrame, digest: str = "digest", key: str = "ref") -> DataFrame:
    """``key, digest, same_as, copies``: each copy linked to the first of its group; pairs are never formed."""
    held = records.where(F.col(digest).isNotNull()).select(key, digest)
    groups = held.groupBy(digest).agg(F.min(key).alias("same_as"), F.count("*").alias("copies")).where("copies > 1")
    return held.join(groups, digest)


def annotations_at(locations: DataFrame, annotations: DataFrame, keys: list[str], ladder=None) -> DataFrame:
    """Annotations whose own segments overlap a location, once per (key, type, location).

    Exact segments are exploded before the join, so a position inside an intron does not meet the transcript.
    """
    from .overlap import LADDER, overlap_join

    asked = locations.select(*keys, F.explode("segments").alias("s")).select(
        *keys, F.col("s.ref").alias("ref"),
        F.when(F.col("s.start") == F.col("s.end"), F.greatest(F.col("s.start") - 1, F.lit(0))).otherwise(F.col("s.start")).alias("start"),
        F.greatest(F.col("s.end"), F.col("s.start") + 1).alias("end"),
    )
    parts = annotations.select("annotation_ix", "type", "location", F.explode("segments").alias("s")).select(
        "annotation_ix", "type", "location", F.col("s.ref").alias("ref"), F.col("s.start").alias("a_start"), F.col("s.end").alias("a_end")
    )
    pairs = overlap_join(asked, parts, ["ref"], ("start", "end"), ("a_start", "a_end"), ladder or LADDER)
    return pairs.groupBy(*keys, "type", "location").agg(F.min("annotation_ix").alias("annotation_ix"))
