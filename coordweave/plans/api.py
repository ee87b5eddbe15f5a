"""Batch counterparts of the request API: every call takes a DataFrame of inputs and returns one row per item."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.faldo import encode_location_id, faldo_json
from ..functions.location import format_location_id, parse_locations
from ..functions.namespaces import Registry, infer_namespace, namespace_of
from ..operators import dims, search
from .store import StoreSet, annotation_ids

# Preferred records of the request API.
PREFER = ("MANE Select",)


class Coordinates:
    """Conversion, description and annotation look-up over a set of stores."""

    def __init__(self, stores: StoreSet, registry: Registry | None = None):
        self.stores, self.registry = stores, registry or Registry()
        records = stores.table("sequence")
        self.records = records.withColumn("rec_ord", F.xxhash64("ref")) if "rec_ord" not in records.columns else records
        self.meta, self.edges, self.annotations = stores.meta, stores.table("edge"), stores.table("annotation")
        self.blocks, self.mismatches = stores.table("block").drop("store_ord"), stores.table("mismatch")
        self.scope = dims.sequence_scope(self.records, self.meta, self.registry)
        self.species = dims.species(self.meta, self.records, self.edges)
        self.assemblies = dims.assemblies(self.meta, self.edges, dims.species_folding(self.meta, self.records))

    @cached_property
    def graph(self) -> DataFrame:
        """Blocks of all stores as the search reads them: the stores' own tables; written on first use if one lacks them."""
        kept = self.stores.graph()
        return search.prepare_graph(self.blocks, self.edges) if kept is None else kept

    # ---- inputs -------------------------------------------------------------------------------------------------

    def read(self, df: DataFrame, text: str = "text", id_col: str = "query_id") -> DataFrame:
        """Texts to locations: database, assembly (``hg19:chr7:..``), annotation ID, or a bare accession in front."""
        head = F.regexp_extract(F.trim(text), r"^([A-Za-z][\w.-]*):([^:\s]+)(:.*)?$", 1)
        name, tail = F.regexp_extract(F.trim(text), r"^([A-Za-z][\w.-]*):([^:\s]+)(:.*)?$", 2), F.regexp_extract(F.trim(text), r"^([A-Za-z][\w.-]*):([^:\s]+)(:.*)?$", 3)
        staged = df.withColumn("_head", head).withColumn("_name", name).withColumn("_tail", tail).withColumn("_db", self.registry.knows(F.col("_head")))
        staged = dims.find_assembly(staged, "_head", self.assemblies).withColumnRenamed("assembly", "_assembly")
        aliases = dims.assembly_aliases(self.meta)
        own = self.scope.select(F.explode("in_assemblies").alias("assembly"), F.substring_index("ref", ":", -1).alias("alias"), "ref")
        table = aliases.withColumn("p", F.lit(0)).unionByName(aliases.select("assembly", F.regexp_replace("alias", "(?i)^chr", "").alias("alias"), "ref").withColumn("p", F.lit(2)))
        table = table.unionByName(aliases.select("assembly", F.concat(F.lit("chr"), "alias").alias("alias"), "ref").withColumn("p", F.lit(1))).unionByName(own.withColumn("p", F.lit(3)))
        table = table.groupBy("assembly", "alias").agg(F.min_by("ref", F.struct("p", "ref")).alias("_aref"))
        staged = staged.join(table.withColumnRenamed("assembly", "_assembly").withColumnRenamed("alias", "_name"), ["_assembly", "_name"], "left")
        if self.annotations is not None:
            ids = annotation_ids(self.annotations, self.meta).select(F.col("id_namespace").alias("_ns"), F.col("id").alias("_name"), F.col("location").alias("_spot"))
            staged = staged.withColumn("_ns", F.lower("_head")).join(ids, ["_ns", "_name"], "left")
        else:
            staged = staged.withColumn("_spot", F.lit(None).cast("string"))
        staged = staged.withColumn("_acc", F.regexp_extract(F.trim(text), r"^([^\s:]+)", 1))
        staged = infer_namespace(staged, "_acc", self.registry, self.scope.select("ref"))
        rest = F.regexp_extract(F.trim(text), r"^[^\s:]+(:.*)?$", 1)
        resolved = (
            F.when(F.col("_db"), F.col(text)).when((F.col("_tail") == "") & F.col("_spot").isNotNull(), F.col("_spot"))
            .when(F.col("_aref").isNotNull(), F.concat("_aref", "_tail")).when(F.col("guessed_ref").isNotNull() & F.col("_assembly").isNull(), F.concat("guessed_ref", rest))
            .otherwise(F.col(text))
        )
        ambiguous = F.when(~F.col("_db") & F.col("candidates").isNotNull() & F.col("_assembly").isNull() & F.col("_spot").isNull(), F.concat(F.lit("'"), "_acc", F.lit("' could be "), F.array_join("candidates", " or "), F.lit("; write the database in the input")))
        lost = F.when(F.col("_assembly").isNotNull() & ~F.col("_db") & F.col("_aref").isNull(), F.concat(F.lit("no sequence '"), "_name", F.lit("' in "), "_assembly", F.lit(" (use a name such as chr1, 1 or an accession)")))
        ready = staged.select(*df.columns, resolved.alias("_text"), F.coalesce(lost, ambiguous).alias("_refused"))
        parsed = parse_locations(ready, "_text", id_col, self.registry, self.scope.select("ref", "unit", "length"), whole_sequence=True)
        return parsed.withColumn("error", F.coalesce("_refused", "error")).drop("_text", "_refused")

    def taxon_of_name(self, name: str) -> int:
        """An NCBI taxon ID, or the scientific / common name of a loaded species (a look-up in the small species table)."""
        digits = name.lower().removeprefix("taxon:").removeprefix("ncbitaxon:")
        if digits.isdigit():
            return int(digits)
        wanted = name.strip().lower()
        common = F.regexp_extract(F.lower("n"), r"\((.*)\)\s*$", 1)
        hit = (F.lower("n") == wanted) | (F.lower(dims.plain_name(F.col("n"))) == wanted) | (common == wanted) | common.endswith(f" {wanted}")
        rows = self.species.select("taxon", F.explode("names").alias("n")).where(hit).select(F.min("taxon").alias("taxon")).where("taxon IS NOT NULL").collect()
        if not rows:
            raise ValueError(f"unknown species '{name}' (an NCBI taxon ID or a loaded organism name)")
        return rows[0].taxon

    # ---- calls --------------------------------------------------------------------------------------------------

    def convert(
        self, df: DataFrame, to=(), taxon=None, assembly: str | None = None, max_hops: int | None = None, codon: str = "auto", tag=(), db=(),
        min_match: float | None = None, max_results: int | None = None, prefer=PREFER, text: str = "text", max_units: int | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """(results, errors). ``tag``, ``db`` and ``min_match`` filter before ``max_results`` cuts each input's list.

        ``max_units``: longer inputs are refused, on request.
        """
        if min_match is not None and not 0 <= min_match <= 1:
            raise ValueError(f"minMatch must be a number between 0 and 1 (got '{min_match}')")
        if max_hops is not None and max_hops < 0:
            raise ValueError("maxHops must not be negative")
        for name in db:
            if name.lower() not in self.registry.namespaces:
                raise ValueError(f"unknown database '{name}' (a namespace such as refseq, ensembl, uniprot, pdb)")
        parsed = self.read(df, text)
        if max_units is not None:
            units = F.aggregate("segments", F.lit(0.0), lambda n, s: n + (s["end"] - s["start"]) / F.when(s["unit"] == "aa", 3).otherwise(1))
            too_long = F.concat(F.lit("input location spans "), units.cast("long"), F.lit(f" bases/residues; at most {max_units} are converted per request"))
            parsed = parsed.withColumn("error", F.coalesce("error", F.when(units > max_units, too_long)))
        errors = parsed.where("error IS NOT NULL").select("query_id", text, "error", "position")
        options = search.Options(
            to=list(to), max_hops=max_hops, prefer=list(prefer), taxon=self.taxon_of_name(str(taxon)) if taxon is not None else None, assembly=assembly,
            max_results=None if tag or db or min_match is not None else max_results,
        )
        found = search.convert(parsed.where("error IS NULL"), self.edges, self.blocks, self.scope, options, self.species, self.mismatches, self.registry, codon, graph=self.graph)
        if tag:
            found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tag])))
        if db:
            found = found.where(namespace_of(F.col("outer")).isin([d.lower() for d in db]))
        if min_match is not None:
            found = found.where(F.col("coverage") >= min_match)
        if max_results is not None and (tag or db or min_match is not None):
            found = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("result_ix"))).where(F.col("_n") <= max_results).drop("_n")
        return found, errors

    def describe(self, df: DataFrame, text: str = "text", codon: str = "auto", base: str = "") -> DataFrame:
        """Canonical ID, IRI, unit, species and assembly, FALDO JSON-LD of every input."""
        parsed = self.read(df, text)
        facts = self.scope.select(F.col("ref").alias("outer"), "unit", "category", "taxon", "assembly")
        organisms = self.species.select("taxon", F.col("organism"))
        ident = format_location_id(F.col("outer"), F.col("kind"), F.col("segments"), codon)
        joined = parsed.join(facts, "outer", "left").join(organisms, "taxon", "left").withColumn("id", ident)
        return joined.withColumn("iri", F.concat(F.lit(base), encode_location_id(F.col("id")))).withColumn("faldo", faldo_json(F.col("id"), F.col("kind"), F.col("segments"), base, codon))

    def sequence(self, refs: DataFrame) -> DataFrame:
        """Merged records of ``ref``, with their group of identical sequences."""
        groups = dims.digest_groups(self.scope).select("ref", "same_as", "copies")
        return refs.select("ref").join(self.scope, "ref").join(groups, "ref", "left")

    def edges_of(self, refs: DataFrame) -> DataFrame:
        return dims.edges_of(self.edges).join(refs.select("ref"), "ref", "left_semi")

    def annotations_of(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Annotations overlapping each input, on its own sequence."""
        parsed = self.read(df, text).where("error IS NULL")
        table = self.annotations.withColumn("annotation_ix", F.struct("store_ord", "annotation_ix"))
        met = dims.annotations_at(parsed, table, ["query_id"])
        return met.join(table.select("annotation_ix", "attributes", "provenance"), "annotation_ix")

    def annotations_across(self, df: DataFrame, assembly: str, text: str = "text") -> DataFrame:
        """Annotations recorded on another assembly: the input is lifted there, each annotation is lifted back."""
        parsed = self.read(df, text).where("error IS NULL")
        options = search.Options(to=["genome"], assembly=assembly, max_hops=1)
        there = search.convert(parsed, self.edges, self.blocks, self.scope, options, self.species, None, self.registry, graph=self.graph)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("result_ix"))
        there = there.withColumn("_nth", best).where("_nth = 1").select("query_id", "outer", "kind", "segments", F.col("id").alias("via"))
        table = self.annotations.withColumn("annotation_ix", F.struct("store_ord", "annotation_ix"))
        met = dims.annotations_at(there, table, ["query_id"]).join(there.select("query_id", "via"), "query_id")
        spots = met.select(F.col("location").alias("query_id"), F.col("location").alias("text")).distinct()
        located = parse_locations(spots, "text", "query_id", self.registry, self.scope.select("ref", "unit", "length")).where("error IS NULL")
        lifted = search.convert(located, self.edges, self.blocks, self.scope, search.Options(max_hops=1), self.species, None, self.registry, graph=self.graph)
        lifted = lifted.where("category = 'genome'").select(F.col("query_id").alias("location"), F.col("id").alias("lifted"), F.col("assembly").alias("lifted_assembly"), "result_ix")
        own = parsed.join(self.scope.select(F.col("ref").alias("outer"), F.col("assembly").alias("lifted_assembly")), "outer", "left").select("query_id", "lifted_assembly")
        first = met.join(own, "query_id").join(lifted, ["location", "lifted_assembly"], "left")
        return first.groupBy("query_id", "type", "location", "via").agg(F.min_by("lifted", "result_ix").alias("lifted"))

    def overview(self) -> dict[str, DataFrame]:
        """Stores, species, assemblies, crossings and tags."""
        return {
            "stores": self.meta, "species": self.species, "assemblies": self.assemblies, "crossings": dims.crossings(self.edges, self.scope),
            "tags": dims.tag_species(self.scope),
        }
