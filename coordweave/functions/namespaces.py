"""Sequence namespaces as Column expressions: keys, units, categories, guesses from bare accessions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accession patterns of the default namespaces.
INSDC = r"^[A-Z]{1,6}\d{5,}(?:\.\d+)?$"
REFSEQ = r"^[A-Z]{2}_[A-Z0-9]+(?:\.\d+)?$"
ENSEMBL = r"^ENS[A-Z]*[EGTPR]\d{11}(?:\.\d+)?$"
UNIPROT = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-\d+)?$"
UNIPARC = r"^UPI[0-9A-F]{10}$"
PDB = r"(?i:^(?:([0-9][A-Za-z0-9]{3})|(pdb_[0-9]{4}[0-9][A-Za-z0-9]{3}))\.([A-Za-z0-9]{1,4})$)"
REFGET = r"^SQ\.[A-Za-z0-9_-]{32}$"

# Accession forms that mean protein (aa) inside a mixed namespace.
INSDC_PROTEIN = r"^[A-Z]{3}\d"
REFSEQ_PROTEIN = r"^(?:NP|XP|YP|WP|AP|ZP)_"
ENSEMBL_PROTEIN = r"^ENS[A-Z]*P\d{11}"

# Target categories from the genome down, and the layer of each.
LAYERS = {"genome": 0, "gene_region": 1, "transcript": 2, "protein": 3, "structure": 4}
CATEGORIES = (*LAYERS, "other")

# Curated accession syntax per database, used to guess a namespace that was not written.
CURATED_PATTERNS = (
    ("refseq", r"^(?:[ANXYWZ]P_\d+)(?:\.\d+)?$"),
    ("refseq", r"^(?:(?:NM|NR|XM|XR)_\d+)(?:\.\d+)?$"),
    ("refseq", r"^(?:(?:AC_|N[CGTW]_|NZ_[A-Z]+)\d+)(?:\.\d+)?$"),
    (
        "ensembl",
        r"^(?:(?:(?:ENS[A-Z]*P\d{11})(?:\.\d+)?)|(?:FBpp\d{7})|(?:(?:MGP_[A-Za-z0-9]+_P\d{7})(?:\.\d+)?)"
        r"|(?:LRG_\d+p\d+(?:-\d)?)|(?:(?:[A-Za-z0-9][A-Za-z0-9_]+)\.t?\d+[a-z]?(?:\.\d+)?)"
        r"|(?:Y[A-Z]{2}\d{3}[A-Z](?:-[A-Z])?)|(?:Q\d{4}))$",
    ),
    (
        "ensembl",
        r"^(?:(?:(?:ENS[A-Z]*T\d{11})(?:\.\d+)?)|(?:FBtr\d{7})|(?:(?:MGP_[A-Za-z0-9]+_T\d{7})(?:\.\d+)?)"
        r"|(?:LRG_\d+t\d+(?:-\d)?)|(?:(?:[A-Za-z0-9][A-Za-z0-9_]+)\.t?\d+[a-z]?(?:\.\d+)?)"
        r"|(?:Y[A-Z]{2}\d{3}[A-Z](?:-[A-Z])?(?:_[a-z]{1,3}RNA)?)|(?:Q\d{4}_[a-z]{1,3}RNA)"
        r"|(?:[A-Z]{3}\d{1,3}(?:-\d)?_[a-z]{1,3}RNA)|(?:snR\d+-?[A-Za-z]?_sno?RNA)"
        r"|(?:t[A-Z]\(?:[ACGUX]{3}\)[A-Z]\d?_tRNA))$",
    ),
    (
        "ensembl",
        r"^(?:(?:(?:ENS[A-Z]*G\d{11})(?:\.\d+)?)|(?:FBgn\d{7})|(?:(?:MGP_[A-Za-z0-9]+_G\d{7})(?:\.\d+)?)"
        r"|(?:LRG_\d+)|(?:WBGene\d{8})|(?:Y[A-Z]{2}\d{3}[A-Z](?:-[A-Z])?)|(?:Q\d{4})"
        r"|(?:[A-Z]{3}\d{1,3}(?:-\d)?)|(?:snR\d+-?[A-Za-z]?)|(?:t[A-Z]\(?:[ACGUX]{3}\)[A-Z]\d?))$",
    ),
    (
        "uniprot",
        r"^(?:(?:[A-NR-Z][0-9](?:[A-Z][A-Z0-9][A-Z0-9][0-9]){1,2}(?:-\d+)?)"
        r"|(?:[OPQ][0-9][A-Z0-9][A-Z0-9][A-Z0-9][0-9](?:-\d+)?)(?:\.\d+)?)$",
    ),
    (
        "uniprot",
        r"^(?:(?:[A-NR-Z][0-9](?:[A-Z][A-Z0-9][A-Z0-9][0-9]){1,2}(?:-\d+))"
        r"|(?:[OPQ][0-9][A-Z0-9][A-Z0-9][A-Z0-9][0-9](?:-\d+)))$",
    ),
    (
        "insdc",
        r"^(?:insdc:)?(?:[A-Z]\d{5}|[A-Z]{2}\d{6}|[A-Z]{4}\d{8}|[A-J][A-Z]{2}\d{5}|[A-Z]{4,}\d{9})(?:\.\d+)?$",
    ),
    (
        "insdc",
        r"^(?:insdc.cds:)?(?:[A-Z]\d{5}|[A-Z]{2}\d{6}|[A-Z]{3}\d{5}|[A-Z]{4}\d{8}|[A-J][A-Z]{2}\d{5})(?:\.\d+)?$",
    ),
    ("pdb", r"^(?:[0-9][A-Za-z0-9]{3})$"),
)


def _unanchored(pattern: str) -> str:
    """A pattern without its start anchors, to stand after ``namespace:``."""
    return re.sub(r"(^|[(|:])\^", r"\1", pattern)


@dataclass(frozen=True)
class Namespace:
    """``unit`` holds unless the accession matches ``protein``; ``normalize`` rewrites a valid accession."""

    prefix: str
    pattern: str
    unit: str | None = None
    protein: str | None = None
    normalize: Callable[[Column], Column] | None = None


def _pdb_chain(acc: Column) -> Column:
    """Classic entries upper-cased, extended IDs of classic entries shortened, chains left as written."""
    classic = F.upper(F.regexp_extract(acc, PDB, 1))
    extended = F.lower(F.regexp_extract(acc, PDB, 2))
    chain = F.regexp_extract(acc, PDB, 3)
    entry = (
        F.when(classic != "", classic)
        .when(extended.startswith("pdb_0000"), F.upper(F.substring(extended, 9, 4)))
        .otherwise(extended)
    )
    return F.concat_ws(".", entry, chain)


DEFAULTS = (
    Namespace("insdc", INSDC, "nt", INSDC_PROTEIN),
    Namespace("refseq", REFSEQ, "nt", REFSEQ_PROTEIN),
    Namespace("ensembl", ENSEMBL, "nt", ENSEMBL_PROTEIN),
    Namespace("uniprot", UNIPROT, "aa"),
    Namespace("uniparc", UNIPARC, "aa"),
    Namespace("pdb", PDB, "aa", None, _pdb_chain),
    Namespace("refget", REFGET),
)


@dataclass
class Registry:
    """Ordered set of namespaces; every method builds Column expressions, so lookups run inside the JVM.

    All namespaces share one alternation over ``namespace:accession``, so a key costs one regular expression however
    many namespaces are registered.
    """

    namespaces: dict[str, Namespace] = field(default_factory=lambda: {n.prefix: n for n in DEFAULTS})

    def register(self, namespace: Namespace) -> "Registry":
        self.namespaces[namespace.prefix.lower()] = namespace
        return self

    def knows(self, prefix: Column) -> Column:
        return F.lower(prefix).isin(list(self.namespaces))

    def _valid(self, prefix: Column, accession: Column) -> Column:
        parts = [f"{re.escape(name)}:(?:{_unanchored(n.pattern)})" for name, n in self.namespaces.items()]
        return F.concat(F.lower(prefix), F.lit(":"), accession).rlike(f"^(?:{'|'.join(parts)})")

    def ref_key(self, prefix: Column, accession: Column) -> Column:
        """``prefix:accession`` normalised, NULL when either is not valid."""
        value = accession
        for name, namespace in self.namespaces.items():
            if namespace.normalize:
                value = F.when(F.lower(prefix) == name, namespace.normalize(accession)).otherwise(value)
        return F.when(self._valid(prefix, accession), F.concat(F.lower(prefix), F.lit(":"), value))

    def ref_error(self, prefix: Column, accession: Column) -> Column:
        """Why ``ref_key`` is NULL (meaningful only then)."""
        return F.when(
            ~F.coalesce(self.knows(prefix), F.lit(False)), F.concat(F.lit("unknown namespace '"), prefix, F.lit("'"))
        ).otherwise(
            F.concat(F.lit("'"), accession, F.lit("' is not a valid "), F.lower(prefix), F.lit(" accession"))
        )

    def default_unit(self, ref: Column) -> Column:
        proteins = [f"{name}:(?:{_unanchored(n.protein)})" for name, n in self.namespaces.items() if n.protein]
        proteins += [f"{name}:" for name, n in self.namespaces.items() if n.unit == "aa"]
        bases = [f"{name}:" for name, n in self.namespaces.items() if n.unit == "nt"]
        return F.when(ref.rlike(f"^(?:{'|'.join(proteins)})"), "aa").when(ref.rlike(f"^(?:{'|'.join(bases)})"), "nt")

    def unit(self, ref: Column, recorded: Column | None = None) -> Column:
        """Recorded unit, else the namespace default, else nucleotides for virtual ``#`` keys, else NULL."""
        known = [recorded] if recorded is not None else []
        return F.coalesce(*known, self.default_unit(ref), F.when(ref.contains("#"), F.lit("nt")))

    def accession_ref(self, accession: Column) -> Column:
        """Key of a bare accession in a file: Ensembl stable IDs, ``XX_`` RefSeq, anything else INSDC."""
        namespace = (
            F.when(accession.rlike(r"^ENS[A-Z]*[GTPER]\d{11}"), "ensembl")
            .when(accession.rlike(r"^[A-Z]{2}_"), "refseq")
            .otherwise("insdc")
        )
        return self.ref_key(namespace, accession)

    def guesses(self, accession: Column) -> Column:
        """Array of keys an accession without a namespace could mean, in namespace order."""
        curated = {name for name, _ in CURATED_PATTERNS}
        found: dict[str, Column] = {}
        for name, pattern in CURATED_PATTERNS:
            test = accession.rlike(pattern)
            found[name] = found[name] | test if name in found else test
        for name, namespace in self.namespaces.items():
            if name == "pdb" or name not in curated:
                test = accession.rlike(namespace.pattern)
                found[name] = found[name] | test if name in found else test
        keys = [F.when(found[name], self.ref_key(F.lit(name), accession)) for name in sorted(found)]
        return F.array_compact(F.array(*keys))


def namespace_of(ref: Column) -> Column:
    return F.substring_index(ref, ":", 1)


def accession_of(ref: Column) -> Column:
    return F.regexp_replace(ref, "^[^:]*:", "")


def category(ref: Column, unit: Column, moltype: Column | None = None) -> Column:
    """Coarse kind of a sequence from its unit, molecule type and accession conventions."""
    namespace, accession = namespace_of(ref), accession_of(ref)
    kind = moltype if moltype is not None else F.lit(None).cast("string")
    refseq = (
        F.when(accession.rlike(r"^(?:NM|NR|XM|XR)_"), "transcript")
        .when(accession.rlike(r"^NG_"), "gene_region")
        .when(accession.rlike(r"^(?:NC|NT|NW|NZ|AC)_"), "genome")
        .when(accession.rlike(r"^(?:NP|XP|YP|WP|AP)_"), "protein")
        .otherwise("other")
    )
    ensembl = (
        F.when(accession.rlike(r"^ENS[A-Z]*T\d"), "transcript")
        .when(accession.rlike(r"^ENS[A-Z]*P\d"), "protein")
        .otherwise("other")
    )
    return (
        F.when(namespace == "pdb", "structure")
        .when((unit == "aa") | (kind == "protein"), "protein")
        .when(namespace == "refseq", refseq)
        .when(namespace == "ensembl", ensembl)
        .when(namespace.isin("uniprot", "uniparc"), "protein")
        .when(kind.rlike("(?i)RNA"), "transcript")
        .when(kind == "DNA", "genome")
        .otherwise("other")
    )


def layer(cat: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, depth in LAYERS.items():
        out = F.when(cat == name, F.lit(depth)).otherwise(out)
    return out


def infer_namespace(df: DataFrame, accession: str, registry: Registry, known: DataFrame | None = None) -> DataFrame:
    """Add ``guessed_ref`` (single best key) and ``candidates`` (several equally good keys) to ``df``.

    ``known`` lists the keys that are loaded (column ``ref``); a loaded candidate beats any pattern.
    """
    keys = df.select(F.col(accession).alias("_acc")).distinct()
    keys = keys.select("_acc", F.explode(registry.guesses(F.col("_acc"))).alias("ref"))
    if known is None:
        keys = keys.withColumn("_held", F.lit(0))
    else:
        held = known.select("ref").distinct().withColumn("_held", F.lit(1))
        keys = keys.join(held, "ref", "left").fillna(0, ["_held"])
    # At most one candidate per namespace, so these groups are as small as the registry.
    best = keys.withColumn("_top", F.max("_held").over(Window.partitionBy("_acc"))).where("_held = _top")
    best = best.groupBy("_acc").agg(F.sort_array(F.collect_list("ref")).alias("_refs"))
    out = df.join(best, df[accession] == best["_acc"], "left")
    return out.select(
        *[df[c] for c in df.columns],
        F.when(F.size("_refs") == 1, F.get("_refs", F.lit(0))).alias("guessed_ref"),
        F.when(F.size("_refs") > 1, F.col("_refs")).alias("candidates"),
    )


def complete_versions(df: DataFrame, ref: str, known: DataFrame) -> DataFrame:
    """Replace version-less keys in ``df[ref]`` by the only versioned key among ``known.ref``; else leave them."""
    versions = known.where(F.col("ref").rlike(r"\.\d+$")).select(
        F.regexp_replace("ref", r"\.\d+$", "").alias("_bare"), F.col("ref").alias("_full")
    )
    unique = versions.groupBy("_bare").agg(F.min("_full").alias("_full"), F.max("_full").alias("_other"))
    unique = unique.where("_full = _other").select("_bare", "_full")
    joined = df.join(unique, df[ref] == unique["_bare"], "left")
    return joined.select(*[F.coalesce("_full", df[c]).alias(c) if c == ref else df[c] for c in df.columns])
