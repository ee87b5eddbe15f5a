"""Registered queries over store dimensions, search rules and file formats (lines are derived from the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import namespaces as ns
from ..functions.faldo import faldo_json
from ..functions.location import format_location, format_location_id, parse_locations
from ..functions.namespaces import Registry
from ..operators import dims, search
from ..operators.residues import tiles
from ..operators.validate import MAX_MISMATCH_RATE, align_proteins, sampled_identity
from ..sources import alignments as al
from ..sources import fasta, features, tabular
from ..sources.lines import with_once
from . import tables as tb
from .store import summary as store_counts
from .queries import SHORT, _location_texts, _neighbour_blocks, query


def _place(split, row):
    return F.struct(split.cast("long").alias("split"), row.cast("long").alias("row")).alias("place")


def _line(df, text: str):
    """One text line per line item, ordered along its order; splits are ranges of orders."""
    placed = df.select("*", F.lit("lines").alias("file"), _place(F.shiftright("f", 10), F.col("f") * (1 << 24) + F.col("src") + 1))
    return with_once(placed, "value", F.expr(text)).select("file", "place", "value")


def _items(spark, sf):
    return tb.layout(spark, sf).withColumn("start", F.col("tgt")).withColumn("stop", F.col("tgt") + F.col("len"))


# ---- dimensions ----------------------------------------------------------------------------------------------------


@query
def record_merge(spark, sf):
    """Orders as records of their customer: first known value per field in order of the key, tags united."""
    records = tb.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("ref"), F.col("o_orderkey").alias("store_ord"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("moltype"),
        F.when(F.col("o_totalprice") > 200000, F.floor("o_totalprice")).otherwise(0).cast("long").alias("length"), F.array("o_orderpriority").alias("tags"),
    )
    merged = dims.merge_records(records)
    return merged.select("ref", "moltype", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.array_join("tags", "|").alias("tags"))


@query
def first_record(spark, sf):
    events = tb.load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return dims.first_per_key(events, ["user_id", "event_type"], ["event_id"])


@query
def edge_cost(spark, sf):
    flags = {"A": "annotation", "N": "alignment", "R": "liftover"}
    kind = F.create_map(*[F.lit(x) for p in flags.items() for x in p])[F.col("l_returnflag")]
    base = tb.load(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", kind.alias("kind"), F.when(F.col("l_linenumber") % 3 == 0, "protein-alignment").alias("adapter"),
        F.struct(
            F.when(F.col("l_discount") > 0.09, "mismatch").when(F.col("l_discount") > 0.02, "ok").otherwise("skipped").alias("status"),
            F.lit(None).cast("string").alias("detail"), F.when(F.col("l_tax") > 0.04, "full").otherwise("partial").alias("basis"),
        ).alias("validation"),
        F.when(F.col("l_linestatus") == "F", F.create_map(F.lit("exception"), F.lit("x"))).otherwise(F.create_map(F.lit("gene"), F.lit("y"))).alias("attributes"),
    )
    apx = search.is_approximate(F.col("attributes"), F.col("validation"))
    scored = base.withColumn("approximate", apx).withColumn("cost", search.edge_cost(F.col("kind"), F.col("adapter"), F.col("approximate")))
    return scored.groupBy("kind", "approximate", "cost").agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


@query
def alignment_shadow(spark, sf):
    """Annotation lines of an (order, supplier) pair that an alignment line of the same pair hides."""
    kind = F.when(F.col("l_returnflag") == "A", "annotation").when(F.col("l_returnflag") == "N", "alignment").otherwise("liftover")
    items = tb.load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_orderkey").alias("from_ref"), F.col("l_suppkey").alias("to_ref"), kind.alias("edge_kind"))
    kept = search.without_shadowed(items, ["l_orderkey"])
    return kept.groupBy(F.col("to_ref").alias("l_suppkey"), "l_returnflag").agg(F.count("*").alias("n"))


@query
def default_assembly(spark, sf):
    """Customers as assemblies of their nation: with positive balance first, then the largest segment name, then balance."""
    table = tb.load(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("taxon"), F.col("c_mktsegment").alias("released"),
        F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("long").alias("annotated"), F.col("c_custkey").alias("ord"),
    )
    return dims.default_assembly(table)


@query
def edges_of_sequence(spark, sf):
    edges = tb.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("from_ref"), F.col("l_suppkey").alias("to_ref"), "l_linenumber")
    return dims.edges_of(edges).groupBy("ref").agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


@query
def annotation_overlap(spark, sf):
    """Events as points on their user's time axis against an hour and a half around every active hour."""
    events = tb.load(spark, sf, "events").select("event_id", F.col("user_id").alias("ref"), tb.seconds("ts").alias("at"))
    hours = events.select("ref", F.expr("at div 3600").alias("hour")).distinct()
    windows = hours.select("ref", "hour", F.greatest(F.col("hour") * 3600 - 900, F.lit(0)).alias("start"), (F.col("hour") * 3600 + 4500).alias("end"))
    segment = lambda lo, hi: F.array(F.struct("ref", lo.alias("start"), hi.alias("end")))
    points = events.select(
        F.col("event_id").alias("annotation_ix"), F.lit("event").alias("type"), F.col("event_id").cast("string").alias("location"), segment(F.col("at"), F.col("at") + 1).alias("segments")
    )
    asked = windows.select(F.col("ref").alias("user"), "hour", segment(F.col("start"), F.col("end")).alias("segments"))
    met = dims.annotations_at(asked, points, ["user", "hour"], (13,))
    return met.groupBy(F.col("user").alias("ref"), "hour").agg(F.count("*").alias("n"), F.min("annotation_ix").alias("first_event"))


@query
def mismatch_lookup(spark, sf):
    """Differing bases of an edge inside the blocks of the same edge, as a search lists them."""
    items = _items(spark, sf).withColumn("edge_key", F.concat_ws(":", "f", "t"))
    letter = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    wrong = items.select("edge_key", F.col("t").alias("ref"), (F.col("tgt") + F.col("len") % 13).alias("pos"), letter(F.col("len")).alias("a"), letter(F.col("len") + 1).alias("b"))
    spans = items.select(F.col("src").alias("block"), "edge_key", F.col("t").alias("ref"), "start", F.col("stop").alias("end"))
    return search.differences_on(spans, wrong, ["block"], SHORT).select("edge_key", "block", F.array_join("_bases", ";").alias("bases"))


@query
def store_summary(spark, sf):
    """Counts of a store whose edges are lines, whose sequences are parts and whose annotations are events."""
    sequences = tb.load(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_brand")).alias("moltype"), F.when(F.col("p_size") != 7, F.col("p_size")).alias("taxon"))
    edges = tb.load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"))
    return store_counts(sequences, edges, tb.blocks(spark, sf), tb.load(spark, sf, "events"))


@query
def category_of(spark, sf):
    heads = ("NC", "NM", "NG", "NP", "XR", "QQ", "NT")
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), F.col("l_linenumber"))
    refs = tb.load(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", F.concat(F.lit("refseq:"), head, F.lit("_"), "l_orderkey").alias("ref"))
    unit = Registry().unit(F.col("ref"))
    kind = ns.category(F.col("ref"), unit, F.when(F.col("l_returnflag") == "R", "RNA"))
    return refs.select(kind.alias("category"), unit.alias("unit"), F.coalesce(ns.layer(kind), F.lit(-1)).alias("layer")).groupBy("category", "unit", "layer").agg(F.count("*").alias("n"))


@query
def namespace_guess(spark, sf):
    text = F.expr("""CASE l_linenumber WHEN 1 THEN concat('NP_', l_orderkey) WHEN 2 THEN concat('NM_', l_orderkey, '.2') WHEN 3 THEN 'P07203'
        WHEN 4 THEN concat('ENST', lpad(l_orderkey, 11, '0')) WHEN 5 THEN concat('AB', lpad(l_orderkey, 6, '0')) WHEN 6 THEN '4hhb.A' ELSE 'nothing' END""")
    asked = tb.load(spark, sf, "lineitem").select("l_linenumber", text.alias("acc"))
    out = ns.infer_namespace(asked, "acc", Registry())
    return out.groupBy("l_linenumber", F.substring_index("guessed_ref", ":", 1).alias("namespace"), F.array_join(F.transform("candidates", lambda c: F.substring_index(c, ":", 1)), "|").alias("several")).agg(F.count("*").alias("n"))


@query
def location_faldo(spark, sf):
    parsed = parse_locations(_location_texts(spark, sf))
    ident = format_location_id(F.col("outer"), F.col("kind"), F.col("segments"))
    text = faldo_json(ident, F.col("kind"), F.col("segments"), "https://example.org/")
    return parsed.select("l_linenumber", "text", F.when(F.col("error").isNull(), text).alias("faldo"))


# ---- formats -------------------------------------------------------------------------------------------------------

CIGAR = "concat(len, 'M', 1 + src % 4, 'I', 2 + len % 5, '=', 3, 'X', 1 + len % 3, 'D', 1 + src % 6, 'M')"


@query
def paf_alignments(spark, sf):
    text = f"concat_ws('\\t', concat('q', f), 100000, src, src + len + 1 + src % 4 + 5 + len % 5 + 1 + src % 6, if(rev, '-', '+'), concat('t', t), 1000000, tgt, tgt + 60, len, len + 9, 60, 'tp:A:P', concat('AS:i:', len), concat('cg:Z:', {CIGAR}))"
    records = al.parse_paf(_line(_items(spark, sf), text))
    return al.paf_blocks(records, ["qname", "tname"]).groupBy("qname").agg(
        F.count("*").alias("blocks"), F.sum("src").alias("src_sum"), F.sum("tgt").alias("tgt_sum"), F.sum("len").alias("len_sum")
    )


@query
def paf_one_to_one(spark, sf):
    """Lines compete for the positions of their supplier: longest first."""
    items = _items(spark, sf)
    spans = items.select(
        F.concat(F.lit("s"), "t").alias("qname"), F.concat_ws(":", "f", "src").alias("rec"), F.struct("f", "src").alias("place"), F.col("start").alias("qstart"),
        F.col("stop").alias("qend"), F.col("len").alias("nmatch"), F.col("len").cast("double").alias("score"),
    )
    return al.one_to_one(spans)


@query
def gap_blocks(spark, sf):
    text = F.expr("concat('M', len, ' I', 1 + src % 4, ' M2 D', 1 + len % 3, ' M', 1 + src % 6)")
    runs = _items(spark, sf).select("f", al.gap_runs(text).alias("g"))
    flat = runs.select("f", F.col("g.t").alias("t_total"), F.col("g.g").alias("g_total"), F.explode("g.runs").alias("r"))
    return flat.groupBy("f").agg(F.count("*").alias("blocks"), F.sum("r.t").alias("t_sum"), F.sum("r.g").alias("g_sum"), F.sum("r.n").alias("n_sum"), F.sum("t_total").alias("t_totals"), F.sum("g_total").alias("g_totals"))


@query
def chain_alignments(spark, sf):
    items = _items(spark, sf)
    heads = tb.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("f")).distinct().withColumn("src", F.lit(-1).cast("long"))
    header = "concat_ws(' ', 'chain', 1000, concat('t', f % 5), 1000000, '+', f % 100, 0, 'q', 1000000, if(f % 2 = 0, '+', '-'), 7, 0, f)"
    lines = _line(heads, header).unionByName(_line(items, "concat_ws('\\t', len, 1 + len % 4, t % 7)"))
    found, data = al.parse_chains(lines)
    return al.chain_blocks(found, data).select("chain_id", "t_name", "src", "tgt", "len", "rev")


@query
def gff3_features(spark, sf):
    text = "concat_ws('\\t', concat('NC_', f), 'x', 'match', tgt + 1, tgt + len, '.', if(rev, '-', '+'), len % 3, concat('ID=f', f, ';Note=a%2Cb+c,d;Dbxref=taxon:', t))"
    rows, _, _ = features.parse_gff3(_line(_items(spark, sf), text))
    grouped = features.group_features(rows)
    grouped = grouped.withColumn("ref", F.concat(F.lit("refseq:"), "seqid"))
    segments = features.rows_to_segments(F.col("rows"), F.col("ref"), F.lit(None).cast("long"), F.lit(False))
    note = F.array_join(F.element_at("attributes", "Note"), "|")
    return grouped.select("id", "type", note.alias("note"), format_location(F.col("ref"), F.lit("join"), segments).alias("location"))


@query
def bed_regions(spark, sf):
    text = "concat_ws('\\t', concat('chr', t), tgt, tgt + len + 40, concat('r', f, '.', src), len % 3, if(rev, '-', '+'), tgt, tgt + len + 40, 0, 2, concat(len, ',10,'), concat('0,', len + 30), concat('kind:', l_returnflag, '|x'), concat('n', len))"
    names = tb.load(spark, sf, "supplier").select(F.concat(F.lit("chr"), "s_suppkey").alias("alias"), F.concat(F.lit("refseq:NC_"), "s_suppkey").alias("ref"))
    bundle = tabular.ingest_bed(_line(_items(spark, sf), text), names, "CRE", ("attributes", "Name"))
    value = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0)).alias(k.lower())
    return bundle.annotations.select("location", value("ID"), value("score"), value("thick"), value("kind"), value("Name"))


@query
def sifts_edges(spark, sf):
    items = _items(spark, sf)
    text = "concat_ws('\\t', '1abc', 'A', concat('P', lpad(if(l_returnflag = 'R', 1, 2), 5, '0')), l_linenumber + 1, l_linenumber + len, src, src + 1, t + 1, t + len + if(l_linenumber = 7, 1, 0))"
    head = spark.range(1).select(F.lit("lines").alias("file"), _place(F.lit(-1), F.lit(-1)), F.lit("PDB\tCHAIN\tSP_PRIMARY\tRES_BEG\tRES_END\tPDB_BEG\tPDB_END\tSP_BEG\tSP_END").alias("value"))
    bundle = tabular.ingest_sifts(head.unionByName(_line(items, text)))
    sizes = bundle.blocks.groupBy("edge_key").agg(F.count("*").alias("blocks"), F.sum("src").alias("src_sum"), F.sum("tgt").alias("tgt_sum"), F.sum("len").alias("len_sum"))
    return bundle.edges.join(sizes, "edge_key").select("from_ref", "to_ref", "blocks", "src_sum", "tgt_sum", "len_sum")


@query
def fasta_records(spark, sf):
    docs = tb.residues(spark, sf)
    header = F.concat(F.lit(">tr|A"), F.lpad((F.col("doc_id") % 10).cast("string"), 1, "0"), F.lit("ABC1|X_"), "doc_id", F.lit(" Some protein OS=Invented species OX="), F.col("doc_id") + 1, F.lit(" GN=x PE=1"))
    text = F.concat(header, F.lit("\n"), F.regexp_replace("residues", "(.{60})", "$1\n"), F.lit("\n"))
    records, _ = fasta.sequence_records(fasta.split_records(docs.select(text.alias("value"))))
    return records.select("ref", "moltype", "unit", "length", "taxon", "organism", "md5")


@query
def fasta_tiles(spark, sf):
    """Documents written as FASTA lines of 60 residues, read back as tiles of 1024."""
    docs = tb.residues(spark, sf)
    header = F.concat(F.lit(">NC_"), F.col("doc_id") + 100000, F.lit(".1 Invented record"))
    cut = F.regexp_extract_all("residues", F.lit(".{1,60}"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(F.concat(F.array(header), cut)).alias("n", "value"))
    place = F.struct(F.shiftright("doc_id", 6).alias("split"), F.struct("doc_id", "n").alias("row")).alias("place")
    _, found = fasta.line_tiles(rows.select(F.lit("lines").alias("file"), place, "value"), size=1024)
    return found.select("ref", "tile_ix", F.length("residues").cast("long").alias("length"), F.md5("residues").alias("tile_md5"))


@query
def block_sampling(spark, sf):
    """Identity over evenly spaced blocks of neighbouring documents cut into 100-base blocks."""
    blocks = _neighbour_blocks(spark, sf).where("len >= 100")
    cut = blocks.select("edge_key", "src_ref", "tgt_ref", "rev", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("len div 100 - 1"))).alias("i"))
    cut = cut.select("edge_key", F.col("i").alias("ix"), "src_ref", (F.col("i") * 100).alias("src"), "tgt_ref", (F.col("i") * 100).alias("tgt"), F.lit(100).cast("long").alias("len"), "rev")
    table = tiles(tb.residues(spark, sf), "doc_id", size=4096)
    return sampled_identity(cut, table, size=4096).select("edge_key", F.col("same").cast("long").alias("same"), F.col("total").cast("long").alias("total"))


@query
def mismatch_rate(spark, sf):
    from .queries import base_mismatches

    rates = base_mismatches(spark, sf).groupBy("edge_key").agg(F.sum("n").alias("mismatches"))
    joined = rates.join(_neighbour_blocks(spark, sf).select("edge_key", "len"), "edge_key")
    return joined.select("edge_key", F.col("mismatches").cast("long").alias("mismatches"), (F.col("mismatches") <= F.col("len") * MAX_MISMATCH_RATE).alias("recorded"))


@query
def protein_alignment(spark, sf):
    """Documents as proteins, one residue per character, aligned with themselves after every 50th residue has changed."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", "X"))
    framed = lambda x: F.concat(F.lit("MKWVTFISLLFLFSSAYS"), x, F.lit("SHFSRQLEERLGLIEV"))
    # Aligning takes far longer than reading: rows are dealt to all cores, however few splits the files have.
    docs = tb.load(spark, sf, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    pairs = docs.select("doc_id", letters.alias("r")).select("doc_id", framed(F.col("r")).alias("a"), framed(F.regexp_replace("r", "(.{49}).", "$1*")).alias("b"))
    return pairs.select("doc_id", align_proteins(F.col("a"), F.col("b")).alias("al")).select(
        "doc_id", F.col("al.identical").cast("long").alias("identical"), F.col("al.aligned").cast("long").alias("aligned"), F.size("al.blocks").alias("blocks"),
        F.array_join("al.substitutions", ";").alias("substitutions"),
    )


@query
def path_search(spark, sf):
    """Every order to the suppliers its lines stand on (two ranks of states per order)."""
    lay = tb.layout(spark, sf)
    names = lambda c, p: F.concat(F.lit(p), F.col(c))
    base = lay.select(
        F.concat_ws(":", "f", "t").alias("edge_key"), F.col("src").alias("ix"), names("f", "refseq:NM_").alias("src_ref"), "src",
        names("t", "refseq:NC_").alias("tgt_ref"), "tgt", "len", "rev",
    )
    edges = lay.select("f", "t").distinct().select(
        F.concat_ws(":", "f", "t").alias("edge_key"), F.lit(0).alias("store_ord"), F.col("f").alias("edge_ord"), F.lit("annotation").alias("kind"), names("f", "refseq:NM_").alias("from_ref"),
        names("t", "refseq:NC_").alias("to_ref"), F.lit(False).alias("directional"), F.lit(None).cast("string").alias("location"), F.create_map(F.lit("type"), F.lit("line")).alias("attributes"),
        F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit("full").alias("basis")).alias("validation"), F.struct(F.lit("gff3").alias("adapter")).alias("provenance"),
    )
    empty = F.lit(None).cast("string")
    refs = edges.select("from_ref").distinct().select(F.col("from_ref").alias("ref"), F.lit("RNA").alias("moltype")).unionByName(edges.select("to_ref").distinct().select(F.col("to_ref").alias("ref"), F.lit("DNA").alias("moltype")))
    scope = refs.select(
        "ref", "moltype", F.lit("nt").alias("unit"), ns.category(F.col("ref"), F.lit("nt"), F.col("moltype")).alias("category"), ns.layer(ns.category(F.col("ref"), F.lit("nt"), F.col("moltype"))).alias("layer"),
        F.lit(1).cast("long").alias("taxon"), empty.alias("assembly"), F.array().cast("array<string>").alias("in_assemblies"), F.array().cast("array<string>").alias("tags"), empty.alias("digest"),
        F.struct(F.lit(0).alias("store_ord"), F.lit(0).cast("long").alias("rec_ord")).alias("first_ord"),
    )
    totals = lay.groupBy("f").agg(F.sum("len").alias("n"))
    seg = F.struct(names("f", "refseq:NM_").alias("ref"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"), F.lit(1).alias("strand"), F.lit(False).alias("fuzzy_low"), F.lit(False).alias("fuzzy_high"), F.lit(False).alias("uncertain"), F.lit("nt").alias("unit"))
    locations = totals.select(F.col("f").alias("query_id"), names("f", "refseq:NM_").alias("outer"), F.lit("join").alias("kind"), F.array(seg).alias("segments"))
    found = search.convert(locations, edges, base, scope, search.Options(to=["genome"], max_hops=1), unmapped=False, ladder=(6, 11))
    return found.select("query_id", "outer", "cost", "hops", F.size("segments").cast("long").alias("parts"), F.col("coverage"))
