import json

from pyspark.sql import functions as F

from coordweave.functions.faldo import decode_location_id, encode_location_id, faldo_json
from coordweave.functions.location import canonicalize, format_location_id, parse_locations
from coordweave.functions.namespaces import Registry, category, complete_versions, infer_namespace

CANONICAL = {
    "refseq:NC_000001.11:5": "refseq:NC_000001.11:5",
    "refseq:NC_000001.11: 5..9": "refseq:NC_000001.11:5..9",
    "refseq:NC_000001.11:complement(join(5..9,12))": "refseq:NC_000001.11:complement(join(5..9,12))",
    "refseq:NC_000001.11:join(complement(12),complement(5..9))": "refseq:NC_000001.11:complement(join(5..9,12))",
    "refseq:NC_000001.11:join(join(1..2,4),6..7)": "refseq:NC_000001.11:join(1..2,4,6..7)",
    "refseq:NC_000001.11:complement(join(complement(1..2),3..4))": "refseq:NC_000001.11:join(complement(3..4),1..2)",
    "refseq:NC_000001.11:order(<1..5,7..>9)": "refseq:NC_000001.11:order(<1..5,7..>9)",
    "refseq:NC_000001.11:3.9": "refseq:NC_000001.11:3.9",
    "refseq:NC_000001.11:3^4": "refseq:NC_000001.11:3^4",
    "refseq:NC_000001.11:join(1..5,NC_000002.12:7..9)": "refseq:NC_000001.11:join(1..5,NC_000002.12:7..9)",
    "refseq:NP_000001.1:5c1..7c3": "refseq:NP_000001.1:5..7",
    "refseq:NP_000001.1:5c2": "refseq:NP_000001.1:5c2",
    "refseq:NP_000001.1:5c2..6": "refseq:NP_000001.1:5c2..6",
    "uniprot:P07203:3c1^3c2": "uniprot:P07203:3c1^3c2",
    "pdb:4hhb.A:10": "pdb:4HHB.A:10",
    "pdb:pdb_00004hhb.A:10": "pdb:4HHB.A:10",
}
ERRORS = {
    "refseq:NC_000001.11:1..<5": ("'<' is only allowed before the begin position", 3),
    "refseq:NC_000001.11:>1..5": ("'>' is only allowed before the end position", 0),
    "refseq:NC_000001.11:<5": ("fuzzy marker on a single position", 0),
    "refseq:NC_000001.11:0": ("positions must be integers >= 1", 0),
    "refseq:NC_000001.11:-4": ("expected a position", 0),
    "refseq:NC_000001.11:7..5": ("range begin is greater than end", 0),
    "refseq:NP_000001.1:5c4": ("codon position must be 1, 2 or 3", 0),
    "refseq:NC_000001.11:join(1,2": ("expected ')'", 8),
    "refseq:NC_000001.11:1..2)": ("unexpected trailing characters", 4),
    "refseq:NC_000001.11:join(order(1,2),3)": ("order() is only allowed at the top level", None),
    "refseq:NC_000001.11:3^5": ("'^' needs adjacent positions", None),
    "refseq:NC_000001.11:5c2": ("codon extension is only allowed on protein sequences", None),
    "uniprot:P07203:complement(3)": ("complement is not allowed on protein sequence", None),
    "other:X1:3": ("unknown namespace 'other'", None),
    "uniprot:NC_1:3": ("'NC_1' is not a valid uniprot accession", None),
    "refseq": ("expected namespace:accession:location", 0),
}


def test_canonical_text_and_errors(spark):
    texts = list(CANONICAL) + list(ERRORS)
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    rows = {r.text: r for r in canonicalize(df).collect()}
    assert {t: rows[t].canonical for t in CANONICAL} == CANONICAL
    for text, (message, position) in ERRORS.items():
        assert rows[text].canonical is None and rows[text].error.startswith(message), (text, rows[text].error)
        assert rows[text].position == position, text


def test_recorded_units_lengths_and_whole_sequences(spark):
    dims = spark.createDataFrame([("refseq:NC_000001.11", "nt", 100), ("uniprot:P07203", "aa", 5), ("uniprot:P00001", "aa", 0)], "ref string, unit string, length long")
    asked = ["refseq:NC_000001.11:99..101", "uniprot:P07203", "uniprot:P00001", "refseq:NC_000001.11:5..7"]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {r.query_id: (r.canonical, r.error) for r in canonicalize(df, sequences=dims, whole_sequence=True).collect()}
    assert got[0][1] == "location exceeds the length of 'refseq:NC_000001.11' (100)"
    assert got[1] == ("uniprot:P07203:1..5", None)
    assert got[2][1].startswith("the length of 'uniprot:P00001' is unknown")
    assert got[3] == ("refseq:NC_000001.11:5..7", None)


def test_faldo(spark):
    texts = ["refseq:NC_000001.11:complement(5..>9)", "uniprot:P07203:3", "refseq:NC_000001.11:3^4", "refseq:NC_000001.11:join(1..2,4)", "uniprot:P07203:5c2..6"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    parsed = parse_locations(df)
    ident = format_location_id(F.col("outer"), F.col("kind"), F.col("segments"))
    rows = parsed.select("query_id", faldo_json(ident, F.col("kind"), F.col("segments"), "https://example.org/").alias("f")).collect()
    node = {r.query_id: json.loads(r.f) for r in rows}
    assert node[0]["@id"] == "https://example.org/refseq:NC_000001.11:complement(5..%3E9)"
    assert node[0]["faldo:begin"]["faldo:position"] == 9 and node[0]["faldo:begin"]["@type"] == ["faldo:FuzzyPosition", "faldo:ReverseStrandPosition"]
    assert node[1]["@type"] == ["faldo:ExactPosition"] and node[1]["faldo:position"] == 3
    assert node[2]["@type"] == "faldo:InBetweenPosition" and node[2]["faldo:before"]["faldo:position"] == 4
    assert node[3]["@type"] == "faldo:ListOfRegions" and node[3]["rdf:_2"]["faldo:position"] == 4
    assert node[4]["faldo:begin"]["cod:codonPosition"] == 2 and "cod:codonPosition" not in node[4]["faldo:end"]
    back = spark.range(1).select(decode_location_id(encode_location_id(F.lit("a:b:<1..>5+2^3"))).alias("x")).first().x
    assert back == "a:b:<1..>5+2^3"


def test_namespaces(spark):
    registry = Registry()
    df = spark.createDataFrame([("NP_000572.2",), ("P07203",), ("ENSP00000451042.1",), ("4hhb.A",), ("?",)], "acc string")
    got = {r.acc: r for r in infer_namespace(df, "acc", registry).collect()}
    assert got["NP_000572.2"].guessed_ref == "refseq:NP_000572.2" and got["4hhb.A"].guessed_ref == "pdb:4HHB.A"
    assert got["P07203"].candidates == ["insdc:P07203", "uniprot:P07203"] and got["?"].guessed_ref is None
    known = spark.createDataFrame([("uniprot:P07203",)], "ref string")
    assert infer_namespace(df, "acc", registry, known).where("acc = 'P07203'").first().guessed_ref == "uniprot:P07203"
    versions = spark.createDataFrame([("ensembl:ENSP1.2",), ("ensembl:ENSP2.1",), ("ensembl:ENSP2.2",)], "ref string")
    asked = spark.createDataFrame([("ensembl:ENSP1",), ("ensembl:ENSP2",), ("ensembl:ENSP3",)], "ref string")
    assert sorted(r.ref for r in complete_versions(asked, "ref", versions).collect()) == ["ensembl:ENSP1.2", "ensembl:ENSP2", "ensembl:ENSP3"]
    refs = spark.createDataFrame([("refseq:NC_1.1", "nt", None), ("refseq:NM_1.1", "nt", None), ("pdb:1ABC.A", "aa", None), ("insdc:AB1", "nt", "mRNA"), ("insdc:AB1", "nt", "DNA")], "ref string, unit string, m string")
    assert [r.c for r in refs.select(category(F.col("ref"), F.col("unit"), F.col("m")).alias("c")).collect()] == ["genome", "transcript", "structure", "transcript", "genome"]
