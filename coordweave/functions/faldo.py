"""Location IRIs and FALDO JSON-LD as text, built from Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALDO = "http://biohackathon.org/resource/faldo#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def encode_location_id(text: Column) -> Column:
    """Percent-encode what an IRI path may not hold: ``<``, ``>`` and ``^``."""
    out = F.replace(text, F.lit("<"), F.lit("%3C"))
    out = F.replace(out, F.lit(">"), F.lit("%3E"))
    return F.replace(out, F.lit("^"), F.lit("%5E"))


def decode_location_id(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _text(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _object(**fields: Column) -> Column:
    """JSON object text of ready-made JSON values; NULL fields are left out. ``__`` stands for ``:``, ``at_`` for ``@``."""
    name = lambda k: k.replace("__", ":").replace("at_", "@")
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{name(k)}":'), v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _string(value: Column | str) -> Column:
    return F.concat(F.lit('"'), _text(value), F.lit('"'))


def faldo_json(ident: Column, kind: Column, segments: Column, base: str = "", codon: str = "auto", references: str = "https://identifiers.org/", vocabulary: str = "urn:codon#") -> Column:
    """JSON-LD text of a location. Reverse-strand regions begin at the higher position; codon positions of proteins are
    written with the caller's ``vocabulary`` (prefix ``cod``)."""

    def position(s: Column, unit: Column, fuzzy: Column, side: str | None) -> Column:
        aa = s["unit"] == "aa"
        strand = F.when(aa, "").when(s["strand"] == 1, ',"faldo:ForwardStrandPosition"').otherwise(',"faldo:ReverseStrandPosition"')
        types = F.concat(F.lit("["), F.when(fuzzy, '"faldo:FuzzyPosition"').otherwise('"faldo:ExactPosition"'), strand, F.lit("]"))
        at = F.when(aa, F.floor(unit / 3).cast("long") + 1).otherwise(unit + 1).cast("string")
        phase = unit % 3 + 1
        implied = {"first": 1, "last": 3}.get(side or "")
        shown = aa & F.lit(codon != "never") & (F.lit(True) if implied is None else phase != implied)
        return _object(
            at_type=types, faldo__position=at, faldo__reference=_object(at_id=_string(F.concat(F.lit(references), s["ref"]))), cod__codonPosition=F.when(shown, phase.cast("string"))
        )

    def node(s: Column) -> Column:
        aa, no = s["unit"] == "aa", F.lit(False)
        plus, length = s["strand"] == 1, s["end"] - s["start"]
        low, high = position(s, s["start"], s["fuzzy_low"], "first"), position(s, s["end"] - 1, s["fuzzy_high"], "last")
        left, right = F.when(plus, s["start"] - 1).otherwise(s["start"]), F.when(plus, s["start"]).otherwise(s["start"] - 1)
        border = aa & (s["start"] % 3 == 0)
        # Between residues no codon position is given; inside a codon both sides carry it.
        plain = s.withField("unit", F.when(border, "aa").otherwise(s["unit"]))
        flank = lambda u: F.when(border, position(plain, F.floor(u / 3).cast("long") * 3, no, "first")).otherwise(position(s, u, no, None))
        between = _object(at_type=_string("faldo:InBetweenPosition"), faldo__after=flank(left), faldo__before=flank(right))
        one_of = _object(at_type=_string("faldo:InRangePosition"), faldo__begin=position(s, s["start"], no, "first"), faldo__end=position(s, s["end"] - 1, no, "last"))
        single_unit = aa & (length == 1) & F.lit(codon != "never")
        single = ((~aa & (length == 1)) | (aa & (s["start"] % 3 == 0) & (length == 3)) | single_unit) & ~s["fuzzy_low"] & ~s["fuzzy_high"]
        region = _object(at_type=_string("faldo:Region"), faldo__begin=F.when(plus, low).otherwise(high), faldo__end=F.when(plus, high).otherwise(low))
        exact = F.when(single_unit, position(s, s["start"], no, None)).otherwise(position(s, s["start"], no, "first"))
        return F.when(length == 0, between).when(s["uncertain"], one_of).when(single, exact).otherwise(region)

    context = F.lit(f'{{"faldo":"{FALDO}","rdf":"{RDF}","cod":"{vocabulary}"}}')
    head = F.concat(F.lit('{"@context":'), context, F.lit(',"@id":"'), F.lit(base), encode_location_id(ident), F.lit('",'))
    collection = F.when(kind == "order", "faldo:BagOfRegions").otherwise("faldo:ListOfRegions")
    members = F.array_join(F.transform(segments, lambda s, i: F.concat(F.lit('"rdf:_'), (i + 1).cast("string"), F.lit('":'), node(s))), ",")
    alone = F.get(F.transform(segments, node), F.lit(0))
    return F.when(F.size(segments) == 1, F.concat(head, F.substring(alone, F.lit(2), F.length(alone)))).otherwise(
        F.concat(head, F.lit('"@type":"'), collection, F.lit('",'), members, F.lit("}"))
    )
