"""SQL counterparts of the further registered queries."""

from .oracles import NEIGHBOURS, ORACLES, RESIDUES, SEG
from .queries import LOCATION_TEXT

LONGS = "CAST(sum({0}) AS BIGINT)"


def _sum(x: str) -> str:
    return LONGS.format(x)


SPAN = "CASE WHEN len = 1 THEN CAST(tgt + 1 AS VARCHAR) ELSE (tgt + 1) || '..' || (tgt + len) END"

ORACLES |= {
    "record_merge": """WITH o AS (SELECT *, CASE WHEN o_totalprice > 200000 THEN CAST(floor(o_totalprice) AS BIGINT) END AS len FROM orders),
        m AS (SELECT o_custkey AS ref, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS moltype, arg_min(len, o_orderkey) FILTER (len IS NOT NULL) AS length
              FROM o GROUP BY o_custkey),
        t AS (SELECT o_custkey AS ref, o_orderpriority AS tag, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2)
        SELECT m.ref, moltype, coalesce(length, 0) AS length, (SELECT string_agg(tag, '|' ORDER BY first_at) FROM t WHERE t.ref = m.ref) AS tags FROM m""",
    "first_record": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, event_id",
    "edge_cost": f"""WITH x AS (SELECT l_linenumber, CASE l_returnflag WHEN 'A' THEN 'annotation' WHEN 'N' THEN 'alignment' ELSE 'liftover' END AS kind,
          l_linenumber % 3 = 0 AS own, l_discount > 0.09 OR (l_linestatus = 'F' AND NOT (l_discount > 0.02 AND l_tax > 0.04)) AS approximate FROM lineitem)
        SELECT kind, approximate, CAST(CASE WHEN kind = 'liftover' THEN 2 WHEN own THEN 3 ELSE 1 END + CASE WHEN approximate THEN 10 ELSE 0 END AS INTEGER) AS cost,
          count(*) AS n, {_sum('l_linenumber')} AS lines FROM x GROUP BY 1, 2, 3""",
    "alignment_shadow": """SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem x WHERE l_returnflag <> 'A' OR NOT EXISTS (
        SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_suppkey = x.l_suppkey AND y.l_returnflag = 'N') GROUP BY 1, 2""",
    "default_assembly": """WITH c AS (SELECT *, CAST(greatest(floor(c_acctbal), 0) AS BIGINT) AS a FROM customer)
        SELECT CAST(c_nationkey AS BIGINT) AS taxon, first(c_name ORDER BY a > 0 DESC, c_mktsegment DESC, a DESC, c_custkey) AS default_assembly, count(*) AS assemblies FROM c GROUP BY c_nationkey""",
    "edges_of_sequence": f"""SELECT ref, count(*) AS n, {_sum('l_linenumber')} AS lines FROM (SELECT l_partkey AS ref, l_linenumber FROM lineitem
        UNION ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_partkey <> l_suppkey) GROUP BY ref""",
    "annotation_overlap": """WITH e AS (SELECT event_id, user_id AS ref, datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS sec FROM events),
        h AS (SELECT DISTINCT ref, sec // 3600 AS hour FROM e)
        SELECT h.ref, hour, count(*) AS n, min(event_id) AS first_event FROM h JOIN e ON e.ref = h.ref AND e.sec >= hour * 3600 - 900 AND e.sec < hour * 3600 + 4500 GROUP BY 1, 2""",
    "mismatch_lookup": f"""WITH {SEG}, m AS (SELECT f, t, tgt + len % 13 AS pos, substr('ACGT', len % 4 + 1, 1) || '>' || substr('ACGT', (len + 1) % 4 + 1, 1) AS change FROM seg)
        SELECT x.f || ':' || x.t AS edge_key, x.src AS block, string_agg('base ' || x.t || ':' || (pos + 1) || ' ' || change, ';' ORDER BY pos, change) AS bases
        FROM seg x JOIN m ON x.f = m.f AND x.t = m.t AND pos BETWEEN x.tgt AND x.tgt + x.len - 1 GROUP BY 1, 2""",
    "store_summary": """SELECT 'moltype' AS what, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') AS name, count(*) AS n FROM part GROUP BY 2
        UNION ALL SELECT 'kind', l_returnflag, count(*) FROM lineitem GROUP BY 2
        UNION ALL SELECT 'taxon', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size <> 7 GROUP BY 2
        UNION ALL SELECT 'blocks', 'all', count(*) FROM lineitem UNION ALL SELECT 'annotations', 'all', count(*) FROM events""",
    "category_of": """WITH x AS (SELECT CASE l_linenumber WHEN 1 THEN 'genome' WHEN 2 THEN 'transcript' WHEN 3 THEN 'gene_region' WHEN 4 THEN 'protein'
          WHEN 5 THEN 'transcript' WHEN 6 THEN 'other' ELSE 'genome' END AS category, CASE WHEN l_linenumber = 4 THEN 'aa' ELSE 'nt' END AS unit FROM lineitem)
        SELECT category, unit, CASE category WHEN 'genome' THEN 0 WHEN 'gene_region' THEN 1 WHEN 'transcript' THEN 2 WHEN 'protein' THEN 3 ELSE -1 END AS layer, count(*) AS n FROM x GROUP BY 1, 2""",
    "namespace_guess": """SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'refseq' WHEN 2 THEN 'refseq' WHEN 4 THEN 'ensembl' WHEN 5 THEN 'insdc' WHEN 6 THEN 'pdb' END AS namespace,
        CASE WHEN l_linenumber = 3 THEN 'insdc|uniprot' END AS several, count(*) AS n FROM lineitem GROUP BY 1""",
    "paf_alignments": f"""WITH {SEG}, b AS (SELECT *, 1 + src % 4 AS i, 5 + len % 5 AS e, 1 + len % 3 AS d, 1 + src % 6 AS m FROM seg),
        p AS (SELECT f, rev, src AS qs, src + len + i + e + m AS qe, tgt, len, i, e, d, m FROM b),
        r AS (SELECT f, CASE WHEN rev THEN qe - len ELSE qs END AS s, tgt AS t, len AS n FROM p
              UNION ALL SELECT f, CASE WHEN rev THEN qe - len - i - e ELSE qs + len + i END, tgt + len, e FROM p
              UNION ALL SELECT f, CASE WHEN rev THEN qe - len - i - e - m ELSE qs + len + i + e END, tgt + len + e + d, m FROM p)
        SELECT 'q' || f AS qname, count(*) AS blocks, {_sum('s')} AS src_sum, {_sum('t')} AS tgt_sum, {_sum('n')} AS len_sum FROM r GROUP BY f""",
    "gap_blocks": f"""WITH {SEG}, b AS (SELECT f, len, 1 + src % 4 AS i, 1 + len % 3 AS d, 1 + src % 6 AS m FROM seg)
        SELECT f, 3 * count(*) AS blocks, {_sum('(len + i) + (len + i + 2)')} AS t_sum, {_sum('len + (len + 2 + d)')} AS g_sum, {_sum('len + 2 + m')} AS n_sum,
          {_sum('3 * (len + i + 2 + m)')} AS t_totals, {_sum('3 * (len + 2 + d + m)')} AS g_totals FROM b GROUP BY f""",
    "chain_alignments": f"""WITH {SEG}, o AS (SELECT *, f % 2 = 1 AS minus,
          CAST(sum(len + 1 + len % 4) OVER w - (len + 1 + len % 4) AS BIGINT) AS t_off, CAST(sum(len + t % 7) OVER w - (len + t % 7) AS BIGINT) AS q_off
          FROM seg WINDOW w AS (PARTITION BY f ORDER BY src ROWS UNBOUNDED PRECEDING))
        SELECT CAST(f AS VARCHAR) AS chain_id, 't' || (f % 5) AS t_name, f % 100 + t_off AS src, CASE WHEN minus THEN 1000000 - (7 + q_off) - len ELSE 7 + q_off END AS tgt, len, minus AS rev FROM o""",
    "gff3_features": f"""WITH {SEG}, g AS (SELECT f, count(DISTINCT rev) AS k, bool_or(rev) AS minus, count(*) AS n,
          string_agg({SPAN}, ',' ORDER BY tgt, src) AS sorted, string_agg(CASE WHEN rev THEN 'complement(' || {SPAN} || ')' ELSE {SPAN} END, ',' ORDER BY src) AS filed FROM seg GROUP BY f)
        SELECT 'f' || f AS id, 'match' AS type, 'a,b+c|d' AS note, CASE WHEN n = 1 AND minus THEN 'complement(' || sorted || ')' WHEN n = 1 THEN sorted
          WHEN k = 2 THEN 'join(' || filed || ')' WHEN minus THEN 'complement(join(' || sorted || '))' ELSE 'join(' || sorted || ')' END AS location FROM g""",
    "bed_regions": f"""WITH {SEG.replace("l_returnflag = 'R' AS rev,", "l_returnflag = 'R' AS rev, l_returnflag AS flag,")}
        SELECT 'refseq:NC_' || t || ':' || CASE WHEN rev THEN 'complement(' ELSE '' END || 'join(' || {SPAN} || ',' || (tgt + len + 31) || '..' || (tgt + len + 40) || ')' || CASE WHEN rev THEN ')' ELSE '' END AS location,
          'r' || f || '.' || src AS id, CASE WHEN len % 3 <> 0 THEN CAST(len % 3 AS VARCHAR) END AS score, CAST(NULL AS VARCHAR) AS thick, flag AS kind, 'n' || len AS name FROM seg""",
    "sifts_edges": f"""WITH {SEG.replace("l_returnflag = 'R' AS rev,", "l_returnflag = 'R' AS rev, l_linenumber AS ln,")},
        u AS (SELECT *, row_number() OVER (ORDER BY f, src) AS a, row_number() OVER (PARTITION BY rev ORDER BY f, src) AS b FROM seg WHERE ln <> 7)
        SELECT 'uniprot:P0000' || CASE WHEN rev THEN 1 ELSE 2 END AS from_ref, 'pdb:1ABC.A' AS to_ref, count(*) AS blocks, {_sum('3 * t')} AS src_sum, {_sum('3 * ln')} AS tgt_sum, {_sum('3 * len')} AS len_sum
        FROM u GROUP BY rev, a - b""",
    "fasta_records": f"""WITH {RESIDUES} SELECT 'uniprot:A' || (doc_id % 10) || 'ABC1' AS ref, 'protein' AS moltype, 'aa' AS unit, length(r) AS length, doc_id + 1 AS taxon,
        'Invented species' AS organism, md5(r) AS md5 FROM res""",
    "block_sampling": f"""WITH {NEIGHBOURS}, n AS (SELECT edge_key, max(pos) + 1 AS total FROM pair GROUP BY edge_key HAVING max(pos) + 1 >= 100),
        s AS (SELECT edge_key, a, b, pos // 100 AS i, greatest(1, (total // 100) // 20) AS step FROM pair JOIN n USING (edge_key) WHERE pos < total // 100 * 100)
        SELECT edge_key, count(*) FILTER (a = b) AS same, count(*) AS total FROM s WHERE i % step = 0 GROUP BY edge_key""",
    "mismatch_rate": f"""WITH {NEIGHBOURS} SELECT edge_key, count(*) FILTER (a <> b) AS mismatches, count(*) FILTER (a <> b) <= count(*) * 0.01 AS recorded
        FROM pair GROUP BY edge_key HAVING count(*) FILTER (a <> b) > 0""",
    "path_search": f"""WITH {SEG}, o AS (SELECT f, sum(len) AS n FROM seg GROUP BY f),
        r AS (SELECT *, lag(t) OVER w AS pt, lag(rev) OVER w AS pr, lag(tgt) OVER w AS pg, lag(len) OVER w AS pl, lag(src) OVER w AS ps FROM seg WINDOW w AS (PARTITION BY f, t ORDER BY src)),
        k AS (SELECT f, t, len, CASE WHEN pt IS NOT NULL AND pr = rev AND CASE WHEN rev THEN tgt + len = pg ELSE tgt = pg + pl END THEN 0 ELSE 1 END AS fresh FROM r)
        SELECT f AS query_id, 'refseq:NC_' || t AS outer, 1 AS cost, 1 AS hops, {_sum('fresh')} AS parts,
          least(1.0::DOUBLE, floor(CAST(sum(len) AS DOUBLE) / CAST(any_value(n) AS DOUBLE) * 1000 + 0.5) / 1000) AS coverage FROM k JOIN o USING (f) GROUP BY f, t""",
}

# The best line over every stretch between two ends of lines, neighbouring stretches of one line joined.
ORACLES["paf_one_to_one"] = f"""WITH {SEG}, s AS (SELECT 's' || t AS qname, f || ':' || src AS rec, f, src, tgt AS a, tgt + len AS b, len FROM seg WHERE len > 0),
    p AS (SELECT qname, a AS x FROM s UNION SELECT qname, b FROM s), e AS (SELECT qname, x, lead(x) OVER (PARTITION BY qname ORDER BY x) AS y FROM p),
    o AS (SELECT e.qname, x, y, arg_min(rec, ROW(-len, f, src)) AS rec FROM e JOIN s ON s.qname = e.qname AND s.a <= x AND y <= s.b GROUP BY 1, 2, 3),
    n AS (SELECT *, CASE WHEN lag(rec) OVER w = rec AND lag(y) OVER w = x THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY qname ORDER BY x)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY qname ORDER BY x) AS run FROM n)
    SELECT qname, rec, CAST(min(x) AS BIGINT) AS free_start, CAST(max(y) AS BIGINT) AS free_end FROM g GROUP BY qname, run, rec"""

ORACLES["sequence_digest"] = f"""WITH {RESIDUES}, g AS (SELECT r, min(doc_id) AS same_as, count(*) AS copies FROM res GROUP BY r HAVING count(*) > 1)
    SELECT doc_id, md5(res.r) AS md5, true AS well_formed, coalesce(same_as, doc_id) AS same_as, coalesce(copies, 1) AS copies FROM res LEFT JOIN g ON g.r = res.r"""

# Isolated changes to a residue that stands nowhere else leave one way to align, with one pair per residue.
ORACLES["protein_alignment"] = """WITH x AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', 'X', 'g')) AS r FROM documents),
    n AS (SELECT doc_id, r, length(r) + 34 AS total, length(r) // 50 AS changed FROM x)
    SELECT doc_id, CAST(total - changed AS BIGINT) AS identical, CAST(total AS BIGINT) AS aligned, 1 AS blocks,
      coalesce(array_to_string(list_transform(range(1, changed + 1), lambda k: (18 + 50 * k) || '/' || (18 + 50 * k) || ':' || r[50 * k] || '>*'), ';'), '') AS substitutions FROM n"""


def _faldo_sql() -> str:
    """FALDO text of the seven forms of location that lines are written in."""
    context = '{"@context":{"faldo":"http://biohackathon.org/resource/faldo#","rdf":"http://www.w3.org/1999/02/22-rdf-syntax-ns#","cod":"urn:codon#"},"@id":"https://example.org/refseq:NC_'

    def at(number: str, strand: str = "Forward", sort: str = "Exact") -> str:
        return f"""'{{"@type":["faldo:{sort}Position","faldo:{strand}StrandPosition"],"faldo:position":' || ({number}) || ',"faldo:reference":{{"@id":"https://identifiers.org/refseq:NC_' || l_orderkey || '"}}}}'"""

    def pair(sort: str, first: str, second: str, names: tuple[str, str] = ("begin", "end")) -> str:
        return f"""'{{"@type":"faldo:{sort}","faldo:{names[0]}":' || {first} || ',"faldo:{names[1]}":' || {second} || '}}'"""

    def alone(ident: str, node: str) -> str:
        return f"""'{context}' || l_orderkey || ':' || {ident} || '",' || substr({node}, 2)"""

    def several(sort: str, ident: str, one: str, two: str) -> str:
        return f"""'{context}' || l_orderkey || ':' || {ident} || '","@type":"faldo:{sort}","rdf:_1":' || {one} || ',"rdf:_2":' || {two} || '}}'"""

    p, s, q = "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT)"
    stretch = f"CASE WHEN {q} = 1 THEN {at(f'{s} + 1')} ELSE {pair('Region', at(f'{s} + 1'), at(f'{s} + {q}'))} END"
    spelled = f"({s} + 1) || CASE WHEN {q} = 1 THEN '' ELSE '..' || ({s} + {q}) END"
    forms = [
        alone(f"({p} + 1)", at(f"{p} + 1")),
        alone(f"({p} + 1) || '..' || ({p} + 1 + {q})", pair("Region", at(f"{p} + 1"), at(f"{p} + 1 + {q}"))),
        alone(f"'complement(%3C' || ({p} + 1) || '..%3E' || ({p} + 1 + {q}) || ')'", pair("Region", at(f"{p} + 1 + {q}", "Reverse", "Fuzzy"), at(f"{p} + 1", "Reverse", "Fuzzy"))),
        several("ListOfRegions", f"'complement(join(' || ({s} + 1) || '..' || ({s} + 3) || ',' || ({p} + 9000) || '))'", at(f"{p} + 9000", "Reverse"), pair("Region", at(f"{s} + 3", "Reverse"), at(f"{s} + 1", "Reverse"))),
        several("ListOfRegions", f"'complement(join(' || ({s} + 1) || ',' || ({p} + 1) || '..' || ({p} + 5) || '))'", pair("Region", at(f"{p} + 5", "Reverse"), at(f"{p} + 1", "Reverse")), at(f"{s} + 1", "Reverse")),
        f"CASE WHEN {s} % 2 = 0 THEN " + alone(f"({p} + 1) || '%5E' || ({p} + 2)", pair("InBetweenPosition", at(f"{p} + 1"), at(f"{p} + 2"), ("after", "before"))) + " END",
        several("BagOfRegions", f"'order(' || ({p} + 1) || '.' || ({p} + 1 + {q}) || ',' || {spelled} || ')'", pair("InRangePosition", at(f"{p} + 1"), at(f"{p} + 1 + {q}")), stretch),
    ]
    text = LOCATION_TEXT.replace("concat(", "concat('', ")
    return f"SELECT l_linenumber, concat('refseq:NC_', l_orderkey, ':', {text}) AS text, CASE l_linenumber " + " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(forms, 1)) + " END AS faldo FROM lineitem"


ORACLES["location_faldo"] = _faldo_sql()

ORACLES["fasta_tiles"] = f"""WITH {RESIDUES}, t AS (SELECT doc_id, r, unnest(range(0, (length(r) + 1023) // 1024)) AS tile_ix FROM res)
    SELECT 'refseq:NC_' || (doc_id + 100000) || '.1' AS ref, tile_ix, CAST(length(r[tile_ix * 1024 + 1 : tile_ix * 1024 + 1024]) AS BIGINT) AS length,
      md5(r[tile_ix * 1024 + 1 : tile_ix * 1024 + 1024]) AS tile_md5 FROM t"""
