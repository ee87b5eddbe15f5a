"""The registered queries once more as plain SQL for an independent engine."""

SEG = """seg AS (
  SELECT l_orderkey AS f, l_suppkey AS t, CAST(l_quantity AS BIGINT) AS len, l_partkey * 20 AS tgt,
         l_returnflag = 'R' AS rev,
         CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - CAST(l_quantity AS BIGINT) AS src
  FROM lineitem)"""

HITS = SEG + """,
hit AS (
  SELECT q.f AS query_id, q.src AS seg_ix, b.f AS tgt_ref, q.tgt AS s_start, q.tgt + q.len AS s_end,
         CASE WHEN q.rev THEN -1 ELSE 1 END AS s_strand, q.len % 7 = 0 AS s_low, q.len % 5 = 0 AS s_high,
         q.len % 11 = 0 AS s_unc, b.f * 1048576 + b.src AS ix,
         greatest(q.tgt, b.tgt) AS a, least(q.tgt + q.len, b.tgt + b.len) AS b,
         CASE WHEN b.rev THEN b.src + b.tgt + b.len - least(q.tgt + q.len, b.tgt + b.len)
              ELSE b.src + greatest(q.tgt, b.tgt) - b.tgt END AS ta,
         CASE WHEN b.rev THEN b.src + b.tgt + b.len - greatest(q.tgt, b.tgt)
              ELSE b.src + least(q.tgt + q.len, b.tgt + b.len) - b.tgt END AS tb,
         CASE WHEN b.rev THEN -1 ELSE 1 END * CASE WHEN q.rev THEN -1 ELSE 1 END AS strand
  FROM seg q JOIN seg b ON q.t = b.t AND q.tgt < b.tgt + b.len AND b.tgt < q.tgt + q.len)"""

TARGETS = HITS + """,
cut AS (
  SELECT h.*, CASE WHEN s_strand = 1 THEN a ELSE -b END AS p,
    EXISTS (SELECT 1 FROM hit o WHERE o.query_id = h.query_id AND o.seg_ix = h.seg_ix AND o.tgt_ref = h.tgt_ref
            AND o.a <= h.a - 1 AND h.a - 1 < o.b) AS low_covered,
    EXISTS (SELECT 1 FROM hit o WHERE o.query_id = h.query_id AND o.seg_ix = h.seg_ix AND o.tgt_ref = h.tgt_ref
            AND o.a <= h.b AND h.b < o.b) AS high_covered
  FROM hit h),
ends AS (
  SELECT *, CASE WHEN s_strand = 1 THEN CASE WHEN a = s_start THEN s_low ELSE NOT low_covered END
                 ELSE CASE WHEN b = s_end THEN s_high ELSE NOT high_covered END END AS cut_first,
            CASE WHEN s_strand = 1 THEN CASE WHEN b = s_end THEN s_high ELSE NOT high_covered END
                 ELSE CASE WHEN a = s_start THEN s_low ELSE NOT low_covered END END AS cut_last,
    lag(seg_ix) OVER w AS l_seg, lag(strand) OVER w AS l_strand, lag(ta) OVER w AS l_ta, lag(tb) OVER w AS l_tb,
    lag(a) OVER w AS l_a, lag(b) OVER w AS l_b, lag(s_unc) OVER w AS l_unc
  FROM cut WINDOW w AS (PARTITION BY query_id, tgt_ref ORDER BY seg_ix, p, ix)),
grp AS (
  SELECT *, sum(CASE WHEN l_seg IS NOT NULL AND l_strand = strand
      AND CASE WHEN strand = 1 THEN ta = l_tb ELSE tb = l_ta END
      AND CASE WHEN l_seg = seg_ix THEN CASE WHEN s_strand = 1 THEN a >= l_b ELSE b <= l_a END
               ELSE NOT s_unc AND NOT l_unc END THEN 0 ELSE 1 END)
      OVER (PARTITION BY query_id, tgt_ref ORDER BY seg_ix, p, ix ROWS UNBOUNDED PRECEDING) AS g,
    row_number() OVER (PARTITION BY query_id, tgt_ref ORDER BY seg_ix, p, ix) AS rn
  FROM ends),
merged AS (
  SELECT query_id, tgt_ref, g, min(ta) AS start, max(tb) AS "end", any_value(strand) AS strand,
         arg_min(cut_first, rn) AS cut_first, arg_max(cut_last, rn) AS cut_last, arg_min(seg_ix, rn) AS seg_ix,
         arg_min(p, rn) AS p, arg_min(ix, rn) AS ix, bool_or(s_unc) AS s_unc
  FROM grp GROUP BY query_id, tgt_ref, g),
marked AS (
  SELECT *, CASE WHEN strand = 1 THEN cut_first ELSE cut_last END AS fuzzy_low,
         CASE WHEN strand = 1 THEN cut_last ELSE cut_first END AS fuzzy_high,
         count(*) OVER (PARTITION BY query_id, seg_ix) AS n
  FROM merged)"""

WINDOW = SEG + """,
win AS (
  SELECT l_suppkey AS ref, l_suppkey || ':' || l_partkey AS query_id, greatest(l_partkey * 20 - 30, 0) AS s,
         l_partkey * 20 + 60 AS e, CASE WHEN bool_or(l_linestatus = 'F') THEN -1 ELSE 1 END AS strand
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""

RESIDUES = """res AS (
  SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-',
         'ACGTACGTACGTACGTACGTACGTACA') AS r FROM documents)"""

NEIGHBOURS = RESIDUES + """,
pair AS (
  SELECT x.doc_id AS edge_key, unnest(string_split(x.r[1:least(length(x.r), length(y.r))], '')) AS a,
         unnest(string_split(y.r[1:least(length(x.r), length(y.r))], '')) AS b,
         unnest(range(least(length(x.r), length(y.r)))) AS pos
  FROM res x JOIN res y ON y.doc_id = x.doc_id - 1 WHERE length(x.r) > 0 AND length(y.r) > 0)"""

CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

ORACLES = {
    "feature_layout": f"WITH {SEG} SELECT f, t, src, len, tgt, rev FROM seg",
    "mapping_invert": f"WITH {SEG} SELECT t AS src_ref, tgt AS src, f AS tgt_ref, src AS tgt, len, rev FROM seg",
    "mapping_concat": f"""WITH {SEG}, two AS (SELECT f AS r, len, 0 AS m, f, src FROM seg UNION ALL SELECT t, len, 1, f, src FROM seg)
        SELECT r AS src_ref, count(*) AS n, CAST(sum(len) AS BIGINT) AS units, count(DISTINCT (m, f, src)) AS distinct_ix
        FROM two GROUP BY r""",
    "block_validation": """SELECT l_returnflag, (l_partkey < 0 OR l_suppkey < 50 OR CAST(l_quantity AS BIGINT) <= 5) AS bad,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "residue_blocks": """SELECT l_orderkey AS src_ref, l_suppkey AS tgt_ref, CAST(3 * l_linenumber AS BIGINT) AS src,
        3 * l_partkey AS tgt, 3 * CAST(l_quantity AS BIGINT) AS len, false AS rev FROM lineitem""",
    "coding_blocks": f"""WITH {SEG}, tot AS (SELECT f, f % 3 AS ph, CAST(sum(len) AS BIGINT) AS total FROM seg GROUP BY f),
        c AS (SELECT s.*, ph, ph + 3 * ((total - ph) // 3) AS stop FROM seg s JOIN tot USING (f) WHERE (total - ph) // 3 >= 1),
        k AS (SELECT *, greatest(src, ph) AS lo, least(src + len, stop) AS hi FROM c)
        SELECT f AS src_ref, lo - ph AS src, t AS tgt_ref,
               CASE WHEN rev THEN tgt + (src + len - hi) ELSE tgt + (lo - src) END AS tgt, hi - lo AS len, rev
        FROM k WHERE lo < hi""",
    "overlap_pairs": f"""WITH {SEG} SELECT x.t, x.f, y.f AS f2, greatest(x.tgt, y.tgt) AS lo,
        least(x.tgt + x.len, y.tgt + y.len) AS hi
        FROM seg x JOIN seg y ON x.t = y.t AND x.f < y.f AND x.tgt < y.tgt + y.len AND y.tgt < x.tgt + x.len""",
    "project_interval": f"""WITH {SEG} SELECT f AS src_ref, src,
        CASE WHEN rev THEN tgt + len // 4 ELSE tgt + len // 4 END AS lo, tgt + len - len // 4 AS hi FROM seg""",
    "mapping_compose": f"""WITH {SEG}, p AS (
        SELECT x.f AS src_ref, y.f AS tgt_ref, greatest(x.tgt, y.tgt) AS lo, least(x.tgt + x.len, y.tgt + y.len) AS hi,
               x.src AS xs, x.tgt AS xt, x.len AS xl, x.rev AS xr, y.src AS ys, y.tgt AS yt, y.len AS yl, y.rev AS yr
        FROM seg x JOIN seg y ON x.t = y.t AND x.tgt < y.tgt + y.len AND y.tgt < x.tgt + x.len)
        SELECT src_ref, CASE WHEN xr THEN xs + xt + xl - hi ELSE xs + lo - xt END AS src, tgt_ref,
               CASE WHEN yr THEN ys + yt + yl - hi ELSE ys + lo - yt END AS tgt, hi - lo AS len, xr <> yr AS rev FROM p""",
    "map_pieces": f"WITH {HITS} SELECT query_id, seg_ix, tgt_ref, a, b, ta, tb, strand FROM hit",
    "map_targets": f"""WITH {TARGETS} SELECT query_id, tgt_ref, seg_ix, start, "end", strand, fuzzy_low, fuzzy_high,
        s_unc AND n = 1 AS uncertain, s_unc AND n > 1 AS split_one_of FROM marked""",
    "map_unmapped": f"""WITH {WINDOW},
        unit AS (SELECT query_id, ref, strand, s, e, unnest(range(s, e)) AS u FROM win),
        free AS (SELECT * FROM unit w WHERE NOT EXISTS (
            SELECT 1 FROM seg b WHERE b.t = w.ref AND b.tgt <= w.u AND w.u < b.tgt + b.len)),
        isl AS (SELECT *, u - row_number() OVER (PARTITION BY query_id ORDER BY u) AS g FROM free)
        SELECT query_id, ref, min(u) AS start, max(u) + 1 AS "end", strand, false AS fuzzy_low, max(u) + 1 = e AS fuzzy_high
        FROM isl GROUP BY query_id, ref, strand, s, e, g""",
    "group_targets": f"""WITH {TARGETS},
        txt AS (SELECT *, count(*) OVER (PARTITION BY query_id, tgt_ref) AS k,
            sum(CASE WHEN strand = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, tgt_ref) AS m,
            CASE WHEN s_unc AND n = 1 THEN (start + 1) || '.' || "end"
                 WHEN "end" - start = 1 AND NOT fuzzy_low AND NOT fuzzy_high THEN CAST("end" AS VARCHAR)
                 ELSE CASE WHEN fuzzy_low THEN '<' ELSE '' END || (start + 1) || '..' || CASE WHEN fuzzy_high THEN '>' ELSE '' END || "end"
            END AS span FROM marked)
        SELECT query_id, 'order:' || tgt_ref AS outer,
               CASE WHEN any_value(m) = 0 THEN 'forward' WHEN any_value(m) = any_value(k) THEN 'reverse' ELSE 'mixed' END AS orientation,
               CASE WHEN any_value(k) = 1 THEN CASE WHEN any_value(m) = 1 THEN 'complement(' || any_value(span) || ')' ELSE any_value(span) END
                    WHEN any_value(m) = any_value(k) THEN 'complement(join(' || string_agg(span, ',' ORDER BY seg_ix DESC, p DESC, ix DESC) || '))'
                    ELSE 'join(' || string_agg(CASE WHEN strand = -1 THEN 'complement(' || span || ')' ELSE span END, ',' ORDER BY seg_ix, p, ix) || ')'
               END AS location
        FROM txt GROUP BY query_id, tgt_ref""",
    "coverage": f"""WITH {TARGETS}, tot AS (SELECT f, sum(len) AS units FROM seg GROUP BY f)
        SELECT query_id, tgt_ref, CAST(sum("end" - start) AS BIGINT) AS mapped,
               least(1.0::DOUBLE, floor(CAST(sum("end" - start) AS DOUBLE) / CAST(any_value(units) AS DOUBLE) * 1000 + 0.5) / 1000) AS coverage
        FROM marked JOIN tot ON f = query_id GROUP BY query_id, tgt_ref""",
    "between_map": f"""WITH {SEG}, spot AS (SELECT DISTINCT t, tgt + 1 AS k FROM seg),
        img AS (SELECT a.t, a.k, b.f, u, CASE WHEN b.rev THEN b.src + b.tgt + b.len - 1 - u ELSE b.src + u - b.tgt END AS pos
                FROM spot a, LATERAL (SELECT unnest([a.k - 1, a.k]) AS u) x
                JOIN seg b ON b.t = a.t AND b.tgt <= x.u AND x.u < b.tgt + b.len),
        pr AS (SELECT t, k, f, count(*) FILTER (u = k - 1) AS nl, count(*) FILTER (u = k) AS nr,
                      min(pos) FILTER (u = k - 1) AS lp, min(pos) FILTER (u = k) AS rp FROM img GROUP BY t, k, f)
        SELECT t || ':' || k AS query_id, f AS tgt_ref, greatest(lp, rp) AS start, CASE WHEN rp > lp THEN 1 ELSE -1 END AS strand
        FROM pr WHERE nl = 1 AND nr = 1 AND abs(rp - lp) = 1""",
    "interval_union": f"""WITH {SEG}, un AS (SELECT DISTINCT t, unnest(range(tgt, tgt + len)) AS u FROM seg),
        isl AS (SELECT t, u, u - row_number() OVER (PARTITION BY t ORDER BY u) AS g FROM un)
        SELECT t, min(u) AS start, max(u) + 1 AS "end" FROM isl GROUP BY t, g""",
    "version_resolver": """WITH v AS (SELECT l_orderkey AS k, min(l_linenumber) AS v FROM lineitem GROUP BY l_orderkey
        HAVING count(DISTINCT l_linenumber) = 1)
        SELECT o_orderkey, 'feature:F' || o_orderkey || coalesce('.' || v, '') AS ref FROM orders LEFT JOIN v ON k = o_orderkey""",
    "consecutive_runs": """WITH r AS (SELECT l_orderkey, l_returnflag, l_quantity,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS a,
            row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS b
          FROM lineitem),
        g AS (SELECT l_orderkey, l_returnflag, min(a) AS first, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
              FROM r GROUP BY l_orderkey, l_returnflag, a - b)
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS island, l_returnflag, n, units FROM g""",
    "reverse_complement": f"""WITH {RESIDUES} SELECT doc_id, length(r) AS n, md5(translate(reverse(r), 'ACGT', 'TGCA')) AS rc_md5 FROM res""",
    "translate": f"""WITH {RESIDUES}, num AS (SELECT doc_id, translate(r, 'TCAG', '0123') AS d FROM res),
        c AS (SELECT doc_id, list_transform(regexp_extract_all(d, '...'), lambda x: substr('{CODE}',
              CAST(16 * CAST(x[1] AS INT) + 4 * CAST(x[2] AS INT) + CAST(x[3] AS INT) + 1 AS INT), 1)) AS aa FROM num)
        SELECT doc_id, md5(array_to_string(aa, '')) AS aa_md5 FROM c""",
    "identity_groups": """WITH d AS (SELECT doc_id, md5(text) AS digest FROM documents)
        SELECT doc_id, digest, same_as, copies FROM (SELECT *, min(doc_id) OVER w AS same_as, count(*) OVER w AS copies
        FROM d WINDOW w AS (PARTITION BY digest)) WHERE copies > 1""",
    "sequence_identity": f"""WITH {NEIGHBOURS} SELECT edge_key, count(*) FILTER (a = b) AS identical, count(*) AS aligned
        FROM pair GROUP BY edge_key""",
    "base_mismatches": f"""WITH {NEIGHBOURS} SELECT edge_key, a, b, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum
        FROM pair WHERE a <> b GROUP BY edge_key, a, b""",
    "residue_slices": f"""WITH {RESIDUES}, w AS (SELECT doc_id, r, length(r) // 3 AS s, length(r) - length(r) // 4 AS e FROM res)
        SELECT doc_id, s AS start, e AS "end", md5(CASE WHEN doc_id % 2 = 0 THEN r[s + 1:e] ELSE translate(reverse(r[s + 1:e]), 'ACGT', 'TGCA') END) AS slice_md5
        FROM w WHERE e > s""",
    "location_canonical": """WITH x AS (SELECT *, CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
        SELECT l_linenumber, CASE WHEN l_linenumber = 6 AND l_suppkey % 2 = 1 THEN NULL ELSE 'refseq:NC_' || l_orderkey END AS outer,
          CASE l_linenumber
            WHEN 1 THEN CAST(l_partkey + 1 AS VARCHAR)
            WHEN 2 THEN (l_partkey + 1) || '..' || (l_partkey + 1 + qty)
            WHEN 3 THEN 'complement(<' || (l_partkey + 1) || '..>' || (l_partkey + 1 + qty) || ')'
            WHEN 4 THEN 'complement(join(' || (l_suppkey + 1) || '..' || (l_suppkey + 3) || ',' || (l_partkey + 9000) || '))'
            WHEN 5 THEN 'complement(join(' || (l_suppkey + 1) || ',' || (l_partkey + 1) || '..' || (l_partkey + 5) || '))'
            WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN (l_partkey + 1) || '^' || (l_partkey + 2) END
            ELSE 'order(' || (l_partkey + 1) || '.' || (l_partkey + 1 + qty) || ',' || (l_suppkey + 1) ||
                 CASE WHEN qty = 1 THEN '' ELSE '..' || (l_suppkey + qty) END || ')' END AS canonical,
          l_linenumber = 6 AND l_suppkey % 2 = 1 AS bad FROM x""",
    "location_segments": """WITH x AS (SELECT *, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
        s AS (
          SELECT l_orderkey, 'join' AS kind, l_partkey AS s, l_partkey + 1 AS e, 1 AS d, 0 AS i FROM x WHERE l_linenumber = 1
          UNION ALL SELECT l_orderkey, 'join', l_partkey, l_partkey + 1 + qty, CASE WHEN l_linenumber = 2 THEN 1 ELSE -1 END, 0 FROM x WHERE l_linenumber IN (2, 3)
          UNION ALL SELECT l_orderkey, 'join', l_partkey + 8999, l_partkey + 9000, -1, 0 FROM x WHERE l_linenumber = 4
          UNION ALL SELECT l_orderkey, 'join', l_suppkey, l_suppkey + 3, -1, 1 FROM x WHERE l_linenumber = 4
          UNION ALL SELECT l_orderkey, 'join', l_partkey, l_partkey + 5, -1, 0 FROM x WHERE l_linenumber = 5
          UNION ALL SELECT l_orderkey, 'join', l_suppkey, l_suppkey + 1, -1, 1 FROM x WHERE l_linenumber = 5
          UNION ALL SELECT l_orderkey, 'join', l_partkey + 1, l_partkey + 1, 1, 0 FROM x WHERE l_linenumber = 6 AND l_suppkey % 2 = 0
          UNION ALL SELECT l_orderkey, 'order', l_partkey, l_partkey + 1 + qty, 1, 0 FROM x WHERE l_linenumber = 7
          UNION ALL SELECT l_orderkey, 'order', l_suppkey, l_suppkey + qty, 1, 1 FROM x WHERE l_linenumber = 7)
        SELECT 'refseq:NC_' || l_orderkey AS outer, kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends,
               CAST(sum(d) AS BIGINT) AS strands, CAST(sum(i) AS BIGINT) AS places FROM s GROUP BY 1, 2""",
}
