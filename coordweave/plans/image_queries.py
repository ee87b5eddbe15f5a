"""Registered queries over mappings that several stores hold in different cuts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.images import common_blocks, shared_pieces
from . import tables as tb
from .oracles import ORACLES
from .queries import query


def _stores(spark, sf):
    """The blocks of all orders; those of two orders in three cut at a third; and stretches over every odd line's second half."""
    lay = tb.layout(spark, sf)
    line = F.when(F.col("rev"), F.col("src") + F.col("tgt") + F.col("len")).otherwise(F.col("tgt") - F.col("src"))
    lay = lay.withColumn("at", line)

    def part(rows, name, start, length):
        cut = rows.select("f", "t", "rev", "at", start.cast("long").alias("src"), length.cast("long").alias("len")).where("len > 0")
        tgt = F.when(F.col("rev"), F.col("at") - F.col("src") - F.col("len")).otherwise(F.col("at") + F.col("src"))
        return cut.select(
            F.concat(F.lit(name), F.col("f").cast("string")).alias("edge_key"), F.col("src").alias("ix"), F.col("f").alias("src_ref"), "src", F.col("t").alias("tgt_ref"),
            tgt.alias("tgt"), "len", "rev",
        )

    src, n = F.col("src"), F.col("len")
    third = F.floor(n / 3)
    some = lay.where("f % 3 > 0")
    second = part(some, "b", src, third).unionByName(part(some, "b", src + third, n - third))
    return part(lay, "a", src, n), second, part(lay.where("l_linenumber % 2 = 1"), "c", src + F.floor(n / 2), n)


_BLOCKS = """l AS (SELECT s.*, CASE WHEN rev THEN src + tgt + len ELSE tgt - src END AS ln, l_linenumber AS n FROM
    (SELECT l_orderkey AS f, l_suppkey AS t, l_linenumber, CAST(l_quantity AS BIGINT) AS len, l_partkey * 20 AS tgt, l_returnflag = 'R' AS rev,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - CAST(l_quantity AS BIGINT) AS src FROM lineitem) s),
  b AS (SELECT 0 AS m, 'a' || f AS edge, f, t, rev, ln, src AS s, src + len AS e FROM l
    UNION ALL SELECT 1, 'b' || f, f, t, rev, ln, src, src + len // 3 FROM l WHERE f % 3 > 0 AND len // 3 > 0
    UNION ALL SELECT 1, 'b' || f, f, t, rev, ln, src + len // 3, src + len FROM l WHERE f % 3 > 0 AND len - len // 3 > 0
    UNION ALL SELECT 2, 'c' || f, f, t, rev, ln, src + len // 2, src + len // 2 + len FROM l WHERE n % 2 = 1 AND len > 0)"""


@query
def common_images(spark, sf):
    """The longest blocks that three stores make up together: equal images once."""
    found = common_blocks(*_stores(spark, sf), ladder=(6,))
    return found.select("edge_key", F.col("ix.mapping").alias("store"), "src_ref", "src", "tgt_ref", "tgt", "len", "rev", "n_blocks")


ORACLES["common_images"] = f"""WITH {_BLOCKS},
  o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY f, t, rev, ln ORDER BY s, m, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM b),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY f, t, rev, ln ORDER BY s, m, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
  SELECT arg_min(edge, m * 1000000000000 + s) AS edge_key, CAST(min(m) AS INTEGER) AS store, f AS src_ref, CAST(min(s) AS BIGINT) AS src, t AS tgt_ref,
    CAST(CASE WHEN rev THEN ln - max(e) ELSE ln + min(s) END AS BIGINT) AS tgt, CAST(max(e) - min(s) AS BIGINT) AS len, rev, count(*) AS n_blocks
  FROM i GROUP BY f, t, rev, ln, island"""


@query
def shared_images(spark, sf):
    """The longest pieces that the same number of three stores hold."""
    return shared_pieces(*_stores(spark, sf))


ORACLES["shared_images"] = f"""WITH {_BLOCKS},
  o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY m, f, t, rev, ln ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM b),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY m, f, t, rev, ln ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
  u AS (SELECT f, t, rev, ln, min(s) AS s, max(e) AS e FROM i GROUP BY m, f, t, rev, ln, island),
  v AS (SELECT f, t, rev, ln, p, sum(d) AS d FROM (SELECT f, t, rev, ln, s AS p, 1 AS d FROM u UNION ALL SELECT f, t, rev, ln, e, -1 FROM u) GROUP BY ALL HAVING sum(d) <> 0),
  w AS (SELECT *, sum(d) OVER (PARTITION BY f, t, rev, ln ORDER BY p) AS depth, lead(p) OVER (PARTITION BY f, t, rev, ln ORDER BY p) AS q FROM v)
  SELECT f AS src_ref, CAST(p AS BIGINT) AS src, t AS tgt_ref, CAST(CASE WHEN rev THEN ln - q ELSE ln + p END AS BIGINT) AS tgt, CAST(q - p AS BIGINT) AS len, rev,
    CAST(depth AS BIGINT) AS n_mappings FROM w WHERE depth > 0"""
