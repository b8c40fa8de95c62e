"""Dependency graphs whose edges come from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import strong_components
from ..operators.graph import clean_edges, cycle_members, dependency_levels, reachable, relatives
from .registry import Sample, query


def _tree(t: Sample) -> DataFrame:
    """Every customer hangs on the one with a tenth of its number."""
    return t.customer.select(
        F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 10).alias("parent"))


@query("dependency_levels", """
WITH RECURSIVE l(node, level) AS (
  SELECT CAST(0 AS BIGINT), 0
  UNION ALL SELECT c_custkey, level + 1 FROM customer JOIN l ON c_custkey // 10 = node
  WHERE c_custkey > 0)
SELECT node, level FROM l
""")
def _(t: Sample):
    return dependency_levels(_tree(t), t.customer.select(F.col("c_custkey").alias("node")))


_CYCLIC_SQL = """
e AS (SELECT DISTINCT child, parent FROM (
    SELECT c_custkey AS child, c_custkey // 10 AS parent FROM customer WHERE c_custkey > 0
    UNION ALL SELECT c_custkey // 10, c_custkey FROM customer
      WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND c_custkey > 0))
"""


def _cyclic(t: Sample) -> DataFrame:
    back = t.customer.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(
        F.floor(F.col("c_custkey") / 10).alias("child"), F.col("c_custkey").alias("parent"))
    return _tree(t).unionByName(back)


@query("clean_edges", f"WITH {_CYCLIC_SQL} SELECT child, parent, false AS deferrable FROM e")
def _(t: Sample):
    return clean_edges(_cyclic(t), t.customer.select(F.col("c_custkey").alias("node")))


@query("cycle_members", f"""
WITH RECURSIVE {_CYCLIC_SQL},
core AS (SELECT a.child AS node FROM e a JOIN e b ON a.child = b.parent AND a.parent = b.child),
up(node) AS (SELECT node FROM core UNION SELECT e.parent FROM e JOIN up ON e.child = up.node),
down(node) AS (SELECT node FROM core UNION SELECT e.child FROM e JOIN down ON e.parent = down.node)
SELECT DISTINCT node, false AS all_deferrable FROM up WHERE node IN (SELECT node FROM down)
""")
def _(t: Sample):
    return cycle_members(_cyclic(t))


@query("strong_components", """
WITH loops AS (SELECT greatest(c_custkey - 7, 0) AS a, c_custkey AS b FROM customer
               WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 7000 AND c_custkey > 0),
starts AS (SELECT *, coalesce(a > max(b) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM loops),
spans AS (SELECT min(a) AS a, max(b) AS b FROM (SELECT *, sum(opens::INTEGER) OVER (ORDER BY b) AS k FROM starts) GROUP BY k)
SELECT c_custkey AS node, coalesce(a, c_custkey) AS component, coalesce(b - a + 1, 1)::BIGINT AS size
FROM customer LEFT JOIN spans ON c_custkey BETWEEN a AND b
""")
def _(t: Sample):
    """One chain through all customers, closed backwards at some of them."""
    key = F.col("c_custkey")
    chain = t.customer.filter(key > 0).select(key.alias("child"), (key - 1).alias("parent"))
    loops = t.customer.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 7000 AND c_custkey > 0").select(
        F.greatest(key - 7, F.lit(0)).alias("child"), key.alias("parent"))
    return strong_components(chain.unionByName(loops), t.customer.select(key.alias("node")))


@query("reachable_parents", """
WITH RECURSIVE r(node, distance) AS (
  SELECT c_custkey, 0 FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION SELECT node // 10, distance + 1 FROM r WHERE node > 0)
SELECT node, min(distance) AS distance FROM r GROUP BY node
""")
def _(t: Sample):
    seeds = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    return reachable(_tree(t), seeds, "parents")


@query("reachable_children", """
WITH RECURSIVE r(node, distance) AS (
  SELECT c_custkey, 0 FROM customer WHERE c_acctbal > 9000
  UNION SELECT c_custkey, distance + 1 FROM customer JOIN r ON c_custkey // 10 = node
  WHERE c_custkey > 0 AND distance < 2)
SELECT node, min(distance) AS distance FROM r GROUP BY node
""")
def _(t: Sample):
    seeds = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("node"))
    return reachable(_tree(t), seeds, "children", depth=2)


_CHAIN_SEED = "c_mktsegment = 'MACHINERY' AND c_acctbal > 9000"


@query("reachable_chain", f"""
WITH s AS (SELECT *, min(CASE WHEN {_CHAIN_SEED} THEN c_custkey END) OVER (
             ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS seed FROM customer)
SELECT c_custkey AS node, (seed - c_custkey)::INTEGER AS distance FROM s WHERE seed IS NOT NULL
""")
def _(t: Sample):
    """One chain through all customers, followed down from a few of them."""
    key = F.col("c_custkey")
    chain = t.customer.filter(key > 0).select(key.alias("child"), (key - 1).alias("parent"))
    return reachable(chain, t.customer.filter(_CHAIN_SEED).select(key.alias("node")), "parents")


@query("chain_levels", """
SELECT c_custkey AS node, (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS level FROM customer
""")
def _(t: Sample):
    """As many levels as there are customers."""
    key = F.col("c_custkey")
    skips = t.customer.filter(key > 5).select(key.alias("child"), F.floor(key / 3).alias("parent"))
    chain = t.customer.filter(key > 0).select(key.alias("child"), (key - 1).alias("parent"))
    return dependency_levels(chain.unionByName(skips), t.customer.select(key.alias("node")))


@query("relatives", """
WITH RECURSIVE named AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9500),
down(node, d) AS (SELECT node, 0 FROM named
  UNION SELECT c_custkey, d + 1 FROM customer JOIN down ON c_custkey // 10 = node
  WHERE c_custkey > 0 AND d < 1),
got AS (SELECT node, min(d) AS d FROM down GROUP BY node),
up(node) AS (SELECT node FROM got UNION SELECT node // 10 FROM up WHERE node > 0)
SELECT node, CASE d WHEN 0 THEN 'named' ELSE 'child(' || d || ')' END AS why FROM got
UNION ALL SELECT node, 'parent' FROM up WHERE node NOT IN (SELECT node FROM got)
""")
def _(t: Sample):
    named = t.customer.filter("c_acctbal > 9500").select(F.col("c_custkey").alias("node"))
    return relatives(_tree(t), named, with_children=True, depth=1)
