"""Queries over the graph of regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import load


def edges(s, d):
    """Foreign keys as edges over an id subset: customers of the first ten nations and suppliers of the first five, as in the
    SQL of the queries below. `whole_edges` has all of them and the lines."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = load(s, d, "nation").select(key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"))
    out = out.unionByName(load(s, d, "customer").where("c_nationkey < 10").select(key("customer", "c_custkey").alias("src"), key("nation", "c_nationkey").alias("dst")))
    return out.unionByName(load(s, d, "supplier").where("s_nationkey < 5").select(key("supplier", "s_suppkey").alias("src"), key("nation", "s_nationkey").alias("dst")))


def nodes(s, d):
    one = lambda t, k, kind: load(s, d, t).select(F.concat(F.lit(kind), F.col(k).cast("string")).alias("node"), F.lit(kind).alias("type"))
    return one("region", "r_regionkey", "region").unionByName(one("nation", "n_nationkey", "nation")).unionByName(one("customer", "c_custkey", "customer")).unionByName(one("supplier", "s_suppkey", "supplier"))


def whole_edges(s, d):
    """All foreign keys as edges; lines join suppliers and parts, each pair once."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = load(s, d, "nation").select(key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"))
    out = out.unionByName(load(s, d, "customer").select(key("customer", "c_custkey").alias("src"), key("nation", "c_nationkey").alias("dst")))
    out = out.unionByName(load(s, d, "supplier").select(key("supplier", "s_suppkey").alias("src"), key("nation", "s_nationkey").alias("dst")))
    # pairs of numbers are told apart before they are written out as names
    pairs = load(s, d, "lineitem").select("l_suppkey", "l_partkey").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL").distinct()
    return out.unionByName(pairs.select(key("supplier", "l_suppkey").alias("src"), key("part", "l_partkey").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL")


def whole_nodes(s, d):
    part = load(s, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("node"), F.lit("part").alias("type"))
    return nodes(s, d).unionByName(part)


def whole_labels(s, d, edges=None):
    return G.components(whole_nodes(s, d), edges or whole_edges(s, d))


def _whole_inner(s, d):
    e = G.written(whole_edges(s, d))
    return G.inner_edges(whole_labels(s, d, e), e)


def _whole_reports(s, d):
    e = G.written(whole_edges(s, d))
    return G.reports(whole_labels(s, d, e), whole_nodes(s, d), e)


def labels(s, d):
    return G.components(nodes(s, d), edges(s, d))


def _some(s, d):
    return nodes(s, d).where("type <> 'nation' OR node < 'nation2'")


def _start(s, d):
    return nodes(s, d).where("node IN ('region1', 'supplier3')")


def _mentions(s, d):
    o = load(s, d, "orders")
    pairs = o.select((F.col("o_orderkey") % 10).alias("batch"), F.concat(F.lit("p"), F.col("o_custkey") % 20).alias("source"), F.concat(F.lit("p"), F.col("o_orderkey") % 25).alias("target"))
    ents = load(s, d, "customer").select((F.col("c_custkey") % 10).alias("batch"), F.concat(F.lit("p"), F.col("c_custkey") % 23).alias("name"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    return G.resolved(pairs, ents)


QUERIES = {
    "graph_components": labels,
    "graph_communities": lambda s, d: G.communities(labels(s, d)),
    "graph_community_titles": lambda s, d: G.titles(G.type_counts(labels(s, d), nodes(s, d))),
    "graph_type_counts": lambda s, d: G.type_counts(labels(s, d), nodes(s, d)),
    "graph_inner_edges": lambda s, d: G.inner_edges(labels(s, d), edges(s, d)),
    "graph_reports": lambda s, d: G.reports(labels(s, d), nodes(s, d), edges(s, d)),
    "graph_k_hop": lambda s, d: G.k_hop(_start(s, d), edges(s, d)),
    "graph_known_edges": lambda s, d: G.known_edges(edges(s, d), _some(s, d)).select("src", "dst"),
    "graph_dangling_edges": lambda s, d: G.dangling_edges(edges(s, d), _some(s, d)),
    "graph_incident_edges": lambda s, d: G.incident_edges(edges(s, d), _start(s, d)).select("src", "dst"),
    "graph_resolved": lambda s, d: _mentions(s, d).groupBy("batch", "src", "dst").agg(F.count("*").alias("n")),
    "graph_degree": lambda s, d: G.degree(edges(s, d)),
    "graph_relevance": lambda s, d: G.relevance(G.reports(labels(s, d), nodes(s, d), edges(s, d)), ["nation1", "customer", "region"], F.col("names"), F.col("size")).select("component", "relevance"),
}
# the same over all nodes and edges, without SQL: tests compare them with brute force
QUERIES |= {
    "graph_whole_components": whole_labels,
    "graph_whole_communities": lambda s, d: G.communities(whole_labels(s, d)),
    "graph_whole_type_counts": lambda s, d: G.type_counts(whole_labels(s, d), whole_nodes(s, d)),
    "graph_whole_inner_edges": _whole_inner,
    "graph_whole_reports": _whole_reports,
    "graph_whole_k_hop": lambda s, d: G.k_hop(_start(s, d), whole_edges(s, d)),
    "graph_whole_incident_edges": lambda s, d: G.incident_edges(whole_edges(s, d), _start(s, d)).select("src", "dst"),
    "graph_whole_degree": lambda s, d: G.degree(whole_edges(s, d)),
}

_E = "e AS (SELECT 'nation' || n_nationkey AS src, 'region' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer' || c_custkey, 'nation' || c_nationkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey FROM supplier WHERE s_nationkey < 5), n AS (SELECT 'region' || r_regionkey AS node, 'region' AS type FROM region UNION ALL SELECT 'nation' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier' || s_suppkey, 'supplier' FROM supplier)"
# every edge of these tables leads towards a region, so a node's tree is the set of nodes with its root
_TREE = f"WITH {_E}, up AS (SELECT node, coalesce(e3.dst, e2.dst, e1.dst, node) AS root FROM n LEFT JOIN e e1 ON e1.src = node LEFT JOIN e e2 ON e2.src = e1.dst LEFT JOIN e e3 ON e3.src = e2.dst), l AS (SELECT node, min(node) OVER (PARTITION BY root) AS component FROM up), c AS (SELECT component, size, round(size / (SELECT count(*) FROM l), 6) AS rank FROM (SELECT component, count(*) AS size FROM l GROUP BY 1) WHERE size >= 3), t AS (SELECT component, type, count(*) AS n FROM l JOIN n USING (node) GROUP BY 1, 2), b AS (SELECT component, arg_min(type, (-n, type)) AS title FROM t GROUP BY 1), i AS (SELECT a.component, src, dst FROM e JOIN l a ON a.node = src JOIN l z ON z.node = dst WHERE a.component = z.component), r AS (SELECT component, size, coalesce(ne, 0) AS edges, types, title, names, round(0.3::double * least(size / 20, 1) + 0.3::double * least(coalesce(ne, 0) / 30, 1) + 0.2::double * least(types / 5, 1) + 0.2::double * rank, 4) AS importance FROM c LEFT JOIN (SELECT component, count(*) AS ne FROM i GROUP BY 1) USING (component) JOIN (SELECT component, count(*) AS types FROM t GROUP BY 1) USING (component) JOIN b USING (component) JOIN (SELECT component, array_to_string(list_sort(list(node))[1:5], ',') AS names FROM l GROUP BY 1) USING (component))"
_U = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_K = "k AS (SELECT node FROM n WHERE type <> 'nation' OR node < 'nation2')"
ORACLES = {
    "graph_components": f"{_TREE} SELECT node, component FROM l",
    "graph_communities": f"{_TREE} SELECT component, size, rank FROM c",
    "graph_community_titles": f"{_TREE} SELECT component, title FROM b",
    "graph_type_counts": f"{_TREE} SELECT component, type, n FROM t",
    # a node's tree is that of its region, and both ends of an edge are in one
    "graph_inner_edges": """WITH l AS (SELECT 'region' || r_regionkey AS node, r_regionkey AS root FROM region UNION ALL SELECT 'nation' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'customer' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey < 10 UNION ALL SELECT 'supplier' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey < 5), c AS MATERIALIZED (SELECT root, min(node) AS component FROM l GROUP BY 1)
SELECT component, 'nation' || n_nationkey AS src, 'region' || n_regionkey AS dst FROM nation JOIN c ON root = n_regionkey
UNION ALL SELECT component, 'customer' || c_custkey, 'nation' || c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN c ON root = n_regionkey WHERE c_nationkey < 10
UNION ALL SELECT component, 'supplier' || s_suppkey, 'nation' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN c ON root = n_regionkey WHERE s_nationkey < 5""",
    "graph_reports": f"{_TREE} SELECT * FROM r",
    "graph_k_hop": f"WITH {_E}, {_U}, h AS (SELECT 'region1' AS node, 0 AS hop UNION SELECT 'supplier3', 0), h1 AS (SELECT DISTINCT dst AS node, 1 AS hop FROM u JOIN h ON src = node), h2 AS (SELECT DISTINCT dst AS node, 2 AS hop FROM u JOIN h1 ON src = node) SELECT node, min(hop) AS hop FROM (SELECT * FROM h UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1",
    "graph_known_edges": f"WITH {_E}, {_K} SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)",
    "graph_dangling_edges": f"WITH {_E}, {_K} SELECT DISTINCT src, dst FROM e WHERE src NOT IN (SELECT node FROM k) OR dst NOT IN (SELECT node FROM k)",
    "graph_incident_edges": f"WITH {_E} SELECT DISTINCT src, dst FROM e WHERE src IN ('region1', 'supplier3') OR dst IN ('region1', 'supplier3')",
    "graph_resolved": "WITH i AS (SELECT c_custkey % 10 AS batch, 'p' || (c_custkey % 23) AS name, max(c_custkey) AS id FROM customer GROUP BY 1, 2), m AS (SELECT o_orderkey % 10 AS batch, 'p' || (o_custkey % 20) AS source, 'p' || (o_orderkey % 25) AS target FROM orders) SELECT m.batch, a.id AS src, b.id AS dst, count(*) AS n FROM m JOIN i a ON a.batch = m.batch AND a.name = source JOIN i b ON b.batch = m.batch AND b.name = target GROUP BY 1, 2, 3",
    "graph_degree": f"WITH {_E}, {_U} SELECT src AS node, count(*) AS degree FROM u GROUP BY 1",
    "graph_relevance": f"{_TREE} SELECT component, round(least(1.0::double, least(size / 10, 0.2::double) + 0.3::double * (contains(lower(names), 'nation1')::int + contains(lower(names), 'customer')::int + contains(lower(names), 'region')::int)), 6) AS relevance FROM r",
}
