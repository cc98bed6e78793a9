"""Queries that answer questions over nations, regions and suppliers, with the documents as text units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import graph as G
from ..session import load


def _key(kind, c):
    return F.concat(F.lit(kind), F.col(c).cast("string"))


def _nations(s, d):
    return load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _traders(s, d):
    return load(s, d, "supplier").join(load(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def entities(s, d):
    text, none = F.lit(None).cast("string"), F.array().cast("array<bigint>")
    out = load(s, d, "region").select(_key("region", "r_regionkey").alias("id"), F.lower("r_name").alias("name"), F.lit("region").alias("type"), text.alias("description"), none.alias("units"))
    k = F.col("n_nationkey").cast("long")
    out = out.unionByName(_nations(s, d).select(_key("nation", "n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.lit("nation").alias("type"), F.concat(F.lit("lies in "), F.lower("r_name")).alias("description"), F.array(k, k + 25, k + 50).alias("units")))
    return out.unionByName(_traders(s, d).select(_key("supplier", "s_suppkey").alias("id"), F.lower("s_name").alias("name"), F.lit("supplier").alias("type"), F.concat(F.lit("trades in "), F.lower("n_name")).alias("description"), F.array("s_suppkey").alias("units")))


def relationships(s, d):
    out = _nations(s, d).select(_key("nation", "n_nationkey").alias("src"), _key("region", "n_regionkey").alias("dst"), F.concat(F.lower("n_name"), F.lit(" lies in "), F.lower("r_name")).alias("description"))
    return out.unionByName(_traders(s, d).select(_key("supplier", "s_suppkey").alias("src"), _key("nation", "s_nationkey").alias("dst"), F.concat(F.lower("s_name"), F.lit(" trades in "), F.lower("n_name")).alias("description")))


def units(s, d):
    return load(s, d, "documents").select(F.col("doc_id").alias("unit_id"), F.concat(F.lit("nation_"), F.col("doc_id") % 25, F.lit(": "), F.col("text")).alias("text"))


def questions(s, d):
    """A question about each supplier's nation: exact, mistyped or wrapped names, or keywords only."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    named = F.when(k % 4 == 0, F.array(F.concat(F.lit("nation_"), nation), F.substring(F.lower("s_name"), 1, 17))).when(k % 4 == 1, F.array(F.concat(F.lit("naton_"), nation))).when(k % 4 == 2, F.array(F.concat(F.lit("all of nation_"), nation, F.lit(" and more")))).otherwise(F.array().cast("array<string>"))
    words = F.when(k % 4 == 3, F.array(F.lit("asia"), F.lit("f"))).otherwise(F.array(F.lit("zzz"), F.lit("nation")))
    kinds = F.lit(["global_search", "summary", "entity_search", "relation_search", "local_search"])
    return load(s, d, "supplier").select(k.alias("query_id"), named.alias("entities"), words.alias("keywords"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("type"), (0.5 + (k % 5) / 10).alias("confidence"), F.element_at(F.lit(["global", "local", "hybrid"]), (k % 3 + 1).cast("int")).alias("search"))


def members(s, d):
    """Regions with their nations on level 2, nations with their suppliers on level 1: (community, level, ord, name, type)."""
    row = lambda c, ck, level, o, ok, name, kind: (_key(c, ck).alias("community"), F.lit(level).alias("level"), _key(o, ok).alias("ord"), F.lower(name).alias("name"), F.lit(kind).alias("type"))
    out = load(s, d, "region").select(*row("region", "r_regionkey", 2, "region", "r_regionkey", "r_name", "region"))
    nation = load(s, d, "nation")
    out = out.unionByName(nation.select(*row("region", "n_regionkey", 2, "nation", "n_nationkey", "n_name", "nation")))
    out = out.unionByName(nation.select(*row("nation", "n_nationkey", 1, "nation", "n_nationkey", "n_name", "nation")))
    return out.unionByName(load(s, d, "supplier").select(*row("nation", "s_nationkey", 1, "supplier", "s_suppkey", "s_name", "supplier")))


def relations(s, d):
    out = _nations(s, d).select(_key("region", "n_regionkey").alias("community"), _key("nation", "n_nationkey").alias("ord"), F.concat(F.lower("n_name"), F.lit(" lies in "), F.lower("r_name")).alias("description"), F.lit("lies").alias("type"))
    return out.unionByName(_traders(s, d).select(_key("nation", "s_nationkey").alias("community"), _key("supplier", "s_suppkey").alias("ord"), F.concat(F.lower("s_name"), F.lit(" trades in "), F.lower("n_name")).alias("description"), F.when(F.col("s_suppkey") % 2 == 0, "trades").alias("type")))


def communities(s, d):
    m = members(s, d)
    titles = G.titles(m.groupBy(F.col("community").alias("component"), "type").agg(F.count("*").alias("n"))).select(F.col("component").alias("community"), F.concat("title", F.lit("社群")).alias("title"))
    sizes = m.groupBy("community", "level").agg(F.count("*").alias("size"))
    return sizes.join(titles, "community").join(G.summaries(m, relations(s, d)), "community")


def _targets(s, d):
    return G.written(A.matched_entities(questions(s, d), entities(s, d)))


def _related(s, d):
    return A.related_entities(_targets(s, d), relationships(s, d))


def _retrieved(s, d, t=None):
    return A.retrieved_units(t or _targets(s, d), relationships(s, d), entities(s, d))


def _network(s, d):
    t = _targets(s, d)
    nodes, edges = A.network(t, G.written(A.related_entities(t, relationships(s, d))), relationships(s, d))
    a = nodes.groupBy("query_id").agg(F.count("*").alias("nodes"), F.count_if("is_target").alias("targets"))
    return a.join(edges.groupBy("query_id").agg(F.count("*").alias("edges")), "query_id", "left").select("query_id", "nodes", "targets", F.coalesce("edges", F.lit(0)).alias("edges"))


def _evidence(s, d):
    t = _targets(s, d)
    return A.evidence_texts(A.primary_entities(t, entities(s, d)), _retrieved(s, d, t), units(s, d))


def _contexts(s, d):
    t = _targets(s, d)
    return A.entity_context(A.primary_entities(t, entities(s, d)), A.key_relationships(t, relationships(s, d)))


def _local(s, d):
    return A.local_search(questions(s, d), entities(s, d), relationships(s, d), units(s, d))


def _global(s, d):
    return A.global_search(questions(s, d), communities(s, d), members(s, d))


def _answers(s, d):
    return A.answered(questions(s, d), _global(s, d), _local(s, d))


def _flat(df):
    return df.withColumn("sources", F.md5(F.array_join("sources", "|")))


def _orders(s, d):
    """Orders as communities with the array of their parts, some of which are unknown."""
    part = F.col("l_partkey") + F.when(F.col("l_linenumber") == 3, 1_000_000_000).otherwise(0)
    return load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", part.alias("p")))), lambda x: x["p"]).alias("parts"))


QUERIES = {
    "entity_matches": lambda s, d: _targets(s, d).select("query_id", "id", "stage", "place"),
    "entity_related": _related,
    "unit_retrieval": lambda s, d: _retrieved(s, d).select("query_id", "unit_id", F.round("score", 6).alias("score"), "place"),
    "entity_focus": lambda s, d: A.primary_entities(_targets(s, d), entities(s, d)).select("query_id", "name", "place"),
    "relationship_keys": lambda s, d: A.key_relationships(_targets(s, d), relationships(s, d)).select("query_id", "src", "dst", "place"),
    "relationship_network": _network,
    "evidence_texts": lambda s, d: _evidence(s, d).select("query_id", "unit_id", "place"),
    "relationship_evidence": lambda s, d: A.relationship_evidence(A.key_relationships(_targets(s, d), relationships(s, d)), units(s, d)),
    "entity_contexts": _contexts,
    "local_answers": lambda s, d: _flat(_local(s, d)),
    "community_ranks": lambda s, d: A.community_relevance(questions(s, d), communities(s, d), members(s, d)).withColumn("p", F.row_number().over(A.W.partitionBy("query_id").orderBy(F.desc("score"), "community"))).where("p <= 5").select("query_id", "community", F.round("score", 6).alias("score"), F.col("p").alias("place")),
    "global_answers": lambda s, d: _flat(_global(s, d)),
    "answers": lambda s, d: _flat(_answers(s, d)),
    "answer_batches": lambda s, d: A.batch_summary(_answers(s, d)),
    "question_contexts": lambda s, d: A.query_context(questions(s, d).select("query_id", "type", F.when(F.col("query_id") % 2 == 0, "planning").otherwise("comparison").alias("intent"), F.size("entities").alias("n_entities"), F.size("keywords").alias("n_keywords"), "confidence")),
    "community_summaries": lambda s, d: G.summaries(members(s, d), relations(s, d)),
    "community_details": lambda s, d: G.detailed_summaries(communities(s, d).select("community", "title"), members(s, d).withColumn("rank", F.length("name")), relations(s, d)),
    "community_keywords": lambda s, d: G.community_keywords(members(s, d), relations(s, d)),
    "community_relation_types": lambda s, d: G.relation_type_counts(relations(s, d)),
    "community_members": lambda s, d: G.looked_up(_orders(s, d), "parts", load(s, d, "part").select("p_partkey", "p_name"), "p_partkey").select("community", "pos", "p_partkey", "p_name"),
    "community_units": lambda s, d: G.first_seen_units(_nations(s, d).select(_key("region", "n_regionkey").alias("community"), F.col("n_nationkey").alias("ord"), F.array(F.col("n_nationkey") % 7, F.col("n_nationkey") + 10, F.col("n_nationkey") * 1000).cast("array<bigint>").alias("units")), load(s, d, "documents").select(F.col("doc_id").alias("unit_id"))),
    "community_reported": lambda s, d: G.with_reports(members(s, d).select("community", "level").distinct(), communities(s, d).where("level = 2").select("community", "title", "summary", (F.col("size") / 10).alias("rank"))).withColumn("rank", F.round("rank", 6)),
    "community_flags": lambda s, d: _flags(s, d),
    "community_reports": lambda s, d: G.full_reports(communities(s, d).select("community", "title", (F.col("size") / 100).alias("rank")), members(s, d).withColumn("rank", F.length("name")), relations(s, d)).select("community", "entities", "relationships", F.to_json("entity_types").alias("entity_types"), F.to_json("relationship_types").alias("relationship_types"), F.array_join("keywords", ",").alias("keywords"), "importance"),
    "relationship_pairs": lambda s, d: G.directed_pairs(relationships(s, d).select("src", "dst", (F.length("src") % 2 == 0).alias("bidirectional"))),
    "extraction_prompts": lambda s, d: G.extraction_prompts(_turns(s, d)).select("document_id", "batch", F.array_join("unit_ids", ",").alias("unit_ids"), F.md5("prompt").alias("prompt")),
    "community_sizes": lambda s, d: G.size_statistics(members(s, d).groupBy("community", "level").agg(F.count("*").alias("size"))),
    "converted_entities": lambda s, d: G.converted_entities(load(s, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_size").alias("degree"), F.col("p_partkey").alias("id"))),
}


def _turns(s, d):
    """Turns of conversations as units, three to a batch of the first ten."""
    c = load(s, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") * 4).alias("chunk_index"), F.concat_ws("-", "conv_id", "turn").alias("unit_id"), "text")


def _flags(s, d):
    """Regions as parents of nations; numbers of members and relationships."""
    m = members(s, d).groupBy("community", "level").agg(F.count("*").alias("n_entities"))
    n = relations(s, d).groupBy("community").agg(F.count("*").alias("n_relationships"))
    up = load(s, d, "nation").select(_key("nation", "n_nationkey").alias("community"), _key("region", "n_regionkey").alias("parent"))
    rows = m.join(n, "community", "left").join(up, "community", "left").select("community", "parent", "n_entities", F.coalesce("n_relationships", F.lit(0)).alias("n_relationships"))
    return G.sized(rows, rows)


_NR = "nation JOIN region ON n_regionkey = r_regionkey"
_SN = "supplier JOIN nation ON s_nationkey = n_nationkey"
_BASE = f"""WITH ent AS MATERIALIZED (SELECT 'region' || r_regionkey AS id, lower(r_name) AS name, 'region' AS type, NULL::varchar AS description, []::bigint[] AS units FROM region
UNION ALL SELECT 'nation' || n_nationkey, lower(n_name), 'nation', 'lies in ' || lower(r_name), [n_nationkey::bigint, n_nationkey + 25, n_nationkey + 50] FROM {_NR}
UNION ALL SELECT 'supplier' || s_suppkey, lower(s_name), 'supplier', 'trades in ' || lower(n_name), [s_suppkey] FROM {_SN}),
rel AS MATERIALIZED (SELECT 'nation' || n_nationkey AS src, 'region' || n_regionkey AS dst, lower(n_name) || ' lies in ' || lower(r_name) AS description FROM {_NR} UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey, lower(s_name) || ' trades in ' || lower(n_name) FROM {_SN}),
un AS MATERIALIZED (SELECT doc_id AS unit_id, 'nation_' || (doc_id % 25) || ': ' || text AS text FROM documents),
q AS MATERIALIZED (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN ['nation_' || s_nationkey, substring(lower(s_name), 1, 17)] WHEN 1 THEN ['naton_' || s_nationkey] WHEN 2 THEN ['all of nation_' || s_nationkey || ' and more'] ELSE []::varchar[] END AS entities, CASE s_suppkey % 4 WHEN 3 THEN ['asia', 'f'] ELSE ['zzz', 'nation'] END AS keywords, ['global_search', 'summary', 'entity_search', 'relation_search', 'local_search'][s_suppkey % 5 + 1] AS type, 0.5::double + (s_suppkey % 5) / 10 AS confidence, ['global', 'local', 'hybrid'][s_suppkey % 3 + 1] AS search FROM supplier),
m AS MATERIALIZED (SELECT query_id, unnest(entities) AS mention, generate_subscripts(entities, 1) - 1 AS pos FROM q),
a AS MATERIALIZED (SELECT query_id, id, min(CASE WHEN name = mention THEN 1000 ELSE 2000 + pos END) AS k FROM m JOIN ent ON contains(name, mention) OR contains(mention, name) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT query_id, id, min(k) AS k FROM (SELECT * FROM a UNION ALL SELECT query_id, id, 3000 FROM q, ent WHERE query_id IN (SELECT q.query_id FROM q LEFT JOIN a USING (query_id) GROUP BY 1 HAVING count(a.id) < 5) AND (list_has_any(keywords, string_split(name, '')) OR list_has_any(keywords, string_split(coalesce(description, ''), ' ')))) GROUP BY 1, 2),
c AS (SELECT * FROM b UNION ALL SELECT query_id, id, 4000 + pos FROM m, ent WHERE query_id IN (SELECT q.query_id FROM q LEFT JOIN b USING (query_id) GROUP BY 1 HAVING count(b.id) < 3) AND levenshtein(mention, name) <= least(2, length(mention) // 2)),
t AS MATERIALIZED (SELECT query_id, id, (k // 1000)::int AS stage, place::int AS place FROM (SELECT query_id, id, k, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS place FROM (SELECT query_id, id, min(k) AS k FROM c GROUP BY 1, 2)) WHERE place <= 10),
u AS MATERIALIZED (SELECT src AS id, dst AS other FROM rel UNION SELECT dst, src FROM rel),
h1 AS MATERIALIZED (SELECT DISTINCT query_id, other AS id FROM t JOIN u USING (id) EXCEPT SELECT query_id, id FROM t),
h2 AS MATERIALIZED (SELECT DISTINCT query_id, other AS id FROM h1 JOIN u USING (id) EXCEPT (SELECT query_id, id FROM t UNION ALL SELECT * FROM h1)),
r AS MATERIALIZED (SELECT query_id, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS p FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)) WHERE p <= 20),
ids AS MATERIALIZED (SELECT query_id, id, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT query_id, id FROM t UNION ALL SELECT query_id, id FROM r)),
v AS MATERIALIZED (SELECT query_id, unit_id, score, place::int AS place FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS place FROM (SELECT query_id, unit_id, count(*) / any_value(total) AS score FROM ids JOIN (SELECT id, unnest(list_distinct(units)) AS unit_id FROM ent) USING (id) GROUP BY 1, 2)) WHERE place <= 20),
f AS MATERIALIZED (SELECT query_id, id, name, type, description, place::int AS place FROM (SELECT query_id, ent.*, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, length(coalesce(description, '')) DESC, name, id) AS place FROM t JOIN ent USING (id)) WHERE place <= 3),
kr AS MATERIALIZED (SELECT query_id, src, dst, description, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, description) AS place FROM (SELECT query_id, rel.* FROM t JOIN rel ON src = id UNION SELECT query_id, rel.* FROM t JOIN rel ON dst = id)) WHERE place <= 15),
ev AS MATERIALIZED (SELECT query_id, unit_id, text, place::int AS place FROM (SELECT query_id, unit_id, text, row_number() OVER (PARTITION BY query_id ORDER BY place, unit_id) AS place FROM (SELECT DISTINCT v.query_id, v.unit_id, v.place, un.text FROM v JOIN un USING (unit_id) JOIN f ON f.query_id = v.query_id AND contains(lower(un.text), lower(f.name)))) WHERE place <= 15),
loc AS (SELECT query_id, CASE WHEN type = 'relation_search' THEN 'relationship' WHEN type IN ('entity_search', 'local_search') THEN 'entity' WHEN len(entities) >= 2 THEN 'relationship' ELSE 'entity' END AS strategy, x.targets, coalesce(rn, 0) AS related, coalesce(kn, 0) AS relationships, coalesce(en, 0) AS evidence, x.fs || coalesce(es, []) AS sources, confidence AS c, quality FROM q JOIN (SELECT query_id, string_agg(name, ',' ORDER BY place) AS targets, list('實體: ' || name || ' (' || type || ')' ORDER BY place) AS fs, avg(CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0.7 END::double) AS quality FROM f GROUP BY 1) x USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS rn FROM r GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS kn FROM kr GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS en, list('文本證據: ' || substring(text, 1, 50) || '...' ORDER BY place) FILTER (place <= 5) AS es FROM ev GROUP BY 1) USING (query_id)),
lo AS MATERIALIZED (SELECT query_id, strategy, targets, related, relationships, evidence, sources, round(least(1, CASE strategy WHEN 'entity' THEN 0.5::double * c + 0.3::double * quality + least(relationships / 10, 0.2::double) ELSE 0.6::double * c + least(relationships / 10, 0.4::double) END), 6) AS confidence FROM loc),
mem AS MATERIALIZED (SELECT 'region' || r_regionkey AS community, 2 AS level, 'region' || r_regionkey AS ord, lower(r_name) AS name, 'region' AS type FROM region UNION ALL SELECT 'region' || n_regionkey, 2, 'nation' || n_nationkey, lower(n_name), 'nation' FROM nation UNION ALL SELECT 'nation' || n_nationkey, 1, 'nation' || n_nationkey, lower(n_name), 'nation' FROM nation UNION ALL SELECT 'nation' || s_nationkey, 1, 'supplier' || s_suppkey, lower(s_name), 'supplier' FROM supplier),
crel AS MATERIALIZED (SELECT 'region' || n_regionkey AS community, 'nation' || n_nationkey AS ord, lower(n_name) || ' lies in ' || lower(r_name) AS description, 'lies' AS type FROM {_NR} UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey, lower(s_name) || ' trades in ' || lower(n_name), CASE WHEN s_suppkey % 2 = 0 THEN 'trades' END FROM {_SN}),
summ AS MATERIALIZED (SELECT community, concat_ws('。', '這個社群包含 ' || n || ' 個實體：' || array_to_string(names[1:5], ', ') || CASE WHEN n > 5 THEN ' 等 ' || n || ' 個實體' ELSE '' END, CASE WHEN m > 0 THEN '主要關係包括：' || array_to_string(told[1:3], '; ') || CASE WHEN m > 3 THEN ' 等 ' || m || ' 個關係' ELSE '' END END) || '。' AS summary FROM (SELECT community, count(*) AS n, list(name ORDER BY ord) AS names FROM mem GROUP BY 1) LEFT JOIN (SELECT community, count(*) AS m, list(description ORDER BY ord) AS told FROM crel GROUP BY 1) USING (community)),
com AS MATERIALIZED (SELECT community, level, size, title || '社群' AS title, summary FROM (SELECT community, level, count(*) AS size FROM mem GROUP BY 1, 2) JOIN (SELECT community, arg_min(type, (-n, type)) AS title FROM (SELECT community, type, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1) USING (community) JOIN summ USING (community)),
sc AS MATERIALIZED (SELECT query_id, com.*, q.type AS kind, len(entities) AS ne, confidence AS c, round(least(1, 0.3::double * len(list_filter(list_distinct(keywords), lambda k: contains(lower(summary), lower(k)))) + 0.4::double * len(list_intersect(list_distinct(entities), names)) + CASE WHEN q.type IN ('global_search', 'summary') THEN level * 0.1::double ELSE 0 END + least(size / 10, 0.2::double)), 9) AS score FROM q, com JOIN (SELECT community, list(DISTINCT name) AS names FROM mem GROUP BY 1) USING (community)),
sr AS (SELECT *, CASE WHEN kind IN ('summary', 'comparison') OR (kind = 'global_search' AND ne > 3) THEN 'hierarchical' ELSE 'community' END AS strategy, row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, community) AS x, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS y FROM sc),
gl AS MATERIALIZED (SELECT query_id, strategy, string_agg(community, ',' ORDER BY CASE strategy WHEN 'hierarchical' THEN -level ELSE 0 END, CASE strategy WHEN 'hierarchical' THEN x ELSE y END) AS communities, CASE strategy WHEN 'hierarchical' THEN list('層級 ' || level || ': ' || title ORDER BY -level, x) ELSE flatten(list(['社群: ' || title, '摘要: ' || substring(summary, 1, 100) || '...'] ORDER BY y)) END AS sources, round(least(1, CASE strategy WHEN 'hierarchical' THEN 0.6::double + 0.1::double * count(DISTINCT level) + 0.05::double * count(*) ELSE 0.4::double * any_value(c) + 0.3::double + least(any_value(ne) / 5, 0.3::double) END), 6) AS confidence FROM sr WHERE (strategy = 'hierarchical' AND x <= 3) OR (strategy <> 'hierarchical' AND y <= 5) GROUP BY 1, 2),
ans AS MATERIALIZED (SELECT query_id, CASE WHEN ug OR ul THEN search ELSE 'fallback' END AS search, round(CASE WHEN ug AND ul THEN 0.6::double * gc + 0.4::double * lc WHEN ug THEN gc WHEN ul THEN lc ELSE 0.1 END, 6) AS confidence, (CASE WHEN ug THEN gs ELSE [] END || CASE WHEN ul THEN ls ELSE [] END)[1:20] AS sources FROM (SELECT q.query_id, search, gl.confidence AS gc, gl.sources AS gs, lo.confidence AS lc, lo.sources AS ls, gl.confidence IS NOT NULL AND search <> 'local' AS ug, lo.confidence IS NOT NULL AND search <> 'global' AS ul FROM q LEFT JOIN gl ON gl.query_id = q.query_id LEFT JOIN lo ON lo.query_id = q.query_id))
"""
ORACLES = {
    name: _BASE + sql
    for name, sql in {
        "entity_matches": "SELECT query_id, id, stage, place FROM t",
        "entity_related": "SELECT query_id, id, hop FROM r",
        "unit_retrieval": "SELECT query_id, unit_id, round(score, 6) AS score, place FROM v",
        "entity_focus": "SELECT query_id, name, place FROM f",
        "relationship_keys": "SELECT query_id, src, dst, place FROM kr",
        "relationship_network": "SELECT query_id, nodes, targets, coalesce(edges, 0) AS edges FROM (SELECT query_id, count(*) AS nodes, count(*) FILTER (tg) AS targets FROM (SELECT query_id, id, true AS tg FROM t UNION ALL SELECT query_id, id, false FROM r) GROUP BY 1) LEFT JOIN (SELECT x.query_id, count(*) AS edges FROM rel JOIN ids x ON x.id = src JOIN ids y ON y.id = dst AND y.query_id = x.query_id GROUP BY 1) USING (query_id)",
        "evidence_texts": "SELECT query_id, unit_id, place FROM ev",
        "relationship_evidence": "SELECT query_id, place, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM (SELECT query_id, place, min(unit_id) AS unit_id FROM (SELECT query_id, place, unnest(string_split(lower(description), ' ')) AS word FROM kr) JOIN (SELECT word, min(unit_id) AS unit_id FROM (SELECT DISTINCT unnest(string_split(lower(description), ' ')) AS word FROM kr), un WHERE contains(lower(text), word) GROUP BY 1) USING (word) GROUP BY 1, 2)) WHERE n <= 10",
        "entity_contexts": "SELECT query_id, concat_ws(chr(10), '目標實體：', x, CASE WHEN y IS NOT NULL THEN '關係：' || chr(10) || y END) AS context FROM (SELECT query_id, string_agg(place || '. ' || name || ' (' || type || '): ' || coalesce(description, '無描述'), chr(10) ORDER BY place) AS x FROM f GROUP BY 1) LEFT JOIN (SELECT query_id, string_agg('- ' || description, chr(10) ORDER BY place) AS y FROM kr GROUP BY 1) USING (query_id)",
        "local_answers": "SELECT query_id, strategy, targets, related, relationships, evidence, md5(array_to_string(sources, '|')) AS sources, confidence FROM lo",
        "community_ranks": "SELECT query_id, community, round(score, 6) AS score, y::int AS place FROM sr WHERE y <= 5",
        "global_answers": "SELECT query_id, strategy, communities, md5(array_to_string(sources, '|')) AS sources, confidence FROM gl",
        "answers": "SELECT query_id, search, confidence, md5(array_to_string(sources, '|')) AS sources FROM ans",
        "answer_batches": "SELECT search, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(len(sources)), 6) AS sources FROM ans GROUP BY 1",
        "question_contexts": "SELECT query_id, CASE WHEN type IN ('global_search', 'summary') THEN 'global_search' ELSE 'local_search' END AS method, len(entities) > 0 AS entity_focus, query_id % 2 = 0 AS reasoning, CASE WHEN confidence > 0.8 THEN 'high' ELSE 'medium' END AS complexity, concat_ws('|', CASE WHEN confidence < 0.6 THEN '查詢可能需要更明確的表達' END, CASE WHEN confidence < 0.6 AND len(entities) = 0 THEN '建議在查詢中包含具體的實體名稱' END, CASE WHEN confidence < 0.6 AND len(keywords) < 3 THEN '建議添加更多關鍵詞來明確查詢意圖' END, CASE type WHEN 'global_search' THEN '這是一個全域查詢，系統將基於整體知識圖譜回答' WHEN 'local_search' THEN '這是一個本地查詢，系統將基於相關實體詳細回答' END) AS hints FROM q",
        "community_summaries": "SELECT community, summary FROM summ",
        "community_details": "SELECT community, concat_ws('。', '這是一個名為「' || title || '」的社群', '包含 ' || n || ' 個實體和 ' || coalesce(m, 0) || ' 個關係', '主要實體包括：' || array_to_string(names[1:5], ', '), '實體類型分佈：' || types, '主要關係：' || array_to_string(told[1:3], '; ')) || '。' AS summary FROM com JOIN (SELECT community, count(*) AS n, list(name ORDER BY length(name) DESC, ord) AS names FROM mem GROUP BY 1) USING (community) JOIN (SELECT community, string_agg(n || '個' || type, ', ' ORDER BY -n, type) AS types FROM (SELECT community, type, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1) USING (community) LEFT JOIN (SELECT community, count(*) AS m, list(description ORDER BY ord) AS told FROM crel GROUP BY 1) USING (community)",
        "community_keywords": "SELECT community, keyword, place::int AS place FROM (SELECT community, keyword, row_number() OVER (PARTITION BY community ORDER BY keyword) AS place FROM (SELECT community, name AS keyword FROM mem UNION SELECT community, w FROM (SELECT community, unnest(string_split(description, ' ')) AS w FROM crel) WHERE length(w) > 2)) WHERE place <= 20",
        "community_relation_types": "SELECT community, coalesce(type, '未知') AS type, count(*) AS n FROM crel GROUP BY 1, 2",
        "community_members": "SELECT community, (pos - 1)::int AS pos, p_partkey, p_name FROM (SELECT community, unnest(parts) AS p_partkey, generate_subscripts(parts, 1) AS pos FROM (SELECT l_orderkey AS community, list(l_partkey + CASE WHEN l_linenumber = 3 THEN 1000000000 ELSE 0 END ORDER BY l_linenumber, l_suppkey, l_partkey) AS parts FROM lineitem GROUP BY 1)) JOIN part USING (p_partkey)",
        "community_units": "SELECT community, unit_id, (row_number() OVER (PARTITION BY community ORDER BY k, unit_id))::int AS place FROM (SELECT community, unit_id, min(k) AS k FROM (SELECT 'region' || n_regionkey AS community, n_nationkey * 10 + p AS k, [n_nationkey % 7, n_nationkey + 10, n_nationkey * 1000][p]::bigint AS unit_id FROM nation, (SELECT unnest([1, 2, 3]) AS p)) WHERE unit_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2)",
        "community_reported": "SELECT x.community, x.level, coalesce(title, '社群 ' || x.community) AS title, coalesce(summary, '') AS summary, round(coalesce(size / 10, 0), 6)::double AS rank FROM (SELECT DISTINCT community, level FROM mem) x LEFT JOIN (SELECT * FROM com WHERE level = 2) c ON c.community = x.community",
        "community_flags": "SELECT community, n + coalesce(m, 0) AS size, NOT contains(community, 'nation') AS is_root, contains(community, 'nation') AS is_leaf FROM (SELECT community, count(*) AS n FROM mem GROUP BY 1) LEFT JOIN (SELECT community, count(*) AS m FROM crel GROUP BY 1) USING (community)",
        "community_reports": """SELECT community, coalesce(n, 0) AS entities, coalesce(m, 0) AS relationships, et AS entity_types, rt AS relationship_types, kw AS keywords, round(0.3::double * least(coalesce(n, 0) / 20, 1) + 0.3::double * least(coalesce(m, 0) / 30, 1) + 0.2::double * least(nt / 5, 1) + 0.2::double * size / 100, 3) AS importance FROM com JOIN (SELECT community, sum(n)::bigint AS n, count(*) AS nt, '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' AS et FROM (SELECT community, type, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1) USING (community) LEFT JOIN (SELECT community, sum(n)::bigint AS m, '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' AS rt FROM (SELECT community, coalesce(type, '未知') AS type, count(*) AS n FROM crel GROUP BY 1, 2) GROUP BY 1) USING (community) JOIN (SELECT community, string_agg(keyword, ',' ORDER BY keyword) AS kw FROM (SELECT community, keyword, row_number() OVER (PARTITION BY community ORDER BY keyword) AS p FROM (SELECT community, name AS keyword FROM mem UNION SELECT community, w FROM (SELECT community, unnest(string_split(description, ' ')) AS w FROM crel) WHERE length(w) > 2)) WHERE p <= 20 GROUP BY 1) USING (community)""",
        "relationship_pairs": "SELECT src, dst FROM rel UNION ALL SELECT dst, src FROM rel WHERE length(src) % 2 = 0",
        "extraction_prompts": "SELECT conv_id AS document_id, (turn * 4 // 10)::int AS batch, string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS unit_ids, md5(string_agg('[' || conv_id || '-' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY 1, 2",
        "community_sizes": "SELECT level, count(*) AS n, round(avg(size), 6) AS mean, max(size) AS most, min(size) AS least FROM (SELECT community, level, count(*) AS size FROM mem GROUP BY 1, 2) GROUP BY GROUPING SETS ((), (level))",
        "converted_entities": "SELECT p_partkey::varchar AS id, trim(p_name) AS name, upper(p_type) AS type, '' AS description, p_size::double AS rank FROM part",
    }.items()
}
