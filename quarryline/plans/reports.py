"""Queries of reports, model choice, embedding quality and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as C
from ..operators import embeddings as E
from ..operators import metrics as M
from ..operators import questions as Q
from ..operators import reports as R
from ..session import load
from ..sources.files import parsed_graph

_ev = lambda s, d: load(s, d, "events")
_vec = lambda s, d: load(s, d, "embeddings")
_doc = lambda s, d: load(s, d, "documents")
_FAILED = lambda: F.col("event_type") == "error"
_TOKENS = lambda: F.from_json("props", "k int")["k"]


def _groups(s, d):
    g = M.error_groups(_ev(s, d), "event_type", "user_id")
    return g.withColumns({"category": F.substring("error_hash", 1, 1), "severity": F.when(F.col("n") % 2 == 0, "high").otherwise("low")})


def _alerts(s, d):
    return M.tiered_alerts(_ev(s, d), "value", {"critical": 90.0, "warning": 80.0}).join(_ev(s, d).select("event_id", "ts", "user_id"), "event_id").select(F.col("event_id").alias("alert_id"), "ts", F.col("severity").alias("level"), F.col("user_id").alias("key"), (F.col("event_id") % 3 == 0).alias("resolved"))


def _models(s, d):
    return load(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("model"), (F.col("s_nationkey") % 5).alias("kind"), (0.5 + (F.col("s_suppkey") % 50) / 100).alias("quality"), (F.abs("s_acctbal") / 1e6).alias("cost"), (F.col("s_suppkey") * 37 % 2000).cast("double").alias("latency"), F.when(F.col("s_suppkey") % 3 == 0, 0.9).alias("history"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("room"))


def _tasks(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_nationkey") % 5).alias("kind"), (F.col("c_custkey") % 1000).alias("size"), (0.5 + (F.col("c_custkey") % 4) / 10).alias("quality"), ((F.col("c_custkey") % 11) / 10).alias("cost_priority"))


def _adapters(s, d):
    return load(s, d, "supplier").select(F.col("s_name").alias("adapter"), "s_nationkey", (F.col("s_suppkey") % 4 != 1).alias("healthy"), ((F.col("s_suppkey") % 10) / 10).alias("weight"), ((F.col("s_suppkey") * 7 % 100) / 100).alias("success_rate"), ((F.col("s_suppkey") * 3 % 80) / 10).alias("mean_time")).withColumnRenamed("s_nationkey", "kind")


def _pairs(s, d):
    return _vec(s, d).select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


def _metrics(s, d):
    """Vectors of the languages' documents as models, their labels as domains; a third of the texts begins in Chinese."""
    rows = _vec(s, d).join(_doc(s, d), F.col("vec_id") == F.col("doc_id")).join(load(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    text = F.when(F.col("vec_id") % 3 == 0, F.concat(F.repeat(F.lit("中文文本"), F.length("text")), "text")).otherwise(F.col("text"))
    rows = rows.select(F.col("lang").alias("model"), "vec_id", "embedding", text.alias("text"), F.col("label").alias("domain"), "quality")
    return E.model_metrics(rows, _pairs(s, d), E.length_pairs(_pairs(s, d), rows))


def _responses(s, d):
    """An answer in JSON about each supplier, fenced for half of them, broken for every seventh."""
    rows = load(s, d, "supplier").join(load(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda c, name: c.cast("string").alias(name)
    entities = F.array(F.struct(text(F.col("s_name"), "name"), F.lit("company").alias("type"), text(F.col("n_name"), "description")), F.struct(F.concat(F.lit(" "), "n_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, "place").alias("type"), F.lit("").alias("description")))
    relations = F.array(F.struct(text(F.col("s_name"), "source"), text(F.col("n_name"), "target"), F.lit("trades in").alias("description")), F.struct(text(F.col("n_name"), "source"), text(F.col("n_name"), "target"), F.lit("itself").alias("description")))
    told = F.to_json(F.struct(entities.alias("entities"), relations.alias("relationships")))
    fenced = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).otherwise(told)
    return rows.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.substring(fenced, 1, 40)).otherwise(fenced).alias("answer"))


def _files(s, d):
    return _doc(s, d).select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.octet_length("text").alias("size"), F.md5("text").alias("hash"), "doc_id")


def _registered(s, d):
    f, k = _files(s, d), F.col("doc_id") % 9
    return f.select(F.when(k == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(k == 2, 1).otherwise(0)).alias("size"), F.when(k == 3, "x").otherwise(F.col("hash")).alias("hash"))


def _changes(s, d):
    kind = F.element_at(F.lit(["added", "modified", "deleted"]), (F.col("event_id") % 3 + 1).cast("int"))
    return _ev(s, d).select(F.col("event_id").alias("change_id"), kind.alias("change"), (F.col("event_id") % 4 == 0).alias("processed"), F.when(F.col("event_id") % 10 == 7, "broken").alias("error"), M.seconds("ts").alias("at"))


QUERIES = {
    "benchmark_summary": lambda s, d: R.benchmark_summary(_ev(s, d), "event_type"),
    "error_rollup": lambda s, d: R.error_rollup(_groups(s, d)),
    "recent_errors": lambda s, d: R.recent_errors(_groups(s, d)).select("error_hash", "n", "last_seen"),
    "cost_statistics": lambda s, d: R.cost_statistics(_ev(s, d), "user_id", _FAILED(), "value", _TOKENS()),
    "query_statistics": lambda s, d: R.query_statistics(load(s, d, "conversations").where("role = 'user'"), F.length("text").cast("double"), F.col("conv_id") % 3 == 0, Q.pattern_key(F.col("text"))),
    "batch_statistics": lambda s, d: R.batch_statistics(_ev(s, d).groupBy("user_id").agg(F.count("*").alias("size"), F.sum("value").alias("seconds"), (F.count_if(_FAILED()) * 4 < F.count("*")).alias("ok"))),
    "adapter_metrics": lambda s, d: R.adapter_metrics(_ev(s, d), "user_id", _FAILED(), _TOKENS()),
    "change_statistics": lambda s, d: R.change_statistics(_files(s, d).select("size", (F.col("doc_id") % 2 == 0).alias("indexed")), _changes(s, d)),
    "api_statistics": lambda s, d: R.api_statistics(_ev(s, d), _FAILED(), "2024-02-01 00:00:00"),
    "model_report": lambda s, d: R.model_report(_ev(s, d), "event_type", _FAILED()),
    "quality_gate": lambda s, d: R.quality_gate(_ev(s, d).groupBy(F.col("event_type").alias("suite")).agg(F.count("*").alias("tests"), F.count_if(F.col("value") > 90).alias("failures")), 0.97),
    "alert_query": lambda s, d: R.alert_page(_alerts(s, d), ["critical"], list(range(50)), True, 50).select("alert_id", "level", "key"),
    "alert_log": lambda s, d: R.trimmed(_alerts(s, d), 100, 50).select("alert_id"),
    "handler_statistics": lambda s, d: R.handler_statistics(_groups(s, d), _ev(s, d).where(_FAILED()).select((F.col("user_id") % 5).alias("handler")), 1706745600),
    "service_summary": lambda s, d: R.service_summary(_ev(s, d).select(F.col("event_type").alias("service"), (F.col("event_type") < "f").alias("loaded"), (F.col("value") < 80).alias("ok"), "value")),
    "optimization_report": lambda s, d: R.optimization_report(_ev(s, d), _FAILED(), F.col("user_id") % 3 == 0, "2024-01-15 00:00:00").select("performance.requests", "performance.success_rate", "performance.mean_time", "cost.total", "cost.largest", "cache.hits", "cache.hit_rate"),
    "table_samples": lambda s, d: R.table_sample(load(s, d, "nation"), "n_nationkey"),
    "history_pages": lambda s, d: R.history_page(load(s, d, "orders"), F.col("o_orderstatus") == "O", [F.desc("o_orderdate"), "o_orderkey"], 10, 25).select("o_orderkey", "total", "has_more"),
    "cleaned_tasks": lambda s, d: R.cleaned_tasks(load(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), M.seconds("o_orderdate").alias("ended")), 946684800, 24 * 365, ["F", "P"]).select("o_orderkey"),
    "historical_performance": lambda s, d: R.historical_performance(_ev(s, d).withColumn("quality", F.col("value") / 100), s.range(200).withColumnRenamed("id", "user_id"), "user_id", _FAILED()),
    "optimal_models": lambda s, d: R.optimal_model(_models(s, d), _tasks(s, d)),
    "best_adapters": lambda s, d: R.best_adapter(_adapters(s, d)),
    "best_values": lambda s, d: R.best_value(_models(s, d), 0.7),
    "macro_scores": lambda s, d: R.macro_scores(_doc(s, d).select("lang", F.when(F.col("doc_id") % 7 == 0, "en").when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("found")), "lang", "found"),
    "similarity_spread": lambda s, d: E.similarity_spread(_vec(s, d)),
    "pair_consistency": lambda s, d: E.consistency(_pairs(s, d), _vec(s, d)),
    "similarity_matrix": lambda s, d: E.similarity_matrix(_vec(s, d), [0, 1, 2, 3, 4, 5]).withColumn("cosine", F.round("cosine", 6)),
    "chinese_metrics": lambda s, d: E.chinese_metrics(_vec(s, d).join(_doc(s, d), F.col("vec_id") == F.col("doc_id")).select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("中文文本"), F.substring("text", 1, 5))).otherwise(F.col("text")).alias("text")), _vec(s, d)),
    "parsed_entities": lambda s, d: parsed_graph(_responses(s, d), "s_suppkey", "answer")[0],
    "parsed_relations": lambda s, d: parsed_graph(_responses(s, d), "s_suppkey", "answer")[1],
    "quality_scores": lambda s, d: E.model_scores(_metrics(s, d)),
    "field_scores": lambda s, d: _doc(s, d).select("doc_id", F.round(E.field_score([(F.col("text"), 1.0), (F.col("source"), 2.0)], ["license", "o", "web"], [2.0, 1.0, 1.0]), 6).alias("score")),
    "sparse_terms": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(E.sparse_terms(F.create_map("p_type", F.col("p_size") * 1.0, F.lit("zz"), F.lit(20.0), "p_brand", F.col("p_partkey") % 40 * 1.0), 2), ",").alias("terms")),
    "strict_entities": lambda s, d: C.strict_entities(load(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("name"), F.lit(" org ").alias("type"), (F.col("s_suppkey") % 13 / 10).alias("confidence"))).select("id", "name", "type", "broken"),
    "strict_relationships": lambda s, d: C.strict_relationships(load(s, d, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("src"), (F.col("l_partkey") % 20).cast("string").alias("dst"), F.when(F.col("l_quantity") > 45, "").otherwise("sells").alias("description"), (F.col("l_discount") * 11).alias("weight"))).groupBy("broken").agg(F.count("*").alias("n")),
    "strict_units": lambda s, d: C.strict_units(_doc(s, d).select("doc_id", "text", (F.col("doc_id") % 5 - 1).alias("start"), (F.col("doc_id") % 7).alias("end"), F.col("doc_id").alias("chunk_index"))).select("doc_id", "broken"),
    "clean_ids": lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(C.clean_ids(F.split(F.concat(F.lit(" b, ,"), "p_name", F.lit(",b,"), "p_brand", F.lit(", "), "p_brand"), ",")), "|").alias("ids")),
    "registry_files": lambda s, d: C.registry_against_files(_registered(s, d), _files(s, d)),
    "timestamp_issues": lambda s, d: C.timestamp_issues(_ev(s, d).select("event_id", F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 8 == 0, F.date_format("ts", "dd.MM.yyyy")).when(F.col("event_id") % 8 == 1, F.lit("2024-13-01")).when(F.col("event_id") % 8 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at")), "event_id", ["event_type"], ["at"]),
    "fixable_issues": lambda s, d: C.fixable(C.registry_against_files(_registered(s, d), _files(s, d)), {"missing": "remove", "size": "reindex"}),
    "label_keys": lambda s, d: load(s, d, "part").select("p_partkey", C.label_key(F.lit("parts"), F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")).alias("key")),
    "merged_maps": lambda s, d: load(s, d, "part").select("p_partkey", F.to_json(C.merged_maps(F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_brand"), F.create_map(F.lit("b"), "p_name", F.lit("c"), F.lit("x")))).alias("merged")),
    "processed_changes": lambda s, d: C.marked_processed(_changes(s, d), _ev(s, d).where(_FAILED()).select(F.col("event_id").alias("change_id"), F.when(F.col("event_id") % 2 == 0, "late").alias("error"))).groupBy("change", "processed", "error").agg(F.count("*").alias("n")),
    "purged_changes": lambda s, d: C.purged(_changes(s, d), 1705276800).groupBy("change", "processed").agg(F.count("*").alias("n")),
    "question_routes": lambda s, d: load(s, d, "part").select("p_partkey", Q.route(F.col("p_name"), {"red": "a", "small widget and more": "b", "gear": "c"}).alias("route")),
    "composite_keys": lambda s, d: load(s, d, "part").select("p_partkey", F.md5(Q.composite_key(F.concat(F.lit(" "), F.upper("p_name")), F.col("p_type"), F.lit("x"), F.array("p_brand", F.lit("A")), F.split("p_name", " "))).alias("key")),
    "answer_confidences": lambda s, d: load(s, d, "part").select("p_partkey", F.round(Q.layered_confidence(F.col("p_size") % 4, F.col("p_partkey") % 9), 6).alias("layered"), F.round(Q.hybrid_confidence(F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 100), F.when(F.col("p_size") % 2 > 0, F.lit(0.5))), 6).alias("hybrid")),
    "admitted_answers": lambda s, d: Q.cached(load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 10).alias("at")), load(s, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 10 - 5).alias("cached_at"), F.col("o_orderkey").alias("answer"), (F.col("o_orderkey") % 10 / 10).alias("confidence")), 20000, 0.5),
    "json_round_trip": lambda s, d: load(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j")).select(F.from_json("j", "n_nationkey int, n_name string").alias("x")).select("x.*"),
}

_X = "json_extract(props, '$.k')::int"
_OK = "(event_type <> 'error')"
_G = "(SELECT md5(event_type || ':' || user_id::varchar)[1:16] AS error_hash, count(*) AS n, floor(epoch(max(ts)))::bigint AS last_seen FROM events GROUP BY 1)"
_AL = "(SELECT event_id AS alert_id, ts, CASE WHEN value > 90 THEN 'critical' ELSE 'warning' END AS level, user_id AS key, event_id % 3 = 0 AS resolved FROM events WHERE value > 80)"
_MO = "(SELECT s_suppkey::varchar AS model, s_nationkey % 5 AS kind, 0.5::double + (s_suppkey % 50) / 100 AS quality, abs(s_acctbal) / 1e6 AS cost, (s_suppkey * 37 % 2000)::double AS latency, CASE WHEN s_suppkey % 3 = 0 THEN 0.9::double END AS history, (s_suppkey % 7 + 1)::double AS room FROM supplier)"
_TA = "(SELECT c_custkey AS task_id, c_nationkey % 5 AS kind, c_custkey % 1000 AS size, 0.5::double + (c_custkey % 4) / 10 AS quality, (c_custkey % 11) / 10 AS p FROM customer)"
_FI = "(SELECT source || '/' || doc_id AS path, strlen(text) AS size, md5(text) AS hash, doc_id FROM documents)"
_RE = f"(SELECT CASE WHEN doc_id % 9 = 1 THEN path || '.gone' ELSE path END AS path, size + (doc_id % 9 = 2)::int AS size, CASE WHEN doc_id % 9 = 3 THEN 'x' ELSE hash END AS hash FROM {_FI})"
_IS = f"(SELECT r.path, CASE WHEN f.size IS NULL THEN 'missing' WHEN r.size <> f.size THEN 'size' WHEN r.hash <> f.hash THEN 'hash' END AS issue FROM {_RE} r LEFT JOIN {_FI} f ON f.path = r.path)"
_CH = "(SELECT event_id AS change_id, ['added', 'modified', 'deleted'][event_id % 3 + 1] AS change, event_id % 4 = 0 AS processed, CASE WHEN event_id % 10 = 7 THEN 'broken' END AS error, floor(epoch(ts))::bigint AS stamp FROM events)"
_U = "(SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, embedding::double[] AS v FROM embeddings))"
_COUNT = "{w}::double * {f}::double * ((length(lower({t})) - length(replace(lower({t}), '{k}', ''))) / {n})"


def _field(words, weights):
    parts = []
    for k, w in zip(words, weights, strict=True):
        a, b = (_COUNT.format(w=w, f=f, t=t, k=k, n=len(k)) for t, f in (("text", 1.0), ("source", 2.0)))
        parts.append(f"CASE WHEN contains(lower(text), '{k}') THEN {a} WHEN contains(lower(source), '{k}') THEN {b} ELSE 0 END")
    return f"least(1, ({' + '.join(parts)}) / {sum(weights)}::double)"


QUALITY_SQL = """
WITH r AS MATERIALIZED (SELECT lang AS model, vec_id, CAST(embedding AS double[]) AS x, CASE WHEN vec_id % 3 = 0 THEN repeat('中文文本', length(text)) || text ELSE text END AS text, label AS domain, quality FROM embeddings JOIN documents ON vec_id = doc_id LEFT JOIN labels USING (doc_id) WHERE len(list_filter(embedding, lambda v: v <> 0)) > 0),
v AS MATERIALIZED (SELECT *, sqrt(list_dot_product(x, x)) AS norm, coalesce(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / nullif(length(text), 0), 0) AS share FROM r),
l AS MATERIALIZED (SELECT model, domain, share >= 0.3 AS chinese, unnest(x) AS x, unnest(list_transform(x, lambda e: e / norm)) AS u, generate_subscripts(x, 1) AS dim FROM v),
a AS (SELECT model, count(*) AS n, coalesce(avg(quality), 0) AS quality, avg(share) AS ratio, avg(norm) AS norm_mean, stddev_pop(norm) AS norm_std FROM v GROUP BY 1),
w AS (SELECT model, avg(CASE WHEN qx / n - (sx / n) * (sx / n) > 1e-4 THEN 1.0::double ELSE 0 END) AS used, sum(s * s) - max(n) AS every, max(n) AS k FROM (SELECT model, dim, sum(u) AS s, sum(x) AS sx, sum(x * x) AS qx, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT model, sum(sq - k) AS inside, sum(k * (k - 1)) AS inside_pairs FROM (SELECT model, domain, sum(s * s) AS sq, max(n) AS k FROM (SELECT model, domain, dim, sum(u) AS s, count(*) AS n FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT model, (sum(s * s) - sum(q)) / nullif(max(n) * (max(n) - 1), 0) AS coherence FROM (SELECT model, dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM l WHERE chinese GROUP BY 1, 2) GROUP BY 1),
p AS MATERIALIZED (SELECT f.model, f.vec_id AS fid, g.vec_id AS gid, f.model AS fm, g.model AS gm, length(f.text) AS fl, length(g.text) AS gl, list_dot_product(f.x, g.x) / (f.norm * g.norm) AS cosine FROM v f JOIN v g ON g.vec_id = f.vec_id + 1),
m AS (SELECT model, avg(cosine) AS semantic FROM p GROUP BY 1),
h AS (SELECT CASE WHEN fl <= gl THEN fm ELSE gm END AS model, avg(cosine) AS length FROM p WHERE least(fl, gl) > 0 AND greatest(fl, gl) >= 2 * least(fl, gl) GROUP BY 1),
t AS (SELECT model, n, quality, ratio, norm_mean, norm_std, used, coalesce(every / nullif(k * (k - 1), 0), 0) AS similarity, coalesce(coherence, 0) AS coherence, coalesce(semantic, 0) AS semantic, coalesce(length, 0) AS length, coalesce(inside / nullif(inside_pairs, 0), 0) - coalesce((every - inside) / nullif(k * (k - 1) - inside_pairs, 0), 0) AS separation FROM a JOIN w USING (model) JOIN i USING (model) LEFT JOIN c USING (model) LEFT JOIN m USING (model) LEFT JOIN h USING (model))
SELECT model, n, round(quality, 6) AS quality, round(ratio, 6) AS ratio, round(norm_mean, 6) AS norm_mean, round(norm_std, 6) AS norm_std, round(used, 6) AS used, round(similarity, 6) AS similarity, round(coherence, 6) AS coherence, round(semantic, 6) AS semantic, round(length, 6) AS length, round(separation, 6) AS separation,
 round(greatest(0, least(1, 0.3::double * greatest(0, least(1, quality)) + 0.4::double * greatest(0, least(1, ((1 - least(norm_std, 0.5::double)) + used + (1 - abs(greatest(-1, least(1, similarity))))) / 3)) + 0.3::double * greatest(0, least(1, (least(ratio / 0.3::double, 1) + (greatest(-1, least(1, coherence)) + 1) / 2) / 2)))), 6) AS overall,
 round(0.2::double * least(ratio / 0.8::double, 1) + 0.25::double * greatest(0, 1 - abs(norm_mean - 1)) * greatest(0, 1 - norm_std) + 0.25::double * least(greatest(semantic, 0), 1) + 0.15::double * least(greatest(length, 0), 1) + 0.15::double * least(greatest(separation, 0) / 0.2::double, 1), 3) AS chinese
FROM t
"""
ORACLES = {
    "benchmark_summary": "WITH s AS (SELECT event_type, list_sort(list(value)) AS x, count(*) AS n, avg(value) AS m, sum(value) AS t FROM events GROUP BY 1), q AS (SELECT *, greatest(1, least(floor((n + 1) * 0.5), n - 1))::int AS c, greatest(1, least(floor((n + 1) * 0.95), n - 1))::int AS a, greatest(1, least(floor((n + 1) * 0.99), n - 1))::int AS b FROM s) SELECT event_type, n AS runs, round(m, 6) AS mean, x[1] AS fastest, x[-1] AS slowest, round(n / t, 6) AS throughput, round(x[c] * (1 - ((n + 1) * 0.5 - c)) + x[c + 1] * ((n + 1) * 0.5 - c), 6) AS median, round(x[a] * (1 - ((n + 1) * 0.95 - a)) + x[a + 1] * ((n + 1) * 0.95 - a), 6) AS p95, round(x[b] * (1 - ((n + 1) * 0.99 - b)) + x[b + 1] * ((n + 1) * 0.99 - b), 6) AS p99 FROM q",
    "error_rollup": f"SELECT category, severity, sum(n)::bigint AS errors, count(*) AS unique_errors FROM (SELECT *, error_hash[1:1] AS category, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM {_G}) GROUP BY GROUPING SETS ((category), (severity))",
    "recent_errors": f"SELECT error_hash, n, last_seen FROM {_G} ORDER BY last_seen DESC, error_hash LIMIT 20",
    "cost_statistics": f"SELECT user_id, count(*) AS requests, round(sum(value), 4) AS cost, sum({_X})::bigint AS tokens, round(sum(value) / nullif(sum({_X}), 0), 6) AS cost_per_token, round(avg(value), 6) AS latency, round(avg({_OK}::int::double), 6) AS success_rate FROM events GROUP BY 1",
    "query_statistics": f"SELECT pattern, count(*) AS n, round(sum(t), 4) AS total, round(avg(t), 6) AS mean, min(t) AS least, max(t) AS most, round(avg(hit::int::double), 6) AS hit_rate FROM (SELECT concat_ws('+', CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END, {', '.join(f'CASE WHEN contains(lower(text), {chr(39)}{w}{chr(39)}) THEN {chr(39)}{w}{chr(39)} END' for w in ('what', 'how', 'why', 'where'))}) AS pattern, length(text)::double AS t, conv_id % 3 = 0 AS hit FROM conversations WHERE role = 'user') GROUP BY GROUPING SETS ((), (pattern))",
    "batch_statistics": "SELECT count(*) AS batches, round(avg(ok::int::double), 6) AS success_rate, round(avg(size), 6) AS mean_size, (sum(size) FILTER (ok))::bigint AS items, round(sum(size) FILTER (ok) / sum(seconds) FILTER (ok), 6) AS throughput FROM (SELECT count(*) AS size, sum(value) AS seconds, (count(*) FILTER (event_type = 'error')) * 4 < count(*) AS ok FROM events GROUP BY user_id)",
    "adapter_metrics": f"SELECT user_id, count(*) AS requests, round(avg({_OK}::int::double), 6) AS success_rate, round(avg(value) FILTER {_OK.replace('(event', '(WHERE event')}, 6) AS mean_time, sum({_X})::bigint AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY 1",
    "change_statistics": f"SELECT * FROM (SELECT count(*) AS files, count(*) FILTER (doc_id % 2 = 0) AS indexed, sum(size)::bigint AS bytes FROM {_FI}), (SELECT count(*) AS changes, count(*) FILTER (NOT processed) AS pending, count(error) AS failed, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted FROM {_CH})",
    "api_statistics": f"SELECT up AS uptime, n AS requests, success_percent, latency, round(n / up, 6) AS per_second, last_hour, last_hour_latency FROM (SELECT 1706745600 - floor(epoch(min(ts)))::bigint AS up, count(*) AS n, round(100 * avg({_OK}::int::double), 4) AS success_percent, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS latency, count(*) FILTER (floor(epoch(ts)) >= 1706742000) AS last_hour, round(avg(value) FILTER (floor(epoch(ts)) >= 1706742000), 6) AS last_hour_latency FROM events)",
    "model_report": f"SELECT event_type, count(*) AS tests, round(avg(value), 3) AS mean_time, round(1 / avg(value), 3) AS throughput, round(max(value), 3) AS peak, round(avg({_OK}::int::double), 3) AS success_rate FROM events GROUP BY 1",
    "quality_gate": "SELECT suite, tests, failures, round((tests - failures) / tests, 6) AS pass_rate, (tests - failures) / tests >= 0.97 AS passed FROM (SELECT event_type AS suite, count(*) AS tests, count(*) FILTER (value > 90) AS failures FROM events GROUP BY GROUPING SETS ((), (event_type)))",
    "alert_query": f"SELECT alert_id, level, key FROM {_AL} WHERE NOT resolved AND level = 'critical' AND key < 50 ORDER BY ts DESC, alert_id LIMIT 50",
    "alert_log": f"SELECT alert_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, alert_id) AS p, count(*) OVER () AS n FROM {_AL}) WHERE n <= 100 OR p <= 50",
    "handler_statistics": f"SELECT * FROM (SELECT count(*) AS unique_errors, sum(n)::bigint AS errors, count(*) FILTER (last_seen >= 1706745600 - 86400) AS last_day FROM {_G}), (SELECT count(*) AS handled, count(DISTINCT user_id % 5) AS handlers FROM events WHERE event_type = 'error')",
    "service_summary": "SELECT event_type AS service, event_type < 'f' AS loaded, count(*) AS requests, round(avg((value < 80)::int::double), 4) AS success_rate, round(avg(value), 4) AS mean_time, (SELECT count(DISTINCT event_type) FROM events WHERE event_type < 'f') AS loaded_services FROM events GROUP BY 1, 2",
    "optimization_report": f"SELECT count(*) AS requests, round(avg({_OK}::int::double), 6) AS success_rate, round(avg(value), 6) AS mean_time, round(sum(value), 4) AS total, round(max(value), 4) AS largest, count(*) FILTER (user_id % 3 = 0) AS hits, round(avg((user_id % 3 = 0)::int::double), 6) AS hit_rate FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "table_samples": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS sample, (SELECT count(*) FROM nation) AS n_rows, 'n_nationkey,n_name,n_regionkey' AS columns FROM nation ORDER BY n_nationkey LIMIT 5""",
    "history_pages": "SELECT o_orderkey, total, total > 35 AS has_more FROM (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10",
    "cleaned_tasks": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND floor(epoch(o_orderdate)) <= 946684800 - 3600 * 24 * 365)",
    "historical_performance": f"SELECT i AS user_id, round(coalesce(q, 0.8), 6) AS quality, round(coalesce(l, 1000), 6) AS latency, round(coalesce(s, 0.95), 6) AS success FROM range(200) t(i) LEFT JOIN (SELECT user_id, avg(value / 100) AS q, avg(value) AS l, avg({_OK}::int::double) AS s FROM events GROUP BY 1) ON user_id = i",
    "optimal_models": f"SELECT task_id, arg_min(model, (-score, model)) AS model, round(max(score), 6) AS score FROM (SELECT task_id, model, round(p / (1 + cost * size) + (1 - p) * (0.6::double * m.quality + 0.2::double / (1 + latency / 1000) + 0.2::double * coalesce(history, m.quality)), 9) AS score FROM {_TA} t JOIN {_MO} m USING (kind) WHERE m.quality >= t.quality AND cost * size <= room) GROUP BY 1",
    "best_adapters": "SELECT kind, arg_min(adapter, (-score, adapter)) AS adapter, round(max(score), 6) AS score FROM (SELECT s_name AS adapter, s_nationkey AS kind, round((s_suppkey % 10) / 10 + 0.3::double * ((s_suppkey * 7 % 100) / 100) - CASE WHEN s_suppkey * 3 % 80 > 0 THEN least((s_suppkey * 3 % 80) / 10 / 10, 0.5::double) ELSE 0 END, 9) AS score FROM supplier WHERE s_suppkey % 4 <> 1) GROUP BY 1",
    "best_values": f"SELECT kind, arg_min(model, (-value, model)) AS model, round(max(value), 6) AS value FROM (SELECT kind, model, round(quality / greatest(cost, 0.001::double), 9) AS value FROM {_MO} WHERE quality >= 0.7::double) GROUP BY 1",
    "macro_scores": "WITH p AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS found FROM documents), l AS (SELECT label, (SELECT count(*) FROM p WHERE lang = label) AS a, (SELECT count(*) FROM p WHERE found = label) AS q, (SELECT count(*) FROM p WHERE lang = label AND found = label) AS h FROM (SELECT lang AS label FROM p UNION SELECT found FROM p)), s AS (SELECT label, coalesce(h / nullif(q, 0), 0) AS pr, coalesce(h / nullif(a, 0), 0) AS re FROM l) SELECT label, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1 FROM s GROUP BY GROUPING SETS ((), (label))",
    "similarity_spread": f"WITH u AS MATERIALIZED {_U}, c AS (SELECT list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT (SELECT count(*) FROM u) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM c",
    "pair_consistency": f"WITH u AS MATERIALIZED {_U} SELECT count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM (SELECT list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)",
    "similarity_matrix": f"WITH u AS MATERIALIZED (SELECT * FROM {_U} WHERE vec_id < 6) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS cosine FROM u a, u b",
    "chinese_metrics": "WITH t AS MATERIALIZED (SELECT vec_id, embedding::double[] AS v, CASE WHEN vec_id % 3 = 0 THEN '中文文本' || substring(text, 1, 5) ELSE text END AS text FROM embeddings JOIN documents ON doc_id = vec_id), r AS (SELECT *, len(regexp_extract_all(text, '[一-鿿]')) / length(text) AS share FROM t WHERE text <> ''), c AS MATERIALIZED (SELECT * FROM r WHERE share >= 0.3) SELECT count(*) AS texts, count(*) FILTER (share >= 0.3) AS chinese, round(avg(share), 6) AS ratio_mean, round(stddev_pop(share), 6) AS ratio_std, round(avg(length(text)), 6) AS mean_length, round(avg(len(regexp_extract_all(text, '[a-zA-Z0-9]+|[一-鿿]'))), 6) AS mean_words, (SELECT round(coalesce(avg(list_dot_product(a.v, b.v)), 0), 6) FROM c a JOIN c b ON a.vec_id <> b.vec_id) AS coherence FROM r",
    "parsed_entities": "SELECT s_suppkey, s_name AS name, 'COMPANY' AS type, n_name AS description, 1.0::double AS rank FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey, n_name, CASE WHEN s_suppkey % 3 > 0 THEN 'PLACE' ELSE 'UNKNOWN' END, '', 1 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0",
    "parsed_relations": "SELECT s_suppkey, s_name AS source, n_name AS target, 'trades in' AS description, 0.8::double AS weight, 'related_to' AS type FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0",
    "quality_scores": QUALITY_SQL,
    "field_scores": f"SELECT doc_id, round({_field(['license', 'o', 'web'], [2.0, 1.0, 1.0])}, 6) AS score FROM documents",
    "sparse_terms": "SELECT p_partkey, array_to_string(list_transform(list_sort([{'w': -p_size * 1.0::double, 't': p_type}, {'w': -20.0::double, 't': 'zz'}, {'w': -(p_partkey % 40) * 1.0::double, 't': p_brand}])[1:2], lambda x: x.t), ',') AS terms FROM part",
    "strict_entities": "SELECT id, name, 'ORG' AS type, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN c > 1 THEN 'confidence' END) AS broken FROM (SELECT s_suppkey::varchar AS id, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS name, s_suppkey % 13 / 10 AS c FROM supplier)",
    "strict_relationships": "SELECT broken, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN l_suppkey % 20 = l_partkey % 20 THEN 'loop' END, CASE WHEN l_quantity > 45 THEN 'description' END, CASE WHEN l_discount * 11 > 1 THEN 'weight' END) AS broken FROM lineitem) GROUP BY 1",
    "strict_units": "SELECT doc_id, concat_ws(',', CASE WHEN trim(text, ' ') = '' THEN 'text' END, CASE WHEN doc_id % 5 - 1 < 0 OR doc_id % 7 <= doc_id % 5 - 1 THEN 'range' END) AS broken FROM documents",
    "clean_ids": "SELECT p_partkey, array_to_string(list_sort(list_distinct(['b', p_name, p_brand])), '|') AS ids FROM part",
    "registry_files": f"SELECT path, issue FROM {_IS} WHERE issue IS NOT NULL",
    "timestamp_issues": "SELECT event_id, 'event_type' AS field, 'missing' AS issue FROM events WHERE event_id % 9 = 0 UNION ALL SELECT event_id, 'at', 'time' FROM events WHERE event_id % 8 < 2",
    "fixable_issues": f"SELECT issue, CASE issue WHEN 'missing' THEN 'remove' WHEN 'size' THEN 'reindex' END AS action, count(*) AS n FROM {_IS} WHERE issue IS NOT NULL GROUP BY 1, 2",
    "label_keys": """SELECT p_partkey, 'parts:{"brand":"' || p_brand || '","type":"' || p_type || '"}' AS key FROM part""",
    "merged_maps": """SELECT p_partkey, '{"a":"' || p_type || '","b":"' || p_name || '","c":"x"}' AS merged FROM part""",
    "processed_changes": f"SELECT change, processed OR event_type = 'error' AS processed, coalesce(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'late' END, error) AS error, count(*) AS n FROM {_CH} JOIN events ON event_id = change_id GROUP BY 1, 2, 3",
    "question_routes": "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'a' WHEN contains('small widget and more', p_name) THEN 'b' WHEN contains(p_name, 'gear') THEN 'c' ELSE 'default' END AS route FROM part",
    "composite_keys": "SELECT p_partkey, md5(p_name || '|' || p_type || '|x|' || array_to_string(list_sort([p_brand, 'A']), '_') || '|' || array_to_string(list_sort(string_split(p_name, ' ')), '_')) AS key FROM part",
    "answer_confidences": "SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 THEN 0 ELSE least(1, 0.6::double + 0.1::double * (p_size % 4) + 0.05::double * (p_partkey % 9)) END, 6)::double AS layered, round(CASE WHEN p_size % 3 > 0 AND p_size % 2 > 0 THEN 0.6::double * p_size / 100 + 0.2::double WHEN p_size % 3 > 0 THEN p_size / 100 WHEN p_size % 2 > 0 THEN 0.5::double ELSE 0.1::double END, 6) AS hybrid FROM part",
    "admitted_answers": "SELECT a.o_orderkey AS id, max(b.o_orderkey) AS answer FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey * 10 - 5 <= a.o_orderkey * 10 AND b.o_orderkey * 10 - 5 > a.o_orderkey * 10 - 20000 AND b.o_orderkey % 10 >= 5 GROUP BY 1",
    "json_round_trip": "SELECT n_nationkey, n_name FROM nation",
    "purged_changes": f"SELECT change, processed, count(*) AS n FROM {_CH} WHERE NOT (processed AND stamp < 1705276800) GROUP BY 1, 2",
}
