"""Queries of vector and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import quantized as Z
from ..operators import vectors as O
from ..session import load

_vec = lambda s, d: load(s, d, "embeddings")
_doc = lambda s, d: load(s, d, "documents")
WORDS = ["the", "que", "und", "tion"]


def _query(s, d, id_=0):
    found = _vec(s, d).where(F.col("vec_id") == id_).first()
    if found is None:
        raise ValueError(f"no vector has the id {id_}")
    return list(found["embedding"])


def _dense(s, d, k, id_=0, name="vec_id"):
    return O.dense_search(_vec(s, d), _query(s, d, id_), k).withColumnRenamed("vec_id", name)


def hybrid(s, d, k=10, method="rrf"):
    keyword = O.keyword_search(_doc(s, d), "doc_id", "text", WORDS, 100)
    return O.fused([(_dense(s, d, 100, name="doc_id"), 0.7), (keyword, 0.3)], "doc_id", k, method).select("doc_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "lists")


def multi_vector(s, d, method):
    lists = [(_dense(s, d, 20, i), w) for i, w in ((0, 1.0), (1, 0.5), (2, 0.25))]
    return O.fused(lists, "vec_id", 10, method).select("vec_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "lists")


def _quantized(s, d, exact):
    """The ten nearest of every vector whose id is divisible by 50, by the index of all vectors. These vectors lie about
    evenly in their space, so the approximate search looks into nine cells of ten."""
    v = _vec(s, d)
    q = Z.fitted(v)
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return Z.search(v, Z.index(v, q), q, asked, 10, probes=-(-9 * len(q.centres) // 10), refine=20, exact=exact).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


QUERIES = {
    "dense_topk": lambda s, d: _dense(s, d, 10).select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity")),
    "semantic_topk": lambda s, d: O.semantic_search(_vec(s, d), lambda text: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.ascii(F.substr(text, i % F.length(text) + 1, F.lit(1))) / 1000 - 0.1), "which vectors are near", 10).select("vec_id", F.round("distance", 6).alias("distance")),
    "dense_topk_filtered": lambda s, d: O.dense_search(_vec(s, d), _query(s, d), 10, F.col("label").isin(1, 2, 3)).select("vec_id", F.round("distance", 6).alias("distance")),
    "batch_topk": lambda s, d: O.batch_search(_vec(s, d), _vec(s, d).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 6).alias("distance")),
    "quantized_topk": lambda s, d: _quantized(s, d, False),
    "quantized_exact_topk": lambda s, d: _quantized(s, d, True),
    "keyword_topk": lambda s, d: O.keyword_search(_doc(s, d), "doc_id", "text", ["benchmark", "license", "gewbe", "password"], 20).select("doc_id", F.round("similarity", 6).alias("similarity")),
    "keyword_scores": lambda s, d: _doc(s, d).select("doc_id", F.round(O.keyword_score(F.col("text"), ["license", "rights"], [2.0, 1.0]), 6).alias("score")),
    "hybrid_rrf": lambda s, d: hybrid(s, d),
    "hybrid_weighted": lambda s, d: hybrid(s, d, 10, "weighted"),
    "multi_vector_sum": lambda s, d: multi_vector(s, d, "weighted"),
    "multi_vector_max": lambda s, d: multi_vector(s, d, "max"),
    "multi_vector_mean": lambda s, d: multi_vector(s, d, "mean"),
    "group_separation": lambda s, d: O.group_separation(_vec(s, d)),
    "vector_statistics": lambda s, d: O.collection_statistics(_vec(s, d)),
    "dimension_use": lambda s, d: O.dimension_use(_vec(s, d)),
    "vector_validation": lambda s, d: O.invalid_vectors(_vec(s, d).withColumn("embedding", F.when(F.col("vec_id") % 40 == 0, F.lit(None)).when(F.col("vec_id") % 41 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))), 64),
    "unit_vectors": lambda s, d: _vec(s, d).select("vec_id", F.round(V.norm(V.unit(V.doubles(F.col("embedding")))), 6).alias("norm"), F.round(F.element_at(V.unit(V.doubles(F.col("embedding"))), 1), 6).alias("first")),
}

_D = "list_sum(list_transform(list_zip(e.embedding::double[], q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_L = "(SELECT vec_id, label, {d} AS distance FROM embeddings e, (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = {i}) q)"


def _near(i, k):
    return f"(SELECT vec_id, 1 / (1 + distance) AS similarity FROM {_L.format(d=_D, i=i)} ORDER BY distance, vec_id LIMIT {k})"


def _score(words, weights=None, text="text"):
    weights = weights or [1.0] * len(words)
    parts = " + ".join(f"{w}::double * ((length(lower({text})) - length(replace(lower({text}), '{k}', ''))) / {len(k)})" for k, w in zip(words, weights, strict=True))
    return f"least(1.0::double, ({parts}) / {sum(weights)}::double)"


def _keyword(words, k):
    return f"(SELECT doc_id, {_score(words)} AS similarity FROM documents WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} ORDER BY similarity DESC, doc_id LIMIT {k})"


def _fuse(lists, id_, score):
    rows = " UNION ALL ".join(f"SELECT {id_}, similarity, {w}::double AS weight, row_number() OVER (ORDER BY similarity DESC, {id_}) AS place FROM {sql} t{n}" for n, (sql, w) in enumerate(lists))
    return f"SELECT {id_}, round(score, 6) AS score, round(similarity, 6) AS similarity, lists FROM (SELECT {id_}, round({score}, 9) AS score, max(similarity) AS similarity, count(*) AS lists FROM ({rows}) GROUP BY 1 ORDER BY score DESC, {id_} LIMIT 10)"


_dense_docs = f"(SELECT vec_id AS doc_id, similarity FROM {_near(0, 100)})"
_multi = [(_near(0, 20), 1.0), (_near(1, 20), 0.5), (_near(2, 20), 0.25)]
ORACLES = {
    "dense_topk": f"SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM {_L.format(d=_D, i=0)} ORDER BY 2, 1 LIMIT 10",
    "semantic_topk": f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings e, (SELECT list_transform(range(1, 65), lambda i: ascii(substring('which vectors are near', (i % 22 + 1)::int, 1)) / 1000 - 0.1::double) AS v) q ORDER BY {_D}, vec_id LIMIT 10",
    "dense_topk_filtered": f"SELECT vec_id, round(distance, 6) AS distance FROM {_L.format(d=_D, i=0)} WHERE label IN (1, 2, 3) ORDER BY 2, 1 LIMIT 10",
    "batch_topk": f"SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_D} AS distance FROM embeddings e, (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 10",
    "keyword_topk": f"SELECT doc_id, round(similarity, 6) AS similarity FROM {_keyword(['benchmark', 'license', 'gewbe', 'password'], 20)}",
    "keyword_scores": f"SELECT doc_id, round({_score(['license', 'rights'], [2.0, 1.0])}, 6) AS score FROM documents",
    "hybrid_rrf": _fuse([(_dense_docs, 0.7), (_keyword(WORDS, 100), 0.3)], "doc_id", "sum(1 / (60 + place))"),
    "hybrid_weighted": _fuse([(_dense_docs, 0.7), (_keyword(WORDS, 100), 0.3)], "doc_id", "sum(similarity * weight)"),
    "multi_vector_sum": _fuse(_multi, "vec_id", "sum(similarity * weight)"),
    "multi_vector_max": _fuse(_multi, "vec_id", "max(similarity * weight)"),
    "multi_vector_mean": _fuse(_multi, "vec_id", "avg(similarity * weight)"),
    "group_separation": "WITH u AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT round(avg(c) FILTER (same), 6) AS within, round(avg(c) FILTER (NOT same), 6) AS between, round(avg(c) FILTER (same) - avg(c) FILTER (NOT same), 6) AS separation FROM p",
    "vector_statistics": "SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dimensions, round(avg(x), 6) AS norm_mean, round(stddev_pop(x), 6) AS norm_std, round(min(x), 6) AS norm_min, round(max(x), 6) AS norm_max FROM (SELECT embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS x FROM embeddings)",
    "dimension_use": "SELECT dim, round(avg((x <> 0)::int::double), 6) AS used, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding::double[]) AS x, (generate_subscripts(embedding, 1) - 1)::int AS dim FROM embeddings) GROUP BY 1",
    "vector_validation": "SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN 'no vector' ELSE 'dimension' END AS reason FROM embeddings WHERE vec_id % 40 = 0 OR vec_id % 41 = 0",
    "unit_vectors": "SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, embedding::double[] AS v FROM embeddings))",
}
# the exact search has the result of measuring all; the other one is tested by its recall
ORACLES["quantized_exact_topk"] = ORACLES["batch_topk"]
