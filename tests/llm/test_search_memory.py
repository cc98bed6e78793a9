"""What one task holds of a shard stays small: several tasks share an executor's memory."""

import tracemalloc

import numpy as np
from quarryline.llm import bm25_wand


def test_shard_memory():
    rng = np.random.default_rng(1)
    n, each, known = bm25_wand.SHARD_DOCS, 300, 50_000
    term_of = (known * rng.random(n * each) ** 3).astype(np.int64)
    doc_of = np.repeat(np.arange(n), each)
    idf = np.linspace(0.1, 9, known)
    queries = [np.unique(term_of[k * each : (k + 1) * each]) for k in range(0, n, 64)]
    tracemalloc.start()
    shard = bm25_wand.Shard(list(range(n)), [each] * n, term_of, doc_of, idf, float(each))
    found = shard.search(queries, 10, np.zeros(len(queries)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(k in places for k, (places, _) in zip(range(0, n, 64), found, strict=True))
    assert peak < 150_000_000


def test_documents_are_taken_apart_once(spark, monkeypatch):
    """However many blocks of queries there are, the search reads terms that were written, and does little for what can't win."""
    monkeypatch.setattr(bm25_wand, "QUERY_BLOCK", 3)
    wrote, plain = [], bm25_wand.term_vectors

    def counted(docs):
        wrote.append(1)
        return plain(docs)

    monkeypatch.setattr(bm25_wand, "term_vectors", counted)
    docs = spark.createDataFrame([(i, f"alpha beta w{i} w{i // 2} w{i // 3}") for i in range(40)], "doc_id long, text string")
    found = {(r.query_id, r["rank"]): r.doc_id for r in bm25_wand.search_like(docs, docs.where("doc_id % 4 = 0"), k=2, most=None, least_df=1).collect()}
    assert wrote == [1] and all(found[i, 1] == i and found[i, 2] != i for i in range(0, 40, 4))


def test_few_documents_are_scored_exactly():
    """With a floor that few documents reach, only these are scored in full."""
    rng = np.random.default_rng(3)
    n, each, known = 1024, 100, 20_000
    term_of = (known * rng.random(n * each) ** 3).astype(np.int64)
    shard = bm25_wand.Shard(list(range(n)), [each] * n, term_of, np.repeat(np.arange(n), each), np.linspace(0.1, 9, known), float(each))
    queries, scored, plain = [np.unique(term_of[k * each : (k + 1) * each]) for k in range(0, n, 8)], [], shard._exact

    def counted(query, found, k, floor):
        scored.append(len(found))
        return plain(query, found, k, floor)

    shard._exact = counted
    floors = np.array([s[0].max() * 0.99 if len(s := found[1:]) else 0 for found in shard.search(queries, 1, np.zeros(len(queries)))])
    scored.clear()
    again = shard.search(queries, 1, floors)
    assert all(k in places for k, (places, _) in zip(range(0, n, 8), again, strict=True)) and sum(scored) <= 4 * len(queries)
