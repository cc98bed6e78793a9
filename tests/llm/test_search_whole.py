"""Search with all terms of a document against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarryline.llm import bm25_wand, queries


def test_whole_documents_as_queries(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(9000)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(1, 250))) for i in range(400)}
    texts |= {k: texts[k + 1] for k in range(2, 60, 6)}  # copies
    texts[100], texts[150], texts[200] = "only these terms here", None, " ".join(rng.choices(words, k=6000))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    tf = {i: Counter(bm25_wand.terms(t)) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    idf = {w: math.log(1 + (len(tf) - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    got = defaultdict(list)
    for r in sorted(queries.op5_bm25_wand(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    assert set(got) == {i for i in texts if i % 50 == 0 and texts[i]}
    assert got[100][0].doc_id == 100 and len(got[100]) == 1
    for q, rows in got.items():
        want = {}
        for i, c in tf.items():
            norm = bm25_wand.K1 * (1 - bm25_wand.B + bm25_wand.B * sum(c.values()) / mean)
            score = sum(idf[w] * c[w] * (bm25_wand.K1 + 1) / (c[w] + norm) for w in tf[q] if c[w])
            if score > 0:
                want[i] = score
        assert np.allclose([r.score for r in rows], sorted(want.values(), reverse=True)[:10])
        assert all(math.isclose(r.score, want[r.doc_id]) for r in rows)


def best(texts, ids, k=10):
    """(query, rank, doc, score) by brute force, ties to the smaller id."""
    tf = {i: Counter(bm25_wand.terms(t)) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    idf = {w: math.log(1 + (len(tf) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for q in ids:
        scores = []
        for i, c in tf.items():
            norm = bm25_wand.K1 * (1 - bm25_wand.B + bm25_wand.B * sum(c.values()) / mean)
            score = sum(idf[w] * c[w] * (bm25_wand.K1 + 1) / (c[w] + norm) for w in tf[q] if c[w])
            if score > 0:
                scores.append((-round(score, 9), i))
        yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k]))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_shards_and_blocks_of_queries(spark, monkeypatch, kind):
    monkeypatch.setattr(bm25_wand, "SHARD_DOCS", 70)
    monkeypatch.setattr(bm25_wand, "QUERY_BLOCK", 9)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i:04}")
    texts = {name(i): " ".join(rng.choices(words, k=rng.randint(1, 60))) for i in range(500)}
    for i in range(0, 200, 5):  # equal documents, so that scores tie
        texts[name(i + 1)] = texts[name(i + 2)] = texts[name(i)]
    docs = spark.createDataFrame(list(texts.items()), f"doc_id {kind}, text string").repartition(6)
    asked = [name(i) for i in range(0, 500, 17)]
    found = bm25_wand.search_like(docs, docs.where(docs.doc_id.isin(asked)), most=None, least_df=1)
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())
    assert got == sorted((q, r, i, round(s, 6)) for q, r, i, s in best(texts, asked))


def test_null_ids_and_no_queries(spark):
    docs = spark.createDataFrame([(None, "same words here"), (None, "same words here"), (1, "same words"), (2, None), (3, "")], "doc_id long, text string")
    found = bm25_wand.search_like(docs, docs.where("doc_id = 1"), most=None, least_df=1).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, None, None] and found[1].score == found[2].score
    assert bm25_wand.search_like(docs, docs.limit(0), most=None, least_df=1).count() == 0
