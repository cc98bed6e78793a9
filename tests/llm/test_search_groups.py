"""Search by groups of alike queries: the same rows as by brute force, with work for few pairs of unlike texts."""

import random

import numpy as np
from test_search_whole import best

from quarryline.llm import bm25_wand


def corpus(n):
    rng = random.Random(5)
    kinds = [[f"{c}{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)] for c in "ab"]
    texts = {i: " ".join([*rng.choices(kinds[i // 2 % 2], k=rng.randint(3, 80)), "same"]) for i in range(n)}
    return texts | {k: texts[k + 4] for k in range(0, n - 8, 40)}  # copies, so that scores tie


def test_groups_give_the_same_rows(spark, monkeypatch):
    for name, value in (("GROUPS", 2), ("SHARD_DOCS", 60), ("SLAB", 16), ("BLOCK_DOCS", 8), ("SIDE", 32), ("CELL", 1e-4), ("LONG", 8)):
        monkeypatch.setattr(bm25_wand, name, value)
    texts = corpus(400)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = bm25_wand.search_like(docs, docs.where("doc_id % 2 = 0"), most=None, least_df=1)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())
    want = sorted(best(texts, range(0, 400, 2)))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])


def test_unlike_queries_take_little(monkeypatch):
    """Frequent terms of a group are added up by products for its own queries only, and no list is walked for them."""
    monkeypatch.setattr(bm25_wand, "GROUPS", 2)
    monkeypatch.setattr(bm25_wand, "CELL", 1e-4)
    words = [bm25_wand.terms(t) for t in corpus(400).values()]
    code = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
    sets = [np.unique([code[w] for w in t]).astype(np.int32) for t in words]
    column, centres = bm25_wand.alike(sets, len(code))
    group = bm25_wand.label(sets, column, centres)
    assert len(centres) == 2 and all(group[i] == group[i % 4] for i in range(400)) and group[0] != group[2]
    order = np.argsort(group, kind="stable")
    asked = bm25_wand.Asked([sets[i] for i in order], len(code), [0, 200, 400])
    own = np.flatnonzero(group == 1)
    of = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    shard = bm25_wand.Shard(own.tolist(), [len(words[i]) for i in own], np.concatenate([sets[i] for i in own]), of, np.ones(len(code)), 40.0, np.ones(len(of), np.int64))
    walked, plain = [], shard._by_lists

    def counted(asked, n, parts):
        walked.extend(int((last - first).sum()) for _, _, first, last in parts)
        return plain(asked, n, parts)

    shard._by_lists = counted
    found = shard.search(asked, 1, np.zeros(400), 1)
    assert all(len(places) for places, _ in found)
    pairs = sum(asked.size[sets[i]].sum() for i in own)
    assert sum(walked) < pairs / 4
