"""The quantised index against measuring all vectors."""

import numpy as np

from quarryline.operators import quantized as Z
from quarryline.plans import search


def brute(rows, queries, k):
    out = {}
    for name, q in queries:
        far = sorted((sum((a - b) ** 2 for a, b in zip(x, q, strict=True)), i) for i, x in rows)
        out[name] = [i for _, i in far[:k]]
    return out


def tables(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 16))
    x = (middles[rng.integers(0, 12, 1500)] + rng.normal(scale=0.4, size=(1500, 16))).round(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(300)]  # a third would be no other case
    odd = [(9000, None), (9001, [1.0] * 15), (9002, [None] * 16), (9003, [])]
    queries = [(i, x[i].tolist()) for i in range(0, 1500, 60)] + [(-1, [50.0] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame(queries + [(-2, None), (-3, [1.0])], "query_id long, embedding array<double>")
    return rows, queries, frame, asked


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_exact_and_recall(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK", 100)  # cells in several blocks
    rows, queries, frame, asked = tables(spark)
    q = Z.fitted(frame, parts=4)
    coded = Z.index(frame, q)
    assert coded.count() == len(rows)
    want = brute(rows, queries, 10)
    assert lists(Z.search(frame, coded, q, asked, 10, probes=2, refine=2, exact=True)) == want
    near = lists(Z.search(frame, coded, q, asked, 10))
    found = [len(set(near[n]) & set(want[n])) / 10 for n in want]
    assert sum(found) / len(found) >= 0.95
    assert lists(Z.search(frame, coded, q, asked, 3000, exact=True))[0] == brute(rows, queries[:1], 3000)[0]
    assert Z.fitted(frame.limit(0)) is None


def test_recall_of_given_table(spark):
    for data in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        recall_of(spark, data)


def recall_of(spark, data):
    got, exact = lists(search.QUERIES["quantized_topk"](spark, data)), lists(search.QUERIES["batch_topk"](spark, data))
    assert got.keys() == exact.keys()
    assert sum(len(set(got[n]) & set(exact[n])) for n in exact) >= 0.95 * sum(map(len, exact.values()))


def test_few_rows_leave_a_block(spark, monkeypatch):
    """k rows a query and block at most go to the last ranking, in the approximate and in the exact step."""
    counts, plain = [], Z.top
    monkeypatch.setattr(Z, "top", lambda pairs, by, k: counts.append(pairs.count()) or plain(pairs, by, k))
    rows, queries, frame, asked = tables(spark)
    q = Z.fitted(frame, parts=4)
    assert lists(Z.search(frame, Z.index(frame, q), q, asked, 10, exact=True)) == brute(rows, queries, 10)
    assert counts and max(counts) <= 10 * len(queries)
