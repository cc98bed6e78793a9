"""Segmentation against all cuts of short runs, and its dictionary against plain counts."""

import itertools
import random
import time

from pyspark.sql import functions as F

from quarryline.operators import metrics, passages
from quarryline.operators import segmentation as S


def all_cuts(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        ends = [k + 1 for k, m in enumerate(marks) if m] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_best_path():
    rng = random.Random(1)
    counts = {c: rng.randint(1, 30) for c in "天地人大小"} | {"".join(rng.choice("天地人大小") for _ in range(rng.randint(2, 4))): rng.randint(1, 20) for _ in range(25)}
    costs, unknown = S.costs_of(counts)
    for _ in range(300):
        run = "".join(rng.choice("天地人大小山") for _ in range(rng.randint(1, 9)))
        ways = [w for w in all_cuts(run) if all(x in costs or len(x) == 1 for x in w)]
        key = lambda w: (sum(costs.get(x, unknown) for x in w), len(w))
        found = S.best_path(run, costs, unknown, S.LONGEST)
        assert "".join(found) == run and key(found) == min(map(key, ways))
    began = time.time()
    assert "".join(S.best_path("天地人大" * 100_000, costs, unknown, S.LONGEST)) == "天地人大" * 100_000
    assert time.time() - began < 30


def test_words(spark):
    """Words that recur are found; other text keeps its tokens; chance neighbours aren't words."""
    rng = random.Random(2)
    words = ["機器學習", "資料", "模型", "系統"]
    singles = "天地人你我他大小上下左右日月水火木金土山川"
    texts = ["".join(rng.choice([*words, *rng.sample(singles, 4)]) for _ in range(30)) for _ in range(200)] + [None, "", "abc 12"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    dictionary = S.counted_words(docs, "text", least=5, cohesion=8)
    known = {r["word"]: r["n"] for r in dictionary.collect()}
    assert set(words) <= set(known) and known["機器學習"] == sum((t or "").count("機器學習") for t in texts)
    cut = S.segmenter(dictionary)
    rows = spark.createDataFrame([(0, "資料模型abc機器學習 12 x系統"), (1, None), (2, ""), (3, "可以進行資料系統")], "id int, t string")
    found = {r["id"]: r["w"] for r in rows.select("id", cut(F.col("t")).alias("w")).collect()}
    assert found[0] == ["資料", "模型", "abc", "機器學習", "12", "x", "系統"] and found[1] == found[2] == []
    # single characters of the excluded words aren't entities, nor are the words themselves
    named = {r["id"]: r["w"] for r in rows.select("id", passages.question_entities(F.col("t"), tokenizer=cut).alias("w")).collect()}
    assert "資料" in named[3] and "可以" not in named[3]
    assert S.counted_words(docs.limit(0), "text").count() == 0


def test_counter_of_one_key(spark):
    """All records in one counter, some without a time or a value: as a plain running sum."""
    rng = random.Random(3)
    rows = [(i, "hot", None if i % 50 == 0 else f"2024-01-{rng.randint(1, 28):02} {rng.randint(0, 23):02}:00:00", None if i % 31 == 0 else i % 7 + 0.25) for i in range(400)]
    frame = spark.createDataFrame(rows, "event_id int, kind string, at string, value double").withColumn("ts", F.to_timestamp("at")).repartition(4)
    got = {r["event_id"]: r["counter"] for r in metrics.running_counter(frame, "kind").collect()}
    total, want = 0.0, {}
    for i, _, _, v in sorted(rows, key=lambda r: (r[2] or "", r[0])):
        total += v or 0.0
        want[i] = round(total, 3)
    assert got == want


def test_quantiles_of_one_key(spark):
    """By histogram as by sorting: one key of all rows, equal values, few rows, nulls, extremes far apart."""
    rng = random.Random(4)
    groups = {"hot": [rng.choice([1.0, 2.0, 2.0, 1e9, -5.0, rng.random()]) for _ in range(500)], "same": [3.0] * 40, "two": [1.0, 2.0], None: [4.0, 1.0, 9.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    cuts = {"p50": 0.5, "p95": 0.95, "p01": 0.01}
    got = {r["kind"]: [r[c] for c in cuts] for r in metrics.exclusive_quantiles(spark.createDataFrame(rows, "kind string, value double").repartition(3), "kind", cuts).collect()}
    want = {}
    for k, vs in groups.items():
        x, n = sorted(vs), len(vs)
        low = [max(1, min(int((n + 1) * p), n - 1)) for p in cuts.values()]
        want[k] = [round(x[a - 1] * (1 - ((n + 1) * p - a)) + x[a] * ((n + 1) * p - a), 6) for a, p in zip(low, cuts.values(), strict=True)]
    assert {k: [round(x, 4) for x in v] for k, v in got.items()} == {k: [round(x, 4) for x in v] for k, v in want.items()}
