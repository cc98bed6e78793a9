"""Containment and near names against all pairs, on texts of any length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import containment
from quarryline.operators.text import edit_matches


def tables(spark, needles, hays):
    return spark.createDataFrame([(n, 1) for n in needles], "needle string, hay int"), spark.createDataFrame([(i, h, "x") for i, h in hays], "hay_id long, hay string, needle string").repartition(3)


@pytest.mark.parametrize("most_bytes", [containment.AUTOMATON_BYTES, 0])
def test_pairs(spark, most_bytes):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé中") for _ in range(n))
    needles = [word(rng.randint(1, 7)) for _ in range(60)] + ["", None, "a", "a", "zzzzzz", ".*", "%"]
    hays = [(i, word(rng.randint(0, 60))) for i in range(120)] + [(None, "abc"), (500, None), (501, ""), (502, ".*%"), (7, "abcabc"), (7, "abcabc")]
    got = sorted(map(repr, containment.contains_pairs(*tables(spark, needles, hays), most_bytes).collect()))
    want = sorted(f"Row(needle={n!r}, hay_id={i})" for n in {n for n in needles if n} for i, h in hays if h and n in h)
    assert got == want
    for a, b in (([], hays[:3]), (needles, [])):
        assert containment.contains_pairs(*tables(spark, a, b), most_bytes).count() == 0


def test_long_texts(spark):
    """A text of 5 MB, and many of 0.5 MB: time and rows grow with the texts."""
    text = "the quick brown fox jumps over the lazy dog " * 115_000
    needles, hays = tables(spark, ["fox", "lazy dog", "nowhere", "needle in the"], [(0, text + "needle in the hay"), *[(i, text[: 500_000 + i]) for i in range(1, 60)]])
    began = time.time()
    got = containment.contains_pairs(needles, hays).groupBy("needle").agg(F.count("*").alias("n")).collect()
    assert {r["needle"]: r["n"] for r in got} == {"fox": 60, "lazy dog": 60, "needle in the": 1}
    assert time.time() - began < 60


def test_edit_matches(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, before = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(2)

    def changed(text):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(["", "x", "ab"]) + text[k + rng.randint(0, 1) :]
        return text

    names = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 200]))) for _ in range(80)] + ["", "a"]
    queries = [changed(rng.choice(names)) for _ in range(120)] + [""]
    got = sorted(map(tuple, edit_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(q,) for q in queries], "query string")).collect()))
    want = sorted((q, n, d) for q in set(queries) for n in set(names) if abs(len(q) - len(n)) < 3 and (d := distance(q, n)) <= min(2, len(q) // 2))
    assert got == want


def test_long_names(spark):
    """A name of 5,000 characters is laid out a few times over, not once for each character."""
    long = "abcdefghij" * 500
    names = spark.createDataFrame([(long,), (long + "k",), ("short",)], "name string")
    queries = spark.createDataFrame([(long[:-1],), (long[:2_500] + "x" + long[2_500:],), ("shirt",)], "query string")
    got = {(len(q), len(n), d) for q, n, d in edit_matches(names, queries).collect()}
    assert got == {(4_999, 5_000, 1), (4_999, 5_001, 2), (5_001, 5_000, 1), (5_001, 5_001, 2), (5, 5, 1)}


def test_matches_among_many_names(spark):
    """Names of another length than any query, and names that share their pieces: no task holds the pieces of all."""
    sc = spark.sparkContext
    gateway = sc._gateway

    def peak():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.peakExecutionMemory() for s in (stages.apply(k) for k in range(stages.size()))}

    names = spark.range(30_000).selectExpr("concat('supplier#', lpad(id, 9, '0')) AS name")
    names = names.unionByName(spark.createDataFrame([("nation_1",), ("aaaaaaaa",), ("nation_12",)], "name string"))
    queries = spark.createDataFrame([("naton_1",), ("aaaaaaab",)], "query string")
    before = peak()
    got = {tuple(r) for r in edit_matches(names, queries).collect()}
    assert got == {("naton_1", "nation_1", 1), ("naton_1", "nation_12", 2), ("aaaaaaab", "aaaaaaaa", 1)}
    assert 0 < max(m for k, m in peak().items() if k not in before) < 250_000_000
