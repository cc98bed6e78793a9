"""Toxicity by held-out accuracy, and on rows of all kinds."""

import zlib

import pytest
from pyspark.sql import functions as F

from quarryline.llm import queries, toxic_lengths

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score double, x int, predicted string, part string"


def test_held_out(spark):
    rows = queries.op11_toxic_lengths(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    toxic, clean = [r for r in held if r["toxic"] == 1], [r for r in held if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    english = [r for r in toxic if r["lang"] == "en"]  # of the other languages' toxic stems the labels here show few
    assert sum(r["predicted"] for r in english) > 0.7 * len(english)
    # clean documents score lower than toxic ones
    above = sum(t["score"] > c["score"] for t in toxic for c in clean)
    assert above > 0.85 * len(toxic) * len(clean)


@pytest.fixture(scope="module")
def model(spark):
    return toxic_lengths.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def test_rows_of_all_kinds(spark, model):
    long = "the ation of and her " * 40_000
    rows = [(1, None), (1, ""), (2, "   \n"), (3, "123 ###"), (4, long), (None, "you idiot, worthless trash and scum, pathetic moron"), (4, long), (5, "x" * 300_000)]
    found = toxic_lengths.score_toxicity(spark.createDataFrame([(i, t, "en", 9.0, 1, "clash", "clash") for i, t in rows], SCHEMA), model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[None]["predicted"] == 1 and by[4]["predicted"] == by[2]["predicted"] == 0
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1  # all are one blank window


def test_whole_texts(spark, model):
    """A toxic passage counts wherever it stands in a text, and scores don't depend on how rows are dealt."""
    prose = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0"), "doc_id").where("lang = 'en' AND n_chars BETWEEN 500 AND 1500").orderBy("doc_id").first()["text"]
    slur = " idiot moron worthless scum trash pathetic loser clown disgusting stupid "
    rows = [(1, prose), (2, slur + prose), (3, prose + slur), (4, prose + "\n" + slur + prose)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxic_lengths.score_toxicity(frame.repartition(4), model).collect()}
    assert scores == {r["doc_id"]: r["score"] for r in toxic_lengths.score_toxicity(frame.coalesce(1), model).collect()}
    assert min(scores[2], scores[3], scores[4]) > 0.7 > scores[1]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", "en", 1.0, 1, "a", "b") for i in range(20)], SCHEMA)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert toxic_lengths.fit(docs, labels([])) is None
    assert {r["score"] for r in toxic_lengths.score_toxicity(docs, None).collect()} == {0.0}
    one_kind = toxic_lengths.fit(docs, labels([(i, 1, 0) for i in range(20)]))
    assert {r["predicted"] for r in toxic_lengths.score_toxicity(docs, one_kind).collect()} == {0}
    assert toxic_lengths.score_toxicity(docs.limit(0), one_kind).select(F.count("*")).first()[0] == 0
