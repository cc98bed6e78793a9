"""Stages of the pipeline on rows with shared or no ids."""

from collections import Counter

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_rows_with_shared_or_no_ids(spark):
    texts = ["the first text of all about rivers", "der zweite Text handelt von Bergen", "un texte de plus sur la mer", "a fourth one with no number at all"]
    data = [(1, texts[0], "en", "a", 1), (1, texts[1], "de", "a", 1), (None, texts[2], "fr", "a", 1), (None, texts[3], "en", "a", 1)]
    docs = spark.createDataFrame(data, COLUMNS)
    want = Counter(data)
    assert rows(corpus_pipeline.language(spark, docs, "")) == want
    assert rows(corpus_pipeline.near_copies(spark, docs, "")) == want
    assert rows(corpus_pipeline.near_copies(spark, docs.unionByName(docs), "")) == want
    # one source, so each row is taken once
    assert rows(corpus_pipeline.mixture(spark, docs, "")) == want


def test_nothing_learned(spark):
    data = [(k, t, None, "a", 1) for k, t in enumerate(["some text", "ein Text", "123", None])]
    assert rows(corpus_pipeline.language(spark, spark.createDataFrame(data, COLUMNS), "")) == Counter(data[:2])
