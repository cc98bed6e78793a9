"""Removal of repeated strings against brute force: short texts only, many blocks, hot anchors, the largest ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import suffix_spans


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept digest) of each row; a null id counts as 2^63 - 1."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            first[w] = min(first.get(w, order(i)), order(i))
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order(i):
                gone[k : k + 50] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return Counter(tuple(r) for r in suffix_spans.kept_digest(suffix_spans.remove_repeats(docs)).collect())


def test_short_texts_only(spark):
    rows = [(i, f"short note {i}") for i in range(40)] + [(i, f"short note {i % 3}") for i in range(40, 50)] + [(None, None), (50, "")]
    assert found(spark, rows) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_one_short_block_among_long_ones(spark):
    rows = [(i, f"short note {i}") for i in range(10)] + [(100 + i, f"short note {i % 5} " * 9) for i in range(10)]
    assert found(spark, rows, 20) == brute(rows)


def test_largest_and_null_ids(spark):
    text = "a passage of more than fifty bytes that is found in several documents"
    rows = [((1 << 63) - 1, text), (None, text + " and more"), (3, "x " + text + " y"), (-5, text[:60])]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [3, 4096])
def test_many_blocks_and_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_spans, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_spans, "GROUP", 300)
    monkeypatch.setattr(suffix_spans, "HOT", hot)
    rng = random.Random(hot)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    licence = say(25)
    rows = [(i, say(rng.randint(0, 40)) + " " + licence + " " + say(rng.randint(0, 40))) for i in range(150)]
    rows += [(200 + i, say(30)) for i in range(50)] + [(300 + i, rows[i][1]) for i in range(20)]
    rows += [(400 + i, "ab" * rng.randint(20, 90)) for i in range(20)] + [(500, say(3000))]
    rows += [(600 + i, licence[rng.randint(0, 40) :] + licence) for i in range(20)]
    rng.shuffle(rows)
    assert found(spark, rows, 7) == brute(rows)


def test_kinds_in_batches(monkeypatch):
    """Batches of whole kinds give what all at once gives."""
    rng = np.random.default_rng(3)
    n = 400
    hashes = rng.integers(0, 9, n).astype(np.uint64)
    doc, windows = rng.integers(0, 50, n), rng.integers(1, 26, n)
    offset = np.minimum(windows - 1, 3)
    size = windows + 49
    flat = rng.integers(97, 99, size.sum()).astype(np.uint8) * 0 + 97
    flat[rng.integers(0, len(flat), 40)] = 98
    whole = suffix_spans.repeated(hashes, doc, offset, windows, flat)
    monkeypatch.setattr(suffix_spans, "SORTED", 10)
    assert (suffix_spans.repeated(hashes, doc, offset, windows, flat) == whole).all()


def test_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        suffix_spans.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    empty = spark.createDataFrame([], "doc_id int, text string, kept string, block long")
    assert suffix_spans.remove_repeats(empty.withColumn("n", F.lit(1))).count() == 0


def test_rows_of_the_exchanges_at_size(spark, monkeypatch):
    """Each block sends a row to each group: over the 10 GB of text of 6 GB of documents that stays below two million rows. With many groups
    the rows equal brute force, and a block's rows leave in few batches."""
    n = 10_200_000_000 // suffix_spans.BLOCK_BYTES
    assert n * suffix_spans.groups_of(n) < 2_000_000
    monkeypatch.setattr(suffix_spans, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(suffix_spans, "GROUP", 40)
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    passages = [" ".join(rng.choices(words, k=12)) for _ in range(20)]
    rows = [(i, " ".join([*rng.choices(words, k=20), rng.choice(passages), *rng.choices(words, k=rng.randint(0, 9)), rng.choice(passages)])) for i in range(150)]
    assert suffix_spans.groups_of(6) > 48
    assert found(spark, rows) == brute(rows)
