"""The pipeline's near-copy stage loses no link, and large groups of texts somewhat below the limit are compared in blocks."""

import random
import time

import corpus_pipeline
import numpy as np
from quarryline.llm import simhash_gray


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = max(top[a], top[b]), min(top[a], top[b])
                top = [y if z == x else z for z in top]
    return top


def frame(spark, texts):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stage_finds_every_link(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(400):
        base = rng.choices(words, k=rng.randint(30, 80))
        n = len(base) - 4
        same = -(-8 * n // 9)  # the least that makes 0.8
        texts += [" ".join(base), " ".join(base[: same + 4] + rng.choices(words, k=n - same))]
    want = brute(texts)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame(spark, texts), "").collect())
    assert got == sorted(set(want)) and len(got) == 400


def test_large_group_below_the_limit(spark, monkeypatch):
    """Texts of 0.6 to 0.8 with one base: what is compared in blocks joins what brute force joins."""
    for name, value in (("LISTED", 4), ("CROWD", 40), ("CROWD_SHINGLES", 20_000)):
        monkeypatch.setattr(simhash_gray, name, value)
    met, plain = [], simhash_gray._crowd_links

    def counted(members, *rest):
        met.append(members.count())
        return plain(members, *rest)

    monkeypatch.setattr(simhash_gray, "_crowd_links", counted)
    # no candidates from the index, so that all links are made up for
    monkeypatch.setattr(simhash_gray, "NEAR", -1)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(150):
        some = list(base)
        for at in rng.sample(range(len(base)), rng.choice([1, 2, 3, 4])):
            some[at] = rng.choice(words)
        texts.append(" ".join(some))
    texts += [" ".join(rng.choices(words, k=50)) for _ in range(20)]
    want = brute(texts)
    got = {r.doc_id: r.component_id for r in simhash_gray.similar_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    assert 25 < len(set(want)) < 150 and met and met[0] > 150


def test_alike():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2500, rng.integers(1, 2400))) for _ in range(60)]
    sets += [s[: max(1, int(len(s) * 0.85))] for s in sets[:30]]
    want = {(i, j) for j in range(90) for i in range(j) if 10 * len(both := np.intersect1d(sets[i], sets[j])) >= 8 * (len(sets[i]) + len(sets[j]) - len(both))}
    assert set(zip(*(x.tolist() for x in simhash_gray.alike(sets, 0.8)), strict=True)) == want and len(want) >= 25


def test_a_pair_meets_in_one_list(spark, monkeypatch):
    """Texts somewhat below the limit share many shingles, but their sets go to few of the lists; no shuffle file stays."""
    monkeypatch.setattr(simhash_gray, "LISTED", 4)
    sent, plain = [], simhash_gray._crowd_links

    def counted(members, *rest):
        sent.append((members.count(), members.select("uid").distinct().count()))
        return plain(members, *rest)

    monkeypatch.setattr(simhash_gray, "_crowd_links", counted)
    monkeypatch.setattr(simhash_gray, "NEAR", -1)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=200)
    texts = []
    for _ in range(60):
        some = list(base)
        for at in rng.sample(range(len(base)), rng.choice([2, 3, 5, 6])):
            some[at] = rng.choice(words)
        texts.append(" ".join(some))
    # a line that all have in common, which tells nothing
    texts += [" ".join(base[:6] + rng.choices(words, k=30)) for _ in range(40)]
    got = {r.doc_id: r.component_id for r in simhash_gray.similar_groups(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))
    rows, distinct = sent[0]
    assert 40 <= distinct <= 60 and rows <= 12 * distinct


def test_shuffle_files_go_with_the_table(spark, tmp_path):
    from quarryline.llm.common import CLEANUP, materialize

    before = spark.conf.get(CLEANUP)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.sparkContext._jvm.System.gc()
    had = tracker.shuffleStatuses().size()
    one = materialize(spark.range(1000).repartition(7, "id"))
    assert one.count() == 1000 and spark.conf.get(CLEANUP) == before
    for _ in range(50):
        if tracker.shuffleStatuses().size() <= had + 1:  # that of the count
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= had + 1
