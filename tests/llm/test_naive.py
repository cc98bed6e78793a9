"""The pairwise ranking and the ring against plain loops."""

import bisect
import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import quality_pairs, ring_shards


def test_pairwise_fit_as_plain_loops():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    good = x[:, 0] + 0.3 * rng.normal(size=40) > 0
    pairs, rounds = 60, 25
    ranker = quality_pairs.PairRanker(x, good, pairs, seed=9, rounds=rounds)
    # each document is a set of ranges, one for each feature; its strength is the sum of their weights
    ranges, width = [], 0
    for col in range(3):
        cuts = sorted(set(np.quantile(x[:, col], np.linspace(0, 1, quality_pairs.RANGES + 1)[1:-1]).tolist()))
        ranges.append([width + bisect.bisect_left(cuts, v) for v in x[:, col].tolist()])
        width += len(cuts) + 1
    parts = list(zip(*ranges, strict=True))
    draw = np.random.default_rng(9)
    better, worse = draw.choice(np.flatnonzero(good), pairs), draw.choice(np.flatnonzero(~good), pairs)
    weights, step = [0.0] * width, [0.0] * width
    for _ in range(rounds):
        slope = [-1e-4 * w for w in weights]
        for a, b in zip(better, worse, strict=True):
            lost = 1 / (1 + math.exp(sum(weights[k] for k in parts[a]) - sum(weights[k] for k in parts[b])))
            for k in parts[a]:
                slope[k] += lost / pairs
            for k in parts[b]:
                slope[k] -= lost / pairs
        step = [0.9 * s + 2.0 * g for s, g in zip(step, slope, strict=True)]
        weights = [w + s for w, s in zip(weights, step, strict=True)]
    assert np.allclose(ranker.weights, weights)


def test_ring_as_document_by_document(spark):
    shards, points, seed = 5, 4, 7
    texts = [(i % 90, f"text {i}") for i in range(300)] + [(None, None), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(ring_shards.RING)).alias("place")).collect()
    ring = sorted((xxhash.xxh64_intdigest(f"{s}/{k}", seed) % ring_shards.RING, s) for s in range(shards) for k in range(points))
    places = [p for p, _ in ring]
    data = []
    for r in rows:
        size, crc = len((r.text or "").encode()) + 16, None if r.text is None else zlib.crc32(r.text.encode())
        data.append((bisect.bisect_left(places, r.place) % len(ring), r.place, r.doc_id, crc, size))
    turn = {a: xxhash.xxh64_intdigest(str(ring[a][0]), seed + 1) for a in range(len(ring))}
    low = lambda v: (v is not None, v or 0)
    data.sort(key=lambda d: (turn[d[0]], d[1], low(d[2]), low(d[3]), d[4]))
    room = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]
    used, out, waiting = [0] * shards, [], []

    def put(d, s):
        out.append((d[2], d[4], d[3], s, used[s]))
        used[s] += 1

    for d in data:  # each document's own shard, while it has room
        own = ring[d[0]][1]
        if used[own] < room[own]:
            put(d, own)
        else:
            waiting.append(d)
    for d in waiting:  # then clockwise to the next one with room
        at = d[0]
        while used[ring[at][1]] >= room[ring[at][1]]:
            at = (at + 1) % len(ring)
        put(d, ring[at][1])
    found = ring_shards.shard_documents(docs, shards, points, seed=seed)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in found.collect()) == Counter(out)
