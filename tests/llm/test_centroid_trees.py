"""Clusters by kd-trees against plain assignment in Python integers, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np

from quarryline.llm import centroid_trees, queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, order long"


def plainly(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids, points = [v for _, v in order[:k]], np.array([v for _, v in kept], object)

    def assigned():
        far = np.array([((points - np.array(c, object)) ** 2).sum(axis=1) for c in centroids]).T
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        home, _ = assigned()
        centroids = [[x // len(own) for x in own.sum(axis=0)] if len(own := points[home == c]) else old for c, old in enumerate(centroids)]
    home, far = assigned()
    inertia = [int(sum(far[home == c])) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(h), int(d), inertia[h], sum(inertia), digest[h]) for (i, _), h, d in zip(kept, home, far, strict=True)), key=repr)


def clustered(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, centroid_trees.with_inertia(*centroid_trees.cluster(frame)).collect()), key=repr)


def vectors(n, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(m + rng.gauss(0, 0.2))) for m in rng.choice(middles)]) for i in range(n)]


def test_rows_of_all_kinds(spark):
    rows = vectors(400)
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(200)] + [rows[7], (None, rows[8][1]), (None, None)]
    rows += [(2000, None), (2001, []), (2002, same[:63]), (2003, [*same, 0.0]), (2004, [None, *same[1:]]), (2005, [float("nan"), *same[1:]]), (2006, [float("inf"), *same[1:]]), (2007, [0.0] * 64)]
    assert clustered(spark, rows) == plainly(rows)


def test_large_components(spark):
    """Components whose squares exceed 64 bits when they are added up are counted in Python integers."""
    rows = vectors(60) + [(100 + i, [float(np.float32(1e5 * (i - 3)))] * 64) for i in range(8)]
    assert clustered(spark, rows) == plainly(rows)


def test_ties_and_few(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # equal centroids: the smaller number takes all
    assert clustered(spark, rows) == plainly(rows)
    assert clustered(spark, rows[:3]) == plainly(rows[:3])
    assert clustered(spark, [(1, None)]) == [] == clustered(spark, [])


def test_tree_prunes():
    """Nodes are assigned as a whole where clusters lie apart, and every vector once."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 50, (300, 4)) + 1000 * c for c in range(4)]).astype(np.int64)
    centroids = np.array([[25 + 1000 * c] * 4 for c in range(4)])
    parts = list(centroid_trees.Tree.build(points).assigned(centroids))
    assert sorted(np.concatenate([at for _, at, _ in parts]).tolist()) == list(range(1200))
    assert sum(len(at) for _, at, held in parts if held is not None) == 1200 and len(parts) < 20
    assert all((points[at].sum(axis=0) == held).all() for _, at, held in parts if held is not None)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    frame = queries.op13_centroid_trees(spark, DATA)
    cursor = con.execute(queries.ORACLES["op13_centroid_trees"])
    assert [d[0] for d in cursor.description] == frame.columns
    assert sorted(map(tuple, frame.collect())) == sorted(cursor.fetchall())
