"""Centroid clustering of integer vectors by the filtering method on kd-trees.

Each partition lays its vectors out in kd-trees whose nodes hold a count, componentwise integer sums and a box. A round
takes the candidates for the nearest centroid down a tree: a candidate is dropped where the whole box is strictly nearer
to another one, a node with one candidate left is assigned as a whole by its sums, and leaves are resolved vector by vector.
All is in integers, so results don't depend on how the vectors are dealt. The trees are built once and written; a round
reads them and returns a count and a sum for each centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

#: Vectors of a tree, and of a leaf at most unless all of them are equal.
TREE, LEAF = 4096, 16
#: Trees that a task reads at once.
HELD = 8
#: Components up to this size have squared distances that fit in 64 bits (64 components); larger ones are Python integers.
WIDE = 1 << 26
_LARGEST = (1 << 63) - 1


@dataclass
class Tree:
    """Nodes in breadth-first order, each the vectors `order[start:end]`; `left` is 0 for a leaf, the right child follows
    the left one."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """Nodes are halved at the median of the component in which their box is widest; equal vectors aren't parted."""
        order = np.arange(len(points))
        start, end, left, low, high, sums = [0], [len(points)], [], [], [], []
        n = 0
        while n < len(start):
            a, b = start[n], end[n]
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            sums.append(own.sum(axis=0))
            wide = high[-1] - low[-1]
            axis = int(wide.argmax())
            if b - a <= LEAF or wide[axis] == 0:
                left.append(0)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis].astype(float), half)]
                left.append(len(start))
                start += [a, a + half]
                end += [a + half, b]
            n += 1
        return cls(points, order, np.array(start), np.array(end), np.array(left), np.array(low), np.array(high), np.array(sums))

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(centroid, vectors, their sum): the parts into which the tree falls. A node that is assigned as a whole brings
        the sum it holds, vectors of leaves None."""
        k = len(centroids)
        nodes, live = np.array([0]), np.ones((1, k), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            live = self._filtered(low, high, live, centroids)
            one = live.sum(axis=1) == 1
            for n, c in zip(nodes[one], live[one].argmax(axis=1), strict=True):
                yield int(c), self.order[self.start[n] : self.end[n]], self.sums[n]
            leaf = ~one & (self.left[nodes] == 0)
            for n, mine in zip(nodes[leaf], live[leaf], strict=True):
                at, of = self.order[self.start[n] : self.end[n]], np.flatnonzero(mine)
                nearest = of[squared(self.points[at], centroids[of]).argmin(axis=1)]  # the first of those as near
                for c in np.unique(nearest):
                    yield int(c), at[nearest == c], None
            inner = ~one & (self.left[nodes] > 0)
            first = self.left[nodes[inner]]
            nodes, live = np.concatenate([first, first + 1]), np.concatenate([live[inner], live[inner]])

    @staticmethod
    def _filtered(low: np.ndarray, high: np.ndarray, live: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Candidates without those that are strictly farther than the one nearest to the box's middle from the corner of
        the box that lies farthest in their own direction from it, and so from every point of the box."""
        twice = (low + high)[:, None, :] - 2 * centroids[None]
        middle = (twice * twice).sum(axis=2)
        middle = np.where(live, middle, middle.max() + 1)
        best = centroids[middle.argmin(axis=1)]
        corner = np.where(centroids[None] > best[:, None, :], high[:, None, :], low[:, None, :])
        own, other = corner - centroids[None], corner - best[:, None, :]
        return live & ~((own * own).sum(axis=2) > (other * other).sum(axis=2))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    apart = points[:, None, :] - centroids[None]
    return (apart * apart).sum(axis=2)


def exact(points: np.ndarray) -> np.ndarray:
    """64-bit integers where all distances fit in them, else Python integers."""
    return points.astype(object) if len(points) and max(int(points.max()), -int(points.min())) >= WIDE else points


def clusterable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def seeds(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id; rows that share an id come in the order of their vectors, those
    without an id last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(map(int, r["v"])) for r in kept.orderBy(name.asc_nulls_last(), "v").select("v").limit(k).collect()]  # k rows


def in_trees(kept: DataFrame, size: int) -> DataFrame:
    """The kd-trees of all vectors (vec_id, v), as a written table: a row for each tree."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TREE):
                block = batch.slice(a, TREE)
                points = block.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                tree = Tree.build(exact(points))
                wide = tree.points.dtype == object
                arrays = [points, tree.order, tree.start, tree.end, tree.left, tree.low, tree.high, None if wide else tree.sums]
                lists = [pa.array([None if x is None else x.ravel().astype(np.int64)], pa.list_(pa.int64())) for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([block.column(0).to_pylist()], pa.list_(block.column(0).type)), *lists], TREE_COLUMNS)

    schema = ", ".join([f"ids array<{kind}>", *(f"{n} array<bigint>" for n in TREE_COLUMNS[1:])])
    with small_batches(kept.sparkSession, TREE):
        return materialize(kept.select("vec_id", "v").mapInArrow(run, schema))


TREE_COLUMNS = ["ids", "points", "order", "start", "end", "left", "low", "high", "sums"]


def read_trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        points, order, start, end, left, low, high, sums = [c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else None for c in batch.columns[1:]]
        points, low, high = (x.reshape(-1, size) for x in (points, low, high))
        if sums is None:  # they may not fit in 64 bits
            points, low, high = (x.astype(object) for x in (points, low, high))
            sums = np.array([points[order[a:b]].sum(axis=0) for a, b in zip(start, end, strict=True)])
        yield batch.column(0)[i].values, Tree(points, order, start, end, left, low, high, sums.reshape(-1, size))


def as_centroids(centroids: list[list[int]], tree: Tree, size: int) -> np.ndarray:
    wide = tree.points.dtype == object or any(abs(x) >= WIDE for c in centroids for x in c)
    return np.array(centroids, object if wide else np.int64).reshape(len(centroids), size)


def moved(trees: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """One round: every vector goes to its nearest centroid, every centroid that has some to the floor of their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tree in read_trees(batch, size):
                count, total = [0] * len(centroids), [0] * len(centroids)
                for c, at, held in tree.assigned(as_centroids(centroids, tree, size)):
                    count[c] += len(at)
                    total[c] = total[c] + (tree.points[at].sum(axis=0) if held is None else held)
                some = [c for c, n in enumerate(count) if n]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[c] for c in some], pa.int64()), pa.array([[str(x) for x in total[c].tolist()] for c in some], pa.list_(pa.string()))], ["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster int, n long, total array<string>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [list(c) for c in centroids]
    with small_batches(trees.sparkSession, HELD):
        found = sums.collect()  # centroids times components
    for r in found:
        out[r["cluster"]][r["at"]] = int(r["x"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of the vectors of exactly `size` components, none null or not finite: (vec_id, cluster, distance), a row for
    each of them, and the final centroids.

    A component x counts as the integer floor(scale * x), of 64 bits. Centroids start as the k vectors with the smallest hashes (see
    `seeds`; fewer if there are fewer vectors). In each round every vector goes to the nearest centroid (the smaller number
    of two as near) and every centroid that has vectors to the floor of their mean; distance is the squared distance to the
    final centroid, the largest 64-bit integer if it is beyond that. Null ids, repeated ids and repeated vectors are rows
    like others; vectors that don't count have no row; an empty table gives none. Other columns aren't returned.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(clusterable(F.col("v"), size))
    kept = materialize(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = seeds(kept, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    trees = in_trees(kept, size)
    discard(kept)
    for _ in range(rounds):
        centroids = moved(trees, centroids, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in read_trees(batch, size):
                own = as_centroids(centroids, tree, size)
                home, far = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
                for c, at, _ in tree.assigned(own):
                    apart = squared(tree.points[at], own[c : c + 1])[:, 0]
                    home[at], far[at] = c, [min(x, _LARGEST) for x in apart.tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(home), pa.array(far)], ["vec_id", "cluster", "distance"])

    with small_batches(trees.sparkSession, HELD):
        assigned = materialize(trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    discard(trees)
    return assigned, centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add each cluster's and all distances' sums and the SHA-256 of the final centroid's components."""
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    if not sums:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    held = lambda x: F.lit(min(x, _LARGEST)).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return assigned.select("vec_id", "cluster", "distance", of([held(sums.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), held(sum(sums.values())).alias("inertia"), of([F.lit(x) for x in digest]).alias("centroid_sha256"))
