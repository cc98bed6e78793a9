"""Embedding near-dedup within the cells of spherical k-means.

Centroids are fitted on a bounded sample; every vector goes to the cell of its nearest centroid, its home, and visits
the cells that may be home to a vector near enough. In a cell, blocks of home vectors meet blocks of all its vectors in
one matrix product each, in double precision. A link counts for both ends, in the homes of both if each visits the other's
and else in the one where they meet, so none counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash_gray import hook, settled

#: Vectors of a block.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not zero, no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def spherical_k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows; an emptied cell starts anew at the row that fits its own centroid worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(near[np.arange(len(x)), home]))
        for c in np.flatnonzero(size < 1e-12):
            sums[c] = x[next(worst)]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visited(near: np.ndarray, centres: np.ndarray, apart: np.ndarray, radius: np.ndarray, limit: float, reach: float) -> np.ndarray:
    """Which cells each vector visits, from its cosines with their centroids; `apart` are the centroids' distances from
    each other, `radius` the largest angle of a home vector from its centroid.

    Two vectors of cosine `limit` are at most `delta` apart. If y is at home in c and x in b, x is nearer to c than to b by
    -delta * |c - b| at least, and at an angle from c of at most y's and theirs. These two bounds lose nothing. In many
    dimensions x - y is rarely in line with c - b: its part that is so has a deviation of about 1 / sqrt(dimensions) of
    its length, of which the first bound allows `reach` times, up to all.
    """
    delta = np.sqrt(max(0.0, 2 - 2 * limit))
    best = near.argmax(axis=1)
    share = min(1.0, reach / np.sqrt(centres.shape[1]))
    keep = near >= near[np.arange(len(near)), best][:, None] - share * delta * apart[best] - 1e-9
    keep &= np.arccos(np.clip(near, -1, 1)) <= radius + np.arccos(limit) + 1e-7
    keep[np.arange(len(near)), best] = True
    return keep


def near_vectors(vectors: DataFrame, limit: float = 0.9, reach: float = 2.2, sample_rows: int = 20_000, most_cells: int = 2048) -> DataFrame:
    """Links of cosine `limit` or more: vec_id, n_links (other vectors linked), component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and stay as groups of one;
    vectors of other lengths never link. Equal vectors count as one in the cells and as many in the counts; rows stay
    one for one. component_id is the smallest vec_id reachable (nulls only if all are), kept says vec_id = component_id;
    of rows that repeat the smallest id all are kept. Other columns aren't returned.

    Every vector is compared with those of the cells that it visits (see there): with an infinite `reach` no link is lost,
    and in up to reach^2 dimensions none is anyhow; else a few of those at the limit are. The number of cells grows as the
    square root of the number of vectors up to `most_cells`; larger cells are more blocks. The fit sees at most
    `sample_rows` vectors, picked by hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    apart = rows.where(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    fit = rows.where(usable(F.col("v")))
    distinct = materialize(fit.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("uid", F.monotonically_increasing_id()))
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()
    if not sample:
        return apart.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    drawn: dict[int, list] = {}
    for r in sample:
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    cells = int(min(most_cells, max(1, distinct.count() ** 0.5)))
    centres = spark.sparkContext.broadcast({n: spherical_k_means(unit(x), max(1, cells * len(x) // len(sample))) for n, x in drawn.items()})

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list, np.ndarray | None]]:
        v = batch.column(1).to_pylist()
        lengths = np.array([len(x) for x in v])
        for n in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == n)
            yield n, of, [v[i] for i in of], centres.value.get(n)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, v, own in by_length(batch):
                if own is not None:
                    near = unit(v) @ own.T
                    home, far = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
                    cells = np.unique(home)
                    widest = [far[home == c].max() for c in cells]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), n, np.int32)), pa.array(cells.astype(np.int32)), pa.array(widest)], ["length", "cell", "radius"])

    # one row for each cell that has a centroid
    wide = distinct.select("uid", "v").mapInArrow(at_home, "length int, cell int, radius double").groupBy("length", "cell").agg(F.max("radius").alias("radius")).collect()
    radii = {n: np.zeros(len(c)) for n, c in centres.value.items()}
    for r in wide:
        radii[r["length"]][r["cell"]] = r["radius"]
    radius = spark.sparkContext.broadcast(radii)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {n: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for n, c in centres.value.items()}
        for batch in batches:
            uid, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for n, of, v, own in by_length(batch):
                if own is None:
                    who, cell, home = np.arange(len(of)), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                else:
                    near = unit(v) @ own.T
                    home = near.argmax(axis=1)
                    who, cell = np.nonzero(visited(near, own, apart[n], radius.value[n], limit, reach))
                ends = np.searchsorted(who, np.arange(len(of) + 1))
                visits = [cell[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[who].astype(np.int32)), pa.array([visits[i] for i in who], pa.list_(pa.int32())), pa.array(uid[of[who]]), pa.array(copies[of[who]]), pa.array([v[i] for i in who], pa.list_(pa.float64()))], ["length", "cell", "home", "visits", "uid", "copies", "v"])

    columns = ["home", "visits", "uid", "copies", "v"]
    members = materialize(distinct.select("uid", "v", "copies").mapInArrow(assign, "length int, cell int, home int, visits array<int>, uid long, copies long, v array<double>"))
    # one row for each cell: most_cells at most, and one for each length of vectors that the sample lacks
    blocks = members.groupBy("length", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(blocks, ["length", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.where("home = cell").select("length", "cell", F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asks"), *columns)
    right = dealt.select("length", "cell", F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), *columns)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks, cell = group["asks"].to_numpy(), group["cell"].iloc[0]
        uid, copies, home, visits, x = group["uid"].to_numpy(), group["copies"].to_numpy(), group["home"].to_numpy(), group["visits"].to_numpy(), unit(group["v"].tolist())
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        # places of the distinct uids, in order, so that a tree's root is its smallest uid
        names, place = np.unique(uid, return_inverse=True)
        root, count = np.arange(len(names)), np.zeros(len(names), np.int64)
        for k in range(0, len(a), 512):
            part = a[k : k + 512]
            p, q = np.nonzero(x[part] @ x[b].T >= limit)
            p, q = part[p], b[q]
            other = uid[p] != uid[q]
            p, q = p[other], q[other]
            count += np.bincount(place[p], copies[q], len(names)).astype(np.int64)
            # a visitor counts this link at home if the other one visits there, and here if not
            guest = np.flatnonzero(home[q] != cell)
            only = guest[[home[j] not in visits[i] for i, j in zip(p[guest], q[guest], strict=True)]] if len(guest) else guest
            count += np.bincount(place[q[only]], copies[p[only]], len(names)).astype(np.int64)
            hook(root, place[p], place[q])
        root = settled(root)
        told = (count > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"uid": names[told], "n": count[told], "root": names[root[told]]})

    found = materialize(left.unionByName(right).groupBy("length", "cell", "i", "j").applyInPandas(compare, "uid long, n long, root long"))
    parts = connected_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    known = distinct.join(counts, "uid", "left").join(parts, distinct.uid == parts.node, "left").select("v", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "uid").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    told = known.join(least, "root").select("v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = fit.join(told, "v").select("vec_id", "n_links", "component_id").unionByName(apart)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
