"""Dense, keyword and hybrid search, fusion of ranked lists, and statistics of vector collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V

#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 4096


def dense_search(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to one query by squared distance, similarity 1 / (1 + distance); filters come first."""
    rows = vectors if where is None else vectors.where(where)
    far = V.squared_distance(V.doubles(F.col("embedding")), F.lit([float(x) for x in query]))
    return rows.select("vec_id", far.alias("distance")).orderBy("distance", "vec_id").limit(k).withColumn("similarity", V.similarity(F.col("distance")))


def semantic_search(vectors: DataFrame, embed: Callable[[Column], Column], query: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k vectors nearest to a text, which `embed` turns into a vector as a column function (a pandas UDF of a model,
    or one of Spark's functions)."""
    asked = vectors.sparkSession.range(1).select(V.doubles(embed(F.lit(query))).alias("q"))
    rows = vectors if where is None else vectors.where(where)
    far = V.squared_distance(V.doubles(F.col("embedding")), F.col("q"))
    return rows.crossJoin(F.broadcast(asked)).select("vec_id", far.alias("distance")).orderBy("distance", "vec_id").limit(k).withColumn("similarity", V.similarity(F.col("distance")))  # one row


def batch_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest vectors of each query (query_id, embedding): query_id, rank, vec_id, distance.

    Queries go to the tasks in blocks of bounded size, each against all vectors; there are as many tasks as cores, whatever
    the table's size, and each keeps its k best of each query. Null vectors, those with nulls and those of another length
    than most queries have are left out.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    vectors, queries = vectors.where(whole), queries.where(whole)
    wide = queries.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if wide is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    vectors, queries = vectors.where(F.size("embedding") == wide["d"]), queries.where(F.size("embedding") == wide["d"])
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", V.doubles(F.col("embedding")).alias("v")).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), np.array([r["v"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best_far, best_id = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            square = (q * q).sum(axis=1)[:, None]
            for batch in batches:
                for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                    x = np.array(part.column(1).to_pylist(), np.float64)
                    # one matrix product tells which can be among the best; these are measured exactly
                    rough = square - 2 * (q @ x.T) + (x * x).sum(axis=1)
                    room = 1e-9 * (square + (x * x).sum(axis=1).max())
                    most = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1, None] + room
                    if best_far.shape[1] == k:
                        most = np.minimum(most, best_far[:, -1:] + room)
                    a, b = np.nonzero(rough <= most)
                    if not len(a):
                        continue
                    place = np.arange(len(a)) - np.searchsorted(a, a)
                    far = np.full((len(ids), place.max() + 1), np.inf)
                    name = np.full(far.shape, np.iinfo(np.int64).max)
                    far[a, place] = ((x[b] - q[a]) ** 2).sum(axis=1)
                    name[a, place] = part.column(0).to_numpy()[b]
                    far, name = np.hstack([best_far, far]), np.hstack([best_id, name])
                    order = np.lexsort((name, far), axis=1)[:, :k]
                    best_far, best_id = np.take_along_axis(far, order, 1), np.take_along_axis(name, order, 1)
            wide = best_far.shape[1]
            if wide:
                told = np.isfinite(best_far.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, wide)[told]), pa.array(best_id.ravel()[told]), pa.array(best_far.ravel()[told])], ["query_id", "vec_id", "distance"])

        one = vectors.select("vec_id", "embedding").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "query_id long, vec_id long, distance double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    nearest = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def keyword_score(text: Column, keywords: list[str], weights: list[float] | None = None) -> Column:
    """The weighted count of keywords in a text over the sum of weights, 1 at most."""
    weights = weights or [1.0] * len(keywords)
    lower = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for word, weight in zip(keywords, weights, strict=True):
        count = (F.length(lower) - F.length(F.replace(lower, F.lit(word), F.lit("")))) / len(word)
        total = total + count * weight
    return F.least(F.lit(1.0), total / sum(weights)) if keywords else F.lit(0.0)


def keyword_search(rows: DataFrame, id_: str, text: str, keywords: list[str], k: int = 10) -> DataFrame:
    """The k rows with the best keyword score, of those that contain a keyword; all are scored before the cut."""
    any_ = F.lit(False)
    for word in keywords:
        any_ = any_ | F.contains(F.lower(F.col(text)), F.lit(word))
    return rows.where(any_).select(id_, keyword_score(F.col(text), keywords).alias("similarity")).orderBy(F.desc("similarity"), id_).limit(k)


def fused(lists: list[tuple[DataFrame, float]], id_: str, k: int, method: str = "rrf", alpha: float = 60.0) -> DataFrame:
    """One ranked list of several (id, similarity): by reciprocal ranks, weighted sum, maximum or mean."""
    rows = None
    for n, (found, weight) in enumerate(lists):
        place = F.row_number().over(W.orderBy(F.desc("similarity"), id_))
        one = found.select(F.lit(n).alias("list"), id_, "similarity", F.lit(weight).alias("weight"), place.alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    weighted = F.col("similarity") * F.col("weight")
    score = {"rrf": F.sum(1 / (alpha + F.col("place"))), "weighted": F.sum(weighted), "max": F.max(weighted), "mean": F.avg(weighted)}[method]
    return rows.groupBy(id_).agg(F.round(score, 9).alias("score"), F.max("similarity").alias("similarity"), F.count("*").alias("lists")).orderBy(F.desc("score"), id_).limit(k)


def group_separation(vectors: DataFrame) -> DataFrame:
    """Mean cosine within and between the groups of `label`, over all pairs, from sums of unit vectors: no pair is made.

    Within a group of n with sum s the pairs' mean is (|s|^2 - n) / (n (n - 1)); in all, likewise.
    """
    units = vectors.select("label", F.posexplode(V.unit(V.doubles(F.col("embedding")))).alias("dim", "x"))
    by_group = units.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    within = by_group.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n"))
    total = by_group.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n"))
    inside = within.agg(F.sum(F.col("square") - F.col("n")).alias("inside"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    both = inside.crossJoin(F.broadcast(total))  # one row each
    outside = (F.col("square") - F.col("n")) - F.col("inside")
    outside_pairs = F.col("n") * (F.col("n") - 1) - F.col("pairs")
    out = both.select((F.col("inside") / F.col("pairs")).alias("within"), (outside / outside_pairs).alias("between"))
    return out.select(F.round("within", 6).alias("within"), F.round("between", 6).alias("between"), F.round(F.col("within") - F.col("between"), 6).alias("separation"))


def collection_statistics(vectors: DataFrame) -> DataFrame:
    """Count, dimensions, and the norms' mean, deviation (of the population) and extremes."""
    n = V.norm(V.doubles(F.col("embedding")))
    rows = vectors.select(F.size("embedding").alias("d"), n.alias("norm"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("d").alias("dimensions"), F.round(F.avg("norm"), 6).alias("norm_mean"), F.round(F.stddev_pop("norm"), 6).alias("norm_std"), F.round(F.min("norm"), 6).alias("norm_min"), F.round(F.max("norm"), 6).alias("norm_max"))


def dimension_use(vectors: DataFrame) -> DataFrame:
    """The share of vectors that use each dimension, and its mean."""
    long = vectors.select(F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    return long.groupBy("dim").agg(F.round(F.avg((F.col("x") != 0).cast("double")), 6).alias("used"), F.round(F.avg("x"), 6).alias("mean"))


def invalid_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Ids with a reason: no vector, another dimension, or repeated id."""
    twice = vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit("repeated id").alias("reason"))
    reason = F.when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != dimension, "dimension")
    return vectors.select("vec_id", reason.alias("reason")).where(F.col("reason").isNotNull()).unionByName(twice)
