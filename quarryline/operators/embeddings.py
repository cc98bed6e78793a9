"""Quality of embeddings: similarities by sums and given pairs, never over all pairs one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors (vec_id, embedding) without nulls, as doubles."""
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).withColumn("embedding", V.doubles(F.col("embedding")))


def similarity_spread(vectors: DataFrame) -> DataFrame:
    """Mean and deviation (of the population) of the cosines of all pairs of different rows: n, mean, std.

    Of unit vectors u the sum of all products is |sum u|^2, that of their squares the squared sum of the entries of the
    sum of u u'. Each task adds its vectors up to one such matrix, so what is exchanged doesn't grow with the table.
    """
    d = usable(vectors).select(F.size("embedding").alias("d")).groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    rows = usable(vectors).join(F.broadcast(d.select("d")), F.size("embedding") == F.col("d")).select("embedding")  # one row

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                x = np.array(part.column(0).to_pylist(), np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.hstack([x / np.where(norm == 0, 1, norm), np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    cells = rows.mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    last = cells.agg(F.max("i").alias("last"))
    marked = cells.crossJoin(F.broadcast(last))  # one row
    inner, edge = (F.col("i") < F.col("last")) & (F.col("j") < F.col("last")), (F.col("i") == F.col("last")) & (F.col("j") < F.col("last"))
    t = marked.agg(F.sum(F.when(inner, F.col("s") * F.col("s"))).alias("squares"), F.sum(F.when(edge, F.col("s") * F.col("s"))).alias("products"), F.sum(F.when(inner & (F.col("i") == F.col("j")), F.col("s"))).alias("own"), F.max(F.when((F.col("i") == F.col("last")) & (F.col("j") == F.col("last")), F.col("s"))).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("products") - F.col("own")) / pairs
    return t.select(F.col("n").cast("long").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("own")) / pairs - mean * mean)), 6).alias("std"))


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosines of given pairs (a, b) of ids; a pair with an unknown id has no row, one with a zero vector 0."""
    v = usable(vectors).select("vec_id", V.unit(F.col("embedding")).alias("u"))
    both = pairs.join(v.select(F.col("vec_id").alias("a"), F.col("u").alias("x")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("u").alias("y")), "b")
    return both.select("a", "b", V.dot(F.col("x"), F.col("y")).alias("cosine"))


def consistency(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Number, mean and deviation (of the population) of the cosines of given pairs."""
    return pair_cosines(pairs, vectors).agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.stddev_pop("cosine"), 6).alias("std"))


def similarity_matrix(vectors: DataFrame, ids: list) -> DataFrame:
    """The cosines of a few named vectors with each other: (a, b, cosine), their number squared."""
    v = usable(vectors).where(F.col("vec_id").isin(*ids)).select("vec_id", V.unit(F.col("embedding")).alias("u"))
    a, b = v.select(F.col("vec_id").alias("a"), F.col("u").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("u").alias("y"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", V.dot(F.col("x"), F.col("y")).alias("cosine"))  # the named ones only


def chinese_metrics(texts: DataFrame, vectors: DataFrame, least: float = 0.3) -> DataFrame:
    """Over texts (vec_id, text) that aren't empty: mean and deviation of the share of Chinese characters, mean length and
    words, and the mean product of the vectors of different texts that are mostly Chinese (0 for fewer than two)."""
    from .passages import is_mostly_chinese
    from .text import CJK, words

    t = F.col("text")
    rows = texts.where(F.coalesce(t, F.lit("")) != "").select("vec_id", (F.regexp_count(t, F.lit(f"[{CJK}]")) / F.length(t)).alias("share"), F.length(t).alias("length"), F.size(words(t)).alias("words"), is_mostly_chinese(t, least).alias("chinese"))
    whole = rows.agg(F.count("*").alias("texts"), F.count_if("chinese").alias("chinese"), F.round(F.avg("share"), 6).alias("ratio_mean"), F.round(F.stddev_pop("share"), 6).alias("ratio_std"), F.round(F.avg("length"), 6).alias("mean_length"), F.round(F.avg("words"), 6).alias("mean_words"))
    long = usable(vectors).join(rows.where("chinese").select("vec_id"), "vec_id").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    sums = long.groupBy("dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    pairs = F.max("n") * (F.max("n") - 1)
    mean = sums.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("s")) - F.sum("q"), pairs), F.lit(0.0)), 6).alias("coherence"))
    return whole.crossJoin(F.broadcast(mean))  # one row each


def length_pairs(pairs: DataFrame, texts: DataFrame, times: float = 2.0) -> DataFrame:
    """Of pairs (a, b) of ids those whose one text is at least `times` as long as the other: (a, b), the shorter first."""
    n = texts.select("vec_id", F.length("text").alias("n"))
    both = pairs.join(n.select(F.col("vec_id").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("vec_id").alias("b"), F.col("n").alias("y")), "b")
    turned = both.select(F.when(F.col("x") <= F.col("y"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("x") <= F.col("y"), F.col("b")).otherwise(F.col("a")).alias("b"), F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return turned.where((F.col("x") > 0) & (F.col("y") >= F.col("x") * times)).select("a", "b")


def model_metrics(rows: DataFrame, similar: DataFrame, lengths: DataFrame, least: float = 0.3) -> DataFrame:
    """What the scores of a model read, by model, from rows (model, vec_id, embedding, text, domain, quality) and pairs (a, b) of
    similar texts and of short and long ones: n, quality, ratio, norm_mean, norm_std, used, similarity, coherence,
    semantic, length, separation.

    Sums by model, domain and dimension are enough for all means over pairs: of unit vectors u of number n with sum s they
    are (|s|^2 - n) / (n (n - 1)). Tasks add up their own rows first, so what is exchanged doesn't grow with the table.
    Vectors that are null, zero or hold nulls are left out; a mean over no pair is 0.
    """
    from .graph import written
    from .text import CJK

    t, x = F.coalesce(F.col("text"), F.lit("")), F.col("embedding")
    share = F.coalesce(F.try_divide(F.length(t) - F.length(F.regexp_replace(t, f"[{CJK}]+", "")), F.length(t)), F.lit(0.0))
    # each text is read once, before its vector is taken apart, and goes no further
    known = usable(rows).where(F.exists("embedding", lambda x: x != 0)).select("model", "vec_id", "embedding", "domain", "quality", share.alias("share"), (F.length(t) > 0).alias("told"))
    known = written(known.withColumn("chinese", F.col("told") & (F.col("share") >= least)).drop("told"))
    scalars = known.select("model", "quality", "share", V.norm(x).alias("norm")).groupBy("model").agg(
        F.count("*").alias("n"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("quality"), F.avg("share").alias("ratio"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"))
    long = known.select("model", "domain", "chinese", F.posexplode(F.arrays_zip(x.alias("x"), V.unit(x).alias("u"))).alias("dim", "c")).select("model", "domain", "chinese", "dim", "c.x", "c.u")
    cells = written(long.groupBy("model", "domain", "chinese", "dim").agg(F.sum("u").alias("s"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("qx"), F.count("*").alias("n")))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    added = [F.sum(c).alias(c) for c in ("s", "sx", "qx", "n")]
    spread = F.col("qx") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sx") / F.col("n"))
    whole = cells.groupBy("model", "dim").agg(*added).groupBy("model").agg(F.avg((spread > 1e-4).cast("double")).alias("used"), square("s").alias("square"), F.max("n").alias("all"))
    inner = cells.groupBy("model", "domain", "dim").agg(*added).groupBy("model", "domain").agg(square("s").alias("sq"), F.max("n").alias("k")).groupBy("model").agg(F.sum(F.col("sq") - F.col("k")).alias("inside"), F.sum(F.col("k") * (F.col("k") - 1)).alias("inside_pairs"))
    told = cells.where("chinese").groupBy("model", "dim").agg(*added).groupBy("model").agg(square("sx").alias("csq"), F.sum("qx").alias("cown"), F.max("n").alias("cn"))
    model_of = known.select(F.col("vec_id").alias("a"), "model")
    mean = lambda pairs, name: pair_cosines(pairs, known).join(model_of, "a").groupBy("model").agg(F.avg("cosine").alias(name))
    out = scalars.join(whole, "model").join(inner, "model").join(told, "model", "left").join(mean(similar, "semantic"), "model", "left").join(mean(lengths, "length"), "model", "left")
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    every, n, c = F.col("square") - F.col("all"), F.col("all"), F.col("cn")
    apart = part(F.col("inside"), F.col("inside_pairs")) - part(every - F.col("inside"), n * (n - 1) - F.col("inside_pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("model", "n", "quality", "ratio", "norm_mean", "norm_std", "used", part(every, n * (n - 1)).alias("similarity"), part(F.col("csq") - F.col("cown"), c * (c - 1)).alias("coherence"), zero(F.col("semantic")).alias("semantic"), zero(F.col("length")).alias("length"), apart.alias("separation"))


def model_scores(metrics: DataFrame) -> DataFrame:
    """The overall score and that for Chinese of each model, beside the metrics, rounded."""
    c = F.col
    overall = overall_quality(c("quality"), c("norm_std"), c("used"), c("similarity"), c("ratio"), c("coherence"))
    chinese = chinese_score(c("ratio"), c("norm_mean"), c("norm_std"), c("semantic"), c("length"), c("separation"))
    return metrics.select("model", "n", *[F.round(m, 6).alias(m) for m in metrics.columns[2:]], F.round(overall, 6).alias("overall"), chinese.alias("chinese"))


def overall_quality(text: Column, norm_std: Column, used: Column, similarity: Column, ratio: Column, coherence: Column, least: float = 0.3) -> Column:
    """.3 of the texts' quality, .4 of the vectors' (steady norms, used dimensions, moderate similarity), .3 of Chinese
    share and coherence, each from 0 to 1."""
    clamp = lambda c, low=0.0: F.greatest(F.lit(low), F.least(F.lit(1.0), c))
    vectors = clamp(((1 - F.least(norm_std, F.lit(0.5))) + used + (1 - F.abs(clamp(similarity, -1.0)))) / 3)
    chinese = clamp((F.least(ratio / max(least, 0.1), F.lit(1.0)) + (clamp(coherence, -1.0) + 1) / 2) / 2)
    return clamp(0.3 * clamp(text) + 0.4 * vectors + 0.3 * chinese)


def chinese_score(ratio: Column, norm_mean: Column, norm_std: Column, semantic: Column, length: Column, separation: Column) -> Column:
    """One score of a model for Chinese: share .2, norms near 1 .25, semantic .25, length .15, separation of domains .15."""
    zero, one = F.lit(0.0), F.lit(1.0)
    norm = F.greatest(zero, 1 - F.abs(norm_mean - 1)) * F.greatest(zero, 1 - norm_std)
    return F.round(0.2 * F.least(ratio / 0.8, one) + 0.25 * norm + 0.25 * F.least(F.greatest(semantic, zero), one) + 0.15 * F.least(F.greatest(length, zero), one) + 0.15 * F.least(F.greatest(separation, zero) / 0.2, one), 3)


def field_score(fields: list[tuple[Column, float]], keywords: list[str], weights: list[float] | None = None) -> Column:
    """The keyword score over several fields (text, factor): each keyword counts in the first field that has it."""
    weights = weights or [1.0] * len(keywords)
    total = F.lit(0.0)
    for word, weight in zip(keywords, weights, strict=True):
        found = F.lit(0.0)
        for text, factor in reversed(fields):
            lower = F.lower(F.coalesce(text, F.lit("")))
            count = (F.length(lower) - F.length(F.replace(lower, F.lit(word), F.lit("")))) / len(word)
            found = F.when(F.contains(lower, F.lit(word)), count * weight * factor).otherwise(found)
        total = total + found
    return F.least(F.lit(1.0), total / sum(weights)) if keywords else F.lit(0.0)


def sparse_terms(sparse: Column, most: int = 10) -> Column:
    """The terms of a sparse vector (a map of weights) with the largest weights, ties by alphabet."""
    by_weight = F.array_sort(F.transform(F.map_entries(sparse), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("term"))))
    return F.transform(F.slice(by_weight, 1, most), lambda e: e["term"])
