"""Mixing sources to target weights by subset-sum budget fitting.

A source is taken whole as often as its target allows. For what remains, its documents are counted by exact length:
most of the budget is filled proportionally over the lengths, and the rest is fitted by bounded-knapsack dynamic
programming over the lengths that are left. Then seeded documents are selected, so many of each length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, materialize

#: The part of the budget that the dynamic programme fits, in words.
FITTED = 4096
#: Documents that it can choose from at least, if there are so many.
CHOICE = 64
#: Sums that the programme tells apart at most; if more words are left to it, sums count in units of several words.
SUMS = 1 << 22
#: Steps of the programme between those whose sums are kept.
KEPT_STEPS = 64
#: Ranges of a seeded hash by which the documents of one length are dealt out.
DEALS = 256


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Add target to sources (source, source_size): all words shared by weight, the weights repeating over the sources
    in code point order (null last), no target above `most` times its source; the excess is reshared by weight.

    Which sources stop at their limit follows from the order of limit over weight, so one pass over the sources does.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = (
        rows.withColumn("gone", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.sum("source_size").over(everything) - F.col("gone")) / F.col("left"))
    )
    free = F.col("share") * F.col("weight") <= F.col("limit")
    level = F.first(F.when(free, F.col("share")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.select("source", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, at most `counts`, so that the words come as near to `budget` as they
    can: proportionally, then by the largest that fit, then exactly for what remains, which is a few documents'
    lengths (if that is more than half of SUMS words, in units of as many words as keep the programme to SUMS sums). Sums
    above the budget count as well as those below; of two as near, the one below."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= budget:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    # what is left to the programme is enough for four of the CHOICE shortest documents, so that sums leave no gaps
    seen, kept = 0, FITTED
    for i in reversed(order):
        seen += counts[i] if lengths[i] > 0 else 0
        kept = max(kept, 4 * lengths[i])
        if seen >= CHOICE:
            break
    else:
        kept = budget  # so few documents are all up to the programme
    coarse = max(0, budget - kept)
    take = [c * coarse // total if total else 0 for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in order:
        if lengths[i] > 0:
            more = min(counts[i] - take[i], max(0, rest - kept) // lengths[i])
            take[i] += more
            rest -= more * lengths[i]
    # bounded knapsack: bit w of `sums` says that w units can be made; each bundle doubles, so few steps take many copies.
    # Nothing beyond twice the rest is nearer to it than no document at all.
    unit = -(-2 * rest // SUMS) or 1
    goal = round(rest / unit)
    full = (1 << (2 * goal + 1)) - 1
    size = [round(n / unit) for n in lengths]
    sums, steps, kept_sums = 1, [], []
    for i in reversed(order):
        spare, bundle = counts[i] - take[i], 1
        while lengths[i] > 0 and spare > 0 and not sums >> goal & 1:
            n = min(bundle, spare)
            if size[i] * n > 2 * goal:
                break
            if len(steps) % KEPT_STEPS == 0:
                kept_sums.append(sums)
            steps.append((i, n))
            sums |= sums << size[i] * n & full
            spare -= n
            bundle *= 2
    below = (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = sums >> (goal + 1)
    over = (above & -above).bit_length()
    made = goal + over if over and over < goal - below else below
    # back through the steps, the sums between two kept ones made again
    for k in reversed(range(len(kept_sums))):
        part, before = steps[k * KEPT_STEPS : (k + 1) * KEPT_STEPS], [kept_sums.pop()]
        for i, n in part[:-1]:
            before.append(before[-1] | before[-1] << size[i] * n & full)
        for (i, n), held in zip(reversed(part), reversed(before), strict=True):
            if not held >> made & 1:
                take[i] += n
                made -= n * size[i]
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """How often each document is taken: doc_id, size, source, source_size, target, copies, taken (copies * size).

    size is the number of words. A document is taken at most `most` times; a source's taken words are at its target
    but for what its lengths can't make up. Rows stay one for one; repeats and null ids are rows like others, a null
    source is a source; an empty table gives no rows; other columns aren't returned. Null or empty texts have size 0 and
    are taken as often as the source is taken whole. Reruns agree: the choice follows from a seeded hash of doc_id.
    """
    deal = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), deal.alias("draw")))
    dealt = rows.withColumn("deal", (F.col("draw") % DEALS).cast("int"))
    counted = materialize(dealt.groupBy("source", "size", "deal").agg(F.count("*").alias("n")))
    sources = materialize(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(0)
    by_source = sources.withColumn("whole", whole.cast("long")).withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        group["take"] = fit_lengths(group["size"].tolist(), group["n"].tolist(), int(group["budget"].iloc[0]) if group["whole"].iloc[0] < most else 0)
        return group[["source", "size", "take"]]

    budgets = by_source.select("source", "budget", "whole")
    taken = lengths.join(budgets, same(lengths, budgets)).select(lengths["source"], "size", "n", "budget", "whole").groupBy("source").applyInPandas(fit, "source string, size long, take long")
    # within a length, whole deals are taken in order, and of one deal a part
    taken = taken.where("take > 0")
    upto = W.partitionBy(counted["source"], counted["size"]).orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    by_deal = counted.join(taken, same(counted, taken) & (counted["size"] == taken["size"])).select(
        counted["source"], counted["size"], "deal", F.least(F.col("n"), F.greatest(F.lit(0), F.col("take") - F.coalesce(F.sum("n").over(upto), F.lit(0)))).alias("picks"))
    by_deal = materialize(by_deal.where("picks > 0"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "deal").orderBy("draw", "doc_id")))
    picked = ranked.join(by_deal, same(ranked, by_deal) & (ranked["size"] == by_deal["size"]) & (ranked["deal"] == by_deal["deal"]), "left").select(ranked["source"], "doc_id", ranked["size"], (F.col("rank") <= F.coalesce("picks", F.lit(0))).cast("long").alias("extra"))
    out = picked.join(by_source, same(picked, by_source))
    copies = F.least(F.lit(most), F.col("whole") + F.col("extra"))
    return out.select("doc_id", picked["size"], picked["source"], "source_size", "target", copies.alias("copies"), (copies * picked["size"]).alias("taken"))
