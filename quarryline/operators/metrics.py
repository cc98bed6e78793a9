"""Usage, latency, error and cost analytics over event records (ts, a key, a value and what else is asked for).

"Now" is always a parameter or the latest record, so that reruns agree. Ties are broken by the record's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seconds(ts) -> Column:
    """Whole seconds since 1970 of a time (with or without zone; the session's zone is UTC)."""
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def usage_summary(records: DataFrame, failed: Column, value: str, *by: str) -> DataFrame:
    """Totals, successes and success rate over all records and by each of `by`, in one pass (grouping sets); values are
    summed over successes only. A column that a row isn't grouped by is null."""
    marked = records.select(*by, failed.alias("failed"), F.col(value).alias("value"))
    return (
        marked.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by])
        .agg(F.count("*").alias("requests"), F.count_if(~F.col("failed")).alias("successes"), F.round(F.avg((~F.col("failed")).cast("double")), 6).alias("success_rate"), F.round(F.sum(F.when(~F.col("failed"), F.col("value"))), 4).alias("value_sum"))
    )


def key_stats(records: DataFrame, key: str, failed: Column, value: str) -> DataFrame:
    """Requests, failures, first and last use and mean value per key; the mean is over successes."""
    return records.groupBy(key).agg(
        F.count("*").alias("requests"),
        F.count_if(failed).alias("failures"),
        seconds(F.min("ts")).alias("first_used"),
        seconds(F.max("ts")).alias("last_used"),
        F.round(F.avg(F.when(~failed, F.col(value))), 6).alias("mean_value"),
    )


def time_buckets(records: DataFrame, unit: str, *by: str, value: str = "value") -> DataFrame:
    """Tumbling buckets of one hour, day or month: count, sum and mean."""
    pattern = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]
    return records.groupBy(F.date_format("ts", pattern).alias("bucket"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def trailing_error_rate(records: DataFrame, key: str, failed: Column, minutes: int, least: int, above: float) -> DataFrame:
    """The records at which a key's error rate over the trailing window passes `above`, of `least` records at least."""
    frame = W.partitionBy(key).orderBy(seconds("ts")).rangeBetween(-60 * minutes, 0)
    rate = F.round(F.avg(failed.cast("double")).over(frame), 6)
    return records.select("event_id", key, F.count("*").over(frame).alias("n"), rate.alias("rate")).where((F.col("n") >= least) & (F.col("rate") > above))


def tiered_alerts(records: DataFrame, value: str, tiers: dict[str, float]) -> DataFrame:
    """The severity of each record: the first tier (highest first) that its value is above; others are left out."""
    level = F.lit(None).cast("string")
    for name, limit in sorted(tiers.items(), key=lambda t: t[1]):
        level = F.when(F.col(value) > limit, F.lit(name)).otherwise(level)
    return records.select("event_id", F.col(value), level.alias("severity")).where(F.col("severity").isNotNull())


def running_counter(records: DataFrame, *labels: str, width: float = 86_400.0) -> DataFrame:
    """The cumulative sum of each counter, in the order of time and id.

    The records of a counter are summed up by stretches of `width` seconds, a scan over the stretches says what each begins
    with, and within a stretch the records are added to that: no task holds more of a counter than one stretch of it and
    one row for each stretch. Records without a time come first.
    """
    keys = [*labels, "__stretch"]
    rows = records.withColumn("__stretch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (width * 1e6)))
    sums = rows.groupBy(*keys).agg(F.sum("value").alias("__sum"))
    so_far = W.partitionBy(*labels).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    begun = sums.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.coalesce(F.sum("__sum").over(so_far), F.lit(0.0)).alias("__before"))
    own = F.sum("value").over(W.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    within = rows.select("event_id", *keys, F.coalesce(own, F.lit(0.0)).alias("__own"))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    return within.join(begun, same).select("event_id", *labels, F.round(F.col("__before") + F.col("__own"), 3).alias("counter"))


def gauge(records: DataFrame, *labels: str) -> DataFrame:
    """The latest value of each gauge."""
    return records.groupBy(*labels).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def histogram(records: DataFrame, width: float, *labels: str) -> DataFrame:
    return records.groupBy(*labels, F.floor(F.col("value") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def timer_stats(records: DataFrame, key: str, last: int = 1000) -> DataFrame:
    """Count, mean and extremes over all of a timer's records; percentiles, as the element at floor(n * p), over its
    last ones only."""
    newest = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    recent = records.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= last).groupBy(key).agg(F.array_sort(F.collect_list("value")).alias("x"))
    at = lambda p: F.element_at("x", F.floor(F.size("x") * p).cast("int") + 1)
    whole = records.groupBy(key).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return whole.join(recent.select(key, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")), key)


def exclusive_quantiles(records: DataFrame, key: str, cuts: dict[str, float], bins: int = 1024) -> DataFrame:
    """Quantiles at position p * (n + 1) of each key's values, interpolated; null values don't count.

    They are selected by histogram: values are counted in `bins` ranges between a key's extremes, and only the ranges that
    hold a place asked for are looked into, value by value with its count. So no group is sorted or held by one task, a key
    of all rows included.
    """
    rows = records.select(F.col(key).alias("key"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    ends = rows.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    e = ends.select(F.col("key").alias("k"), "low", "high", "n")
    share = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    dealt = rows.join(e, F.col("key").eqNullSafe(F.col("k"))).select("key", "value", "n", F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int").alias("bin"))
    counts = dealt.groupBy("key", "n", "bin").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("n") + 1
    low = lambda p: F.greatest(F.lit(1), F.least(F.floor(place * p), F.col("n") - 1))
    # a place has the value with at most place - 1 smaller ones
    asked = F.array(*[F.struct(F.lit(name).alias("cut"), at.cast("long").alias("place"), part.alias("part")) for name, p in cuts.items() for at, part in ((low(p), 1 - (place * p - low(p))), (low(p) + 1, place * p - low(p)))])
    bounds = counts.withColumn("before", before)
    wanted = bounds.select("key", "bin", "before", "held", F.explode(asked).alias("a")).where((F.col("a.place") > F.col("before")) & (F.col("a.place") <= F.col("before") + F.col("held")))
    spots = wanted.select(F.col("key").alias("k"), F.col("bin").alias("b"), "before", "a.cut", "a.place", "a.part")
    ranges = spots.select("k", "b", "before").distinct()
    near = dealt.join(ranges, F.col("key").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b"))).groupBy("key", "bin", "before", "value").agg(F.count("*").alias("same"))
    upto = F.sum("same").over(W.partitionBy("key", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = near.withColumn("last", F.col("before") + upto).select("key", "bin", "value", "last", (F.col("last") - F.col("same")).alias("first"))
    found = ranked.join(spots, F.col("key").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("b")) & (F.col("place") > F.col("first")) & (F.col("place") <= F.col("last")))
    return found.groupBy(F.col("key").alias(key)).agg(*[F.round(F.sum(F.when(F.col("cut") == name, F.col("value") * F.col("part"))), 6).alias(name) for name in cuts])


def trend(records: DataFrame, key: str, frame: int = 5, tolerance: float = 0.1) -> DataFrame:
    """The mean of the last `frame` values against that of those before: rising, falling or stable; keys with fewer
    than two frames are unknown."""
    newest = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    place = F.col("place")
    means = records.withColumn("place", F.row_number().over(newest)).where(place <= 2 * frame).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(F.when(place <= frame, F.col("value"))).alias("now"), F.avg(F.when(place > frame, F.col("value"))).alias("before"))
    word = F.when(F.col("n") < 2 * frame, "unknown").when(F.col("now") > F.col("before") * (1 + tolerance), "rising").when(F.col("now") < F.col("before") * (1 - tolerance), "falling").otherwise("stable")
    return means.select(key, F.round("now", 6).alias("recent_mean"), word.alias("trend"))


def error_groups(errors: DataFrame, *parts: str) -> DataFrame:
    """Errors that agree in `parts`, under a short hash: how many, and when last seen."""
    key = F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts])), 1, 16)
    return errors.groupBy(key.alias("error_hash")).agg(F.count("*").alias("n"), seconds(F.max("ts")).alias("last_seen"))


def over_threshold(groups: DataFrame, severity: Column, limits: dict[str, int]) -> DataFrame:
    """Groups whose count reaches the limit of their severity."""
    least = F.lit(None).cast("int")
    for name, n in limits.items():
        least = F.when(severity == name, n).otherwise(least)
    return groups.withColumn("severity", severity).where(F.col("n") >= least)


def retained(groups: DataFrame, oldest: int, most: int) -> DataFrame:
    """Error groups seen since `oldest`, the newest `most` of them."""
    return groups.where(F.col("last_seen") >= oldest).orderBy(F.desc("last_seen"), "error_hash").limit(most)


def top_keys(records: DataFrame, key: str, metric: Column, limit: int) -> DataFrame:
    return records.groupBy(key).agg(metric.alias("metric")).orderBy(F.desc("metric"), key).limit(limit)


def budget_use(records: DataFrame, key: str, daily: float, monthly: float) -> DataFrame:
    """What each record brings its key's day and month to, and whether that is within budget or near it."""
    day = W.partitionBy(key, F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    month = W.partitionBy(key, F.date_trunc("month", "ts")).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    used = records.select("event_id", key, F.round(F.sum("value").over(day), 3).alias("day_total"), F.round(F.sum("value").over(month), 3).alias("month_total"))
    state = F.when((F.col("day_total") > daily) | (F.col("month_total") > monthly), "over").when((F.col("day_total") > 0.8 * daily) | (F.col("month_total") > 0.8 * monthly), "near").otherwise("within")
    return used.withColumn("state", state)


def recent_efficiency(records: DataFrame, key: str, failed: Column, last: int = 20, least: int = 10) -> DataFrame:
    """Keys with enough records: success rate and mean value of the last ones, and their ratio."""
    newest = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    marked = records.withColumn("failed", failed).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= last)
    means = marked.groupBy(key).agg(F.count("*").alias("n"), F.avg((~F.col("failed")).cast("double")).alias("success"), F.avg("value").alias("cost")).where(F.col("n") >= least)
    return means.select(key, F.round("success", 6).alias("success"), F.round("cost", 6).alias("cost"), F.round(F.col("success") / (F.col("cost") + 0.001), 6).alias("efficiency"))


def best_keys(records: DataFrame, key: str, failed: Column) -> DataFrame:
    """The key with the largest mean value, and those with the largest count and success rate; ties to the first name."""
    means = records.groupBy(key).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.avg((~failed).cast("double")).alias("rate"))
    first = lambda metric: F.min_by(key, F.struct(-F.col(metric), F.col(key)))
    return means.agg(first("mean").alias("by_mean"), first("n").alias("by_count"), first("rate").alias("by_rate"))


def adaptive_batch(records: DataFrame, key: str, base: int, target: float, last: int = 10) -> DataFrame:
    """The batch size after each record: a tenth of the way to what the trailing mean time allows, within half and
    twice the base; the base until three records are there."""
    frame = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(1 - last, 0)
    mean, n = F.avg("value").over(frame), F.count("value").over(frame)
    ideal = F.lit(target) / F.greatest(F.abs(mean), F.lit(0.001))
    size = F.greatest(F.lit(base / 2.0), F.least(F.lit(base * 2.0), F.lit(float(base)) + 0.1 * (ideal - base)))
    return records.select("event_id", key, F.round(F.when(n < 3, F.lit(float(base))).otherwise(size), 4).alias("batch_size"))


def down_sampled(records: DataFrame, key: str, interval: int) -> DataFrame:
    """Each key's records, one kept only if `interval` seconds have passed since the last one kept.

    The rule looks back at its own choices, so each key's times are walked in order: a task walks its sorted rows as they
    come, with the last kept time as all it remembers. Times within one key aren't split, but never held either.
    """
    kind = records.schema[key].dataType.simpleString()
    rows = records.select(key, "event_id", seconds("ts").alias("second"))
    dealt = rows.repartition(key).sortWithinPartitions(key, "second", "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, until = object(), 0
        for batch in batches:
            names, at = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for name, second in zip(names, at, strict=True):
                new = name != held
                take = second is not None and (new or until is None or second >= until)
                if new:
                    held, until = name, None
                if take:
                    until = second + interval
                keep.append(take)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=[key, "event_id"]).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(walk, f"{key} {kind}, event_id long")


def smoothed(records: DataFrame, key: str, old: float = 0.7) -> DataFrame:
    """The exponentially smoothed value of each key's daily means, in order of days."""
    days = records.groupBy(key, F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    series = days.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "mean"))).alias("x"))
    out = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.element_at("x", 1)["mean"], lambda acc, d: old * acc + (1 - old) * d["mean"])
    return series.select(key, F.round(out, 6).alias("smoothed"))


def daily_extremes(records: DataFrame) -> DataFrame:
    return records.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"), F.count_if(F.col("event_type") == "error").alias("errors"))


def request_spikes(records: DataFrame, width: int = 300, times: float = 3.0) -> DataFrame:
    """Buckets of time with over `times` the mean count of all buckets that have records."""
    buckets = records.groupBy((F.floor(seconds("ts") / width) * width).cast("long").alias("start")).agg(F.count("*").alias("n"))
    mean = buckets.agg(F.avg("n").alias("mean"))
    return buckets.join(F.broadcast(mean), F.col("n") > times * F.col("mean")).select("start", "n")


def monthly_costs(records: DataFrame, model: str, cost: str) -> DataFrame:
    """Requests and cost of each calendar month and model, with the month's total and the model's share of it."""
    by = records.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col(model).alias("model")).agg(F.count("*").alias("requests"), F.sum(cost).alias("cost"))
    whole = by.groupBy("month").agg(F.sum("cost").alias("total"))  # a row for each month
    m = F.col("month")
    both = by.join(whole.withColumnRenamed("month", "of"), m.eqNullSafe(F.col("of")))
    return both.select("month", "model", "requests", F.round("cost", 4).alias("cost"), F.round("total", 4).alias("total"), F.round(F.coalesce(F.try_divide(F.col("cost"), F.col("total")), F.lit(0.0)), 6).alias("share"))


def counts_by_each(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows have each value of each of `by`, in one pass: (kind, value, n, place), the most frequent first."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("kind"), F.col(b).cast("string").alias("value")) for b in by]))
    counts = rows.select(each.alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), F.asc_nulls_first("value"))))
