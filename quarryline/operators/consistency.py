"""Differences between snapshots, registries and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified (by hash or by size) and deleted paths of two snapshots (path, hash, size): (change_id, path, change). A
    hash or size that is unknown in one of them only counts as modified."""
    a = old.select("path", F.struct("hash", "size").alias("before"))
    b = new.select("path", F.struct("hash", "size").alias("after"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    rows = both.select("path", change.alias("change")).where(F.col("change").isNotNull())
    return rows.select(F.concat(F.substring("change", 1, 3), F.lit("_"), F.substring(F.md5("path"), 1, 8)).alias("change_id"), "path", "change")


def registry_issues(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries without what they name, what no entry names, and entries that disagree: (id, issue, severity)."""
    lost = registry.join(stored, "id", "left_anti").select("id", F.lit("missing").alias("issue"), F.lit("high").alias("severity"))
    extra = stored.join(registry, "id", "left_anti").select("id", F.lit("orphaned").alias("issue"), F.lit("medium").alias("severity"))
    off = registry.alias("r").join(stored.alias("s"), "id").where(F.col("r.size") != F.col("s.size")).select("id", F.lit("mismatch").alias("issue"), F.lit("low").alias("severity"))
    return lost.unionByName(extra).unionByName(off)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by kind and by severity in one pass."""
    return issues.groupingSets([[F.col("issue")], [F.col("severity")]], F.col("issue"), F.col("severity")).agg(F.count("*").alias("n"))


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changes put in: rows of equal key are replaced, of several changes the last by `ord` counts, and of
    those with one `ord` the largest by the other columns in order."""
    others = [c for c in changes.columns if c not in (key, "ord")]
    best = changes.groupBy(key).agg(F.max(F.struct("ord", *others)).alias("c"))
    last = best.select(key, *[F.col("c")[c].alias(c) for c in others])
    return table.join(last, key, "left_anti").unionByName(last.select(*table.columns))


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def key_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys added, removed or changed between two states (key, value)."""
    both = old.withColumnRenamed("value", "before").join(new.withColumnRenamed("value", "after"), "key", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select("key", change.alias("change")).where(F.col("change").isNotNull())


def kept_snapshots(snapshots: DataFrame, newest: int, since: int) -> DataFrame:
    """Snapshots (id, at) that are among the newest or not older than `since`."""
    top = snapshots.select("id", "at").orderBy(F.desc("at"), "id").limit(newest)
    # those not older than `since` and, of the newest, the older ones: no row is in both, and none is sorted beyond the top
    return snapshots.select("id", "at").where(F.col("at") >= since).unionByName(top.where(F.coalesce(F.col("at") < since, F.lit(True))))


def validated(rows: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Rows with the names of the rules (name: condition that must hold) that they break, joined by commas."""
    broken = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return rows.withColumn("broken", broken).withColumn("is_valid", F.col("broken") == "")


def strict_entities(rows: DataFrame) -> DataFrame:
    """Entities (id, name, type, confidence) stripped, their type in capitals, with the rules that they break."""
    out = rows.withColumns({"name": F.trim("name"), "type": F.upper(F.trim("type"))})
    return validated(out, {"id": F.trim("id") != "", "name": F.col("name") != "", "type": F.col("type") != "", "confidence": F.col("confidence").between(0, 1)})


def strict_relationships(rows: DataFrame) -> DataFrame:
    """Relationships (src, dst, description, weight) with the rules that they break: both ends, no loop, a weight of 0 to 1."""
    return validated(rows, {"ends": (F.trim("src") != "") & (F.trim("dst") != ""), "loop": F.col("src") != F.col("dst"), "description": F.trim("description") != "", "weight": F.col("weight").between(0, 1)})


def strict_units(rows: DataFrame) -> DataFrame:
    """Text units (text, start, end, chunk_index) with the rules that they break."""
    return validated(rows, {"text": F.trim("text") != "", "range": (F.col("start") >= 0) & (F.col("end") > F.col("start")), "index": F.col("chunk_index") >= 0})


def clean_ids(ids) -> Column:
    """Ids stripped, without blanks and repeats, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")))


def registry_against_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong with each registered file (path, size, hash): missing, another size, or another hash."""
    f = files.select("path", F.col("size").alias("real_size"), F.col("hash").alias("real_hash"))
    issue = F.when(F.col("real_size").isNull(), "missing").when(F.col("size") != F.col("real_size"), "size").when(F.col("hash") != F.col("real_hash"), "hash")
    return registry.join(f, "path", "left").select("path", issue.alias("issue")).where(F.col("issue").isNotNull())


def timestamp_issues(rows: DataFrame, id_: str, required: list[str], times: list[str]) -> DataFrame:
    """Required fields that are missing or blank and times that are no ISO times: (id, field, issue)."""
    lost = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.struct(F.lit(c).alias("field"), F.lit("missing").alias("issue"))) for c in required]
    bad = [F.when(F.col(c).isNotNull() & ~is_iso_time(F.col(c)), F.struct(F.lit(c).alias("field"), F.lit("time").alias("issue"))) for c in times]
    return rows.select(id_, F.explode(F.array_compact(F.array(*lost, *bad))).alias("x")).select(id_, "x.field", "x.issue")


def is_iso_time(text) -> Column:
    """Whether a text is a date or a time in ISO form, with or without a zone."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.coalesce(shaped & F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " ")).isNotNull(), F.lit(False))


def fixable(issues: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Issues (issue, ...) with the action that mends them, and the number of each action and of those left to people."""
    action = F.lit(None).cast("string")
    for issue, name in actions.items():
        action = F.when(F.col("issue") == issue, name).otherwise(action)
    return issues.withColumn("action", action).groupBy("issue", "action").agg(F.count("*").alias("n"))


def label_key(name, labels) -> Column:
    """The key of a metric: its name and its labels (a map) as JSON in order."""
    return F.concat(name, F.lit(":"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels)))))


def merged_maps(base, override) -> Column:
    """Both maps as one; the second one's values count where both have a key."""
    left = F.filter(F.map_entries(base), lambda e: ~F.coalesce(F.map_contains_key(override, e["key"]), F.lit(False)))
    return F.map_from_entries(F.array_sort(F.concat(left, F.map_entries(override))))


def merge_settings(base: dict, override: dict) -> dict:
    """Nested settings, the second one's values counting where both have a key."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merge_settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def marked_processed(changes: DataFrame, done: DataFrame) -> DataFrame:
    """Changes (change_id, ...) with processed set and the error taken from `done` (change_id, error)."""
    d = done.select("change_id", F.col("error").alias("__error"), F.lit(True).alias("__done"))
    rows = changes.join(d, "change_id", "left")
    return rows.withColumns({"processed": F.col("processed") | F.coalesce("__done", F.lit(False)), "error": F.coalesce("__error", "error")}).drop("__error", "__done")


def purged(changes: DataFrame, before: int) -> DataFrame:
    """Changes without the processed ones from before a time."""
    return changes.where(~(F.col("processed") & (F.col("at") < before)))
