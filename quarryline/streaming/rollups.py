"""The event roll-ups over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of each type in tumbling windows of event time; records later than `late` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: records with less than `gap` between them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def polled_changes(seen: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of a source that polls: the changes between the state seen (path, hash, size) and what was found, and the
    state to start from next."""
    from ..operators.consistency import snapshot_changes

    return snapshot_changes(seen, found), found.select("path", "hash", "size")


class ChangeLog:
    """What has become of each batch of changes, in storage: a ledger of (batch, attempt, state, error) and the rows of the
    batches that failed. States are applied, failed and, after `most` attempts, dead; the last one of a batch holds."""

    def __init__(self, spark: SparkSession, path: str, most: int = 3):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _append(self, batch: int, attempt: int, state: str, error: str = "") -> None:
        row = self.spark.createDataFrame([(batch, attempt, state, error)], "batch long, attempt int, state string, error string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def ledger(self) -> DataFrame:
        """The last state of each batch."""
        schema = "batch long, attempt int, state string, error string"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/ledger")
        order = F.struct("attempt", (F.col("state") != "failed").alias("last"))
        return rows.groupBy("batch").agg(F.max_by(F.struct("attempt", "state", "error"), order).alias("s")).select("batch", "s.*")

    def failed_rows(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/failed/batch={batch}")

    def dead(self) -> DataFrame:
        """Batches that are given up, with their errors; their rows stay readable by `failed_rows`."""
        return self.ledger().where("state = 'dead'").select("batch", "attempt", "error")

    def tried(self, apply, rows: DataFrame, batch: int, attempt: int) -> None:
        """Apply a batch and note what came of it. The rows of one that fails are written before that is noted."""
        try:
            apply(rows, batch)
        except Exception as error:  # whatever it is, the batch is kept and comes again
            if attempt == 1:
                rows.write.mode("overwrite").parquet(f"{self.path}/failed/batch={batch}")
            self._append(batch, attempt, "failed" if attempt < self.most else "dead", str(error)[:2000])
        else:
            self._append(batch, attempt, "applied")

    def retried(self, apply) -> None:
        """Try the batches that have failed again, the oldest first."""
        for r in self.ledger().where("state = 'failed'").orderBy("batch").collect():  # open batches
            self.tried(apply, self.failed_rows(r["batch"]), r["batch"], r["attempt"] + 1)


def pending_changes(changes: DataFrame, apply, checkpoint: str, log: str | None = None, most: int = 3):
    """Micro-batches of change records that aren't processed given to `apply(rows, batch)`, one after the other; returns the
    running query.

    A change is never lost: a batch that fails is kept with its rows in the change log (folder `log`, by default beside the
    checkpoint) and tried again before each later batch and at each start, `most` times in all, after which it is listed as
    dead. It is applied once: the log, which the batch's number is the key of, tells a restarted query what is done. If the
    driver is lost after `apply` and before its note, the batch comes again with its number, by which `apply` can write
    idempotently (`into_batches` does).
    """
    kept = ChangeLog(changes.sparkSession, log or f"{checkpoint.rstrip('/')}-log", most)
    kept.retried(apply)

    def one(rows: DataFrame, batch: int) -> None:
        if kept.ledger().where(F.col("batch") == batch).take(1):
            return
        kept.retried(apply)
        kept.tried(apply, rows.where("NOT coalesce(processed, false)"), batch, 1)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_batches(path: str):
    """An `apply` that writes each batch to a folder of its number, over what an interrupted attempt has left there."""

    def apply(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return apply
