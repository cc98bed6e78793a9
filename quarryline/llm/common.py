"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in the contracts' word pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets one in its own warehouse folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Spark's switch for removing an action's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts the lineage, survives lost executors, and
    gives the planner true sizes. What was shuffled for it is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, True):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quarryline_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` has written and nothing reads any more."""
    for one in tables:
        path = one.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(one._quarryline_path)
        path.getFileSystem(one.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 200) -> AbstractContextManager[None]:
    """Batches of few rows for what is run within, where a row can be large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from (a null id is not held out, and isn't learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))
