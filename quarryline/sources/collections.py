"""Collections of vectors kept as parquet tables in a folder that all tasks see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consistency import deleted

FIXED = "id string, vector array<float>, created_at timestamp, updated_at timestamp"


class Collections:
    """Create, change and describe the collections of one folder. A change writes a new version beside the old one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory())

    def _versions(self, name: str) -> list[int]:
        top = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(top):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(top) if self._fs.exists(self._path(f"{s.getPath().toString()}/_SUCCESS")))

    def create(self, name: str, metadata: str = "") -> bool:
        if self._versions(name):
            return False
        self.spark.createDataFrame([], FIXED + (f", {metadata}" if metadata else "")).write.parquet(f"{self.folder}/{name}/v0")
        return True

    def drop(self, name: str) -> bool:
        return bool(self._versions(name)) and self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self._versions(name)[-1]}")

    def _replace(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{name}/v{self._versions(name)[-1] + 1}")

    def _stamped(self, name: str, rows: DataFrame) -> DataFrame:
        table = self.read(name)
        now = F.current_timestamp()
        rows = rows.withColumn("vector", F.col("vector").cast("array<float>")).withColumns({c: now for c in ("created_at", "updated_at") if c not in rows.columns})
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows (id, vector, metadata); rows without a vector or of a blank id aren't taken."""
        good = rows.where(F.col("vector").isNotNull() & (F.trim("id") != ""))
        self._replace(name, self.read(name).unionByName(self._stamped(name, good)))

    def upsert(self, name: str, rows: DataFrame) -> None:
        new = self._stamped(name, rows)
        self._replace(name, deleted(self.read(name), new, "id").unionByName(new))

    def delete(self, name: str, ids: DataFrame) -> None:
        self._replace(name, deleted(self.read(name), ids, "id"))

    def get(self, name: str, id_: str) -> DataFrame:
        return self.read(name).where(F.col("id") == id_)

    def describe(self, name: str) -> DataFrame:
        """Count and dimension; 0 for an empty collection."""
        return self.read(name).agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def schema(self, name: str) -> dict[str, str]:
        """The metadata columns of a collection and their types."""
        fixed = {"id", "vector", "created_at", "updated_at"}
        return {f.name: f.dataType.simpleString() for f in self.read(name).schema if f.name not in fixed}

    def statistics(self) -> DataFrame:
        """Over all collections: their number, rows, and different dimensions above 0."""
        rows = None
        for name in self.names():
            one = self.describe(name).select(F.lit(name).alias("name"), "n", "dimension")
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = self.spark.createDataFrame([], "name string, n long, dimension int")
        return rows.agg(F.count("*").alias("collections"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.array_sort(F.collect_set(F.when(F.col("dimension") > 0, F.col("dimension")))).alias("dimensions"))

    def store(self, name: str, rows: DataFrame) -> int:
        """Append rows (id, embedding, ...) that have an embedding, making the collection if there is none; returns how many
        were taken."""
        good = rows.where(F.col("embedding").isNotNull() & (F.trim("id") != "")).withColumnRenamed("embedding", "vector")
        if not self.exists(name):
            self.create(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema if f.name not in ("id", "vector")))
        before = self.read(name).count()
        self.insert(name, good)
        return self.read(name).count() - before

    def restore(self, name: str, from_: str) -> int:
        """Make or replace a collection from a backup; returns the number of rows."""
        rows = self.spark.read.parquet(from_)
        version = (self._versions(name) or [-1])[-1] + 1
        rows.write.parquet(f"{self.folder}/{name}/v{version}")
        return self.read(name).count()

    def backup(self, name: str, to: str) -> int:
        """Copy a collection and return the number of rows, which both have."""
        rows = self.read(name)
        rows.write.mode("overwrite").parquet(to)
        n, copied = rows.count(), self.spark.read.parquet(to).count()
        if n != copied:
            raise RuntimeError(f"{copied} of {n} rows were copied")
        return n
