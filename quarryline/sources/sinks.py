"""Writing documents, indexes, results and records, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a saved index.
INDEX = ("documents", "entities", "relationships", "communities")


def save_index(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables of an index as JSON lines, with a table of their counts. Text units and embeddings aren't saved."""
    counts = None
    for name in INDEX:
        tables[name].write.mode("overwrite").json(f"{folder}/{name}")
        one = tables[name].agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    counts.write.mode("overwrite").json(f"{folder}/index_stats")


def load_index(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The saved tables with the given schemas."""
    return {name: spark.read.schema(schemas[name]).json(f"{folder}/{name}") for name in INDEX}


def virtual_units(documents: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Text units for an index that was saved without: a unit for each document with a text, entity and relationship that
    has a description: (unit_id, text, kind)."""
    unit = lambda df, kind, id_, text: df.select(F.concat(F.lit(kind + "_"), F.col(id_).cast("string")).alias("unit_id"), text.alias("text"), F.lit(kind).alias("kind"))
    out = unit(documents, "document", "id", F.col("text"))
    out = out.unionByName(unit(entities, "entity", "id", F.concat_ws(": ", "name", F.nullif(F.col("description"), F.lit("")))))
    out = out.unionByName(unit(relationships, "relationship", "id", F.col("description")))
    return out.where(F.trim("text") != "")


def documents_to_parquet(documents: DataFrame, folder: str) -> str:
    """Documents (id, title, text, metadata) as a parquet table."""
    documents.select("id", "title", "text", "metadata").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return f"{folder}/documents.parquet"


def save_results(results: DataFrame, path: str, form: str) -> None:
    """Results (query, answer, confidence, search_type, search_time) as json, csv, markdown or txt. Line ends within csv
    fields become spaces."""
    out = results.select("query", "answer", "confidence", "search_type", "search_time")
    if form == "json":
        out.write.mode("overwrite").json(path)
    elif form == "csv":
        flat = out.withColumns({c: F.regexp_replace(c, r"[\r\n]+", " ") for c in ("query", "answer")})
        flat.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    elif form == "markdown":
        line = F.format_string("## %s\n\n%s\n\n- %s, %.2f\n", "query", "answer", "search_type", "confidence")
        out.select(line.alias("value")).write.mode("overwrite").text(path)
    elif form == "txt":
        out.select(F.format_string("%s\t%s", "query", "answer").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form}")


def export_records(records: DataFrame, path: str, form: str = "json") -> None:
    """Metrics, errors, usage or benchmarks as json or csv; nested columns are JSON texts in csv."""
    if form == "json":
        records.write.mode("overwrite").json(path)
    elif form == "csv":
        nested = {f.name: F.to_json(f.name) for f in records.schema if f.dataType.typeName() in ("array", "map", "struct")}
        records.withColumns(nested).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form}")


def pending(changes: DataFrame, most: int) -> DataFrame:
    """The oldest changes that aren't processed yet, `most` at most."""
    return changes.where("NOT processed").orderBy("at", "change_id").limit(most)
