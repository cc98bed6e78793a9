"""Reading folders of text, Markdown and JSON files as documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import strip_markup

# Suffixes that are read, and the order in which encodings are tried.
SUFFIXES = ("txt", "md", "json", "csv")
ENCODINGS = ("utf-8", "gbk", "latin-1")


def decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8 if valid, which Spark checks itself, else the next encoding that fits."""

    @F.pandas_udf("string")
    def other(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for encoding in ENCODINGS[1:]:
                try:
                    return b.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return None

        return raw.map(one)

    valid = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(valid, other(F.when(valid.isNull(), content)))


def detected_encoding(content: Column) -> Column:
    """The first of ENCODINGS that a file's bytes fit, null for none: UTF-8 is told by Spark itself."""

    @F.pandas_udf("string")
    def other(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for encoding in ENCODINGS[1:] if b is not None else ():
                try:
                    b.decode(encoding)
                    return encoding
                except UnicodeDecodeError:
                    continue
            return None

        return raw.map(one)

    valid = F.try_validate_utf8(content.cast("string")).isNotNull()
    return F.when(valid, ENCODINGS[0]).otherwise(other(F.when(~valid, content)))


def validated_files(files: DataFrame, most_bytes: int = 100_000_000, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files with the first reason for which they can't be read: suffix, empty, too large, or encoding (null: none)."""
    reason = F.when(~F.lower("suffix").isin(*suffixes), "suffix").when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too large").when(detected_encoding(F.col("content")).isNull(), "encoding")
    return files.select("path", "size", reason.alias("reason"))


def sorted_listing(files: DataFrame) -> DataFrame:
    """Files in the order of their paths."""
    return files.select("path", "name", "suffix", "size", "modified").orderBy("path")


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, any_case: bool = False) -> DataFrame:
    """Files under a folder, with name, suffix, size, time and content; suffixes are told by case unless `any_case`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
    rows = found.select("path", name.alias("name"), suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows.where((F.lower("suffix") if any_case else F.col("suffix")).isin(*suffixes))


def read_documents(spark: SparkSession, folder: str, language: str | None = None, **options) -> DataFrame:
    """Documents of a folder: id (of the path), title, text, type, size, language (as given) and a map of metadata. Markup is stripped from Markdown; files that
    can't be decoded, and blank ones, have an error instead of a text; files of no bytes are skipped by the reader."""
    rows = scan_files(spark, folder, **options).withColumn("raw", decoded(F.col("content")))
    text = F.trim(F.when(F.col("suffix") == "md", strip_markup(F.col("raw"))).otherwise(F.col("raw")))
    error = F.when(F.col("raw").isNull(), "encoding").when(F.btrim(text, F.lit(" \n\r\t")) == "", "empty")
    return rows.select(F.substring(F.sha2("path", 256), 1, 16).alias("id"), F.regexp_replace("name", r"\.[^.]+$", "").alias("title"), F.when(error.isNull(), text).alias("text"), F.col("suffix").alias("type"), "size", error.alias("error"), F.sha2("content", 256).alias("hash"), F.lit(language).cast("string").alias("language"), F.create_map(F.lit("file_name"), F.col("name"), F.lit("file_path"), F.col("path"), F.lit("modified"), F.col("modified").cast("string")).alias("metadata"))


def listing(files: DataFrame) -> DataFrame:
    """Files, newest first."""
    return files.select("path", "size", "modified").orderBy(F.desc("modified"), "path")


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("question")).where("question <> ''")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_graph(responses: DataFrame, id_: str, text: str, units: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of JSON answers, fenced or not; what isn't valid gives no rows. Entities have rank 1, relations
    weight .8 and type related_to; with `units`, both carry that column, the ids of the batch's units."""
    shape = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string>>"
    bare = F.regexp_replace(F.col(text), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    also = [units] if units else []
    rows = responses.select(id_, *also, F.from_json(bare, shape).alias("j"))
    entities = rows.select(id_, *also, F.explode("j.entities").alias("e")).select(id_, *also, F.trim("e.name").alias("name"), F.upper(F.coalesce("e.type", F.lit("unknown"))).alias("type"), "e.description", F.lit(1.0).alias("rank")).where("name <> ''")
    relations = rows.select(id_, *also, F.explode("j.relationships").alias("r")).select(id_, *also, F.trim("r.source").alias("source"), F.trim("r.target").alias("target"), "r.description", F.lit(0.8).alias("weight"), F.lit("related_to").alias("type")).where("source <> target")
    return entities.distinct(), relations.distinct()
