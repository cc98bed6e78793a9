"""Which texts contain which strings, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Bytes of needles up to which they go into one automaton that every task holds.
AUTOMATON_BYTES = 4_000_000
#: Characters by which strings that contain others are looked up beyond that.
GRAM = 4
#: Rows that a task emits at once.
EMITTED = 50_000


def contains_pairs(needles: DataFrame, hays: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The pairs (needle, hay_id) of strings `needle` and texts (hay_id, hay) that contain them, each once a row of `hays`;
    null and empty needles are in none, null texts contain none.

    Needles of up to `most_bytes` together are put into an Aho-Corasick automaton, which each text is read through once:
    the work is that of reading the texts and their hits. More of them are looked up by their rarest piece of GRAM
    characters. Texts are never a join key and only ids leave the pass.
    """
    asked = written(needles.select("needle").where("needle <> ''").distinct())
    held = asked.agg(F.sum(F.octet_length("needle") + 32).alias("n")).first()["n"] or 0  # one row
    rows = hays.select("hay_id", "hay").where("hay <> ''")
    return by_automaton(asked, rows) if held <= most_bytes else by_rarest_piece(asked, rows)


def by_automaton(needles: DataFrame, hays: DataFrame) -> DataFrame:
    words = needles.sparkSession.sparkContext.broadcast(sorted(r["needle"] for r in needles.collect()))  # AUTOMATON_BYTES at most
    kind = hays.schema["hay_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known = words.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, word in enumerate(known):
            automaton.add_word(word, n)
        if known:
            automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(batch.column(1)):
                hits = {n for _, n in automaton.iter(text.as_py())} if known else ()
                found += [known[n] for n in hits]
                ids += [k] * len(hits)
                if len(ids) >= EMITTED or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(ids, pa.int64()))], ["needle", "hay_id"])
                    ids, found = [], []

    return hays.mapInArrow(run, f"needle string, hay_id {kind}")


def pieces(text: Column, size: int) -> Column:
    """The different runs of `size` characters of a text, itself if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_distinct(runs)


def by_rarest_piece(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Each needle is looked up by that of its pieces which the fewest texts have; the texts are then read once, each with the
    needles that it may contain."""
    numbered = written(hays.withColumn("row", F.monotonically_increasing_id()))
    short = F.least(F.length("needle"), F.lit(GRAM))
    sizes = sorted(r["n"] for r in needles.select(short.alias("n")).distinct().collect())  # GRAM numbers at most
    asked = needles.select("needle", F.explode(pieces(F.col("needle"), GRAM)).alias("piece"))
    laid = numbered.select("row", F.explode(F.array_distinct(F.concat(*[pieces(F.col("hay"), n) for n in sizes]))).alias("piece"))
    counts = laid.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("texts"))
    rarest = asked.join(counts, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("r")).where("r.texts > 0")
    may = laid.join(rarest.select("needle", F.col("r.piece").alias("piece")), "piece")
    listed = may.groupBy("row", F.pmod(F.xxhash64("needle"), F.lit(8)).alias("part")).agg(F.collect_list("needle").alias("needles"))
    read = listed.join(numbered, "row").select("hay_id", F.explode(F.filter("needles", lambda n: F.contains(F.col("hay"), n))).alias("needle"))
    return read.select("needle", "hay_id")
