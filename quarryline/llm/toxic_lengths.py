"""Toxicity by compression distance: window lengths under zstandard dictionaries of ordinary and of toxic text.

One dictionary is trained on windows of ordinary documents, one on the words of toxic documents whose beginnings these have
more often than chance allows. A window is compressed with the ordinary dictionary alone and with both, one behind the
other; what the second saves says how much of the window is toxic text that ordinary text doesn't explain. A document's
savings (means of its largest ones, and how many windows there are) are turned into a score by thresholds that are
calibrated on labelled documents which neither dictionary has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_trie import in_blocks
from .common import discard, materialize

#: Words of a window.
WINDOW = 8
#: Bytes of the dictionaries, and the level that windows are compressed at.
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 110_000, 1_024, 3
#: Lengths of the beginnings of words that are counted besides whole words.
BEGINNINGS = (4, 5, 6, 8)
#: Standard deviations by which the share of toxic documents that have a beginning must exceed that of ordinary ones.
SURPLUS = 6.5
_WORD = re.compile(r"[^\W\d_]+")


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learned from (a null id is not held out, and isn't learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    """The words of the whole text in lower case, WINDOW at a time; a text without words is one blank window."""
    words = _WORD.findall((text or "").lower())
    return [(" " + " ".join(words[k : k + WINDOW]) + " ").encode() for k in range(0, len(words), WINDOW)] or [b" "]


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; of too few to train one, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if content not in _COMPRESSORS:
        if len(_COMPRESSORS) > 8:
            _COMPRESSORS.clear()
        words = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        _COMPRESSORS[content] = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _COMPRESSORS[content]


def savings(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    """What the toxic dictionary saves: means over the largest eighth, sixteenth and two of the windows, and the logarithm
    of their number."""
    alone, both = compressor(ordinary).compress, compressor(ordinary + toxic).compress
    saved = np.sort([len(alone(w)) - len(both(w)) for w in windows(text)])[::-1]
    n = len(saved)
    return [float(saved[: max(2, n // 8)].mean()), float(saved[: max(2, n // 16)].mean()), float(saved[:2].mean()), float(np.log2(n))]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        # term by term, as a matrix product rounds by the number of rows that come together
        terms = _design((x - self.middle) / self.spread)
        return 1 / (1 + np.exp(-np.clip(sum(terms[:, n] * w for n, w in enumerate(self.weights)), -30, 30)))


def _design(x: np.ndarray) -> np.ndarray:
    """Linear terms, and how each saving counts by the number of windows."""
    return np.column_stack([np.ones(len(x)), x, x[:, :3] * x[:, 3:], x[:, :1] ** 2])


def calibrated(ordinary: bytes, toxic: bytes, x: np.ndarray, label: np.ndarray) -> Model:
    """Logistic weights by Newton steps with a small penalty; labels of one kind give their share as every score."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    d = _design((x - middle) / spread)
    weights = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
        curve = (d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(len(weights))
        step = np.linalg.solve(curve, d.T @ (label - p) - 0.1 * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(ordinary, toxic, weights, middle, spread)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def unlike(docs: DataFrame) -> DataFrame:
    """Of documents (text, toxic) that are copies or near copies of each other about one: those that share the smallest hash
    of their runs of five words, by one of four hashes, count once, so that copied text isn't mistaken for usage."""
    words = words_of(F.col("text"))
    runs = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.concat_ws(" ", F.slice("words", i, 5)))).otherwise(F.array(F.concat_ws(" ", "words")))
    rows = docs.withColumn("words", words).withColumn("runs", runs)
    rows = rows.select("text", "toxic", *[F.array_min(F.transform("runs", lambda r, n=n: F.xxhash64(F.lit(n), r))).alias(f"h{n}") for n in range(4)])
    for n in range(4):
        rows = rows.dropDuplicates([f"h{n}"])
    return rows.select("text", "toxic")


def beginnings(word: Column) -> Column:
    cut = lambda n: F.when(F.length(word) > n, F.substr(word, F.lit(1), F.lit(n)))
    return F.array_compact(F.array(*[cut(n) for n in BEGINNINGS], F.concat(word, F.lit(" "))))


def toxic_words(docs: DataFrame, least: float = SURPLUS, most: int = 20_000) -> list[tuple[str, int]]:
    """Words of toxic documents (text, toxic) with a beginning that they have in surplus, and in how many of them: the
    `most` frequent at most."""
    n = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    words = docs.select("toxic", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    units = F.array_distinct(F.flatten(F.transform(words_of(F.col("text")), beginnings)))
    counts = docs.select("toxic", F.explode(units).alias("unit")).groupBy("unit").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count("*").alias("all"))
    share = F.col("all") / (n[True] + n[False])
    apart = F.col("t") / n[True] - (F.col("all") - F.col("t")) / n[False]
    surplus = apart / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n[True] + 1 / n[False]))
    units = counts.where((F.col("t") > 0) & (surplus > least)).select("unit")
    having = words.where("toxic").groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.explode(beginnings(F.col("word"))).alias("unit"))
    found = having.join(units, "unit", "left_semi").groupBy("word").agg(F.first("n").alias("n")).where(F.length("word") <= 64)
    return [(r["word"], r["n"]) for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, ordinary_windows: int = 40_000, seed: int = 7) -> Model | None:
    """Dictionaries and thresholds from at most `sample_rows` labelled documents of the learnable fold, picked by a hash of
    their id: two thirds train the dictionaries, the rest calibrates. The driver holds words and windows of bounded number
    and length, and four numbers a document of the rest. None if no label can be learned from."""
    usable = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    drawn = usable.orderBy(draw, "doc_id").limit(sample_rows).withColumn("part", F.pmod(draw, F.lit(3)))
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", "part"))  # sample_rows rows of three numbers
    for_words = materialize(unlike(texts.where("part > 0").select("text", "toxic")))
    found = toxic_words(for_words)
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / WINDOW).cast("int") - 1)), lambda k: F.concat_ws(" ", F.slice("words", k * WINDOW + 1, WINDOW))))
    pieces = for_words.where("NOT toxic").select(words_of(F.col("text")).alias("words")).select(piece.alias("w")).where("w <> '' AND length(w) <= 400")
    plain = [f" {r['w']} ".encode() for r in pieces.orderBy(F.xxhash64(F.lit(seed), "w"), "w").limit(ordinary_windows).collect()]
    ordinary = trained(plain, ORDINARY_BYTES)
    # words in turn, as neighbours that are the same would be trained as one long string
    toxic = trained([f" {w} ".encode() for k in range(50) for w, n in found if n > k], TOXIC_BYTES)
    rows = measured(texts.where("part = 0").select(F.col("toxic").alias("doc_id"), "text"), ordinary, toxic).collect()
    discard(texts, for_words)
    if not rows:
        return None
    found = sorted((r["x"], float(r["doc_id"])) for r in rows)  # sums of floats in one order, however the rows came
    return calibrated(ordinary, toxic, np.array([x for x, _ in found]), np.array([label for _, label in found]))


def measured(docs: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(doc_id, x): the savings of each whole text; rows stay one for one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 4_000_000):
                x = [savings(t, ordinary, toxic) for t in block.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def score_toxicity(docs: DataFrame, model: Model | None, at_least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: score is 0 to 1, predicted 1 from `at_least` on.

    Null and empty texts, and those without letters, are one blank window that saves nothing, and are scored like others;
    without a model every score is 0. Rows stay one for one, repeats and null ids included; an empty table gives no rows;
    other columns aren't returned.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 4_000_000):
                own = held.value
                score = own.scores(np.array([savings(t, own.ordinary, own.toxic) for t in block.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score), pa.array((score >= at_least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
