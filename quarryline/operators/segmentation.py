"""Words of text that is written without blanks: a dictionary counted from the corpus, and the likeliest path through it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written
from .text import CJK

#: Characters of the longest word, and words that a dictionary has at most: the bound that lets every task hold it.
LONGEST, MOST_WORDS = 4, 200_000
#: Costs are logarithms of probabilities in whole millionths, so that paths compare alike everywhere.
SCALE = 1_000_000
_TOKEN = re.compile(f"[a-zA-Z0-9]+|[{CJK}]+")


def counted_words(docs: DataFrame, text: str, least: int = 2, cohesion: int = 2, longest: int = LONGEST, most: int = MOST_WORDS) -> DataFrame:
    """The dictionary (word, n) of the Chinese runs of a table's texts: all single characters, and the runs of up to `longest`
    characters that occur `least` times or more and hold together: however such a run is cut in two, it is at least
    `cohesion` times as frequent as its parts would make it by chance. Of more than `most`, the most frequent stay (ties by
    the word). Null texts have none."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{CJK}]+"), F.lit(0))).alias("run"))
    pieces = lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substr("run", i, F.lit(k))))
    none = F.array().cast("array<string>")
    grams = runs.select(F.explode(F.concat(*[F.coalesce(pieces(k), none) for k in range(1, longest + 1)])).alias("word"))
    counts = written(grams.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.where(F.length("word") == 1).agg(F.sum("n").alias("total"))  # one row
    several = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cuts = several.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substr("word", F.lit(1), i).alias("a"), F.substr("word", i + 1).alias("b")))).alias("cut"))
    a, b = counts.select(F.col("word").alias("a"), F.col("n").alias("na")), counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    held = cuts.select("word", "n", "cut.a", "cut.b").join(a, "a").join(b, "b").crossJoin(F.broadcast(total))
    firm = held.groupBy("word", "n").agg(F.bool_and(F.col("n") * F.col("total") >= cohesion * F.col("na") * F.col("nb")).alias("firm")).where("firm").select("word", "n")
    return counts.where(F.length("word") == 1).unionByName(firm).orderBy(F.desc("n"), "word").limit(most)


def costs_of(counts: dict[str, int]) -> tuple[dict[str, int], int]:
    """The cost of each word, and that of a character that is in no word by itself."""
    total = sum(n for w, n in counts.items() if len(w) == 1) or 1
    return {w: round(SCALE * math.log(total / n)) if n < total else 0 for w, n in counts.items()}, round(SCALE * math.log(total + 1)) + SCALE


def best_path(run: str, costs: dict[str, int], unknown: int, longest: int) -> list[str]:
    """The cheapest way to cut a run into words; of ways as cheap the one of fewer words, then that whose last words are the
    longer ones. The word graph is walked from left to right, so the work grows with the run."""
    best, back = [(0, 0)], [0]
    for end in range(1, len(run) + 1):
        ways = []
        for start in range(max(0, end - longest), end):
            cost = costs.get(run[start:end], unknown if end - start == 1 else None)
            if cost is not None:
                ways.append((best[start][0] + cost, best[start][1] + 1, start))
        least = min(ways)
        best.append(least[:2])
        back.append(least[2])
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segmenter(dictionary: DataFrame, longest: int = LONGEST) -> Callable[[Column], Column]:
    """A tokenizer of text columns by a dictionary (word, n) of at most MOST_WORDS words: runs of Latin letters and digits, and
    the words of Chinese runs, in order. A null text has no words."""
    counts = {r["word"]: r["n"] for r in dictionary.limit(MOST_WORDS).collect()}
    held = dictionary.sparkSession.sparkContext.broadcast(costs_of(counts))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        costs, unknown = held.value

        def words(text: str | None) -> list[str]:
            out = []
            for token in _TOKEN.findall(text or ""):
                out += [token] if token[0].isascii() else best_path(token, costs, unknown, longest)
            return out

        return texts.map(words)

    return cut
