"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of labelled text is built. A text is parsed against it
greedily: each phrase is the longest match that continues in the sample. The number of phrases, each priced at the
base-2 logarithm of the sample's length, is the code length of the text; the language that needs fewest normalised
phrases wins. The automaton with its restarts is laid out as a table, so many texts take their next byte at once; a long
text is cut into lanes that are parsed side by side from the start, and then each from the state in which the lane before
it ends, as far as the two parses differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import learnable

#: Bytes of one lane.
LANE = 1024
#: Lanes that are parsed side by side.
WIDTH = 16384


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of `text`; state 0 is the start."""
    moves, link, longest = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


_PARSERS: dict[tuple, Parser] = {}


class Parser:
    """Counts the phrases of texts against each language's sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        known = sorted({b for s in samples.values() for b in s})
        self.wide = len(known) + 2
        #: class of each byte: 0 for bytes in no sample, the last for the filling after a lane's end
        self.classes = np.zeros(256, np.uint8)
        self.classes[known] = np.arange(1, len(known) + 1)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.langs])
        self.tables = [self._table(suffix_automaton(samples[x]), known) for x in self.langs]

    @classmethod
    def of(cls, samples: dict[str, bytes]) -> Parser:
        key = tuple(sorted(samples.items()))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = cls(samples)
        return _PARSERS[key]

    def _table(self, moves: list[dict[int, int]], known: list[int]) -> np.ndarray:
        """For a state's row and a byte's class: the next row's start times four, plus the number of phrases that end: the
        open one where it can't go on, and that of a byte in no sample, which is a phrase by itself."""
        at = {b: k + 1 for k, b in enumerate(known)}
        fresh = np.full(self.wide, 2, np.int32)
        for b, to in moves[0].items():
            fresh[at[b]] = 4 * to * self.wide + 1
        table = np.tile(fresh, (len(moves), 1))
        for s, out in enumerate(moves):
            for b, to in out.items():
                table[s, at[b]] = 4 * to * self.wide
        # at the start no phrase is open
        table[0] -= table[0] % 4 > 0
        table[:, -1] = 4 * np.arange(len(moves)) * self.wide
        return table.ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases, a row for each text and a column for each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        if not len(owner):
            return out
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(sizes) - sizes, lanes) + LANE * place
        size = np.minimum(LANE, np.repeat(np.cumsum(sizes), lanes) - start)
        order = np.argsort(-size, kind="stable")
        count, end = np.zeros((len(self.langs), len(owner)), np.int64), np.zeros((len(self.langs), len(owner)), np.int32)
        for k in range(0, len(order), WIDTH):
            part = order[k : k + WIDTH]
            longest = int(size[part[0]])
            grid = np.full((longest, len(part)), self.wide - 1, np.uint8)
            full = int((size[part] == longest).sum())
            if full:
                grid[:, :full] = data[start[part[:full], None] + np.arange(longest)].T
            for j in range(full, len(part)):
                grid[: size[part[j]], j] = data[start[part[j]] : start[part[j]] + size[part[j]]]
            for n, table in enumerate(self.tables):
                at = np.zeros(len(part), np.int32)
                told = np.zeros(len(part), np.int32)
                for row in grid:
                    at += row
                    found = table.take(at)
                    told += found & 3
                    at = found >> 2
                count[n, part], end[n, part] = told, at
        last = np.cumsum(lanes)[sizes > 0] - 1
        for n, table in enumerate(self.tables):
            true_end, entry, more = end[n].copy(), np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64)
            while True:
                want = np.r_[np.int32(0), true_end[:-1]]
                want[place == 0] = 0
                again = np.flatnonzero(want != entry)
                if not len(again):
                    break
                entry[again] = want[again]
                more[again], true_end[again] = resumed(table, data, self.wide - 1, start[again], size[again], want[again], end[n, again])
            out[:, n] = np.bincount(owner, count[n] + more, len(texts)).astype(np.int64)
            out[owner[last], n] += true_end[last] > 0
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its share among the languages' code probabilities, and phrases per byte."""
        counts = self.phrases(texts)
        bits = counts * self.bits
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(-np.minimum(bits - least[:, None], 60)).sum(axis=1)
        rate = counts[np.arange(len(texts)), best] / np.maximum(1, [len(t) for t in texts])
        return [self.langs[b] for b in best], share, rate


def resumed(table: np.ndarray, data: np.ndarray, filling: int, start: np.ndarray, size: np.ndarray, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many phrases more end in each lane if it is entered in state `entry` instead of the start, and its last state,
    which is `end` if both parses meet. They are followed side by side until they do."""
    more, last = np.zeros(len(start), np.int64), end.copy()
    live, a, b = np.arange(len(start)), np.zeros(len(start), np.int32), entry.copy()
    for k in range(LANE):
        if k % 8 == 0:
            over = (a == b) | (size[live] <= k)
            last[live[over]] = b[over]
            last[live[over & (a == b)]] = end[live[over & (a == b)]]
            live, a, b = live[~over], a[~over], b[~over]
            if not len(live):
                return more, last
        byte = np.where(k < size[live], data[np.minimum(start[live] + k, len(data) - 1)], filling)
        x, y = table.take(a + byte), table.take(b + byte)
        more[live] += (y & 3).astype(np.int64) - (x & 3)
        a, b = x >> 2, y >> 2
    same = a == b
    last[live] = np.where(same, end[live], b)
    return more, last


def letters(text: Column) -> Column:
    """Lower-cased letters; whatever stands between them is one space, for symbols tell languages nothing."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def fit_samples(docs: DataFrame, sample_bytes: int = 16_384, sample_rows: int = 64, stretch: int = 1024, all_bytes: int = 131_072) -> dict[str, bytes]:
    """Lower-cased labelled text of each language from the learnable fold: of at most `sample_rows` texts, drawn by a hash of
    their id, a stretch of `stretch` characters at most from a place that the hash tells, `sample_bytes` a language and
    `all_bytes` of all languages together at most. These bounds hold whatever the corpus, and long texts are drawn like
    short ones. An unlabelled language isn't learned; rows with a null id, label or text, or without a letter, are left
    out."""
    usable = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)).alias("draw"), "doc_id", "text")
    # a number for each language; then a few times the rows that are asked for, so that what is sorted is small
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, (4 * sample_rows << 30) // n + 1)])
    text = letters(F.col("text"))
    begin = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.lit(1), F.length("text") - stretch + 1)).cast("int") + 1
    few = usable.where(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "draw", "doc_id", text.alias("text"))
    few = few.select("lang", "draw", "doc_id", F.substr("text", begin, F.lit(stretch)).alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    drawn: dict[str, list[str]] = {}
    for r in few.withColumn("place", place).where(F.col("place") <= sample_rows).orderBy("lang", "place").select("lang", "text").collect():
        drawn.setdefault(r["lang"], []).append(r["text"])
    most = min(sample_bytes, all_bytes // len(counts))
    return {lang: "\n".join(dict.fromkeys(texts)).encode()[:most].decode(errors="ignore").encode() for lang, texts in drawn.items()}


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The language of each whole text: doc_id, lang_pred, score, rate (phrases per byte).

    score is the winner's share of the code probabilities, 0 to 1. A text that is null or has no letter, and any text
    if nothing could be learned, is `und` with score 0. Ties go to the first language by name. Rows stay one for one,
    repeats included; other columns aren't returned.
    """
    parser = Parser.of if samples else None  # each Python worker lays the tables out once, from the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                langs, scores, rates = parser(samples).predict([t.encode() for t in block.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(langs), pa.array(scores), pa.array(rates)], ["doc_id", "lang_pred", "score", "rate"])

    text = F.col("text")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) & F.lit(parser is not None)
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = docs.where(~lettered).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(1.0).alias("rate"))
    if parser is None:
        return none
    return docs.where(lettered).select("doc_id", letters(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rate double").unionByName(none)


def blocks(batch: pa.RecordBatch, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
