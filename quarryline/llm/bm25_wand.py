"""Exact BM25 top-k search with block-max pruning, shard by shard.

Queries lie in the tasks as lists by term, once for all shards. A shard is a bounded run of documents of a group (groups
are those of alike queries, told by frequent terms), blocks of like lengths after one another. Each document adds its
contributions along the lists of its rare terms: what a query has so far, with the block's largest contributions of the
frequent terms or with all of the document's own, bounds the score from above. Queries that no document of the block
can bring to their floors, the k-th best scores of the shards before, are skipped; for the others the frequent terms are
added by products of matrices, many queries and documents at once. Those sums are in single precision with room for its
error; what may be among the best is then added up in double precision. Document counts and lengths are those of the whole table, so the scores of all
shards compare and their best are merged exactly. Documents are taken apart into terms once; terms are told by hashes of 64
bits, of which two of ten million terms share one by a chance of 3e-6.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe_trie import in_blocks
from .common import discard, materialize, setting

K1, B = 1.2, 0.75
#: Most documents and distinct terms of documents of a shard.
SHARD_DOCS, SHARD_TERMS = 6144, 2_000_000
#: Documents of a block, and that are searched side by side; queries of a product; most terms of a group that are laid out as rows.
BLOCK_DOCS, SLAB, SIDE, ROWS = 64, 128, 2048, 1024
#: Groups of alike queries at first, the frequent terms that tell them, and the cosine of centres from which on two are one.
GROUPS, FEATURES, ALIKE = 8, 512, 0.4
#: The work of a cell of a product against that of a place of a list.
CELL = 0.006
#: Room for the error of sums in single precision.
ERROR = 1e-4
#: Queries, and terms of queries, that are sent to the tasks at once.
QUERY_BLOCK, QUERY_TERMS = 24_576, 6_000_000
#: Queries from which on a term's list is copied by itself.
LONG = 64
#: ASCII letters in lower case, digits and all bytes beyond ASCII are parts of terms; the rest separates them.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def corpus_statistics(docs: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of documents, their mean length in terms, and (term, df) of each term, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*df, None], pa.binary()).cast(pa.string()), pa.array([*df.values(), n], pa.int64()), pa.array([0] * len(df) + [length], pa.int64())], ["term", "df", "length"])
            df.clear()
            return out

        df: Counter[bytes] = Counter()
        n = length = 0
        for batch in batches:
            for block in in_blocks(batch, 1_000_000):
                for t in block.column(1).to_pylist():
                    found = terms(t)
                    n += 1
                    length += len(found)
                    df.update(set(found))
                if len(df) > 400_000:
                    yield told()
                    n = length = 0
        yield told()

    parts = docs.select("doc_id", "text").mapInArrow(count, "term string, df long, length long")
    table = materialize(parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")))
    total = table.where("term IS NULL").first()
    n = total["df"] if total else 0
    return n, (total["length"] / n if n else 0.0), table.where("term IS NOT NULL").select("term", "df")


def characteristic_terms(asking: DataFrame, n: int, df: DataFrame, most: int | None = 25, least_df: int = 2) -> DataFrame:
    """A query for each document: the `most` terms (None: all) of its whole text with the largest tf * idf that `least_df`
    documents have at least: (query_id, terms array<struct<term, idf>>), rarest first. Documents without such terms have no query."""
    kind = asking.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 1_000_000):
                for q, t in zip(block.column(0), block.column(1).to_pylist(), strict=True):
                    tf = Counter(w.decode("utf-8", "replace") for w in terms(t))
                    yield pa.RecordBatch.from_arrays([pa.array([q.as_py()] * len(tf), block.schema.field(0).type), pa.array(tf.keys(), pa.string()), pa.array(tf.values(), pa.int64())], ["query_id", "term", "tf"])

    found = asking.select("doc_id", "text").mapInArrow(split, f"query_id {kind}, term string, tf long")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = found.groupBy("query_id", "term").agg(F.max("tf").alias("tf")).join(df.where(F.col("df") >= least_df), "term").withColumn("idf", idf)
    best = W.partitionBy("query_id").orderBy((F.col("tf") * F.col("idf")).desc(), "term")
    top = weighed if most is None else weighed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("order"), "term", "idf"))).alias("terms")).select("query_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["idf"].alias("idf"))).alias("terms"))


class Asked:
    """Queries and the lists of those that name each term. bounds part them into groups of alike queries; the terms that many
    of a group name are laid out as rows, one byte a query."""

    def __init__(self, queries: list[np.ndarray], known: int, bounds: list[int] | None = None):
        self.queries, self.m = queries, len(queries)
        size = np.array([len(q) for q in queries], np.int64)
        terms_ = np.concatenate(queries) if queries else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])
        self.size = np.bincount(terms_, minlength=known)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.of = np.repeat(np.arange(self.m, dtype=np.int32), size)[np.argsort(terms_, kind="stable")]
        bounds = bounds or [0, self.m]
        of = np.repeat(np.arange(self.m, dtype=np.int32), size)
        self.common, self.groups = self._rows(terms_, of, self.m, ROWS // 2), []
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = slice(ends[a], ends[b])
            frequent, row, bits = self._rows(terms_[part], of[part] - a, b - a, ROWS)
            # where the group's part of each row's list begins and ends
            inside = np.array([np.searchsorted(self.of[x:y], (a, b)) + x for x, y in zip(self.at[frequent].tolist(), self.at[frequent + 1].tolist(), strict=True)], np.int64).reshape(-1, 2)
            self.groups.append((a, b, frequent, row, bits, inside))

    def _rows(self, term: np.ndarray, of: np.ndarray, m: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms that most of m queries name, each term's row (-1: none), and the rows."""
        count = np.bincount(term, minlength=len(self.size))
        frequent = np.argsort(-count, kind="stable")[:most]
        frequent = frequent[count[frequent] > max(1, m // 64)]
        row = np.full(len(count), -1, np.int16)
        row[frequent] = np.arange(len(frequent))
        bits = np.zeros((len(frequent), m), np.uint8)
        place = row[term]
        bits[place[place >= 0], of[place >= 0]] = 1
        return frequent, row, bits


class Shard:
    """A run of documents over the terms of a block of queries. term_of and doc_of are the terms of the documents, with
    repeats; or by document, each with its terms sorted and once, with tf."""

    def __init__(self, ids: list, lengths: list[int], term_of: np.ndarray, doc_of: np.ndarray, idf: np.ndarray, mean: float, tf: np.ndarray | None = None):
        self.ids, self.n, self.known = ids, len(ids), len(idf)
        if tf is None:
            pair, tf = np.unique(doc_of.astype(np.int64) * self.known + term_of, return_counts=True)
            doc_of, term_of = np.divmod(pair, self.known)
            del pair
        self.doc_term = term_of.astype(np.int32)
        self.doc_at = np.searchsorted(doc_of, np.arange(self.n + 1))
        self.doc_impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * np.array(lengths) / mean))[doc_of])
        self.doc_impact *= idf[self.doc_term]
        self.asked = np.zeros(self.known, bool)

    def search(self, queries: list[np.ndarray] | Asked, k: int, floors: np.ndarray, group: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of the documents that may be among the best k, of those that score its
        floor at least. group is that of the queries that are most like the documents."""
        asked = queries if isinstance(queries, Asked) else Asked(queries, self.known)
        out = [(np.zeros(0, np.int64), np.zeros(0))] * asked.m
        low = np.maximum(floors * (1 - ERROR) ** 2, np.finfo(np.float32).tiny).astype(np.float32)
        held, n_held = [], 0
        for a in range(0, self.n, SLAB):
            new = self._slab(asked, group, a, min(a + SLAB, self.n), k, low)
            held.append(new)
            n_held += len(new[0])
            if n_held > 3 * k * asked.m:
                held = [best_so_far(held, k, low)]
                n_held = len(held[0][0])
        of, doc, _ = best_so_far(held, k, low)
        turn = np.flatnonzero(np.diff(of, prepend=-1))
        for x, y in zip(turn.tolist(), [*turn[1:].tolist(), len(of)], strict=False):
            q = int(of[x])
            out[q] = self._exact(asked.queries[q], np.sort(doc[x:y]), k, floors[q])
        return out

    def _slab(self, asked: Asked, group: int, lo: int, hi: int, k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents and scores in single precision, where these reach `low`; queries without a floor get one."""
        n, m = hi - lo, asked.m
        a, b, frequent, row, bits, inside = asked.groups[group]
        term, impact = (x[self.doc_at[lo] : self.doc_at[hi]] for x in (self.doc_term, self.doc_impact))
        doc = np.repeat(np.arange(n), np.diff(self.doc_at[lo : hi + 1]))
        # as many of the group's rows as pay are added up by a product, those of them that pay for the other queries, too; all else by lists
        place, count = row[term], inside[:, 1] - inside[:, 0]
        named = np.bincount(place[place >= 0], minlength=len(bits))
        lists = np.concatenate([np.cumsum((named * count)[::-1])[::-1], [0]])
        used = int(np.argmin(lists + CELL * n * (b - a) * np.arange(len(bits) + 1)))
        laid = (place >= 0) & (place < used)
        _, common, common_bits = asked.common
        wide = (common[frequent] >= 0) & (named * (asked.size[frequent] - count) > CELL * n * (m - b + a))
        doc_, impact_, place_ = doc[laid], impact[laid], place[laid]
        part = ~wide[place_]
        other = term[laid][part]
        score = self._by_lists(asked, n, [(doc[~laid], impact[~laid], asked.at[term[~laid]], asked.at[term[~laid] + 1]), (doc_[part], impact_[part], asked.at[other], inside[place_[part], 0]), (doc_[part], impact_[part], inside[place_[part], 1], asked.at[other + 1])])
        if used:
            own = np.zeros((-(-n // BLOCK_DOCS) * BLOCK_DOCS, used), np.float32)
            own[doc_, place_] = impact_
            most, total = own.reshape(-1, BLOCK_DOCS, used).max(axis=1), own.sum(axis=1)[:n, None]
            own = own[:n]
            for c in range(a, b, SIDE):
                d = min(c + SIDE, b)
                side = bits[:used, c - a : d - a].astype(np.float32)
                bound = np.minimum(np.repeat(most @ side, BLOCK_DOCS, axis=0)[:n], total)
                bound += score[:, c:d]
                live = np.flatnonzero((bound.max(axis=0) >= low[c:d] * (1 - ERROR)))
                if 4 * len(live) > 3 * (d - c):
                    score[:, c:d] += own @ side
                elif len(live):
                    score[:, c + live] += own @ side[:, live]
            wide = np.flatnonzero(wide[:used])
            if len(wide):
                some, own = common[frequent[wide]], own[:, wide]
                for x, y in ((0, a), (b, m)):
                    for c in range(x, y, SIDE):
                        d = min(c + SIDE, y)
                        score[:, c:d] += own @ common_bits[some, c:d].astype(np.float32)
        top = score.max(axis=0)
        fresh = np.flatnonzero((low <= np.finfo(np.float32).tiny) & (top > 0)) if n > k else []
        if len(fresh):
            low[fresh] = np.maximum(low[fresh], np.partition(score[:, fresh], n - k, axis=0)[n - k] * (1 - ERROR) ** 2)
        some = np.flatnonzero(top >= low)
        near = score[:, some]
        doc, at = np.nonzero(near >= low[some])
        return some[at], doc + lo, near[doc, at]

    def _by_lists(self, asked: Asked, n: int, parts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Sums of impacts by document and query. parts: documents, impacts, and first and last places of lists."""
        doc, impact, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        some = np.flatnonzero(last > first)
        some = some[np.argsort(doc[some], kind="stable")]
        doc, impact, first, size = doc[some], impact[some], first[some], (last - first)[some]
        # short lists are gathered for all documents at once, long ones are copied as a whole
        short = size < LONG
        gathered = asked.of[spans(first[short], size[short])]
        weights = np.repeat(impact[short], size[short])
        cuts = np.cumsum(np.bincount(doc[short], size[short], n)).astype(np.int64).tolist()
        turns = np.cumsum(np.bincount(doc[~short], minlength=n)).tolist()
        impact, first, size = impact[~short], first[~short], size[~short]
        starts, ends, of = first.tolist(), (first + size).tolist(), asked.of
        score = np.zeros((n, asked.m), np.float32)
        for i, (a, b, x, y) in enumerate(zip([0, *cuts], cuts, [0, *turns], turns, strict=False)):
            pairs = np.concatenate([gathered[a:b], *[of[s:e] for s, e in zip(starts[x:y], ends[x:y], strict=True)]], dtype=np.int64)
            if len(pairs):
                score[i] = np.bincount(pairs, np.concatenate([weights[a:b], np.repeat(impact[x:y], size[x:y])]), asked.m)
        return score

    def _exact(self, query: np.ndarray, found: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores in full, each in the order of terms, so that equal documents of all shards score the same."""
        self.asked[query] = True
        size = self.doc_at[found + 1] - self.doc_at[found]
        post = spans(self.doc_at[found], size)
        hit = self.asked[self.doc_term[post]]
        scores = np.bincount(np.repeat(np.arange(len(found)), size)[hit], self.doc_impact[post[hit]], len(found))
        self.asked[query] = False
        if len(scores) > k:
            floor = max(floor, np.partition(scores, -k)[-k])
        keep = (scores > 0) & (scores >= floor)
        return found[keep], scores[keep]


def best_so_far(held: list[tuple[np.ndarray, ...]], k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (queries, documents, scores), by query, what may be among the best k; raises `low` to what these reach."""
    of, doc, score = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    order = np.lexsort((-score, of))
    of, doc, score = of[order], doc[order], score[order]
    turn = np.flatnonzero(np.diff(of, prepend=-1))
    full = turn[np.diff(turn, append=len(of)) >= k]
    low[of[full]] = np.maximum(low[of[full]], score[full + k - 1] * np.float32((1 - ERROR) ** 2))
    keep = score >= low[of]
    return of[keep], doc[keep], score[keep]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, `size` of them, side by side."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def alike(queries: list[np.ndarray], known: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of documents by the frequent terms that they hold, found by spherical k-means of the queries: the column of
    each such term (-1: none), and the centres. Which group a document is put in changes the time, not the result."""
    column = np.full(known, -1, np.int16)
    if len(queries) < 64 * GROUPS:
        return column, np.zeros((1, 0), np.float32)
    size = np.bincount(np.concatenate(queries), minlength=known)
    frequent = np.argsort(-size, kind="stable")[:FEATURES]
    column[frequent] = np.arange(len(frequent))
    points = held_columns([column[q] for q in queries], len(frequent))
    points /= np.maximum(np.sqrt(points.sum(axis=1, keepdims=True)), 1)
    centres = points[[int(points.sum(axis=1).argmax())]]
    while len(centres) < GROUPS:  # the point that is the least like all centres so far, of those that hold much
        least = np.where(points.sum(axis=1) >= np.median(points.sum(axis=1)), (points @ centres.T).max(axis=1), 9)
        centres = np.concatenate([centres, points[[int(least.argmin())]]])
    for _ in range(8):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.array([points[own == c].sum(axis=0) for c in range(GROUPS)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    while len(sums) > 1:  # groups that name much the same are one
        like = np.tril(centres @ centres.T, -1)
        a, b = np.unravel_index(like.argmax(), like.shape)
        if like[a, b] < ALIKE:
            break
        sums[b] += sums[a]
        sums = np.delete(sums, a, axis=0)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return column, centres.astype(np.float32)


def held_columns(columns: list[np.ndarray], n: int) -> np.ndarray:
    """A row for each array of columns, with 1 in those that it holds (-1: none)."""
    out = np.zeros((len(columns), n), np.float32)
    column, of = np.concatenate(columns), np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    out[of[column >= 0], column[column >= 0]] = 1
    return out


def label(terms_: list[np.ndarray], column: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The group of each document."""
    if len(centres) == 1 or not terms_:
        return np.zeros(len(terms_), np.int64)
    return (held_columns([column[t] for t in terms_], centres.shape[1]) @ centres.T).argmax(axis=1)


SEED = 42


def term_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, length, hashes, counts) of each document, written: its number of terms, and the hashes and numbers of its
    distinct ones as bytes of 64 and 32 bits each, by hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for block in in_blocks(batch, 1_000_000):
                found = [Counter(terms(t)) for t in block.column(1).to_pylist()]
                hashes, counts = [], []
                for tf in found:
                    value, count = np.fromiter(map(digest, tf, repeat(SEED)), np.uint64, len(tf)), np.fromiter(tf.values(), np.int32, len(tf))
                    order = np.argsort(value)
                    hashes.append(value[order].tobytes())
                    counts.append(count[order].tobytes())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([tf.total() for tf in found], pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "length", "hashes", "counts"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, length long, hashes binary, counts binary"))


def search(docs: DataFrame, queries: DataFrame, n: int, mean: float, k: int = 10) -> DataFrame:
    """The `k` best documents of each query: query_id, rank (from 1), doc_id, score; ties go to the smaller doc_id.

    queries are (query_id, terms array<struct<term, idf>>); they are sent to the tasks in blocks of about QUERY_BLOCK,
    each against all documents. There are about as many tasks as cores, whatever the table's size, each of which goes through its
    shards one after the other with the floors so far and gives the best of each query once. Documents without a query's terms aren't found by it; null texts have no terms; rows
    that repeat are found as often; other columns aren't returned. Scores are those of BM25 with k1 1.2 and b 0.75.
    """
    spark = docs.sparkSession
    queries = materialize(queries.withColumn("draw", F.pmod(F.xxhash64("query_id"), F.lit(1 << 40))))
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-asked["n"] // QUERY_BLOCK), -(-asked["terms"] // QUERY_TERMS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    found = None
    vectors = term_vectors(docs)
    for block in range(blocks):
        rows = queries.where(F.col("draw") % blocks == block).select("query_id", "terms.term", "terms.idf").toArrow().combine_chunks()
        ids, lists, idfs = (rows.column(c).combine_chunks() for c in range(3))
        lists, idfs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lists, idfs))
        coded = lists.flatten().dictionary_encode()
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        known, place = np.unique(hashes, return_inverse=True)
        index = place[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int32)
        idf = np.zeros(len(known))
        idf[index] = idfs.flatten().to_numpy(zero_copy_only=False)
        each = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = [np.sort(q) for q in np.split(index, np.cumsum(each)[:-1])] if len(each) else []
        column, centres = alike(of, len(known))
        own = label(of, column, centres)
        order = np.lexsort((each, own))
        index = np.concatenate([of[q] for q in order]) if len(order) else index
        bounds = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(centres)))]).tolist()
        names = ids.take(pa.array(order)).to_pylist()
        sent = spark.sparkContext.broadcast((names, index, np.cumsum(each[order]), known, idf, column, centres, bounds))
        del rows, lists, idfs, coded, of, names

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, index, ends, known, idf, column, centres, bounds = sent.value
            asked = Asked(np.split(index, ends[:-1]) if len(ends) else [], len(known), bounds)
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            # documents by group, until there are enough of one: (id, length, terms, counts)
            held: list[list[tuple]] = [[] for _ in centres]
            size = [0] * len(held)

            def settle(group):
                rows = sorted(held[group], key=lambda x: -x[1])  # blocks of like lengths
                held[group], size[group] = [], 0
                ids, lengths, term, counts = zip(*rows, strict=True)
                of = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in term])
                shard = Shard(list(ids), list(lengths), np.concatenate(term), of, idf, mean, np.concatenate(counts))
                floors = np.array([b[-1][0] if len(b) == k else 0.0 for b in best])
                for q, (places, scores) in enumerate(shard.search(asked, k, floors, group)):
                    if len(places):
                        new = [(s, ids[p]) for s, p in zip(scores.tolist(), places.tolist(), strict=True)]
                        best[q] = sorted([*best[q], *new], key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]

            id_type = None
            for whole in batches:
                id_type = whole.schema.field(0).type
                for at in range(0, whole.num_rows if len(known) else 0, SLAB):
                    ids, lengths, hashes, counts = (x.to_pylist() for x in whole.slice(at, SLAB).columns)
                    value, count = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(counts), np.int32)
                    term = np.minimum(np.searchsorted(known, value), len(known) - 1).astype(np.int32)
                    hit = known[term] == value
                    ends_ = np.cumsum([len(h) // 8 for h in hashes])
                    cuts = np.concatenate([[0], np.cumsum(hit)])[ends_]
                    terms_, counts_ = (np.split(x[hit], cuts[:-1]) for x in (term, count))
                    for group, *row in zip(label(terms_, column, centres).tolist(), ids, lengths, terms_, counts_, strict=True):
                        if not len(row[2]):  # none of the queries' terms
                            continue
                        held[group].append(tuple(row))
                        size[group] += len(row[2])
                        if len(held[group]) >= SHARD_DOCS or size[group] >= SHARD_TERMS:
                            settle(group)
                    while sum(size) > 3 * SHARD_TERMS // 2:
                        settle(int(np.argmax(size)))
            for group in range(len(held)):
                if held[group]:
                    settle(group)
            flat = [(names[q], i, s) for q, b in enumerate(best) for s, i in b]
            for at in range(0, len(flat), 50_000):
                q, i, s = zip(*flat[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "doc_id": pa.array(i, id_type), "score": pa.array(s, pa.float64())})

        # whole files, in about as many parts of one size as there are cores
        with setting(spark, "spark.sql.files.maxPartitionBytes", 1 << 40):
            one = materialize(vectors.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, f"query_id {query_kind}, doc_id {kind}, score double"))
        found = one if found is None else found.unionByName(one)
    discard(vectors)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_like(docs: DataFrame, asking: DataFrame, k: int = 10, most: int | None = 25, least_df: int = 2) -> DataFrame:
    """The documents most like each document of `asking`, by its characteristic terms (see there; with most=None and
    least_df=1 by all its terms): the statistics and the candidates are all of `docs`. A document is its own best hit as
    a rule."""
    n, mean, df = corpus_statistics(docs)
    return search(docs, characteristic_terms(asking, n, df, most, least_df), n, mean or 1.0, k)
