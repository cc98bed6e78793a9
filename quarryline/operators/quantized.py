"""An index of vectors by coarse cells and product quantisation (IVF-PQ), searched approximately or exactly.

The space is cut into cells around centroids; what is left of a vector beside its centroid is cut into parts, each of which
is told by the number of the nearest entry in that part's codebook. The index is a table of cells and codes, a few bytes a
vector. A search multiplies queries with what the codes of a block of rows stand for, and measures only the best of each
block by their vectors. The exact search passes over the cells whose radius, which the index tells, keeps them out of
reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from .graph import written

#: Rows that are searched together.
BLOCK = 16_384
#: Queries that a task has at most, about, and how many of them are measured at once.
ASKED = 4_096
CHUNK = 256


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of rows; one that loses its rows starts anew at the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = distances(x, centres)
        home = far.argmin(axis=1)
        count = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        worst = iter(np.argsort(-far[np.arange(len(x)), home]))
        for c in np.flatnonzero(count == 0):
            sums[c], count[c] = x[next(worst)], 1
        centres = sums / count[:, None]
    return centres


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as rows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1))


@dataclass
class Quantizer:
    centres: np.ndarray
    #: For each part its entries.
    books: list[np.ndarray]

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum([0, *[b.shape[1] for b in self.books]])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, codes, and distance from what these stand for."""
        home = distances(x, self.centres).argmin(axis=1)
        rest = x - self.centres[home]
        codes = np.stack([distances(rest[:, a:b], book).argmin(axis=1) for a, b, book in zip(self.ends, self.ends[1:], self.books, strict=False)], axis=1).astype(np.uint8)
        gone = rest - np.hstack([book[codes[:, n]] for n, book in enumerate(self.books)])
        return home, codes, np.sqrt((gone * gone).sum(axis=1))

    def stood_for(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.centres[cells] + np.hstack([book[codes[:, n]] for n, book in enumerate(self.books)])


def fitted(vectors: DataFrame, parts: int = 8, cells: int | None = None, entries: int = 256, sample_rows: int = 20_000, seed: int = 1) -> Quantizer | None:
    """Cells and codebooks from at most `sample_rows` vectors, picked by a hash of themselves; None if there are none. There are
    about the square root of the table's rows of cells, 4,096 at most, unless `cells` says how many."""
    rows = whole(vectors)
    drawn = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()
    if not drawn:
        return None
    x = np.array([r["v"] for r in drawn])
    centres = k_means(x, cells or int(min(4096, max(1, rows.count() ** 0.5))), 10, seed)
    rest = x - centres[distances(x, centres).argmin(axis=1)]
    cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
    return Quantizer(centres, [k_means(rest[:, c], min(entries, 256), 10, seed + n) for n, c in enumerate(cuts)])


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors without nulls, of the length that most of them have (the smaller of two as frequent)."""
    rows = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0)).select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    wide = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()  # one row
    return rows.where(F.size("v") == (wide["d"] if wide else 0))


def index(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """The index of all usable vectors, as a written table: cell, vec_id, codes, off (the distance from the codes) and far (that
    from the cell's centroid)."""
    held = vectors.sparkSession.sparkContext.broadcast(quantizer)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                x = np.array(part.column(1).to_pylist(), np.float64)
                home, codes, off = held.value.coded(x)
                far = np.sqrt(((x - held.value.centres[home]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(far)], ["cell", "vec_id", "codes", "off", "far"])

    return written(whole(vectors).mapInArrow(run, f"cell int, vec_id {kind}, codes binary, off double, far double"))


def search(vectors: DataFrame, coded: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int = 10, probes: int = 8, refine: int = 10, exact: bool = False) -> DataFrame:
    """The k vectors nearest to each query (query_id, embedding) by squared distance: query_id, rank, vec_id, distance.

    Cells are put together, in their order, to blocks of about BLOCK rows, and a larger one is cut. A task has a block and
    at most ASKED queries, whose `probes` nearest cells reach into it: the `refine` * k best of the block by their codes are
    measured by their vectors, and the k best of these leave the task. With `exact`, the k-th distance found so is a
    bound: then all rows of all cells that reach into it are measured, of which those within it, k a block at most, leave
    the task, so the result is that of measuring all. Ties go to the smaller vec_id. Queries that can't be used (see
    `whole`) have no rows; ids must differ.
    """
    spark = vectors.sparkSession
    asked = written(queries.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull()) & (F.size("embedding") == quantizer.centres.shape[1])).select("query_id", V.doubles(F.col("embedding")).alias("q")))
    names, ids = asked.schema["query_id"].dataType.simpleString(), coded.schema["vec_id"].dataType.simpleString()
    # a row for each cell
    cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()
    known, radius, first, cuts = [r["cell"] for r in cells], [r["radius"] for r in cells], [], []
    block = room = 0
    for r in cells:
        if room and room + r["n"] > BLOCK:
            block, room = block + 1, 0
        first.append(block)
        cuts.append(-(-r["n"] // BLOCK))
        block, room = (block + cuts[-1], 0) if cuts[-1] > 1 else (block, room + r["n"])
    held = spark.sparkContext.broadcast((quantizer, np.array(known, np.int64), np.array(radius), np.array(first, np.int64), np.array(cuts, np.int64)))
    places = spark.createDataFrame([(int(c), f, n) for c, f, n in zip(known, first, cuts, strict=True)], "cell int, first int, cuts int")
    parts = max(1, -(-asked.count() // ASKED))
    at = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).cast("int")
    dealt = coded.join(F.broadcast(places), "cell").join(whole(vectors), "vec_id").select("cell", "vec_id", "codes", "v", at.alias("block"))
    # each block once for each part of the queries; a number of tasks is named, as small rows are much work here
    tasks = min(2_000, parts * sum(cuts) + 1)
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def reached(q: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
        """Queries by cells: which are met."""
        quantizer_, cells_, radius_, *_ = held.value
        far = np.sqrt(distances(q, quantizer_.centres[cells_]))
        if bound is not None:
            return far - radius_ <= np.sqrt(bound)[:, None] * (1 + 1e-9) + 1e-9
        met = np.zeros(far.shape, bool)
        np.put_along_axis(met, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
        return met

    def spread(exactly: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, _, first_, cuts_ = held.value
            cell = np.repeat(np.arange(len(cuts_)), cuts_)
            # the blocks of the cells, which rise; where each block begins among them
            blocks = np.concatenate([np.arange(f, f + n) for f, n in zip(first_, cuts_, strict=True)] or [np.zeros(0, np.int64)])
            starts = np.unique(blocks, return_index=True)[1]
            for whole_batch in batches:
                for batch in (whole_batch.slice(n, CHUNK) for n in range(0, whole_batch.num_rows, CHUNK)):
                    met = reached(matrix(batch.column(1)), batch.column(2).to_numpy() if exactly else None)
                    who, block_ = np.nonzero(np.logical_or.reduceat(met[:, cell], starts, axis=1) if len(starts) else np.zeros((batch.num_rows, 0), bool))
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays([*(c.take(who) for c in batch.columns), pa.array(block_.astype(np.int32))], ["query_id", "q", "bound", "part", "block"])

        return run

    def among(exactly: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            quantizer_, cells_, *_ = held.value
            found = []
            if left.num_rows and right.num_rows:
                left = left.sort_by("vec_id")
                x = matrix(left["v"])
                home = np.searchsorted(cells_, left["cell"].to_numpy())
                rough = x if exactly else quantizer_.stood_for(left["cell"].to_numpy(), np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(x), -1))
                across = np.ascontiguousarray(x.T)
                every, bounds = matrix(right["q"]), right["bound"].to_numpy()
                for n in range(0, len(every), CHUNK):
                    q, bound = every[n : n + CHUNK], bounds[n : n + CHUNK]
                    far = distances(q, rough)
                    met = reached(q, bound if exactly else None)[:, home]
                    far[~met] = np.inf
                    # what is measured exactly: products and sums of these vectors differ in the last digits
                    slack = 1e-9 * (1 + (q * q).sum(axis=1) + (x * x).sum(axis=1).max())
                    most = k if exactly else refine * k
                    if far.shape[1] > most:
                        limit = np.partition(far, most - 1, axis=1)[:, most - 1] + slack
                    else:
                        limit = np.full(len(q), np.inf)
                    if exactly:
                        limit = np.minimum(limit, bound + slack)
                    who, row = np.nonzero(met & (far <= limit[:, None]))
                    true = np.zeros(len(who))
                    for d in range(x.shape[1]):  # summed up in the order of `squared_distance`
                        gap = across[d][row] - q[who, d]
                        true += gap * gap
                    order = np.lexsort((row, true, who))
                    who, row, true = who[order], row[order], true[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    best = place < k
                    found.append(pa.table([right["query_id"].take(pa.array(who[best] + n)), left["vec_id"].take(pa.array(row[best])), pa.array(true[best])], ["query_id", "vec_id", "distance"]))
            return pa.concat_tables(found) if found else pa.table([pa.array([], right.schema.field("query_id").type), pa.array([], left.schema.field("vec_id").type), pa.array([], pa.float64())], ["query_id", "vec_id", "distance"])

        return run

    def found(rows: DataFrame, exactly: bool) -> DataFrame:
        """The best of rows that are queries (query_id, q, bound)."""
        rows = rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        sent = rows.mapInArrow(spread(exactly), f"query_id {names}, q array<double>, bound double, part int, block int")
        pairs = dealt.repartition(tasks, "block", "part").groupBy("block", "part").cogroup(sent.repartition(tasks, "block", "part").groupBy("block", "part")).applyInArrow(among(exactly), f"query_id {names}, vec_id {ids}, distance double")
        return top(pairs, F.col("distance"), k)

    best = found(asked.select("query_id", "q", F.lit(float("inf")).alias("bound")), False)
    if exact:
        # a query with fewer than k rows so far isn't bounded
        kth = written(best).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("bound"))
        rows = asked.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        best = found(rows, True)
    return best.select("query_id", "rank", "vec_id", "distance")


def top(pairs: DataFrame, by: Column, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(by, "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)
