"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several points of the ring. A document starts at the shard of the next point clockwise from its id's
place; if that shard is full, it goes on clockwise to the next shard with room. Documents between two points take the
same way, so which of them overflow is settled by counts: the arcs fill the shards in a fixed order, and each arc's
documents, in order of their place, are cut into runs, one for each shard they go to.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RING = 1 << 62


def ring(shards: int, points: int, seed: int) -> list[tuple[int, int]]:
    """The points of the ring in order: (place, shard). A shard's points don't depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{k}", seed) % RING, s) for s in range(shards) for k in range(points))


def fill(counts: dict[int, int], owners: list[tuple[int, int]], room: list[int], seed: int) -> list[tuple[int, int, int, int]]:
    """Where each arc's documents go: (arc, first rank, shard, first slot). Arcs take their turn by a hash of their
    number's point, so adding a shard leaves the order of the others."""
    left, used, out = list(room), [0] * len(room), []
    turn = sorted(counts, key=lambda a: xxhash.xxh64_intdigest(str(owners[a][0]), seed + 1))
    own = {a: min(counts[a], 0) for a in turn}
    # first each arc's own shard, then the overflow
    waiting = []
    for arc in turn:
        shard = owners[arc][1]
        own[arc] = min(counts[arc], left[shard])
        if own[arc]:
            out.append((arc, 0, shard, used[shard]))
            left[shard] -= own[arc]
            used[shard] += own[arc]
        if counts[arc] > own[arc]:
            waiting.append(arc)
    for arc in waiting:
        rank, at = own[arc], arc
        while rank < counts[arc]:
            at = (at + 1) % len(owners)
            shard = owners[at][1]
            n = min(counts[arc] - rank, left[shard])
            if n:
                out.append((arc, rank, shard, used[shard]))
                left[shard] -= n
                used[shard] += n
                rank += n
    return out


def shard_documents(docs: DataFrame, shards: int = 40, points: int = 128, slack: float = 0.0, seed: int = 7) -> DataFrame:
    """Put documents into `shards` shards: doc_id, size, text_crc32, shard, slot.

    No shard holds more than (1 + slack) of its even share of rows; with slack 0 the counts are at most one apart. size
    is the text's UTF-8 bytes (null: none) plus 16, text_crc32 null for a null text. slot counts from 0 without gaps
    within a shard. Rows stay one for one; documents with one id (repeats, nulls) start at one place and overflow like
    others, ordered by checksum and size. An empty table gives no rows; other columns aren't returned.

    Only counts by arc, of which there are shards * points whatever the data, go to the driver and back.
    """
    text = F.col("text")
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(RING))
    owners = ring(shards, points, seed)
    places = [p for p, _ in owners]
    # the arcs are many and near even: an estimate by the top bits, then the exact one among few neighbours, needs no join
    bits = 12
    first = [bisect_left(places, b << (62 - bits)) for b in range((1 << bits) + 1)]
    deepest = max(b - a for a, b in zip(first, first[1:], strict=False))
    starts, sorted_places = F.lit(first), F.lit(places)
    cell = F.shiftright(place, 62 - bits).cast("int")
    base = F.get(starts, cell)
    within = F.size(F.filter(F.slice(sorted_places, base + 1, F.lit(deepest + 1)), lambda p: p < place))
    arc = (base + within) % len(owners)
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"), arc.cast("int").alias("arc"))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    most, more = divmod(total, shards)
    room = [int((1 + slack) * most) + (s < more) for s in range(shards)] if slack == 0 else [-(-int((1 + slack) * total) // shards) + 1] * shards
    runs: list[list[tuple[int, int, int]]] = [[] for _ in owners]
    for a, rank, shard, slot in fill(counts, owners, room, seed):
        runs[a].append((rank, shard, slot))
    spark = docs.sparkSession
    table = spark.createDataFrame([(a, sorted(r)) for a, r in enumerate(runs) if r], "arc int, runs array<struct<first:long,shard:int,slot:long>>")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")).cast("long") - 1)
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    return ranked.join(F.broadcast(table), "arc").withColumn("run", run).select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot"))
