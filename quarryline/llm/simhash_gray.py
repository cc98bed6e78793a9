"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint is split into four parts of 16 bits: two that differ in 3 bits or fewer agree in one part at least. So
each fingerprint, turned until one part leads, goes to the four tasks of its leading parts. There the turned
fingerprints are sorted by Gray rank, in which neighbours share many bits; the bits that all members of a run share,
as a mask and a pattern, form its node, runs of nodes the nodes above. A search goes down from the nodes of its
leading part and drops a whole node once the differences that have accumulated on the masks pass the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_trie import in_blocks
from .common import CLEANUP, discard, materialize, setting, small_batches
from .components import connected_components

PARTS = 4
#: Members of a node of the index.
FAN = 8
#: Shingles whose bits are counted at once.
SHINGLES = 65_536
#: Pairs of a search and a node that are compared at once.
PAIRS = 1_000_000
#: Members of a group of equal leading bits that one task compares; larger groups are cut into blocks of about this size,
#: and each pair of blocks is a task.
BLOCK = 65_536


def shingles_of(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in blocks of at most SHINGLES; none if it has no word."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(words, len(tokens))
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    for k in range(0, len(last), SHINGLES):
        found = b"".join([digest(joined[a:b], 42) for a, b in zip(first[k : k + SHINGLES], last[k : k + SHINGLES], strict=True)])
        yield np.frombuffer(found, ">u8").astype(np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles_of(text, words)])).view(np.int64)


def fingerprint(text: str | None, words: int) -> bytes:
    """The fingerprint of a text, 64 bits; 0 if it has no word."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingles_of(text, words):
        n += len(hashes)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes() if n else bytes(8)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a long of the same 64 bits.

    A-Z are lower-cased, words are runs of other than ASCII white space, the shingles are joined by spaces and counted
    with repeats; a text of fewer words is one shingle. Null texts and those without words have 0. Rows stay one for one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 4_000_000):
                found = np.frombuffer(b"".join([fingerprint(t, words) for t in block.column(1).to_pylist()]), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def turned(fp: Column, part: int) -> Column:
    bits = 64 // PARTS * part
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def gray_rank(fp: Column) -> Column:
    """The place of a bit string in Gray order, as a long that sorts like the unsigned place."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def links(codes: np.ndarray, groups: np.ndarray, limit: int, pairs: list | None = None) -> np.ndarray:
    """The smallest place in `codes` that each place reaches within its group by steps of at most `limit` bits.

    codes are in Gray order within groups, a row of 64-bit words each; groups stand side by side. The pairs of places
    that join the trees, the closest first, are appended to `pairs` if it is given.
    """
    n = len(codes)
    root = np.arange(n)
    # nodes by level from the members up: pattern, mask, first child, child count, last member, group
    levels = [(codes, np.full_like(codes, ~np.uint64(0)), np.arange(n), np.ones(n, np.int64), np.arange(n), groups)]
    while True:
        pattern, mask, _, _, last, group = levels[-1]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        if len(levels) > 1 and sizes.max() == 1:
            break
        runs = -(-sizes // FAN)
        first = np.repeat(starts, runs) + FAN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        count = np.minimum(FAN, np.repeat(starts + sizes, runs) - first)
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        levels.append((ones, ones | zeros, first, count, last[first + count - 1], group[first]))
    top = levels[-1]
    node_of = np.searchsorted(top[5], groups)  # a group has one node on the top level
    # a group of one has no pairs
    busy = np.flatnonzero(top[4][node_of] > np.arange(n))
    for a in range(0, len(busy), 1024):
        query = busy[a : a + 1024]
        # nodes whose members are all of one tree have nothing to say to that tree
        flat = settled(root)
        tree = [flat]
        for _, _, first, _, _, _ in levels[1:]:
            low, high = np.minimum.reduceat(tree[-1], first), np.maximum.reduceat(tree[-1], first)
            tree.append(np.where(low == high, low, -1))
        node = node_of[query]
        frontier = [(len(levels) - 1, query, node, differing((codes[query] ^ top[0][node]) & top[1][node]))]
        while frontier:
            depth, query, node, off = frontier.pop()
            keep = (off <= limit) & (levels[depth][4][node] > query) & (tree[depth][node] != flat[query])
            query, node, off = query[keep], node[keep], off[keep]
            if not len(query):
                continue
            if not depth:
                hook(root, query, node, off, pairs)
                continue
            _, mask, first, count, _, _ = levels[depth]
            most = PAIRS // FAN // codes.shape[1]
            for b in range(0, len(query), most):
                q, x, d = query[b : b + most], node[b : b + most], off[b : b + most]
                times = count[x]
                child = np.repeat(first[x], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                more = levels[depth - 1][1][child] & ~np.repeat(mask[x], times, axis=0)
                q = np.repeat(q, times)
                d = np.repeat(d, times) + differing((codes[q] ^ levels[depth - 1][0][child]) & more)
                frontier.append((depth - 1, q, child, d))
    return settled(root)


def differing(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def settled(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(root, up := root[root]):
        root = up
    return root


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray | None = None, pairs: list | None = None) -> None:
    """Join the trees of the pairs' ends, in place, by each tree's closest pair first; a tree's root is its smallest
    place. The pairs that join trees are appended to `pairs`."""
    while True:
        flat = settled(root)
        root[:] = flat
        x, y = flat[a], flat[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if far is None:
            np.minimum.at(root, high, low)
            continue
        far = far[differ]
        order = np.lexsort((far, high))
        order = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        root[high[order]] = low[order]
        if pairs is not None:
            pairs.append((a[order], b[order]))


def near_fingerprints(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints (fp) that join just those that links of at most `limit` bits join.

    `limit` is at most 3. Each task holds the fingerprints of one leading part at a time; they are distinct, so copies
    of a text count once. Each group gives one edge for each member at most, not all pairs.
    """
    if limit >= PARTS:
        raise ValueError(f"limit must be below {PARTS}")
    parts = None
    for part in range(PARTS):
        one = distinct.select(F.lit(part).alias("part"), "fp", turned(F.col("fp"), part).alias("code"))
        parts = one if parts is None else parts.unionByName(one)
    lead = F.shiftrightunsigned("code", 64 - 64 // PARTS)
    dealt = in_block_pairs(parts.withColumn("grp", lead + F.col("part") * F.lit(1 << 16)), F.col("fp"), gray_rank(F.col("code"))).select("grp", "code", "fp")

    def edges(grp: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = links(code.view(np.uint64)[:, None], grp, limit) if len(grp) else np.arange(0)
        joined = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[root[joined]])], ["src", "dst"])

    return dealt.mapInArrow(lambda batches: whole_groups(batches, edges), "src long, dst long").distinct()


def in_block_pairs(members: DataFrame, name: Column, order: Column) -> DataFrame:
    """Members dealt to tasks by grp, in order within it. A grp of more than BLOCK members is cut into blocks by a hash of
    the member's name, and its members go to each pair of blocks theirs is in, so no task holds more than about two."""
    large = members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    if large.take(1):
        dealt = members.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(1), name), F.col("blocks")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # two groups of one hash would be compared as well, which adds no link
        pair = F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))
        members = dealt.withColumn("grp", F.when(F.col("blocks") > 1, pair).otherwise(F.col("grp").cast("long"))).select(*members.columns)
    return members.repartition("grp").sortWithinPartitions("grp", order)


def whole_groups(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Apply `make` to the columns of runs of whole groups (equal values of the first column, side by side)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        # the last group may go on in the next batch
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or not held or held[0][0][0] != columns[0][0]:
            held.append([c[:cut] for c in columns])
            yield make(*[np.concatenate(c) for c in zip(*held, strict=True)])
            held = [[c[cut:] for c in columns]]
        else:
            held.append(columns)
    if held:
        yield make(*[np.concatenate(c) for c in zip(*held, strict=True)])


def simhash_components(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """Each document's fingerprint and near-duplicate group: doc_id, fp, fingerprint (16 hex digits), component_id.

    Documents of one fingerprint, and of fingerprints that differ in at most `limit` bits, are linked; component_id is
    the smallest doc_id reachable (null if all ids of the group are null). Rows stay one for one, repeats included; an
    empty table gives no rows; other columns aren't returned.
    """
    marked = materialize(fingerprints(docs, words))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_fingerprints(distinct, limit))
    roots = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # one row for each distinct fingerprint; a fingerprint that many documents have is split by adaptive skew handling
    of = roots.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of 64 bits of a wide fingerprint, tables of its sampled bits, bits of a table's key, and the differing bits up to
#: which two texts are candidates: a pair of similarity 0.8 differs in 78 bits of 512 on average (of very short texts in up
#: to 100), with a deviation of 8 or 9. Beyond FAR bits a pair isn't one of 0.8 but for a chance of less than 1e-12.
WIDE, TABLES, KEY_BITS, NEAR, FAR = 8, 48, 16, 110, 170
#: Most of the frequent shingles that a task knows. They only order the shingles, which changes the time but no result.
FREQUENT = 200_000
#: Most texts whose numbers are sent to all tasks to pick them; more are joined.
PICKED = 1_000_000


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """A fingerprint of WIDE words of a set of shingle hashes: the first of the hashes themselves, further ones of the
    hashes mixed again."""
    hashes, out = shingles.view(np.uint64), []
    for _ in range(WIDE):
        ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)))
        hashes = (hashes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(29)
    return np.concatenate(out).view(">i8").astype(np.int64)


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, row: str | None = None, exact: bool = True) -> DataFrame:
    """Add component_id, the smallest doc_id of each document's group of near copies, to (doc_id, text).

    Texts are linked whose sets of shingles have a Jaccard similarity of `least` at the lowest; groups are what links
    join. Candidates come from wide SimHash fingerprints: two that agree in the sampled bits of a table meet there, the
    Gray-order index finds those within NEAR bits, and the closest pairs that join them are verified on the whole texts.
    No text is joined to one that it isn't linked with over verified links. Of the links at `least` this finds 0.97, of
    those at 0.9 nearly all.

    With `exact` what that misses is made up: of the shingles in one order, rare ones first, two texts of that similarity
    have one in common among the first n - ceil(least * n) + 1 of each, and the pairs of different groups that share such a
    one are verified, too, those of a large group of texts somewhat below `least` in blocks, without being written out.

    Texts of the same words count as one, so do null texts and those without words. Rows stay one for one. `row` names a
    column of distinct longs, if a table has one; other columns aren't returned.
    """
    spark = docs.sparkSession
    if row is None:
        docs, row = materialize(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())), "__row"
    rows = docs.select(F.col(row).alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [f"w{n}" for n in range(WIDE)]

    known = np.zeros((0, 2), np.int64)
    if exact:

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words))], ["h"])

        sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select("text").mapInArrow(explode, "h long")
        with setting(spark, CLEANUP, True):
            often = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
        known = np.array(sorted((r["h"], r["n"]) for r in often), np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast(known)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for block in in_blocks(batch.select(["row", "text", "doc_id"]), 1_000_000):
                keys, sizes, codes, firsts = [], [], [], []
                for t in block.column(1).to_pylist():
                    keys.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())))
                    found = shingle_set(t, words)
                    n = len(found)
                    sizes.append(n)
                    codes.append(wide_fingerprint(found) if n else np.zeros(WIDE, np.int64))
                    weight = np.zeros(n, np.int64)
                    if len(known) and n:
                        at = np.minimum(np.searchsorted(known[:, 0], found), len(known) - 1)
                        weight = np.where(known[at, 0] == found, known[at, 1], 0)
                    firsts.append(found[np.lexsort((found, weight))[: n - math.ceil(least * n - 1e-9) + 1]] if exact else found[:0])
                prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate(firsts)))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in np.array(codes).T], prefix], ["row", "doc_id", "key", "n", *names, "prefix"])

    made = ", ".join(f"{w} long" for w in names)
    with small_batches(spark, 2000):
        marked = materialize(rows.mapInArrow(mark, f"row long, doc_id {kind}, key binary, n long, {made}, prefix array<bigint>"))
    distinct = materialize(marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("uid"), *[F.first(c).alias(c) for c in ("n", *names, "prefix")]))
    wide, marked = marked, materialize(marked.select("doc_id", "key"))
    discard(wide)
    texts = rows.select(F.col("row").alias("uid"), "text")
    draw = np.random.default_rng(17)
    picks = [draw.choice(64 * WIDE, KEY_BITS, replace=False) for _ in range(TABLES // 4 if exact else TABLES)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                columns = [c.to_numpy() for c in part.columns]
                bits = np.unpackbits(np.column_stack(columns[1:]).astype(">i8").view(np.uint8).reshape(part.num_rows, -1), axis=1)
                for n, pick in enumerate(picks):
                    key = np.packbits(bits[:, pick], axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(n << KEY_BITS | key[:, 0] << 8 | key[:, 1], pa.int32()), *part.columns], ["grp", "uid", *names])

    dealt = distinct.where("n > 0").select("uid", *names).mapInArrow(deal, f"grp int, uid long, {made}")
    dealt = in_block_pairs(dealt, F.col("uid"), gray_rank(F.col("w0"))).select("grp", "uid", *names)

    def edges(grp: np.ndarray, uid: np.ndarray, *codes: np.ndarray) -> pa.RecordBatch:
        pairs, codes = [(np.zeros(0, np.int64),) * 2], np.column_stack(codes).view(np.uint64)
        if len(grp):
            links(codes, grp, NEAR, pairs)
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        far = differing(codes[a] ^ codes[b])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[a], uid[b])), pa.array(np.maximum(uid[a], uid[b])), pa.array(far)], ["src", "dst", "far"])

    near = materialize(dealt.mapInArrow(lambda batches: whole_groups(batches, edges), "src long, dst long, far long").distinct())
    # first the closest pair of each text; then, of the pairs that would join two parts, the closest of each two
    nearest = F.min_by("src", F.struct("far", "src")).alias("src")
    first = materialize(near.groupBy("dst").agg(nearest).select("src", "dst"))
    links_ = verified(first, texts, words, least)
    parts = connected_components(links_)
    ends = near.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src", "left").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst", "left")
    ends = ends.select("src", "dst", "far", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")).where("a <> b")
    second = ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by(F.struct("src", "dst"), F.struct("far", "src", "dst")).alias("pair")).select("pair.src", "pair.dst")
    second = materialize(second.join(first, ["src", "dst"], "left_anti"))
    links_ = links_.unionByName(verified(second, texts, words, least))
    parts = connected_components(links_)
    if exact:
        parts = _completed(distinct, names, links_, parts, first.unionByName(second), texts, words, least)
    roots = distinct.select("key", "least", "uid").join(parts, distinct.uid == parts.node, "left").select("key", "least", F.coalesce("component", "uid").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    out = materialize(marked.join(roots.join(smallest, "root").select("key", "component_id"), "key").select("doc_id", "component_id"))
    discard(marked, distinct, near, first, second)
    return out


#: Texts of a list of one shingle up to which their pairs are written out; the sets of longer lists' texts are compared where
#: they meet, in blocks of at most so many texts and shingles, but first their fingerprints, in blocks of more texts.
LISTED, CROWD, CROWD_SHINGLES, CROWD_CODES = 24, 1000, 1_000_000, 4096


def _completed(distinct: DataFrame, names: list[str], links_: DataFrame, parts: DataFrame, tried: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The components with the links between different ones of `parts` that a prefix filter finds.

    Of a list of few texts that share a shingle the pairs are written out and verified one by one. In a list of many, the
    texts' fingerprints meet, which tell the texts that none of the list can be linked with; of the others the whole sets
    meet, in one list for each two texts, and only links that join parts leave, so what is written grows with the list, not
    its square.
    """
    shared = distinct.where("n > 0").select("uid", "n", F.posexplode("prefix").alias("at", "h"))
    rooted = shared.join(parts, shared.uid == parts.node, "left").select("h", F.coalesce("component", "uid").alias("root"), "uid", "n", "at")

    def across(h: np.ndarray, root: np.ndarray, uid: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(h)]
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts) if len(h) else starts > 0
        for a, b in zip(starts[several], ends[several], strict=True):
            if b - a > LISTED:
                yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(uid[a:b]), pa.array(root[a:b]), pa.array(n[a:b]), pa.array(at[a:b].astype(np.int64))], ["grp", "uid", "root", "n", "at"])
                continue
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            # what may be shared from the common shingle on and before it must suffice
            most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
            keep = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (most >= least * (n[i] + n[j] - most) - 1e-9)
            if keep.any():
                i, j = i[keep], j[keep]
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(uid[i], uid[j])), pa.array(np.maximum(uid[i], uid[j])), none, none], ["grp", "uid", "root", "n", "at"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, across):
            yield from found

    met = materialize(rooted.repartition("h").sortWithinPartitions("h", "uid").mapInArrow(rest, "grp long, uid long, root long, n long, at long"))
    # a pair that has been looked at isn't linked, or it would be in one part; most others have a passage in common only,
    # which their fingerprints tell
    pairs = met.where("grp IS NULL").select(F.col("uid").alias("src"), F.col("root").alias("dst")).distinct().join(tried, ["src", "dst"], "left_anti")
    a, b = (distinct.select(F.col("uid").alias(end), F.array(*names).alias(f)) for end, f in (("src", "a"), ("dst", "b")))
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    pairs = materialize(pairs.join(a, "src").join(b, "dst").where(bits <= FAR).select("src", "dst"))
    crowds = _crowds(met.where("grp IS NOT NULL"), distinct.select("uid", *names), names, least)
    found = links_.unionByName(verified(pairs, texts, words, least)).unionByName(_crowd_links(crowds, texts, words, least))
    out = connected_components(found)
    discard(met, pairs, crowds)
    return out


def in_crowd_blocks(members: DataFrame, load: Column) -> DataFrame:
    """Members (grp, uid, ...) whose loads in a grp sum up to more than 1 cut into blocks by a hash: each member is dealt to
    each pair of blocks that its own is in, of which the new grp is the name."""
    blocks = members.groupBy("grp").agg(F.ceil(F.sum(load)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("pair", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def _crowds(members: DataFrame, codes: DataFrame, names: list[str], least: float) -> DataFrame:
    """The members (grp, uid, root, n; at: the place of the list's shingle) that may be linked with one of another root in
    their grp, as sizes, places and fingerprints go, and that share no grp of a smaller number with that one: each pair is
    compared once, in however many lists it is, so a text's set goes to few of its lists."""

    def keep(pair: np.ndarray, grp: np.ndarray, uid: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        words, live = [w.view(np.uint64) for w in rest[:WIDE]], np.zeros(len(pair), bool)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
        for a, b in zip(starts, [*starts[1:], len(pair)], strict=False):  # in order of n
            others = memberships(rest[WIDE][a:b]) if len(rest) > WIDE else []
            for x in range(a, b, 256):
                y = min(b, x + 256)
                end = a + int(np.searchsorted(n[a:b], n[y - 1] / least + 1e-6, "right"))
                one, other = (slice(x, y), None), slice(x, end)
                most = np.minimum(at[one], at[other]) + np.minimum(n[one] - at[one], n[other] - at[other])
                may = (root[one] != root[other]) & (n[one] >= least * n[other] - 1e-9) & (most >= least * (n[one] + n[other] - most) - 1e-9)
                for has in others:
                    may &= has[x - a : y - a] @ has[x - a : end - a].T == 0
                i, j = np.nonzero(may)
                i, j = i + x, j + x
                for k in range(0, len(i), PAIRS):
                    p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                    off = sum(np.bitwise_count(w[p] ^ w[q]).astype(np.int16) for w in words)
                    live[p[off <= FAR]] = live[q[off <= FAR]] = True
        return pa.RecordBatch.from_arrays([pa.array(x[live]) for x in (grp, uid, root, n, at)], ["grp", "uid", "root", "n", "at"])

    def kept(members: DataFrame, most: int, *more: str) -> DataFrame:
        dealt = in_crowd_blocks(members, F.lit(1.0) / most).join(codes, "uid").select("pair", "grp", "uid", "root", "n", "at", *names, *more)
        met = dealt.repartition("pair").sortWithinPartitions("pair", "n")
        return materialize(met.mapInArrow(lambda batches: whole_groups(batches, keep), "grp long, uid long, root long, n long, at long").distinct())

    first = kept(members, CROWD_CODES)
    lists = first.groupBy("uid").agg(F.array_sort(F.collect_list("grp")).alias("lists"))
    lower = first.join(lists, "uid").withColumn("lower", F.filter("lists", lambda x: x < F.col("grp"))).drop("lists")
    with small_batches(members.sparkSession, 2000):
        found = kept(lower, CROWD, "lower")
    discard(first)
    return found


def memberships(lists: np.ndarray) -> list[np.ndarray]:
    """0/1 matrices, of a bounded number of columns each: which of the numbers that several lists have each list has."""
    _, of, times = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True, return_counts=True)
    who, place = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.cumsum(times > 1) - 1
    who, of = who[times[of] > 1], place[of[times[of] > 1]]
    out = []
    for k in range(0, int((times > 1).sum()), 1024):
        some = (of >= k) & (of < k + 1024)
        has = np.zeros((len(lists), 1024), np.float32)
        has[who[some], of[some] - k] = 1
        out.append(has)
    return out


def _crowd_links(members: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (src, dst) that join what links between texts of one grp join, of members (grp, uid, root, n: number of
    shingles); texts of one root are joined already. A grp of more than CROWD texts or CROWD_SHINGLES shingles is cut into
    blocks by a hash, and each pair of blocks is compared in one place."""
    load = F.greatest(F.lit(1.0) / CROWD, F.col("n") / CROWD_SHINGLES)
    dealt = in_crowd_blocks(members, load).select(F.col("pair").alias("grp"), "uid", "root")
    sets = shingle_sets(texts, materialize(members.select("uid").distinct()), words)

    def compare(grp: np.ndarray, uid: np.ndarray, root: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        pairs = [(np.zeros(0, np.int64),) * 2]
        starts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.zeros(0, np.int64)
        for a, b in zip(starts, [*starts[1:], len(grp)], strict=False):  # no group in an empty part
            i, j = alike([np.frombuffer(x, np.int64) for x in sets[a:b]], least)
            part = np.unique(root[a:b], return_inverse=True)[1]
            tree = np.arange(part.max() + 1)
            joins: list[tuple[np.ndarray, np.ndarray]] = []
            x, y = part[i], part[j]
            # one link for each two parts, and of these a tree
            _, one = np.unique(np.minimum(x, y) * len(tree) + np.maximum(x, y), return_index=True)
            one = one[x[one] != y[one]]
            for p in one.tolist():
                u, v = x[p], y[p]
                while tree[u] != u:
                    tree[u] = tree[tree[u]]
                    u = tree[u]
                while tree[v] != v:
                    tree[v] = tree[tree[v]]
                    v = tree[v]
                if u != v:
                    tree[max(u, v)] = min(u, v)
                    joins.append((uid[a + i[p : p + 1]], uid[a + j[p : p + 1]]))
            pairs += joins
        src, dst = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], ["src", "dst"])

    with small_batches(members.sparkSession):  # a row holds a whole text's set
        met = dealt.join(sets, "uid").select("grp", "uid", "root", F.col("h").alias("shingles"))
        found = materialize(met.repartition("grp").sortWithinPartitions("grp", "uid").mapInArrow(lambda batches: whole_groups(batches, compare), "src long, dst long"))
    discard(sets)
    return found


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of sets whose similarity is `least` or more, counted by products of 0/1 matrices of a
    bounded number of shingles at a time."""
    sizes = np.array([len(x) for x in sets], np.int64)
    shingle, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), sizes)
    # a shingle that one set has is in no intersection
    place = np.cumsum(times > 1) - 1
    who, of = who[times[of] > 1], place[of[times[of] > 1]]
    order = np.argsort(of, kind="stable")
    who, of = who[order], of[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # counts are below 2 ** 24
    for k in range(0, int((times > 1).sum()), 1024):
        a, b = np.searchsorted(of, (k, k + 1024))
        has = np.zeros((len(sets), 1024), np.float32)
        has[who[a:b], of[a:b] - k] = 1
        both += has @ has.T
    i, j = np.triu_indices(len(sets), 1)
    n = both[i, j].astype(np.int64)
    keep = n >= least * (sizes[i] + sizes[j] - n) - 1e-9
    return i[keep], j[keep]


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (src, dst) of uids whose texts' sets of shingles are alike by `least` or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for t, u in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(u.as_buffer(), np.uint64)  # sorted as such
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    named = materialize(pairs.select(F.col("src").alias("uid")).unionByName(pairs.select(F.col("dst").alias("uid"))).distinct())
    sets = shingle_sets(texts, named, words)
    a, b = sets.select(F.col("uid").alias("src"), F.col("h").alias("a")), sets.select(F.col("uid").alias("dst"), F.col("h").alias("b"))
    with small_batches(pairs.sparkSession):  # a row holds two whole texts' sets
        found = materialize(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(check, "src long, dst long"))
    discard(sets)
    return found


def shingle_sets(texts: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(uid, h): the sets of the texts that the table `named` names, written; `named` is discarded."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, 1_000_000):
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([shingle_set(t, words).tobytes() for t in block.column(1).to_pylist()], pa.binary())], ["uid", "h"])

    few = named.count() <= PICKED
    with small_batches(texts.sparkSession, 500):
        sets = materialize(texts.join(F.broadcast(named) if few else named, "uid", "left_semi").mapInArrow(shingled, "uid long, h binary"))
    discard(named)
    return sets
