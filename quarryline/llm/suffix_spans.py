"""Removal of repeated byte strings by a hash-compared suffix sort.

Every window of WINDOW bytes has an anchor: the leftmost of its GRAM-byte strings with the smallest hash. Equal windows
have equal anchors at equal places, so only windows of one anchor string need comparing. First the anchor hashes of all
blocks of documents are exchanged, and each block learns which of its anchors occur in another document too. For those
alone the bytes around the anchor are exchanged. Where they differ, the suffixes that start at the windows are sorted by
mergesort: prefix polynomial hashes and binary search give the common extension of two suffixes, which decides their
order in a logarithmic number of steps. Neighbours that share a whole window are verified byte by byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_trie import in_blocks
from .common import materialize

WINDOW, GRAM = 50, 26
#: Bytes of text in a block of documents, and of those that are hashed at once.
BLOCK_BYTES, HASHED_BYTES = 8_000_000, 250_000
#: Anchors of a group in an exchange, on average; a quarter, if that makes no more than FEW groups. Each block sends a row to
#: each group, so the rows are fewer by the square as blocks and groups are larger.
GROUP, FEW = 1_000_000, 48
#: Anchors whose windows are sorted at once (those of one anchor string together).
SORTED = 16_384
#: Anchor strings of more places than this are hot: their windows are dealt by their own bytes, one by one.
HOT = 4_096
#: Bits of a hash by which anchors are first compared.
BITS = 48
_BASE = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
#: A null id counts as the largest there is.
_NO_ID = (1 << 63) - 1


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each as differences laid out byte by byte, compressed."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        deltas = np.diff(a.astype(np.int64, copy=False), prepend=np.int64(0))
        parts.append(deltas.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, n), 8 * n, []
    for size in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()))
        at += 8 * size
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The mixed polynomial hash of the `size` bytes at each place (of the last ones, of fewer)."""
    whole, held, step, have = None, 0, _BYTE[data], 1
    while True:
        if size & have:
            if whole is None:
                whole, held = step.copy(), have
            else:
                whole[: len(whole) - held] += step[held:] * np.uint64(pow(_BASE, held, 1 << 64))
                held += have
        if have * 2 > size:
            break
        longer = step.copy()
        longer[: len(step) - have] += step[have:] * np.uint64(pow(_BASE, have, 1 << 64))
        step, have = longer, have * 2
    return mixed(whole)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of documents laid side by side: hash, place, first and last window start."""
    starts = np.r_[0, ends[:-1]]
    cuts = [0]
    while cuts[-1] < len(ends):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + HASHED_BYTES, "right"))))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        base = starts[a]
        part = data[base : ends[b - 1]]
        if len(part) < WINDOW:
            continue
        hashes = gram_hashes(part, GRAM)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part), dtype=np.uint64)
        wide, have = WINDOW - GRAM + 1, 1
        while have < wide:
            step = min(have, wide - have)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            have += step
        # windows lie within a document
        room = np.zeros(len(part) + 1, np.int32)
        first, last = starts[a:b] - base, ends[a:b] - base - WINDOW + 1
        some = last > first
        np.add.at(room, first[some], 1)
        np.add.at(room, last[some], -1)
        window = np.flatnonzero(np.cumsum(room[:-1]))
        if not len(window):
            continue
        anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
        at = anchor[turn]
        out.append((hashes[at], at + base, window[turn] + base, window[np.r_[turn[1:], len(window)] - 1] + base))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def short(hashes: np.ndarray) -> np.ndarray:
    """BITS of hashes mixed once more: an anchor has the smallest hash of its window, so anchors' own hashes are uneven."""
    return (mixed(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def group_of(values: np.ndarray, groups: int) -> np.ndarray:
    return ((values >> (BITS - 24)) * groups) >> 24


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, ends and ids of a block's documents, without those that are copies of another."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
    ends, ids, _ = unpacked(row["docs"], 3)
    copies = row.get("copies")
    if copies:
        stays = np.ones(len(ids), bool)
        stays[copies] = False
        sizes = np.diff(np.r_[0, ends])
        data, ids, ends = data[np.repeat(stays, sizes)], ids[stays], np.cumsum(sizes[stays])
    return data, ends, ids


def groups_of(n_blocks: int) -> int:
    """The number of groups that the anchors of so many blocks are dealt to."""
    n = n_blocks * BLOCK_BYTES // 12
    return max(1, -(-n // GROUP), min(FEW, -(-4 * n // GROUP)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def blocks(docs: DataFrame, name: str) -> DataFrame:
    """Documents in blocks of about BLOCK_BYTES: (block, docs, texts), both packed. They are kept as a table `name` bucketed
    by block, as many buckets as shuffles have partitions, so that what is learned of a block later joins it where it lies."""
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_blocks(batch, BLOCK_BYTES):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                given = part.column(0).to_pylist()
                ids = np.array([_NO_ID if i is None else i for i in given], np.int64)
                ends = np.cumsum([len(t) for t in texts])
                yield pa.RecordBatch.from_pydict({"docs": [packed(ends, ids, np.array([i is not None for i in given]))], "texts": [zstandard.ZstdCompressor(level=6).compress(b"".join(texts))]})

    packed_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "docs binary, texts binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed_docs.withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block").write.bucketBy(buckets, "block").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def copies(packed_docs: DataFrame) -> DataFrame:
    """(block, copies): the places in each block of documents that a document with a smaller id equals as a whole. They
    take no part in the search, for it has the other; all of their bytes go if they hold a window."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, ends, ids = opened(row)
            raw, starts = data.tobytes(), np.r_[0, ends[:-1]].tolist()
            names = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(starts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]] * len(ids), pa.int64()), "place": pa.array(range(len(ids)), pa.int32()), "id": pa.array(ids), "digest": pa.array(names, pa.binary())})

    named = materialize(packed_docs.mapInArrow(digests, "block long, place int, id long, digest binary"))
    first = named.groupBy("digest").agg(F.min("id").alias("first"))
    return named.join(first, "digest").where("id > first").groupBy("block").agg(F.collect_list("place").alias("copies"))


def owners(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, places, "right")


def shared_anchors(packed_docs: DataFrame, groups: int) -> DataFrame:
    """(block, grp, mask): as bits, which of the block's distinct anchor hashes of a group, in order, other documents have
    too, and then which of them are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, ends, _ = opened(row)
            hashes, place, _, _ = anchors(data, ends)
            if not len(hashes):  # no document of the block has a window
                continue
            value, doc = short(hashes), owners(place, ends)
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            last = np.r_[first[1:], len(value)]
            twice, times = doc[last - 1] != doc[first], last - first
            value = value[first]
            grp = group_of(value, groups)
            cut = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            out = [(int(grp[a]), row["block"], packed(value[a:b], twice[a:b], times[a:b])) for a, b in zip(cut, np.r_[cut[1:], len(grp)], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["grp", "block", "sent"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(b, 3) for b in group["sent"]]
        value, twice, times = (np.concatenate([g[k] for g in got]) for k in range(3))
        distinct, place, count = np.unique(value, return_inverse=True, return_counts=True)
        shared = ((count > 1) | (np.bincount(place, twice, len(distinct)) > 0))[place]
        hot = (np.bincount(place, times, len(distinct)) > HOT)[place] & shared
        ends = np.cumsum([len(g[0]) for g in got])
        masks = [np.packbits(shared[e - len(g[0]) : e]).tobytes() + np.packbits(hot[e - len(g[0]) : e]).tobytes() for g, e in zip(got, ends, strict=True)]
        return pd.DataFrame({"block": group["block"], "grp": group["grp"], "mask": masks})

    sent = packed_docs.mapInArrow(send, "grp int, block long, sent binary")
    return sent.groupBy("grp").applyInPandas(meet, "block long, grp int, mask binary")


def contexts(packed_docs: DataFrame, masks: DataFrame, groups: int) -> DataFrame:
    """(grp, block, anchors, bytes): the surroundings of each block's shared anchors; of equal ones in a block the one in
    the smallest document. What a block can tell by itself comes as (grp, block, local): those of its larger documents."""
    told = masks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("grp", "mask"))).alias("masks"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, ends, ids = opened(row)
            hashes, place, low, high = anchors(data, ends)
            value = short(hashes)
            distinct, where = np.unique(value, return_inverse=True)
            grp = group_of(distinct, groups)
            shared, hot = [], []
            for m in row["masks"]:
                n = int(np.searchsorted(grp, m["grp"], "right") - np.searchsorted(grp, m["grp"]))
                bits = np.frombuffer(m["mask"], np.uint8)
                shared.append(np.unpackbits(bits[: len(bits) // 2], count=n))
                hot.append(np.unpackbits(bits[len(bits) // 2 :], count=n))
            use = np.flatnonzero(np.concatenate(shared)[where])
            hashes, place, low, high, value, hot = hashes[use], place[use], low[use], high[use], value[use], np.concatenate(hot)[where[use]] == 1
            # a hot anchor's windows stand for themselves: each goes where its own bytes say, so no group has them all
            times = np.where(hot, high - low + 1, 1)
            of = np.repeat(np.arange(len(low)), times)
            step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            hashes, place, value, hot, low, high = hashes[of], place[of], value[of], hot[of], low[of] + step, np.where(hot[of], low[of] + step, high[of])
            doc = ids[owners(place, ends)]
            length = high - low + WINDOW
            # equal surroundings of the block: the first by document stands for all
            text = text_hashes(data, low, length)
            value = np.where(hot, short(text), value)
            order = np.lexsort((low, doc, place - low, length, text, hashes))
            same = np.zeros(len(order), bool)
            if len(order) > 1:
                x, y = order[:-1], order[1:]
                same[1:] = (hashes[x] == hashes[y]) & (text[x] == text[y]) & (length[x] == length[y]) & (place[x] - low[x] == place[y] - low[y])
                for k in np.flatnonzero(same):  # verified, as hashes can collide
                    a, b = order[k - 1], order[k]
                    same[k] = data[low[a] : low[a] + length[a]].tobytes() == data[low[b] : low[b] + length[b]].tobytes()
            group = np.cumsum(~same) - 1
            lead = order[np.flatnonzero(~same)]
            later = doc[order] > doc[lead[group]] if len(order) else np.zeros(0, bool)
            followers = order[same & ~later]  # of the smallest document itself: they share the leader's fate
            fate = group[same & ~later]
            local = order[later]
            sent_grp = group_of(value[lead], groups)
            by = np.argsort(sent_grp, kind="stable")
            leader_place = np.empty(len(lead), np.int64)
            to, starts = np.unique(sent_grp[by], return_index=True)
            its = np.argsort(sent_grp[fate], kind="stable")
            mine_at = np.searchsorted(sent_grp[fate][its], np.r_[to, groups])
            out = []
            for k, (g, a, b) in enumerate(zip(to.tolist(), starts, np.r_[starts, len(by)][1:], strict=True)):
                part, mine = by[a:b], its[mine_at[k] : mine_at[k + 1]]
                i = lead[part]
                leader_place[part] = np.arange(len(part))
                size = length[i]
                flat = np.repeat(low[i] - np.cumsum(size) + size, size) + np.arange(size.sum())
                table = packed(hashes[i].view(np.int64), doc[i], low[i], place[i] - low[i], size - WINDOW + 1, low[followers[mine]], leader_place[fate[mine]])
                out.append((g, row["block"], table, zstandard.ZstdCompressor(level=3).compress(data[flat].tobytes()), None))
            if len(local):
                out.append((int(row["block"] % groups), row["block"], None, None, packed(low[local], (np.int64(1) << (high[local] - low[local] + 1)) - 1)))
            for k in range(0, len(out), 64):
                columns = zip(*out[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["grp", "block", "anchors", "bytes", "local"])

    joined = packed_docs.join(told, "block").select("block", "docs", "texts", "copies", "masks")
    return joined.mapInArrow(send, "grp int, block long, anchors binary, bytes binary, local binary")


POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(2 * WINDOW)], np.uint64)


def text_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The polynomial hash of each stretch of bytes."""
    out = np.zeros(len(start), np.uint64)
    along = np.arange(2 * WINDOW - GRAM)
    for k in range(0, len(start), 8192):
        at = start[k : k + 8192, None] + along
        inside = along < length[k : k + 8192, None]
        values = _BYTE[data[np.minimum(at, len(data) - 1)]] * POWERS[: len(along)]
        out[k : k + 8192] = np.where(inside, values, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return out


class Suffixes:
    """Suffixes of texts (rows of a matrix of bytes), compared by prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, row: np.ndarray, start: np.ndarray):
        n, wide = text.shape
        self.text, self.row, self.start = text, row, start
        self.sums = np.zeros((n, wide + 1), np.uint64)
        np.cumsum(_BYTE[text] * POWERS[:wide], axis=1, dtype=np.uint64, out=self.sums[:, 1:])
        self.up = POWERS

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of suffixes x and y, up to a window, by binary search over prefix hashes."""
        rx, ry, sx, sy = self.row[x], self.row[y], self.start[x], self.start[y]
        ax, ay = self.sums[rx, sx], self.sums[ry, sy]
        px, py = self.up[sx], self.up[sy]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), WINDOW)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            equal = (self.sums[rx, sx + middle] - ax) * py == (self.sums[ry, sy + middle] - ay) * px
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; where windows are equal, `ties` says."""
        n = self.common(x, y)
        at = np.minimum(n, WINDOW - 1)
        return np.where(n == WINDOW, ties, self.text[self.row[x], self.start[x] + at] < self.text[self.row[y], self.start[y] + at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes within their groups (ascending numbers): a mergesort of all groups side by side, in
        which each suffix finds its place in the sister run by binary search."""
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        order, width = np.arange(len(group)), 1
        while len(size) and width < size.max():
            live = np.flatnonzero(size > width)
            rank = live - first[live]
            run = rank // width
            left = run % 2 == 0
            sister = first[live] + np.where(left, run + 1, run - 1) * width
            end = first[live] + size[live]
            low = np.minimum(sister, end)
            high = np.minimum(sister + width, end)
            begin = low.copy()
            me = order[live]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                # the sister's element comes before mine: equal ones of the left run go first
                goes = self.before(order[middle], me[open_], ~left[open_])
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
            to = first[live] + run // 2 * 2 * width + rank % width + (low - begin)
            merged = order.copy()
            merged[to] = me
            order, width = merged, width * 2
        return order


def repeated(hashes: np.ndarray, doc: np.ndarray, offset: np.ndarray, windows: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """For each anchor, as bits, which of its windows an anchor of a smaller document has too. Anchors are taken some
    whole kinds (equal hashes) at a time, so what is laid out stays small."""
    size = windows + WINDOW - 1
    at = np.cumsum(size) - size
    order = np.argsort(hashes, kind="stable")
    kinds = hashes[order]
    masks = np.zeros(len(hashes), np.int64)
    begin = 0
    while begin < len(order):
        end = min(len(order), begin + SORTED)
        end = int(np.searchsorted(kinds, kinds[end - 1], "right"))  # a kind stays together
        rows = order[begin:end]
        masks[rows] = repeated_of_kinds(hashes[rows], doc[rows], offset[rows], windows[rows], laid_out(flat, at[rows], size[rows]))
        begin = end
    return masks


def laid_out(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of bytes as the rows of a matrix, filled up with zeros."""
    text = np.zeros((len(at), 2 * WINDOW - GRAM), np.uint8)
    for k in range(0, len(at), 8192):  # an index of all bytes at once would take many times their room
        some = size[k : k + 8192]
        row = np.repeat(np.arange(len(some)), some)
        along = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        text[row + k, along] = flat[np.repeat(at[k : k + 8192], some) + along]
    return text


def repeated_of_kinds(hashes: np.ndarray, doc: np.ndarray, offset: np.ndarray, windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    n, wide = text.shape
    _, kind = np.unique(hashes, return_inverse=True)
    # equal surroundings of one kind are one, with its smallest document; equality is of bytes, as hashes can collide
    content = np.empty(n, np.uint64)
    for k in range(0, n, 8192):
        content[k : k + 8192] = (_BYTE[text[k : k + 8192]] * POWERS[:wide]).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((doc, windows, offset, content, kind))
    x, y = order[:-1], order[1:]
    same = (kind[x] == kind[y]) & (content[x] == content[y]) & (offset[x] == offset[y]) & (windows[x] == windows[y])
    for k in range(0, n, 8192):
        same[k : k + 8192] &= (text[x[k : k + 8192]] == text[y[k : k + 8192]]).all(axis=1)
    first = np.r_[True, ~same]
    lead = order[first]
    leader = np.empty(n, np.int64)
    leader[order] = np.cumsum(first) - 1
    smallest = np.full(len(lead), _NO_ID)
    np.minimum.at(smallest, leader, doc)
    # of kinds with several surroundings the windows are compared, of the others not
    least = np.repeat(smallest[:, None], WINDOW - GRAM + 1, axis=1)
    many = np.flatnonzero(np.bincount(kind[lead])[kind[lead]] > 1)
    if len(many):
        rows = lead[many]
        least[many] = smallest_documents(text[rows], kind[rows], smallest[many], offset[rows], windows[rows])
    along = np.arange(WINDOW - GRAM + 1)
    gone = (least[leader] < doc[:, None]) & (along < windows[:, None])
    return (gone * (np.int64(1) << along)).sum(axis=1)


def smallest_documents(text: np.ndarray, kind: np.ndarray, doc: np.ndarray, offset: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The smallest document that has each window of each anchor, by sorting the suffixes that start at the windows:
    those of one kind of anchor at one place."""
    item = np.repeat(np.arange(len(text)), windows)
    start = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = kind[item] * text.shape[1] + (offset[item] - start)
    by = np.argsort(group, kind="stable")
    item, start, group = item[by], start[by], group[by]
    suffixes = Suffixes(text, item, start)
    order = suffixes.sort(group)
    x, y = order[:-1], order[1:]
    same = (group[x] == group[y]) & (suffixes.common(x, y) == WINDOW)
    checked = np.flatnonzero(same)
    equal = np.ones(len(checked), bool)
    along = np.arange(WINDOW)
    for k in range(0, len(checked), 20_000):
        u, v = x[checked[k : k + 20_000]], y[checked[k : k + 20_000]]
        equal[k : k + 20_000] = (text[item[u][:, None], start[u][:, None] + along] == text[item[v][:, None], start[v][:, None] + along]).all(axis=1)
    wrong = checked[~equal]
    classes = np.cumsum(np.r_[True, ~same]) - 1
    if len(wrong):  # two strings of one hash: the groups concerned are told apart by their bytes
        bad = np.isin(group[order], group[x[wrong]])
        names: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(bad):
            s = order[k]
            classes[k] = len(order) + names.setdefault((int(group[s]), text[item[s], start[s] : start[s] + WINDOW].tobytes()), len(names))
    _, classes = np.unique(classes, return_inverse=True)
    least = np.full(classes.max() + 1, _NO_ID)
    np.minimum.at(least, classes, doc[item[order]])
    out = np.repeat(doc[:, None], WINDOW - GRAM + 1, axis=1)
    out[item[order], start[order]] = least[classes]
    return out


def repeated_windows(sent: DataFrame) -> DataFrame:
    """(block, found): packed window starts of the block and bits of those from there on that are repeats."""

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        out = [(b, x) for b, x in zip(group["block"], group["local"], strict=True) if x is not None]
        group = group[group["anchors"].notna()]
        if len(group):
            got = [unpacked(b, 7) for b in group["anchors"]]
            flat = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for b in group["bytes"]])
            hashes, doc, low, offset, windows = (np.concatenate([g[k] for g in got]) for k in range(5))
            masks = repeated(hashes, doc, offset, windows, flat)
            at = 0
            for block, g in zip(group["block"], got, strict=True):
                mine = masks[at : at + len(g[0])]
                at += len(g[0])
                low, bits = np.r_[g[2], g[5]], np.r_[mine, mine[g[6]]]
                some = bits != 0
                if some.any():
                    by = np.argsort(low[some])
                    out.append((block, packed(low[some][by], bits[some][by])))
        return pd.DataFrame(out, columns=["block", "found"])

    return sent.groupBy("grp").applyInPandas(resolve, "block long, found binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of each document without the bytes of windows that a document with a smaller doc_id has too: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    Texts are UTF-8 bytes as given, null is empty; texts shorter than a window lose nothing. Documents of equal id (or
    none; a null id counts as the largest long) don't remove from each other. Rows stay one for one; other columns aren't
    returned. doc_id must be of an integer type (ValueError if not) and comes back as a long.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("doc_id must be an integer")
    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    packed_docs = blocks(docs, name)
    groups = groups_of(packed_docs.count())
    packed_docs = packed_docs.join(materialize(copies(packed_docs)), "block", "left")
    masks = materialize(shared_anchors(packed_docs, groups))
    found = repeated_windows(contexts(packed_docs, masks, groups)).groupBy("block").agg(F.collect_list("found").alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, ends, _ = opened(row)
            starts = np.zeros(len(data) + WINDOW + 1, np.int32)
            if row["found"]:
                low, bits = (np.concatenate(x) for x in zip(*[unpacked(blob, 2) for blob in row["found"]], strict=True))
                for k in range(WINDOW - GRAM + 1):
                    starts[low[(bits >> k) & 1 == 1] + k] = 1
            cover = starts.copy()
            cover[WINDOW:] -= starts[:-WINDOW]
            gone = np.cumsum(cover)[: len(data)] > 0
            out = []
            all_ends, all_ids, valid = unpacked(row["docs"], 3)
            copied = np.zeros(len(all_ids), bool)
            copied[row["copies"] or []] = True
            given = [i if v else None for i, v in zip(all_ids.tolist(), valid.tolist(), strict=True)]
            names = (given[k] for k in np.flatnonzero(~copied))
            for a, b, i in zip(np.r_[0, ends][: len(ends)].tolist(), ends.tolist(), names, strict=True):  # none, if all are copies
                part = gone[a:b]
                removed = int(part.sum())
                spans = int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if removed else 0
                out.append((i, b - a, removed, spans, data[a:b][~part].tobytes() if removed else data[a:b].tobytes()))
            if copied.any():
                raw = zstandard.ZstdDecompressor().decompress(row["texts"])
                for k in np.flatnonzero(copied).tolist():
                    end, n = int(all_ends[k]), int(all_ends[k] - (all_ends[k - 1] if k else 0))
                    whole = n >= WINDOW
                    out.append((given[k], n, n if whole else 0, int(whole), b"" if whole else raw[end - n : end]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = packed_docs.join(found, "block", "left").select("docs", "texts", "copies", "found")
    kept = materialize(whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
    spark.sql(f"DROP TABLE {name}")
    return kept


def kept_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
