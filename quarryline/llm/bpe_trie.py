"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts, sorted, are the depth-first order of their trie: walking from one word to the
next pops the stack to the shared prefix and pushes one state per new byte. A node's state is the last token of the
encoding of its prefix, with that encoding itself, so the encoding of a shared prefix is made once. The last token
is the one suffix token that the encoding of the rest can stand before: no merge crosses the border between them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are split into words at once.
BLOCK_CHARS = 1_000_000
#: Bytes of a prefix up to which its encoding is kept on the way down; of longer ones only the last token is.
KEPT_DEPTH = 64
#: Words whose encodings a Python worker keeps.
KEPT_WORDS = 300_000

_ENCODERS: dict[str, "TrieEncoder"] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: its own if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    """Encoder of one vocabulary; `spec` is the text of a tokenizer file of the byte-level BPE kind."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = parsed["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in vocab.items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        of_id = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.raw = Pool([of_id.get(i, b"") for i in range(max(of_id) + 1)])
        self.decimal = Pool([b"%d," % i for i in range(max(of_id) + 1)])
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(parsed["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = n
            self.parts.setdefault(vocab[left + right], (n, a, b))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._border: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        # a token that its own bytes aren't encoded as (an earlier merge takes one of its parts) is never a last token
        standing: set[int] = set()
        for token in [*range(len(vocab))]:
            if token not in self.parts:
                standing.add(token)
        for token, (n, a, b) in sorted(self.parts.items(), key=lambda x: x[1][0]):
            if a in standing and b in standing and self.joins_until(a, b, n):
                standing.add(token)
        self._suffixes([(raw, i) for raw, i in self.ids.items() if i in standing])

    def _suffixes(self, tokens: list[tuple[bytes, int]]) -> None:
        """For each prefix of a token: the prefix that a further byte leads to, and the tokens that it ends with,
        longest first."""
        step: dict[int, int] = {}
        ends: list[list[tuple[int, int]]] = [[]]
        for raw, token in tokens:
            at = 0
            for byte in raw:
                at = step.setdefault(at << 8 | byte, len(ends))
                if at == len(ends):
                    ends.append([])
            ends[at].append((token, len(raw)))
        self.step, self.ends, self.shorter = step, ends, [0] * len(ends)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, at in step.items():
            below.setdefault(key >> 8, []).append((key & 255, at))
        level = [(0, byte, at) for byte, at in below[0]]
        while level:
            following = []
            for parent, byte, at in level:
                self.shorter[at] = self._next(self.shorter[parent], byte) if parent else 0
                ends[at] += ends[self.shorter[at]]
                following += [(at, b, x) for b, x in below.get(at, ())]
            level = following
        self.grown = dict(step)

    def _next(self, at: int, byte: int) -> int:
        while True:
            to = self.step.get(at << 8 | byte)
            if to is not None or not at:
                return to or 0
            at = self.shorter[at]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge (1 right, 0 left) of `token` while it is built, each with the rank of the
        merge that ends it."""
        known = self._spines[side].get(token)
        if known is None:
            known, top, until = [], token, float("inf")
            while True:
                known.append((token, until))
                if token not in self.parts:
                    break
                n, a, b = self.parts[token]
                token, until = (b if side else a), n
            self._spines[side][top] = known
        return known

    def joins(self, pair: int) -> bool:
        """Whether the two tokens (ids of 32 bits side by side) can follow each other: no merge across the border comes
        before those that build them (at equal ranks the leftmost goes first)."""
        if len(self._border) > 1_000_000:
            self._border.clear()
        known = self._border[pair] = self.joins_until(pair >> 32, pair & 0xFFFFFFFF, float("inf"))
        return known

    def joins_until(self, left: int, right: int, rank: float) -> bool:
        """As joins(), looking at merges before `rank` only."""
        rights, ranks = self._spine(right, 0), self.rank
        for a, a_until in self._spine(left, 1):
            for b, b_until in rights:
                n = ranks.get((a, b))
                if n is not None and n < a_until and n <= b_until and n < rank:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The encodings (ids of four bytes) of distinct words, by one depth-first walk of their trie."""
        out: dict[str, bytes] = {}
        joins, border, grown, ends = self.joins, self._border, self.grown, self.ends
        last: list[int] = [0]
        state: list[int] = [0]
        encoded: list[bytes] = [b""]
        before = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], encoded[shared + 1 :], state[shared + 1 :]
            at = state[shared]
            for end in range(shared + 1, len(raw) + 1):
                key = at << 8 | raw[end - 1]
                at = grown.get(key)
                if at is None:
                    at = grown[key] = self._next(key >> 8, key & 255)
                state.append(at)
                for token, length in ends[at]:
                    if length < end:
                        pair = last[end - length] << 32 | token
                        fits = border.get(pair)
                        if not (joins(pair) if fits is None else fits):
                            continue
                    last.append(token)
                    if end <= KEPT_DEPTH:
                        encoded.append(encoded[end - length] + token.to_bytes(4, "little"))
                    break
            out[word] = encoded[-1] if len(raw) <= KEPT_DEPTH else self._walked_back(last, encoded)
            before = raw
        return out

    def _walked_back(self, last: list[int], encoded: list[bytes]) -> bytes:
        """The encoding of a long prefix, from its last token back to the part that is kept."""
        end, tail = len(last) - 1, []
        while end > KEPT_DEPTH:
            tail.append(last[end])
            end -= int(self.raw.sizes[last[end]])
        return encoded[end] + np.array(tail[::-1], np.int32).tobytes()

    def pieces(self, text: str) -> list[str]:
        return [w for k, part in enumerate(self.special_split.split(text) if self.special_split else [text]) for w in ([part] if k % 2 else self.words.findall(part))]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The text cut before single spaces, in blocks; where spaces stand side by side, or a special token is named,
        at white space after which no word can reach back. Each chunk is encoded by itself."""
        plain = not any(map(text.__contains__, _SIDE_BY_SIDE)) and not any(map(text.__contains__, self.special))
        if plain and len(text) <= BLOCK_CHARS:
            first, *rest = text.split(" ")
            yield [*([first] if first else []), *[" " + c for c in rest]]
            return
        at = 0
        while at < len(text):
            cut = next((m.end() for m in _CUT.finditer(text, at + BLOCK_CHARS)), len(text)) if len(text) - at > BLOCK_CHARS else len(text)
            yield self.pieces(text[at:cut])
            at = cut

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the distinct words of all texts are in one trie."""
        split = [list(self.chunks(t)) if len(t) <= BLOCK_CHARS else None for t in texts]
        self.learn({c for blocks in split if blocks for chunks in blocks for c in chunks})
        return [np.frombuffer(b"".join(map(self._joined, self.chunks(t) if blocks is None else blocks)), np.int32) for t, blocks in zip(texts, split, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def _joined(self, chunks: list[str]) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            self.learn(set(chunks))
            return b"".join(map(self.cache.__getitem__, chunks))

    def learn(self, chunks: set[str]) -> None:
        """Put the encodings of chunks into the cache: two generations, of which the older goes when the newer is full."""
        new = chunks.difference(self.cache)
        if len(self.cache) + len(new) > KEPT_WORDS:
            self.older, self.cache, new = self.cache, {}, chunks
        split = {}
        for c in new:
            if (known := self.older.get(c)) is not None:
                self.cache[c] = known
            else:
                split[c] = self.pieces(c)
        encoded = self.encode_words({w for words in split.values() for w in words}.difference(self.special))
        encoded.update((s, i.to_bytes(4, "little")) for s, i in self.special.items())
        self.cache.update((c, b"".join(map(encoded.__getitem__, words))) for c, words in split.items())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; special tokens are kept, broken UTF-8 is replaced."""
        return self.raw.joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class Pool:
    """Byte strings by number, to be joined many at a time."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, which: np.ndarray) -> bytes:
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - ends + sizes, sizes)].tobytes()


_WHITE = [c for c in map(chr, range(0x3001)) if regex.match(r"\s", c)]
_SIDE_BY_SIDE = [*{x for c in _WHITE for x in (c + " ", " " + c)}]
#: After other text, before a space and a word: a word ends there. A named special token holds no space.
_CUT = regex.compile(r"\S(?= \S)")


def encoder(spec: str) -> TrieEncoder:
    """One encoder for each vocabulary in a Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(spec)
    return _ENCODERS[key]


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode `text`; returns doc_id, ids (decimal, joined by commas), n_tokens, decoded.

    A null or empty text has no tokens (ids and decoded are empty). Other columns of `docs` aren't returned; rows and
    their repeats stay one for one. `tokenizer_path` is read on the driver, its 1-2 MB go with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            for block in in_blocks(batch):
                texts = [t or "" for t in block.column(1).to_pylist()]
                ids = enc.encode_all(texts)
                columns = {
                    "doc_id": block.column(0),
                    "ids": pa.array([enc.decimal.joined(i)[:-1] for i in ids], pa.binary()).cast(pa.string()),
                    "n_tokens": pa.array(map(len, ids), pa.int64()),
                    "decoded": pa.array([enc.decode(i) for i in ids], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids string, n_tokens long, decoded string")


def in_blocks(batch: pa.RecordBatch, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text) of about so many bytes of text; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
