"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a whole stretch of the corpus are laid out in one symbol array. An inverted index
from mergeable pair to positions is built once; merges are then applied in rank order over all words at a
time, and each applied merge looks up only the two pairs it has made with its neighbours. A word's ids do not
depend on the other words, so every task replays its own part of the corpus and nothing is shuffled.

Texts are first cut into chunks at single blanks between visible characters, where no match of the pattern can
go on, and equal chunks are found by hash and confirmed byte by byte. Only distinct chunks are split by the
pattern, and only words not met before are replayed; all else is integer arrays.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import Hasher, gather, lists, pieces
from .common import without

#: Most distinct words, and distinct chunks, that a task keeps with their ids; beyond, it starts anew.
KEPT_WORDS = 300_000
#: Bytes of text whose words are replayed together.
STRETCH = 4 << 20
_SHIFT = 20
#: ASCII characters that are seen, first bytes of characters of two and three bytes that no Unicode space has, and inner bytes.
_VISIBLE, _PAIR, _TRIPLE, _INNER = (np.zeros(256, bool) for _ in range(4))
_VISIBLE[0x21:0x7F] = _PAIR[0xC3:0xE0] = _TRIPLE[0xE0] = _TRIPLE[0xE4:0xF0] = _INNER[0x80:0xC0] = True


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file (``base64 rank`` lines)."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


class Merges:
    """The vocabulary with its pair table: ``pairs[a << 20 | b]`` is the id of the token that ``a`` and ``b`` make."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.pairs: dict[int, int] = {}
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = i
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        table = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                table[a, b] = self.pairs.get(int(self.bytes[a]) << _SHIFT | int(self.bytes[b]), -1)
        self.byte_pairs = table

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word's begin."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        last = np.zeros(n + 1, bool)
        last[begin[1:][sizes > 0] - 1] = True
        # compact arrays, as lists of numbers would take ten times the space
        symbol = array("i", self.bytes[data].astype(np.int32).tobytes())
        after = array("i", np.where(last[:n], -1, np.arange(1, n + 1)).astype(np.int32).tobytes())
        before = array("i", np.concatenate([[-1], np.where(last[: n - 1], -1, np.arange(n - 1))]).astype(np.int32).tobytes()) if n else array("i")
        # the inverted index: token id that a pair makes -> positions of such pairs; those of byte pairs lie sorted in ``at``
        rank = self.byte_pairs[data[:-1], data[1:]] if n > 1 else np.zeros(0, np.int64)
        rank[last[: n - 1]] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")].astype(np.int32)
        kinds, starts = np.unique(rank[rank >= 0], return_counts=True)
        ends = np.cumsum(starts)
        stretches = {k: at[hi - size : hi] for k, size, hi in zip(kinds.tolist(), starts.tolist(), ends.tolist(), strict=True)}
        index: dict[int, list[int]] = {}
        queue = sorted(stretches)
        pairs = self.pairs
        while queue:
            made = heappop(queue)
            positions = index.pop(made, [])
            if made in stretches:
                positions += stretches.pop(made).tolist()
            if not positions:
                continue
            positions.sort()
            held: int = -1  # rest of a word that must wait for a lower-ranked pair that has come up in it
            for p in positions:
                q = after[p]
                if q < 0 or symbol[p] < 0 or pairs.get(symbol[p] << _SHIFT | symbol[q]) != made:
                    continue
                if held >= 0:
                    if p <= held:
                        if made not in index:
                            index[made] = []
                            heappush(queue, made)
                        index[made].append(p)
                        continue
                    held = -1
                r = after[q]
                symbol[p], symbol[q], after[p] = made, -1, r
                if r >= 0:
                    before[r] = p
                    k = pairs.get(made << _SHIFT | symbol[r])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heappush(queue, k)
                        if k < made:
                            held = int(begin[np.searchsorted(begin, p, "right")]) - 1
                left = before[p]
                if left >= 0:
                    k = pairs.get(symbol[left] << _SHIFT | made)
                    if k is not None:
                        if k in index:
                            index[k].append(left)
                        else:
                            index[k] = [left]
                            heappush(queue, k)
                        if k < made:
                            held = int(begin[np.searchsorted(begin, p, "right")]) - 1
        flat = np.frombuffer(symbol, np.int32)
        alive = flat >= 0
        return flat[alive], np.concatenate([[0], np.cumsum(alive)])[begin].astype(np.int64)


class Pool:
    """Lists of numbers by key: one array, and where each list begins."""

    def __init__(self) -> None:
        self.slots: dict[str | bytes, int] = {}
        self.values, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, keys: list, values: np.ndarray, sizes: np.ndarray) -> None:
        self.slots.update(zip(keys, range(len(self.slots), len(self.slots) + len(keys)), strict=True))
        self.values = np.concatenate([self.values, values.astype(np.uint32)])
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) + self.begin[-1]])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at these slots, one after the other, and their sizes."""
        sizes = self.begin[at + 1] - self.begin[at]
        return gather(self.values, self.begin[at], sizes), sizes


def _chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the chunks: of each text, and at each single blank between two visible characters.

    A neighbour beyond ASCII counts as visible only if its first byte rules out every Unicode space.
    """
    n = len(data)
    start = np.zeros(n, bool)
    start[off[:-1][off[:-1] < off[1:]]] = True
    at = np.flatnonzero(data[3 : n - 1] == 0x20) + 3
    before, two, three, after = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    start[at[(_VISIBLE[before] | ((before >= 0x80) & (_PAIR[two] | (_INNER[two] & _TRIPLE[three])))) & (_VISIBLE | _PAIR | _TRIPLE)[after]]] = True
    return np.flatnonzero(start)


def _distinct_chunks(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(distinct chunks, which of them each chunk is, start of each chunk)``."""
    starts = _chunk_starts(data, off)
    if not len(starts):
        return [], np.zeros(0, np.int64), starts
    ends = np.append(starts[1:], len(data))
    _, first, back = np.unique(Hasher(data).at(starts, ends), return_index=True, return_inverse=True)
    # a chunk stands for those with its hash only where all bytes are equal; the others stand for themselves
    sizes, like = ends - starts, first[back]
    differs = data[np.minimum(np.repeat(starts[like] - starts, sizes) + np.arange(len(data)), len(data) - 1)] != data
    odd = np.flatnonzero((sizes != sizes[like]) | np.logical_or.reduceat(differs, starts))
    back[odd] = len(first) + np.arange(len(odd))
    first = np.append(first, odd)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], back, starts


class Encoder:
    """Encodes texts stretch by stretch; chunks and words seen before keep their ids.

    ``pattern`` must not have a match that goes on over a single blank between visible characters.
    """

    def __init__(self, tokens: list[bytes], pattern: str, kept_words: int = KEPT_WORDS):
        self.merges, self.find, self.kept = Merges(tokens), regex.compile(pattern).findall, kept_words
        self.words, self.chunks = Pool(), Pool()
        self.token_sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_bytes, self.token_begin = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.token_sizes) - self.token_sizes

    def _learn(self, chunks: list[bytes]) -> None:
        """Take in chunks not met before: split them, and replay the words not met before all at once."""
        split = [self.find(c.decode()) for c in chunks]
        new = set().union(*split) - self.words.slots.keys()
        if len(self.words.slots) + len(new) > self.kept:
            self.words = Pool()
            new = set().union(*split)
        # words that are tokens as a whole stay whole; the others are replayed
        known, whole, apart = self.merges.ids, [], []
        for w in sorted(new):
            (whole if w.encode() in known else apart).append(w)
        self.words.add(whole, np.array([known[w.encode()] for w in whole], np.uint32), np.ones(len(whole), np.int64))
        ids, begin = self.merges.replay([w.encode() for w in apart])
        self.words.add(apart, ids, np.diff(begin))
        count = np.fromiter(map(len, split), np.int64, len(split))
        values, sizes = self.words.of(np.fromiter((self.words.slots[w] for s in split for w in s), np.int64, int(count.sum())))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.chunks.add(chunks, values, np.diff(ends[np.concatenate([[0], np.cumsum(count)])]))

    def encode(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(ids of all texts, where each text's begin)`` of each part, ``(bytes, offsets)``; one replay serves all parts."""
        cut = [_distinct_chunks(*part) for part in parts]
        need = set().union(*(chunks for chunks, _, _ in cut)) if cut else set()
        new = need - self.chunks.slots.keys()
        if len(self.chunks.slots) + len(new) > self.kept:
            self.chunks = Pool()
            new = need
        if new:
            gc.disable()  # no cycles are made, and a search for some would go through all kept words again and again
            try:
                self._learn(sorted(new))
            finally:
                gc.enable()
        for (_, off), (chunks, back, starts) in zip(parts, cut, strict=True):
            slot = np.fromiter(map(self.chunks.slots.__getitem__, chunks), np.int64, len(chunks))
            ids, counts = self.chunks.of(slot[back])
            yield ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[np.searchsorted(starts, off)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = [t.encode() for t in texts]
        ids, begin = next(self.encode([(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]))
        return [ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes of the ids' tokens, one after the other, and where each token's begin)``."""
        sizes = self.token_sizes[ids]
        return gather(self.token_bytes, self.token_begin[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoded(ids)[0].tobytes()


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


Encoded = tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[Encoded]:
    """``(rows, bytes, offsets, ids, their begins, decoded bytes, their begins)`` for runs of rows."""
    for stretch in _stretches(batches, STRETCH):
        parts = list(pieces(stretch.column("text"), 1 << 20))
        for (lo, hi, data, off), (ids, begin) in zip(parts, encoder.encode([part[2:] for part in parts]), strict=True):
            decoded, token = encoder.decoded(ids)
            yield stretch.slice(lo, hi - lo), data, off, ids, begin, decoded, token[begin]


def encode_and_check(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    NULL text counts as empty (no id). Texts are encoded whole, however long; repeated rows are each returned;
    ties between equal pairs go to the leftmost; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern))  # the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests(data: np.ndarray, begin: np.ndarray) -> pa.Array:
            raw, bounds = memoryview(data.tobytes()), (begin * data.itemsize).tolist()
            return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())

        for rows, _, _, ids, begin, decoded, at in _encoded(batches, Encoder(*shared.value)):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(begin), pa.int64()), digests(ids.astype("<u4"), begin), digests(decoded, at)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """``docs`` with its own columns, and ``n_tokens``, ``token_ids`` and ``decodes`` (the ids give the text's bytes
    back) after them. Columns of ``docs`` with one of these names give way to the new ones."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern))
    docs = without(docs, "n_tokens", "token_ids", "decodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off, ids, begin, decoded, at in _encoded(batches, Encoder(*shared.value)):
            good = [np.array_equal(data[a:b], decoded[c:d]) for a, b, c, d in zip(off[:-1], off[1:], at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(begin), pa.int64()), lists(ids.astype(np.int32), begin, pa.int32()), pa.array(good, pa.bool_())], names=[*rows.schema.names, "n_tokens", "token_ids", "decodes"])

    schema = T.StructType([*docs.schema, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are not UTF-8 become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(shared.value.__getitem__, ids.as_py() or [])).decode(errors="replace") for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, "doc_id long, text string")
