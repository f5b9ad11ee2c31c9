"""Exact substring deduplication by a logarithmic family of suffix arrays.

A byte goes if some string of ``length`` bytes that covers it starts anywhere else too. Comparing every suffix
of the corpus is not needed: each window of ``length`` bytes picks one anchor, the smallest hashed ``k``-mer in
it, by its content alone, so equal windows have anchors that are equal and at the same offset.

1. Neighbouring windows with one anchor form a fragment. An anchor that occurs once rules its windows out.
2. Fragments with equal anchor and digest are folded before the shuffle. The bytes of each fragment that is left, and
   of a second copy of it if it has any, go to the partition of their anchor, and there, batch by batch, into a
   :class:`Family`: a new batch gets a suffix array of its anchors, is merge-scanned against the arrays of the existing
   levels for long matches, and levels of equal size are merged, so there are only logarithmically many. The family
   alone decides what is repeated, on bytes: a window is, if two fragments share what it has on both sides of the anchor.
   An anchor with more different fragments than ``hot`` is not kept in one place: they go through the same steps as
   texts of their own with a longer anchor, down to windows that are their own anchors. ``hot`` bounds the work of a
   task and changes no result.
3. Every occurrence of a fragment takes over its repeated windows; their bytes are cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Hasher, U, buffers, gather, mix, pieces
from .common import cut, drop_table, give_back

LENGTH = 200
#: Sizes of the anchors; the later ones only for what shares a hot anchor of the one before. A window is its own last anchor.
ANCHORS = (100, 184, 200)
#: Bytes of fragments that one family takes in, and that one of its batches has.
FAMILY_BYTES = 8 << 20
#: Most partitions of the fragments; beyond, a partition has several families, one after the other.
MOST_PARTS = 20_000
BATCH_BYTES = 2 << 20
#: Different fragments of one anchor that are still compared in one partition: what fills it.
HOT = 20_000
#: By which spans find their row again: the id, and a hash of id and text.
KEY = ("cardloom_id", "cardloom_key")


def fragments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHORS[0]) -> tuple[np.ndarray, ...]:
    """``(text, first window, windows, offset of the anchor, anchor hash, fragment hash)`` of the fragments of each text."""
    n, none = len(data), tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    windows = n - length + 1
    if windows <= 0:
        return none
    hasher, width = Hasher(data), length - k + 1
    grams = hasher.every(k)
    # hash in the upper bits, place in the lower ones: the smallest key is the leftmost smallest k-mer
    keys = (grams & ~U((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)
    table = np.concatenate([keys, np.full(-len(keys) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U((1 << 28) - 1)).astype(np.int64)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    # windows that begin in one text and end in another belong to none: cut the runs at both ends of each text
    last = np.clip(off[1:] - length + 1, 0, windows)
    bounds = np.unique(np.concatenate([[0, windows], change, off[:-1][off[:-1] < windows], last]))
    start, end = bounds[:-1], bounds[1:]
    text = np.searchsorted(off, start, "right") - 1
    use = start + length <= off[text + 1]
    start, end, text = start[use], end[use], text[use]
    at = anchor[start]
    return text, start - off[text], end - start, at - start, grams[at], _digest(hasher, start, end - 1 + length, at - start)


def _digest(hasher: Hasher, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Digest of a fragment: its bytes and where its anchor is."""
    return hasher.at(start, end) ^ mix((place * 1024 + 7).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), KEY[1]: F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))})


def _fragment_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """A row for each fragment; ``place`` holds first window, number of windows and offset of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            for lo, _, data, off in pieces(batch.column("text")):
                text, first, count, at, anchor, whole = fragments(data, off, length, k)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[lo + text], pa.int64()) for x in keys], pa.array(first << 32 | count << 16 | at, pa.int64()), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=[*KEY, "place", "anchor", "whole"])

    return docs.select(*KEY, "text").mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, place long, anchor long, whole long")


def _contexts(text: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Up to ``width`` bytes from each place on (``step`` 1) or back from it (-1), then their number, as sortable strings."""
    size = np.minimum(size, width)
    out = np.zeros((len(at), width + 2), np.uint8)
    for lo in range(0, len(at), 8192):  # in parts: places take eight times the space of bytes
        reach = np.arange(width)
        inside = reach < size[lo : lo + 8192, None]
        out[lo : lo + 8192, :width][inside] = text[((at[lo : lo + 8192, None] if step > 0 else at[lo : lo + 8192, None] - 1) + step * reach)[inside]]
    out[:, width], out[:, width + 1] = size >> 8, size & 255
    return out.view(f"S{width + 2}").ravel()


def _common(strings: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string from :func:`_contexts` with the one before it; 0 for the first."""
    rows = np.frombuffer(strings.tobytes(), np.uint8).reshape(len(strings), strings.itemsize)
    size = rows[:, -2].astype(np.int64) << 8 | rows[:, -1]
    differs = rows[1:, :-2] != rows[:-1, :-2]
    reach = np.where(differs.any(1), differs.argmax(1), strings.itemsize) if differs.shape[1] else np.zeros(len(differs), np.int64)
    return np.concatenate([[0], np.minimum(reach, np.minimum(size[1:], size[:-1]))])[: len(rows)]


class Level:
    """A suffix array: anchors in ``text`` in the order of the bytes from them on. ``low`` and ``high`` bound each one's
    fragment; ``group`` tells equal anchors at a glance; ``entry`` is the fragment's number in the family."""

    FIELDS = ("at", "low", "high", "group", "entry")

    def __init__(self, text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, entry: np.ndarray):
        self.text, self.at, self.low, self.high, self.group, self.entry = text, at, low, high, group, entry

    def take(self, order: np.ndarray) -> Level:
        return Level(self.text, *(getattr(self, f)[order] for f in self.FIELDS))

    def suffixes(self, length: int) -> np.ndarray:
        return _contexts(self.text, self.at, self.high - self.at, length, 1)

    def whole_windows(self, length: int, k: int) -> np.ndarray:
        """Which windows around its anchor each entry has, by the number of their bytes before the anchor."""
        before = np.arange(length - k + 1)
        return (before <= (self.at - self.low)[:, None]) & (length - before <= (self.high - self.at)[:, None])

    def merge(self, other: Level, length: int) -> Level:
        """One array out of two, in order."""
        place = np.searchsorted(self.suffixes(length), other.suffixes(length), "right")
        add = (len(self.text), len(self.text), len(self.text), 0, 0)
        return Level(np.concatenate([self.text, other.text]), *(np.insert(getattr(self, f), place, getattr(other, f) + a) for f, a in zip(self.FIELDS, add, strict=True)))

    def repeated(self, length: int, k: int) -> np.ndarray:
        """Which windows of each entry are repeated in the array, by the number of their bytes before the anchor."""
        n, width = len(self.at), length - k
        left, right, own = self.at - self.low, np.minimum(self.high - self.at, length), self.whole_windows(length, k)
        suffixes, before = self.suffixes(length), _contexts(self.text, self.at, left, width, -1)
        common = _common(suffixes)
        group = np.cumsum(common < k)
        # equal fragments are repeated whole; then one of each stands for them
        same = np.concatenate([[False], (common[1:] == right[1:]) & (common[1:] == right[:-1])])[:n]
        _, back = np.unique(before, return_inverse=True)
        _, first, body, copies = np.unique(np.cumsum(~same) * (n + 1) + back, return_index=True, return_inverse=True, return_counts=True)
        out = own & (copies[body] > 1)[:, None]
        some = np.sort(first)
        some = some[(np.bincount(group[some], minlength=int(group[-1]) + 1 if n else 1)[group[some]] > 1)]
        if not len(some):
            return out
        # classes of equal bytes after and before the anchor, to every depth, from the common prefixes of neighbours
        reach = np.concatenate([[0], np.minimum.reduceat(common[: some[-1] + 1], some[:-1] + 1)]) if len(some) > 1 else np.zeros(1, np.int64)
        order = np.argsort(before[some], kind="stable")
        behind, m = _common(before[some][order]), len(some)
        found, class_before = np.zeros((m, width + 1), bool), np.empty(m, np.int64)
        for j in range(width + 1):
            class_before[order] = np.cumsum(behind < j)
            keys = np.cumsum(reach < length - j) * (m + 1) + class_before
            keys[~own[some, j]] = -1 - np.flatnonzero(~own[some, j])
            by = np.argsort(keys)
            twin = np.flatnonzero(keys[by][1:] == keys[by][:-1])
            found[by[twin], j] = found[by[twin + 1], j] = True
        shared = np.zeros((len(first), width + 1), bool)
        shared[body[some]] = found
        return out | (shared[body] & own)


class Family:
    """Levels of suffix arrays whose sizes grow geometrically."""

    def __init__(self, length: int = LENGTH, k: int = ANCHORS[0]):
        self.length, self.k, self.levels = length, k, []
        self.windows = np.zeros((0, length - k + 1), bool)

    def add(self, texts: list[bytes], anchors: np.ndarray, groups: np.ndarray, copied: np.ndarray) -> None:
        """Take in a batch of fragments with the offsets of their anchors; ``copied`` ones stand for several equal rows."""
        sizes, base = np.fromiter(map(len, texts), np.int64, len(texts)), len(self.windows)
        low = np.cumsum(sizes) - sizes
        new = Level(np.frombuffer(b"".join(texts), np.uint8), low + anchors, low, low + sizes, groups, np.arange(base, base + len(texts)))
        self.windows = np.concatenate([self.windows, new.whole_windows(self.length, self.k) & copied[:, None]])
        new = new.take(np.argsort(new.suffixes(self.length), kind="stable"))
        self._mark(new)
        for level in self.levels:  # merge-scan: what the batch has in common with a level
            ours, theirs = np.isin(new.group, level.group), np.isin(level.group, new.group)
            if ours.any():
                self._mark(level.take(np.flatnonzero(theirs)).merge(new.take(np.flatnonzero(ours)), self.length))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1].at) >= len(self.levels[-2].at):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(last, self.length)

    def _mark(self, level: Level) -> None:
        self.windows[level.entry] |= level.repeated(self.length, self.k)


def _runs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, first, count)`` of the runs of consecutive places of each id."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(head)
    return ids[begin], at[begin], np.diff(np.append(begin, len(ids)))


def _compared(bodies: DataFrame, length: int, k: int, batch_bytes: int) -> DataFrame:
    """``anchor, whole, skip, windows``: runs of repeated windows within the fragments of each partition, whose anchors come in
    order. A family takes in anchors until it has ``FAMILY_BYTES``; the next anchor begins another one, so a partition may be
    of any size."""

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        family, columns = Family(length, k), []
        held, size = [], 0
        for i, part in enumerate(parts):
            held.append(part)
            size += part.column("body").nbytes
            if size >= batch_bytes or i == len(parts) - 1:
                for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                    group, whole, place = (batch.column(c).to_numpy() for c in ("anchor", "whole", "place"))
                    family.add(batch.column("body").to_pylist(), place & 65535, group, batch.column("copied").to_numpy(zero_copy_only=False))
                    columns.append((group, whole, place & 65535))
                held, size = [], 0
        entry, before = np.nonzero(family.windows)
        anchors, wholes, places = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else (np.zeros(0, np.int64),) * 3
        at, first, count = _runs(entry, places[entry] - before)
        return pa.RecordBatch.from_arrays([pa.array(anchors[at], pa.int64()), pa.array(wholes[at], pa.int64()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "whole", "skip", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            while batch.num_rows:
                own = batch.num_rows
                if size >= FAMILY_BYTES:  # only the last anchor's own fragments still join this family
                    own = int(np.searchsorted(batch.column("anchor").to_numpy(), last, "right"))
                    if not own:
                        yield compared(parts)
                        parts, size = [], 0
                        continue
                parts.append(batch.slice(0, own))
                size += parts[-1].column("body").nbytes
                last, batch = batch.column("anchor")[own - 1].as_py(), batch.slice(own)
        if parts:
            yield compared(parts)

    return bodies.select("anchor", "whole", "place", "copied", "body").mapInArrow(run, "anchor long, whole long, skip int, windows int")


def _bodies(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``anchor, hot, whole, place, copied, body``: the bytes of each wanted fragment, cut out of a text it was seen in."""
    fields = {"anchor": "long", "hot": "boolean", "whole": "long", "place": "long", "copied": "boolean"}
    lists = wanted.groupBy(KEY[1]).agg(F.collect_list(F.struct(*fields)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column("text")):
                part = batch.column("wanted").slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                columns = dict(zip(fields, part.flatten().flatten(), strict=True))
                place = columns["place"].to_numpy()
                start, size = off[row] + (place >> 32), (place >> 16 & 65535) - 1 + length
                # a text with the same key that is another text does not have the fragment
                good = np.flatnonzero(start + size <= off[row + 1])
                digest = _digest(Hasher(data), start[good], (start + size)[good], (place & 65535)[good])
                good = good[digest.view(np.int64) == columns["whole"].to_numpy()[good]]
                end = np.cumsum(size[good])
                body = pa.BinaryArray.from_buffers(pa.binary(), len(good), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(gather(data, start[good], size[good]))])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(good)) for c in columns.values()), body], names=[*fields, "body"])

    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    return docs.join(lists, KEY[1]).dropDuplicates(list(KEY)).select("text", "wanted").mapInArrow(run, f"{schema}, body binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, hot: int = HOT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``KEY, cardloom_spans`` for ``KEY, text``: the byte ranges (``start``, ``stop``) of each text that repeated windows cover, as maximal runs.

    ``anchors`` are k-mer sizes, growing to ``length``: the fragments of a hot anchor are taken as texts in their
    own right with the next size, so their windows spread over many anchors.
    """
    k = min(anchors[0], length)
    docs = docs.select(*KEY, "text")
    rows = _fragment_rows(docs, length, k)
    # fragments by digest, then anchors by their fragments: both are partial sums before the shuffle
    seen = F.struct(F.col(KEY[1]), F.col("place"))
    kinds = cut(rows.groupBy("anchor", "whole").agg(F.count("*").alias("times"), F.min(seen).alias("one"), F.max(seen).alias("two")).withColumn("two", F.when(F.col("times") > 1, F.col("two"))), "fragments")
    groups = kinds.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.count("*").alias("kinds")).where("all_times > 1")
    repeated = kinds.join(groups, "anchor")
    # of copies the first and the last are compared; equal rows have one place, and count as copies
    places = F.array_distinct(F.array_compact(F.array("one", "two")))
    wanted = repeated.select("anchor", "whole", (F.col("kinds") > hot).alias("hot"), ((F.col("times") > 1) & (F.col("one") == F.col("two"))).alias("copied"), F.explode(places).alias("at"))
    wanted = cut(wanted.select("anchor", "whole", "hot", "copied", "at.*"), "wanted")
    drop_table(kinds)
    give_back(docs.sparkSession)
    bodies = cut(_bodies(wanted, docs, length), "bodies")
    drop_table(wanted)
    give_back(docs.sparkSession)
    size = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = min(1 + size // FAMILY_BYTES, MOST_PARTS)
    edges = _compared(bodies.where("not hot").repartition(parts, "anchor").sortWithinPartitions("anchor"), length, k, batch_bytes)
    inner = None
    if len(anchors) > 1 and not bodies.where("hot").isEmpty():
        again = bodies.where("hot").select(F.col("anchor").alias(KEY[0]), F.col("whole").alias(KEY[1]), F.col("body").alias("text"))
        copies = bodies.where("hot and copied").select(F.col("anchor").alias(KEY[0]), F.col("whole").alias(KEY[1]), F.col("body").alias("text"))
        inner = repeated_spans(again.unionByName(copies), length, anchors[1:], hot, batch_bytes)
        runs = inner.select(F.col(KEY[0]).alias("anchor"), F.col(KEY[1]).alias("whole"), F.explode("cardloom_spans").alias("s"))
        edges = edges.unionByName(runs.select("anchor", "whole", F.col("s.start").alias("skip"), (F.col("s.stop") - F.col("s.start") - length + 1).alias("windows")))
    verdicts = cut(edges.groupBy("anchor", "whole").agg(F.collect_set(F.struct("skip", "windows")).alias("runs")), "verdicts")
    drop_table(bodies)
    give_back(docs.sparkSession)
    if inner is not None:
        drop_table(inner)
    found = _fragment_rows(docs, length, k).join(verdicts, ["anchor", "whole"])
    first = F.shiftright("place", 32).cast("int")
    covered = F.transform("runs", lambda r: F.struct((first + r["skip"]).alias("start"), (first + r["skip"] + r["windows"] - 1 + length).alias("stop")))
    spans = found.select(*KEY, covered.alias("spans")).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("cardloom_spans"))
    out = cut(_joined(spans), "spans")
    drop_table(verdicts)
    return out


def _joined(spans: DataFrame) -> DataFrame:
    """The spans of each row as their maximal runs: what covers the same bytes, in as few spans as there can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_maximal(x) for x in batch.column("cardloom_spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(found, batch.schema.field("cardloom_spans").type)], names=[*KEY, "cardloom_spans"])

    return spans.select(*KEY, "cardloom_spans").mapInArrow(run, spans.schema)


def _maximal(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def _kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """``(bytes that stay, bytes removed, maximal removed runs)``."""
    if not spans:
        return text, 0, 0
    bounds = np.array(sorted((s["start"], s["stop"]) for s in spans))
    reach = np.maximum.accumulate(bounds[:, 1])
    new = np.append(True, bounds[1:, 0] > reach[:-1])
    starts, stops = bounds[new, 0], np.append(reach[:-1][new[1:]], reach[-1])
    parts = [text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True)]
    return b"".join(parts), int((stops - starts).sum()), len(starts)


def removal(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, hot: int = HOT) -> DataFrame:
    """What stays of each row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. NULL counts as empty; texts under ``length``
    bytes stay whole; matches never cross texts; strings are judged on the input. Repeated rows count as texts of
    their own, so both lose all that is long enough; rows are told apart by id and text. An empty table gives no row;
    very long texts are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw, out = data.tobytes(), []
            for i, spans in enumerate(batch.column("cardloom_spans").to_pylist()):
                text = raw[off[i] : off[i + 1]]
                kept, removed, runs = _kept(text, spans)
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = _keyed(docs.select("doc_id", "text"))
    return docs.join(repeated_spans(docs, length, anchors, hot), list(KEY), "left").select("doc_id", "text", "cardloom_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, hot: int = HOT) -> DataFrame:
    """``docs`` with its own columns and the repeated bytes taken out of ``text`` (broken characters at the cuts go
    as well; ``n_chars``, if there, is brought up to date)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            raw, texts, here = data.tobytes(), [], batch.column("text").is_valid().to_pylist()
            for i, spans in enumerate(batch.column("cardloom_spans").to_pylist()):
                text = raw[off[i] : off[i + 1]]
                texts.append(_kept(text, spans)[0].decode(errors="ignore") if here[i] else None)
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    keyed = _keyed(docs)
    return keyed.join(repeated_spans(keyed, length, anchors, hot), list(KEY), "left").select(*[keyed[n] for n in names], "cardloom_spans").mapInArrow(run, docs.schema)
