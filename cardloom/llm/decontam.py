"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words that ignores some of them, so a passage still matches where a
few words were replaced. Masked hashes of benchmark items and of corpus texts are joined; each pair that shares a
seed is then verified word by word on its diagonals, letting substitutions count against the overlap.

The corpus is scanned once, whatever the benchmark's size: a bit table of fixed size tells which seeds can occur in it,
and only texts with such a seed go on to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Hasher, U, lists, mix, pieces, word_bounds
from .common import cut, drop_table, give_back

#: Word positions that count (1); each mask has six of them.
MASKS = ("1111011", "110110011", "1011010101", "1100101011", "111111")
#: For items of fewer words: all of them.
SHORT = ("1", "11", "111", "1111", "11111")
#: An overlap counts from so many equal words on (or all words of a shorter item) ...
WORDS = 12
#: ... if at least this share of its words is equal.
IDENTITY = 0.8
#: Score of a changed word, where an equal one has 1, at which that share adds up to 0.
_MISS = -round(IDENTITY / (1 - IDENTITY))
#: Size of the bit table as a power of two: 8 MB.
FILTER_BITS = 26
#: A seed sets one bit for each of these factors; it can occur in the benchmark only where all of them are set.
_PROBES = (U(1), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
#: Parts in which the table is put together.
SLICES = 64
#: By which results find their row again: the id, and a hash of id and text.
KEY = ("cardloom_id", "cardloom_key")

#: Lower case, and ASCII punctuation as white space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 0x20


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, first word of each text)`` without case and punctuation."""
    folded = _FOLD[data]
    starts, ends, first = word_bounds(folded, off)
    return Hasher(folded).at(starts, ends), first


def _masked(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counted words below the mask, at each position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (*MASKS, *SHORT).index(mask) + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * U(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def _item_masks(n: int) -> tuple[str, ...]:
    return MASKS if n > len(SHORT) else SHORT[n - 1 : n]


def item_table(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, n_words, words, seeds`` of each different item with a word; ``item`` is a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in pieces(batch.column("text")):
                words, first = word_hashes(data, off)
                own = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                seeds = [np.unique(np.concatenate([_masked(w, m) for m in _item_masks(len(w))] or [w])) for w in own]
                begin = np.cumsum([0, *map(len, seeds)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").slice(lo, hi - lo), batch.column("item_id").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([w.tobytes() for w in own], pa.binary()), lists(np.concatenate(seeds).view(np.int64), begin, pa.int64())],
                    names=["item", "item_id", "n_words", "words", "seeds"],
                )

    items = benchmark.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(run, "item long, item_id long, n_words long, words binary, seeds array<long>").where("n_words > 0").dropDuplicates(["item"])


def seed_filter(items: DataFrame, bits: int) -> np.ndarray:
    """The bit table of all seeds of the items: set by each task, cut into slices, and put together slice by slice."""
    width = max((1 << bits) // SLICES, 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(max(1 << bits, SLICES), bool)
        for batch in batches:
            seeds = batch.column("seeds").flatten().to_numpy().view(np.uint64)
            for factor in _PROBES:
                table[(seeds * factor >> U(64 - bits)).astype(np.int64)] = True
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([np.packbits(part).tobytes() for part in table.reshape(SLICES, width)], pa.binary())], names=["slice", "marks"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("marks"), strict=True):
                found[k] = found.get(k, np.uint8(0)) | np.frombuffer(part.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([t.tobytes() for t in found.values()], pa.binary())], names=["slice", "marks"])

    table = np.zeros((SLICES, (width + 7) // 8), np.uint8)  # packed, as it is used: the driver holds no byte for each bit
    for row in items.select("seeds").mapInArrow(mark, "slice int, marks binary").repartition(SLICES, "slice").mapInArrow(join, "slice int, marks binary").collect():  # one table of fixed size
        table[row["slice"]] = np.frombuffer(row["marks"], np.uint8)
    return table.ravel() if width % 8 == 0 else np.packbits(np.unpackbits(table, axis=1)[:, :width].ravel())


def _hits(docs: DataFrame, table: Broadcast, bits: int, short: list[int]) -> DataFrame:
    """``KEY, words, seeds`` of the texts with a seed that the table has; ``seeds`` are those, once each."""
    masks = [*MASKS, *(SHORT[n - 1] for n in short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = table.value
        for batch in batches:
            for lo, _, data, off in pieces(batch.column("text"), 1 << 20):
                words, first = word_hashes(data, off)
                rows, seeds = [], []
                for mask in masks:
                    h = _masked(words, mask)
                    hit = np.arange(len(h))
                    for factor in _PROBES:
                        at = (h[hit] * factor >> U(64 - bits)).astype(np.int64)
                        hit = hit[(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
                    row = np.searchsorted(first, hit, "right") - 1
                    inside = hit + len(mask) <= first[row + 1]
                    rows.append(row[inside])
                    seeds.append(h[hit[inside]])
                row, seed = np.concatenate(rows), np.concatenate(seeds)
                if not len(row):
                    continue
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                once = np.append(True, (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]))
                row, seed = row[once], seed[once]
                texts, begin = np.unique(row, return_index=True)
                own = [words[first[t] : first[t + 1]].tobytes() for t in texts]
                at = pa.array(lo + texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in KEY), pa.array(own, pa.binary()), lists(seed.view(np.int64), np.append(begin, len(row)), pa.int64())], names=[*KEY, "words", "seeds"])

    return docs.select(*KEY, "text").mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, words binary, seeds array<long>").dropDuplicates(list(KEY))


def _stretch(same: np.ndarray) -> tuple[int, int]:
    """``(words, equal words)`` of the longest stretch with at least ``IDENTITY`` equal words.

    No other stretch that is similar enough has more equal words, so a test of them misses none.
    """
    # similar enough is a sum of 0 or more, and each end goes with the first begin that is not above it
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, _MISS))])
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    right = int(np.argmax(np.arange(len(total)) - first))
    at = np.flatnonzero(same[int(first[right]) : right])  # changed words at its ends are not part of it
    return (int(at[-1] - at[0]) + 1, len(at)) if len(at) else (0, 0)


def best_overlap(text: np.ndarray, item: np.ndarray) -> tuple[int, int] | None:
    """``(words, equal words)`` of the overlap with the most equal words on a diagonal that shares a seed, if there is any."""
    diagonals = [np.zeros(0, np.int64)]
    for mask in _item_masks(len(item)):
        h, g = _masked(text, mask), _masked(item, mask)
        order = np.argsort(g, kind="stable")
        lo, hi = np.searchsorted(g[order], h), np.searchsorted(g[order], h, "right")
        p = np.flatnonzero(hi > lo)
        n = (hi - lo)[p]
        q = order[np.repeat(lo[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        diagonals.append(np.unique(np.repeat(p, n) - q))
    found, best, m = np.unique(np.concatenate(diagonals)), None, len(item)
    need, place = min(WORDS, m), np.arange(m)
    for lo in range(0, len(found), max(1, (1 << 20) // m)):
        part = found[lo : lo + max(1, (1 << 20) // m)]
        at = part[:, None] + place
        same = (at >= 0) & (at < len(text)) & (text[np.clip(at, 0, len(text) - 1)] == item)
        for i in np.flatnonzero(same.sum(1) >= need):
            n, k = _stretch(same[i, max(0, -part[i]) : min(m, len(text) - part[i])])
            if k >= need and (best is None or (k, -n) > (best[1], -best[0])):
                best = n, k
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``KEY, item_id, overlap_words, equal_words``: each different text and benchmark item that overlap, for ``KEY, text``."""
    items = cut(item_table(benchmark), "items")
    short = sorted(r[0] for r in items.where(F.col("n_words") <= len(SHORT)).select("n_words").distinct().collect())  # at most five numbers
    table = docs.sparkSession.sparkContext.broadcast(seed_filter(items, filter_bits))  # of fixed size
    give_back(docs.sparkSession)
    hits = cut(_hits(docs, table, filter_bits, short), "hits")
    give_back(docs.sparkSession)
    left, right = hits.select(*KEY, F.explode("seeds").alias("seed")), items.select("item", F.explode("seeds").alias("seed"))
    pairs = left.join(right, "seed").select(*KEY, "item").distinct()
    both = pairs.join(hits.select(*KEY, F.col("words").alias("text_words")), list(KEY)).join(items.select("item", "item_id", "words"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [best_overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("text_words"), batch.column("words"), strict=True)]
            keep = pa.array([g is not None for g in got], pa.bool_())
            n, k = (pa.array([g[i] for g in got if g], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in (*KEY, "item_id")), n, k], names=[*KEY, "item_id", "overlap_words", "equal_words"])

    found = cut(both.select(*KEY, "item_id", "text_words", "words").mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, item_id long, overlap_words long, equal_words long"), "overlaps")
    drop_table(items)
    drop_table(hits)
    give_back(docs.sparkSession)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), KEY[1]: F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")})


def contamination(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """For each row of ``docs`` (``doc_id``, ``text``; others are ignored), which benchmark items overlap it.

    Returns ``doc_id, contaminated, item_ids, n_items, equal_words, overlap_words`` (the last two of the overlap
    with the most equal words). NULL and empty texts, and an empty benchmark, give no overlap; an item of fewer than
    ``WORDS`` words overlaps where all of them stand in one stretch that is similar enough, one without a word never.
    Repeated rows and very long texts are each searched whole; repeated items are listed once by id, items without an
    id count but are not listed; item ids are sorted; an empty table gives no row. ``filter_bits`` changes no result.
    """
    rows = _keyed(docs.select("doc_id", "text"))
    found = overlaps(rows, benchmark, filter_bits)
    best = F.max(F.struct("equal_words", (-F.col("overlap_words")).alias("n")))
    per_text = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), best.alias("best"))
    out = rows.select("doc_id", *KEY).join(per_text, list(KEY), "left")
    none = F.array().cast("array<long>")
    return out.select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("best.equal_words", F.lit(0)).cast("long").alias("equal_words"), F.coalesce(-F.col("best.n"), F.lit(0)).cast("long").alias("overlap_words"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs``, with their own columns, that no benchmark item overlaps."""
    keyed = _keyed(docs)
    found = overlaps(keyed.select(*KEY, "text"), benchmark, filter_bits).select(*KEY).distinct()
    return keyed.join(found, list(KEY), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
