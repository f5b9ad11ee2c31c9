"""Quality classifier: supervised subword embeddings.

Words, pairs of words and character 3- to 5-grams are hashed into a table of learned vectors; a document is the average of its
vectors, and a softmax layer on it gives the class. The model is trained by plain stochastic gradient descent
in numpy on a bounded sample of labelled documents. For scoring, table and output layer fold into one number
per bucket, so every whole text costs one lookup per word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Hasher, U, char_starts, lists, mix, pieces, word_bounds
from .common import give_back, held_out, sample_order

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: Most labelled documents of each class that the model is fitted on; and bytes of their texts after which no more are
#: taken (nor any that is longer by itself), so what reaches the driver is bounded, however long texts are.
SAMPLE = 800
SAMPLE_BYTES = 2 << 20
#: Odd factor that tells the first word of a pair from the second.
_PAIR = U(0x9FB21C651E98DF25)
#: Documents with this score or more are predicted to be of class 1.
THRESHOLD = 0.3


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text of each feature, bucket)``, first for words, then for pairs of words, then for each n-gram length; all stay within a text."""
    hasher = Hasher(data)
    starts, ends, first = word_bounds(data, off)
    words, own = hasher.at(starts, ends), np.repeat(np.arange(len(off) - 1), np.diff(first))
    yield own, (words % U(BUCKETS)).astype(np.int64)
    inside = own[1:] == own[:-1]
    yield own[1:][inside], (mix(words[:-1] * _PAIR + words[1:])[inside] % U(BUCKETS)).astype(np.int64)
    chars = char_starts(data)
    owner = np.searchsorted(off, chars[:-1], "right") - 1
    for n in GRAMS:
        if len(chars) <= n:
            continue
        start, end = chars[:-n], chars[n:]
        own = owner[: len(start)]
        inside = end <= off[own + 1]
        yield own[inside], (hasher.at(start[inside], end[inside]) % U(BUCKETS)).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags of features of labelled texts: ``label, buckets, weights`` (weights sum to 1)."""
    for batch in batches:
        for lo, hi, data, off in pieces(batch.column("text")):
            rows = hi - lo
            parts = [own * BUCKETS + bucket for own, bucket in features(data, off)]
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            begin = np.searchsorted(keys, np.arange(rows + 1) * BUCKETS)
            total = np.add.reduceat(np.append(counts, 0), begin[:-1]) * (np.diff(begin) > 0)
            weight = counts / np.repeat(np.maximum(total, 1), np.diff(begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(lo, rows), lists((keys % BUCKETS).astype(np.int32), begin, pa.int32()), lists(weight.astype(np.float32), begin, pa.float32())],
                names=["label", "buckets", "weights"],
            )


@dataclass
class Model:
    """``table[bucket]`` is the difference of the two classes' scores that a feature adds; ``bias`` that of none."""

    table: np.ndarray
    bias: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for own, bucket in features(data, off):
            total += np.bincount(own, self.table[bucket], rows)
            count += np.bincount(own, minlength=rows)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 6, rate: float = 0.2, seed: int = 1) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time, rate falling to zero; classes weigh the same."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    ones = sum(y for y, _, _ in bags)
    share = {0: len(bags) / max(1, 2 * (len(bags) - ones)), 1: len(bags) / max(1, 2 * ones)}
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            y, idx, weight = bags[i]
            done += 1
            if not len(idx):
                continue
            step = rate * share[y] * (1 - done / (steps + 1))
            mean = weight @ vectors[idx]
            score = mean @ out + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            # a text has thousands of features of small weight: the rate of the vectors is scaled up to that
            vectors[idx] -= (step * min(20.0, 1 / float(weight @ weight))) * np.outer(weight, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` documents and ``2 * sample_bytes`` bytes of each class, chosen by a hash of their ids among those not held out.

    Labels other than 0 and 1, NULL ids and repeated labels of an id (the smallest counts) are ignored; without
    labelled documents of both classes the model gives the share of class 1 (0.5 if there is none at all).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())  # two classes
    # a first cut by hash leaves about twice the sample of each class to be ranked
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, (2.0 * sample + 50) / n))]) if counts else F.create_map(F.lit(0), F.lit(0.0))
    near = known.where(F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(*sample_order())))
    chosen = ranked.where(F.col("n") <= sample).select("doc_id", "label")  # at most 2 * sample rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("label").orderBy(*sample_order(), "text").rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.where(F.col("size") <= sample_bytes).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_bytes)
    give_back(docs.sparkSession)
    rows = texts.select("label", "text").mapInArrow(_bags, "label int, buckets array<int>, weights array<float>").toArrow()
    ys = rows.column("label").to_numpy()
    bags = [(int(y), b.values.to_numpy(), w.values.to_numpy()) for y, b, w in zip(ys, rows.column("buckets"), rows.column("weights"), strict=True)]
    order = sorted(range(len(bags)), key=lambda i: (bags[i][0], len(bags[i][1]), bags[i][1].sum(), float(bags[i][2] @ bags[i][2]) if len(bags[i][1]) else 0.0))
    bags = [bags[i] for i in order]
    if len({b[0] for b in bags}) < 2:
        p = min(max(float(np.mean(ys)) if len(ys) else 0.5, 0.01), 0.99)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    model = fit(bags)
    del rows, bags
    give_back(docs.sparkSession)  # the driver has more to do
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; only the text is an input of the score.

    NULL and empty texts have no feature and get the model's bias; repeated rows get the same score; very long
    texts are scored whole; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(data, off) for _, _, data, off in pieces(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(data, off) for _, _, data, off in pieces(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
