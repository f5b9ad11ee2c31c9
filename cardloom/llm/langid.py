"""Language ID by a linear-chain conditional random field over words.

Each word has features (itself as a lexicon entry, prefixes, suffixes, character 2- and 3-grams) whose learned
weights score the languages; learned transitions score language changes between neighbours. Forward-backward
gives each word's probability of each language, so code-switched text is labelled word by word, and a document
takes the language with the most probability over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Hasher, U, char_starts, lower_ascii, pieces, word_bounds
from .common import held_out, sample_order

BUCKETS = 1 << 18
#: Most documents of each language that the model is fitted on.
SAMPLE = 150
UNKNOWN = "und"
_SCALE = 6.0
_STEP = 64


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word of each feature, bucket)`` for the given words of a byte array."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher, chars = Hasher(data), char_starts(data)
    first, last = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    owner, kinds = [np.arange(n)], [hasher.at(starts, ends)]
    for j in (1, 2, 3):
        fits = np.flatnonzero(last - first >= j)
        for salt, (s, e) in ((2 * j, (starts[fits], chars[first[fits] + j])), (2 * j + 1, (chars[last[fits] - j], ends[fits]))):
            owner.append(fits)
            kinds.append(hasher.at(s, e) * U(2 * salt + 1) + U(salt))
    for j in (2, 3):
        count = np.maximum(last - first - j + 1, 0)
        own = np.repeat(np.arange(n), count)
        at = np.repeat(first, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        owner.append(own)
        kinds.append(hasher.at(chars[at], chars[at + j]) * U(101 + 2 * j))
    return np.concatenate(owner), ((np.concatenate(kinds) >> U(20)) % U(BUCKETS)).astype(np.int64)


def _unary(weights: np.ndarray, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Scores of each word for each language: the mean of its features' weights, scaled."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, column[bucket], n) for column in weights.T], 1) * (_SCALE / count)[:, None]


def marginals(unary: np.ndarray, first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences at once: probability of each language for each word.

    Sequences are cut into stretches of ``_STEP`` words. The stretches' transfer matrices give the messages at
    every cut, and then all stretches run side by side; the result is that of one long pass.
    """
    n, k = unary.shape
    if n == 0:
        return np.zeros((0, k))
    psi, move = np.exp(unary - unary.max(1, keepdims=True)), np.exp(change - change.max())
    per = np.diff(first)
    cuts = -(-per // _STEP)
    head = np.concatenate([[0], np.cumsum(cuts)]).astype(np.int64)
    total = int(head[-1])
    start = np.repeat(first[:-1], cuts) + (np.arange(total) - np.repeat(head[:-1], cuts)) * _STEP
    size = np.minimum(np.repeat(first[1:], cuts) - start, _STEP)
    index = start[:, None] + np.minimum(np.arange(_STEP), size[:, None] - 1)
    inside = np.arange(_STEP) < size[:, None]
    local = psi[index]  # total, step, k
    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(int(size.max())):
        new = carry @ move * local[:, t, None, :]
        new /= new.sum((1, 2), keepdims=True)
        carry = np.where(inside[:, t, None, None], new, carry)
    left, right = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    for c in range(1, int(cuts.max(initial=0))):
        at = (head[:-1] + c)[cuts > c]
        v = (left[at - 1, None, :] @ carry[at - 1])[:, 0]
        left[at] = v / v.sum(1, keepdims=True)
        at = (head[1:] - 1 - c)[cuts > c]
        v = (carry[at + 1] @ right[at + 1, :, None])[:, :, 0]
        right[at] = v / v.sum(1, keepdims=True)
    out = np.empty((total, _STEP, k))
    alpha = left
    for t in range(_STEP):
        alpha = alpha @ move * local[:, t]
        alpha /= alpha.sum(1, keepdims=True)
        out[:, t] = alpha
    beta = right
    for t in range(_STEP - 1, -1, -1):
        use = inside[:, t, None]
        both = out[:, t] * beta
        out[:, t] = both / both.sum(1, keepdims=True)
        new = (local[:, t] * beta) @ move.T
        beta = np.where(use, new / new.sum(1, keepdims=True), beta)
    return out[inside]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    change: np.ndarray

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, ends, first, probability of each language for each word)``."""
        low = lower_ascii(data)
        starts, ends, first = word_bounds(low, off)
        # each distinct word is scored once
        _, where, back = np.unique(Hasher(low).at(starts, ends), return_index=True, return_inverse=True)
        owner, bucket = word_features(low, starts[where], ends[where])
        unary = _unary(self.weights, owner, bucket, len(where))[back] if len(where) else np.zeros((0, len(self.languages)))
        return starts, ends, first, marginals(unary, first, self.change)

    def documents(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (an index), its share of the probability, and whether any word has a letter."""
        starts, ends, first, p = self.words(data, off)
        letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
        own = np.repeat(np.arange(len(off) - 1), np.diff(first))
        use = letter[ends] > letter[starts]
        total = np.stack([np.bincount(own[use], column[use], len(off) - 1) for column in p.T], 1)
        best, count = total.argmax(1), np.bincount(own[use], minlength=len(off) - 1)
        return best, total[np.arange(len(best)), best] / np.maximum(count, 1), count > 0


#: ASCII letters, and bytes of other code points (checked in full where a text has nothing else).
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def slopes(unary: np.ndarray, change: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood of the labels ``seen`` (sequence, word): by each word's scores, and by the
    transitions (summed). They are what the model expects, by forward-backward, less what was seen."""
    n, length, k = unary.shape
    psi, move = np.exp(unary - unary.max(2, keepdims=True)), np.exp(change - change.max())
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    v = np.full((n, k), 1 / k)
    for t in range(length):
        v = v @ move * psi[:, t]  # any language may come before the first word
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    for t in range(length - 2, -1, -1):
        v = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = v / v.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move * (psi * beta)[:, 1:, None, :]
    start = move * (psi[:, 0] * beta[:, 0])[:, None, :]
    pair = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1)) + (start / start.sum((1, 2), keepdims=True)).sum(0)
    np.subtract.at(pair, (seen[:, :-1].ravel(), seen[:, 1:].ravel()), 1)
    np.subtract.at(pair.T, seen[:, 0], (move / move.sum(0)).T[seen[:, 0]])
    p.reshape(-1, k)[np.arange(n * length), seen.ravel()] -= 1
    return p, pair


def fit(texts: list[tuple[str, bytes]], languages: list[str], epochs: int = 4, length: int = 64, batch: int = 128, rate: float = 0.5, seed: int = 3) -> Model:
    """Train by adaptive stochastic gradient on the exact CRF gradient.

    Sequences of ``length`` words are put together from stretches of the labelled texts, so that languages
    change inside them and the transitions have something to learn from.
    """
    rng, k = np.random.default_rng(seed), len(languages)
    data = lower_ascii(np.frombuffer(b"".join(t for _, t in texts), np.uint8))
    off = np.cumsum([0, *(len(t) for _, t in texts)])
    starts, ends, first = word_bounds(data, off)
    label = np.repeat([languages.index(lang) for lang, _ in texts], np.diff(first))
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    _, where, back = np.unique(Hasher(data).at(starts, ends), return_index=True, return_inverse=True)
    owner, bucket = word_features(data, starts[where], ends[where])
    order = np.argsort(owner, kind="stable")
    bucket, begin = bucket[order], np.searchsorted(owner[order], np.arange(len(where) + 1))
    weights, grown = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-8)
    change, change_grown = np.zeros((k, k)), np.full((k, k), 1e-8)
    words = np.arange(len(starts))
    for _ in range(epochs):
        stretch = np.cumsum(np.concatenate([[1], (rng.random(max(len(words) - 1, 0)) < 1 / 12) | (own[1:] != own[:-1])]))
        rank = rng.permutation(int(stretch[-1]) + 1)[stretch]
        shuffled = words[np.argsort(rank, kind="stable")]
        shuffled = shuffled[: len(shuffled) // length * length] if len(shuffled) >= length else np.resize(shuffled, length)
        rows = shuffled.reshape(-1, length)
        for lo in range(0, len(rows), batch):
            at = rows[lo : lo + batch]
            used, local = np.unique(back[at], return_inverse=True)
            count = begin[used + 1] - begin[used]
            feature = bucket[np.repeat(begin[used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            word = np.repeat(np.arange(len(used)), count)
            unary = _unary(weights, word, feature, len(used))[local].reshape(*at.shape, k)
            p, pair = slopes(unary, change, label[at])
            error = np.stack([np.bincount(local.ravel(), p[:, :, j].ravel(), len(used)) for j in range(k)], 1) * (_SCALE / np.maximum(count, 1))[:, None]
            touched, slot = np.unique(feature, return_inverse=True)
            slope = np.stack([np.bincount(slot, error[word, j], len(touched)) for j in range(k)], 1) / len(at)
            grown[touched] += slope**2
            weights[touched] -= rate * slope / np.sqrt(grown[touched])
            pair /= at.size
            change_grown += pair**2
            change -= 0.2 * pair / np.sqrt(change_grown)
    return Model(languages, weights.astype(np.float32), change)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` whole documents of each language, chosen by a hash of the id among those with a
    language and not held out. Without any, the only language is ``und``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = usable.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)))
    # a first cut by hash leaves about twice the sample of each language to be ranked
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2.0 * sample + 50) / r["count"]))])
    near = usable.where(F.pmod(F.xxhash64(F.lit("cut"), "doc_id"), F.lit(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20))
    ranked = near.select("doc_id", "lang", "text").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*sample_order(), "text")))
    rows = ranked.where(F.col("n") <= sample).select("lang", "n", "text").collect()
    texts = sorted((r["lang"], r["n"], r["text"]) for r in rows)
    return fit([(lang, text.encode()) for lang, _, text in texts], sorted({t[0] for t in texts}))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``, from the text alone.

    A NULL text, or one without a letter, is ``und`` with score 0. Very long texts are labelled whole; repeated
    rows get the same answer; ties go to the first language by name; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for batch in batches:
            lang, score = [], []
            for lo, _, data, off in pieces(batch.column("text")):
                best, share, found = shared.value.documents(data, off)
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                plain = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                for i in np.flatnonzero(found & ~plain):
                    found[i] = any(map(str.isalpha, batch.column("text")[lo + int(i)].as_py() or ""))
                lang.append(np.where(found, names[best], UNKNOWN))
                score.append(np.where(found, np.clip(share, 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(lang) if lang else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, words, languages, probabilities``: each word of each text with its most probable language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, langs, probs = [], [], []
            for _, _, data, off in pieces(batch.column("text")):
                starts, ends, first, p = shared.value.words(data, off)
                raw, best = data.tobytes(), p.argmax(1)
                for i in range(len(off) - 1):
                    span = range(first[i], first[i + 1])
                    words.append([raw[starts[j] : ends[j]].decode() for j in span])
                    langs.append([shared.value.languages[best[j]] for j in span])
                    probs.append([float(p[j, best[j]]) for j in span])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(langs, pa.list_(pa.string())), pa.array(probs, pa.list_(pa.float64()))], names=["doc_id", "words", "languages", "probabilities"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<string>, languages array<string>, probabilities array<double>")
