"""Overlaps of which only a part is similar enough, against every stretch of the diagonal."""

import numpy as np
import pytest

from cardloom.llm import decontam
from cardloom.llm.common import tune


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def hashed(text):
    raw = text.encode()
    return decontam.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def overlap(item, text):
    return decontam.best_overlap(hashed(text), hashed(item))


def edited(same):
    item = [f"w{i}" for i in range(len(same))]
    return " ".join(item), " ".join(w if s else f"x{i}" for i, (w, s) in enumerate(zip(item, same, strict=True)))


@pytest.mark.parametrize(("core", "rounds"), [(15, 6), (12, 5), (24, 9)])
def test_an_edited_tail_does_not_hide_a_verbatim_core(core, rounds):
    same = [True] * core + [False, False, True, True, True, True, True] * rounds
    n, k = overlap(*edited(same))
    assert k >= decontam.WORDS and 5 * k >= 4 * n


def test_verification_equals_every_stretch():
    rng = np.random.default_rng(8)
    for _ in range(300):
        same = rng.random(int(rng.integers(6, 50))) < rng.uniform(0.5, 0.95)
        ends = [(lo, hi) for lo in range(len(same)) for hi in range(lo + 1, len(same) + 1) if 5 * same[lo:hi].sum() >= 4 * (hi - lo)]
        most = max((int(same[lo:hi].sum()) for lo, hi in ends), default=0)
        assert decontam._stretch(same)[1] == most


def brute(item, text):
    """Most equal words of a similar enough stretch on any diagonal that shares a seed, over all stretches."""
    a, b = text.split(), item.split()
    masks = decontam.MASKS if len(b) > 5 else ("1" * len(b),)
    best = 0
    for d in range(-len(b), len(a) + 1):
        same = [0 <= d + j < len(a) and a[d + j] == w for j, w in enumerate(b)]
        seeded = any(all(d + j + i < len(a) and j + d >= 0 and same[j + i] for i, c in enumerate(m) if c == "1") for m in masks for j in range(max(0, -d), min(len(b), len(a) - d) - len(m) + 1))
        if seeded:
            lo, hi = max(0, -d), min(len(b), len(a) - d)
            best = max([best, *(sum(same[x:y]) for x in range(lo, hi) for y in range(x + 1, hi + 1) if 5 * sum(same[x:y]) >= 4 * (y - x))])
    return best if b and best >= min(decontam.WORDS, len(b)) else 0


@pytest.mark.parametrize("bits", [26, 3])
def test_contamination_equals_brute_force(spark, bits):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(14)]
    pick = lambda n: [vocabulary[i] for i in rng.integers(0, 14, n)]
    items = [pick(int(n)) for n in (1, 2, 3, 4, 5, 6, 9, 14, 20, 30)] + [["a"] * 16]
    texts = [pick(int(rng.integers(0, 50))) for _ in range(20)] + [["a"] * 40, [], ["zz"]]
    for item in items[6:10]:
        for rate in (0.0, 0.1, 0.25):
            texts.append(pick(5) + [w if rng.random() >= rate else "other" for w in item] + pick(5))
    texts = [" ".join(t) for t in texts]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[-1], 2), (3, None, 3)], "doc_id long, text string, item_ids int")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(3, " ".join(items[3]))], "item_id long, text string")
    got = decontam.contamination(rows, bench, bits).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id is not None and (r.doc_id != 3 or r.contaminated):
            text = texts[r.doc_id]
            counts = [brute(" ".join(t), text) for t in items]
            assert (r.item_ids, r.equal_words) == ([i for i, n in enumerate(counts) if n], max(counts)), text
    kept = decontam.keep_clean(rows, bench, bits)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if not r.contaminated and r.doc_id is not None)
