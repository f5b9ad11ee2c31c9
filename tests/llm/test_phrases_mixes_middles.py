"""Phrase mining, mixing and fill-in-the-middle against plain loops."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from cardloom.llm import collocations, fim, mixture
from cardloom.llm.common import tune


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def mined(rows, least, longest, top, covered):
    """All phrases of all texts counted in one dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = [(lang, p) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    out = {}
    for lang, p in found:
        a = f[lang, p]
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(m == lang and len(q) > len(p) and inside(q) and 100 * f[m, q] >= covered * a for m, q in found):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], k))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s, k) for lang, rows in out.items() for i, (s, a, p, l, r, k) in enumerate(sorted(rows)[:top], 1))


def texts(seed, size):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "Straße", "été", "x", "a-b", "New", "York", "City", "日本", "q"]
    out = []
    for i in range(size):
        words = [vocabulary[j] for j in np.minimum(rng.geometric(0.3, int(rng.integers(0, 60))) - 1, len(vocabulary) - 1)]
        out.append("".join(w + " \t,\n.:"[int(j)] * int(k) for w, j, k in zip(words, np.minimum(rng.geometric(0.7, len(words)) - 1, 5), rng.integers(1, 3, len(words)), strict=True)) if i % 9 else "new york city of the of the été of")
    return out + [None, "", "  ", "...", "one", "the of " * 4000]


@pytest.mark.parametrize(("least", "longest", "top", "covered", "shards", "bits"), [(5, 5, 40, 100, 4, 26), (20, 4, 2000, 80, 3, 8), (2, 3, 7, 100, 1, 12)])
def test_mined_phrases_equal_brute_force(spark, least, longest, top, covered, shards, bits):
    rows = [(["en", "fr", None, "und", "en"][i % 5], t) for i, t in enumerate(texts(least, 120))]
    rows += rows[:10]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(docs, least, longest, top, covered, shards, bits).collect())
    assert got == mined(rows, least, longest, top, covered) and got


def test_counts_do_not_depend_on_parts_and_batches_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    tokens = rng.integers(-1, 6, 3000).astype(np.int32)
    keys = [rng.integers(1, 1 << 62, 6) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([*(pa.array([k]) for k in keys), pa.array([np.bincount(tokens[tokens >= 0])]), pa.array([tokens.tobytes()], pa.binary())], names=["h1", "h2", "counts", "tokens"])
    table = collocations.Bits(12)
    table.every[:] = np.uint64(2**64 - 1)
    table.recent = {0: table.every}

    def counted():
        got, rows = Counter(), []
        for out in collocations._counted(iter([batch]), table, 5, True):
            rows.append(out.num_rows)
            for length, h1, h2, _, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[length, h1, h2] += n
        return got, max(rows)

    whole, _ = counted()
    pieces = "".join(chr(97 + t) if t >= 0 else " " for t in tokens).split()
    assert sorted(whole.values()) == sorted(Counter(p[i : i + k] for k in range(1, 6) for p in pieces for i in range(len(p) - k + 1)).values())
    for name, value in (("PART_WORDS", 7), ("OUT_ROWS", 5), ("HELD", 50)):
        monkeypatch.setattr(collocations, name, value)
    parts, most = counted()
    assert parts == whole and most <= 5


def test_a_phrase_that_gets_frequent_in_the_last_shard_is_counted_in_all(spark, monkeypatch):
    """Each text is a shard of its own, so words, pairs and triples reach the threshold one round after another."""
    monkeypatch.setattr(collocations, "write_shards", lambda docs, path, shards, real=collocations.write_shards: real(docs, path, shards, 1))
    rows = [("en", t) for t in ["red fox runs. red", "fox runs", "red fox", "red fox runs far", "far red fox runs"]]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = sorted(tuple(r) for r in collocations.mine(docs, 3, 5, 10, 100, 5, 20).collect())
    assert got == mined(rows, 3, 5, 10, 100) and [r[2] for r in got] == ["fox runs", "red fox", "red fox runs"]


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(empty, longest=1)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 10**14, [3 * 10**13, 2 * 10**13], [10**13 + 7, 10**13 + 9])], "a long, n long, lefts array<long>, rights array<long>")
    got = row.select(collocations._score().alias("s")).first()["s"]
    assert [(x["score"], x["k"], x["l"], x["r"]) for x in got] == [(1000 * 10**27 // (l * r), k, l, r) for k, l, r in ((1, 3 * 10**13, 10**13 + 9), (2, 2 * 10**13, 10**13 + 7))]


def budgets(sizes, weights, share, most):
    """Targets by rounds: shares by weight, full sources fixed, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = Fraction(share * sum(sizes.values()), 100), {}
    while open_ := [s for s in names if s not in full]:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if part[s] > most * sizes[s]]
        if not above:
            return {**full, **part}
        for s in above:
            full[s] = Fraction(most * sizes[s])
            left -= full[s]
    return full


@pytest.mark.parametrize(("weights", "share", "most", "range_rows", "group"), [((3, 1, 2), 150, 2, 4000, 1024), ((3, 1, 2), 150, 2, 3, 2), ((1,), 40, 1, 5, 1), ((5, 1), 300, 3, 2, 3)])
def test_mixes_take_each_budget_exactly(spark, weights, share, most, range_rows, group):
    rng = np.random.default_rng(range_rows)
    rows = [(int(i), "w x " * int(k), s) for i, (k, s) in enumerate(zip(rng.integers(0, 30, 200), rng.choice(["a", "B", "é", "a b", ""], 200, p=[0.6, 0.1, 0.1, 0.1, 0.1]), strict=True))]
    rows += [(7, "same text here", "a")] * 90 + [(None, None, None)] * 4 + [(None, "x\x1cy", None), (None, "long " * 9000, "B"), (5, "", "none")]
    schema = "doc_id long, text string, source string, size string, key int"
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    runs = [sorted((tuple(r) for r in mixture.mix(d, weights, share, most, range_rows, group).collect()), key=repr) for d in (docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    count = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = budgets(sizes, weights, share, most)
    taken, order = Counter(), {}
    for _, size, source_size, target, words, source, before, epochs in runs[0]:
        taken[source] += words
        assert 0 <= words <= most * size and source_size == sizes[source] and target == pytest.approx(float(want[source])) and epochs * size <= words <= (epochs + 1) * size
        order.setdefault(source, []).append((before, size))
    assert all(taken[s] == int(want[s]) for s in sizes)
    for places in order.values():  # the places are those of one queue
        end = 0
        for before, size in sorted(places):
            assert before == end
            end += size
    assert sorted((i is None, i, count(t)) for i, t, _ in rows if i is not None) == sorted((i is None, i, k) for i, k, *_ in runs[0] if i is not None)


def test_an_empty_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture.mix(empty).collect() == []
    nothing = mixture.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], empty.schema)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_word_counts_and_keys(spark):
    values = ["", None, " a\tb c\x0bd\r\n", "x", "\x1c", "é è"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string").select(mixture.word_count().alias("n"), mixture.random_key().alias("k")).collect()
    assert [r.n for r in got] == [len(re.findall("[^ \t-\r]+", t or "")) for t in values]
    assert [r.k for r in got] == [int(hashlib.md5(f"{i}:{t or ''}".encode()).hexdigest()[:15], 16) for i, t in enumerate(values)]


def middle(doc_id, text, unit, rate, spm, seed):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), len(p.encode()), len(m.encode()), out


@pytest.mark.parametrize(("unit", "rate", "spm", "seed"), [("line", 100, 50, 7), ("char", 100, 50, 7), ("char", 60, 0, 1), ("line", 0, 100, 2)])
def test_middles_equal_brute_force(spark, unit, rate, spm, seed):
    rng = np.random.default_rng(seed)
    alphabet = [*"ab \n\n\r<PSM>", "é", "日", "😀", " "]
    rows = [(int(i), "".join(rng.choice(alphabet, int(n)))) for i, n in enumerate(rng.integers(0, 80, 150))]
    rows += [(None, None), (None, "x\ny"), (-5, ""), (3, "\n"), (3, "\n"), (4, "no line end"), (6, "é\n" * 70000 + "😀"), (8, "a<P"), (9, "<M>"), (10, "><S")]
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, output string, text string")
    made = fim.fill_in_middle(docs, unit, rate, spm, seed)
    got = made.select("*", fim.restored().alias("back")).collect()
    plain = lambda r: tuple((v is None, v) for v in r)
    assert sorted(plain(r)[:8] for r in got) == sorted(plain(middle(i, t, unit, rate, spm, seed)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.back) for r in got if r.doc_id is not None) == sorted((False, i, t or "") for i, t in rows if i is not None)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_the_index_converts_both_ways():
    text = "aé日😀b\nß" * 5 + "plain"
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in chars])
    assert index.bytes(chars).tolist() == places.tolist() and index.chars(places).tolist() == chars.tolist()
    assert len(fim.Exceptions(np.frombuffer(b"ascii only", np.uint8)).byte) == 0


def test_marks_that_cannot_be_found_again(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "cab", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=marks)
    with pytest.raises(Exception, match="unit"):
        fim.fill_in_middle(docs, unit="page").collect()
