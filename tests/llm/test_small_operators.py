"""Sharding, sketches, URL and license rules, quality and language: small cases and edge rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import langid, license_scan, quality, sharding, sketch, urlfilter
from cardloom.llm.common import tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans int, label string, rep string, row int"


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def docs(spark, texts, ids=None, lang="en"):
    rows = [((i if ids is None else ids[i]), t, lang if isinstance(lang, str) or lang is None else lang[i], "s", 0, 7, "l", "r", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["one two three four five six", "", None, "x", "a b c", "one two three four five six", "w " * 30000, "\x00é   ß", "   "]


def test_shards_are_near_equal_gapless_and_cover_every_row(spark):
    texts = ["t" * (i % 97) for i in range(3000)] + ODD
    rows = sharding.shard(docs(spark, texts), shards=6, slots=512).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size, place = {}, {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        place.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(6)) and max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 6 + 60_000
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    assert sharding.shard(docs(spark, [])).count() == 0
    same = sharding.shard(docs(spark, ["a", "b", "a"], [1, 1, None]), shards=2, slots=8)
    assert same.count() == 3


def test_slot_maps_are_edited_by_version(spark, tmp_path):
    rng = np.random.default_rng(0)
    load = rng.integers(0, 1000, 400).tolist()
    first = sharding.SlotMap.balanced(load, 8)
    assert max(first.totals()) - min(first.totals()) <= 1000
    load[:50] = [5000] * 50
    second = first.rebalance(load)
    worst = sharding.SlotMap(first.owner, load, 8)
    moved = sum(a != b for a, b in zip(first.owner, second.owner, strict=True))
    assert second.version == 2 and 0 < moved < 120 and max(second.totals()) - min(second.totals()) < max(worst.totals()) - min(worst.totals())
    third = second.grow()
    assert all(a == b or b == 8 for a, b in zip(second.owner, third.owner, strict=True)) and third.totals()[8] > 0.8 * sum(load) / 9
    for m in (first, second, third):
        m.store(spark, str(tmp_path / "map"))
    assert {r.version for r in spark.read.parquet(str(tmp_path / "map")).select("version").distinct().collect()} == {1, 2, 3}


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_of_texts_and_edits(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, n)) for n in (400, 90, 5, 3, 1200)] + ["", None, "A b  c\nd E f", "a B c d e F"]
    out = {r.doc_id: r for r in sketch.fingerprints(docs(spark, texts), bucket_rows=2).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for likeness, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(likeness - exact) < 0.15
    assert out[7].fingerprint == out[8].fingerprint != "" and out[5].fingerprint == out[6].fingerprint == ""
    assert out[7].edited_fingerprint and sketch.fingerprints(docs(spark, [])).count() == 0
    one = sketch.fingerprints(docs(spark, ["a b c d e f"], [None])).first()
    assert one.near_next == 1.0
    plan = sketch.fingerprints(docs(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(6)
    a = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000))
    b = " ".join(a.split()[:1000])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    # three standard errors of a resemblance of a third at k = 128
    got = row.select(sketch.merge(F.col("a"), F.col("b")).alias("m"), "a", sketch.containment(F.col("b"), F.col("a")).alias("c"), sketch.containment(F.col("a"), F.col("b")).alias("d"), sketch.distinct_count(F.col("a")).alias("n")).first()
    assert got.m == got.a and got.c > 0.62 and abs(got.d - 0.33) < 0.15 and abs(got.n - 2996) < 700
    parts = spark.createDataFrame([(1, a), (1, b), (2, b)], "k long, t string").select("k", sketch.sketch(F.col("t")).alias("s"))
    assert {r.k: r.s for r in sketch.merge_rows(parts, "k", "s").collect()}[1] == got.a


URLS = ["http://X.Example.com/en/1", "https://www.example.com/en/2", "http://a.www.example.com/en/", "http://example.com/fr/", "http://net/es/1", "http://a.net/fr/x?q", "http://a.net/en", "http://planet/es/", "http://com", "http://com/", None, "nothing", "http://a.com?x/en/", "ftp://u@h.net:8/es/", "://", "http://example.com/en", "http://notexample.com/en/"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, rule in urlfilter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


def test_url_verdicts_from_the_array_and_from_the_join(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    want = {i: brute(u) for i, u in enumerate(URLS)}
    for most in (1 << 20, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, most_bytes=most).collect()}
        assert got == want
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_digest_collisions_are_confirmed_by_string(tmp_path):
    index = urlfilter.DigestArray.build([("block", "a/"), ("allow", "b/"), ("allow", "a/")])
    index.save(str(tmp_path / "x"))
    mapped = urlfilter.DigestArray.map(str(tmp_path / "x"))
    assert isinstance(mapped.keys.base if mapped.keys.base is not None else mapped.keys, object) and len(mapped.keys) == 2
    wrong = mapped.probe(mapped.keys[:1], [b"another string"])
    right = mapped.probe(mapped.keys[:1], [mapped.entry(0)])
    assert wrong.tolist() == [-1] and right.tolist() == [0]


def test_license_texts_and_lines(spark):
    texts = ["released under the MIT licence!", "Copyright 2020 X\nReleased under the MIT License.\n", "prose\nLicensed under CC BY-NC 4.0.\nprose\nReleased under the MIT License.", "not a license", None, "", "x " * 50000]
    out = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert out[0] == ("MIT", "MIT", 1) and out[1] == ("MIT", "MIT", 1) and out[2] == (None, "CC-BY-NC-4.0,MIT", 2)
    assert all(out[i] == (None, "", 0) for i in (3, 4, 5, 6)) and license_scan.scan(docs(spark, [])).count() == 0


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    words = [f"plain{i}" for i in range(60)]
    texts, rows = [], []
    for i in range(n):
        good = i % 3 != 0
        w = rng.choice(words, 40)
        texts.append(" ".join(w) if good else "!! ".join(x.upper() for x in w))
        rows.append((i, int(good), "clash"))
    return docs(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_quality_learns_and_scores_whole_texts(spark):
    d, labels = labelled(spark)
    model = quality.train(d, labels)
    out = quality.score(d.unionByName(docs(spark, ODD, list(range(1000, 1000 + len(ODD))))), model).collect()
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out) and len(out) == 400 + len(ODD)
    empty = {r.doc_id: r.score for r in out}
    assert empty[1001] == empty[1002] and quality.score(docs(spark, []), model).count() == 0
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and 0.95 < kept.where("doc_id % 3 <> 0").count() / d.where("doc_id % 3 <> 0").count() <= 1.0
    shuffled = quality.train(d, labels.where("quality = 1"))
    assert shuffled.score(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0] > 0.9


def switched(spark):
    rng = np.random.default_rng(2)
    vocab = {"aa": ["tion", "the", "ing", "with"], "bb": ["ción", "que", "los", "para"]}
    texts, langs = [], []
    for i in range(300):
        lang = ("aa", "bb")[i % 2]
        texts.append(" ".join("".join(rng.choice(vocab[lang], 2)) for _ in range(30)))
        langs.append(lang)
    return docs(spark, texts, lang=langs), vocab


def test_language_of_documents_and_of_switched_words(spark):
    d, _ = switched(spark)
    model = langid.train(d, sample=60)
    out = langid.predict(d, model).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 30 and all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] and 0 <= r.score <= 1 for r in held)
    odd = {r.doc_id: r for r in langid.predict(docs(spark, ["12 34 !!", None, "", "жз", "the1", "thing " * 20000], lang=None), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred != "und" and odd[4].lang_pred != "und" and odd[5].lang_pred == "aa"
    text = "thetion ingwith withthe losque quepara ciónlos parción thething"
    row = langid.label_words(docs(spark, [text]), model).first()
    assert row.words == text.split() and row.languages == ["aa"] * 3 + ["bb"] * 4 + ["aa"]
    assert langid.predict(docs(spark, []), model).count() == 0
    assert langid.predict(docs(spark, ["x"]), langid.train(docs(spark, ["x"], lang=None))).first().lang_pred == "und"


@pytest.mark.parametrize("length", [1, 63, 64, 65, 300])
def test_forward_backward_equals_one_long_pass(length):
    rng = np.random.default_rng(length)
    unary, change = rng.normal(size=(length + 7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, length, length, length + 7])
    got = langid.marginals(unary, first, change)
    for lo, hi in ((0, length), (length, length + 7)):
        psi, move = np.exp(unary[lo:hi]), np.exp(change)
        alpha, beta = np.zeros_like(psi), np.ones_like(psi)
        v = np.full(3, 1 / 3)
        for t in range(hi - lo):
            v = (v @ move) * psi[t]
            v /= v.sum()
            alpha[t] = v
        for t in range(hi - lo - 2, -1, -1):
            v = move @ (psi[t + 1] * beta[t + 1])
            beta[t] = v / v.sum()
        p = alpha * beta
        assert np.allclose(got[lo:hi], p / p.sum(1, keepdims=True))
