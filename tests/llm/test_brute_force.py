"""Fingerprints, slopes, features, slot maps and URL rules against plain loops."""

import hashlib
import itertools
import os
import re
import struct

import numpy as np
import pytest
import xxhash

from cardloom.llm import decontam, langid, quality, sharding, sketch, urlfilter
from cardloom.llm.bytetext import Hasher
from cardloom.llm.common import held_out, tune


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def bottom(text, k):
    """The ``k`` smallest distinct hashes of the five-word shingles, word by word."""
    words = [w for w in re.split("[ \\t-\\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    hashes = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)))[0] for w in words]

    def fold(values):
        out = 42
        for v in values:
            out = xxhash.xxh64_intdigest(struct.pack("<q", v), out)
        return struct.unpack("<q", struct.pack("<Q", out))[0]

    runs = [hashes[i : i + 5] for i in range(len(hashes) - 4)] if len(hashes) >= 5 else [hashes] if hashes else []
    return sorted({fold(r) for r in runs})[:k]


@pytest.mark.parametrize(("rows_a_range", "ranges"), [(2000, 1 << 16), (1, 1 << 16), (3, 4)])
def test_fingerprints_equal_brute_force(spark, rows_a_range, ranges):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 40, int(n))) for n in rng.integers(0, 90, 40)] + ["", None, "a b", "É é\tx  y\nz q", "w " * 3000]
    ids = [int(x) for x in rng.permutation(len(texts) - 6) * 3 - 20] + [500] * 3 + [None] * 3
    rows = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, sketch string")
    k = 16
    got = sketch.fingerprints(rows, k, rows_a_range, ranges).collect()
    least = -(1 << 63)
    tie = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda r: (-(r[0] if r[0] is not None else least), tie(r[1]), r[1]))
    hexed = lambda values: "".join(f"{v % (1 << 64):016x}" for v in values)

    def like(a, b):
        union = sorted({*a, *b})[:k]
        return len({*a} & {*b} & {*union}) / len(union) if union else 1.0

    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = bottom(t, k), bottom(edited, k), bottom(after, k)
        want.append((i is None, i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    have = [(r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got]
    assert sorted(have, key=lambda r: (r[0], r[1] or 0, *r[2:])) == sorted(want, key=lambda r: (r[0], r[1] or 0, *r[2:]))


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(6)
    n, length, k = 3, 4, 3
    unary, change, seen = rng.normal(size=(n, length, k)), rng.normal(size=(k, k)), rng.integers(0, k, (n, length))

    def loss(unary, change):
        """Negative log-likelihood over all label sequences, any label standing before the first."""
        def weight(i, labels):
            return sum(unary[i, t, y] for t, y in enumerate(labels)) + sum(change[a, b] for a, b in itertools.pairwise(labels)) + np.log(np.exp(change[:, labels[0]]).sum())

        return sum(np.log(sum(np.exp(weight(i, y)) for y in itertools.product(range(k), repeat=length))) - weight(i, seen[i]) for i in range(n))

    by_word, by_change = langid.slopes(unary, change, seen)
    step = 1e-6
    for at in np.ndindex(unary.shape):
        up, down = unary.copy(), unary.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(up, change) - loss(down, change)) / (2 * step) - by_word[at]) < 1e-5
    for at in np.ndindex(change.shape):
        up, down = change.copy(), change.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(unary, up) - loss(unary, down)) / (2 * step) - by_change[at]) < 1e-5


def test_quality_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.2)
    texts = ["one two  two three", "", None, "é ñandú é", "x", "aaaa aaaa aaaa " * 900, "one two  two three"]

    def hashed(b):
        return int(Hasher(np.frombuffer(b, np.uint8)).at(np.array([0]), np.array([len(b)]))[0])

    def plain(text):
        words, total = [hashed(w.encode()) for w in (text or "").split()], []
        total += [w % quality.BUCKETS for w in words]
        total += [int(quality.mix(np.array([(a * int(quality._PAIR) + b) % (1 << 64)], np.uint64))[0]) % quality.BUCKETS for a, b in itertools.pairwise(words)]
        total += [hashed((text or "")[i : i + n].encode()) % quality.BUCKETS for n in quality.GRAMS for i in range(len(text or "") - n + 1)]
        return 1 / (1 + np.exp(-(float(np.mean(model.table[total])) if total else 0.0) - model.bias))

    rows = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in quality.score(rows, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert abs(got[i].score - plain(t)) < 1e-6 and got[i].predicted == int(got[i].score >= 0.3)


def test_the_stored_map_is_read_back_and_edited(spark, tmp_path):
    store = str(tmp_path / "map")
    rows = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    texts = ["t" * (i % 50) for i in range(2000)]
    first = {r.doc_id: r for r in sharding.shard(rows(texts), 5, 256, store).collect()}
    again = {r.doc_id: r for r in sharding.shard(rows(texts), 5, 256, store).collect()}
    assert {i: r.shard for i, r in first.items()} == {i: r.shard for i, r in again.items()} and again[0].map_version == 1
    more = texts + ["u" * 400 for _ in range(300)]
    third = {r.doc_id: r for r in sharding.shard(rows(more), 5, 256, store).collect()}
    moved = sum(third[i].shard != first[i].shard for i in first)
    total = [sum(r["size"] for r in third.values() if r.shard == s) for s in range(5)]
    assert third[0].map_version == 2 and 0 < moved < 700 and max(total) - min(total) < 0.03 * sum(total) / 5
    assert sharding.SlotMap.stored(spark, store, 1).owner != sharding.SlotMap.stored(spark, store).owner
    grown = {r.doc_id: r for r in sharding.shard(rows(more), 6, 256, store).collect()}
    assert {r.shard for r in grown.values()} == set(range(6)) and grown[0].map_version > 2
    with pytest.raises(ValueError, match="slots are fixed"):
        sharding.shard(rows(more), 3, 256, store)
    assert sharding.SlotMap.stored(spark, str(tmp_path / "none")) is None


def test_records_of_one_id_spread_over_the_shards(spark):
    rows = spark.createDataFrame([((7, None)[i % 2], f"text {i} " * 9) for i in range(1200)], "doc_id long, text string")
    total = {}
    for r in sharding.shard(rows, 6, 512).collect():
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    assert len(total) == 6 and max(total.values()) - min(total.values()) < 0.05 * sum(total.values()) / 6


RULES = [("block", "com/"), ("allow", "com/"), ("block", "a.com/x/"), ("allow", "net/"), ("block", "net/y"), ("block", "net/")]


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_url_rules_do_not_depend_on_how_they_are_looked_up(spark, most):
    urls = ["http://a.com/x/1", "http://b.A.com/x/", "http://com/", "http://xcom/", "https://q.net/yes?z", "net", None, "", "://", "http://a.com/" + "p/" * 40000, "http://" + "s." * 3000 + "net/y", "http://a.com/x/1", "http://é.net/y/é#x"]
    rows = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host, best = host.lower(), None
        for verdict, entry in dict((e, (v, e)) for v, e in RULES).values():
            h, p = entry[: entry.index("/")], entry[entry.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(entry) > len(best[1])):
                best = verdict, entry
        return host, path, best and best[1], best[0] if best else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows, RULES, most).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}


def judged(url, rules):
    """The rules gone over one by one."""
    if url is None or "://" not in url:
        return None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path, host = re.match("[^?#]*", rest[len(host) :])[0], host.lower()
    fits = []
    for entry, verdict in {e: v for v, e in rules}.items():
        h, p = (entry[: entry.index("/")], entry[entry.index("/") :]) if "/" in entry else (entry, "")
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(entry.encode()), len(h.encode()), entry, verdict))
    return max(fits)[2:] if fits else (None, "allow")


def test_ties_and_entries_without_a_path(spark):
    rng = np.random.default_rng(8)
    pick = lambda values, least, most: list(rng.choice(values, int(rng.integers(least, most))))
    rules = [("allow", "com/xyz"), ("block", "a.com/x"), ("block", "b.com"), ("allow", "b.com/"), ("block", "é")]
    rules += [(str(rng.choice(["allow", "block"])), ".".join(pick(["a", "b", "com", "é"], 1, 4)) + ("/" + "".join(pick(["x", "y", "é", "/"], 0, 4)) if rng.random() < 0.8 else "")) for _ in range(150)]
    urls = ["http://a.com/xyz", "http://b.com", "http://q.b.com/", "http://b.com?x", "http:///b.com"]
    urls += ["http://" + ".".join(pick(["a", "b", "com", "A", "é"], 1, 5)) + "/" + "".join(pick(["x", "y", "é", "/"], 0, 6)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: judged(u, rules) for i, u in enumerate(urls)}
    for most in (0, 64 << 20):
        assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(rows, rules, most).collect()} == want
    assert want[0] == ("a.com/x", "block") or want[0][0].startswith("a.com")


def test_many_entries_cost_a_batch_no_more(tmp_path):
    import time

    took = []
    for n in (5, 100_000):
        urlfilter.DigestArray.build([("block", f"h{i}.com/p{i % 7}") for i in range(n)]).save(str(tmp_path / str(n)))
        index = urlfilter.DigestArray.map(str(tmp_path / str(n)))
        hosts = [f"h{i % 5}.com" for i in range(512)]
        urlfilter._longest(index, hosts, ["/p1x"] * 512)
        begun = time.perf_counter()
        urlfilter._longest(index, hosts, ["/p1x"] * 512)
        took.append(time.perf_counter() - begun)
        assert index.lengths.tolist() == [3]
    assert took[1] < 20 * took[0] + 0.05


def test_training_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    bags = [(int(i % 2), np.unique(rng.integers(0, 40, 9)).astype(np.int32), None) for i in range(12)] + [(1, np.zeros(0, np.int32), np.zeros(0, np.float32))]
    bags = [(y, b, np.full(len(b), 1 / max(1, len(b)), np.float32) if w is None else w) for y, b, w in bags]
    got = quality.fit(bags, dim=3, epochs=2, rate=0.1, seed=4)
    rng = np.random.default_rng(4)
    vectors = ((rng.random((quality.BUCKETS, 3)) - 0.5) / 3)[:40].tolist()
    out, bias = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0]
    ones, done = sum(y for y, _, _ in bags), 0
    share = [len(bags) / (2 * (len(bags) - ones)), len(bags) / (2 * ones)]
    for _ in range(2):
        for i in rng.permutation(len(bags)):
            y, idx, weight = bags[i]
            done += 1
            if not len(idx):
                continue
            step = 0.1 * share[y] * (1 - done / (2 * len(bags) + 1))
            mean = [sum(w * vectors[b][d] for b, w in zip(idx, weight, strict=True)) for d in range(3)]
            score = [sum(mean[d] * out[d][c] for d in range(3)) + bias[c] for c in (0, 1)]
            e = [np.exp(s - max(score)) for s in score]
            slope = [e[c] / sum(e) - (c == y) for c in (0, 1)]
            back = [sum(out[d][c] * slope[c] for c in (0, 1)) for d in range(3)]
            for d in range(3):
                for c in (0, 1):
                    out[d][c] -= step * mean[d] * slope[c]
            for c in (0, 1):
                bias[c] -= 0.1 * step * slope[c]
            scale = step * min(20.0, 1 / sum(w * w for w in weight))
            for b, w in zip(idx, weight, strict=True):
                for d in range(3):
                    vectors[b][d] -= scale * w * back[d]
    want = [sum(v[d] * (out[d][1] - out[d][0]) for d in range(3)) for v in vectors]
    assert np.allclose(got.table[:40], want, rtol=1e-3, atol=1e-5) and abs(got.bias - (bias[1] - bias[0])) < 1e-5


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags: seen.append(len(bags)) or quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))
    docs = spark.createDataFrame([(i, "word " * (400 if i % 10 else 9000)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    quality.train(docs, labels, sample_bytes=20_000)  # texts of 2000 bytes; those of 45000 are over the bound by themselves
    quality.train(docs, labels, sample=7)
    assert seen == [20, 14]


def test_no_single_feature_decides(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = docs.join(labels.where("quality in (0, 1)"), "doc_id").where(held_out()).select("text", "quality").collect()
    texts = [np.frombuffer((r.text or "").encode(), np.uint8) for r in rows]
    decided = lambda m: np.array([m.score(t, np.array([0, len(t)]))[0] >= quality.THRESHOLD for t in texts])
    first = decided(model)
    assert np.mean(first == np.array([r.quality == 1 for r in rows])) > 0.9
    for bucket in np.argsort(-np.abs(model.table))[:4]:
        table = model.table.copy()
        table[bucket] = 0
        assert np.mean(decided(quality.Model(table, model.bias)) != first) < 0.02


@pytest.mark.parametrize(("n", "changed", "least"), [(15, 2, 0.999), (15, 3, 0.98), (20, 4, 0.98), (40, 8, 0.999)])
def test_masks_find_overlaps_with_changed_words(n, changed, least):
    rng = np.random.default_rng(n + changed)
    found, trials = 0, 2000
    for _ in range(trials):
        words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = words.copy()
        other[rng.choice(n, changed, replace=False)] ^= np.uint64(1)
        found += any((decontam._masked(words, m) == decontam._masked(other, m)).any() for m in decontam.MASKS)
    assert found / trials >= least
