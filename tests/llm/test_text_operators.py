"""BPE, decontamination, Jaccard join, suffix deduplication and the pipeline against brute force."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cardloom.llm import bpe, components, decontam, jaccard, suffix
from cardloom.llm.common import tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans int, label string, rep string, row int"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def docs(spark, texts, ids=None):
    return spark.createDataFrame([((i if ids is None else ids[i]), t, "en", "s", len(t or ""), 7, "l", "r", 1) for i, t in enumerate(texts)], DOCS)


TOKENS = bpe.load_ranks(PATH)
OFFICIAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
ENCODER = bpe.Encoder(TOKENS, public_tokenizers.PATTERN, kept_words=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeiothn   \n.'s1!"), st.characters(codec="utf-8"))), max_size=4))
def test_merge_replay_equals_the_library(texts):
    got = ENCODER.encode_batch(texts)
    assert [x.tolist() for x in got] == [OFFICIAL.encode_ordinary(t) for t in texts]
    assert [ENCODER.decode(x) for x in got] == [t.encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=12), min_size=1, max_size=6), st.permutations(["ab", "bc", "abc", "ca", "aa", "cab", "bca", "abca", "aaa", "cc"]))
def test_replay_follows_ranks_even_where_a_merge_makes_a_lower_one(words, merged):
    tokens = [bytes([b]) for b in range(256)] + [m.encode() for m in merged]
    official = tiktoken.Encoding("own", pat_str="[^ ]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    text = " ".join(words).replace(" ", "")
    assert bpe.Encoder(tokens, "[^ ]+").encode_batch([text])[0].tolist() == official.encode_ordinary(text)


def test_encode_and_decode_tables(spark):
    texts = ["Hello world's  text", "", None, "é" * 3000, "Hello world's  text"]
    rows = {r.doc_id: r for r in bpe.encode_and_check(docs(spark, texts), TOKENS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = OFFICIAL.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    out = bpe.encode(docs(spark, texts), TOKENS, public_tokenizers.PATTERN)
    assert out.columns[: len(DOCS.split(","))] == docs(spark, []).columns and out.where("decodes").count() == 5
    back = {r.doc_id: r.text for r in bpe.decode(out.selectExpr("doc_id", "token_ids AS ids"), TOKENS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} and bpe.encode(docs(spark, []), TOKENS, public_tokenizers.PATTERN).count() == 0


def words(rng, n, size=5000):
    return [f"w{x}" for x in rng.integers(0, size, n)]


def test_contamination_tolerates_substitutions_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(3)
    items = [words(rng, n) for n in (40, 25, 16, 8, 4)]
    changed = list(items[0])
    for i in (3, 11, 19, 27, 35):
        changed[i] = "other"
    host = lambda passage: " ".join(words(rng, 60) + passage + words(rng, 60))
    texts = [host(items[0]), host(changed), host(items[0][10:30]), host(items[1]), host([w.upper() + "," for w in items[2]]), host(items[3]), host(items[4]), host([]), host(items[0][:6]), None, "", " ".join(items[1]), host(words(rng, 20000) + items[1])]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (1, " ".join(items[1]))], "item_id long, text string")
    want = [[0], [0], [0], [1], [2], [3], [4], [], [], [], [], [1], [1]]
    for bits in (26, 4):
        out = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.contamination(docs(spark, texts), benchmark, bits).collect()}
        assert out == {i: (bool(w), w) for i, w in enumerate(want)}
    kept = decontam.keep_clean(docs(spark, texts), benchmark, 4)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w] and kept.columns == docs(spark, []).columns
    none = decontam.contamination(docs(spark, texts), benchmark.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_classes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    passage = words(rng, 30)
    for _ in range(12):  # chains of near copies, of which the ends are not near each other
        base = words(rng, int(rng.integers(20, 120)))
        for step in range(5):
            texts.append(" ".join(base))
            base = list(base)
            base[int(rng.integers(0, len(base)))] = f"new{step}"
    texts += [" ".join(words(rng, 20) + passage + words(rng, 25)) for _ in range(60)]  # a passage that many share
    hub = words(rng, 150)
    for i in range(80):  # near copies of one text that are far from each other
        copy = list(hub)
        for j in rng.integers(0, 150, 2):
            copy[int(j)] = f"x{i}"
        texts.append(" ".join(copy))
    texts += ["a b c", "A  b\tc", "a b", None, "", "   ", "one two three four five", "One two three four FIVE", texts[0].upper(), texts[0], "z " * 20000, "y " * 20000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(docs(spark, texts)).collect()}
    assert got == classes(texts)
    kept = jaccard.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in classes(texts).values()}) and kept.columns == docs(spark, []).columns
    assert jaccard.link_classes(docs(spark, [])).count() == 0 and jaccard.keep_one(docs(spark, [])).count() == 0
    twice = jaccard.link_classes(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [5, 5, None])).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(twice, key=lambda r: r.doc_id or 0)] == [(None, 5), (5, 5), (5, 5)]
    assert jaccard.keep_one(docs(spark, ["a b c", "a b c", None], [5, 5, None])).count() == 2


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (200, 199)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140)) and found[200] == 199
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [200, 1])
def test_suffix_removal_equals_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = [text(n) for n in (150, 210, 260, 400)]
    texts = [text(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 4))] + text(int(rng.integers(0, 300))) for _ in range(40)]
    texts += ["a" * 450, "ab" * 300, texts[0], texts[0], None, "", "x" * 199, text(250) + shared[2][:205] + shared[3][100:305], "\x00" * 230, shared[1] + shared[1]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removal(docs(spark, texts), hot=hot).collect()}
    assert got == dict(enumerate(repeats(texts, 200)))
    cut = {r.doc_id: r for r in suffix.cut_repeats(docs(spark, texts), hot=hot).collect()}
    assert cut[44].text is None and cut[40].text == "" and cut[40].n_chars == 0 and len(cut) == len(texts)
    assert suffix.removal(docs(spark, [])).count() == 0
    loose = suffix.removal(docs(spark, ["q" * 250, "r" * 10], [None, None])).collect()
    assert sorted(r.n_removed for r in loose) == [0, 250]


def test_family_decides_every_window_and_merges_levels_geometrically():
    rng = np.random.default_rng(9)
    length, k = 6, 3
    anchor = np.frombuffer(b"".join(bytes(rng.integers(97, 99, 3).astype(np.uint8)) for _ in range(200)), np.uint8).reshape(-1, 3)
    texts, places = [], []
    for a in anchor:  # the anchor with up to three bytes before and after it
        before, after = (bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 4, 2))
        texts.append(before + a.tobytes() + after)
        places.append(len(before))
    groups = np.array([int.from_bytes(a.tobytes()) for a in anchor])
    family = suffix.Family(length, k)
    for i in range(0, 200, 8):
        family.add(texts[i : i + 8], np.array(places[i : i + 8]), groups[i : i + 8], np.zeros(8, bool))
    windows = [(e, j, t[p - j : p - j + length]) for e, (t, p) in enumerate(zip(texts, places, strict=True)) for j in range(length - k + 1) if p - j >= 0 and p - j + length <= len(t)]
    count = Counter((j, w) for _, j, w in windows)
    want = np.zeros((200, length - k + 1), bool)
    for e, j, w in windows:
        want[e, j] = count[j, w] > 1
    assert np.array_equal(family.windows, want) and want.any() and not want.all()
    sizes = [len(level.at) for level in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 6 and sum(sizes) == 200
    for level in family.levels:  # suffixes stand in order
        ends = [level.text[a:h].tobytes()[:length] for a, h in zip(level.at, level.high, strict=True)]
        assert ends == sorted(ends)


def test_different_texts_under_one_id_keep_their_own_bytes(spark):
    rng = np.random.default_rng(18)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    copied, alone = text(500), text(509)
    rows = [copied, alone, copied, "z" * 50 + copied[100:420]]
    out = suffix.removal(docs(spark, rows, [5, 5, 6, None])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == sorted((b[0], b[1]) for b in repeats(rows, 200))
    twice = suffix.removal(docs(spark, [copied, copied, alone], [5, 5, 5])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in twice) == [(500, 500), (500, 500), (509, 0)]


def test_pipeline_decisions_take_effect(spark, tmp_path):
    rng = np.random.default_rng(10)
    good = [" ".join(words(rng, 80)) for _ in range(150)]
    junk = ["!! ".join(w.upper() for w in words(rng, 60)) for _ in range(60)]
    item, shared = " ".join(words(rng, 30)), " ".join(words(rng, 60))
    extra = [good[0], good[1] + " tail", " ".join(words(rng, 60)) + " " + item + " " + " ".join(words(rng, 60)), " ".join(words(rng, 400)) + " " + shared, " ".join(words(rng, 400)) + " " + shared, None, ""]
    texts = good + junk + extra
    d = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(150)) <= set(out) and not set(range(150, 210)) & set(out)
    assert 210 not in out and 211 not in out and 212 not in out and 213 in out and 214 in out
    assert shared not in out[213].text and shared not in out[214].text and out[213].decodes and out[213].n_tokens == len(out[213].token_ids)
    assert out[5].token_ids == OFFICIAL.encode_ordinary(good[5])
    assert len(corpus_pipeline.STAGES) == 5 and base64


def test_chunks_split_only_where_no_token_goes_on():
    texts = ["a b", " a  b c", "x .. y", "don't 's 'll", "café été да нет", "a  b", "　 x 　y   z", "日本 語 x", "1 2 3  ", "a é", " ", "q\n r \n\n s", "\U0001f600 \U0001f600 a", "x\x85 y", "  a  "]
    for kept in (1, 1000):
        encoder = bpe.Encoder(TOKENS, public_tokenizers.PATTERN, kept_words=kept)
        assert [x.tolist() for x in encoder.encode_batch(texts)] == [OFFICIAL.encode_ordinary(t) for t in texts]


def test_encoded_columns_replace_clashing_ones(spark):
    clashing = docs(spark, ["a b", None]).selectExpr("*", "1 AS N_TOKENS", "'x' AS token_ids")
    out = bpe.encode(clashing, TOKENS, public_tokenizers.PATTERN)
    assert out.columns[-3:] == ["n_tokens", "token_ids", "decodes"] and sorted(r.n_tokens for r in out.collect()) == [0, 2]
