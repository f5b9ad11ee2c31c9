"""Repeated rows, several texts under one id, ties and clashing columns."""

import numpy as np
import pytest

from cardloom.llm import jaccard, langid, license_scan, suffix
from cardloom.llm.common import tune


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_texts_under_one_id_are_linked_by_any_of_them(spark):
    rng = np.random.default_rng(1)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda x: x[:30] + ["changed"] + x[31:]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join(near(b))), (3, " ".join(near(a))), (7, " ".join(c)), (7, " ".join(c)), (None, " ".join(c)), (None, " ".join(near(c))), (None, None), (None, " ")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, token string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.link_classes(df).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 56, 0), (0, 56, 7), (3, 56, 3), (5, 56, 3), (5, 56, 3), (7, 56, 7), (7, 56, 7), (9, 56, 3)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [t for t in texts if t[0] == 3] == [(3, " ".join(near(a)))] and not [t for t in texts if t[0] in (5, 9)]
    assert texts.count((0, "")) == 1 and texts.count((0, " ")) == 1  # rows without id and words all stay
    assert sum("w" in t for _, t in texts) == 2  # one for a and b, one for c, near copies without an id included


def test_many_sets_that_share_a_prefix_shingle_without_linking(spark):
    rng = np.random.default_rng(2)
    passage = words(rng, 60)
    texts = [" ".join(passage + words(rng, 14)) for _ in range(40)]  # each pair shares 56 of 84 shingles
    texts += [" ".join(passage + words(rng, 5)) for _ in range(6)]  # and these 56 of 66: they link
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.link_classes(df).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) == 41


def test_languages_of_repeated_rows_and_ties(spark):
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2), np.float32), np.zeros((2, 2)))
    rows = [(1, "some words", "zz"), (1, "some words", "zz"), (2, "x " * 40000, None), (3, None, None), (None, "é", "zz"), (4, "12 34 !", "zz")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 6)))
    assert by_id == {1: [("aa", 0.5)] * 2, 2: [("aa", 0.5)], 3: [("und", 0.0)], None: [("aa", 0.5)], 4: [("und", 0.0)]}


def test_licenses_of_repeated_rows(spark):
    line = license_scan.KNOWN[0][1]
    rows = [(1, f"text\n{line}\n{line}", "x"), (1, f"text\n{line}\n{line}", "x"), (None, line, "y"), (2, None, "z"), (3, line + " more " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.text_license or "", r.line_licenses, r.n_license_lines) for r in license_scan.scan(df).collect())
    assert got == [(0, "Apache-2.0", "Apache-2.0", 1), (1, "", "Apache-2.0", 2), (1, "", "Apache-2.0", 2), (2, "", "", 0), (3, "", "", 0)]


def test_very_long_texts_lose_what_they_repeat(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 300_000).astype(np.uint8)).decode()
    rows = [(1, long + "#" + long[1000:1400], "s"), (2, long[5000:5150], "s"), (3, "ü" * 150_000, "s")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.removal(spark.createDataFrame(rows, "doc_id long, text string, anchor string")).collect()}
    assert got == {1: (300_401, 800, 2), 2: (150, 0, 0), 3: (300_000, 300_000, 1)}
