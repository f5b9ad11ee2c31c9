"""Every language of the documents is learned, however many there are."""

import numpy as np

from cardloom.llm import langid


def test_more_than_64_languages_are_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(70):
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(8)]
        rows += [(i * 8 + j, " ".join(rng.choice(words, 12)), f"l{i:02d}") for j in range(8 if i < 64 else 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == [f"l{i:02d}" for i in range(70)]
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows if lang >= "l64"]) > 0.9
