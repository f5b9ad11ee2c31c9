"""What ended jobs leave in the driver goes before a stage of the pipeline begins, and between the jobs of the longest one."""

import corpus_pipeline
from cardloom.llm import suffix


def test_every_stage_and_the_suffix_jobs_give_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "tune", lambda s: None)
    monkeypatch.setattr(corpus_pipeline, "read", lambda s, d, t: t)
    monkeypatch.setattr(corpus_pipeline, "give_back", calls.append)
    for module, name in ((corpus_pipeline.quality, "train"), (corpus_pipeline.quality, "keep_good"), (corpus_pipeline.jaccard, "keep_one"), (corpus_pipeline.suffix, "cut_repeats"), (corpus_pipeline.decontam, "keep_clean"), (corpus_pipeline.bpe, "load_ranks"), (corpus_pipeline.bpe, "encode")):
        monkeypatch.setattr(module, name, lambda *a: a[0])
    assert [stage("session", "docs", "") is not None for _, stage in corpus_pipeline.STAGES] == [True] * 5 and calls == ["session"] * 5
    monkeypatch.undo()
    monkeypatch.setattr(suffix, "give_back", calls.append)
    docs = spark.createDataFrame([(1, "ab" * 150), (2, "ab" * 150), (3, "c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix.cut_repeats(docs).collect()} == {1: "", 2: "", 3: "c"} and len(calls) >= 8
