"""What the driver holds beside Spark: what Python frees goes back, tables stay packed, and components are not found twice."""

import tracemalloc
from pathlib import Path

import numpy as np

from cardloom.llm import common, decontam, jaccard, quality
from cardloom.llm.common import give_back


def _resident_mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_what_python_frees_goes_back(spark):
    held = [bytes(4000) for _ in range(40_000)]
    last, before = bytes(4000), _resident_mb()  # stands above the others, so that they do not lie at the end of the heap
    del held
    give_back(spark)
    assert before - _resident_mb() > 100 and len(last) == 4000


def test_what_the_jvm_frees_goes_back(spark, monkeypatch):
    assert common._trim_java(spark).startswith("Trim native heap")
    calls = []
    monkeypatch.setattr(common, "_trim_java", calls.append)
    give_back(spark)
    assert calls == [spark]


def test_the_seed_table_stays_packed_in_the_driver(spark):
    items = spark.createDataFrame([([1, 2, 1 << 62, -5],), ([7],)], "seeds array<long>")
    for bits in (26, 12, 8, 7, 5):
        marked = np.zeros(max(1 << bits, decontam.SLICES), bool)
        for factor in decontam._PROBES:
            marked[(np.array([1, 2, 1 << 62, -5, 7]).view(np.uint64) * factor >> np.uint64(64 - bits)).astype(np.int64)] = True
        tracemalloc.start()
        table = decontam.seed_filter(items, bits)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(table, np.packbits(marked)) and peak < (40 << 20)


def _chain(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"]), "other words that stand alone here", "other words that stand alone here"]
    return spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_only_links_between_components_are_joined_again(spark, monkeypatch):
    calls, inner = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: calls.append(links.count()) or inner(links))
    got = {r.doc_id: r.component_id for r in jaccard.link_classes(_chain(spark)).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 13, 14: 13} and len(calls) == 1  # no link was left


def test_links_that_are_left_tie_components(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "rep long, component long")
    links = spark.createDataFrame([(2, 6), (6, 9)], "a long, b long")
    tied = jaccard._between(links, members)
    assert sorted(map(tuple, tied.collect())) == [(1, 5), (5, 9)]
    assert {r.node: r.component for r in jaccard.components(tied).collect()} == {1: 1, 5: 1, 9: 1}


def test_stages_between_give_back(spark, monkeypatch):
    calls = []
    for module in (decontam, quality):
        monkeypatch.setattr(module, "give_back", calls.append)
    docs = spark.createDataFrame([(i, f"good text {i} of some words" if i % 2 else f"bad bad {i}") for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert len(calls) == 2
    decontam.keep_clean(docs, spark.createDataFrame([(1, "good text 3 of some words")], "item_id long, text string")).count()
    assert len(calls) == 5
