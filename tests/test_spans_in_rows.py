"""Spans accepted where their page is a row: no shuffle, and the rows of the way by keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import crop, export, labels, masks, spans
from cardloom.plans import queries as q

#: Stop words, marks alone, words with marks, unusual blanks within a word, letters whose lower case is a case of its own.
WORDS = ["the", "Of", "--", "a", "cell", "Cell,", "membrane", "x y", " ", "it's", "Σ", "ΟΔΟΣ", "İx", "Ᲊab", "\U0001f600", "nucleus", "the.", "(you)", "ab\x1ccd", "mitochondrion"]


def documents(spark, tmp_path, ids):
    rng = random.Random(11)
    blank = ["", " ", "\n\t "]
    texts = [None, "", " \n ", "the", *(rng.choice(blank) + rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS[: rng.choice([4, 9, 20])]) for _ in range(rng.choice([1, 3, 8, 9, 17, 159, 160, 161, 400]))) + rng.choice(blank) for _ in range(40))]
    rows = [(i, x, "en", "web") for i, x in zip(ids, texts, strict=False)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def by_keys(spark, d):
    return spans.accept_spans(q._gate(spark, d).where("passes").select("job_id", "page_number", "span_ord", "text", "boxes"))


def rows(df):
    return sorted(map(tuple, df.select("job_id", "page_number", "span_ord", "text", F.col("boxes").cast("string")).collect()))


def test_rows_are_those_of_the_way_by_keys(spark, tmp_path):
    d = documents(spark, tmp_path, [None, *range(-5, 60)])
    found = rows(q._accepted(spark, d))
    assert found == rows(by_keys(spark, d)) and len({r[0] for r in found}) > 20 and any(r[2] >= 100 for r in found)


def test_a_deck_of_several_documents_meets_by_keys(spark, tmp_path):
    d = documents(spark, tmp_path, [5, 6, 7, 8, 9, 9, 10, *range(20, 60)])
    assert rows(q._accepted(spark, d)) == rows(by_keys(spark, d))


@pytest.mark.parametrize("name", ["accept_spans", "text_occlusions", "occlusion_cards", "occlusion_fields", "export_occlusion_notes"])
def test_text_occlusions_are_not_shuffled(spark, tmp_path, capsys, name):
    q.QUERIES[name](spark, documents(spark, tmp_path, range(60))).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_cards_stay_where_they_are_beside_their_decks(spark, capsys):
    q.QUERIES["export_notes"](spark, "/root/testdata/sf0.001").explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_notes_by_keys_are_those_of_rows(spark):
    made = f"from_json('{{\"kind\":\"text\",\"labels\":[\"a\"],\"crop_box\":{{\"left\":0,\"top\":0,\"width\":1,\"height\":0.5}},\"target_boxes\":[{{\"left\":0.25,\"top\":0.25,\"width\":0.5,\"height\":0.125}},{{\"left\":0,\"top\":0,\"width\":1,\"height\":0.5}}],\"mask_boxes\":[]}}', '{masks.OCCLUSION}')"
    cards = spark.range(6).select((F.col("id") % 2).alias("job_id"), F.col("id").alias("card_id"), F.lit("f").alias("front"), F.lit("<b>").alias("back"), F.expr(made).alias("occlusion"), (F.col("id") == 4).alias("is_deleted"))
    jobs = spark.createDataFrame([(0, "A", "ready"), (1, "B", "failed")], "job_id long, deck_name string, status string")
    got = export.occlusion_notes(cards, jobs, cards.where("card_id > 0").select("job_id", "card_id")).collect()
    shape = "{{{{c1::image-occlusion:rect:left={}:top={}:width={}:height={}:oi=1}}}}".format
    field = shape("0.2500", "0.5000", "0.5000", "0.2500") + "<br>" + shape("0.0000", "0.0000", "1.0000", "1.0000")
    assert [(r.job_id, r.card_id, r.fields) for r in got] == [(0, 2, [field, '<img src="sb-job0-card2.png">', "f", "&lt;b&gt;", ""])]


def test_grouping_in_rows_is_grouping_by_keys(spark, tmp_path, monkeypatch, capsys):
    d = documents(spark, tmp_path, [None, *range(-5, 60)])
    df = q.QUERIES["mask_grouping"](spark, d)
    df.explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out
    found = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(q.c, "is_row_decks", lambda *_: False)
    assert found == sorted(map(tuple, q.QUERIES["mask_grouping"](spark, d).collect())) and len({r[4:6] for r in found}) == 4


def test_labels_and_crops_of_texts_are_those_of_images(spark, tmp_path):
    d = documents(spark, tmp_path, [None, *range(-5, 60)])
    by_image = labels.page_occlusions(crop.derive_crop(q._profiles(spark, d).where("flags.is_labeled_diagram"), 2, ["labels"]))
    fields = ["job_id", "page_number", "ord", "note_type", "front", F.col("occlusion").cast("string")]
    got, want = (sorted(map(tuple, x.where("job_id is not null").select(*fields).collect())) for x in (q._diagram_pending(spark, d), by_image))
    assert got == want and len({r[-1] for r in got}) > 20


@pytest.mark.parametrize("gap", [1, 2, 3, 9])
def test_the_first_gap_is_that_of_a_plain_loop(gap):
    rng = random.Random(gap)
    for _ in range(200):
        ink = np.array([rng.random() < 0.4 for _ in range(rng.randint(0, 12))], bool)
        want = next((i for i in range(len(ink) - gap + 1) if not ink[i : i + gap].any()), -1)
        assert crop._first_gap(ink, gap) == want
        back = next((i for i in range(len(ink) - gap, -1, -1) if not ink[i : i + gap].any()), None)
        assert crop._up(ink, len(ink), gap) == (0 if back is None else back + gap)
