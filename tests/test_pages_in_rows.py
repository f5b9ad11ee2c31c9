"""Steps that work where a page, a line or a deck lies: no shuffle where none is needed, and the same rows."""

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardloom.operators import labels
from cardloom.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plan(capsys, df) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["label_union", "label_boxes", "low_yield_pages", "gutter_edges", "derive_crop", "diagram_occlusions"])
def test_labels_and_crops_are_found_where_their_page_is(spark, capsys, name):
    assert "Exchange hashpartitioning" not in plan(capsys, QUERIES[name](spark, str(DATA)))


def test_merging_in_a_row_keeps_the_largest_sets(spark):
    rng = random.Random(3)
    groups = [(p, o, [rng.choice([*range(6), 9, -1, None]) for _ in range(rng.randint(0, 4))], f"{p}-{o}") for p, o in itertools.product((0, 1), range(12))]
    seen = {}
    for p, o, items, text in groups:
        key = tuple(sorted({i for i in items if i is not None and 0 <= i < 7}))
        if key:
            seen.setdefault(key, (p * 1_000_000 + o, text))
    want = sorted((at, list(k), text) for k, (at, text) in seen.items() if not any(set(k) < set(o) for o in seen))
    rows = spark.createDataFrame([(1, 1, *x) for x in groups], "job_id long, page_number long, pass long, group_ord long, item_indices array<long>, label_text string")
    one = rows.groupBy("job_id", "page_number").agg(F.collect_list(F.struct("pass", "group_ord", "item_indices", "label_text")).alias("groups")).withColumn("n_items", F.lit(7).cast("long"))
    assert sorted((r.label_ord, r.indices, r.label_text) for r in labels.merge_pages(one).first().labels) == want


def test_grouping_reads_its_rows_once(spark, capsys):
    from cardloom.operators import masks

    pending = spark.range(4).select(F.lit(1).cast("long").alias("job_id"), F.lit(1).cast("long").alias("page_number"), F.col("id").alias("ord"), F.lit("diagram").alias("note_type"), F.lit("f").alias("front"), F.from_json(F.lit('{"kind":"diagram","labels":["a"],"target_boxes":[],"mask_boxes":[]}'), masks.OCCLUSION).alias("occlusion"))
    opts = spark.createDataFrame([(1, "grouped", "individual")], "job_id long, diagram_mask_grouping string, text_mask_grouping string")
    out = masks.group_masks(pending, opts)
    assert plan(capsys, out).count("Range (") == 1
    assert [(r.ord, r.bucket_ord, r.occlusion.labels) for r in out.collect()] == [(0, 0, ["a"] * 4)]


def test_box_overlaps_returns_every_pair(spark):
    if DATA.is_dir():
        rows = QUERIES["box_overlaps"](spark, str(DATA))
        assert rows.columns == ["job_id", "page_number", "a", "b"] and rows.count() == rows.where("a < b").distinct().count() > 0


@pytest.mark.parametrize("name", ["dedupe_cards", "cards_per_source", "valid_drafts"])
def test_drafts_are_not_dealt_out_by_their_few_decks(spark, capsys, name):
    out = plan(capsys, QUERIES[name](spark, str(DATA)))
    assert "BroadcastHashJoin" in out and "SortMergeJoin" not in out


def test_candidates_are_counted_where_their_line_is(spark, capsys):
    from cardloom.operators import spans

    lines = [["ab", "c", "the"], ["x"], [], ["a b", "\U0001f600", "café", "d", "e", "f"]]
    df = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(lines)], "job_id long, page_number long, line_index long, tokens array<string>")
    got = {r.line_index: tuple(r)[3:] for r in spans.count_candidates(df).collect()}
    rows = spans.candidates(df).groupBy("line_index").agg(F.count("*"), F.sum(spans.fitting_size(F.col("text")).cast("int")), F.sum(F.length("text")), F.max("text"))
    assert got == {r.line_index: tuple(r)[1:] for r in rows.collect()}
    assert "Exchange hashpartitioning" not in plan(capsys, QUERIES["candidate_spans"](spark, str(DATA)))


@pytest.mark.parametrize("name", ["ref_words", "span_text", "span_boxes", "span_gate"])
def test_references_meet_their_lines_where_the_deck_lies(spark, capsys, name):
    out = plan(capsys, QUERIES[name](spark, str(DATA)))
    assert all("REPARTITION_BY_NUM" in x for x in out.splitlines() if "Exchange hashpartitioning" in x)
