import random
import re

import pytest
from pyspark.sql import functions as F

from cardloom.functions import text as t
from cardloom.operators import cards
from cardloom.sources.versions import Versions

DRAFT = "job_id string, ord long, note_type string, front string, back string, cloze_text string, source_page long, needs_page_image boolean"


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_normalize_text_drops_case_punctuation_and_any_white_space(spark):
    assert column(spark, ["  What, is THE answer?! ", "a\x1cb\x85c", "...", "", None], t.normalize_text) == ["what is the answer", "a b c", "", "", None]


def test_cloze_needs_a_numbered_deletion_on_one_line(spark):
    values = ["{{c1::x}} y", "{{c0::x}}", "{{c::x}}", "{{c1::}}", "{{c1::a\nb}}", "   ", None]
    assert column(spark, values, t.is_valid_cloze) == [True, True, False, False, False, False, False]


def test_slug_html_and_deck_id(spark):
    assert column(spark, [" Bio: Lecture #3 ", "--", "Ünïcode", ""], t.slugify) == ["bio-lecture-3", "deck", "n-code", "deck"]
    assert column(spark, ["<a href=\"x\">&amp;'"], t.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;amp;&#x27;"]
    import hashlib

    names = ["Biology", "", "é"]
    assert column(spark, names, t.deck_id) == [10**9 + int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") % 999_999_999 for n in names]


def test_word_spans_table_function(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\u2003\u3000é😀\x1c\u200b") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", " a\u00a0b"]
    t.register_word_spans(spark, "i int")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = spark.sql("SELECT * FROM word_spans(TABLE({rows}))", rows=rows).collect()
    assert sorted(map(tuple, got)) == [(i, m.start(), m.end() - m.start()) for i, x in enumerate(texts) for m in re.finditer(r"\S+", x or "")]
    assert spark.sql("SELECT * FROM word_spans(TABLE({rows}))", rows=rows.limit(0)).count() == 0


def test_violations_name_the_broken_rule(spark):
    rows = [("basic", "q", "a", None), ("basic", " ", "a", None), ("basic", "q", None, None), ("cloze", None, None, "{{c1::x}}"), ("cloze", None, None, None), ("diagram", None, "a", None), ("text_occlusion", "q", "", None), ("diagram", "q", "a", None)]
    found = [r[0] for r in spark.createDataFrame(rows, "note_type string, front string, back string, cloze_text string").select(cards.violation()).collect()]
    assert [x is None for x in found] == [True, False, False, True, False, False, False, True]
    assert found[1] == "Basic cards require a non-empty 'front'." and found[2] == "Basic cards require a non-empty 'back'." and found[5].startswith("Occlusion")


def test_valid_drafts_checks_type_page_and_length(spark):
    rows = [("d", 1, "basic", "q", "a", None, 1, False), ("d", 2, "basic", "q", "x" * 2001, None, 1, False), ("d", 3, "basic", "q", "a", None, 99, False), ("d", 4, "basic", "q", "a", None, 0, False), ("d", 5, "diagram", "q", "a", None, 1, False), ("e", 6, "basic", "q", "a", None, 1, False), ("d", 7, "basic", "q", "é" * 2000, None, 5, False)]
    drafts = spark.createDataFrame(rows, DRAFT)
    jobs = spark.createDataFrame([("d", 5)], "job_id string, page_count long")
    assert sorted(r.ord for r in cards.valid_drafts(drafts, jobs).collect()) == [1, 7]


def test_dedupe_shares_one_key_space_ignores_backs_and_keeps_empty_keys(spark):
    rows = [("d", 1, "basic", "What is X?", "a", None, 1, False), ("d", 2, "basic", "what is x", "b", None, 1, False), ("d", 3, "cloze", None, None, "What is X", 1, False), ("d", 4, "basic", "?!", "a", None, 1, False), ("d", 5, "basic", "...", "a", None, 1, False), ("e", 6, "basic", "What is X?", "a", None, 1, False)]
    kept = cards.dedupe(spark.createDataFrame(rows, DRAFT), ["ord"])
    assert sorted(r.ord for r in kept.collect()) == [1, 4, 5, 6]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_groups_and_rule_based_cards(spark):
    texts = ["a bb ccc dd e ff ggg hh i jj", "", "one", "x " * 30 + "longest middle", *["p q"] * 8]
    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate(texts, 1)], "job_id long, page_number long, text string")
    groups = cards.page_groups(pages)
    assert sorted((r.group_no, len(r.pages)) for r in groups.collect()) == [(0, 10), (1, 2)]
    drafts = cards.draft_cards(groups)
    made = drafts.orderBy("group_no", "ord").collect()
    assert [(r.group_no, r.ord, r.source_page, r.needs_page_image) for r in made] == [((p - 1) // 10, (p - 1) % 10, p, p != 4) for p in range(1, 13) if p != 2]
    assert [r.cloze_text for r in made[:3]] == ["a bb {{c1::ccc}} dd e ff ggg", "{{c1::one}}", "x x x x {{c1::longest}} middle"]
    assert drafts.where(cards.violation().isNotNull()).count() == 0
    assert sorted(r.page_number for r in cards.flagged_pages(groups).collect()) == [1, 11]


def test_listing_puts_cards_without_a_page_first(spark):
    rows = [(1, 3, 2, False), (1, 1, None, False), (1, 2, 2, False), (1, 4, 1, True)]
    listed = cards.job_cards(spark.createDataFrame(rows, "job_id long, id long, source_page long, is_deleted boolean"))
    assert [r.id for r in listed.collect()] == [1, 2, 3]


def test_a_repeated_run_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "job_id long, id long")
    store = Versions(spark, str(tmp_path / "cards"))
    for _ in range(2):
        cards.write_cards(df, store.path, "monday")
    assert cards.write_cards(df.where("id = 20").withColumn("id", F.lit(99).cast("long")), store.path, "tuesday") == 3
    assert sorted(r.id for r in store.read().where("job_id = 2").collect()) == [20, 21, 99]
    assert "PushedFilters: [IsNotNull(job_id), EqualTo(job_id,2)]" in store.read().where("job_id = 2")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1])
def test_empty_decks(spark, n):
    pages = spark.createDataFrame([(1, 1, "x")] * n, "job_id long, page_number long, text string")
    assert cards.page_groups(pages).count() == n
