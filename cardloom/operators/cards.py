"""Card drafts: field rules, validity, near-duplicate removal, page groups, rule-based drafts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_valid_cloze, normalize_text
from ..sources.versions import Versions

OCCLUSION_TYPES = ("diagram", "text_occlusion")
#: Most code points in a field of a draft.
FIELD_LIMIT = 2000
PAGES_PER_GROUP = 10
#: Words on each side of a gap; a page with fewer words than ``SHORT_PAGE`` needs its image.
AROUND = 4
SHORT_PAGE = 20


def is_occlusion(note_type: str = "note_type") -> Column:
    return F.col(note_type).isin(*OCCLUSION_TYPES)


#: The rules of the card types, in order: types, field, check (not blank, or a gap as well), message. The messages are fixed values.
RULES = (
    (("basic",), "front", "text", "Basic cards require a non-empty 'front'."),
    (("basic",), "back", "text", "Basic cards require a non-empty 'back'."),
    (("cloze",), "cloze_text", "cloze", "Cloze cards require non-empty 'cloze_text' with valid {{c1::...}} syntax."),
    (OCCLUSION_TYPES, "front", "text", "Occlusion cards require a non-empty 'front'."),
    (OCCLUSION_TYPES, "back", "text", "Occlusion cards require a non-empty 'back'."),
)


def violation() -> Column:
    """What breaks the rules of a card's type (columns ``note_type, front, back, cloze_text``), or NULL."""
    out = [
        F.when(F.col("note_type").isin(*types) & (is_blank(F.col(field)) if check == "text" else ~F.coalesce(is_valid_cloze(F.col(field)), F.lit(False))), message)
        for types, field, check, message in RULES
    ]
    return F.coalesce(*out)


def valid_drafts(drafts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Drafts that may become cards: a text type, a page of the deck, short enough fields, and no violation.

    ``jobs`` has ``job_id, page_count``, one row for each deck.
    """
    short = [F.coalesce(F.length(c) <= FIELD_LIMIT, F.lit(True)) for c in ("front", "back", "cloze_text")]
    fits = F.col("note_type").isin("basic", "cloze") & short[0] & short[1] & short[2] & violation().isNull()
    placed = drafts.where(fits).join(jobs.select("job_id", "page_count"), "job_id")
    return placed.where((F.col("source_page") >= 1) & (F.col("source_page") <= F.col("page_count"))).drop("page_count")


def dedup_key() -> Column:
    return normalize_text(F.coalesce(F.when(F.col("note_type") == "cloze", F.col("cloze_text")).otherwise(F.col("front")), F.lit("")))


def dedupe(drafts: DataFrame, order: list[str], deck: str = "job_id") -> DataFrame:
    """The first draft, by ``order``, of each normalised question of a deck; drafts with an empty key all stay.

    Only the rank-one filter is on the window, so tasks drop later copies before the shuffle, a hot key included.
    """
    keyed = drafts.withColumn("key", dedup_key())
    # drafts without a key are each a group of their own
    alone = F.when(F.col("key") == "", F.struct(*order))
    first = F.row_number().over(Window.partitionBy(deck, "key", alone).orderBy(*order))
    return keyed.withColumn("place", first).where("place = 1").drop("place", "key")


def page_groups(pages: DataFrame, size: int = PAGES_PER_GROUP) -> DataFrame:
    """Runs of ``size`` pages of a deck: ``job_id, group_no`` and the pages in order. A group never holds more than ``size`` pages."""
    keyed = pages.withColumn("group_no", F.floor((F.col("page_number") - 1) / size).cast("long"))
    return keyed.groupBy("job_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))


def draft_cards(groups: DataFrame) -> DataFrame:
    """Rule-based drafts: for each page of a group (``job_id, group_no, pages``) that has words, a gap for its longest word,
    the first of several, in the words around it.

    Returns drafts with ``group_no`` and ``ord``, the page's place in the group.
    """
    pages = groups.select("job_id", "group_no", F.posexplode("pages").alias("ord", "page"))
    words = pages.select("job_id", "group_no", "ord", F.col("page.page_number").alias("source_page"), F.filter(F.split("page.text", " "), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"))))
    found = words.withColumn("at", -longest["at"])
    before, after = F.slice("words", F.greatest(F.col("at") - AROUND + 1, F.lit(1)), F.least(F.col("at"), F.lit(AROUND))), F.slice("words", F.col("at") + 2, F.lit(AROUND))
    gap = F.concat(F.lit("{{c1::"), F.element_at("words", (F.col("at") + 1).cast("int")), F.lit("}}"))
    text, none = F.array_join(F.concat(before, F.array(gap), after), " "), F.lit(None).cast("string")
    return found.select(
        "job_id", "group_no", F.col("ord").cast("long").alias("ord"), F.lit("cloze").alias("note_type"), none.alias("front"), none.alias("back"),
        text.alias("cloze_text"), "source_page", (F.size("words") < SHORT_PAGE).alias("needs_page_image"),
    )


def flagged_pages(groups: DataFrame) -> DataFrame:
    """The pages that the rule-based generator holds for diagrams: the first of each group."""
    return groups.select("job_id", F.element_at("pages", 1)["page_number"].alias("page_number"))


def diagram_shortlist(flagged: DataFrame, jobs: DataFrame, images: DataFrame) -> DataFrame:
    """Flagged pages, once each, that lie in the deck and have an image: what the costly detector gets to see."""
    inside = flagged.distinct().join(jobs.select("job_id", "page_count"), "job_id").where((F.col("page_number") >= 1) & (F.col("page_number") <= F.col("page_count")))
    return inside.join(images, ["job_id", "page_number"], "left_semi").select("job_id", "page_number")


def visible(cards: DataFrame) -> DataFrame:
    return cards.where(~F.col("is_deleted"))


def job_cards(cards: DataFrame) -> DataFrame:
    """A deck's visible cards in listing order: by page (none first), then id."""
    return visible(cards).orderBy("job_id", F.col("source_page").asc_nulls_first(), "id")


def card_counts(jobs: DataFrame, cards: DataFrame) -> DataFrame:
    """``jobs`` with ``card_count``, the number of visible cards."""
    counts = visible(cards).groupBy("job_id").agg(F.count("*").alias("card_count"))
    return jobs.join(counts, "job_id", "left").withColumn("card_count", F.coalesce("card_count", F.lit(0)).cast("long"))


def write_cards(cards: DataFrame, path: str, run: str) -> int:
    """Card sink: the cards of a run as one part of the versions under ``path``; returns the version. A run that is repeated
    replaces its cards. Files are sorted by deck, so the statistics of the files lead a reader of one deck to its own, and a
    large deck has several."""
    laid = cards.repartitionByRange("job_id", "id").sortWithinPartitions("job_id", "id")
    return Versions(cards.sparkSession, path).publish(laid, run)
