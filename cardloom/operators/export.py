"""Export: notes with their fields, and the media they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import deck_id, html_escape
from ..sources.versions import Versions

#: Note models by id.
BASIC_MODEL = 1607392319
CLOZE_MODEL = 1607392320
OCCLUSION_MODEL = 1607392321


def page_media(job: Column, page: Column) -> Column:
    return F.format_string("sb-job%d-page%d.png", job, page)


def card_media(job: Column, card: Column) -> Column:
    return F.format_string("sb-job%d-card%d.png", job, card)


def four_places(x: Column) -> Column:
    """A number with four decimals, rounded on its exact binary value, half to even; meant for shares, below 2**13.

    The built-in formatter rounds the shortest decimal instead. The number is cut into whole 2**-26 and the rest; ten thousand
    times either is exact, and so is the comparison of their fractions with a half.
    """
    size = F.abs(x)
    high = F.floor(size * 2.0**26).cast("double") / 2.0**26
    whole = F.floor(high * 10000.0)
    over, rest = high * 10000.0 - whole.cast("double") - 0.5, (high - size) * 10000.0
    up = (over > rest) | ((over == rest) & (whole % 2 == 1))
    n = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def occlusions_of(occlusion: Column) -> Column:
    """Every target box of an occlusion, in shares of its crop, under one card index; empty without any."""
    c = occlusion["crop_box"]

    def shape(b: Column) -> Column:
        shares = {"left": (b["left"] - c["left"]) / c["width"], "top": (b["top"] - c["top"]) / c["height"], "width": b["width"] / c["width"], "height": b["height"] / c["height"]}
        return F.concat(F.lit("{{c1::image-occlusion:rect"), *[x for name, v in shares.items() for x in (F.lit(f":{name}="), four_places(v))], F.lit(":oi=1}}"))

    return F.array_join(F.transform(occlusion["target_boxes"], shape), "<br>")


def occlusions_field(cards: DataFrame, key: list[str]) -> DataFrame:
    """``key, occlusions_field`` of the cards that have a target box; a card is a row, so nothing is shuffled."""
    return cards.where(F.size("occlusion.target_boxes") > 0).select(*key, occlusions_of(F.col("occlusion")).alias("occlusions_field"))


def _image(name: Column) -> Column:
    return F.concat(F.lit('<img src="'), html_escape(name), F.lit('">'))


def text_notes(cards: DataFrame, jobs: DataFrame, images: DataFrame) -> DataFrame:
    """Notes of the visible basic and cloze cards of ready decks; a page image is added where one is wanted and there.

    ``cards`` has ``job_id, card_id, note_type, front, back, cloze_text, source_page, needs_page_image, is_deleted``;
    ``jobs`` ``job_id, deck_name, status``; ``images`` ``job_id, page_number``. Returns ``deck_id, model_id, job_id,
    card_id, fields, media``.
    """
    ready = jobs.where("status = 'ready'").select("job_id", deck_id(F.col("deck_name")).alias("deck_id"))
    shown = cards.where(~F.col("is_deleted") & F.col("note_type").isin("basic", "cloze")).join(ready, "job_id")
    have = images.select("job_id", F.col("page_number").alias("source_page"), F.lit(True).alias("there")).distinct()
    both = shown.join(have, ["job_id", "source_page"], "left")
    media = F.when(F.col("needs_page_image") & F.coalesce("there", F.lit(False)), page_media(F.col("job_id"), F.col("source_page")))
    both = both.withColumn("media", media)
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    img = _image(F.col("media"))
    basic = F.array(esc(F.col("front")), F.concat(esc(F.col("back")), F.coalesce(F.concat(F.lit("<br>"), img), F.lit(""))))
    cloze = F.array(esc(F.col("cloze_text")), F.coalesce(img, F.lit("")))
    is_basic = F.col("note_type") == "basic"
    return both.select("deck_id", F.when(is_basic, BASIC_MODEL).otherwise(CLOZE_MODEL).cast("long").alias("model_id"), "job_id", "card_id", F.when(is_basic, basic).otherwise(cloze).alias("fields"), "media")


def occlusion_notes(cards: DataFrame, jobs: DataFrame, composed: DataFrame) -> DataFrame:
    """Notes of the visible occlusion cards of ready decks whose answer image was composed (``job_id, card_id``)."""
    ready = jobs.where("status = 'ready'").select("job_id", deck_id(F.col("deck_name")).alias("deck_id"))
    return shown_notes(cards.where(~F.col("is_deleted")).join(composed, ["job_id", "card_id"], "left_semi").join(ready, "job_id"))


def shown_notes(cards: DataFrame) -> DataFrame:
    """The same of cards that are all shown and have their ``deck_id`` in their row: no shuffle."""
    shown = cards.where(F.size("occlusion.target_boxes") > 0)
    media = card_media(F.col("job_id"), F.col("card_id"))
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    fields = F.array(occlusions_of(F.col("occlusion")), _image(media), esc(F.col("front")), esc(F.col("back")), F.lit(""))
    return shown.select("deck_id", F.lit(OCCLUSION_MODEL).cast("long").alias("model_id"), "job_id", "card_id", fields.alias("fields"), media.alias("media"))


def readiness(jobs: DataFrame) -> DataFrame:
    """Jobs with ``refusal``: NULL if a deck may be exported."""
    return jobs.withColumn("refusal", F.when(F.col("status").isNull(), "Job not found.").when(F.col("status") != "ready", "Job is not ready for export."))


def write_export(notes: DataFrame, path: str, part: str = "all") -> int:
    """Note sink: an export replaces the one before it under the same name, decks without notes included; returns the version."""
    laid = notes.repartitionByRange("deck_id", "card_id").sortWithinPartitions("deck_id", "card_id")
    return Versions(notes.sparkSession, path).publish(laid, part)
