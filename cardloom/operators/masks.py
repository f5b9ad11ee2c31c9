"""Occlusions: validity, grouping into cards, cards and the rectangles to paint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, contains, crop_local
from ..functions.text import is_blank

OCCLUSION = f"struct<kind:string,direction:string,labels:array<string>,crop_box:{BOX},target_boxes:array<{BOX}>,mask_boxes:array<{BOX}>>"
#: Fronts of grouped cards.
GROUPED_FRONT = {"diagram": "Name all labeled parts", "text_occlusion": "Fill in the blanks"}
#: Colours as red, green, blue.
MASK_COLOR = "60,60,60"
HIGHLIGHT_FILL = "255,213,79"
_PAGE = ["job_id", "page_number"]


def occlusion_is_valid(o: Column) -> Column:
    """Labels, none of them blank, and each target within the crop. Masks may stick out."""
    labelled = F.coalesce((F.size(o["labels"]) > 0) & F.forall(o["labels"], lambda s: ~is_blank(s)), F.lit(False))
    return labelled & F.coalesce(F.forall(o["target_boxes"], lambda b: contains(o["crop_box"], b)), F.lit(False))


def group_masks(pending: DataFrame, options: DataFrame) -> DataFrame:
    """Pending occlusions merged page by page and kind by kind where a deck's options say so.

    ``pending`` has ``job_id, page_number, ord, note_type, front, occlusion`` (``ord`` counts through the deck, the
    kinds one after the other); ``options`` has ``job_id, diagram_mask_grouping, text_mask_grouping``, a row for each
    deck. A merged occlusion has all labels in order, boxes once each by first appearance, and crop and direction of
    the first. Returns the same columns plus ``bucket_ord``: the bucket's first ``ord``, by which buckets are ordered
    (if nothing is grouped in a deck, each row's own ``ord``).
    """
    rows = grouping_of(pending.join(options, "job_id"))
    return group_pages(rows.groupBy(*_PAGE, "note_type", "merged", "plain").agg(F.array_sort(F.collect_list(F.struct("ord", "front", "occlusion"))).alias("pending")))


def grouping_of(rows: DataFrame) -> DataFrame:
    """Rows with a ``note_type`` and the options of their deck: adds ``merged``, whether the occlusions of a page are, and ``plain``,
    whether nothing is grouped in the deck; rows whose option is not known are left out."""
    mode = F.when(F.col("note_type") == "diagram", F.col("diagram_mask_grouping")).when(F.col("note_type") == "text_occlusion", F.col("text_mask_grouping")).otherwise("individual")
    both = rows.withColumn("merged", mode == "grouped").withColumn("plain", (F.col("diagram_mask_grouping") != "grouped") & (F.col("text_mask_grouping") != "grouped"))
    return both.where(F.col("merged").isNotNull())


def group_pages(rows: DataFrame) -> DataFrame:
    """:func:`group_masks` where the occlusions of a page and kind are in a row, as ``pending`` (``array<struct<ord, front,
    occlusion>>``) in order, with ``merged`` and ``plain`` (:func:`grouping_of`): no shuffle."""
    first = F.element_at("pending", 1)

    def joined(name: str) -> Column:
        return F.flatten(F.transform("pending", lambda r: r["occlusion"][name]))

    one = F.struct(
        first["occlusion"]["kind"].alias("kind"), first["occlusion"]["direction"].alias("direction"), joined("labels").alias("labels"), first["occlusion"]["crop_box"].alias("crop_box"),
        F.array_distinct(joined("target_boxes")).alias("target_boxes"), F.array_distinct(joined("mask_boxes")).alias("mask_boxes"),
    )
    front = F.when(F.col("note_type") == "diagram", GROUPED_FRONT["diagram"]).otherwise(GROUPED_FRONT["text_occlusion"])
    grouped = F.struct(first["ord"].alias("ord"), front.alias("front"), one.alias("occlusion"), first["ord"].alias("bucket_ord"))
    own = lambda r: F.when(~F.col("plain") & F.col("note_type").isNotNull(), first["ord"]).otherwise(r["ord"])
    single = F.transform("pending", lambda r: F.struct(r["ord"].alias("ord"), r["front"].alias("front"), r["occlusion"].alias("occlusion"), own(r).alias("bucket_ord")))
    # rows meet once: what stays single and what is merged come from the same group
    out = rows.select(*_PAGE, "note_type", F.explode(F.when(F.col("merged"), F.array(grouped)).otherwise(single)).alias("r"))
    return out.select(*_PAGE, "r.ord", "note_type", "r.front", "r.occlusion", "r.bucket_ord")


def exploded(pages: DataFrame) -> DataFrame:
    """A row for each of the ``pending`` occlusions of a page and kind."""
    return pages.select(*_PAGE, "note_type", F.explode("pending").alias("r")).select(*_PAGE, "r.ord", "note_type", "r.front", "r.occlusion")


def occlusion_cards(pending: DataFrame) -> DataFrame:
    """Cards of pending occlusions: an id from the card's place, the answer (labels joined) and the occlusion as JSON."""
    return pending.select(
        F.xxhash64("job_id", "page_number", "note_type", "ord").alias("id"), *_PAGE, "ord", "note_type", "front",
        F.array_join("occlusion.labels", ", ").alias("back"), F.to_json("occlusion").alias("occlusion_json"), "occlusion",
    )


def composition_plan(cards: DataFrame, width: int = 1400, height: int = 1000) -> DataFrame:
    """The rectangles to paint on both sides of each occlusion card, in pixels of its crop, bottom one first.

    The question hides every mask and then marks the single target of a diagram; the answer hides the masks other
    than the targets. Returns the card's key columns, ``side, z, x0, y0, x1, y1, fill``.
    """
    o = F.col("occlusion")
    pointer = F.when((o["kind"] == "diagram") & (F.size(o["target_boxes"]) == 1), F.get(o["target_boxes"], F.lit(0)))

    def painted(boxes: Column, side: str, fill: str) -> Column:
        return F.transform(boxes, lambda b: F.struct(F.lit(side).alias("side"), b.alias("box"), F.lit(fill).alias("fill")))

    masks = painted(o["mask_boxes"], "question", MASK_COLOR)
    mark = painted(F.filter(F.array(pointer), lambda b: b.isNotNull()), "question", HIGHLIGHT_FILL)
    answer = painted(F.filter(o["mask_boxes"], lambda b: ~F.array_contains(o["target_boxes"], b)), "answer", MASK_COLOR)
    rows = cards.select(*_PAGE, "ord", "note_type", o["crop_box"].alias("crop"), F.posexplode(F.concat(masks, mark, answer)).alias("z", "r"))
    x0, y0, x1, y1 = crop_local(F.col("r.box"), F.col("crop"), width, height)
    return rows.select(*_PAGE, "ord", "note_type", F.col("r.side").alias("side"), F.col("z").cast("long").alias("z"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.col("r.fill").alias("fill"))
