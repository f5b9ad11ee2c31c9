"""Diagram labels: merging of classifier passes, label boxes, page flags, model-request texts, occlusions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import BOX, full_page, union_box, union_of
from ..functions.text import lines_of
from .masks import exploded, occlusion_is_valid

_PAGE = ["job_id", "page_number"]


#: Labels of a page as :func:`merge_pages` gives them.
MERGED = "array<struct<label_ord:bigint,indices:array<bigint>,label_text:string>>"


def _largest(sets: list[frozenset]) -> list[int]:
    """Places of the sets (each once) that no other one strictly holds. A set is held by one with its rarest item only, so an
    item that all of them share brings no two together."""
    holders: dict = defaultdict(list)
    for s in sets:
        for i in s:
            holders[i].append(s)
    kept = []
    for at, own in enumerate(sets):
        for other in min([holders[i] for i in own], key=len):
            if own < other:
                break
        else:
            kept.append(at)
    return kept


def merged_groups(groups: Sequence[tuple], n_items: int) -> list[tuple[int, list[int], int]]:
    """Label groups of a page (``pass, group_ord, item_indices``) merged as :func:`merge_passes` says: ``label_ord``, indices in
    order, and the place of the group whose text stays."""
    seen: dict[frozenset, int] = {}
    for g in sorted(range(len(groups)), key=[x[:2] for x in groups].__getitem__):
        own = frozenset([i for i in groups[g][2] or () if i is not None and 0 <= i < n_items])
        if own:
            seen.setdefault(own, g)
    found = list(seen.items())
    return [(groups[g][0] * 1_000_000 + groups[g][1], sorted(own), g) for own, g in map(found.__getitem__, _largest(list(seen)))]


def merge_pages(pages: DataFrame) -> DataFrame:
    """:func:`merge_passes` where a page's groups are in its row: ``groups`` (``array<struct<pass, group_ord, item_indices,
    label_text>>``) and ``n_items`` become ``labels`` (``label_ord, indices, label_text``); other columns stay. No shuffle."""
    schema = T.StructType([*[f for f in pages.schema if f.name not in ("groups", "labels")], T.StructField("labels", T._parse_datatype_string(MERGED))])
    rest = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("groups"), batch.column("n_items").to_pylist()
            flat = lists.flatten()
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            groups = list(zip(*(flat.field(n).to_pylist() for n in ("pass", "group_ord", "item_indices")), strict=True))
            label, chosen, texts, begin, lo = [], [], [], [0], 0
            for n, count in zip(sizes, counts, strict=True):
                for ord_, indices, g in merged_groups(groups[lo : lo + count], n):
                    label.append(ord_)
                    chosen.append(indices)
                    texts.append(lo + g)
                lo += count
                begin.append(len(label))
            named = flat.field("label_text").take(pa.array(texts, pa.int64()))
            rows = pa.StructArray.from_arrays([pa.array(label, pa.int64()), pa.array(chosen, pa.list_(pa.int64())), named], names=["label_ord", "indices", "label_text"])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rows)], names=[*rest, "labels"])

    return pages.select(*rest, "groups").mapInArrow(run, schema)


#: Labels of a page with their boxes.
BOXED = f"array<struct<label_ord:bigint,label_text:string,box:{BOX}>>"
#: Pages whose merging is kept in a task: pages whose groups name the same items differ in their texts only.
KEPT = 1024
Groups = Callable[[int, list[str]], tuple[tuple, list[str]]]


def label_batches(groups_of: Groups, place: Callable[[int], tuple], edges: Callable[[list[str], list[tuple]], tuple], line_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step on batches of pages, each a row with its words in order as ``text``, parted by single blanks, ``line_words`` to a
    line, ``flagged`` if it is held for a diagram, and a ``hint``, a box or NULL. Adds ``labels`` (``BOXED``), the groups of all
    passes merged, with the boxes around their lines, and ``edges`` (NULL without labels); pages without a flag have neither.

    ``groups_of`` gives the groups of a page by its number and lines, as ``pass, group_ord, item_indices`` in a tuple, and their
    texts; ``place`` the box of a line; ``edges`` whole numbers by the lines and the boxes of labels and hint.
    """

    def boxed(groups: tuple, n_items: int) -> list[tuple]:
        out = []
        for ord_, indices, g in merged_groups(groups, n_items):
            boxes = [place(i) for i in indices]
            left, top = min([b[0] for b in boxes]), min([b[1] for b in boxes])
            high, low = max([b[0] + b[2] for b in boxes]), max([b[1] + b[3] for b in boxes])
            if high > left and low > top:
                out.append((ord_, g, (left, top, high - left, low - top)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(KEPT)(boxed)
        for batch in batches:
            ords, texts, flat, begin, found = [], [], [], [0], []
            for number, text, flagged, hint in zip(*(batch.column(n).to_pylist() for n in ("page_number", "text", "flagged", "hint")), strict=True):
                made: tuple | None = None
                if flagged:
                    lines = lines_of(text, line_words)
                    groups, named = groups_of(number, lines)
                    own = known(groups, len(lines))
                    ords += [x[0] for x in own]
                    texts += [named[x[1]] for x in own]
                    boxes = [x[2] for x in own]
                    flat += boxes
                    made = edges(lines, [*boxes, tuple(hint.values())] if hint else boxes) if boxes else None
                found.append(made)
                begin.append(len(ords))
            sides = zip(*flat, strict=True) if flat else [[]] * 4
            box = pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in sides], names=["left", "top", "width", "height"])
            rows = pa.StructArray.from_arrays([pa.array(ords, pa.int64()), pa.array(texts, pa.string()), box], names=["label_ord", "label_text", "box"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rows), pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "labels", "edges"])

    return run


def merge_passes(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Label groups of all passes of a page as index sets: unknown indices go, the first text of a set stays, and a
    set that is a strict subset of another goes.

    ``groups`` has ``job_id, page_number, pass, group_ord, item_indices, label_text``; ``items`` has ``job_id,
    page_number, n_items``. Returns ``job_id, page_number, label_ord, indices, label_text``; the order is that of
    first appearance. A page's groups come together once, in one row; see :func:`merge_pages` for those that are.
    """
    group = F.struct(F.col("pass").cast("long").alias("pass"), F.col("group_ord").cast("long").alias("group_ord"), F.col("item_indices").cast("array<bigint>").alias("item_indices"), "label_text")
    pages = groups.groupBy(*_PAGE).agg(F.collect_list(group).alias("groups")).join(items.select(*_PAGE, F.col("n_items").cast("long").alias("n_items")), _PAGE)
    return merge_pages(pages.select(*_PAGE, "n_items", "groups")).select(*_PAGE, F.explode("labels").alias("l")).select(*_PAGE, "l.*")


def label_boxes(merged: DataFrame, lines: DataFrame) -> DataFrame:
    """The box around the lines of each merged label: ``job_id, page_number, label_ord, label_text, box``."""
    items = merged.select(*_PAGE, "label_ord", "label_text", F.explode("indices").alias("line_index"))
    return items.join(lines.select(*_PAGE, "line_index", "box"), [*_PAGE, "line_index"]).groupBy(*_PAGE, "label_ord", "label_text").agg(union_box(F.col("box")).alias("box")).where("box is not null")


def boxes_of(labels: Column, lines: Column) -> Column:
    """The same within a page's row: ``array<struct<label_ord, label_text, box>>`` of its ``labels`` and ``lines``."""
    own = lambda l: F.transform(F.filter(lines, lambda x: F.array_contains(l["indices"], x["line_index"])), lambda x: x["box"])  # noqa: E731, E741
    # an array of one element binds the boxes of a label once
    boxed = F.transform(labels, lambda l: F.struct(l["label_ord"].alias("label_ord"), l["label_text"].alias("label_text"), F.get(F.transform(F.array(own(l)), union_of), F.lit(0)).alias("box")))  # noqa: E741
    return F.filter(boxed, lambda l: l["box"].isNotNull())  # noqa: E741


def page_flags(passes: DataFrame) -> DataFrame:
    """Whether any pass holds a page for a labelled diagram, and the first pass's box that is not NULL."""
    return passes.groupBy(*_PAGE).agg(F.max("is_labeled_diagram").alias("is_labeled_diagram"), F.min_by("diagram_box", F.when(F.col("diagram_box").isNotNull(), F.col("pass"))).alias("diagram_box"))


def flags_of(passes: Column) -> Column:
    """:func:`page_flags` within a page's row, from its passes in order: ``struct<is_labeled_diagram, diagram_box>``."""
    hints = F.filter(F.transform(passes, lambda p: p["diagram_box"]), lambda b: b.isNotNull())
    return F.struct(F.array_max(F.transform(passes, lambda p: p["is_labeled_diagram"])).alias("is_labeled_diagram"), F.get(hints, F.lit(0)).alias("diagram_box"))


def is_low(n_labels: Column, n_items: Column) -> Column:
    return n_labels <= F.greatest(F.lit(1), F.floor(n_items / 10))


def low_yield(flags: DataFrame, boxes: DataFrame, items: DataFrame) -> DataFrame:
    """Flagged pages with suspiciously few labels for their number of items: ``n_labels, n_items``."""
    counts = boxes.groupBy(*_PAGE).agg(F.count("*").alias("n_labels"))
    both = flags.where("is_labeled_diagram").select(*_PAGE).join(items, _PAGE).join(counts, _PAGE, "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)).cast("long"))
    return both.where(is_low(F.col("n_labels"), F.col("n_items"))).select(*_PAGE, "n_labels", "n_items")


#: Labels that the rule-based detector takes from a page.
LABELS_PER_PAGE = 2


def detect_labels(lines: DataFrame) -> DataFrame:
    """Rule-based detector: the first words of a page, in reading order, that begin with a capital, as labels with their boxes.

    ``lines`` has ``job_id, page_number, line_index, words``. Returns ``job_id, page_number, label_ord, label_text, box``.
    """
    named = F.filter(F.transform("words", lambda w, i: F.struct((F.col("line_index") * 1000 + i).alias("at"), w["text"].alias("label_text"), w["box"].alias("box"))), lambda w: w["label_text"].rlike("^\\p{Lu}"))
    words = lines.select(*_PAGE, F.explode(F.slice(named, 1, LABELS_PER_PAGE)).alias("w")).select(*_PAGE, "w.*")
    ranked = words.withColumn("n", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("at"))).where(F.col("n") <= LABELS_PER_PAGE)
    return ranked.select(*_PAGE, (F.col("n") - 1).cast("long").alias("label_ord"), "label_text", "box")


def diagram_occlusions(labels: DataFrame, crops: DataFrame) -> DataFrame:
    """One occlusion for each label of a page: all label boxes masked, its own revealed, the page's crop (or all of it).

    ``labels`` has ``job_id, page_number, label_ord, label_text, box``; ``crops`` has ``job_id, page_number, crop_box``.
    """
    masks = labels.groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("label_ord", "box"))), lambda b: b["box"]).alias("mask_boxes"))
    return _revealed(labels.join(masks, _PAGE).join(crops.select(*_PAGE, "crop_box"), _PAGE, "left"))


def page_occlusions(pages: DataFrame) -> DataFrame:
    """The same where a page's ``labels`` (``array<struct<label_ord, label_text, box>>``) and ``crop_box`` are in its row."""
    return exploded(page_pending(pages).withColumn("note_type", F.lit("diagram")))


def page_pending(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`page_occlusions` with those of a page in its row: ``job_id, page_number``, the columns of ``keep`` and ``pending``
    (``array<struct<ord, front, occlusion>>``), in order."""
    # generators of one row: labels are put in order once, and occlusions once
    rows = pages.select(*_PAGE, *keep, F.coalesce("crop_box", full_page()).alias("crop_box"), F.explode(F.array(F.array_sort("labels"))).alias("labels"))
    rows = rows.select("*", F.explode(F.array(F.col("labels.box"))).alias("mask_boxes"))
    made = F.transform("labels", lambda l: F.struct(l["label_ord"].alias("ord"), F.lit(FRONT).alias("front"), _occlusion(l).alias("occlusion")))  # noqa: E741
    listed = F.filter(made, lambda r: occlusion_is_valid(r["occlusion"]))
    return rows.select(*_PAGE, *keep, F.explode(F.array(listed)).alias("pending"))


#: Front of a card that asks for one label.
FRONT = "What is this?"


def _occlusion(label: Column) -> Column:
    """One label revealed (``label_text, box``) among ``mask_boxes`` in ``crop_box``."""
    return F.struct(
        F.lit("diagram").alias("kind"), F.lit("identify").alias("direction"), F.array(label["label_text"]).alias("labels"),
        F.col("crop_box"), F.array(label["box"]).alias("target_boxes"), F.col("mask_boxes"),
    )


def _revealed(rows: DataFrame) -> DataFrame:
    one = _occlusion(F.struct("label_text", "box"))
    out = rows.withColumn("crop_box", F.coalesce("crop_box", full_page())).select(*_PAGE, F.col("label_ord").alias("ord"), F.lit("diagram").alias("note_type"), F.lit(FRONT).alias("front"), one.alias("occlusion"))
    return out.where(occlusion_is_valid(F.col("occlusion")))


def _short(x: Column) -> Column:
    """A number to three places, as short as it goes."""
    return F.bround(x, 3).cast("string")


def item_prompt(lines: DataFrame) -> DataFrame:
    """The request text of each page: its lines with numbers and boxes, in order. ``job_id, page_number, prompt, span_prompt``."""
    b = F.col("box")
    quoted = F.concat(F.lit("["), F.col("line_index"), F.lit('] "'), F.col("text"), F.lit('"'))
    full = F.concat(quoted, F.lit(" @ ("), F.concat_ws(", ", _short(b["left"]), _short(b["top"]), _short(b["width"]), _short(b["height"])), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("line_index", full.alias("full"), quoted.alias("plain"))))
    per_page = lines.groupBy(*_PAGE).agg(rows.alias("rows"))
    return per_page.select(*_PAGE, F.array_join(F.transform("rows", lambda r: r["full"]), "\n").alias("prompt"), F.array_join(F.transform("rows", lambda r: r["plain"]), "\n").alias("span_prompt"))
