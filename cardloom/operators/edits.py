"""Card edits: a log of creations, patches and deletions folded over the cards, in a batch and on a stream by one set of rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cards import OCCLUSION_TYPES, RULES

FIELDS = "note_type string, front string, back string, cloze_text string, needs_page_image boolean, is_deleted boolean"
LOG = "card_id long, seq long, op string, patch map<string,string>"
#: Texts that count as true and as false; any other is NULL.
FLAGS = {**dict.fromkeys(("t", "true", "y", "yes", "1"), True), **dict.fromkeys(("f", "false", "n", "no", "0"), False)}
_BLANK = re.compile(r"[\s\x1c-\x1f\x85]*", re.UNICODE)
_CLOZE = re.compile("\\{\\{c[0-9]+::[^\n\r\x85  ]+?\\}\\}")


class Card(NamedTuple):
    note_type: str | None
    front: str | None
    back: str | None
    cloze_text: str | None
    needs_page_image: bool | None
    is_deleted: bool


def flag(text: str | None) -> bool | None:
    return None if text is None else FLAGS.get(text.strip().lower())


def broken_rule(card: Card) -> str | None:
    """The message of the first of ``cards.RULES`` that a card breaks."""
    for types, field, check, message in RULES:
        if card.note_type in types:
            text = getattr(card, field)
            blank = text is None or _BLANK.fullmatch(text) is not None
            if blank or (check == "cloze" and _CLOZE.search(text) is None):
                return message
    return None


def after_edit(card: Card | None, op: str, patch: dict[str, str | None]) -> tuple[Card | None, str | None]:
    """The card after one edit, and why the edit was refused, if it was; a refused edit changes nothing.

    ``create`` sets a card; keys of a patch that are there are set, even to NULL; an unknown or deleted card (None) has
    nothing to change. Type and geometry of an occlusion card are fixed.
    """
    if op == "create":
        return Card(patch.get("note_type"), patch.get("front"), patch.get("back"), patch.get("cloze_text"), flag(patch.get("needs_page_image", "false")), flag(patch.get("is_deleted")) is True), None
    if card is None or card.is_deleted:
        return card, "Card not found."
    if "occlusion" in patch:
        return card, "Occlusion geometry cannot be edited."
    if op == "delete":
        return card._replace(is_deleted=True), None
    kind = patch.get("note_type", card.note_type)
    occluded = card.note_type in OCCLUSION_TYPES
    if kind is None or ((occluded or kind in OCCLUSION_TYPES) and kind != card.note_type):
        return card, "Card cannot change to this note type."
    new = card._replace(note_type=kind, **{f: patch[f] for f in ("front", "back", "cloze_text") if f in patch})
    message = broken_rule(new)
    if message:
        return card, message
    if occluded:
        return new._replace(cloze_text=card.cloze_text), None
    # a text card keeps the fields of its type only
    new = new._replace(front=None, back=None) if kind == "cloze" else new._replace(cloze_text=None) if kind == "basic" else new
    return new._replace(needs_page_image=flag(patch["needs_page_image"])) if "needs_page_image" in patch else new, None


def creations(cards: DataFrame) -> DataFrame:
    """Cards (``card_id`` and ``FIELDS``) as the first entries of a log."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    patch = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]))
    return cards.select("card_id", F.lit(None).cast("long").alias("seq"), F.lit("create").alias("op"), patch.alias("patch"))


def apply_edits(cards: DataFrame, edits: DataFrame) -> DataFrame:
    """``cards`` (``card_id`` and ``FIELDS``) after their edits (``LOG``), with ``applied``, ``refused`` and ``last_reason``.

    A card and its edits come to a task in order of ``seq`` (cards first), sorted by Spark, and the task holds the present
    card and two counters, however long its log is. Edits of unknown cards have no card to change and are left out.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, card, applied, refused, reason = None, None, 0, 0, None
        for batch in batches:
            out = []
            ids, ops, patches = (batch.column(c).to_pylist() for c in ("card_id", "op", "patch"))
            for own, group in groupby(range(len(ids)), ids.__getitem__):
                if own != key:
                    if card is not None:
                        out.append((key, *card, applied, refused, reason))
                    key, card, applied, refused, reason = own, None, 0, 0, None
                for i in group:
                    card, why = after_edit(card, ops[i], dict(patches[i] or ()))
                    if ops[i] != "create" and card is not None:
                        applied, refused, reason = (applied + 1, refused, reason) if why is None else (applied, refused + 1, why)
            yield from rows(out)
        if card is not None:
            yield from rows([(key, *card, applied, refused, reason)])

    schema = f"card_id long, {FIELDS}, applied long, refused long, last_reason string"
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)

    def rows(values: list[tuple]) -> Iterator[pa.RecordBatch]:
        if values:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*values, strict=True), types, strict=True)], names=list(names))

    log = creations(cards).unionByName(edits.select("card_id", "seq", "op", "patch")).where("card_id is not null")
    return log.repartition("card_id").sortWithinPartitions("card_id", F.col("op") != "create", "seq").mapInArrow(fold, schema)
