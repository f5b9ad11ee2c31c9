"""Phrases to mask: candidates, words and boxes of a phrase, the gate rules, selection and acceptance."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX, bottom, box, full_page, right
from ..functions.text import PUNCTUATION, SPACE, STOPWORDS, is_stopwords_only, normalize_text, strip, token_is_stopword

MIN_CONFIDENCE = 0.5
MOST_WORDS = 5
MIN_CHARS = 3
MIN_CONTEXT_WORDS = 4
SPANS_PER_PAGE = 5
_PAGE = ["job_id", "page_number"]
_LINE = [*_PAGE, "line_index"]
_SPAN = [*_PAGE, "span_ord"]


def fitting_size(text: Column) -> Column:
    """One to five words, and three characters besides spaces."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    return F.size(words).between(1, MOST_WORDS) & (F.length(F.replace(text, F.lit(" "), F.lit(""))) >= MIN_CHARS)


def ref_text(text: Column, start: Column, length: Column) -> Column:
    """The stretch of a line that a reference covers, clamped to the line and stripped."""
    low = F.greatest(start, F.lit(0))
    return strip(F.substring(text, (low + 1).cast("int"), F.greatest(start + length - low, F.lit(0)).cast("int")))


def candidates(lines: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Every run of one to ``most`` words of each line, in reading order: ``job_id, page_number, line_index, start, count, text``.

    ``lines`` has ``tokens``. Generators only: no shuffle.
    """
    starts = lines.where(F.size("tokens") > 0).select(*_LINE, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("start"))
    runs = starts.select(*_LINE, "tokens", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("tokens") - F.col("start")))).alias("count"))
    return runs.select(*_LINE, F.col("start").cast("long").alias("start"), F.col("count").cast("long").alias("count"), F.array_join(F.slice("tokens", F.col("start") + 1, F.col("count")), " ").alias("text"))


def count_candidates(lines: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The same runs counted where their line is: ``candidates``, how many of them are ``fitting``, their ``chars``, and
    ``last_text``, the greatest of them. Lines without tokens are left out. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tokens in batch.column("tokens").to_pylist():
                sizes = [(len(t.split()), len(t) - t.count(" ")) for t in tokens]
                found = fitting = chars = 0
                last = ""
                for i in range(len(tokens)):
                    words = solid = 0
                    for k, (w, n) in enumerate(sizes[i : i + most], 1):
                        text = " ".join(tokens[i : i + k])
                        words, solid = words + w, solid + n
                        found, chars = found + 1, chars + len(text)
                        fitting += 1 <= words <= MOST_WORDS and solid >= MIN_CHARS
                        last = max(last, text)
                out.append((found, fitting, chars, last))
            columns = zip(*out, strict=True) if out else [[]] * 4
            made = [pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _LINE), *made], names=[*_LINE, "candidates", "fitting", "chars", "last_text"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in _LINE), "candidates bigint, fitting bigint, chars bigint, last_text string"])
    return lines.where(F.size("tokens") > 0).select(*_LINE, "tokens").mapInArrow(run, schema)


def ref_lines(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """References with their line's ``text, confidence, n_words, words``; NULL where there is no such line."""
    return refs.join(lines.select(*_LINE, F.col("text").alias("line_text"), "confidence", "n_words", "words"), _LINE, "left")


def raw_texts(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """The characters of its line that each reference names, whole words or not: ``ref_text``; NULL where there is no such line."""
    return ref_lines(refs, lines).select(*_SPAN, "ref_ord", "line_index", ref_text(F.col("line_text"), F.col("char_start"), F.col("char_length")).alias("ref_text"))


def placed(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """References with their line's ``confidence, n_words`` and ``covered``: its words that lie whole within the
    reference, as ``array<struct<word_index, word, box>>``, NULL where there is no such line.

    A line is a row that holds its words, so references are joined with lines once and all else is row-local.
    """
    indexed = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("word_index"), w["text"].alias("word"), w["box"].alias("box"), w["char_start"].alias("from"), (w["char_start"] + w["char_length"]).alias("to")))
    inside = F.filter(indexed, lambda w: (w["from"] >= F.col("char_start")) & (w["to"] <= F.col("char_start") + F.col("char_length")))
    # a generator of one row: the covered words are found once, not for each use
    return ref_lines(refs, lines).select(*_SPAN, "ref_ord", "line_index", "confidence", "n_words", F.explode(F.array(inside)).alias("covered"))


def ref_words(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """The words that lie whole within each reference: ``word_index, word, box``."""
    rows = placed(refs, lines).select(*_SPAN, "ref_ord", "line_index", F.explode("covered").alias("w"))
    return rows.select(*_SPAN, "ref_ord", "line_index", "w.word_index", "w.word", "w.box")


def covering(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """References with their line's ``confidence, n_words`` and what they cover of it: ``n_covered`` (0 where there is no such
    line), and, if anything, its words in order as ``text`` and the ``box`` around them.

    As :func:`placed`, but only covered words are looked at, and each of these is put together once, behind a generator of one
    row: the box has ten uses in a rule or a row.
    """
    low, high = F.col("char_start"), F.col("char_start") + F.col("char_length")
    inside = F.filter("words", lambda w: (w["char_start"] >= low) & (w["char_start"] + w["char_length"] <= high))
    keys = [*_SPAN, "ref_ord", "line_index", "confidence", "n_words"]
    rows = ref_lines(refs, lines).select(*keys, F.explode(F.array(inside)).alias("covered"))
    edges = F.transform("covered", lambda w: F.struct(w["box"]["left"].alias("l"), w["box"]["top"].alias("t"), right(w["box"]).alias("r"), bottom(w["box"]).alias("b")))
    rows = rows.select(*keys, "covered", F.explode(F.array(edges)).alias("edges"))
    around = F.struct(F.array_min("edges.l").alias("l"), F.array_min("edges.t").alias("t"), F.array_max("edges.r").alias("r"), F.array_max("edges.b").alias("b"))
    rows = rows.select(*keys, "covered", F.explode(F.array(around)).alias("e"))
    e = F.col("e")
    n = F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long")
    return rows.select(
        *keys, n.alias("n_covered"), F.when(n > 0, F.array_join(F.transform("covered", lambda w: w["text"]), " ")).alias("text"),
        F.when((e["r"] > e["l"]) & (e["b"] > e["t"]), box(e["l"], e["t"], e["r"] - e["l"], e["b"] - e["t"])).alias("box"),
    )


def covers(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """What each reference covers, if anything: ``n_covered``, its words in order as ``text``, and ``box`` around them."""
    return covering(refs, lines).where("n_covered > 0").drop("confidence", "n_words")


def span_text(cover: DataFrame) -> DataFrame:
    """Text of each span: what its references cover, in order, joined by spaces; spans that cover nothing are left out."""
    parts = F.array_sort(F.collect_list(F.struct("ref_ord", "text")))
    return cover.groupBy(*_SPAN).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def span_boxes(cover: DataFrame) -> DataFrame:
    """A box for each reference of a span, so a phrase across two lines has two: ``ref_ord, line_index, box``."""
    return cover.where("box is not null").select(*_SPAN, "ref_ord", "line_index", "box")


def gate(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """The rules of each span, a flag each: ``confident, whole_line, enough_context, fits, only_stopwords`` with ``text``,
    ``boxes`` and ``passes``. References meet their lines in one join, and a span gathers its few references in one group."""
    rows = covering(refs, lines)
    n_covered = F.col("n_covered")
    all_parts = F.array_sort(F.collect_list(F.struct("ref_ord", "text", "box", "line_index", "n_words", "n_covered")))
    flags = rows.groupBy(*_SPAN).agg(
        F.min(F.coalesce(F.col("confidence") >= MIN_CONFIDENCE, F.lit(False))).alias("confident"),
        F.min(F.coalesce((F.col("n_words") > 0) & (n_covered >= F.col("n_words")), F.lit(False))).alias("whole_line"),
        F.min(F.col("n_words").isNotNull()).alias("known"), all_parts.alias("refs"),
    )

    def left_over(parts: Column) -> Column:
        """Words of the span's lines that stay in sight; each line counts once, less what all references cover of it."""
        touched = F.array_distinct(F.transform(parts, lambda p: F.struct(p["line_index"].alias("line_index"), p["n_words"].alias("n_words"))))
        hidden = lambda line: F.aggregate(F.filter(parts, lambda p: p["line_index"] == line["line_index"]), F.lit(0).cast("long"), lambda a, p: a + p["n_covered"])
        return F.aggregate(touched, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n_words"] - F.least(hidden(x), x["n_words"]), F.lit(0)))

    flags = flags.withColumn("left_over", left_over(F.col("refs"))).withColumn("parts", F.filter("refs", lambda p: p["text"].isNotNull())).drop("refs")
    # a generator of one row: the text is put together once, not for each rule
    out = flags.withColumn("text", F.explode(F.array(F.array_join(F.transform("parts", lambda p: p["text"]), " "))))
    rules = F.struct(fitting_size(F.col("text")).alias("fits"), is_stopwords_only(F.col("text")).alias("only_stopwords"), (F.col("known") & (F.coalesce("left_over", F.lit(0)) >= MIN_CONTEXT_WORDS)).alias("enough_context"))
    out = out.withColumn("rule", F.explode(F.array(rules))).select(
        *_SPAN, "text", F.filter(F.transform("parts", lambda p: p["box"]), lambda b: b.isNotNull()).alias("boxes"), "confident", "whole_line",
        F.col("rule.enough_context").alias("enough_context"), F.col("rule.fits").alias("fits"), F.col("rule.only_stopwords").alias("only_stopwords"),
    )
    return out.withColumn("passes", F.col("confident") & F.col("fits") & ~F.col("whole_line") & F.col("enough_context") & ~F.col("only_stopwords"))


def confident_spans(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """``job_id, page_number, span_ord, confident``: every line a span touches exists and was read surely enough."""
    sure = F.coalesce(F.col("confidence") >= MIN_CONFIDENCE, F.lit(False))
    return ref_lines(refs, lines).groupBy(*_SPAN).agg(F.min(sure).alias("confident"))


def select_spans(lines: DataFrame) -> DataFrame:
    """The rule-based selector: one phrase of each surely read line, not at its start, two words rather than one, the leftmost that fits.

    ``lines`` has ``tokens, confidence``. A line is a row, so the best run is found without a shuffle.
    Returns ``job_id, page_number, span_ord, ref_ord, line_index, char_start, char_length, text``.
    """
    sure = lines.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.size("tokens") > 1))
    # each token is looked at once: its words (more than one only if it holds an unusual blank), its characters, and whether it
    # is stop words only
    words = lambda t: F.when(~t.rlike(SPACE), 1).otherwise(F.size(F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")))
    flags = F.transform("tokens", lambda t: F.struct(words(t).alias("words"), F.length(F.replace(t, F.lit(" "), F.lit(""))).alias("chars"), token_is_stopword(t).alias("stop")))
    flagged = sure.select(*_LINE, "tokens", F.explode(F.array(flags)).alias("flags"))
    n = F.size("tokens")

    def runs(count: int) -> Column:
        indexes = F.when(n - count >= 1, F.sequence(F.lit(1), n - count)).otherwise(F.array().cast("array<int>"))
        of = lambda i, k: F.get("flags", i + k)
        total = lambda i, name: sum((of(i, k)[name] for k in range(1, count)), of(i, 0)[name])
        stop = lambda i: of(i, 0)["stop"] & of(i, 1)["stop"] if count > 1 else of(i, 0)["stop"]
        fit = F.filter(indexes, lambda i: total(i, "words").between(1, MOST_WORDS) & (total(i, "chars") >= MIN_CHARS) & ~stop(i))
        return F.transform(F.slice(fit, 1, 1), lambda i: F.struct(i.alias("start"), F.lit(count).alias("count"), F.array_join(F.slice("tokens", i + 1, F.lit(count)), " ").alias("text")))

    # a generator of at most one row keeps the optimiser from copying the choice into each of its uses
    found = flagged.select(*_LINE, "tokens", F.explode(F.slice(F.concat(runs(2), runs(1)), 1, 1)).alias("best"))
    return found.select(
        *_PAGE, F.col("line_index").alias("span_ord"), F.lit(0).cast("long").alias("ref_ord"), "line_index",
        (F.length(F.array_join(F.slice("tokens", F.lit(1), F.col("best.start")), " ")) + 1).cast("long").alias("char_start"),
        F.length("best.text").cast("long").alias("char_length"), F.col("best.text").alias("text"),
    )


def accept_spans(passing: DataFrame, cap: int = SPANS_PER_PAGE) -> DataFrame:
    """At most ``cap`` spans of a page, in order: a span goes if its normalised text was accepted before, it has no
    box, or a box of it overlaps an accepted one. A rejected span reserves nothing.

    ``passing`` has ``job_id, page_number, span_ord, text, boxes`` of the spans that pass the gate. Spark sorts the spans of a
    page; a task reads them in order, knows the accepted ones of one page, and passes over the rest of it once there are
    ``cap``, so a page may have any number of spans.
    """
    names = [*_SPAN, "text", "boxes"]
    spans = passing.where(F.size("boxes") > 0).select(*names, normalize_text(F.col("text")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, keys, areas = None, set(), []
        for batch in batches:
            pages = list(zip(*(batch.column(c).to_pylist() for c in _PAGE), strict=True))
            key, boxes, kept, i = batch.column("key"), batch.column("boxes"), [], 0
            while i < len(pages):
                if pages[i] != page:
                    page, keys, areas = pages[i], set(), []
                if len(keys) == cap:  # nothing more of this page
                    i = bisect_right(pages, page, i) if pages[-1] != page else len(pages)
                    continue
                own = key[i].as_py()
                if own not in keys:
                    new = [(b["left"], b["left"] + b["width"], b["top"], b["top"] + b["height"]) for b in boxes[i].as_py()]
                    if not any(min(a[1], b[1]) - max(a[0], b[0]) > 0 and min(a[3], b[3]) - max(a[2], b[2]) > 0 for a in areas for b in new):
                        keys.add(own)
                        areas += new
                        kept.append(i)
                i += 1
            yield batch.take(pa.array(kept, pa.int64())).select(names)

    ordered = spans.where(" and ".join(f"{c} is not null" for c in _PAGE)).repartition(*_PAGE).sortWithinPartitions(*_SPAN)
    return ordered.mapInArrow(run, spans.select(*names).schema)


class Line(NamedTuple):
    """A line of a page's row: its words, the same in lower case, and whether it was read surely enough."""

    index: int
    words: list[str]
    lower: list[str]
    sure: bool


class Page:
    """The lines of a page's row, each put together when it is first asked for."""

    __slots__ = ("_known", "_lower", "_size", "_sure", "_words", "n_lines")

    def __init__(self, text: str, lower: str, sure: list[bool], size: int):
        self._words, self._lower, self._sure, self._size, self._known = text.split(" "), lower.split(" "), sure, size, {}
        self.n_lines = -(-len(self._words) // size)

    def line(self, index: int) -> Line | None:
        found = self._known.get(index)
        if found is None and 0 <= index < self.n_lines:
            own = slice(index * self._size, (index + 1) * self._size)
            found = self._known[index] = Line(index, self._words[own], self._lower[own], self._sure[index])
        return found


#: References of a span, in order: line, first character, number of characters.
Refs = list[tuple[int, int, int]]
_UNMARKED = str.maketrans("", "", PUNCTUATION)
_STOP = frozenset(STOPWORDS)


def _normalized(lower: str) -> list[str]:
    """The words of :func:`normalize_text` of a text that Spark has put in lower case; what splits them is ``SPACE``."""
    return lower.translate(_UNMARKED).split()


def _only_stopwords(lower: list[str]) -> bool:
    """:func:`is_stopwords_only` of words joined by blanks; one of letters and digits alone tells without being normalised."""
    for w in lower:
        if w not in _STOP and w.isalnum():
            return False
    return all(w in _STOP for w in _normalized(" ".join(lower)))


def _fits(text: str) -> bool:
    """:func:`fitting_size`."""
    return len(text) - text.count(" ") >= MIN_CHARS and 1 <= len(text.split()) <= MOST_WORDS


def choose(line: Line) -> tuple[int, int] | None:
    """The choice of :func:`select_spans` on a line, as first character and number of characters; the rest of the line is not
    looked at once a run fits."""
    n = len(line.words)
    if line.sure:
        for count in (2, 1) if n > 1 else ():
            for i in range(1, n - count + 1):
                text = " ".join(line.words[i : i + count])
                if _fits(text) and not _only_stopwords(line.lower[i : i + count]):
                    return sum(map(len, line.words[:i])) + i, len(text)
    return None


def _covered(words: list[str], low: int, high: int) -> list[int]:
    """Which words of a line lie whole between two of its characters."""
    at, found = 0, []
    for i, w in enumerate(words):
        end = at + len(w)
        if end > high:
            break
        if low <= at:
            found.append(i)
        at = end + 1
    return found


def _passing(refs: Refs, page: Page, place: Callable[[int, int], tuple]) -> tuple[str, list[str], list[tuple]] | None:
    """Text, words in lower case and boxes of a span, by its references; None if it breaks a rule of :func:`gate`."""
    parts, hidden, whole = [], {}, True
    for index, start, length in refs:
        line = page.line(index)
        if line is None or not line.sure:
            return None
        found = _covered(line.words, start, start + length)
        hidden[index] = hidden.get(index, 0) + len(found)
        whole = whole and 0 < len(line.words) <= len(found)
        if found:
            parts.append((line, found))
    if whole or sum([max(len(page.line(i).words) - n, 0) for i, n in hidden.items()]) < MIN_CONTEXT_WORDS:
        return None
    text = " ".join([line.words[i] for line, found in parts for i in found])
    lower = [line.lower[i] for line, found in parts for i in found]
    if not _fits(text) or _only_stopwords(lower):
        return None
    boxes = []
    for line, found in parts:
        left, top, width, height = place(line.index, found[0])
        high, low = left + width, top + height
        for i in found[1:]:
            x, y, width, height = place(line.index, i)
            left, top, high, low = min(left, x), min(top, y), max(high, x + width), max(low, y + height)
        if high > left and low > top:
            boxes.append((left, top, high - left, low - top))
    return text, lower, boxes


def _clear(box_: tuple, areas: list[tuple]) -> bool:
    """Whether a box has no common area with any of ``areas``, which all have an extent."""
    left, top, width, height = box_
    high, low = left + width, top + height
    for x, y, w, h in areas:
        if x < high and left < x + w and y < low and top < y + h:
            return False
    return True


#: Accepted spans of a page as :func:`accept_pages` gives them.
ACCEPTED = f"array<struct<span_ord:bigint,text:string,boxes:array<{BOX}>>>"


def accept_pages(pages: DataFrame, refer: Callable[[Page], Iterable[tuple[int, Refs]]], place: Callable[[int, int], tuple], line_words: int, cap: int = SPANS_PER_PAGE) -> DataFrame:
    """:func:`gate` and :func:`accept_spans` where a page is a row: its words in order as ``text``, parted by single blanks,
    ``line_words`` to a line, the same in ``lower`` case, and the ``confidence`` of its lines. Returns ``job_id, page_number,
    spans``. No shuffle.

    ``refer`` gives a page's spans in order of ``span_ord`` (each once) with their references, ``place`` the box of a word by the
    places of its line and itself. A span is looked at when its turn comes, so none is after the last one accepted.
    """
    rows = pages.where(" and ".join(f"{c} is not null" for c in _PAGE)).select(*_PAGE, "text", "lower", "confidence")
    schema, names = pages.select(*_PAGE, F.lit(None).cast(ACCEPTED).alias("spans")).schema, [*_PAGE, "spans"]
    step = accept_batches(refer, place, line_words, cap)
    return rows.mapInArrow(lambda batches: (b.select(names) for b in step(batches)), schema)


def accept_batches(refer: Callable[[Page], Iterable[tuple[int, Refs]]], place: Callable[[int, int], tuple], line_words: int, cap: int = SPANS_PER_PAGE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of :func:`accept_pages` on batches: adds ``spans``."""

    def accepted(page: Page) -> Iterator[tuple]:
        keys, areas = set(), []
        for span, refs in refer(page):
            found = _passing(refs, page, place)
            if found is None or not found[2]:
                continue
            text, lower, boxes = found
            key = tuple(_normalized(" ".join(lower)))
            if key not in keys and all([_clear(b, areas) for b in boxes]):
                keys.add(key)
                areas += boxes
                yield span, text, boxes
                if len(keys) == cap:
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, inner, spans, texts, flat = [0], [0], [], [], []
            lists = batch.column("confidence")
            sure = pc.fill_null(pc.greater_equal(lists.flatten(), MIN_CONFIDENCE), False).to_numpy(zero_copy_only=False).tolist()
            first, *_ = ends = lists.offsets.to_pylist()
            for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in ("text", "lower")), strict=True)):
                for span, text, boxes in accepted(Page(*row, sure[ends[i] - first : ends[i + 1] - first], line_words)):
                    spans.append(span)
                    texts.append(text)
                    flat += boxes
                    inner.append(len(flat))
                begin.append(len(spans))
            sides = zip(*flat, strict=True) if flat else [[]] * 4
            boxed = pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in sides], names=["left", "top", "width", "height"])
            made = pa.StructArray.from_arrays([pa.array(spans, pa.int64()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), boxed)], names=["span_ord", "text", "boxes"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), made)], names=[*batch.schema.names, "spans"])

    return run


#: Front of a card that asks for one phrase.
FRONT = "Fill in the blank"


def _occlusion(span: Column) -> Column:
    """The page uncropped, the boxes of a span (``text, boxes``) masked and revealed."""
    return F.struct(
        F.lit("text").alias("kind"), F.lit("identify").alias("direction"), F.array(span["text"]).alias("labels"),
        full_page().alias("crop_box"), span["boxes"].alias("target_boxes"), span["boxes"].alias("mask_boxes"),
    )


def text_occlusions(accepted: DataFrame) -> DataFrame:
    """One occlusion for each accepted span: the page uncropped, its boxes masked and revealed."""
    return accepted.select(*_PAGE, F.col("span_ord").alias("ord"), F.lit("text_occlusion").alias("note_type"), F.lit(FRONT).alias("front"), _occlusion(F.struct("text", "boxes")).alias("occlusion"))


def pending_of(spans: Column) -> Column:
    """The same of the ``spans`` of a page (:func:`accept_pages`): ``array<struct<ord, front, occlusion>>``, in order."""
    return F.transform(spans, lambda x: F.struct(x["span_ord"].alias("ord"), F.lit(FRONT).alias("front"), _occlusion(x).alias("occlusion")))


def best_ranked(candidates_: DataFrame) -> DataFrame:
    """The selector's choice among candidate rows (``candidates``), as a window: more words first, then leftmost."""
    fit = candidates_.where((F.col("start") >= 1) & (F.col("count") <= 2)).where(fitting_size(F.col("text")) & ~is_stopwords_only(F.col("text")))
    order = Window.partitionBy(*_LINE).orderBy(F.desc("count"), "start")
    return fit.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


