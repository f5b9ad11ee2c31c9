"""Crops from ink: page images, ink profiles, histogram median, blank gutters and the crop of a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box, full_page
from ..functions.text import lines_of

INK_BELOW = 230
LIGHT_FROM = 128
PAD = 0.03
MIN_GAP = 8
GAP_SHARE = 0.015
LARGEST = 0.90
_PAGE = ["job_id", "page_number"]
PROFILE = "job_id long, page_number long, width long, height long, row_ink array<boolean>, col_ink array<boolean>, hist array<long>"


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """Page images below ``path`` (``jobs/{job}/pages/page_{n}.png``) with ``job_id, page_number`` from their names."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    name = F.col("image.origin")
    return images.select(
        F.regexp_extract(name, "jobs/(\\d+)/pages/", 1).cast("long").alias("job_id"), F.regexp_extract(name, "page_(\\d+)\\.png", 1).cast("long").alias("page_number"),
        F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def text_images(lines: DataFrame, rows: int = 20, pitch: int = 4) -> DataFrame:
    """Grey images of pages from their lines (``line_index, text``), whole lines on pages as wide as their longest.

    A character is a pixel, its code the luminance (that of ``?`` beyond Latin-1), on the first two of the ``pitch`` rows of
    its line; spaces and all else are white. Columns as of :func:`read_page_images`.
    """
    page = lines.groupBy(*_PAGE).agg(F.max(F.length("text")).cast("int").alias("width"), F.map_from_entries(F.collect_list(F.struct(F.col("line_index").cast("int").alias("i"), "text"))).alias("by_line"))
    return _drawn(page, rows, pitch)


def page_images(pages: DataFrame, rows: int = 20, pitch: int = 4) -> DataFrame:
    """The same where a page's ``lines`` (``array<struct<line_index, text, ...>>``) are in its row; other columns stay. No shuffle."""
    entries = F.map_from_entries(F.transform("lines", lambda l: F.struct(l["line_index"].cast("int").alias("i"), l["text"].alias("text"))))  # noqa: E741
    width = F.array_max(F.transform("lines", lambda l: F.length(l["text"]))).cast("int")  # noqa: E741
    others = [n for n in pages.columns if n != "lines"]
    return _drawn(pages.select(*others, width.alias("width"), F.explode(F.array(entries)).alias("by_line")), rows, pitch)


def _drawn(page: DataFrame, rows: int, pitch: int) -> DataFrame:
    white = lambda n: F.repeat(F.lit("\u00ff"), n)

    def band(i: Column) -> Column:
        text = F.coalesce(F.element_at("by_line", i), F.lit(""))
        plain = F.regexp_replace(F.translate(text, " ", "\u00ff"), "[^\\x00-\\xff]", "?")
        row = F.rpad(plain, F.col("width"), "\u00ff")
        return F.concat(row, row, white(F.col("width") * (pitch - 2)))

    pixels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), band), "")
    others = [n for n in page.columns if n not in ("width", "by_line")]
    return page.where("width > 0").select(*others, F.col("width").cast("long").alias("width"), F.lit(rows * pitch).cast("long").alias("height"), F.lit(1).alias("channels"), F.encode(pixels, "ISO-8859-1").alias("data"))


def _profile(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ink, columns with ink, histogram."""
    ink = grey < INK_BELOW
    return ink.any(1), ink.any(0), np.bincount(grey.ravel(), minlength=256)


def _image(lines: list[str], rows: int, pitch: int) -> np.ndarray:
    """The image of :func:`text_images` of one page's lines."""
    width = max(map(len, lines))
    drawn = [x.encode("latin-1", "replace").replace(b" ", b"\xff").ljust(width, b"\xff") * 2 + b"\xff" * (width * (pitch - 2)) for x in lines[:rows]]
    return np.frombuffer(b"".join(drawn).ljust(width * rows * pitch, b"\xff"), np.uint8).reshape(rows * pitch, width)


def ink_profile(images: DataFrame) -> DataFrame:
    """Rows and columns with ink, and the luminance histogram, of each image (``read_page_images``); other columns stay."""
    taken = {"width", "height", "channels", "data", *_PAGE}
    others = [f for f in images.schema if f.name not in taken]
    known = T._parse_datatype_string(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, c = (batch.column(n).to_numpy() for n in ("width", "height", "channels"))
            rows, cols, counts = [], [], []
            for i, data in enumerate(batch.column("data")):
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(h[i], w[i], c[i])
                grey = pixels[:, :, 0] if c[i] == 1 else (pixels[:, :, 2].astype(np.int64) * 299 + pixels[:, :, 1].astype(np.int64) * 587 + pixels[:, :, 0].astype(np.int64) * 114 + 500) // 1000
                for one, all_ in zip(_profile(grey), (rows, cols, counts), strict=True):
                    all_.append(one)
            out = [_lists(x, t) for x, t in ((rows, pa.bool_()), (cols, pa.bool_()), (counts, pa.int64()))]
            more = [f.name for f in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*_PAGE, "width", "height")), *out, *(batch.column(n) for n in more)], names=[*known.names, *more])

    return images.mapInArrow(run, T.StructType([*known, *others]))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    begin = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def median_luma(hist: Column) -> Column:
    """The smallest value whose running count reaches half the total, the half rounded down."""
    half = F.floor(F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x) / 2)

    def walk(h: Column) -> Column:
        # running count and number of values so far in one number
        step = lambda a, x: F.when(F.shiftright(a, 9) >= h, a).otherwise(a + F.shiftleft(x, 9) + 1)
        return F.greatest(F.aggregate(hist, F.lit(0).cast("long"), step).bitwiseAND(511) - 1, F.lit(0))

    # a one-element array binds the half: else it would be summed up again for each value
    return F.get(F.transform(F.array(half), walk), F.lit(0))


def _median(hist: np.ndarray) -> int:
    """The same on an array."""
    return int(np.searchsorted(np.cumsum(hist), hist.sum() // 2))


def _up(ink: np.ndarray, start: int, gap: int) -> int:
    """From ``start`` towards 0: the inner side of the first blank run of ``gap``; 0 without one."""
    at = _first_gap(ink[:start][::-1], gap)
    return start - at if at >= 0 else 0


def _down(ink: np.ndarray, start: int, gap: int) -> int:
    """From ``start`` towards the end: the inner side of the first blank run of ``gap``; the end without one."""
    at = _first_gap(ink[start:], gap)
    return start + at if at >= 0 else len(ink)


def _first_gap(ink: np.ndarray, gap: int) -> int:
    """Index at which the first run of ``gap`` blanks begins, or -1."""
    return ink.tobytes().find(bytes(gap))


def _edges(ink: np.ndarray, low: float, high: float, size: int, min_gap: int) -> tuple[int, int]:
    """Edges of the crop along one axis of ``size`` pixels, from the seed's edges in shares; halves round to even."""
    pad, gap = round(size * PAD), max(min_gap, round(size * GAP_SHARE))
    start = max(0, min(round(low * size) - pad, size - 1))
    stop = max(start + 1, min(round(high * size) + pad, size))
    return _up(ink, start, gap), _down(ink, stop, gap)


def _seed(boxes: list[tuple]) -> dict | None:
    """The box around all boxes (left, top, width, height); None without any, or without extent."""
    if not boxes:
        return None
    left, top = min([b[0] for b in boxes]), min([b[1] for b in boxes])
    width, height = max([b[0] + b[2] for b in boxes]) - left, max([b[1] + b[3] for b in boxes]) - top
    return {"left": left, "top": top, "right": left + width, "bottom": top + height} if width > 0 and height > 0 else None


def _found(rows: np.ndarray, cols: np.ndarray, hist: np.ndarray, boxes: list[tuple], min_gap: int) -> tuple:
    """Edges of a page's crop in pixels, NULL without a seed, and its median luminance."""
    seed = _seed(boxes)
    x = _edges(cols, seed["left"], seed["right"], len(cols), min_gap) if seed else (None, None)
    y = _edges(rows, seed["top"], seed["bottom"], len(rows), min_gap) if seed else (None, None)
    return *x, *y, _median(hist)


#: What :func:`gutters` adds.
EDGES = ("left_px", "right_px", "top_px", "bottom_px", "median")


def text_edges(min_gap: int, rows: int = 20, pitch: int = 4) -> Callable[[list[str], list[tuple]], tuple]:
    """What tells ``TEXT_EDGES`` by the lines of a page and its boxes: the ``width, height`` of the image of :func:`text_images`,
    which is gone when its page is done, and what :func:`gutters` adds."""

    def edges(lines: list[str], boxes: list[tuple]) -> tuple:
        grey = _image(lines, rows, pitch)
        return grey.shape[1], grey.shape[0], *_found(*_profile(grey), boxes, min_gap)

    return edges


TEXT_EDGES = ("width", "height", *EDGES)


def gutters(profiles: DataFrame, min_gap: int = MIN_GAP) -> DataFrame:
    """Edges of the crop of each page in pixels, from its label boxes and hint (``boxes`` with the hint among them), and
    the page's ``median`` luminance: one pass over the pages.

    ``profiles`` has ``width, height, row_ink, col_ink, hist, boxes``. Adds ``left_px, right_px, top_px, bottom_px``
    (NULL without a seed) and ``median``.
    """
    added = EDGES
    profiles = profiles.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, boxes in enumerate(batch.column("boxes").to_pylist()):
                rows, cols, hist = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("row_ink", "col_ink", "hist"))
                out.append(_found(rows, cols, hist, [(b["left"], b["top"], b["width"], b["height"]) for b in boxes or []], min_gap))
            columns = zip(*out, strict=True) if out else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *added])

    return profiles.mapInArrow(run, T.StructType([*profiles.schema, *(T.StructField(n, T.LongType()) for n in added)]))


def derive_crop(profiles: DataFrame, min_gap: int = MIN_GAP, keep: Sequence[str] = ()) -> DataFrame:
    """``job_id, page_number, crop_box`` and the columns of ``keep``: the page where there are no boxes, the paper is dark or the crop would be most of it."""
    return crop_boxes(gutters(profiles, min_gap), keep)


def crop_boxes(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The same where the edges are known (:func:`gutters`)."""
    w, h = F.col("width"), F.col("height")
    unit = lambda x, hi: F.greatest(F.lit(0.0), F.least(hi, x))
    edges = edges.withColumns({"left": unit(F.col("left_px") / w, F.lit(1.0)), "top": unit(F.col("top_px") / h, F.lit(1.0))})
    left, top = F.col("left"), F.col("top")
    edges = edges.withColumns({"wide": unit((F.col("right_px") - F.col("left_px")) / w, 1.0 - left), "tall": unit((F.col("bottom_px") - F.col("top_px")) / h, 1.0 - top)})
    wide, tall = F.col("wide"), F.col("tall")
    # there are edges if and only if there are boxes with an extent
    usable = F.col("left_px").isNotNull() & (F.col("median") >= LIGHT_FROM) & (wide > 0) & (tall > 0) & (wide * tall <= LARGEST)
    return edges.select(*_PAGE, *keep, F.when(F.coalesce(usable, F.lit(False)), box(left, top, wide, tall)).otherwise(full_page()).alias("crop_box"))
