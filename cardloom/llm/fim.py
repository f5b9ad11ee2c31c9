"""Fill-in-the-middle transformation over a sparse index of exceptions.

Most code points are one byte. The index records only the others: where each begins and how many bytes it has
beyond one. Between two exceptions code points and bytes advance alike, so a cut is converted either way by one
``searchsorted`` in that short index and an addition; text without multibyte characters has an empty index and
costs arithmetic only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import pieces

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Hundredths of the documents that are transformed, and of those that begin with the suffix.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7


class Exceptions:
    """Multibyte characters of a run of UTF-8 bytes: ``byte`` and ``char`` place of each, ``excess[i]`` spare bytes of the first ``i``."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.char = self.byte - self.excess[:-1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte place (the start of a character, or the end)."""
        return at - self.excess[np.searchsorted(self.byte, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return at + self.excess[np.searchsorted(self.char, at)]


def line_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ends, first)``: where each line ends (a newline belongs to its line); those of text ``i`` are ``first[i]:first[i+1]``."""
    ends = np.union1d(np.flatnonzero(data == 0x0A) + 1, off[1:][np.diff(off) > 0])
    return ends, np.searchsorted(ends, off, "right")


def _cuts(data: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, unit: str, index: Exceptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each text, and the bytes after the smaller and the larger of ``a`` and ``b`` modulo that number plus one."""
    if unit == "line":
        ends, first = line_ends(data, off)
        n = np.diff(first)
        place = lambda k: np.where(k > 0, np.append(ends, 0)[np.minimum(first[:-1] + np.maximum(k, 1) - 1, len(ends))], off[:-1])
    elif unit == "char":
        begin = index.chars(off)
        n = np.diff(begin)
        place = lambda k: index.bytes(begin[:-1] + k)
    else:
        raise ValueError(f"unit must be line or char, not {unit!r}")
    x, y = a % (n + 1), b % (n + 1)
    return n, place(np.minimum(x, y)), place(np.maximum(x, y))


def _draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers for each document, from the hash of its id. A NULL id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Each text of ``docs`` (``doc_id``, ``text``; others are ignored), cut in three and put in another order.

    Returns ``doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output``. The text has ``n`` units
    (lines with their newline, or code points); two cuts come from the hash of the id. ``psm`` is prefix, suffix, middle,
    each after its mark; ``spm`` is suffix, prefix, middle. ``plain`` stays as it is, without lengths: empty texts, texts
    that hold a mark, and what ``rate`` leaves out. A NULL text counts as empty; repeated rows come out alike; rows of one
    id are cut by the same numbers; very long texts are cut whole; an empty table gives no row. Nothing is shuffled.
    """
    if any(not m or m[0] in m[1:] for m in sentinels) or len(set(sentinels)) < 3 or any(x in y for x in sentinels for y in sentinels if x != y):
        raise ValueError("marks must differ, none inside another, and their first character must not come again")
    marks = [m.encode() for m in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            held = np.zeros(len(batch), bool)
            for m in marks:
                held |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
            draws = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            for lo, hi, data, off in pieces(texts):
                h1, h2, h3, h4 = (h[lo:hi] for h in draws)
                index = Exceptions(data)
                n, one, two = _cuts(data, off, h1, h2, unit, index)
                plain = (np.diff(off) == 0) | held[lo:hi] | (h3 % 100 >= rate)
                spm = h4 % 100 < suffix_first
                start, chars_one = index.chars(off[:-1]), index.chars(one)
                numbers = [pa.array(v, pa.int64(), mask=plain) for v in (chars_one - start, index.chars(two) - chars_one, one - off[:-1], two - one)]
                raw, out = data.tobytes(), []
                for i in range(hi - lo):
                    a, b, c, d = off[i], one[i], two[i], off[i + 1]
                    if plain[i]:
                        out.append(raw[a:d])
                    elif spm[i]:
                        out.append(b"".join([marks[1], raw[c:d], marks[0], raw[a:b], marks[2], raw[b:c]]))
                    else:
                        out.append(b"".join([marks[0], raw[a:b], marks[1], raw[c:d], marks[2], raw[b:c]]))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *numbers, pa.array(out, pa.binary())], names=NAMES)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_draws("doc_id", seed)).mapInArrow(run, schema)
    return made.withColumn("output", F.col("output").cast("string"))


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"]


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of: its parts between the marks, each of which stands there once, in their first order."""
    p, s, m = sentinels
    text = F.col(output)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head, rest = F.substring_index(text, second, 1), F.substring_index(text, second, -1)
        return F.substr(head, F.lit(len(first) + 1)), F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(F.col(form) == "plain", text).when(F.col(form) == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def digests(docs: DataFrame) -> DataFrame:
    """The lengths of :func:`fill_in_middle`, with the digests of its output and of the text rebuilt from that."""
    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))
