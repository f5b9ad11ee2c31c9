"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a text editor sees it: the engine's ``\s`` alone leaves out separators and control blanks.
SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLOZE = "\\{\\{c\\d+::.+?\\}\\}"
#: Words that cannot be an answer by themselves.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can",
    "do", "does", "for", "from", "had", "has", "have", "if", "in", "into",
    "is", "it", "its", "may", "not", "of", "on", "or", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "were",
    "which", "will", "with", "you", "your",
)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def normalize_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), f"{SPACE}+", " "))


def is_valid_cloze(text: Column) -> Column:
    """Not blank, with at least one ``{{cN::...}}`` on one line."""
    return ~is_blank(text) & F.coalesce(text.rlike(CLOZE), F.lit(False))


def is_stopwords_only(text: Column) -> Column:
    """No word is left after normalising but stop words."""
    words = F.split(normalize_text(text), " ")
    return F.coalesce(F.forall(words, lambda w: (w == "") | w.isin(*STOPWORDS)), F.lit(True))


def token_is_stopword(token: Column) -> Column:
    """The same for a token that is not empty: most have more letters than any stop word, or no blank within, and are told by
    one lookup."""
    bare = F.translate(F.lower(token), PUNCTUATION, "")
    one = (bare == "") | bare.isin(*STOPWORDS)
    return F.when(~token.rlike(SPACE), one).otherwise(is_stopwords_only(token))


def html_escape(text: Column) -> Column:
    """The five characters that matter to HTML, ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def slugify(name: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; ``deck`` if none is left."""
    dashed = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("deck"))


def deck_id(name: Column) -> Column:
    """A stable ten-digit id: from the first eight bytes of the name's SHA-256."""
    head = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.lit(1_000_000_000) + (head % F.lit(999_999_999).cast("decimal(20,0)")).cast("long")).cast("long")


def word_pieces(text: Column) -> Column:
    """The text cut before each word: every piece but the first starts with a word and keeps the blanks after it."""
    return F.split(text, f"(?<={SPACE})(?=[^\\s\\x1c-\\x1f\\x85\\p{{Z}}])")


def line_word_offsets(text: Column) -> Column:
    """``array<struct<char_start, char_length>>`` of the words of a line, row-local: meant for lines, not for whole documents."""

    def places(pieces: Column) -> Column:
        placed = F.transform(pieces, lambda p, i: F.struct(F.length(F.array_join(F.slice(pieces, F.lit(1), i), "")).cast("long").alias("char_start"), F.length(strip(p)).cast("long").alias("char_length")))
        return F.filter(placed, lambda p: p["char_length"] > 0)

    # a one-element array binds the pieces once
    return F.get(F.transform(F.array(word_pieces(text)), places), F.lit(0))


#: Code points that are white space to a text editor.
_BLANKS = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, length)`` in code points of the words of an Arrow column of texts, all rows at once; NULL has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())]).astype(np.int64)
    if not len(points):
        return (np.zeros(0, np.int64),) * 3
    solid = np.append(~np.isin(points, _BLANKS), False)
    edge = np.zeros(len(points) + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge[1:])) + 1
    row = np.searchsorted(begin, starts, "right") - 1
    return row, starts - begin[row], ends - starts


def lines_of(text: str, line_words: int) -> list[str]:
    """The lines of a text whose words are parted by single blanks."""
    words = text.split(" ")
    return [" ".join(words[i : i + line_words]) for i in range(0, len(words), line_words)]


class WordSpans:
    """Table function of a table with a column ``text``: its other columns and ``char_start, char_length``, a row for each word.

    A call handles an Arrow batch of rows.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        row, start, length = word_places(batch.column("text"))
        rows = pa.array(row)
        kept = {n: batch.column(n).take(rows) for n in batch.schema.names if n not in ("text", "char_start", "char_length")}
        yield pa.table({**kept, "char_start": pa.array(start.astype(np.int32)), "char_length": pa.array(length.astype(np.int32))})


def register_word_spans(spark, keys: str = "", name: str = "word_spans") -> None:
    """Make the table function known to SQL, for use as ``word_spans(TABLE(...))``; ``keys`` are the table's columns besides
    ``text``, with their types and in their order."""
    schema = ", ".join(filter(None, [keys, "char_start int, char_length int"]))
    spark.udtf.register(name, F.arrow_udtf(WordSpans, returnType=schema))
