"""Document fingerprints: the bottom-k sketch of a text's five-word shingle hashes.

A fingerprint is the ``k`` smallest distinct 64-bit shingle hashes in ascending order. Sketches merge by
taking the ``k`` smallest of their union, so parts of a text or a corpus can be sketched apart. Everything is
built-in Spark functions: one scan, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the ``words``-word shingles of a lower-cased text. Fewer words: one shingle of them all; none or NULL: empty."""
    split = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+"), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    # let-binding: the one-element array keeps the word hashes from being computed again for each shingle
    rolled = F.flatten(
        F.transform(
            F.array(hashed),
            lambda h: F.when(
                F.size(h) >= words,
                F.transform(F.slice(h, 1, F.size(h) - (words - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)])),
            )
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>")),
        )
    )
    return F.array_distinct(rolled)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """Bottom-k sketch of a text as ``array<bigint>``."""
    return bottom_k(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom_k(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom-k that both sketches hold. Two empty ones: 1; one empty: 0."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; an empty ``a`` is contained in anything."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def merge_rows(rows: DataFrame, key: str, sketch_column: str, k: int = K) -> DataFrame:
    """Merge the sketches of each key's parts. Only hashes among a part's k smallest travel, and each key keeps
    the k smallest of the distinct ones."""
    parts = rows.select(key, F.explode(sketch_column).alias("hash")).distinct()
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).where(F.col("place") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(sketch_column))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _longs(values: list[int]) -> Column:
    """Numbers as one array constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the value, found in two steps of about the square root of their number."""
    width = max(1, math.isqrt(len(cuts)))
    blocks = F.split(F.lit(";".join(",".join(map(str, cuts[i : i + width])) for i in range(0, len(cuts), width))), ";")
    block = F.size(F.filter(_longs(cuts[::width]), lambda c: c <= value))
    inner = F.split(F.get(blocks, block - 1), ",").cast("array<bigint>")
    return F.when(block > 0, (block - 1) * width + F.size(F.filter(F.coalesce(inner, _longs([])), lambda c: c <= value))).otherwise(0) if cuts else F.lit(0)


def with_next(docs: DataFrame, made: Column, bucket_rows: int, most_buckets: int) -> DataFrame:
    """Each row (``doc_id``, ``text``) with ``sketch`` (``made``, an expression of its text) and with ``next_text, next_sketch``
    of the next row by descending ``doc_id``; the last one's next is the first.

    Ids are cut into ranges of about ``bucket_rows`` rows, as many as ``most_buckets``; beyond that ranges grow. A range of
    a single id is cut further by a hash of the text, into its share of ``most_buckets`` at most, so the driver holds twice that number of rows. Each range's window also sees
    the first row of the one after it, so no task sees more than one range. NULL ids come last; equal ids follow one
    another by that hash, then by text.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    buckets = max(1, min(most_buckets, docs.count() // bucket_rows))
    found = keyed.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], max(10000, 4 * buckets)), F.min("id")).first()
    cuts = sorted({*(found[0] or [])} - {found[1]})
    keyed = keyed.withColumn("range", _range_of(F.col("id"), cuts).cast("int"))
    sizes = keyed.groupBy("range").agg(F.count("*").alias("n"), (F.min("id") == F.max("id")).alias("single")).collect()  # a row for each range
    parts = [1] * (len(cuts) + 1)
    total = sum(r["n"] for r in sizes)
    for r in sizes:  # no more than most_buckets in all
        parts[r["range"]] = max(1, min(r["n"] // bucket_rows, most_buckets * r["n"] // total)) if r["single"] else 1
    share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    keyed = keyed.withColumn("part", F.floor(F.least(share, F.lit(1 - 1e-12)) * F.get(_longs(parts), F.col("range"))).cast("int"))
    tops = keyed.groupBy("range", "part").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("back"))).alias("top")).collect()  # likewise
    order = sorted(tops, key=lambda r: (-r["range"], r["part"]))
    # the first row of each range also stands, as a guest, at the end of the one before it
    moved = [(r["top"]["id"], ~r["top"]["back"], order[i - 1]["range"], order[i - 1]["part"]) for i, r in enumerate(order)]
    hosts = spark.createDataFrame(moved, "id long, tie long, range int, part int")
    guests = keyed.select("id", "tie", "text").join(F.broadcast(hosts), ["id", "tie"]).groupBy("range", "part").agg(F.min("text").alias("text"))
    own = keyed.withColumn("guest", F.lit(0))
    both = own.unionByName(guests.withColumn("guest", F.lit(1)), allowMissingColumns=True).withColumn("sketch", made)
    down = Window.partitionBy("range", "part").orderBy("guest", F.desc("id"), "tie", "text")
    rows = both.withColumns({"next_text": F.lead("text").over(down), "next_sketch": F.lead("sketch").over(down)})
    return rows.where("guest = 0").drop("id", "tie", "range", "part", "guest")


def fingerprints(docs: DataFrame, k: int = K, bucket_rows: int = 2000, most_buckets: int = 1 << 16) -> DataFrame:
    """The fingerprint of each text and of its edited text (the last ``floor(n/3)`` code points replaced by the
    first as many, or all, of the next document).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    distinct_shingles``. NULL text counts as empty; an empty text has an empty fingerprint, whose likeness to
    another empty one is 1 and to any other 0. Equal texts have equal fingerprints; repeated rows are each
    returned; an empty table gives no row; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    paired = with_next(docs.select("doc_id", text), sketch(F.col("text"), k), bucket_rows, most_buckets)
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    # a generator keeps the optimiser from copying the sketch expression into each of its uses
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", F.explode(F.array(sketch(F.col("edited"), k))).alias("edited_sketch"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
    )
