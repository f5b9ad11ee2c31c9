"""N-gram Jaccard join by grouped prefixes.

A document is the set of its five-word shingles. Two sets of similarity 0.8 or more share at least one of the
first ``n - ceil(0.8 n) + 1`` shingles of each in any common order; the order here puts frequent shingles
last (counts of all documents, in a fixed number of buckets), so a passage of a third of the corpus hardly
ever is in a prefix. Documents with one prefix and size are one group, only groups are joined by prefix
shingles, and members are expanded and verified on their whole sets.

Verification goes by star: each prefix shingle's groups are first compared with one leader, so a cluster of
thousands costs one comparison for each member; then only pairs that still lie in different components are
compared, and those meet by shingle and size. No link between different components is lost, and members of one need no further proof.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Hasher, U, lists, lower_ascii, mix, pieces, shingles, word_bounds
from .common import cut, drop_table, give_back
from .components import components

#: Buckets of the shingle counts: a table of fixed size, whatever the corpus.
COUNT_BITS = 20
#: Slices in which they are summed, and least number of tasks that sum them.
SLICES, SUMMERS = 4096, 128
WORDS = 5


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sorted distinct shingle hashes of each text)`` for runs of rows."""
    for lo, _, data, off in pieces(column):
        low = lower_ascii(data)
        starts, ends, first = word_bounds(low, off)
        hashes, begin = shingles(Hasher(low).at(starts, ends), first, words)
        yield lo, [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(off) - 1)]


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _least_common(n: int, percent: int) -> int:
    """Fewest common shingles of two similar sets of ``n``."""
    return (2 * percent * n + 99 + percent) // (100 + percent)


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle in each bucket, over all of ``docs``.

    Each task counts into one array of fixed size and cuts it into slices; slices are dealt out and summed each in its
    own place, by as many tasks as the session shuffles into (``SUMMERS`` at least, ``SLICES`` at most), and the driver
    gets one array.
    """
    size, width = 1 << COUNT_BITS, (1 << COUNT_BITS) // SLICES
    summers = min(SLICES, max(SUMMERS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)  # a task has fewer documents than that
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), words):
                total += np.bincount((np.concatenate(sets) >> U(64 - COUNT_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part.tobytes() for part in total.reshape(SLICES, width)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                totals[k] = totals.get(k, np.zeros(width, np.uint64)) + np.frombuffer(part.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["slice", "counts"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(summers, "slice").mapInArrow(add, "slice int, counts binary")
    total = np.zeros((SLICES, width), np.uint64)
    for row in parts.collect():  # SLICES rows, one array of fixed size in all
        total[row["slice"]] = np.frombuffer(row["counts"], np.uint64)
    return total.ravel()


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the common order: rare buckets first, then by hash."""
    return s[np.lexsort((s, counts[(s >> U(64 - COUNT_BITS)).astype(np.int64)]))]


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """A set in 128 bits."""
    return mix(s).sum(dtype=np.uint64), (mix(s ^ U(0x5851F42D4C957F2D)) * U(3)).sum(dtype=np.uint64)


def prefixes(docs: DataFrame, counts: Broadcast, words: int = WORDS, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, grp, prefix``: size, digest of the set, group (equal prefix and size), and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, group, parts = [], [], [], []
            for _, sets in shingle_sets(batch.column("text"), words):
                for s in sets:
                    n = _prefix_length(len(s), percent)
                    head = _ordered(s, counts.value)[:n]
                    size.append(len(s))
                    digest.append(_digest(s))
                    group.append(mix(np.array([mix(head * U(2 * len(s) + 1)).sum(dtype=np.uint64) + U(len(s))], np.uint64))[0])
                    parts.append(head)
            d = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
            begin = np.cumsum([0, *map(len, parts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.array(group, np.uint64).view(np.int64)), lists(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64), begin, pa.int64())],
                names=["doc_id", "n_shingles", "d1", "d2", "grp", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, grp long, prefix array<long>")


def deeper_shingles(docs: DataFrame, counts: Broadcast, words: int = WORDS, percent: int = 80) -> DataFrame:
    """``doc_id, d1, d2, token``: the shingles after the prefix of which two similar sets of equal size and prefix share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), words):
                parts = []
                for s in sets:
                    at = _prefix_length(len(s), percent)
                    parts.append(_ordered(s, counts.value)[at : at + len(s) - _least_common(len(s), percent) + 1])
                row = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
                d = np.array([_digest(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)[row]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(lo + row)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "d1", "d2", "token"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, token long")


def set_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, shingle_set`` (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), words):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingle_set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle_set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough, with the sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                common[i] = np.count_nonzero(both[1:] == both[:-1])
                union[i] = len(both) - common[i]
            keep = pa.array(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(union)], names=["a", "b", "common", "in_union"]).filter(keep)

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingle_set").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingle_set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long, in_union long")


def _could_link(n: str, m: str, i: str, j: str, percent: int) -> F.Column:
    """Sizes are near enough, and if the shingle at places ``i`` and ``j`` is the first common one, enough are left after it."""
    small, large = F.least(n, m), F.greatest(n, m)
    most = 1 + F.least(F.col(n) - F.col(i) - 1, F.col(m) - F.col(j) - 1)
    return (100 * small >= percent * large) & (most * (100 + percent) >= percent * (F.col(n) + F.col(m)))


def _band(size: Column, percent: int) -> Column:
    """Band of a set's size; sizes near enough to link lie in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / math.log(max(100 / percent, 1.1))).cast("int")


def _still_open(members: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that share a prefix shingle and could link: ``a, b``.

    Of two sets that link, the smaller one has a common shingle in the shorter prefix that two sets of its own size
    need. So only that much of each set is looked up, by shingle and band of size, and sets that merely share a
    frequent passage, each with more of its own, do not meet at all.
    """
    rows = shared.select("token", "head", "n", "place").join(members, "head")
    ends = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rows = rows.join(ends, "token", "left_semi")
    short = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1
    small = rows.where(F.col("place") < short).select("token", _band(F.col("n"), percent).alias("band"), F.col("rep").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("component").alias("ac"))
    least = F.ceil(F.col("n") * percent / 100)
    large = rows.select("token", F.explode(F.sequence(_band(least, percent), _band(F.col("n"), percent))).alias("band"), F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bp"), F.col("component").alias("bc"))
    met = small.join(large, ["token", "band"]).where("ac <> bc and (an < bn or (an = bn and a < b))").where(_could_link("an", "bn", "ap", "bp", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _within_groups(members: DataFrame, docs: DataFrame, counts: Broadcast, words: int, percent: int) -> DataFrame | None:
    """Pairs of sets of one group in different components that share one of their next shingles as well: ``a, b``."""
    mixed = members.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("head")
    rows = members.join(mixed, "head", "left_semi")
    if rows.isEmpty():
        return None
    texts = docs.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    deep = deeper_shingles(texts, counts, words, percent).distinct().withColumnRenamed("doc_id", "rep")
    keyed = rows.join(deep, ["rep", "d1", "d2"]).select("head", "token", "rep", "component")
    left, right = keyed.withColumnsRenamed({"rep": "a", "component": "ac"}), keyed.withColumnsRenamed({"rep": "b", "component": "bc"})
    return left.join(right, ["head", "token"]).where("a < b and ac <> bc").select("a", "b")


def _between(links: DataFrame, members: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b``) as links between the components of their ends."""
    own = members.select("rep", "component").distinct()  # different sets of one id are one document
    left, right = own.withColumnsRenamed({"rep": "a", "component": "ac"}), own.withColumnsRenamed({"rep": "b", "component": "bc"})
    return links.join(left, "a").join(right, "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))


def link_classes(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """Component of each row of ``docs`` (``doc_id``, ``text``; others are ignored) under links of Jaccard similarity ``percent`` / 100 or more.

    Returns ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable). A NULL text, or one without
    words, has no shingle and is its own component; a text of fewer words than a shingle has one shingle of
    them all. Equal sets are linked; repeated rows are each returned; different texts under one id are one document,
    linked by what links any of them; a row without an id gets the class of rows with an equal set, else NULL; an empty
    table gives no row; very long texts take part whole.
    """
    docs = docs.select("doc_id", "text")
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))  # an array of fixed size
    whole = cut(prefixes(docs, counts, words, percent), "prefixes")
    give_back(docs.sparkSession)
    # one representative for each set, and one for each group of equal prefix and size
    reps = cut(whole.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("grp").alias("grp")), "reps")
    groups = reps.groupBy("grp").agg(F.min("rep").alias("head"), F.count("*").alias("members"))
    heads = whole.join(groups.select(F.col("head").alias("doc_id"), "grp"), ["doc_id", "grp"], "left_semi").dropDuplicates(["doc_id", "grp"])
    tokens = heads.select(F.col("doc_id").alias("head"), "n_shingles", F.posexplode("prefix").alias("place", "token"))
    # size and place in one number: three longs a row are all that is shuffled
    tokens = tokens.select("token", "head", (F.shiftleft("n_shingles", 32) + F.col("place")).alias("at"))
    leaders = tokens.groupBy("token").agg(F.min("head").alias("lead"), F.count("*").alias("times")).where("times > 1").select("token", "lead")
    shared = cut(tokens.join(leaders, "token").select("token", "head", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("place"), "lead"), "shared")
    give_back(docs.sparkSession)
    table = cut(whole.select("doc_id", "n_shingles", "d1", "d2"), "digests")
    drop_table(whole)
    give_back(docs.sparkSession)

    first = shared.where(F.col("head") == F.col("lead")).select("token", F.col("n").alias("lead_n"), F.col("place").alias("lead_place"))
    stars = shared.where(F.col("head") != F.col("lead")).join(first, "token").where(_could_link("n", "lead_n", "place", "lead_place", percent)).select(F.col("lead").alias("a"), F.col("head").alias("b"))
    inner = reps.join(groups.where("members > 1"), "grp").where(F.col("rep") != F.col("head")).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    pairs = cut(stars.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    give_back(docs.sparkSession)

    # whole sets only of documents that some prefix shingle ties to another
    tied = shared.select(F.col("head").alias("doc_id")).unionByName(inner.select(F.col("a").alias("doc_id"))).unionByName(inner.select(F.col("b").alias("doc_id"))).distinct()
    # repeated rows go before the sets are made, while the rows are still together by id
    once = docs.join(tied, "doc_id", "left_semi").withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"])
    sets = cut(set_table(once, words), "sets")
    give_back(docs.sparkSession)
    links = cut(verified(pairs, sets, percent).select("a", "b"), "links")
    give_back(docs.sparkSession)
    found = components(links)

    # what is left: sets that share a prefix shingle, or a group, and lie in different components
    member = reps.join(groups.select("grp", "head"), "grp").join(found, reps["rep"] == found["node"], "left")
    members = cut(member.select("head", "rep", "d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component")), "members")
    drop_table(found)
    give_back(docs.sparkSession)
    rest = _still_open(members.select("head", "rep", "component"), shared, percent)
    own = _within_groups(members, docs, counts, words, percent)
    pairs2 = cut((rest if own is None else rest.unionByName(own)).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    for t in (shared, pairs):
        drop_table(t)
    give_back(docs.sparkSession)
    links2 = cut(verified(pairs2, sets, percent).select("a", "b"), "links")
    drop_table(sets)
    give_back(docs.sparkSession)

    # these links tie components that are known by now, so only those are joined; mostly there are none
    final = None if links2.isEmpty() else components(_between(links2, members))
    label = members.select("d1", "d2", "n_shingles", "component")
    if final is not None:
        label = label.join(final.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("d1", "d2", "n_shingles", F.coalesce("least", "component").alias("component"))
    out = table.select("doc_id", "n_shingles", "d1", "d2").join(label, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result = cut(out, "classes")
    for t in (table, pairs2, links, links2, reps, members, *([] if final is None else [final])):
        drop_table(t)
    return result


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """``docs``, with its own columns: one row of each component, that of the smallest ``doc_id`` and then of the smallest text.

    Rows without an id are told apart by their text; those without an id and without words all stay.
    """
    blank = F.coalesce(F.col("text"), F.lit("")).rlike("^[ \\t-\\r]*$")
    key, place = "cardloom_key", "cardloom_place"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.col("text"))))
    loose = F.col("doc_id").isNull() & blank
    kept = link_classes(keyed.where(~loose).select(F.col(key).alias("doc_id"), "text"), words, percent).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    ranked = keyed.where(~loose).join(kept, key, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    return ranked.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(loose))
