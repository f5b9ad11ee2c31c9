"""Phrase mining by dynamic itemset counting.

The corpus is written once as ``SHARDS`` shards of word numbers. Scans go round the shards. Words are counted from
the first one; a longer phrase is counted from the scan after both its subphrases (all but its last, all but its first
word) have reached the threshold, at whatever shard that is, until it has seen every shard once. So lengths
interleave, and most of a corpus' phrases are complete after two rounds instead of five.

Counters are a table in the shared folder, however large. What has reached the threshold, and at which of the last scans,
tasks look up in bit tables of fixed size, which have no false negatives: a false positive is counted without need, but
counted right, since a task always counts all occurrences of a phrase in its shard. Each counter remembers which shards it
has seen, so none counts twice, and goes when its cycle is over without reaching the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import BASE, Hasher, U, lower_ascii, mix, pieces
from .common import cut, drop_path, drop_table, scratch_path

SHARDS = 4
LONGEST = 5
LEAST = 100
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
COVERED = 100
TOP = 2000
#: Bits of a table that tasks look phrases up in: 4 MB, whatever the corpus; there are ``SHARDS`` + 1.
FILTER_BITS = 25
#: Different phrases that a task sums up before it hands them on.
HELD = 1 << 20
#: Words of a stretch that are counted at a time, and rows of one batch that a task hands on: both bound a task's memory.
PART_WORDS = 1 << 18
OUT_ROWS = 1 << 15
#: Words that a task goes over, at least where there are enough cores: the more, the fewer rows it hands on.
TASK_WORDS = 6_000_000
_BASES = (BASE, 0xD1342543DE82EF95)
_FACTORS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _language_seed(lang: str) -> tuple[np.uint64, np.uint64]:
    digest = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    return U(int.from_bytes(digest[:8], "little")), U(int.from_bytes(digest[8:], "little"))


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, text, new)`` of the words: their places, their text, and whether a piece begins with them."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    solid = _WORD[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    text = np.searchsorted(off, starts, "right") - 1
    breaks = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])
    return starts, ends, text, new


def _runs(keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(first, counts)``: the equal pairs of two key columns, as places of one of each and how many there are."""
    order = np.argsort(keys[0], kind="stable")
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    return order[begin], np.diff(np.append(begin, len(order)))


def _stretch(texts: pa.Array, codes: np.ndarray, seeds: list[np.ndarray]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(raw, starts, ends, own, new, keys)`` of the words of ``texts``: their bytes and places in them, their language (as in
    ``codes``), whether a piece begins with them, and both halves of their keys. Texts are hashed a few at a time, since hashing
    takes many times their size: a task's memory does not hold that for a whole stretch."""
    raw, parts, at = [], [], 0
    for lo, hi, data, off in pieces(texts):
        low = lower_ascii(data)
        starts, ends, text, new = _tokens(low, off)
        own = codes[lo:hi][text]
        keys = [mix(Hasher(low, base).at(starts, ends) ^ seed[own]) for base, seed in zip(_BASES, seeds, strict=True)]
        raw.append(low.tobytes())
        parts.append([starts + at, ends + at, own, new, *keys])
        at += len(low)
    starts, ends, own, new, *keys = (np.concatenate(x) for x in zip(*parts, strict=True))
    return b"".join(raw), starts, ends, own, new, keys


#: A stretch of a task's texts: its languages with their numbers of words; its different words with language (a number),
#: count and 128-bit key; and the texts as numbers of these words, with -1 where a piece ends.
SHARD_SCHEMA = "shard int, langs array<string>, n_words array<long>, words array<string>, own array<int>, counts array<long>, h1 array<long>, h2 array<long>, tokens binary"


def write_shards(docs: DataFrame, path: str, shards: int, piece: int = 1 << 22) -> None:
    """``docs`` (``lang``, ``text``) as rows of ``SHARD_SCHEMA``, a row for each ``piece`` bytes of a task's texts, laid out by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            codes, langs = names.indices.to_numpy(), names.dictionary
            seeds = [np.array(x, np.uint64) for x in zip(*map(_language_seed, langs.to_pylist()), strict=True)]
            for lo, hi, *_ in pieces(batch.column("text"), piece):
                raw, starts, ends, own, new, keys = _stretch(batch.column("text").slice(lo, hi - lo), codes[lo:hi], seeds)
                first, counts = _runs((keys[0], keys[1]))
                number = np.empty(len(starts), np.int32)
                number[np.argsort(keys[0], kind="stable")] = np.repeat(np.arange(len(first), dtype=np.int32), counts)
                columns = [
                    langs, pa.array(np.bincount(own, minlength=len(langs))), pa.array([raw[a:b] for a, b in zip(starts[first], ends[first], strict=True)], pa.binary()),
                    pa.array(own[first], pa.int32()), pa.array(counts, pa.int64()), *[pa.array(k[first].view(np.int64)) for k in keys],
                ]
                whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([shard % shards], pa.int32()), *whole, pa.array([np.insert(number, np.flatnonzero(new), -1).tobytes()], pa.binary())], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])
                shard += 1

    made = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, SHARD_SCHEMA.replace("words array<string>", "words array<binary>"))
    made.withColumn("words", F.col("words").cast("array<string>")).write.partitionBy("shard").parquet(path)


class Bits:
    """Bit tables of the keys that reached the threshold: one of all, and one for each of the last scans."""

    def __init__(self, bits: int):
        self.bits = bits
        self.every = np.zeros(1 << bits - 6, np.uint64)
        self.recent: dict[int, np.ndarray] = {}

    def add(self, keys: DataFrame, step: int) -> None:
        """Set the two bits of each of ``keys`` (``h1``). Tasks fold keys of one 64-bit word before the shuffle, and the
        driver gets a row for each word at most: the table's fixed size."""
        places = F.array(F.shiftrightunsigned("h1", 64 - self.bits), F.col("h1").bitwiseAND((1 << self.bits) - 1))
        spots = keys.select(F.explode(places).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        table = np.zeros_like(self.every)
        table[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
        self.recent[step] = table
        self.every |= table

    def forget(self, step: int) -> None:
        self.recent = {s: t for s, t in self.recent.items() if s >= step}

    def anew(self) -> bool:
        return any(t.any() for t in self.recent.values())


def _has(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in (keys >> U(64 - bits), keys & U((1 << bits) - 1)):
        out &= (table[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
    return out


def _latest(recent: dict[int, np.ndarray], bits: int, keys: np.ndarray) -> np.ndarray:
    """The last of the steps whose table has each key, or -1."""
    out = np.full(len(keys), -1, np.int16)
    for step, table in sorted(recent.items()):
        out[_has(table, bits, keys)] = step
    return out


def _parts(tokens: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``tokens`` cut where pieces end, into parts of about ``most``; a longer piece is a part of its own."""
    ends, lo = np.flatnonzero(tokens < 0), 0
    while lo < len(tokens):
        i = int(np.searchsorted(ends, lo + most))
        hi = int(ends[i]) if i < len(ends) else len(tokens)
        yield tokens[lo:hi]
        lo = hi


def _phrases(batch: pa.RecordBatch, table: Bits, longest: int, most: int = 1 << 62) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For each length from 2, at the places where both subphrases reached the threshold: ``(length, keys, step, keys of the
    first and of the second subphrase)``; ``step`` is the last at which one of them did, or -1 if that is long ago. A stretch of
    texts is gone over in parts of ``most`` words."""
    for h1, h2, raw in zip(batch.column("h1"), batch.column("h2"), batch.column("tokens"), strict=True):
        words = [h.values.to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2)]
        known, late = _has(table.every, table.bits, words[0]), _latest(table.recent, table.bits, words[0])
        for tokens in _parts(np.frombuffer(raw.as_buffer(), np.int32), most):
            at = np.flatnonzero(tokens >= 0)
            at = at[known[tokens[at]]]  # where a known phrase of the present length begins
            step, keys = late[tokens[at]], [w[tokens[at]] for w in words]
            for n in range(2, longest + 1):
                # a phrase of n words begins where one of n - 1 does and another one word later
                pair = np.flatnonzero(at[1:] == at[:-1] + 1)
                if not len(pair):
                    break
                subs = [[k[pair] for k in keys], [k[pair + 1] for k in keys]]
                last = tokens[at[pair] + n - 1]
                # the key folds that of the first n - 1 words and the last word's
                keys = [mix(k * f + w[last] + U(n)) for k, f, w in zip(subs[0], _FACTORS, words, strict=True)]
                yield n, keys, np.maximum(step[pair], step[pair + 1]), *subs
                at = at[pair]
                keep = _has(table.every, table.bits, keys[0])
                at, keys = at[keep], [k[keep] for k in keys]
                step = _latest(table.recent, table.bits, keys[0])


COUNTS = "len byte, h1 long, h2 long, since short, n long"


def _counted(batches: Iterator[pa.RecordBatch], table: Bits, longest: int, words: bool) -> Iterator[pa.RecordBatch]:
    """``COUNTS`` of what is counted in a shard: words, if they still are, and the phrases one of whose subphrases reached the
    threshold at one of the last scans. ``since`` is the scan after that."""
    held: list[list[np.ndarray]] = []

    def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [list(x) for x in zip(*parts, strict=True)]
        parts.clear()

        def joined(i: int) -> np.ndarray:  # a column at a time, so that the parts are there once only
            whole = np.concatenate(columns[i])
            columns[i].clear()
            return whole

        h1 = joined(1)
        order = np.argsort(h1, kind="stable")  # rows of one hash that differ otherwise may stay apart
        h1 = h1[order]
        length, h2, since, n = (joined(i)[order] for i in (0, 2, 3, 4))
        del order
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (length[1:] != length[:-1])
        begin = np.flatnonzero(new)
        return [length[begin], h1[begin], h2[begin], np.maximum.reduceat(since, begin), np.add.reduceat(n, begin)] if len(begin) else [length, h1, h2, since, n]

    def out(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(part[0]), OUT_ROWS):
            length, h1, h2, since, n = (x[lo : lo + OUT_ROWS] for x in part)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(since), pa.array(n)], names=[c.split()[0] for c in COUNTS.split(", ")])

    def full() -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in held) > HELD:
            part = summed(held)
            if len(part[0]) > HELD // 2:
                yield from out(part)
            else:
                held.append(part)

    for batch in batches:
        if words:
            for h1, h2, n in zip(batch.column("h1"), batch.column("h2"), batch.column("counts"), strict=True):
                keys = [h.values.to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2)]
                held.append([np.ones(len(keys[0]), np.int8), *keys, np.zeros(len(keys[0]), np.int16), n.values.to_numpy(zero_copy_only=False)])
                yield from full()
        for length, keys, step, *_ in _phrases(batch, table, longest, PART_WORDS):
            some = np.flatnonzero(step >= 0)
            if len(some):
                first, counts = _runs((keys[0][some], keys[1][some]))
                one = some[first]
                held.append([np.full(len(one), length, np.int8), keys[0][one], keys[1][one], step[one] + np.int16(1), counts])
                yield from full()
    if held:
        yield from out(summed(held))


def _updated(state: DataFrame | None, found: DataFrame, shard: int, step: int, shards: int, least: int) -> DataFrame:
    """The counters after a scan: ``len, h1, h2, since, seen`` (shards, as bits), ``total``, ``box`` (the step at which ``least`` was reached).

    Of a phrase, all occurrences in the shard are added, unless it has seen the shard. Where a cycle has ended without
    ``least``, the counter goes.
    """
    bit = 1 << shard
    new = found.withColumns({"seen": F.lit(None).cast("int"), "total": F.lit(None).cast("long"), "box": F.lit(None).cast("short")})
    both = new if state is None else state.withColumn("n", F.lit(None).cast("long")).unionByName(new)
    # tasks have summed up what they found: summing again before the shuffle would hold all of it and fold next to nothing
    merged = both.repartition("len", "h1", "h2").groupBy("len", "h1", "h2").agg(*[F.max(c).alias(c) for c in ("since", "seen", "total", "box")], F.sum("n").alias("n"))
    seen, total = F.coalesce("seen", F.lit(0)), F.coalesce("total", F.lit(0))
    fresh = F.col("n").isNotNull() & (seen.bitwiseAND(bit) == 0)
    now = total + F.when(fresh, F.col("n")).otherwise(0)
    open_ = F.lit(step) < F.col("since") + shards - 1
    return merged.where((now >= least) | open_).select(
        "len", "h1", "h2", "since", F.when(fresh, seen.bitwiseOR(bit)).otherwise(seen).alias("seen"), now.alias("total"), F.coalesce("box", F.when(now >= least, step).cast("short")).alias("box"),
    )


LINKS = "len byte, h1 long, h2 long, p1 long, p2 long, s1 long, s2 long, lang string, word string"


def _linked(batches: Iterator[pa.RecordBatch], table: Bits, wanted: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """``LINKS`` of what ``wanted`` has, once for each row of a shard: keys of both subphrases of a phrase, language and text of a word."""
    names = [c.split()[0] for c in LINKS.split(", ")]
    long = lambda values: pa.array(values.view(np.int64))
    for batch in batches:
        for langs, words, own, h1, h2 in zip(*(batch.column(c) for c in ("langs", "words", "own", "h1", "h2")), strict=True):
            keys = [h.values.to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2)]
            some = pa.array(np.flatnonzero(_has(wanted, table.bits, keys[0])))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int8)), *(long(k).take(some) for k in keys), none, none, none, none, langs.values.take(own.values.take(some)), words.values.take(some)], names=names)
        for length, keys, _, left, right in _phrases(batch, table, longest):
            some = np.flatnonzero(_has(wanted, table.bits, keys[0]))
            one = some[_runs((keys[0][some], keys[1][some]))[0]]
            empty = pa.nulls(len(one), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), length, np.int8)), *(long(k[one]) for k in (*keys, *left, *right)), empty, empty], names=names)


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: words and phrases that occur ``least`` times or more, as ``LINKS`` with ``a``, their number; and
    ``lang, n``, the words of each language. Both are tables in the shared folder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs, path, shards)
    schema = SHARD_SCHEMA.replace("shard int, ", "")
    there = {f.getPath().getName() for f in _listed(spark, path)}
    every = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = cut(every.select(F.inline(F.arrays_zip("langs", "n_words"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("n_words").alias("n")), "word-totals")
    tasks = max(spark.sparkContext.defaultParallelism, (totals.agg(F.sum("n")).first()[0] or 0) // shards // TASK_WORDS)
    shard_rows = lambda k: spark.read.schema(schema).parquet(f"{path}/shard={k}").coalesce(tasks) if f"shard={k}" in there else spark.createDataFrame([], schema)
    table, state, step = Bits(bits), None, 0
    while step < shards or table.anew():
        shard = step % shards
        shared = spark.sparkContext.broadcast(table)  # tables of fixed size
        found = shard_rows(shard).select("h1", "h2", "counts", "tokens").mapInArrow(lambda b, t=shared, w=step < shards: _counted(b, t.value, longest, w), COUNTS)
        state, old = cut(_updated(state, found, shard, step, shards, least), "counters"), state
        if old is not None:
            drop_table(old)
        shared.destroy()
        # phrases of most words are part of no longer one
        table.forget(step + 1 - shards)
        table.add(state.where((F.col("box") == step) & (F.col("len") < longest)).select("h1"), step)
        step += 1
    frequent = state.where(F.col("total") >= least).select("len", "h1", "h2", "seen", F.col("total").alias("a"))
    # what a phrase consists of is looked up in the first shard that has it: one more scan of one shard, mostly
    table.recent, keys = {}, ["len", "h1", "h2"]
    links, sent = spark.createDataFrame([], LINKS), []
    for k in range(shards):
        first = Bits(bits)
        first.add(frequent.where(F.col("seen").bitwiseAND((2 << k) - 1) == 1 << k), step)
        if first.every.any():
            sent.append(spark.sparkContext.broadcast((table, first.every)))
            links = links.unionByName(shard_rows(k).select("langs", "words", "own", "h1", "h2", "tokens").mapInArrow(lambda b, t=sent[-1]: _linked(b, *t.value, longest), LINKS))
    links = links.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("p1", "p2", "s1", "s2", "lang", "word")])
    phrases = cut(links.join(frequent.drop("seen"), keys), "frequent")
    for t in sent:
        t.destroy()
    drop_table(state)
    drop_path(path)
    return phrases, totals


def _listed(spark: SparkSession, path: str) -> list:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)


def _spelled(phrases: DataFrame, totals: DataFrame, longest: int) -> list[DataFrame]:
    """Tables of the phrases of 1, 2, ... words with their text: ``lang, phrase, last, h1, h2, a, n, lefts, rights`` and the keys of
    their subphrases. ``lefts`` and ``rights`` hold the counts of the phrase's beginnings and of its ends, shortest first."""
    none = F.array().cast("array<bigint>")
    level = phrases.where("len = 1").join(totals, "lang").select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "h1", "h2", "a", "n", none.alias("lefts"), none.alias("rights"))
    out = [level]
    for n in range(2, longest + 1):
        left = level.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), "lang", "n", F.col("phrase").alias("head"), F.concat("lefts", F.array("a")).alias("lefts"))
        right = level.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "last", F.concat("rights", F.array("a")).alias("rights"))
        own = phrases.where(F.col("len") == n).drop("len", "lang", "word")
        level = cut(own.join(left, ["p1", "p2"]).join(right, ["s1", "s2"]).withColumn("phrase", F.concat_ws(" ", "head", "last")).drop("head"), f"phrases-{n}")
        out.append(level)
    return out


def _score() -> Column:
    """``array<struct<score, k, l, r>>``: the value of each cut of a phrase. Whole numbers of up to 38 digits."""
    parts = F.size("lefts")
    cuts = F.sequence(F.lit(1), parts)
    whole = F.expr("cast(1000 * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n as decimal(18,0))")
    halves = F.transform(cuts, lambda k: F.struct(k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("rights", parts - k + 1).alias("r"), whole.alias("w")))
    return F.transform(halves, lambda c: F.struct(F.call_function("div", c["w"], c["l"].cast("decimal(18,0)") * c["r"].cast("decimal(18,0)")).alias("score"), c["k"], c["l"], c["r"]))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` collocations of each language in ``docs`` (``lang``, ``text``; others are ignored).

    Returns ``lang, rank, phrase, a, l, r, n, score, cut_after``. Words are runs without blank and tab in pieces between ``.,;:!?``
    and line ends, A-Z lower-cased; phrases have 2 to ``longest`` words, ``least`` occurrences or more, and score
    ``1000 a n / (l r)`` (floored) at their weakest cut. One whose words stand inside a longer phrase with ``covered`` / 100 of its
    occurrences is left out. NULL text is empty, NULL language ``und``; repeated rows count each; a text of any length counts
    whole; without phrases, as for an empty table, no row is returned. Equal scores go by occurrences, then by the phrase's bytes.
    """
    if longest < 2 or not 1 <= shards <= 30:
        raise ValueError("phrases have two words or more, shards are 1 to 30")
    phrases, totals = count_phrases(docs, least, longest, shards, bits)
    levels = _spelled(phrases, totals, longest)
    both = levels[1]
    for t in levels[2:]:
        both = both.unionByName(t)
    # a longer phrase with enough occurrences has one of one word more around this one, with no fewer
    around = both.select(F.explode(F.array(F.struct(F.col("p1").alias("h1"), F.col("p2").alias("h2")), F.struct(F.col("s1").alias("h1"), F.col("s2").alias("h2")))).alias("sub"), "a")
    most = around.groupBy("sub.h1", "sub.h2").agg(F.max("a").alias("outer"))
    kept = both.join(most, ["h1", "h2"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < covered * F.col("a")))
    best = kept.withColumn("best", F.array_min(_score()))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"), F.col("best.k").alias("cut_after"))
    result = cut(out, "collocations")
    for t in (phrases, totals, *levels[1:]):
        drop_table(t)
    return result
