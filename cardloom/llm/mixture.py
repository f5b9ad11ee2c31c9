"""Mixing sources to target weights: every source's documents in a random order, cut where its budget of words ends.

Each row gets a hash-random key. Ranges of keys, about equally many rows each, sort a source in many tasks; the
words of each range are summed, and two levels of prefix sums over these sums tell where a range begins in its source's
order. So every row knows how many words stand before it, and the budget is cut to the word: a budget beyond the source's
size takes whole epochs first. All of it is built-in Spark functions over a narrow table; texts are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table

#: Weights of the sources in order of their names, over and over.
WEIGHTS = (3, 1, 2)
#: The mix, in hundredths of all words; and how often a source may be taken.
SHARE, MOST = 150, 2
#: Rows of a range, about; and ranges whose sums one task goes through.
RANGE_ROWS, GROUP = 4000, 1024
KEY_BITS = 60


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def random_key() -> Column:
    """A number of ``KEY_BITS`` bits that id and text decide."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def allocate(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``source, ord, rows, words, target, budget`` for the sums ``source, rows, words``: a row for each source.

    Sources sorted by what they can give for their weight: those that the common level exceeds come first, and running
    sums tell where that ends, so the resharing needs no rounds. ``budget`` is the target's whole words.
    """
    fold = math.lcm(*weights)
    named = sources.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")).cast("long"))
    every = Window.partitionBy()
    lined = weighted.withColumns({"all_words": F.sum("words").over(every), "all_weight": F.sum("weight").over(every), "line": F.col("words") * F.expr(f"{fold} div weight")})
    before = Window.orderBy("line", "ord").rowsBetween(Window.unboundedPreceding, -1)
    left = lined.withColumns({
        # hundredths of words still to share out, and weights still to share them, if all sources before are full
        "words_left": share * F.col("all_words") - F.coalesce(F.sum(100 * most * F.col("words")).over(before), F.lit(0)),
        "weight_left": F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = left.withColumn("over", (F.col("weight") * F.col("words_left") > 100 * most * F.col("words") * F.col("weight_left")).cast("int"))
    full = fits.withColumn("full", F.min("over").over(Window.orderBy("line", "ord").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    # the level is that of the first source which is not full
    level = F.min(F.when(~F.col("full"), F.struct("line", "ord", "words_left", "weight_left"))).over(every)
    shared = full.withColumn("level", level)
    part = F.col("weight") * F.col("level.words_left")
    target = F.when(F.col("full"), (most * F.col("words")).cast("double")).otherwise(part.cast("double") / (100 * F.col("level.weight_left")).cast("double"))
    budget = F.when(F.col("full"), most * F.col("words")).otherwise(F.expr("(weight * level.words_left) div (100 * level.weight_left)"))
    return shared.select("source", F.col("ord").cast("int").alias("ord"), "rows", "words", target.alias("target"), budget.alias("budget"))


def _ranges(rows: DataFrame, range_rows: int) -> DataFrame:
    """``rows`` with ``range, place, part``: in this order, and by key within, they are a random order of a source.

    A range is an equal share of the keys. Where a range has far more rows than that, they are repeated rows, which share
    a key: such a key is a place of its own, in as many parts as it needs. Which of its rows come first makes no difference,
    as they are alike.
    """
    rows = rows.withColumn("range", F.floor(F.col("key") / 2.0**KEY_BITS * F.ceil(F.col("rows") / range_rows)))
    dense = rows.groupBy("ord", "range").agg(F.count("*").alias("n")).where(F.col("n") > 4 * range_rows).select("ord", "range")
    keys = rows.join(dense, ["ord", "range"], "left_semi").groupBy("ord", "range", "key").agg(F.count("*").alias("n")).where(F.col("n") > range_rows)
    hot = keys.groupBy("ord", "range").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.ceil(F.col("n") / range_rows).alias("parts"))))).alias("hot"))
    found = rows.join(hot, ["ord", "range"], "left")
    below = F.size(F.filter(F.map_keys("hot"), lambda k: k < F.col("key")))
    parts = F.try_element_at("hot", F.col("key"))
    return found.withColumns({
        "place": F.when(F.col("hot").isNull(), 0).otherwise(2 * below + F.when(parts.isNull(), 0).otherwise(1)),
        "part": F.when(parts.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("salt"), parts)).cast("int"),
    }).drop("hot")


def prefix_sums(rows: DataFrame, range_rows: int = RANGE_ROWS, group: int = GROUP) -> DataFrame:
    """``rows`` (``ord, rows, key, doc_id, size, salt`` and others) with ``before``, the words ahead of each in its source's order."""
    placed = cut(_ranges(rows, range_rows), "placed")
    where = ["ord", "range", "place", "part"]
    sums = placed.groupBy(*where).agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("range") / group))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut(sums.withColumn("in_group", F.coalesce(F.sum("words").over(ahead("ord", "group").orderBy("range", "place", "part")), F.lit(0))), "sums")
    groups = inner.groupBy("ord", "group").agg(F.sum("words").alias("words"))
    outer = groups.withColumn("in_source", F.coalesce(F.sum("words").over(ahead("ord").orderBy("group")), F.lit(0))).drop("words")
    offsets = inner.join(outer, ["ord", "group"]).select(*where, (F.col("in_group") + F.col("in_source")).alias("offset"))
    own = F.coalesce(F.sum("size").over(ahead(*where).orderBy("key", "doc_id", "size", "salt")), F.lit(0))
    out = cut(placed.withColumn("own", own).join(offsets, where).withColumn("before", F.col("offset") + F.col("own")).drop("own", "offset", "range", "place", "part"), "ordered")
    for t in (placed, inner):
        drop_table(t)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, range_rows: int = RANGE_ROWS, group: int = GROUP) -> DataFrame:
    """How many words of each row of ``docs`` (``doc_id, text, source``; others are ignored) the mix takes.

    Returns ``doc_id, size, source_size, target, taken, source, before, epochs``: ``epochs`` whole passes over the source,
    then the rows, in the source's random order, whose words lie within the rest of its budget; ``before`` is the row's
    place in that order, in words. The row on the edge is taken in part, so a source gives its budget exactly. A NULL text
    has no words, and such rows are never taken; a NULL source is one of its own, the last; rows without an id are told
    apart by their text; repeated rows count each, and follow one another; an empty table gives no row, and sources without words have a target of 0.
    The order is that of a hash, so reruns agree, however the table is cut into files.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), random_key().alias("key"), F.monotonically_increasing_id().alias("salt")), "rows")
    sources = cut(allocate(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")), weights, share, most), "sources")
    # the written table of sources tells Spark its size, which decides between a broadcast and a shuffle
    known = sources.withColumnRenamed("source", "name")
    keyed = rows.join(known, rows["source"].eqNullSafe(known["name"])).drop("name")
    ordered = prefix_sums(keyed, range_rows, group)
    epochs = F.when(F.col("words") > 0, F.expr("budget div words")).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("epochs") * F.col("words")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    out = ordered.withColumn("epochs", epochs).select("doc_id", "size", F.col("words").alias("source_size"), "target", taken.cast("long").alias("taken"), "source", "before", "epochs")
    result = cut(out, "mix")
    for t in (rows, sources, ordered):
        drop_table(t)
    return result
