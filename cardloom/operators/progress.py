"""Progress of decks: stages, counters, percent, remaining time, throttling and status."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values, in order: stage, share of the work, label.
STAGES = (
    ("rendering", 10.0, "Rendering pages"),
    ("extracting", 5.0, "Extracting text"),
    ("generating_cards", 45.0, "Generating cards"),
    ("detecting_masks", 30.0, "Finding diagram labels"),
    ("composing", 5.0, "Composing card images"),
    ("finalizing", 5.0, "Finishing up"),
)
ETA_FROM = 0.15
ACTIVE = ("pending", "processing")


def stages(spark: SparkSession) -> DataFrame:
    """``ord, stage, weight, label, start``: six rows; ``start`` is what is done when a stage begins."""
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(STAGES)], "ord long, stage string, weight double, label string")
    return with_boundaries(rows)


def with_boundaries(rows: DataFrame) -> DataFrame:
    """Sum of the weights of earlier stages, as ``start``."""
    earlier = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))


#: Events that end a deck's run.
ENDS = ("ready", "failed")
#: Time without an event after which what is known of a deck is forgotten.
IDLE_MICROS = 3_600_000_000


def run_of(kinds: list[str], micros: list[int], known: tuple[int, int, bool] | None, idle: int = IDLE_MICROS) -> tuple[list[int | None], tuple[int, int, bool] | None]:
    """The run that each of a deck's events, in order, belongs to, and what is then known: start of the run, its last event,
    and whether that ended it.

    A run is called by the time of its first event. It goes on until nothing has come for more than ``idle``; an event within
    that time after the one that ended it is late and belongs to none.
    """
    out: list[int | None] = []
    for kind, now in zip(kinds, micros, strict=True):
        if known is None or now - known[1] > idle:
            known = (now, now, kind in ENDS)
        elif known[2]:
            out.append(None)
            continue
        else:
            known = (known[0], now, kind in ENDS)
        out.append(known[0])
    return out, known


def runs(events: DataFrame, idle: int = IDLE_MICROS) -> DataFrame:
    """``events`` (``job_id, n, kind, ts`` and others) with ``run``, the time its run began (:func:`run_of`); NULL for late ones.

    Tasks stream over a deck's sorted events and hold three values.
    """
    rows = events.withColumn("run", F.unix_micros(F.col("ts").cast("timestamp")))
    place = rows.columns.index("run")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, known = None, None
        for batch in batches:
            jobs, kinds, micros = (batch.column(c).to_pylist() for c in ("job_id", "kind", "run"))
            out: list[int | None] = []
            for key, group in groupby(range(len(jobs)), jobs.__getitem__):
                own = list(group)
                found, known = run_of([kinds[i] for i in own], [micros[i] for i in own], known if key == job else None, idle)
                job = key
                out += found
            yield batch.set_column(place, "run", pa.array(out, pa.int64()))

    marked = rows.repartition("job_id").sortWithinPartitions("job_id", "n").mapInArrow(mark, rows.schema)
    return marked.withColumn("run", F.timestamp_micros("run"))


def run_states(events: DataFrame, idle: int = IDLE_MICROS) -> DataFrame:
    """Counters after each event (:func:`state`) within its run; ``run`` and the counters of late events are NULL."""
    marked = runs(events, idle)
    late = marked.where("run is null").withColumns({"stage_ord": F.lit(None).cast("long"), "completed": F.lit(None).cast("long"), "stage_total": F.lit(None).cast("long"), "skipped": F.lit(None).cast("boolean")})
    return state(marked.where("run is not null"), ["job_id", "run"]).unionByName(late)


def state(events: DataFrame, by: Sequence[str] = ("job_id",)) -> DataFrame:
    """Counters after each event (``job_id, n, stage_ord, kind, total, amount``): a stage event enters its stage at 0 of
    ``total`` (NULL: unknown), unless the total is 0 or less, which skips the stage; an advance adds ``amount`` (one if NULL).

    ``stage_ord`` becomes that of the stage a deck is in (NULL before the first); adds ``completed, stage_total`` and
    ``skipped``. Running sums of one window for each deck, or each group of ``by``.
    """
    run = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    enters = (F.col("kind") == "stage") & F.coalesce(F.col("total") > 0, F.lit(True))
    amount = F.when(F.col("kind") == "advance", F.coalesce("amount", F.lit(1))).otherwise(0)
    # what was added up before a stage was entered does not count for it
    marked = events.withColumns({"enters": enters, "added": F.sum(amount).over(run)})
    last = F.last(F.when(F.col("enters"), F.struct("stage_ord", "total", "added")), ignorenulls=True).over(run)
    rows = marked.withColumn("last", last)
    return rows.withColumns({
        "stage_ord": F.col("last.stage_ord"), "completed": (F.col("added") - F.coalesce("last.added", F.lit(0))).cast("long"), "stage_total": F.col("last.total").cast("long"),
        "skipped": (F.col("kind") == "stage") & ~F.col("enters"),
    }).drop("last", "enters", "added")


def percent(status: Column, weight: Column, start: Column, completed: Column, total: Column) -> Column:
    """Percent done: NULL while pending, after failing, or without a stage or total; 100 when ready."""
    share = F.least(F.coalesce(completed, F.lit(0)), total) / total
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), start + weight * share))
    unknown = status.isin("pending", "failed") | weight.isNull() | total.isNull() | (total <= 0)
    return F.when(status == "ready", F.lit(100.0)).when(~F.coalesce(unknown, F.lit(True)), value)


def eta_seconds(done: Column, elapsed: Column) -> Column:
    """Seconds left, once enough is done and time has passed; half rounds to even."""
    f = done / 100.0
    return F.when((f >= ETA_FROM) & (elapsed > 0), F.bround(elapsed / f * (1 - f)).cast("long"))


def progress(jobs: DataFrame, spark: SparkSession) -> DataFrame:
    """Jobs (``status, stage, stage_completed, stage_total, processing_started_at, now``) with ``percent, eta_seconds, stage_label``."""
    both = jobs.join(F.broadcast(stages(spark)), "stage", "left")
    both = both.withColumn("percent", percent(F.col("status"), F.col("weight"), F.col("start"), F.col("stage_completed"), F.col("stage_total")))
    elapsed = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("processing_started_at").cast("timestamp"))) / 1e6
    running = F.col("status") == "processing"
    return both.withColumn("eta_seconds", F.when(running, eta_seconds(F.col("percent"), elapsed))).withColumnRenamed("label", "stage_label").drop("weight", "start", "ord")


def eta_label(seconds: Column) -> Column:
    """A remaining time in words; NULL for nothing or no time."""
    whole = lambda x: F.floor(x + 0.5).cast("long")
    minutes, hours = whole(seconds / 60), whole(seconds / 3600)
    label = F.when(seconds < 60, "less than a minute remaining").when(minutes < 60, F.concat(F.lit("about "), minutes, F.lit(" min remaining")))
    return F.when(seconds > 0, label.otherwise(F.concat(F.lit("about "), hours, F.lit(" hr remaining"))))


def falls(percents: DataFrame) -> DataFrame:
    """How often a deck's percent falls (``job_id, n, percent``): ``job_id, events, falls``; every count must be 0."""
    before = Window.partitionBy("job_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return percents.withColumn("fell", F.coalesce(F.col("percent") < F.max("percent").over(before), F.lit(False)).cast("int")).groupBy("job_id").agg(F.count("*").alias("events"), F.sum("fell").alias("falls"))


#: Least time between two commits of a deck's progress within a stage.
COMMIT_MICROS = 1_000_000


def commits(stage: list[bool], micros: list[int], last: int | None) -> tuple[list[bool], int | None]:
    """Which of a deck's events, in order, are committed, and when the last one was: a stage always, an advance once
    enough time has passed since the last commit, whichever it was."""
    out = []
    for entered, now in zip(stage, micros, strict=True):
        due = entered or last is None or now - last >= COMMIT_MICROS
        out.append(due)
        last = now if due else last
    return out, last


def throttled(states: DataFrame) -> DataFrame:
    """The states that are committed (:func:`commits`); skipped stages are not.

    ``states`` has ``job_id, ts, n, kind, stage_ord, completed, skipped``. Each commit depends on the one before, so a deck's
    events are read in order; tasks stream over sorted rows and hold no more than the time of the last commit.
    """
    names = ["job_id", "n", "stage_ord", "completed", "kind"]
    rows = states.where("not skipped").select(*names, F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    schema = rows.drop("micros").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, last = None, None
        for batch in batches:
            jobs, kinds, micros = (batch.column(c).to_pylist() for c in ("job_id", "kind", "micros"))
            keep: list[bool] = []
            for key, group in groupby(range(len(jobs)), jobs.__getitem__):
                rows_ = list(group)
                last = last if key == job else None
                due, last = commits([kinds[i] == "stage" for i in rows_], [micros[i] for i in rows_], last)
                job = key
                keep += due
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return rows.repartition("job_id").sortWithinPartitions("job_id", "n").mapInArrow(run, schema)


def job_status(jobs: DataFrame) -> DataFrame:
    """Status of each deck from its gates: ``reason, page_error, stage_error, started, finished``; the first error is the message."""
    message = F.coalesce("reason", "page_error", "stage_error")
    status = F.when(message.isNotNull(), "failed").when(F.col("finished"), "ready").when(F.col("started"), "processing").otherwise("pending")
    return jobs.select("job_id", status.alias("status"), message.alias("error_message"))


def active(jobs: DataFrame) -> DataFrame:
    """Decks that are still worth asking after."""
    return jobs.where(F.col("status").isin(*ACTIVE))
