"""Streams of progress events, card edits and drafts whose state ends. Each has a batch twin with the same results.

Progress, commits and drafts keep time by the events: a timer ends what is known of a key when the watermark has passed the
time after which the batch twin forgets it too, so results do not depend on when a timer fires. Edits have no time of
their own: what is left of a deleted card goes after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.cards import dedup_key
from ..operators.edits import Card, after_edit
from ..operators.progress import COMMIT_MICROS, IDLE_MICROS, commits, run_of

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers and times to live needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _row(schema: str) -> Row:
    """Maker of rows with the names of a schema."""
    return Row(*[f.split(" ")[0] for f in schema.split(", ")])


class _Timed(StatefulProcessor):
    """State of a key with one timer, set anew with each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.schema)

    def ends_at(self, micros: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(micros // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


PROGRESS = "job_id long, run timestamp, n long, stage_ord long, kind string, ts timestamp, completed long, stage_total long, skipped boolean"


class _Progress(_Timed):
    schema = "start long, last long, ended boolean, stage long, done long, total long"

    def __init__(self, idle: int):
        self.idle = idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, known, stage, done, total = _row(PROGRESS), None, None, 0, None
        if self.known.exists():
            start, last, ended, stage, done, total = self.known.get()
            known = (start, last, ended)
        # an event of the next run clears the counters of the one before
        for r in sorted(rows, key=lambda r: r.n):
            (run,), new = run_of([r.kind], [r.micros], known, self.idle)
            if run is None:
                yield out(key[0], None, r.n, None, r.kind, r.ts, None, None, None)
                continue
            if known is None or new[0] != known[0]:
                stage, done, total = None, 0, None
            known, skipped = new, r.kind == "stage" and r.total is not None and r.total <= 0
            if r.kind == "advance":
                done += 1 if r.amount is None else r.amount
            elif r.kind == "stage" and not skipped:
                stage, done, total = r.stage_ord, 0, r.total
            yield out(key[0], r.ts - timedelta(microseconds=r.micros - new[0]), r.n, stage, r.kind, r.ts, done, total, skipped)
        self.known.update((*known, stage, done, total))
        self.ends_at(known[1] + self.idle)


def progress_stream(events: DataFrame, idle: int = IDLE_MICROS) -> DataFrame:
    """Counters after each event of a deck's run, as ``progress.run_states``. ``events`` has a watermark on ``ts``.

    Of a deck, the start of its run, its last event, stage, counter and total are known, until the watermark is ``idle`` past
    its last event; so a deck that is ready, failed or silent leaves nothing. What comes within that time after the end is
    late: it is returned without a run.
    """
    keep_state_on_disk(events.sparkSession)
    rows = events.select("job_id", F.col("n").cast("long"), F.col("stage_ord").cast("long"), "kind", "ts", F.col("total").cast("long"), F.col("amount").cast("long"), F.unix_micros("ts").alias("micros"))
    return rows.groupBy("job_id").transformWithState(_Progress(idle), PROGRESS, "Append", "EventTime")


COMMITTED = "job_id long, n long, stage_ord long, completed long, kind string"


class _Commits(_Timed):
    schema = "last long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, ordered = _row(COMMITTED), sorted(rows, key=lambda r: r.n)
        due, last = commits([r.kind == "stage" for r in ordered], [r.micros for r in ordered], self.known.get()[0] if self.known.exists() else None)
        for r, now in zip(ordered, due, strict=True):
            if now:
                yield out(key[0], r.n, r.stage_ord, r.completed, r.kind)
        self.known.update((last,))
        self.ends_at(last + COMMIT_MICROS)  # from then on anything is due, as for a deck never seen


def throttled_stream(states: DataFrame) -> DataFrame:
    """The states that are committed, as ``progress.throttled``. ``states`` has a watermark on ``ts``; of a deck the time of its last
    commit is known, for as long as that can hold back another."""
    keep_state_on_disk(states.sparkSession)
    rows = states.where("not skipped").select("job_id", "n", "stage_ord", "completed", "kind", F.unix_micros("ts").alias("micros"), "ts")
    return rows.groupBy("job_id").transformWithState(_Commits(), COMMITTED, "Append", "EventTime")


EDIT_OUT = "card_id long, seq long, note_type string, front string, back string, cloze_text string, needs_page_image boolean, is_deleted boolean, reason string"
#: How long what is left of a deleted card is known, in milliseconds.
GONE_MILLIS = 86_400_000


class _Edits(StatefulProcessor):
    schema = "note_type string, front string, back string, cloze_text string, needs_page_image boolean, is_deleted boolean"

    def __init__(self, gone_millis: int):
        self.gone_millis = gone_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", self.schema)
        self.gone = handle.getValueState("gone", self.schema, self.gone_millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = _row(EDIT_OUT)
        card = Card(*self.card.get()) if self.card.exists() else Card(*self.gone.get()) if self.gone.exists() else None
        for r in sorted(rows, key=lambda r: (r.op != "create", r.seq if r.seq is not None else 0)):
            card, reason = after_edit(card, r.op, dict(r.patch or {}))
            yield out(key[0], r.seq, *(card or (None, None, None, None, None, True)), reason)
        if card is None:
            return
        kept, other = (self.gone, self.card) if card.is_deleted else (self.card, self.gone)
        kept.update(tuple(card))
        if other.exists():
            other.clear()

    def close(self) -> None:
        pass


def edits_stream(edits: DataFrame, gone_millis: int = GONE_MILLIS) -> DataFrame:
    """The card after each edit of a log (``edits.LOG``), with the reason if it was refused, as ``edits.apply_edits`` has it at the end.

    One card is known of each id. A deleted one is known for ``gone_millis`` more, so edits that come after it are returned with
    its fields; later ones are refused like those of an unknown card.
    """
    keep_state_on_disk(edits.sparkSession)
    return edits.groupBy("card_id").transformWithState(_Edits(gone_millis), EDIT_OUT, "Append", "ProcessingTime")


class _First(_Timed):
    def __init__(self, schema: str, order: list[str], horizon: int):
        self.schema, self.order, self.horizon = schema, order, horizon

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = lambda values: tuple((v is None, v) for v in values[-len(self.order) :])
        fresh = not self.known.exists()
        best, first = (None if fresh else self.known.get()), None
        for r in rows:
            values = tuple(r[f] for f in self.names)
            first = r.micros if first is None else min(first, r.micros)
            if best is None or place(values) < place(best):
                best = values
        self.known.update(best)
        if fresh:
            self.ends_at(first + self.horizon)
        return iter(())

    @property
    def names(self) -> list[str]:
        return [f.split(" ")[0].strip("`") for f in self.schema.split(", ")]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists():
            yield Row(*self.names)(*self.known.get())
            self.known.clear()


def first_wins_stream(drafts: DataFrame, key: list[str], order: list[str], ts: str, horizon: int) -> DataFrame:
    """The first of ``drafts``, by ``order``, of each ``key``, as a rank-one window over all of them. ``drafts`` has a watermark on ``ts``.

    The best draft of a key so far is known until the watermark is ``horizon`` microseconds past the first of them, and is then
    returned; so copies that lie within that time count once, however they are split into batches. Later ones begin anew.
    Columns of ``order`` are numbers or texts; all columns are of plain types.
    """
    keep_state_on_disk(drafts.sparkSession)
    fields = [f for f in drafts.schema if f.name not in order and f.name != ts] + [drafts.schema[c] for c in order]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows = drafts.withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(*key).transformWithState(_First(schema, order, horizon), StructType(fields), "Append", "EventTime")


def dedupe_stream(drafts: DataFrame, order: list[str], ts: str, horizon: int, deck: str = "job_id") -> DataFrame:
    """``cards.dedupe`` on a stream: the first draft of each normalised question of a deck; drafts without one all stay."""
    keyed = drafts.withColumn("dedup_key", dedup_key())
    alone = F.when(F.col("dedup_key") == "", F.concat_ws("/", *order)).otherwise("")
    found = first_wins_stream(keyed.withColumn("alone", alone), [deck, "dedup_key", "alone"], order, ts, horizon)
    return found.drop("dedup_key", "alone")
