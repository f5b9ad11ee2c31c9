"""Streams whose state ends, versions of tables, the card store and quarantine."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cardloom.functions import geometry as g
from cardloom.operators import cards, edits, progress, quarantine
from cardloom.plans import queries
from cardloom.sources.versions import Versions, save_bucketed
from cardloom.streaming import state as streams

START = dt.datetime(2024, 1, 1)
EVENT = "job_id long, n long, stage_ord long, kind string, ts timestamp, total long, amount long"


def run_stream(spark, tmp_path, batches, build, name, watermark="0 seconds"):
    """The stream's rows over ``batches``, taken in one after the other, and the rows of state after each micro-batch."""
    path = tmp_path / name
    path.mkdir()
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(str(path / f"{i:03d}"))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = build(stream.withWatermark("ts", watermark) if "ts" in stream.columns else stream)
    writer = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    if "ts" in stream.columns:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination(60)
    else:  # state that ends by the clock keeps a query going: it is stopped once a row for each input row is there
        q, want, begun = writer.start(), sum(b.count() for b in batches), time.time()
        while spark.table(name).count() < want and q.isActive and time.time() - begun < 60:
            time.sleep(0.5)
        q.stop()
    assert q.exception() is None
    rows = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json)["stateOperators"]]
    return spark.table(name), rows


def deck_events(rng, job, count):
    """Stages and advances in runs that end with an event or in silence."""
    ts, rows = START, []
    for n in range(1, count + 1):
        ts += dt.timedelta(seconds=rng.choice((1, 5, 20, 50, 70, 400)))
        kind = rng.choices(("stage", "advance", "ready", "failed"), (3, 8, 1, 1))[0]
        rows.append((job, n, rng.randrange(6), kind, ts, rng.choice((None, 0, 3, 9)), rng.choice((None, 1, 2))))
    return rows


def plain_runs(rows, idle):
    """Start of the run of each event of a deck, or None for late ones."""
    out, start, last, ended = [], None, None, False
    for *_, kind, ts, _, _ in rows:
        if start is None or (ts - last).total_seconds() > idle:
            start = last = ts
        elif ended:
            out.append(None)
            continue
        last, ended = ts, kind in ("ready", "failed")
        out.append(start)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_runs_end_in_the_stream_as_in_the_batch(spark, tmp_path, parts):
    rng = random.Random(parts)
    decks = [deck_events(rng, j, 60) for j in range(3)]
    rows = sorted((r for d in decks for r in d), key=lambda r: r[4])
    idle = 60_000_000
    batch = progress.run_states(spark.createDataFrame(rows, EVENT), idle).collect()
    pick = lambda found: sorted((r.job_id, r.n, str(r.run), r.kind, str(r.stage_ord), str(r.completed), str(r.stage_total), str(r.skipped)) for r in found)
    want = {(r[0], r[1]): run for d in decks for r, run in zip(d, plain_runs(d, 60), strict=True)}
    assert {(r.job_id, r.n): r.run for r in batch} == want and None in want.values() and len({v for k, v in want.items() if k[0] == 0}) > 3
    # events come in order of time, cut anywhere; a last one, long after, moves the watermark
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    pieces.append([(99, 1, 0, "advance", START + dt.timedelta(days=9), None, None)])
    frames = [spark.createDataFrame(p, EVENT) for p in pieces]
    out, states = run_stream(spark, tmp_path, frames, lambda s: streams.progress_stream(s, idle), f"runs_{parts}")
    assert pick(r for r in out.collect() if r.job_id != 99) == pick(batch)
    assert max(states) <= 4 and states[-1] <= 1  # nothing is left of the decks but the last event's


def test_commits_leave_no_state(spark, tmp_path):
    rows = [(j, n, 0, "advance", START + dt.timedelta(milliseconds=300 * n), None, 1) for j in range(40) for n in range(1, 9)]
    states = progress.state(spark.createDataFrame(rows, EVENT)).select("job_id", "n", "stage_ord", "kind", "ts", "completed", "skipped")
    end = spark.createDataFrame([(99, 1, 0, "advance", START + dt.timedelta(hours=1), 1, False)], states.schema)
    out, left = run_stream(spark, tmp_path, [states.where("n < 4"), states.where("n >= 4"), end], streams.throttled_stream, "commits")
    batch = progress.throttled(states)
    assert sorted(map(tuple, out.where("job_id <> 99").collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert max(left) <= 41 and left[-1] <= 1


def test_a_long_log_is_folded_in_bounded_memory(spark):
    n = 60_000
    card = spark.createDataFrame([(1, "basic", "q", "a", None, False, False), (2, "cloze", None, None, "{{c1::x}}", True, False)], f"card_id long, {edits.FIELDS}")
    log = spark.range(n).select(F.lit(1).cast("long").alias("card_id"), F.col("id").alias("seq"), F.lit("patch").alias("op"), F.create_map(F.lit("front"), F.when(F.col("id") % 3 == 2, F.lit(" ")).otherwise(F.concat(F.lit("v"), "id"))).alias("patch"))
    plan = edits.apply_edits(card, log)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    got = {r.card_id: r for r in plan.collect()}
    assert (got[1].front, got[1].applied, got[1].refused) == (f"v{n - 2}", 2 * n // 3, n // 3) and (got[2].applied, got[2].needs_page_image, got[2].last_reason) == (0, True, None)


def test_deleted_cards_are_forgotten_after_a_time(spark, tmp_path):
    log = [(1, 0, "create", {"note_type": "basic", "front": "q", "back": "a"}), (1, 1, "delete", {})]
    late = [(1, 2, "patch", {"front": "late"}), (2, 1, "patch", {"front": "nobody"})]
    frames = [spark.createDataFrame(x, edits.LOG) for x in (log, late)]
    out, _ = run_stream(spark, tmp_path, frames, streams.edits_stream, "gone_known")
    assert {(r.card_id, r.seq): (r.front, r.reason) for r in out.collect()} == {(1, 0): ("q", None), (1, 1): ("q", None), (1, 2): ("q", "Card not found."), (2, 1): (None, "Card not found.")}
    out, _ = run_stream(spark, tmp_path, frames, lambda s: streams.edits_stream(s, 1), "gone_forgotten")
    assert {(r.card_id, r.seq): (r.front, r.reason) for r in out.collect()}[1, 2] == (None, "Card not found.")


@pytest.mark.parametrize("parts", [1, 4])
def test_first_drafts_of_a_stream_are_those_of_the_batch(spark, tmp_path, parts):
    rng = random.Random(parts)
    schema = "job_id string, doc_id long, line_no long, note_type string, front string, cloze_text string, ts timestamp"
    rows = [(f"d{i % 2}", i, i % 3, "basic", rng.choice(["Same?", "same", "Other", " ", None, f"own {i}"]), None, START + dt.timedelta(seconds=i)) for i in range(80)]
    want = sorted((r.job_id, r.doc_id, r.line_no) for r in cards.dedupe(spark.createDataFrame(rows, schema), ["doc_id", "line_no"]).collect())
    mixed = rng.sample(rows, len(rows))
    frames = [spark.createDataFrame(mixed[k::parts], schema) for k in range(parts)]
    frames.append(spark.createDataFrame([("end", 0, 0, "basic", "end", None, START + dt.timedelta(days=1))], schema))
    out, left = run_stream(spark, tmp_path, frames, lambda s: streams.dedupe_stream(s, ["doc_id", "line_no"], "ts", 3_600_000_000), f"first_{parts}", "1 hour")
    assert sorted((r.job_id, r.doc_id, r.line_no) for r in out.where("job_id <> 'end'").collect()) == want and left[-1] <= 1


def numbers(spark, *values):
    return spark.createDataFrame([(v, v % 2) for v in values], "x long, y long")


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no whole version"):
        store.read()
    assert store.publish(numbers(spark, 1, 2), "a") == 1 and store.publish(numbers(spark, 3), "b", ["y"]) == 2
    assert sorted(map(tuple, store.read().collect())) == [(1, 1), (2, 0), (3, 1)]
    assert store.publish(numbers(spark, 4), "a") == 3 and sorted(r.x for r in store.read().collect()) == [3, 4]
    assert sorted(r.x for r in store.read(2).collect()) == [1, 2, 3]  # an earlier version is still whole
    store.publish(numbers(spark).limit(0), "b")
    assert [r.x for r in store.read().collect()] == [4]
    store.remove("a")
    assert store.read().collect() == [] and store.read().columns == ["x", "y"]
    with pytest.raises(ValueError, match="columns"):
        store.publish(spark.range(1), "a")
    with pytest.raises(ValueError, match="name"):
        store.publish(numbers(spark, 1), "a/b")


def test_a_killed_writer_is_not_seen(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    store.publish(numbers(spark, 1), "a")

    def dies(batches):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        store.publish(numbers(spark, 2).mapInArrow(dies, "x long, y long"), "a")
    numbers(spark, 3).write.parquet(f"{store.path}/data/a-lost")  # files without a manifest
    (tmp_path / "t/manifests/000000000002.json").write_text('{"parts": {"a"')  # a manifest cut off
    assert store.last()[0] == 1 and [r.x for r in store.read().collect()] == [1]
    assert store.publish(numbers(spark, 4), "b") == 3 and sorted(r.x for r in store.read().collect()) == [1, 4]
    store.clean()
    assert store.numbers() == [3] and sorted(r.x for r in store.read().collect()) == [1, 4]
    assert sum(1 for f in (tmp_path / "t/data").iterdir()) == 2


def test_two_writers_keep_each_others_parts(spark, tmp_path, monkeypatch):
    one, two = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "t"))
    one.publish(numbers(spark, 1), "a")
    seen, calls = one.last(), []
    real = one.last
    monkeypatch.setattr(one, "last", lambda: calls.append(1) or (seen if len(calls) == 1 else real()))
    monkeypatch.setattr(one, "numbers", lambda known=one.numbers: [1] if len(calls) == 1 else known())
    two.publish(numbers(spark, 2), "b")
    assert one.publish(numbers(spark, 3), "c") == 3 and sorted(r.x for r in two.read().collect()) == [1, 2, 3] and len(calls) == 2


def test_cards_are_counted_where_they_lie(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i, i % 3 == 0) for i in range(70)], "job_id long, id long, is_deleted boolean")
    stored = save_bucketed(rows, "cards_here", "job_id", 4, str(tmp_path / "cards"))
    jobs = spark.createDataFrame([(j,) for j in range(8)], "job_id long").repartition(4, "job_id")
    counted = cards.card_counts(jobs, stored)
    assert {r.job_id: r.card_count for r in counted.collect()} == {r.job_id: r.card_count for r in cards.card_counts(jobs, rows).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = cards.card_counts(jobs, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("HashAggregate") :]
    assert plan.count("Exchange") == 1 and "Exchange" not in side and "Bucketed: true" in side
    spark.sql("DROP TABLE cards_here")


def test_the_summary_over_the_store_moves_no_card(spark):
    folder = "/root/testdata/sf0.001"
    pytest.importorskip("pathlib").Path(folder).is_dir() or pytest.skip("no tables here")
    plan = queries._stored_summary(spark, folder)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("Bucketed: true")
    side = plan[plan[:scan].rindex("Project" if "HashAggregate" not in plan[:scan] else "HashAggregate") : scan]
    assert "Exchange" not in side


def test_quarantine_reads_once_and_counts(spark):
    reads = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    values = [(0.1, 0.1, 0.2, 0.2), (-0.1, 0.0, 0.0, 0.1), (0.0, 0.0, 0.0, 0.5), (0.5, 0.5, 1.5, 0.5), (0.2, 0.2, 1.0, 1.0), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, box {g.BOX}")
    found = quarantine.split(rows.mapInArrow(tick, rows.schema), g.rules(F.col("box")))
    assert {r.i: r.reason for r in found.rejected.collect()} == {1: "corner", 2: "extent", 3: "size", 5: "corner"}
    assert sorted(r.i for r in found.good.collect()) == [0, 4] and found.good.columns == ["i", "box"]
    assert found.counts == {"seen": 6, "corner": 2, "extent": 1, "size": 1} and reads.value == len(values)
    assert [r[0] for r in rows.select(g.is_valid(F.col("box"))).collect()] == [True, False, False, False, True, False]
    empty = quarantine.split(rows.limit(0), g.rules(F.col("box")))
    assert empty.counts == {"seen": 0, "corner": 0, "extent": 0, "size": 0} and empty.rejected.count() == 0
    with pytest.raises(ValueError):
        quarantine.split(rows, {"seen": F.lit(True)})
