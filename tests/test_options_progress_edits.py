import datetime as dt
import random
import time
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cardloom.functions import geometry as g
from cardloom.operators import crop, edits, export, options, progress, providers
from cardloom.sources.versions import Versions
from cardloom.streaming import state as streams


def test_admission_reports_the_first_failure(spark):
    rows = [("Deck", "application/pdf", "a.pdf", 10, "%PDF-"), ("  ", "application/pdf", "a.pdf", 10, "%PDF-"), ("x" * 101, None, None, 10, "x"), ("D", "text/plain", "a.txt", 10, "%PDF-"), ("D", None, "A.PDF", 99, "%PDF-"), ("D", None, "A.PDF", 10, "hello"), ("D", "text/plain", "a.PDF", 10, "%PDF-")]
    found = options.admission(spark.createDataFrame(rows, "deck_name string, content_type string, filename string, size long, head string"), 50)
    assert [(r.reason or "ok").split()[0] for r in found.collect()] == ["ok", "deck_name", "deck_name", "Uploaded", "PDF", "File", "ok"]


@pytest.mark.parametrize(
    "payload, expected",
    [
        (None, ("basic_cloze", True, "individual", "individual")), ("  ", ("basic_cloze", True, "individual", "individual")),
        ('{"mask_grouping":"grouped","text_mask_grouping":"individual"}', ("basic_cloze", True, "grouped", "individual")),
        ('{"diagram_occlusion_enabled":false}', ("basic_cloze", False, "individual", "individual")),
        ("{not json", None), ("[]", None), ('{"color":1}', None), ('{"text_card_mode":"x"}', None), ('{"mask_grouping":"both"}', None), ('{"diagram_occlusion_enabled":"maybe"}', None), ('{"text_card_mode":1}', None),
    ],
)
def test_options(spark, payload, expected):
    r = options.resolve_options(spark.createDataFrame([(payload,)], "options string")).first()
    found = (r.text_card_mode, r.diagram_occlusion_enabled, r.diagram_mask_grouping, r.text_mask_grouping)
    assert (r.reason is None and found == expected) if expected else (r.reason and found == (None,) * 4)


def test_legacy_occlusions(spark):
    b = '{"left":0.1,"top":0.2,"width":0.3,"height":0.4}'
    rows = [(f'{{"direction":"identify","label":"Ridge","crop_box":{b},"label_box":{b},"mask_boxes":[{b}]}}',), (f'{{"kind":"text","labels":["a"],"label":"b","crop_box":{b},"target_boxes":[{b}],"mask_boxes":[]}}',)]
    out = [r.o for r in spark.createDataFrame(rows, "x string").select(options.upgrade_occlusion(F.col("x")).alias("o")).collect()]
    assert (out[0].kind, out[0].labels, len(out[0].target_boxes)) == ("diagram", ["Ridge"], 1) and (out[1].kind, out[1].labels) == ("text", ["a"])


def test_page_limit_and_schema_merge(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 4)] + [(2, 1)], "job_id long, page_number long")
    assert {r.job_id: r.error_message for r in options.page_limit(pages, 2).collect()} == {1: "PDF has 3 pages, which exceeds the 2-page limit.", 2: None}
    merged = options.merge_schema(spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([(2, "x")], "a long, b string"))
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2, "x")]


def test_percent_table(spark):
    rows = [("processing", "rendering", 0, 4, 0.0), ("processing", "generating_cards", 2, 4, 37.5), ("processing", "finalizing", 99, 4, 100.0), ("processing", "rendering", None, 4, 0.0), ("processing", "rendering", 1, 0, None), ("processing", "rendering", 1, None, None), ("pending", "rendering", 1, 2, None), ("failed", "rendering", 1, 2, None), ("ready", None, None, None, 100.0), ("processing", None, 1, 2, None)]
    start = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(i, *r[:4], start, start + dt.timedelta(seconds=60)) for i, r in enumerate(rows)], "i int, status string, stage string, stage_completed long, stage_total long, processing_started_at timestamp, now timestamp")
    out = progress.progress(jobs, spark).orderBy("i").collect()
    assert [r.percent for r in out] == [r[4] for r in rows]
    assert out[1].eta_seconds == 100 and out[0].eta_seconds is None and out[1].stage_label == "Generating cards"
    assert [r.start for r in progress.stages(spark).orderBy("ord").collect()] == [0.0, 10.0, 15.0, 60.0, 90.0, 95.0]


def test_eta_labels(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (59.0,), (60.0,), (90.0,), (3569.0,), (3570.0,), (9000.0,)], "s double")
    assert [r[0] for r in rows.select(progress.eta_label(F.col("s"))).collect()] == [None, None, "less than a minute remaining", "about 1 min remaining", "about 2 min remaining", "about 59 min remaining", "about 1 hr remaining", "about 3 hr remaining"]


def events(spark):
    """Per deck: stages with totals of 4, none (skipped), unknown and 2, and advances of one to three; gaps of 0.3 s."""
    start = dt.datetime(2024, 1, 1)
    steps = [("advance", None, 2), ("stage", 4, None), ("advance", None, 1), ("advance", None, None), ("advance", None, 3), ("stage", 0, None), ("advance", None, 1), ("stage", None, None), ("advance", None, 2), ("advance", None, 2), ("advance", None, 1), ("advance", None, 1), ("stage", 2, None), ("advance", None, 2)]
    rows, stage = [], -1
    for j in (1, 2):
        stage = -1
        for n, (kind, total, amount) in enumerate(steps, 1):
            stage += kind == "stage"
            rows.append((j, n, max(stage, 0), kind, start + dt.timedelta(milliseconds=300 * n), total, amount))
    return spark.createDataFrame(rows, "job_id long, n long, stage_ord long, kind string, ts timestamp, total long, amount long")


def run_stream(spark, tmp_path, df, build, name):
    path = str(tmp_path / name)
    df.repartition(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    stream = build(stream.withWatermark("ts", "1 second") if "ts" in df.columns else stream)
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    if "ts" in df.columns:
        q.processAllAvailable()
    else:  # state that ends by the clock keeps a query going
        begun = time.time()
        while spark.table(name).count() < df.count() and q.isActive and time.time() - begun < 60:
            time.sleep(0.5)
    q.stop()
    return spark.table(name)


def test_counters_follow_totals_and_amounts_and_skip_empty_stages(spark):
    got = [(r.stage_ord, r.completed, r.stage_total, r.skipped) for r in progress.state(events(spark)).where("job_id = 1").orderBy("n").collect()]
    no = False
    assert got == [(None, 2, None, no), (0, 0, 4, no), (0, 1, 4, no), (0, 2, 4, no), (0, 5, 4, no), (0, 5, 4, True), (0, 6, 4, no), (2, 0, None, no), (2, 2, None, no), (2, 4, None, no), (2, 5, None, no), (2, 6, None, no), (3, 0, 2, no), (3, 2, 2, no)]


def test_progress_stream_equals_batch(spark, tmp_path):
    batch = progress.run_states(events(spark))
    assert {r.run for r in batch.collect()} == {dt.datetime(2024, 1, 1, microsecond=300_000)}
    stream = run_stream(spark, tmp_path, events(spark), streams.progress_stream, "progress_stream")
    pick = lambda df: sorted((r.job_id, r.n, r.stage_ord or -1, r.completed, r.stage_total or -1, r.skipped) for r in df.collect())
    assert pick(stream) == pick(batch)
    assert progress.falls(batch.select("job_id", "n", F.col("n").cast("double").alias("percent"))).where("falls > 0").count() == 0


def test_commits_are_a_second_apart_but_for_stages():
    seconds = [0, 950, 1050, 1900, 2050, 2100]
    due, last = progress.commits([True] + [False] * 5, [1000 * s for s in seconds], None)
    assert [s for s, d in zip(seconds, due, strict=True) if d] == [0, 1050, 2050] and last == 2_050_000
    assert progress.commits([False, True, False], [0, 10, 1_000_009], None)[0] == [True, True, False]
    assert progress.commits([False], [5], 4)[0] == [False]


def test_throttled_stream_equals_batch(spark, tmp_path):
    states = progress.state(events(spark)).select("job_id", "n", "stage_ord", "kind", "ts", "completed", "skipped")
    pick = lambda df: sorted((r.job_id, r.n, r.stage_ord or -1, r.completed, r.kind) for r in df.collect())
    batch = pick(progress.throttled(states))
    assert [n for j, n, *_ in batch if j == 1] == [1, 2, 7, 8, 12, 13]  # event 6, a skipped stage, and what comes too soon are not committed
    assert pick(run_stream(spark, tmp_path, states, streams.throttled_stream, "throttled_stream")) == batch


LOG = "card_id long, seq long, op string, patch map<string,string>"
EDITS = [
    (1, 1, "patch", {"front": "new", "needs_page_image": "true"}), (1, 2, "patch", {"note_type": "cloze", "cloze_text": "bad"}), (1, 3, "patch", {"note_type": "cloze", "cloze_text": "{{c1::x}}"}), (1, 4, "patch", {"note_type": "diagram"}),
    (2, 1, "patch", {"back": "named", "needs_page_image": "true"}), (4, 1, "patch", {"needs_page_image": "yes"}), (4, 2, "patch", {"needs_page_image": "perhaps"}), (2, 2, "patch", {"note_type": "basic"}), (2, 3, "patch", {"occlusion": "x"}), (2, 4, "patch", {"front": " "}), (3, 1, "delete", {}), (3, 2, "patch", {"front": "late"}), (9, 1, "patch", {"front": "nobody"}),
]


def test_edit_fold_and_its_stream_agree(spark, tmp_path):
    cards = spark.createDataFrame([(1, "basic", "q", "a", None, False, False), (2, "diagram", "q", "a", None, False, False), (3, "basic", "q", "a", None, False, False), (4, "cloze", None, None, "{{c1::k}}", False, False)], "card_id long, note_type string, front string, back string, cloze_text string, needs_page_image boolean, is_deleted boolean")
    out = {r.card_id: r for r in edits.apply_edits(cards, spark.createDataFrame(EDITS, LOG)).collect()}
    assert (out[1].note_type, out[1].front, out[1].back, out[1].cloze_text, out[1].applied, out[1].refused) == ("cloze", None, None, "{{c1::x}}", 2, 2)
    assert (out[2].note_type, out[2].front, out[2].back, out[2].applied, out[2].refused) == ("diagram", "q", "named", 1, 3)
    assert (out[3].is_deleted, out[3].front, out[3].last_reason) == (True, "q", "Card not found.") and out[4].applied == 2 and len(out) == 4
    assert {k: r.needs_page_image for k, r in out.items()} == {1: True, 2: False, 3: False, 4: None}
    created = [(r.card_id, 0, "create", {k: v for k, v in r.asDict().items() if k in ("note_type", "front", "back", "cloze_text") and v is not None}) for r in cards.collect()]
    stream = run_stream(spark, tmp_path, spark.createDataFrame(created + EDITS, LOG), streams.edits_stream, "edits_stream")
    last = {}
    for r in sorted(stream.collect(), key=lambda r: r.seq):
        last[r.card_id] = r
    for k, r in out.items():
        assert (last[k].note_type, last[k].front, last[k].back, last[k].cloze_text, last[k].needs_page_image, last[k].is_deleted) == (r.note_type, r.front, r.back, r.cloze_text, r.needs_page_image, r.is_deleted)
    refused = sorted((r.card_id, r.seq) for r in stream.collect() if r.reason)
    assert refused == [(1, 2), (1, 4), (2, 2), (2, 3), (2, 4), (3, 2), (9, 1)]


def test_status_of_a_deck(spark):
    rows = [(1, None, None, None, True, True), (2, "bad", "long", None, True, True), (3, None, None, "boom", True, False), (4, None, None, None, False, False), (5, None, None, None, True, False)]
    out = progress.job_status(spark.createDataFrame(rows, "job_id long, reason string, page_error string, stage_error string, started boolean, finished boolean"))
    assert [(r.status, r.error_message) for r in out.orderBy("job_id").collect()] == [("ready", None), ("failed", "bad"), ("failed", "boom"), ("pending", None), ("processing", None)]
    assert progress.active(out).count() == 2


def png(pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_crop_of_page_images(spark, tmp_path):
    def image(job, page, pixels):
        d = tmp_path / f"jobs/{job}/pages"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"page_{page}.png").write_bytes(png(pixels))

    def square(size, lo, hi, ink=0, paper=255):
        return [[ink if lo <= x < hi and lo <= y < hi else paper for x in range(size)] for y in range(size)]

    image(1, 1, square(400, 120, 280))
    image(1, 2, square(300, 0, 300, ink=20))
    image(1, 3, square(200, 2, 198))
    profiles = crop.ink_profile(crop.read_page_images(spark, str(tmp_path / "jobs")))
    box = g.box(0.4, 0.4, 0.2, 0.2)
    out = {r.page_number: r.crop_box for r in crop.derive_crop(profiles.withColumn("boxes", F.array(box))).collect()}
    assert (out[1].left, out[1].top) == (0.3, 0.3) and round(out[1].width, 9) == 0.4
    assert out[2].width == 1.0 and out[3].width == 1.0
    none = crop.derive_crop(profiles.withColumn("boxes", F.array().cast(f"array<{g.BOX}>"))).where("page_number = 1").first()
    assert none.crop_box.width == 1.0


def test_histogram_median_takes_half_rounded_down(spark):
    hist = [0] * 256
    hist[10], hist[20] = 1, 2
    assert spark.createDataFrame([(hist,)], "h array<long>").select(crop.median_luma(F.col("h"))).first()[0] == 10


def test_export_notes(spark, tmp_path):
    cards = spark.createDataFrame([(1, 1, "basic", "a<b", "x", None, 1, True, False), (1, 2, "cloze", None, None, "{{c1::k}}", 2, True, False), (1, 3, "basic", "q", "a", None, 1, False, True), (2, 4, "basic", "q", "a", None, 1, False, False)], "job_id long, card_id long, note_type string, front string, back string, cloze_text string, source_page long, needs_page_image boolean, is_deleted boolean")
    jobs = spark.createDataFrame([(1, "Deck", "ready"), (2, "Other", "processing")], "job_id long, deck_name string, status string")
    images = spark.createDataFrame([(1, 1)], "job_id long, page_number long")
    notes = {r.card_id: r for r in export.text_notes(cards, jobs, images).collect()}
    assert set(notes) == {1, 2} and notes[1].fields == ["a&lt;b", 'x<br><img src="sb-job1-page1.png">'] and notes[2].fields == ["{{c1::k}}", ""]
    store = Versions(spark, str(tmp_path / "out"))
    export.write_export(export.text_notes(cards, jobs, images.union(images)), store.path)
    assert store.read().count() == 2
    for left in ("card_id = 1", "false"):  # an export without notes leaves none of the one before
        export.write_export(export.text_notes(cards.where(left), jobs, images), store.path)
        assert sorted(r.card_id for r in store.read().collect()) == ([1] if left != "false" else [])
    assert [r.refusal for r in export.readiness(jobs).orderBy("job_id").collect()] == [None, "Job is not ready for export."]


def test_fields_round_on_the_exact_value(spark):
    rng = random.Random(3)
    values = [0.00015, 0.03125, None, 0.0, 1.0, -0.25, -0.00005, 0.99995, 0.99994999, 7.5, 1e-9, 5e-5, 123.00005] + [rng.random() * 2 - 0.5 for _ in range(400)] + [k / 2**n for n in (4, 5, 9, 20) for k in range(-9, 40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(export.four_places(F.col("x"))).collect()]
    assert got == [None if v is None else f"{v:.4f}" for v in values]


def test_providers(spark):
    assert providers.provider("labels", "rules")
    with pytest.raises(ValueError, match="diagram_detector 'nope'"):
        providers.provider("labels", "nope")
    rows = spark.createDataFrame([(1, 1), (1, 2)], "job_id long, page_number long")

    def step(row):
        if row["page_number"] == 2:
            raise RuntimeError("no")
        return "fine"

    out = {r.page_number: (r.result, r.error, r.fatal) for r in providers.best_effort(rows, step, "string").collect()}
    assert out == {1: ("fine", None, False), 2: (None, "RuntimeError: no", True)}
    assert [tuple(r) for r in providers.failed_jobs(providers.best_effort(rows, step, "string")).collect()] == [(1, "RuntimeError: no")]
    calm = providers.best_effort(rows.withColumn("error", F.lit("old")), step, "string", (RuntimeError,))
    assert {r.page_number: (r.error, r.fatal) for r in calm.collect()} == {1: (None, False), 2: ("RuntimeError: no", False)} and providers.failed_jobs(calm).count() == 0


def test_recogniser_and_uploads(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(11))), (1, 2, "")], "job_id long, page_number long, text string")
    lines = providers.provider("ocr", "layer")(pages).orderBy("line_index").collect()
    assert [(r.line_index, r.n_words, r.confidence) for r in lines] == [(0, 8, 1.0), (1, 3, 1.0)] and [w.char_start for w in lines[1].words] == [0, 3, 6]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    found = options.admission(options.read_uploads(spark, str(tmp_path)))
    assert {r.filename: r.reason for r in found.collect()} == {"a.pdf": None, "b.pdf": "File is not a valid PDF."}


def test_text_images_hold_whole_lines(spark):
    lines = spark.createDataFrame([(1, 1, 0, "ab " + "x" * 300), (1, 1, 2, "\u4e2d")], "job_id long, page_number long, line_index long, text string")
    row = crop.ink_profile(crop.text_images(lines)).first()
    assert (row.width, row.height) == (303, 80) and [i for i, x in enumerate(row.row_ink) if x] == [0, 1, 8, 9]
    assert sum(row.col_ink) == 302 and row.hist[ord("x")] == 600 and row.hist[ord("?")] == 2 and sum(row.hist) == 303 * 80
