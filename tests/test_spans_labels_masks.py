import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cardloom.functions import geometry as g
from cardloom.functions.text import STOPWORDS
from cardloom.operators import labels, masks, overlaps, spans

BOX = g.BOX


def boxes(spark, values):
    return spark.createDataFrame(values, "l double, t double, w double, h double").select(g.box(F.col("l"), F.col("t"), F.col("w"), F.col("h")).alias("b"))


def test_box_domain_and_overlap(spark):
    rows = boxes(spark, [(0.0, 0.0, 1.0, 1.0), (0.9, 0.9, 0.5, 0.5), (-0.1, 0.0, 0.1, 0.1), (0.0, 0.0, 0.0, 0.1), (0.1, 1.1, 0.1, 0.1)])
    assert [r[0] for r in rows.select(g.is_valid(F.col("b"))).collect()] == [True, True, False, False, False]
    pair = spark.range(1).select(g.overlaps(g.box(0, 0, 0.5, 0.5), g.box(0.5, 0, 0.5, 0.5)).alias("touch"), g.overlaps(g.box(0, 0, 0.5, 0.5), g.box(0.4, 0.4, 0.5, 0.5)).alias("meet")).first()
    assert (pair.touch, pair.meet) == (False, True)


def test_flips(spark):
    raw = spark.createDataFrame([(0.1, 0.7, 0.2, 0.1), (0.1, 0.7, 0.0, 0.1), (2.0, 2.0, 0.1, 0.1), (-0.1, 0.0, 0.3, 0.1)], "x double, y double, w double, h double")
    out = [r[0] for r in raw.select(g.from_bottom_left(*[F.col(c) for c in "xywh"])).collect()]
    assert round(out[0].top, 9) == 0.2 and out[1] is None and out[2] is None and round(out[3].width, 9) == 0.2
    quad = spark.range(1).select(g.from_quad(F.array(F.lit(0.1), F.lit(0.3), F.lit(0.32), F.lit(0.12)), F.array(F.lit(0.5), F.lit(0.52), F.lit(0.6), F.lit(0.58)))).first()[0]
    assert (round(quad.left, 9), round(quad.top, 9), round(quad.width, 9), round(quad.height, 9)) == (0.1, 0.4, 0.22, 0.1)


def test_sizes_and_raw_text(spark):
    texts = [" ".join("k" * size for size in sizes) for sizes in itertools.product((1, 2, 4), repeat=2)] + ["", "kk", "kkk", " ".join("k" * 5), "k " * 6]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    want = [1 <= len(x.split()) <= 5 and len(x.replace(" ", "")) >= 3 for x in texts]
    assert [r[0] for r in rows.select(spans.fitting_size(F.col("x"))).collect()] == want and {True, False} == set(want)
    cuts = [("0123456789", start, size) for start in (-3, 0, 4, 9, 12) for size in (0, 2, 5, 30)]
    cut = spark.createDataFrame(cuts, "x string, s int, n int").select(spans.ref_text(F.col("x"), F.col("s"), F.col("n")))
    assert [r[0] for r in cut.collect()] == [x[max(s, 0) : max(s + n, 0)] for x, s, n in cuts]


def made_lines(seed, count):
    """Lines of one to nine words, some of them stop words."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "is", "in"]) if rng.random() < 0.3 else "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(count)]


def words_of(line, i):
    """``(word, start, length, box)`` of each word of the line ``i``."""
    out, at = [], 0
    for k, w in enumerate(line.split()):
        out.append((w, at, len(w), (k / 10, i / 100, 0.09, 0.004)))
        at += len(w) + 1
    return out


def page(spark, texts, confidence=lambda i: 0.9):
    rows = [(1, 1, i, x, x.split(), confidence(i), len(x.split()), words_of(x, i)) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, f"job_id long, page_number long, line_index long, text string, tokens array<string>, confidence double, n_words long, words array<struct<text:string,char_start:bigint,char_length:bigint,box:{BOX}>>")


def refs(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "job_id long, page_number long, span_ord long, ref_ord long, line_index long, char_start long, char_length long")


def made_refs(seed, lines, count):
    """Spans of one or two references, at words or anywhere, some of them to lines that are not there."""
    rng, out = random.Random(seed), []
    for span in range(count):
        for k in range(rng.choice((1, 1, 1, 2))):
            i = rng.randrange(len(lines) + 2)
            line = lines[i] if i < len(lines) else "none"
            words = words_of(line, i)
            first = rng.randrange(len(words))
            last = rng.randrange(first, min(len(words), first + 6))
            start, end = words[first][1], words[last][1] + words[last][2]
            shift = rng.choice((0, 0, 0, 1, -1))
            out.append((span, k, i, start + shift, end - start))
    return out


def plain_gate(lines, confidence, all_refs):
    """The rules of each span, one after the other."""
    out = {}
    for span in {r[0] for r in all_refs}:
        own = sorted(r[1:] for r in all_refs if r[0] == span)
        covered = [[w for w in words_of(lines[i], i) if w[1] >= start and w[1] + w[2] <= start + size] if i < len(lines) else None for _, i, start, size in own]
        known = all(c is not None for c in covered)
        text = " ".join(" ".join(w[0] for w in c) for c in covered if c)
        hidden = {}
        for (_, i, _, _), c in zip(own, covered, strict=True):
            hidden[i] = hidden.get(i, 0) + len(c or ())
        left = sum(len(lines[i].split()) - min(n, len(lines[i].split())) for i, n in hidden.items() if i < len(lines))
        flags = {
            "confident": known and all(confidence(r[1]) >= 0.5 for r in own), "whole_line": all(c is not None and len(c) == len(lines[r[1]].split()) for r, c in zip(own, covered, strict=True)),
            "enough_context": known and left >= 4, "fits": 1 <= len(text.split()) <= 5 and len(text.replace(" ", "")) >= 3, "only_stopwords": all(w in STOPWORDS for w in text.split()),
        }
        flags["passes"] = flags["confident"] and flags["fits"] and not flags["whole_line"] and flags["enough_context"] and not flags["only_stopwords"]
        around = lambda c: (min(w[3][0] for w in c), max(w[3][0] + w[3][2] for w in c), c[0][3][1], c[0][3][1] + c[0][3][3])
        out[span] = (text, flags, [around(c) for c in covered if c])
    return out


def plain_accept(gate, cap=5):
    kept = []
    for span in sorted(gate):
        text, flags, boxes = gate[span]
        clash = any(text == t or any(min(a[1], b[1]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[2], b[2]) for a in boxes for b in bs) for _, t, bs in kept)
        if flags["passes"] and boxes and not clash and len(kept) < cap:
            kept.append((span, text, boxes))
    return [k[0] for k in kept]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_and_acceptance_equal_plain_rules(spark, seed):
    lines = made_lines(seed, 40)
    confidence = lambda i: (0.3, 0.5, 0.9, 0.9)[i % 4]
    rows = made_refs(seed, lines, 120)
    table, want = page(spark, lines, confidence), plain_gate(lines, confidence, rows)
    gate = spans.gate(refs(spark, rows), table)
    got = {r.span_ord: (r.text, {f: r[f] for f in want[0][1]}) for r in gate.collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    assert all(len({v[1][f] for v in want.values()}) == 2 for f in want[0][1])  # each rule is met and broken
    kept = spans.accept_spans(gate.where("passes"))
    assert sorted(r.span_ord for r in kept.collect()) == plain_accept(want)
    cover = spans.covers(refs(spark, rows), table)
    assert {r.span_ord: r.text for r in spans.span_text(cover).collect()} == {k: v[0] for k, v in want.items() if v[0]}
    assert spans.span_boxes(cover).count() == sum(len(v[2]) for v in want.values())
    found = {(r.span_ord, r.ref_ord, r.word_index, r.word) for r in spans.ref_words(refs(spark, rows), table).collect()}
    assert found == {(r[0], r[1], k, w[0]) for r in rows if r[2] < len(lines) for k, w in enumerate(words_of(lines[r[2]], r[2])) if w[1] >= r[3] and w[1] + w[2] <= r[3] + r[4]}
    raw = {(r.span_ord, r.ref_ord): r.ref_text for r in spans.raw_texts(refs(spark, rows), table).collect()}
    assert raw == {(r[0], r[1]): lines[r[2]][max(r[3], 0) : max(r[3] + r[4], 0)].strip() if r[2] < len(lines) else None for r in rows}
    out = spans.text_occlusions(kept).orderBy("ord").first()
    assert out.front == "Fill in the blank" and out.occlusion.labels == [want[out.ord][0]] and out.occlusion.crop_box.width == 1.0


def test_left_over_words_count_each_line_once(spark):
    lines = page(spark, ["a1 b1 c1 d1 e1 f1", "a2 b2 c2"])
    span = refs(spark, [(0, 0, 0, 0, 2), (0, 1, 0, 3, 2), (0, 2, 1, 0, 8), (1, 0, 0, 0, 8)])
    rows = {r.span_ord: r for r in spans.gate(span, lines).collect()}
    assert rows[0].enough_context and rows[0].text == "a1 b1 a2 b2 c2" and not rows[0].whole_line  # four of six words are left
    assert not rows[1].enough_context and rows[1].text == "a1 b1 c1"


def test_cap_of_five_a_page(spark):
    lines = page(spark, [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}" for i in range(8)])
    chosen = spans.select_spans(lines)
    assert [r.text for r in chosen.orderBy("line_index").collect()][0] == "beta0 gamma0"
    gate = spans.gate(chosen.drop("text"), lines).where("passes")
    assert [r.span_ord for r in spans.accept_spans(gate).orderBy("span_ord").collect()] == [0, 1, 2, 3, 4]
    by_window = {(r.line_index, r.text) for r in spans.best_ranked(spans.candidates(lines)).collect()}
    assert by_window == {(r.line_index, r.text) for r in chosen.collect()}


def passes(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "job_id long, page_number long, pass long, group_ord long, item_indices array<long>, label_text string")


def test_label_merge(spark):
    items = spark.createDataFrame([(1, 1, 3)], "job_id long, page_number long, n_items long")
    merged = labels.merge_passes(passes(spark, [(0, 0, [0, 1], "First"), (1, 0, [1, 0], "Second"), (1, 1, [0], "part"), (1, 2, [2, 99], "kept"), (0, 3, [77], "gone")]), items)
    assert {(tuple(r.indices), r.label_text) for r in merged.collect()} == {((0, 1), "First"), ((2,), "kept")}
    assert "NestedLoop" not in merged._jdf.queryExecution().executedPlan().toString()
    flags = spark.createDataFrame([(1, 1, 0, False, None), (1, 1, 1, True, (0.1, 0.1, 0.8, 0.8))], f"job_id long, page_number long, pass long, is_labeled_diagram boolean, diagram_box {BOX}")
    assert labels.page_flags(flags).first().is_labeled_diagram and labels.page_flags(flags).first().diagram_box.left == 0.1


def occlusion(label, left, masks_):
    return Row(kind="diagram", direction="identify", labels=[label], crop_box=(0.0, 0.0, 1.0, 1.0), target_boxes=[(left, 0.1, 0.1, 0.1)], mask_boxes=[(x, 0.1, 0.1, 0.1) for x in masks_])


def test_grouping_merges_once_per_kind_and_page(spark):
    rows = [(1, 1, i, "diagram", "What is this?", occlusion(n, x, (0.1, 0.3, 0.5))) for i, (n, x) in enumerate((("Ridge", 0.1), ("River bed", 0.3), ("Delta", 0.5)))]
    pending = spark.createDataFrame(rows, f"job_id long, page_number long, ord long, note_type string, front string, occlusion {masks.OCCLUSION}")
    opts = "job_id long, diagram_mask_grouping string, text_mask_grouping string"
    same = masks.group_masks(pending, spark.createDataFrame([(1, "individual", "individual")], opts)).orderBy("bucket_ord").collect()
    assert [r.bucket_ord for r in same] == [0, 1, 2]
    one = masks.group_masks(pending, spark.createDataFrame([(1, "grouped", "individual")], opts)).collect()
    assert len(one) == 1 and one[0].front == "Name all labeled parts" and one[0].occlusion.labels == ["Ridge", "River bed", "Delta"] and len(one[0].occlusion.mask_boxes) == 3
    card = masks.occlusion_cards(pending).orderBy("ord").first()
    assert card.back == "Ridge" and '"kind":"diagram"' in card.occlusion_json
    plan = masks.composition_plan(pending.where("ord = 0"), 100, 100).orderBy("z").collect()
    assert [(r.side, r.fill) for r in plan] == [("question", masks.MASK_COLOR)] * 3 + [("question", masks.HIGHLIGHT_FILL)] + [("answer", masks.MASK_COLOR)] * 2


def test_occlusion_validity(spark):
    rows = [(occlusion(" ", 0.1, ()),), (occlusion("x", 0.1, ()),), (occlusion("x", 0.95, ()),)]
    df = spark.createDataFrame(rows, f"o {masks.OCCLUSION}")
    assert [r[0] for r in df.select(masks.occlusion_is_valid(F.col("o"))).collect()] == [False, True, False]


def test_box_pairs_meet_once_whatever_their_height(spark):
    rng = __import__("random").Random(4)
    rows = [(1, i, rng.random(), rng.random(), rng.random() * 0.5 + 0.01, rng.random() * 0.6 + 0.01) for i in range(60)]
    df = spark.createDataFrame(rows, "job_id long, ident long, l double, t double, w double, h double").select("job_id", "ident", g.box(F.col("l"), F.col("t"), F.col("w"), F.col("h")).alias("box"))
    meet = lambda a, b: min(a[2] + a[4], b[2] + b[4]) > max(a[2], b[2]) and min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3])
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and meet(a, b))
    for crowd in (4096, 7):
        assert sorted((r.a, r.b) for r in overlaps.overlapping_pairs(df, ["job_id"], "ident", crowd).collect()) == want


def test_a_crowded_page_is_swept_tile_by_tile(spark):
    n, side = 100_000, 317
    # a grid of boxes, each a little wider than its cell: it meets its eight neighbours only
    x, y = F.col("id") % side, F.floor(F.col("id") / side)
    grid = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("ident"), g.box(x / side, y / side, F.lit(1.2 / side), F.lit(1.2 / side)).alias("box"))
    pairs = overlaps.overlapping_pairs(grid, ["job_id"], "ident")
    rows, last = n // side, n % side
    right_, below = rows * (side - 1) + max(last - 1, 0), (rows - 1) * side + last
    slanted = (rows - 1) * 2 * (side - 1) + (max(last - 1, 0) + min(last, side - 1))
    got = pairs.agg(F.count("*"), F.count_distinct("a", "b"), F.max(F.abs(F.col("a") - F.col("b")))).first()
    assert tuple(got) == (right_ + below + slanted, right_ + below + slanted, side + 1)


def test_sets_that_all_share_an_item(spark):
    n = 400
    rows = [(1, 1, 0, i, [0, i, i + 1], f"t{i}") for i in range(1, n)] + [(1, 1, 1, i, [0, i], f"s{i}") for i in range(1, n, 2)] + [(1, 1, 1, n, [0], "zero"), (1, 2, 0, 0, [0], "alone")]
    sets = spark.createDataFrame(rows, "job_id long, page_number long, pass long, group_ord long, item_indices array<long>, label_text string")
    items = spark.createDataFrame([(1, 1, n + 1), (1, 2, 9)], "job_id long, page_number long, n_items long")
    merged = labels.merge_passes(sets, items)
    assert {r.label_text for r in merged.collect()} == {f"t{i}" for i in range(1, n)} | {"alone"}
