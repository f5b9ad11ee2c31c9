"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.progress import STAGES

LIMIT = 100
SP = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
_STOP = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{_PUNCT}', ''), '{SP}+', ' ', 'g'))"


def _blank(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g') = '', true)"


def _cloze(x: str) -> str:
    return f"(not {_blank(x)} and coalesce(regexp_matches({x}, '\\{{\\{{c\\d+::.+?\\}}\\}}'), false))"


def _violation(kind: str, front: str, back: str, cloze: str) -> str:
    return f"""case when {kind} = 'basic' and {_blank(front)} then 'Basic cards require a non-empty ''front''.'
      when {kind} = 'basic' and {_blank(back)} then 'Basic cards require a non-empty ''back''.'
      when {kind} = 'cloze' and not {_cloze(cloze)} then 'Cloze cards require non-empty ''cloze_text'' with valid {{{{c1::...}}}} syntax.'
      when {kind} in ('diagram', 'text_occlusion') and {_blank(front)} then 'Occlusion cards require a non-empty ''front''.'
      when {kind} in ('diagram', 'text_occlusion') and {_blank(back)} then 'Occlusion cards require a non-empty ''back''.' end"""


def _fits(x: str) -> str:
    return f"(len(list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> '')) between 1 and 5 and length(replace({x}, ' ', '')) >= 3)"


def _stop(x: str) -> str:
    return f"(len(list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '' and w not in {_STOP})) = 0)"


def _escape(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


def _deck(x: str) -> str:
    return f"(1000000000 + (('0x' || substr(sha256({x}), 1, 16))::UBIGINT % 999999999)::BIGINT)"


WORDS = """toks AS (SELECT doc_id AS job_id, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS w
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM documents)),
words AS (SELECT job_id, w // 160 + 1 AS page_number, (w // 8) % 20 AS line_index, w % 8 AS word_index, w // 8 AS line_no, tok AS text,
  coalesce(sum(length(tok) + 1) OVER (PARTITION BY job_id, w // 8 ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
  length(tok)::BIGINT AS char_length, (w % 8) / 8.0::DOUBLE AS l, ((w // 8) % 20) / 20.0::DOUBLE AS t, (0.9::DOUBLE / 8.0::DOUBLE) AS wd, 0.04::DOUBLE AS ht FROM toks),
lines AS (SELECT job_id, page_number, line_index, any_value(line_no) AS line_no, string_agg(text, ' ' ORDER BY word_index) AS text, list(text ORDER BY word_index) AS tokens,
  ((3 + (job_id + any_value(line_no)) % 8) / 10.0::DOUBLE) AS confidence, count(*) AS n_words FROM words GROUP BY job_id, page_number, line_index),
pages AS (SELECT job_id, page_number, string_agg(text, ' ' ORDER BY line_index) AS text, count(*) AS n_items FROM lines GROUP BY job_id, page_number),
jobs AS (SELECT job_id, max(page_number) AS page_count FROM pages GROUP BY job_id)"""

CARDS = """raw AS (SELECT lang AS job_id, doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM (SELECT *, string_split(text, chr(10)) AS a FROM documents)),
drafts AS (SELECT job_id, doc_id, line_no, CASE WHEN length(line) % 2 = 0 THEN 'basic' ELSE 'cloze' END AS note_type,
  CASE WHEN length(line) % 2 = 0 THEN line END AS front, CASE WHEN length(line) % 2 = 0 THEN source END AS back,
  CASE WHEN length(line) % 2 <> 0 THEN '{{c1::' || string_split(line, ' ')[1] || '}}' || substr(line, length(string_split(line, ' ')[1]) + 1) END AS cloze_text,
  line_no // 20 + 1 AS source_page, line_no % 10 = 0 AS needs_page_image FROM raw)"""

_VALID = f"""valid AS (SELECT * FROM drafts WHERE note_type IN ('basic', 'cloze') AND coalesce(length(front) <= 2000, true) AND coalesce(length(back) <= 2000, true)
  AND coalesce(length(cloze_text) <= 2000, true) AND ({_violation("note_type", "front", "back", "cloze_text")}) IS NULL
  AND source_page BETWEEN 1 AND (SELECT max(source_page) FROM drafts p WHERE p.job_id IS NOT DISTINCT FROM drafts.job_id))"""
_KEPT = f"""keyed AS (SELECT *, {_norm("coalesce(CASE WHEN note_type = 'cloze' THEN cloze_text ELSE front END, '')")} AS key FROM valid),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, key ORDER BY doc_id, line_no) AS rn FROM keyed) WHERE rn = 1 OR key = '')"""

SPANS = f"""cand AS (SELECT job_id, page_number, line_index, confidence, tokens, n_words, unnest(range(1, n_words)) AS start FROM lines WHERE confidence >= 0.5 AND n_words > 1),
runs AS (SELECT *, n AS cnt, array_to_string(tokens[start + 1 : start + n], ' ') AS text FROM cand, (VALUES (1), (2)) c(n) WHERE start + n <= n_words),
chosen AS (SELECT job_id, page_number, line_index, text, (length(array_to_string(tokens[1 : start], ' ')) + 1)::BIGINT AS char_start, length(text)::BIGINT AS char_length
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number, line_index ORDER BY cnt DESC, start) AS rn FROM runs WHERE {_fits("text")} AND NOT {_stop("text")}) WHERE rn = 1)"""
REFS = """refs AS (SELECT job_id, page_number, line_index AS span_ord, 0::BIGINT AS ref_ord, line_index, char_start, char_length FROM chosen
  UNION ALL SELECT job_id, page_number, line_index + 100, 0, line_index, char_start + 1, char_length FROM chosen
  UNION ALL SELECT job_id, page_number, line_index + 200, 0, 99, char_start, char_length FROM chosen
  UNION ALL SELECT job_id, page_number, line_index + 300, 0, line_index, length(text) - length(tokens[-1]), length(tokens[-1]) FROM lines
  UNION ALL SELECT job_id, page_number, line_index + 299, 1, line_index, 0, length(tokens[1]) FROM lines WHERE line_index > 0),
covered AS (SELECT r.job_id, r.page_number, r.span_ord, r.ref_ord, r.line_index, w.word_index, w.text AS word, l, t, wd, ht FROM refs r JOIN words w
  ON r.job_id = w.job_id AND r.page_number = w.page_number AND r.line_index = w.line_index AND w.char_start >= r.char_start AND w.char_start + w.char_length <= r.char_start + r.char_length),
cover AS (SELECT job_id, page_number, span_ord, ref_ord, line_index, count(*) AS n_covered, string_agg(word, ' ' ORDER BY word_index) AS text,
  min(l) AS bl, min(t) AS bt, max(l + wd) - min(l) AS bw, max(t + ht) - min(t) AS bh FROM covered GROUP BY ALL)"""
GATE = f"""placed AS (SELECT r.*, li.confidence, li.n_words, coalesce(c.n_covered, 0) AS n_covered, c.text AS ctext FROM refs r LEFT JOIN lines li USING (job_id, page_number, line_index)
  LEFT JOIN cover c USING (job_id, page_number, span_ord, ref_ord, line_index)),
per_line AS (SELECT job_id, page_number, span_ord, line_index, bool_and(coalesce(confidence >= 0.5, false)) AS confident,
  bool_and(coalesce(n_words > 0 AND n_covered >= n_words, false)) AS whole, max(n_words) AS n_words, sum(n_covered) AS masked FROM placed GROUP BY ALL),
per_span AS (SELECT job_id, page_number, span_ord, bool_and(confident) AS confident, bool_and(whole) AS whole_line, bool_and(n_words IS NOT NULL) AS known,
  coalesce(sum(n_words - least(masked, n_words)), 0) AS left_over FROM per_line GROUP BY ALL),
span_texts AS (SELECT job_id, page_number, span_ord, string_agg(text, ' ' ORDER BY ref_ord) AS text FROM cover GROUP BY ALL),
gate0 AS (SELECT job_id, page_number, span_ord, coalesce(t.text, '') AS text, confident, whole_line, known AND left_over >= 4 AS enough_context FROM per_span LEFT JOIN span_texts t USING (job_id, page_number, span_ord)),
gate AS (SELECT *, {_fits("text")} AS fits, {_stop("text")} AS only_stopwords, confident AND {_fits("text")} AND NOT whole_line AND enough_context AND NOT {_stop("text")} AS passes FROM gate0)"""
ACCEPT = f"""span_list AS (SELECT g.job_id, g.page_number, g.span_ord, any_value(g.text) AS text, any_value({_norm("g.text")}) AS key,
  list({{'l': bl, 't': bt, 'r': bl + bw, 'b': bt + bh, 'w': bw, 'h': bh}} ORDER BY ref_ord) AS boxes
  FROM gate g JOIN cover c USING (job_id, page_number, span_ord) WHERE passes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY span_ord) AS n FROM span_list),
fold AS (SELECT job_id, page_number, n, span_ord, text, key, boxes, true AS ok, [key] AS keys, boxes AS taken, 1 AS k FROM ranked WHERE n = 1
  UNION ALL SELECT r.job_id, r.page_number, r.n, r.span_ord, r.text, r.key, r.boxes, o.ok,
    CASE WHEN o.ok THEN list_append(f.keys, r.key) ELSE f.keys END, CASE WHEN o.ok THEN list_concat(f.taken, r.boxes) ELSE f.taken END, f.k + o.ok::INT
  FROM fold f JOIN ranked r ON r.job_id = f.job_id AND r.page_number = f.page_number AND r.n = f.n + 1,
    LATERAL (SELECT f.k < 5 AND NOT list_contains(f.keys, r.key) AND len(list_filter(f.taken, lambda x: len(list_filter(r.boxes, lambda y:
      least(x.r, y.r) - greatest(x.l, y.l) > 0 AND least(x.b, y.b) - greatest(x.t, y.t) > 0)) > 0)) = 0 AS ok) o),
accepted AS (SELECT job_id, page_number, span_ord, text, boxes FROM fold WHERE ok)"""
PASSES = """marks AS (SELECT job_id, page_number, line_index AS i, CASE WHEN page_number % 5 = 0 THEN 0 ELSE line_index - line_index % 4 END AS b, CASE WHEN page_number % 5 = 0 THEN 0 ELSE line_index END AS own, text FROM lines),
passes AS (SELECT job_id, page_number, 0 AS pass, i * 10 AS group_ord, range(b, own + 1) AS items, 'a ' || text AS label_text FROM marks
  UNION ALL SELECT job_id, page_number, 1, i * 10 + 1, [own], 'b ' || text FROM marks UNION ALL SELECT job_id, page_number, 1, i * 10 + 2, [b, own], 'c ' || text FROM marks
  UNION ALL SELECT job_id, page_number, 1, i * 10 + 3, [own, 99], 'd ' || text FROM marks),
sets AS (SELECT job_id, page_number, indices, min(pass * 1000000 + group_ord)::BIGINT AS label_ord, arg_min(label_text, pass * 1000000 + group_ord) AS label_text
  FROM (SELECT p.*, list_sort(list_distinct(list_filter(items, lambda x: x >= 0 AND x < g.n_items))) AS indices FROM passes p JOIN pages g USING (job_id, page_number)) WHERE len(indices) > 0 GROUP BY ALL),
merged AS (SELECT * FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE a.job_id = b.job_id AND a.page_number = b.page_number AND len(a.indices) < len(b.indices) AND list_has_all(b.indices, a.indices))),
label_box AS (SELECT m.job_id, m.page_number, m.label_ord, m.label_text, 0.0::DOUBLE AS bl, min(li.line_index / 20.0::DOUBLE) AS bt, 1.0::DOUBLE AS bw,
  max(li.line_index / 20.0::DOUBLE + 0.04::DOUBLE) - min(li.line_index / 20.0::DOUBLE) AS bh FROM (SELECT *, unnest(indices) AS line_index FROM merged) m JOIN lines li USING (job_id, page_number, line_index) GROUP BY ALL),
flags AS (SELECT job_id, page_number, (page_number % 3 IN (0, 1)) AS flag, page_number % 2 = 0 AS hinted FROM pages)"""
_SHORT = f"""flagged AS (SELECT DISTINCT job_id, ((page_number - 1) // 10) * 10 + 1 AS page_number FROM pages),
shortlist AS (SELECT f.job_id, f.page_number FROM flagged f JOIN jobs j USING (job_id) WHERE page_count <= {LIMIT} AND f.page_number BETWEEN 1 AND page_count AND (f.page_number % 2 = 0 OR job_id % 3 = 0))"""
#: A pixel for each character, its code the luminance; spaces are white, and so are the two rows below each line.
RASTER = """chars AS (SELECT job_id, page_number, line_index, x, CASE WHEN c = ' ' THEN 255 WHEN unicode(c) > 255 THEN 63 ELSE unicode(c) END AS luma
  FROM (SELECT job_id, page_number, line_index, unnest(range(0, length(text))) AS x, unnest(string_split(text, '')) AS c FROM lines)),
sizes AS (SELECT job_id, page_number, max(length(text))::BIGINT AS w FROM lines GROUP BY ALL),
ink AS (SELECT * FROM chars WHERE luma < 230),
row_on AS (SELECT job_id, page_number, unnest([line_index * 4, line_index * 4 + 1]) AS y FROM (SELECT DISTINCT job_id, page_number, line_index FROM ink)),
col_on AS (SELECT DISTINCT job_id, page_number, x FROM ink),
hist AS (SELECT job_id, page_number, luma, 2 * count(*) AS n FROM chars WHERE luma < 255 GROUP BY ALL),
inked AS (SELECT job_id, page_number, w, coalesce((SELECT sum(n) FROM hist h WHERE h.job_id = s.job_id AND h.page_number = s.page_number AND luma < 230), 0)::BIGINT AS inked FROM sizes s),
running AS (SELECT job_id, page_number, luma, sum(n) OVER (PARTITION BY job_id, page_number ORDER BY luma) AS upto FROM hist),
medians AS (SELECT i.*, coalesce((SELECT min(luma) FROM running r WHERE r.job_id = i.job_id AND r.page_number = i.page_number AND upto >= (i.w * 80) // 2), 255)::BIGINT AS median FROM inked i)"""
#: Edges by gaps and islands: the distance from the seed edge to the nearest run of two blanks on each side.
CROP = """seeds AS (SELECT b.job_id, b.page_number, least(min(bl), CASE WHEN bool_or(hinted) THEN 0.1 ELSE 9 END) AS sl, least(min(bt), CASE WHEN bool_or(hinted) THEN 0.1 ELSE 9 END) AS st,
  greatest(max(bl + bw), CASE WHEN bool_or(hinted) THEN 0.1::DOUBLE + 0.8::DOUBLE ELSE 0 END) AS sr, greatest(max(bt + bh), CASE WHEN bool_or(hinted) THEN 0.1::DOUBLE + 0.8::DOUBLE ELSE 0 END) AS sb
  FROM label_box b JOIN flags USING (job_id, page_number) GROUP BY ALL),
pads AS (SELECT *, round_even(w * 0.03::DOUBLE, 0)::BIGINT AS pad, greatest(2, round_even(w * 0.015::DOUBLE, 0))::BIGINT AS gap FROM seeds JOIN sizes USING (job_id, page_number)),
px AS (SELECT job_id, page_number, w, gap, greatest(0, least(round_even(sl * w, 0)::BIGINT - pad, w - 1)) AS l, round_even((sl + (sr - sl)) * w, 0)::BIGINT + pad AS r0,
  greatest(0, least(round_even(st * 80, 0)::BIGINT - 2, 79)) AS t, round_even((st + (sb - st)) * 80, 0)::BIGINT + 2 AS b0 FROM pads),
px2 AS (SELECT *, greatest(l + 1, least(r0, w)) AS r, greatest(t + 1, least(b0, 80)) AS b FROM px),
xs AS (SELECT p.job_id, p.page_number, p.x, c.x IS NULL AS blank FROM (SELECT job_id, page_number, unnest(range(0, w)) AS x FROM sizes) p LEFT JOIN col_on c USING (job_id, page_number, x)),
ys AS (SELECT p.job_id, p.page_number, p.y, c.y IS NULL AS blank FROM (SELECT job_id, page_number, unnest(range(0, 80)) AS y FROM sizes) p LEFT JOIN row_on c USING (job_id, page_number, y)),
x_runs AS (SELECT job_id, page_number, min(x) AS a, max(x) + 1 AS z FROM (SELECT *, x - row_number() OVER (PARTITION BY job_id, page_number, blank ORDER BY x) AS island FROM xs) WHERE blank GROUP BY job_id, page_number, island),
y_runs AS (SELECT job_id, page_number, min(y) AS a, max(y) + 1 AS z FROM (SELECT *, y - row_number() OVER (PARTITION BY job_id, page_number, blank ORDER BY y) AS island FROM ys) WHERE blank GROUP BY job_id, page_number, island),
edges AS (SELECT p.job_id, p.page_number, p.w,
  coalesce((SELECT max(least(z, p.l)) FROM x_runs q WHERE q.job_id = p.job_id AND q.page_number = p.page_number AND least(z, p.l) - a >= p.gap), 0)::BIGINT AS left_px,
  coalesce((SELECT min(greatest(a, p.r)) FROM x_runs q WHERE q.job_id = p.job_id AND q.page_number = p.page_number AND z - greatest(a, p.r) >= p.gap), p.w)::BIGINT AS right_px,
  coalesce((SELECT max(least(z, p.t)) FROM y_runs q WHERE q.job_id = p.job_id AND q.page_number = p.page_number AND least(z, p.t) - a >= 2), 0)::BIGINT AS top_px,
  coalesce((SELECT min(greatest(a, p.b)) FROM y_runs q WHERE q.job_id = p.job_id AND q.page_number = p.page_number AND z - greatest(a, p.b) >= 2), 80)::BIGINT AS bottom_px FROM px2 p),
unit AS (SELECT e.*, median, greatest(0::DOUBLE, least(1::DOUBLE, left_px / e.w::DOUBLE)) AS cl, greatest(0::DOUBLE, least(1::DOUBLE, top_px / 80::DOUBLE)) AS ct FROM edges e JOIN medians USING (job_id, page_number)),
unit2 AS (SELECT *, greatest(0::DOUBLE, least(1 - cl, (right_px - left_px) / w::DOUBLE)) AS cw, greatest(0::DOUBLE, least(1 - ct, (bottom_px - top_px) / 80::DOUBLE)) AS ch FROM unit),
crops AS (SELECT job_id, page_number, CASE WHEN ok THEN cl ELSE 0 END AS cl, CASE WHEN ok THEN ct ELSE 0 END AS ct, CASE WHEN ok THEN cw ELSE 1 END AS cw, CASE WHEN ok THEN ch ELSE 1 END AS ch
  FROM (SELECT *, median >= 128 AND cw > 0 AND ch > 0 AND cw * ch <= 0.9 AS ok FROM unit2))"""
DIAGRAM = """dia AS (SELECT b.*, cl, ct, cw, ch FROM label_box b JOIN flags f USING (job_id, page_number) JOIN crops USING (job_id, page_number) WHERE flag),
dia_n AS (SELECT job_id, page_number, count(*) AS n_masks FROM dia GROUP BY ALL),
dia_ok AS (SELECT * FROM dia JOIN dia_n USING (job_id, page_number) WHERE trim(label_text) <> '' AND bl >= cl - 0.001 AND bt >= ct - 0.001 AND bl + bw <= cl + cw + 0.001 AND bt + bh <= ct + ch + 0.001)"""
PENDING = """pending AS (SELECT job_id, page_number, page_number * 10000000000 + label_ord AS ord, 'diagram' AS note_type, 'What is this?' AS front, label_text AS label, n_masks,
    [{'l': bl, 't': bt, 'w': bw, 'h': bh}] AS targets, (SELECT list({'l': d.bl, 't': d.bt, 'w': d.bw, 'h': d.bh} ORDER BY d.label_ord) FROM dia d WHERE d.job_id = o.job_id AND d.page_number = o.page_number) AS masks, cl, ct, cw, ch FROM dia_ok o
  UNION ALL SELECT job_id, page_number, 1000000000000000 + page_number * 10000000000 + span_ord, 'text_occlusion', 'Fill in the blank', text, len(boxes),
    list_transform(boxes, lambda x: {'l': x.l, 't': x.t, 'w': x.w, 'h': x.h}), list_transform(boxes, lambda x: {'l': x.l, 't': x.t, 'w': x.w, 'h': x.h}), 0, 0, 1, 1 FROM accepted)"""
EVENTS = """ev AS (SELECT user_id AS job_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
ev2 AS (SELECT *, least(5, (n - 1) // 11) AS stage_ord FROM ev),
ev3 AS (SELECT * EXCLUDE (stage_ord), stage_ord AS named, CASE WHEN n - 1 = stage_ord * 11 THEN 'stage' ELSE 'advance' END AS kind, CASE WHEN n - 1 = stage_ord * 11 AND event_id % 13 < 12 THEN event_id % 13 END AS total,
  CASE WHEN n - 1 <> stage_ord * 11 THEN 1 + event_id % 3 ELSE 0 END AS amount FROM ev2),
ev4 AS (SELECT *, max(CASE WHEN kind = 'stage' AND (total IS NULL OR total > 0) THEN n END) OVER (PARTITION BY job_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS entry FROM ev3),
states AS (SELECT v.*, s.named AS stage_ord, s.total::BIGINT AS stage_total, v.kind = 'stage' AND v.n IS DISTINCT FROM v.entry AS skipped,
  sum(v.amount) OVER (PARTITION BY v.job_id, v.entry ORDER BY v.n ROWS UNBOUNDED PRECEDING)::BIGINT AS completed FROM ev4 v LEFT JOIN ev3 s ON s.job_id = v.job_id AND s.n = v.entry),
stages AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{s}', {w}::DOUBLE, '{label}', {sum(x[1] for x in STAGES[:i])}::DOUBLE)" for i, (s, w, label) in enumerate(STAGES)) + """) v(ord, stage, weight, label, start)),
job_rows AS (SELECT job_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN n >= 66 THEN 'ready' ELSE 'processing' END AS status, stage, label, weight, start, completed, stage_total,
  epoch_us((SELECT max(ts) FROM ev e WHERE e.job_id = s.job_id)) + 30000000 - epoch_us((SELECT min(ts) FROM ev e WHERE e.job_id = s.job_id)) AS elapsed_us
  FROM states s LEFT JOIN stages ON stage_ord = ord WHERE n = (SELECT max(n) FROM ev e WHERE e.job_id = s.job_id)),
percents AS (SELECT *, CASE WHEN status = 'ready' THEN 100::DOUBLE WHEN status = 'failed' OR weight IS NULL OR stage_total IS NULL THEN NULL ELSE greatest(0::DOUBLE, least(100::DOUBLE, start + weight * (least(completed, stage_total) / stage_total::DOUBLE))) END AS percent FROM job_rows)"""
DECK = f"""{CARDS}, deck AS (SELECT doc_id % 150 AS job_id, doc_id * 1000 + line_no AS id, note_type, front, back, cloze_text, CASE WHEN line_no % 13 <> 5 THEN source_page END AS source_page,
  needs_page_image, doc_id % 4 = 1 AS is_deleted FROM drafts)"""
NOTES = f"""ready AS (SELECT job_id, {_deck("'Deck ' || job_id")} AS deck_id FROM job_rows WHERE status = 'ready'),
shown AS (SELECT d.*, deck_id, CASE WHEN needs_page_image AND source_page IN (1, 2, 3) AND (d.job_id + source_page) % 2 = 0 THEN 'sb-job' || d.job_id || '-page' || source_page || '.png' END AS media
  FROM deck d JOIN ready USING (job_id) WHERE NOT is_deleted)"""
_FULL = f"{WORDS}, {SPANS}, {REFS}, {GATE}, {ACCEPT}"
_BOTH = f"{_FULL}, {PASSES}, {RASTER}, {CROP}, {DIAGRAM}, {PENDING}"
_RAW = "raw_boxes AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, (l_quantity - 3) / 50.0::DOUBLE + 0 AS x, l_tax * 12.5::DOUBLE + 0 AS y, l_discount * 5::DOUBLE + 0 AS w, l_linenumber / 20.0::DOUBLE AS h FROM lineitem)"
_IN = "(x >= 0 AND x <= 1 AND y >= 0 AND y <= 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1)"


def _u(x: str) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"


ORACLE: dict[str, str] = {
    "page_lines": f"WITH {WORDS} SELECT job_id, page_number, line_index, text, confidence, n_words, 0::DOUBLE AS \"left\", line_index / 20.0::DOUBLE AS top, 1::DOUBLE AS width, 0.04::DOUBLE AS height FROM lines",
    "page_limit": f"WITH {WORDS} SELECT job_id, page_count, CASE WHEN page_count > {LIMIT} THEN 'PDF has ' || page_count || ' pages, which exceeds the {LIMIT}-page limit.' END AS error_message FROM jobs",
    "page_groups": f"WITH {WORDS} SELECT job_id, (page_number - 1) // 10 AS group_no, min(page_number) AS first_page, max(page_number) AS last_page, sum(length(text))::BIGINT AS chars FROM pages GROUP BY job_id, group_no",
    "upload_admission": """SELECT page_id, CASE WHEN page_id % 7 = 0 OR length(url) > 100 OR length(url) < 1 THEN 'deck_name must be 1-100 characters.'
  WHEN page_id % 3 <> 0 AND page_id % 4 <> 1 AND NOT lower(url) LIKE '%.pdf' THEN 'Uploaded file must be a PDF.'
  WHEN strlen(CASE WHEN page_id % 5 < 3 THEN '%PDF-1.4' || html ELSE html END) > 52428800 THEN 'PDF exceeds the 50 MB size limit.' WHEN page_id % 5 >= 3 AND NOT html LIKE '%PDF-%' THEN 'File is not a valid PDF.' END AS reason FROM pages""",
    "schema_merge": "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source, CASE WHEN doc_id % 2 = 1 THEN n_chars END AS n_chars FROM documents",
    "normalize_text": f"SELECT doc_id AS id, 0::BIGINT AS turn, {_norm('text')} AS key FROM documents UNION ALL SELECT conv_id, turn + 1, {_norm('text')} FROM conversations",
    "word_offsets": f"WITH {WORDS} SELECT job_id, page_number, line_index, char_start + 2 AS char_start, char_length FROM words",
    "word_spans": """WITH c AS (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations), e AS (SELECT *, regexp_matches(substr(text, i, 1), '\\s') AS blank, i = 1 OR regexp_matches(substr(text, i - 1, 1), '\\s') AS edge FROM c)
 SELECT conv_id, turn, (i - 1)::INT AS char_start, length(regexp_extract(substr(text, i), '^\\S+'))::INT AS char_length FROM e WHERE NOT blank AND edge""",
    "recognised_lines": f"""WITH {WORDS}, z AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY job_id, page_number, line_index ORDER BY word_index DESC) = 1)
 SELECT job_id, page_number, line_index, li.text, 1.0::DOUBLE AS confidence, li.n_words, z.char_start AS last_start, z.l AS last_left FROM lines li JOIN z USING (job_id, page_number, line_index)""",
    "cloze_valid": f"WITH {CARDS} SELECT doc_id, line_no, {_cloze('cloze_text')} AS valid FROM drafts WHERE note_type = 'cloze'",
    "card_violations": f"""WITH {CARDS}, turns AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
 both_ AS (SELECT job_id, doc_id, line_no, note_type, front, back, cloze_text FROM drafts UNION ALL SELECT conv_id::VARCHAR, conv_id, turn, 'basic', text, nt, NULL FROM turns WHERE role = 'user' AND nr = 'assistant'),
 odd AS (SELECT job_id, doc_id, line_no, CASE WHEN line_no % 9 = 4 THEN 'text_occlusion' ELSE note_type END AS note_type, front, CASE WHEN line_no % 11 = 3 THEN ' ' ELSE back END AS back, cloze_text FROM both_)
 SELECT job_id, doc_id, line_no, note_type, {_violation('note_type', 'front', 'back', 'cloze_text')} AS violation FROM odd""",
    "valid_drafts": f"WITH {CARDS}, {_VALID} SELECT doc_id, line_no, note_type, source_page FROM valid",
    "dedupe_cards": f"WITH {CARDS}, {_VALID}, {_KEPT} SELECT job_id, doc_id, line_no, note_type FROM kept",
    "cards_per_source": f"WITH {CARDS}, {_VALID}, {_KEPT} SELECT d.source, count(*) AS cards, sum((note_type = 'cloze')::INT)::BIGINT AS cloze_cards FROM kept JOIN documents d USING (doc_id) GROUP BY d.source",
    "generate_cards": f"""WITH {WORDS}, w AS (SELECT job_id, page_number, line_index * 8 + word_index AS i, text, count(*) OVER (PARTITION BY job_id, page_number) AS n FROM words),
 best AS (SELECT job_id, page_number, n, i AS spot FROM w QUALIFY row_number() OVER (PARTITION BY job_id, page_number ORDER BY length(text) DESC, i) = 1)
 SELECT job_id, (page_number - 1) // 10 AS group_no, (page_number - 1) % 10 AS ord, 'cloze' AS note_type, NULL::VARCHAR AS front, NULL::VARCHAR AS back,
  string_agg(CASE WHEN i = spot THEN '{{{{c1::' || text || '}}}}' ELSE text END, ' ' ORDER BY i) AS cloze_text, page_number AS source_page, any_value(best.n) < 20 AS needs_page_image
 FROM best JOIN w USING (job_id, page_number) WHERE i BETWEEN spot - 4 AND spot + 4 GROUP BY job_id, page_number""",
    "diagram_shortlist": f"WITH {WORDS}, {_SHORT} SELECT job_id, page_number FROM shortlist",
    "stage_plan": f"""WITH {WORDS}, {_SHORT}, n AS (SELECT job_id, count(*) AS c FROM shortlist GROUP BY job_id)
 SELECT job_id, job_id % 2 = 0 AS runs_cards, job_id % 2 <> 0 AS runs_text_masks, job_id % 5 <> 0 AND coalesce(c, 0) > 0 AS runs_diagrams, coalesce(c, 0)::BIGINT AS diagram_pages FROM jobs LEFT JOIN n USING (job_id) WHERE page_count <= {LIMIT}""",
    "job_summary": f"WITH {EVENTS}, {DECK} SELECT j.job_id, status, stage, label AS stage_label, coalesce(c, 0)::BIGINT AS card_count FROM job_rows j LEFT JOIN (SELECT job_id, count(*) AS c FROM deck WHERE NOT is_deleted GROUP BY job_id) k ON k.job_id = j.job_id",
    "job_cards": f"WITH {DECK} SELECT job_id, id, note_type, source_page FROM deck WHERE NOT is_deleted ORDER BY job_id, source_page NULLS FIRST, id",
    "candidate_spans": f"""WITH {WORDS}, c AS (SELECT job_id, page_number, line_index, array_to_string(tokens[s + 1 : s + k], ' ') AS text FROM (SELECT *, unnest(range(0, n_words)) AS s FROM lines), (VALUES (1), (2), (3), (4), (5)) v(k) WHERE s + k <= n_words)
 SELECT job_id, page_number, line_index, count(*) AS candidates, sum({_fits('text')}::INT)::BIGINT AS fitting, sum(length(text))::BIGINT AS chars, max(text) AS last_text FROM c GROUP BY ALL""",
    "ref_words": f"WITH {WORDS}, {SPANS}, {REFS} SELECT job_id, page_number, span_ord, ref_ord, line_index, word_index, word FROM covered",
    "raw_ref_texts": f"""WITH {WORDS}, {SPANS}, {REFS} SELECT r.job_id, r.page_number, r.span_ord, r.ref_ord, r.line_index,
 regexp_replace(substr(li.text, r.char_start + 1, r.char_length), '^{SP}+|{SP}+$', '', 'g') AS ref_text FROM refs r LEFT JOIN lines li USING (job_id, page_number, line_index)""",
    "span_text": f"WITH {WORDS}, {SPANS}, {REFS} SELECT job_id, page_number, span_ord, string_agg(text, ' ' ORDER BY ref_ord) AS text FROM cover GROUP BY ALL",
    "span_boxes": f"WITH {WORDS}, {SPANS}, {REFS} SELECT job_id, page_number, span_ord, ref_ord, line_index, bl AS \"left\", bt AS top, bw AS width, bh AS height FROM cover",
    "confident_spans": f"WITH {WORDS}, {SPANS}, {REFS}, {GATE} SELECT job_id, page_number, span_ord, confident FROM per_span",
    "span_gate": f"WITH {WORDS}, {SPANS}, {REFS}, {GATE} SELECT job_id, page_number, span_ord, text, confident, whole_line, enough_context, fits, only_stopwords, passes FROM gate",
    "select_spans": f"WITH {WORDS}, {SPANS} SELECT job_id, page_number, line_index, char_start, char_length, text FROM chosen",
    "box_overlaps": f"""WITH {WORDS}, b AS (SELECT job_id, page_number, line_index, line_index * 8 + word_index AS ident, l, t, CASE WHEN char_length > 4 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS w, CASE WHEN char_length % 2 = 0 THEN 0.07::DOUBLE ELSE 0.05::DOUBLE END AS h FROM words),
 -- boxes are at most 0.07 high and lines 0.05 apart: only words of one line and of the next can overlap
 p AS (SELECT *, line_index + step AS other FROM b, (VALUES (0), (1)) v(step))
 SELECT p.job_id, p.page_number, p.ident AS a, q.ident AS b FROM p JOIN b q ON p.job_id = q.job_id AND p.page_number = q.page_number AND p.other = q.line_index AND p.ident < q.ident WHERE least(p.l + p.w, q.l + q.w) - greatest(p.l, q.l) > 0 AND least(p.t + p.h, q.t + q.h) - greatest(p.t, q.t) > 0""",
    "accept_spans": f"WITH RECURSIVE {_FULL} SELECT job_id, page_number, span_ord, text, len(boxes)::BIGINT AS n_boxes FROM accepted",
    "text_occlusions": f"WITH RECURSIVE {_FULL} SELECT job_id, page_number, span_ord AS ord, 'Fill in the blank' AS front, text AS label, (place - 1)::BIGINT AS place, b.l AS \"left\", b.t AS top, b.w AS width, b.h AS height FROM (SELECT *, unnest(boxes) AS b, generate_subscripts(boxes, 1) AS place FROM accepted)",
    "label_union": f"WITH {WORDS}, {PASSES} SELECT job_id, page_number, label_ord, array_to_string(indices, ',') AS indices, label_text FROM merged",
    "label_boxes": f"WITH {WORDS}, {PASSES} SELECT job_id, page_number, label_ord, label_text, bl AS \"left\", bt AS top, bw AS width, bh AS height FROM label_box",
    "page_flags": f"WITH {WORDS}, {PASSES} SELECT job_id, page_number, flag AS is_labeled_diagram, CASE WHEN hinted THEN 0.1::DOUBLE END AS \"left\", CASE WHEN hinted THEN 0.1::DOUBLE END AS top, CASE WHEN hinted THEN 0.8::DOUBLE END AS width, CASE WHEN hinted THEN 0.8::DOUBLE END AS height FROM flags",
    "low_yield_pages": f"""WITH {WORDS}, {PASSES}, n AS (SELECT job_id, page_number, count(*) AS c FROM label_box GROUP BY ALL)
 SELECT job_id, page_number, coalesce(c, 0)::BIGINT AS n_labels, n_items FROM flags JOIN pages USING (job_id, page_number) LEFT JOIN n USING (job_id, page_number) WHERE flag AND coalesce(c, 0) <= greatest(1, n_items // 10)""",
    "detect_labels": f"""WITH {WORDS}, {_SHORT} SELECT job_id, page_number, n - 1 AS label_ord, text AS label_text, l AS "left", t AS top, wd AS width, ht AS height
 FROM (SELECT w.*, row_number() OVER (PARTITION BY job_id, page_number ORDER BY line_index, word_index) AS n FROM words w SEMI JOIN shortlist USING (job_id, page_number) WHERE regexp_matches(text, '^\\p{{Lu}}')) WHERE n <= 2""",
    "page_prompts": f"""WITH {WORDS}, num AS (SELECT *, rtrim(rtrim(printf('%.3f', line_index / 20.0), '0'), '.') AS q FROM lines),
 rows_ AS (SELECT *, '[' || line_index || '] "' || text || '"' AS plain, CASE WHEN q LIKE '%.%' THEN q ELSE q || '.0' END AS top FROM num)
 SELECT job_id, page_number, md5(string_agg(plain || ' @ (0.0, ' || top || ', 1.0, 0.04)', chr(10) ORDER BY line_index)) AS prompt_md5, string_agg(plain, chr(10) ORDER BY line_index) AS span_prompt FROM rows_ GROUP BY job_id, page_number""",
    "diagram_occlusions": f"WITH {WORDS}, {PASSES}, {RASTER}, {CROP}, {DIAGRAM} SELECT job_id, page_number, label_ord AS ord, 'What is this?' AS front, label_text AS label, n_masks, cl::DOUBLE AS \"left\", ct::DOUBLE AS top, cw::DOUBLE AS width, ch::DOUBLE AS height FROM dia_ok",
    "mask_grouping": f"""WITH RECURSIVE {_BOTH}, opt AS (SELECT *, CASE WHEN note_type = 'diagram' THEN job_id % 2 = 0 ELSE job_id % 3 = 0 END AS merged_, job_id % 2 <> 0 AND job_id % 3 <> 0 AS plain FROM pending),
 bucket AS (SELECT job_id, page_number, note_type, min(ord) AS bucket_ord FROM opt WHERE NOT plain GROUP BY ALL)
 SELECT job_id, page_number, ord, coalesce(bucket_ord, ord) AS bucket_ord, note_type, front, label AS labels, len(targets)::BIGINT AS n_targets, len(masks)::BIGINT AS n_masks FROM opt LEFT JOIN bucket USING (job_id, page_number, note_type) WHERE NOT merged_
 UNION ALL SELECT job_id, page_number, min(ord), min(ord), note_type, CASE WHEN note_type = 'diagram' THEN 'Name all labeled parts' ELSE 'Fill in the blanks' END, string_agg(label, '|' ORDER BY ord), len(list_distinct(flatten(list(targets))))::BIGINT, len(list_distinct(flatten(list(masks))))::BIGINT FROM opt WHERE merged_ GROUP BY job_id, page_number, note_type""",
    "occlusion_cards": f"WITH RECURSIVE {_FULL} SELECT job_id, page_number, span_ord AS ord, 'text_occlusion' AS note_type, 'Fill in the blank' AS front, text AS back, 'text' AS kind, len(boxes)::BIGINT AS n_targets FROM accepted",
    "composition_plan": f"""WITH RECURSIVE {_BOTH}, q AS (SELECT *, unnest(masks) AS m, generate_subscripts(masks, 1) - 1 AS z FROM pending),
 a AS (SELECT *, row_number() OVER (PARTITION BY job_id, page_number, ord ORDER BY z) - 1 AS k FROM q WHERE NOT list_contains(targets, m)),
 r AS (SELECT job_id, page_number, ord, note_type, 'question' AS side, z, m, '60,60,60' AS fill, cl, ct FROM q
  UNION ALL SELECT job_id, page_number, ord, note_type, 'question', len(masks), targets[1], '255,213,79', cl, ct FROM pending WHERE note_type = 'diagram' AND len(targets) = 1
  UNION ALL SELECT job_id, page_number, ord, note_type, 'answer', len(masks) + (note_type = 'diagram' AND len(targets) = 1)::INT + k, m, '60,60,60', cl, ct FROM a)
 SELECT job_id, page_number, ord, note_type, side, z::BIGINT AS z, m.l * 1400 - cl * 1400 AS x0, m.t * 1000 - ct * 1000 AS y0, (m.l + m.w) * 1400 - cl * 1400 AS x1, (m.t + m.h) * 1000 - ct * 1000 AS y1, fill FROM r""",
    "box_validity": f"WITH {_RAW} SELECT k1, k2, k3, k4, count(*) AS boxes, sum({_IN}::INT)::BIGINT AS valid FROM raw_boxes GROUP BY ALL",
    "flip_boxes": f"""WITH {_RAW}, f AS (SELECT *, {_u('x')} AS l, {_u('x + w')} AS r, {_u('y')} AS lo, {_u('y + h')} AS up, {_u('least(x, x + w, x + w / 2)')} AS ql, {_u('greatest(x, x + w, x + w / 2)')} AS qr,
  {_u('1 - greatest(y, y + h, y + h / 2)')} AS qt, {_u('1 - least(y, y + h, y + h / 2)')} AS qb FROM raw_boxes),
 g AS (SELECT *, r > l AND up > lo AS a, qr > ql AND qb > qt AS b FROM f)
 SELECT k1, k2, k3, k4, min(CASE WHEN a THEN l END) AS "left", min(CASE WHEN a THEN 1 - up END) AS top, min(CASE WHEN a THEN r - l END) AS width, min(CASE WHEN a THEN up - lo END) AS height,
  max(CASE WHEN b THEN ql END) AS quad_left, max(CASE WHEN b THEN qt END) AS quad_top, max(CASE WHEN b THEN qr - ql END) AS quad_width, max(CASE WHEN b THEN qb - qt END) AS quad_height FROM g GROUP BY ALL""",
    "occlusion_validity": f"WITH {_RAW} SELECT k1, k2, k3, k4, count(*) AS boxes, sum((k2 <> 1 AND x >= 0.1::DOUBLE - 0.001::DOUBLE AND y >= 0.1::DOUBLE - 0.001::DOUBLE AND x + w <= 0.1::DOUBLE + 0.8::DOUBLE + 0.001::DOUBLE AND y + h <= 0.1::DOUBLE + 0.8::DOUBLE + 0.001::DOUBLE)::INT)::BIGINT AS valid FROM raw_boxes WHERE {_IN} GROUP BY ALL",
    "page_median_luma": f"WITH {WORDS}, {RASTER} SELECT job_id, page_number, inked, median FROM medians",
    "ink_profile": f"""WITH {WORDS}, {RASTER} SELECT job_id, page_number, w AS width, 80::BIGINT AS height, (SELECT count(*) FROM row_on r WHERE r.job_id = s.job_id AND r.page_number = s.page_number) AS rows_with_ink,
 (SELECT count(*) FROM col_on c WHERE c.job_id = s.job_id AND c.page_number = s.page_number) AS cols_with_ink FROM sizes s""",
    "gutter_edges": f"WITH {WORDS}, {PASSES}, {RASTER}, {CROP} SELECT job_id, page_number, left_px, right_px, top_px, bottom_px FROM edges",
    "derive_crop": f"WITH {WORDS}, {PASSES}, {RASTER}, {CROP} SELECT job_id, page_number, cl::DOUBLE AS \"left\", ct::DOUBLE AS top, cw::DOUBLE AS width, ch::DOUBLE AS height FROM crops",
    "resize_plan": """WITH p AS (SELECT p_partkey, (p_size * 37 + p_partkey % 900) AS w, (p_size * 53 + p_partkey % 700) AS h FROM part)
 SELECT p_partkey, CASE WHEN greatest(w, h) > 1024 THEN round_even(w * (1024::DOUBLE / greatest(w, h)), 0)::BIGINT ELSE w END AS width, CASE WHEN greatest(w, h) > 1024 THEN round_even(h * (1024::DOUBLE / greatest(w, h)), 0)::BIGINT ELSE h END AS height FROM p""",
    "resolve_options": """WITH e AS (SELECT event_id, event_id % 12 AS k FROM events), r AS (SELECT *, CASE k WHEN 6 THEN 'options must be valid JSON.' WHEN 7 THEN 'options must be a JSON object.' WHEN 8 THEN 'unknown option' WHEN 9 THEN 'invalid option value' WHEN 10 THEN 'invalid option value' WHEN 11 THEN 'invalid option value' END AS reason FROM e)
 SELECT event_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN k = 2 THEN 'text_occlusion' ELSE 'basic_cloze' END END AS text_card_mode, CASE WHEN reason IS NULL THEN k <> 2 END AS diagram_occlusion_enabled,
  CASE WHEN reason IS NULL THEN CASE WHEN k IN (2, 3, 4, 5) THEN 'grouped' ELSE 'individual' END END AS diagram_mask_grouping, CASE WHEN reason IS NULL THEN CASE WHEN k = 4 THEN 'grouped' ELSE 'individual' END END AS text_mask_grouping FROM r""",
    "upgrade_occlusions": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE 'diagram' END AS kind, 'identify' AS direction, CASE WHEN event_id % 3 = 0 THEN 'a,b ' || event_id ELSE 'part ' || event_id END AS labels, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_targets, (event_id % 4) / 8.0::DOUBLE AS target_left, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_masks FROM events",
    "stage_boundaries": f"WITH {EVENTS} SELECT job_id, stage, weight, start AS boundary FROM ev3 JOIN stages ON ord = named WHERE kind = 'stage' AND (total IS NULL OR total > 0)",
    "progress_state": f"WITH {EVENTS} SELECT job_id, n, stage_ord, completed, stage_total, skipped FROM states",
    "job_progress": f"""WITH {EVENTS} SELECT job_id, status, stage, percent, CASE WHEN status = 'processing' AND percent / 100 >= 0.15 AND elapsed_us > 0 THEN round_even((elapsed_us / 1e6) / (percent / 100) * (1 - percent / 100), 0)::BIGINT END AS eta_seconds FROM percents""",
    "progress_monotone": f"""WITH {EVENTS}, p AS (SELECT job_id, n, CASE WHEN weight IS NOT NULL AND stage_total IS NOT NULL THEN greatest(0, least(100, start + weight * (least(completed, stage_total) / stage_total::DOUBLE))) END AS percent FROM states LEFT JOIN stages ON ord = stage_ord),
 f AS (SELECT job_id, coalesce(percent < max(percent) OVER (PARTITION BY job_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fell FROM p) SELECT job_id, count(*) AS events, sum(fell::INT)::BIGINT AS falls FROM f GROUP BY job_id""",
    "progress_throttled": f"""WITH RECURSIVE {EVENTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS i FROM states WHERE NOT skipped),
 walk AS (SELECT job_id, i, n, stage_ord, completed, kind, true AS due, epoch_us(ts) AS last FROM seen WHERE i = 1
  UNION ALL SELECT x.job_id, x.i, x.n, x.stage_ord, x.completed, x.kind, x.kind = 'stage' OR epoch_us(x.ts) - w.last >= 1000000, CASE WHEN x.kind = 'stage' OR epoch_us(x.ts) - w.last >= 1000000 THEN epoch_us(x.ts) ELSE w.last END
  FROM walk w JOIN seen x ON x.job_id = w.job_id AND x.i = w.i + 1) SELECT job_id, n, stage_ord, completed, kind FROM walk WHERE due""",
    "eta_labels": """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (value - 3) * 97 END AS s FROM events)
 SELECT event_id, CASE WHEN s > 0 THEN CASE WHEN s < 60 THEN 'less than a minute remaining' WHEN floor(s / 60 + 0.5) < 60 THEN 'about ' || floor(s / 60 + 0.5)::BIGINT || ' min remaining' ELSE 'about ' || floor(s / 3600 + 0.5)::BIGINT || ' hr remaining' END END AS eta FROM e""",
    "job_status": f"""WITH {WORDS}, j AS (SELECT job_id, CASE WHEN job_id % 17 = 0 THEN 'File is not a valid PDF.' WHEN page_count > {LIMIT} THEN 'PDF has ' || page_count || ' pages, which exceeds the {LIMIT}-page limit.' WHEN job_id % 13 = 1 THEN 'boom' END AS m FROM jobs)
 SELECT job_id, CASE WHEN m IS NOT NULL THEN 'failed' WHEN job_id % 3 = 1 THEN 'ready' WHEN job_id % 3 <> 0 THEN 'processing' ELSE 'pending' END AS status, m AS error_message FROM j""",
    "active_jobs": f"WITH {EVENTS} SELECT job_id, status, stage FROM job_rows WHERE status IN ('pending', 'processing')",
    "html_escape": f"SELECT page_id, {_escape('html')} AS escaped FROM pages",
    "slugify": "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(CASE WHEN page_id % 11 = 0 THEN ' -- ' ELSE url END)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'deck') AS slug FROM pages",
    "deck_ids": f"SELECT p_partkey, {_deck('p_name')} AS deck_id FROM part",
    "occlusion_fields": f"""WITH RECURSIVE {_FULL} SELECT job_id, page_number, span_ord AS ord, array_to_string(list_transform(boxes, lambda x: '{{{{c1::image-occlusion:rect:left=' || printf('%.4f', x.l) || ':top=' || printf('%.4f', x.t) || ':width=' || printf('%.4f', x.w) || ':height=' || printf('%.4f', x.h) || ':oi=1}}}}'), '<br>') AS occlusions_field FROM accepted""",
    "export_notes": f"""WITH {EVENTS}, {DECK}, {NOTES} SELECT deck_id, CASE WHEN note_type = 'basic' THEN 1607392319 ELSE 1607392320 END::BIGINT AS model_id, job_id, id AS card_id,
  CASE WHEN note_type = 'basic' THEN {_escape("coalesce(front, '')")} ELSE {_escape("coalesce(cloze_text, '')")} END AS field0,
  CASE WHEN note_type = 'basic' THEN {_escape("coalesce(back, '')")} || coalesce('<br><img src="' || media || '">', '') ELSE coalesce('<img src="' || media || '">', '') END AS field1 FROM shown""",
    "export_media": f"WITH {EVENTS}, {DECK}, {NOTES} SELECT DISTINCT deck_id, media FROM shown WHERE media IS NOT NULL",
    "export_occlusion_notes": f"""WITH RECURSIVE {_FULL}, c AS (SELECT job_id, page_number * 1000 + span_ord AS card_id, text, span_ord FROM accepted)
 SELECT {_deck("'Deck ' || job_id")} AS deck_id, 1607392321::BIGINT AS model_id, job_id, card_id, 'sb-job' || job_id || '-card' || card_id || '.png' AS media, '<img src="sb-job' || job_id || '-card' || card_id || '.png">' AS image, 'Fill in the blank' AS header, {_escape('text')} AS back_extra
 FROM c WHERE job_id % 4 <> 0 AND card_id % 5 <> 0 AND span_ord % 7 <> 3""",
    "page_errors": f"WITH {WORDS} SELECT job_id, page_number, CASE WHEN n_items >= 3 THEN n_items * 2 END AS result, CASE WHEN n_items < 3 THEN 'ValueError: page with ' || n_items || ' lines' END AS error FROM pages",
    "job_failures": f"WITH {WORDS} SELECT job_id, 'RuntimeError: page ' || min(page_number) || ' cannot be read' AS error_message FROM pages WHERE n_items = 7 GROUP BY job_id",
    "apply_edits": f"""WITH RECURSIVE base AS (SELECT DISTINCT user_id AS card_id, CASE user_id % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'cloze' WHEN 2 THEN 'diagram' ELSE 'text_occlusion' END AS note_type FROM events),
 log AS (SELECT user_id AS card_id, event_type AS e, (props::JSON->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 fold AS (SELECT card_id, 0 AS n, note_type, CASE WHEN note_type <> 'cloze' THEN 'front' END AS front, CASE WHEN note_type <> 'cloze' THEN 'back' END AS back, CASE WHEN note_type = 'cloze' THEN '{{{{c1::term}}}} is key' END AS cloze_text,
   false AS is_deleted, 0::BIGINT AS applied, 0::BIGINT AS refused, NULL::VARCHAR AS last_reason FROM base
  UNION ALL SELECT f.card_id, f.n + 1, CASE WHEN ok AND NOT occ THEN kind ELSE f.note_type END,
   CASE WHEN NOT ok THEN f.front WHEN occ OR kind = 'basic' THEN nf END, CASE WHEN NOT ok THEN f.back WHEN occ OR kind = 'basic' THEN nb END,
   CASE WHEN NOT ok OR occ THEN f.cloze_text WHEN kind = 'cloze' THEN nc END,
   f.is_deleted OR (l.e = 'error' AND l.k % 10 = 0 AND NOT f.is_deleted), f.applied + ((ok OR del) AND NOT f.is_deleted)::BIGINT, f.refused + (reason IS NOT NULL)::BIGINT, coalesce(reason, f.last_reason)
  FROM fold f JOIN log l ON l.card_id = f.card_id AND l.n = f.n + 1,
   LATERAL (SELECT f.note_type IN ('diagram', 'text_occlusion') AS occ, CASE l.e WHEN 'purchase' THEN 'cloze' WHEN 'signup' THEN 'basic' ELSE f.note_type END AS kind, l.e = 'error' AND l.k % 10 = 0 AS del,
     CASE WHEN l.e IN ('click', 'signup') THEN 'v' || l.k ELSE f.front END AS nf, CASE WHEN l.e IN ('view', 'signup') THEN 'v' || l.k ELSE f.back END AS nb,
     CASE WHEN l.e = 'purchase' THEN CASE WHEN l.k % 2 = 0 THEN '{{{{c1::v' || l.k || '}}}}' ELSE 'v' || l.k END ELSE f.cloze_text END AS nc) a,
   LATERAL (SELECT CASE WHEN f.is_deleted THEN 'Card not found.' WHEN l.e = 'error' AND NOT del THEN 'Occlusion geometry cannot be edited.' WHEN del THEN NULL WHEN occ AND kind <> f.note_type THEN 'Card cannot change to this note type.'
     ELSE {_violation("kind", "nf", "nb", "nc")} END AS reason) b, LATERAL (SELECT reason IS NULL AND NOT del AS ok) c)
 SELECT card_id, note_type, front, back, cloze_text, is_deleted, applied, refused, last_reason FROM fold f WHERE n = (SELECT max(n) FROM log l WHERE l.card_id = f.card_id)""",
}

ORACLE["stored_job_summary"] = f"SELECT job_id, status, stage, card_count FROM ({ORACLE['job_summary']})"
_REASON = "CASE WHEN NOT (x >= 0 AND x <= 1 AND y >= 0 AND y <= 1) THEN 'corner' WHEN NOT (w > 0 AND h > 0) THEN 'extent' WHEN NOT (w <= 1 AND h <= 1) THEN 'size' END"
ORACLE["rejected_boxes"] = f"WITH {_RAW} SELECT k1, k2, k3, k4, reason, count(*) AS boxes FROM (SELECT *, {_REASON} AS reason FROM raw_boxes) WHERE reason IS NOT NULL GROUP BY ALL"
ORACLE["quarantine_counts"] = f"""WITH {_RAW}, r AS (SELECT {_REASON} AS reason FROM raw_boxes), c AS (SELECT reason, count(*) AS n FROM r GROUP BY reason)
 SELECT v.reason, coalesce(n, 0)::BIGINT AS counted, coalesce(n, 0)::BIGINT AS rows FROM (VALUES ('corner'), ('extent'), ('size')) v(reason) LEFT JOIN c USING (reason) UNION ALL SELECT 'seen', count(*), count(*) FROM r"""
ORACLE["published_notes"] = f"""SELECT deck_id, model_id, job_id, card_id, nullif(regexp_extract(field1, 'sb-job[0-9]+-page[0-9]+\\.png'), '') AS media, 2::BIGINT AS n_fields, md5(field1) AS fields_md5 FROM ({ORACLE['export_notes']})
 UNION ALL SELECT deck_id, model_id, job_id, card_id, media, 5::BIGINT, md5(image || '|' || header || '|' || back_extra || '|') FROM ({ORACLE['export_occlusion_notes']})"""
# a deck's events are gone through one after the other; counters then restart with each run and each stage that is entered
ORACLE["run_progress"] = f"""WITH RECURSIVE {EVENTS}, e AS (SELECT job_id, n, epoch_us(ts) AS us, named, total, amount, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'failed' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ready' ELSE kind END AS kind FROM ev3),
 walk AS (SELECT job_id, n, us AS run, us AS last, kind IN ('ready', 'failed') AS ended, false AS late FROM e WHERE n = 1
  UNION ALL SELECT e.job_id, e.n, CASE WHEN us - last > 43200000000 THEN us ELSE run END, CASE WHEN ended AND us - last <= 43200000000 THEN last ELSE us END, (ended AND us - last <= 43200000000) OR kind IN ('ready', 'failed'), ended AND us - last <= 43200000000 FROM walk w JOIN e ON e.job_id = w.job_id AND e.n = w.n + 1),
 own AS (SELECT e.*, run, max(CASE WHEN kind = 'stage' AND (total IS NULL OR total > 0) THEN n END) OVER (PARTITION BY job_id, run ORDER BY n ROWS UNBOUNDED PRECEDING) AS entry FROM e JOIN walk USING (job_id, n) WHERE NOT late)
 SELECT o.job_id, o.n, o.run, s.named AS stage_ord, sum(CASE WHEN o.kind = 'advance' THEN o.amount ELSE 0 END) OVER (PARTITION BY o.job_id, o.run, o.entry ORDER BY o.n ROWS UNBOUNDED PRECEDING)::BIGINT AS completed, s.total::BIGINT AS stage_total, o.kind = 'stage' AND o.n IS DISTINCT FROM o.entry AS skipped FROM own o LEFT JOIN e s ON s.job_id = o.job_id AND s.n = o.entry
 UNION ALL SELECT job_id, n, NULL, NULL, NULL, NULL, NULL FROM walk WHERE late"""
