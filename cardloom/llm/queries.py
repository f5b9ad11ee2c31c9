"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontam, fim, jaccard, langid, license_scan, mixture, quality, sharding, sketch, suffix, urlfilter
from ..sources.corpus import spread
from .common import drop_path, read, scratch_path, tune


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    store = scratch_path(spark, "slot-map")
    out = sharding.shard(_docs(spark, sf_dir), store=store)
    drop_path(store)  # the places are part of the plan by now
    return out


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.predict(docs.select("doc_id", "text"), langid.train(docs))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return sketch.fingerprints(_docs(spark, sf_dir))


def op4_merge_replay(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    tune(spark)
    return bpe.encode_and_check(_docs(spark, sf_dir), bpe.load_ranks(public_tokenizers.path(ranks)), public_tokenizers.PATTERN)


def op5_sorted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op6_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return suffix.removal(_docs(spark, sf_dir))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return license_scan.scan(_docs(spark, sf_dir))


def op8_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontam.contamination(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.link_classes(_docs(spark, sf_dir))


def op11_dynamic_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return collocations.mine(_docs(spark, sf_dir))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mixture.mix(_docs(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fim.digests(_docs(spark, sf_dir))


QUERIES = {
    "op1_virtual_slots": op1_virtual_slots,
    "op2_crf_language": op2_crf_language,
    "op3_bottom_k": op3_bottom_k,
    "op4_merge_replay": op4_merge_replay,
    "op5_sorted_digests": op5_sorted_digests,
    "op6_suffix_family": op6_suffix_family,
    "op7_license_digests": op7_license_digests,
    "op8_subword_quality": op8_subword_quality,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_prefix_join": op10_prefix_join,
    "op11_dynamic_counting": op11_dynamic_counting,
    "op12_source_mix": op12_source_mix,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _canonical(x: str) -> str:
    """The canonical form of a license text in DuckDB."""
    out = f"trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '(?im)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$', ' ', 'g')), '[^0-9a-z\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g'))"
    out = f"(' ' || replace({out}, ' ', '  ') || ' ')"
    for spelling, standard in license_scan.SPELLINGS:
        out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {standard.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


_RULES = ", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}')" for v, r in urlfilter.RULES)
_KNOWN = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(license_scan.KNOWN))

#: DuckDB SQL with the same rows, where SQL can express the operator. The others are tested against brute force,
#: an official library or held-out accuracy: balanced maps (op1), trained models (op2, op8), sketches of an engine's
#: own hash (op3), merge ranks (op4), and word-aligned overlaps (op9).
ORACLE: dict[str, str] = {
    "op5_sorted_digests": f"""WITH rules AS (SELECT * FROM (VALUES {_RULES}) r(v, h, p, rule)),
 u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 m AS (SELECT s.*, r.rule, r.v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS n FROM s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
 SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1""",
    # every window of 200 bytes is counted by its MD5; removed runs are islands of windows that lie no further apart than one
    "op6_suffix_family": """WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 w AS (SELECT r, i, md5_number(array_slice(x, i, i + 199)) AS s FROM (SELECT r, x, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)),
 hit AS (SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
 marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true)::INT AS new FROM hit),
 runs AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY r, run),
 ends AS (SELECT r, a, z FROM runs UNION ALL SELECT r, n + 1, n FROM b),
 parts AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) + 1 AS low FROM ends),
 kept AS (SELECT r, string_agg(CASE WHEN a > low THEN hex(array_slice(x, low, a - 1)) ELSE '' END, '' ORDER BY a, z) AS h, (sum(z - a + 1))::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans FROM parts JOIN b USING (r) GROUP BY r)
 SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(h)) AS kept_sha256 FROM b JOIN kept USING (r)""",
    "op7_license_digests": f"""WITH known AS (SELECT sha256({_canonical("t")}) AS digest, arg_min(k, i) AS license FROM (VALUES {_KNOWN}) v(i, k, t) GROUP BY 1),
 whole AS (SELECT doc_id, sha256({_canonical("text")}) AS text_sha256 FROM documents),
 lines AS (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
 found AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS line_licenses, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY doc_id)
 SELECT doc_id, text_sha256, license AS text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines FROM whole LEFT JOIN known ON digest = text_sha256 LEFT JOIN found USING (doc_id)""",
    "op10_prefix_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
 sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' ')) WHEN len(a) > 0 THEN ['<' || array_to_string(a, ' ')] ELSE [] END) AS s FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
 edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    # every phrase of up to five words counted in one go
    "op11_dynamic_counting": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS a FROM p),
 n AS (SELECT lang, sum(len(a))::BIGINT AS n FROM w GROUP BY lang),
 g AS (SELECT lang, k, array_to_string(a[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM w, range(1, 6) r(k)) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
 cuts AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score, l.k AS cut_after
   FROM c JOIN n USING (lang) JOIN g l ON l.lang = c.lang AND l.k < c.k AND l.phrase = array_to_string(c.ws[1 : l.k], ' ') JOIN g r ON r.lang = c.lang AND r.k = c.k - l.k AND r.phrase = array_to_string(c.ws[l.k + 1 :], ' ')),
 low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_after) = 1),
 sub AS (SELECT DISTINCT lang, a AS around, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM c, range(2, 5) r(m) WHERE m < k)),
 kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = low.lang AND sub.phrase = low.phrase AND 100 * sub.around >= 100 * low.a))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, cut_after::INT AS cut_after FROM kept QUALIFY rank <= 2000""",
    # targets by rounds: whoever is above twice its size stops there, and the rest is shared anew
    "op12_source_mix": r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
 level AS (SELECT 0 AS i, source, words, weight, false AS capped, 0::DOUBLE AS target, 0::HUGEINT AS part, 1::HUGEINT AS of_ FROM s
  UNION ALL SELECT i + 1, source, words, weight, capped OR weight * free > 200 * words::HUGEINT * unmet, CASE WHEN capped THEN target WHEN weight * free > 200 * words::HUGEINT * unmet THEN 2.0 * words ELSE weight * free / (100.0 * unmet) END, CASE WHEN capped THEN part WHEN weight * free > 200 * words::HUGEINT * unmet THEN 2 * words ELSE weight * free END, CASE WHEN capped THEN of_ WHEN weight * free > 200 * words::HUGEINT * unmet THEN 1 ELSE 100 * unmet END
  FROM (SELECT *, 150 * sum(words) OVER () - coalesce(sum(200 * words) FILTER (capped) OVER (), 0) AS free, sum(weight) FILTER (NOT capped) OVER () AS unmet FROM level) WHERE i < 60),
 t AS (SELECT source, words, target, (part // of_)::BIGINT AS budget FROM level WHERE i = 60),
 o AS (SELECT d.*, words, target, budget, CASE WHEN words > 0 THEN budget // words ELSE 0 END AS epochs, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, words AS source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * words - before)))::BIGINT AS taken, source, before, epochs::BIGINT AS epochs FROM o""",
    "op13_fill_in_middle": r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
 x AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 AS h4, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM h),
 c AS (SELECT doc_id, n, text, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s FROM x)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
}
