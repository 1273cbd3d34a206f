"""DuckDB SQL for the registered queries. It shares no code with the operators."""

from __future__ import annotations

# the corpus's accented letters as control characters: DuckDB's levenshtein counts bytes
_FROM = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_TO = "'||" + "||".join(f"chr({n})" for n in [*range(1, 9), *range(14, 27)]) + "||'"


def _enc(x: str) -> str:
    return f"translate({x}, '{_FROM}', '{_TO}')"


_NOISE = "SELECT conv_id, turn, role, text AS ref, replace(replace(translate(text, 'eo', 'c0'), ' the ', ' '), '. ', '. uh ') AS hyp FROM conversations"
_STRUCK = "SELECT conv_id, turn, role, regexp_replace(text, ' th[a-z]* |q', ' | ', 'g') AS ref, text AS hyp FROM conversations"
_TURNS = "SELECT u.conv_id, u.turn, u.role, u.text AS ref, a.text AS hyp FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"
_LINES = lambda src: f"SELECT conv_id, turn, role, regexp_replace(ref, '[\\n\\r\\t ]+', ' ', 'g') AS ref, regexp_replace(hyp, '[\\n\\r\\t ]+', ' ', 'g') AS hyp, 0 AS ignored FROM ({src})"
_PLAIN = lambda src: f"SELECT *, 0 AS ignored FROM ({src})"
_MASK = f"""
SELECT conv_id, turn, role, replace(ref, '|', '') AS ref,
  list_reduce(list_transform(seg, lambda s, i: {{'p': 0::BIGINT, 'j': 0::BIGINT, 'out': ''::VARCHAR, 'seg': s, 'last': i = len(seg)}}),
    lambda acc, e: {{
      'p': acc.p + length(e.seg) + CASE WHEN e.last THEN 0 ELSE 1 END,
      'j': least(length(hyp), CASE WHEN e.last THEN least(acc.j + length(e.seg), length(hyp))
        WHEN regexp_full_match(CASE WHEN acc.p + length(e.seg) = 0 THEN '' ELSE ref[acc.p + length(e.seg) : acc.p + length(e.seg)] END, '\\s?')
          AND regexp_full_match(ref[acc.p + length(e.seg) + 2 : acc.p + length(e.seg) + 2], '\\s?')
        THEN least(acc.j + length(e.seg), length(hyp)) + length(regexp_extract(hyp[least(acc.j + length(e.seg), length(hyp)) + 1 :], '^\\s*\\S*'))
        ELSE least(acc.j + length(e.seg), length(hyp)) + 1 END),
      'out': acc.out || hyp[acc.j + 1 : acc.j + length(e.seg)], 'seg': ''::VARCHAR, 'last': false}},
    {{'p': 0::BIGINT, 'j': 0::BIGINT, 'out': ''::VARCHAR, 'seg': ''::VARCHAR, 'last': false}}).out AS hyp,
  length(ref) - length(replace(ref, '|', '')) AS ignored
FROM (SELECT *, string_split(ref, '|') AS seg FROM ({_STRUCK}))"""

_ORDER = f"""
SELECT conv_id, turn, array_to_string(seg, '') AS masked_ref,
  list_reduce(list_transform(seg, lambda s, i: {{'p': 0::BIGINT, 'j': 0::BIGINT, 'out': ''::VARCHAR, 'seg': s, 'm': coalesce(length(mk[i]), 0)::BIGINT}}),
    lambda acc, e: {{
      'p': acc.p + length(e.seg) + e.m,
      'j': least(length(hyp), CASE WHEN e.m = 0 THEN least(acc.j + length(e.seg), length(hyp))
        WHEN regexp_full_match(CASE WHEN acc.p + length(e.seg) = 0 THEN '' ELSE ref[acc.p + length(e.seg) : acc.p + length(e.seg)] END, '\\s?')
          AND regexp_full_match(ref[acc.p + length(e.seg) + e.m + 1 : acc.p + length(e.seg) + e.m + 1], '\\s?')
        THEN least(acc.j + length(e.seg), length(hyp)) + length(regexp_extract(hyp[least(acc.j + length(e.seg), length(hyp)) + 1 :], '^\\s*\\S*'))
        ELSE least(acc.j + length(e.seg), length(hyp)) + 1 END),
      'out': acc.out || hyp[acc.j + 1 : acc.j + length(e.seg)], 'seg': ''::VARCHAR, 'm': 0::BIGINT}},
    {{'p': 0::BIGINT, 'j': 0::BIGINT, 'out': ''::VARCHAR, 'seg': ''::VARCHAR, 'm': 0::BIGINT}}).out AS masked_hyp,
  4 * length(ref) - length(replace(ref, 'th', '')) - length(replace(ref, 'the', '')) - length(replace(ref, 'an', '')) - length(replace(ref, 'a', '')) AS ignored
FROM (SELECT *, string_split_regex(ref, 'th|the|an|a') AS seg, regexp_extract_all(ref, 'th|the|an|a') AS mk FROM ({_NOISE}))"""


def _scored(pairs: str) -> str:
    """CTEs up to ``m``: all metrics of ``pairs`` (conv_id, turn, role, ref, hyp, ignored), unrounded.

    The distance table is built row by row, all pairs at once; insertions are a running minimum over the row.
    """
    return f"""
WITH RECURSIVE p AS (
  SELECT *, list_filter(regexp_split_to_array(ref, '\\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(hyp, '\\s+'), lambda w: w <> '') AS b FROM ({pairs})),
dp AS (
  SELECT conv_id, turn, 0::BIGINT AS r, j::BIGINT AS j, j::BIGINT AS d, 0::BIGINT AS c, 0::BIGINT AS s, 0::BIGINT AS x, j::BIGINT AS i FROM (SELECT conv_id, turn, unnest(range(0, len(b) + 1)) AS j FROM p)
  UNION ALL
  SELECT conv_id, turn, r, j, best.d + j - best.j, best.c, best.s, best.x, best.i + j - best.j FROM (
    SELECT conv_id, turn, r, j, arg_min(cell, (cell.d - j) * 1000000 - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING) AS best FROM (
      SELECT q.conv_id, q.turn, q.r + 1 AS r, q.j,
        CASE WHEN q.j > 0 AND p.a[q.r + 1] = p.b[q.j] THEN {{'d': dd, 'c': dc + 1, 's': ds, 'x': dx, 'i': di, 'j': q.j}}
             WHEN q.j > 0 AND dd <= q.d THEN {{'d': dd + 1, 'c': dc, 's': ds + 1, 'x': dx, 'i': di, 'j': q.j}}
             ELSE {{'d': q.d + 1, 'c': q.c, 's': q.s, 'x': q.x + 1, 'i': q.i, 'j': q.j}} END AS cell
      FROM (SELECT *, lag(d) OVER w AS dd, lag(c) OVER w AS dc, lag(s) OVER w AS ds, lag(x) OVER w AS dx, lag(i) OVER w AS di FROM dp WINDOW w AS (PARTITION BY conv_id, turn ORDER BY j)) q
      JOIN p ON p.conv_id = q.conv_id AND p.turn = q.turn WHERE q.r < len(p.a)))),
m AS (
  SELECT p.conv_id, p.turn, p.role, p.ref, p.hyp, p.ignored, levenshtein({_enc('p.ref')}, {_enc('p.hyp')}) AS cd, length(p.ref) AS rc, length(p.hyp) AS hc,
    len(p.a) AS n, len(p.b) AS k, dp.d AS wd, dp.c, dp.s, dp.x, dp.i
  FROM p JOIN dp ON dp.conv_id = p.conv_id AND dp.turn = p.turn AND dp.r = len(p.a) AND dp.j = len(p.b)),
f AS (
  SELECT conv_id, turn, 'store-' || (conv_id % 4) AS store, ref, hyp, cd AS char_distance,
    CASE WHEN greatest(rc, hc) = 0 THEN 1.0::DOUBLE ELSE 1 - cd::DOUBLE / greatest(rc, hc) END AS char_similarity, CASE WHEN rc = 0 THEN 1.0::DOUBLE ELSE 1 - cd::DOUBLE / rc END AS char_accuracy,
    wd AS word_distance, CASE WHEN greatest(n, k) = 0 THEN 1.0::DOUBLE ELSE 1 - wd::DOUBLE / greatest(n, k) END AS word_similarity,
    1 - CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE wd::DOUBLE / n END AS word_accuracy, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE wd::DOUBLE / n END AS word_error_rate,
    n AS ref_words, k AS hyp_words, c AS correct_words, s AS substitutions, x AS deletions, i AS insertions, ignored AS ignored_chars,
    CASE WHEN conv_id % 5 <> 0 THEN rc ELSE 0 END AS input_tokens, CASE WHEN conv_id % 5 <> 0 THEN hc ELSE 0 END AS output_tokens
  FROM m)
"""


_RATES = ("char_similarity", "char_accuracy", "word_similarity", "word_accuracy", "word_error_rate")
_COUNTS = ("char_distance", "word_distance", "ref_words", "hyp_words", "correct_words", "substitutions", "deletions", "insertions", "ignored_chars")
_ALL = ", ".join([*(f"{c}::BIGINT AS {c}" for c in _COUNTS), *(f"round({c}, 6) AS {c}" for c in _RATES)])
_AVG = ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _RATES)
_BOXES = "SELECT DISTINCT l_orderkey AS page, (l_partkey % 40 * 9)::BIGINT AS x, (l_suppkey % 9 * 7)::BIGINT AS y, (l_quantity::BIGINT % 31 + 4)::BIGINT AS w, (l_quantity::BIGINT % 17 + l_linenumber + 5)::BIGINT AS h FROM lineitem"


def _bands(size: int | str) -> str:
    """Boxes with their place in reading order."""
    return f"""b AS ({_BOXES}),
s AS (SELECT *, coalesce((y - lag(y) OVER o >= {size})::BIGINT, 0) AS st FROM b WINDOW o AS (PARTITION BY page ORDER BY y, x, w, h)),
g AS (SELECT *, sum(st) OVER (PARTITION BY page ORDER BY y, x, w, h ROWS UNBOUNDED PRECEDING) AS band FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, x, y, w, h) AS pos FROM g)"""


_ENVELOPE = "min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n"
_WORDS = f"""WITH {_bands(10)},
l AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(w) OVER v AS pw, lag(h) OVER v AS ph FROM o WINDOW v AS (PARTITION BY page ORDER BY pos)),
n AS (SELECT *, CASE WHEN x - (px + pw) >= 0 AND x - (px + pw) <= greatest(ph, h) // 3 AND y + h >= py AND y <= py + ph THEN 0 ELSE 1 END AS new FROM l),
q AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS word FROM n),
words AS (SELECT page, word, {_ENVELOPE} FROM q GROUP BY page, word)"""
_FOLD = f"""WITH {_bands('lag(h) OVER o // 2')},
pg AS (SELECT page, list({{'x': x, 'y': y, 'r': x + w, 'b': y + h, 'hs': h, 'n': 1::BIGINT}} ORDER BY pos) AS bs FROM o GROUP BY page),
fold AS (SELECT page, list_reduce(list_transform(bs, lambda e: [e]), lambda acc, e:
  CASE WHEN e[1].b >= acc[-1].y - (acc[-1].hs // acc[-1].n) // 3 AND e[1].y <= acc[-1].b + (acc[-1].hs // acc[-1].n) // 3
  THEN list_concat(acc[1:-2], [{{'x': least(acc[-1].x, e[1].x), 'y': least(acc[-1].y, e[1].y), 'r': greatest(acc[-1].r, e[1].r), 'b': greatest(acc[-1].b, e[1].b), 'hs': acc[-1].hs + e[1].hs, 'n': acc[-1].n + 1}}])
  ELSE list_concat(acc, e) END) AS ls FROM pg),
lines AS (SELECT page, i AS line, ls[i].x AS x, ls[i].y AS y, ls[i].r - ls[i].x AS w, ls[i].b - ls[i].y AS h, ls[i].n AS n FROM (SELECT page, ls, unnest(range(1, len(ls) + 1)) AS i FROM fold))"""
_WS_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _clean() -> str:
    # The answer prefixes.
    prefixes = (
        "(the\\s+)?text\\s+in\\s+(the\\s+)?image\\s+(is|says|reads):?\\s*", "(the\\s+)?image\\s+contains\\s+(the\\s+following\\s+)?text:?\\s*",
        "here''?s?\\s+(the\\s+)?text\\s+(extracted\\s+)?from\\s+(the\\s+)?image:?\\s*", "(i\\s+can\\s+see\\s+)?text\\s+(that\\s+says|reading):?\\s*",
        "i\\s+can\\s+see\\s+text\\s+reading:\\s*", "certainly!\\s+here''?s?\\s+(the\\s+)?text\\s+(extracted\\s+)?from\\s+(the\\s+)?image:?\\s*",
        "here''?s?\\s+the\\s+extracted\\s+text\\s+from\\s+(the\\s+)?image:?\\s*",
    )
    x = _WS_TRIM.format("t")
    for p in prefixes:
        x = _WS_TRIM.format(f"regexp_replace({x}, '^{p}', '', 'i')")
    heads = "['', 'Here''s the text extracted from the image: ', 'Certainly! Here is the text from image:'||chr(10), '\"', 'The image contains the following text:', '```'||chr(10), 'Text in the image reads ', 'I can see text reading: ']"
    tails = "['', ' ', chr(10), '\"', ' '||chr(9), chr(10)||'```', '', '''''']"
    return f"""WITH r AS (SELECT conv_id, turn, {heads}[turn % 8 + 1] || text || {tails}[turn % 8 + 1] AS t FROM conversations),
q AS (SELECT conv_id, turn, trim({x}, '"''') AS t FROM r)
SELECT conv_id, turn, CASE WHEN starts_with(t, '```') AND ends_with(t, '```') THEN {_WS_TRIM.format("regexp_replace(regexp_replace(t, '^```', ''), '```$', '')")} ELSE t END AS text FROM q"""


def _masked(x: str) -> str:
    # Where secrets stand.
    for pattern, to in (
        ('([?&])(api[_\\-]?[kK]ey|key)=([^&\\s"]+)', "\\1\\2=***MASKED***"), ("Bearer\\s+([A-Za-z0-9_\\-\\.]+)", "Bearer ***MASKED***"),
        ("Ocp-Apim-Subscription-Key:\\s*([^\\s]+)", "Ocp-Apim-Subscription-Key: ***MASKED***"), ("x-api-key:\\s*([^\\s]+)", "x-api-key: ***MASKED***"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


# entities are set aside with a control character while the other ampersands are replaced
_AMP = "replace(replace(regexp_replace({0}, '&(amp;|lt;|gt;|quot;|apos;|#[0-9]*;)', chr(1) || '\\1', 'g'), '&', '&amp;'), chr(1), '&')"
_STORED = f"""{_scored(_PLAIN(_TURNS))}, st AS (
  SELECT *, store || '-' || (conv_id % 7) AS file, CASE WHEN conv_id % 7 = 3 THEN 0.0 WHEN conv_id % 7 = 5 THEN char_accuracy + 1 ELSE char_accuracy END AS stored,
    turn <> 2 AND hyp <> '' AND CASE WHEN conv_id % 7 = 3 THEN 0.0 WHEN conv_id % 7 = 5 THEN char_accuracy + 1 ELSE char_accuracy END <> char_accuracy AS changed FROM f)"""
_BOARD = f"count(*) AS total_evaluations, {_AVG}"
_COST = "coalesce(avg(input_tokens) / 1000000 * 2.5 + avg(output_tokens) / 1000000 * 10.0, 0)"
_SPAN = "'<span class=''ocrx_line'' id=''line_' || {n} || ''' title=''bbox ' || x || ' ' || y || ' ' || (x + w) || ' ' || (y + h) || '''><span class=''ocrx_word'' id=''word_' || {n} || ''' title=''bbox ' || x || ' ' || y || ' ' || (x + w) || ' ' || (y + h) || '''>' || {t} || '</span></span>'"
# Fixed value: the document around the spans.
_DOC = (
    """'<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">' || chr(10) || '<head>' || chr(10) || '<title></title>' || chr(10) || '<meta http-equiv="Content-Type" content="text/html;charset=utf-8" />' || chr(10) || '<meta name=''ocr-system'' content=''htr'' />' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<div class=''ocr_page'' id=''page_1''>' || chr(10)""",
    "chr(10) || '</div>' || chr(10) || '</body>' || chr(10) || '</html>'",
)

SQL: dict[str, str] = {
    "score_pairs": f"{_scored(_PLAIN(_NOISE))} SELECT conv_id, turn, {_ALL} FROM f",
    "score_turns": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id, turn, {_ALL} FROM f",
    "score_masked": f"{_scored(_MASK)} SELECT conv_id, turn, {_ALL} FROM f",
    "score_single_line": f"{_scored(_LINES(_NOISE))} SELECT conv_id, turn, {_ALL} FROM f",
    "char_distance": f"SELECT conv_id, turn, levenshtein({_enc('ref')}, {_enc('hyp')}) AS char_distance FROM ({_TURNS})",
    "char_similarity": f"SELECT conv_id, turn, round(CASE WHEN greatest(length(ref), length(hyp)) = 0 THEN 1 ELSE 1 - d::DOUBLE / greatest(length(ref), length(hyp)) END, 6) AS char_similarity, round(CASE WHEN length(ref) = 0 THEN 1 ELSE 1 - d::DOUBLE / length(ref) END, 6) AS char_accuracy FROM (SELECT *, levenshtein({_enc('ref')}, {_enc('hyp')}) AS d FROM ({_TURNS}))",
    "word_distance": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id, turn, word_distance FROM f",
    "word_error_rate": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id, turn, round(word_similarity, 6) AS word_similarity, round(word_error_rate, 6) AS word_error_rate, round(word_accuracy, 6) AS word_accuracy FROM f",
    "align_words": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id, turn, wd AS dist, c AS correct, s AS substitutions, x AS deletions, i AS insertions FROM m",
    "normalize_single_line": "SELECT doc_id, regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g') AS line FROM documents",
    "tokenize": "SELECT doc_id, array_to_string(w, '/') AS words, len(w) AS n_words FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)",
    "mask_ignore": f"SELECT conv_id, turn, ref AS masked_ref, hyp AS masked_hyp, ignored FROM ({_MASK})",
    "mask_order": _ORDER,
    "ignored_count": "SELECT doc_id, 3 * length(text) - length(replace(text, '|', '')) - length(replace(text, 'the', '')) - length(replace(text, ',', '')) AS ignored FROM documents",
    "eval_summary": f"{_scored(_PLAIN(_TURNS))} SELECT {_BOARD} FROM f",
    "leaderboard": f"{_scored(_PLAIN(_TURNS))} SELECT store, {_BOARD} FROM f GROUP BY store",
    "leaderboard_cost": f"{_scored(_PLAIN(_TURNS))} SELECT store, {_BOARD}, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens, round({_COST}, 6) AS page_cost FROM f GROUP BY store",
    "leaderboard_tsv": f"{_scored(_PLAIN(_TURNS))} SELECT 'Model' || chr(9) || 'TotalEvaluations' || chr(9) || 'AvgCharSimilarity' || chr(9) || 'AvgCharAccuracy' || chr(9) || 'AvgWordSimilarity' || chr(9) || 'AvgWordAccuracy' || chr(9) || 'AvgWordErrorRate' AS line UNION ALL SELECT store || chr(9) || count(*) || chr(9) || {' || chr(9) || '.join(f'''format('{{:.6f}}', avg({c}))''' for c in _RATES)} FROM f GROUP BY store",
    "cost_projection": f"""{_scored(_PLAIN(_TURNS))}, t AS (SELECT store, count(*) AS n, avg(input_tokens) AS i, avg(output_tokens) AS o FROM f WHERE input_tokens > 0 OR output_tokens > 0 GROUP BY store)
SELECT store, n AS docs_with_tokens, round(i, 6) AS avg_input_tokens, round(o, 6) AS avg_output_tokens, round(i / 1e6 * 2.5, 6) AS input_cost_per_doc, round(o / 1e6 * 10, 6) AS output_cost_per_doc, round(i / 1e6 * 2.5 + o / 1e6 * 10, 6) AS total_cost_per_doc,
round(i / 1e6 * 2.5 * 5000, 6) AS estimated_input_cost, round(o / 1e6 * 10 * 5000, 6) AS estimated_output_cost, round((i / 1e6 * 2.5 + o / 1e6 * 10) * 5000, 6) AS estimated_total_cost FROM t""",
    "backfill_diff": f"{_STORED} SELECT conv_id, turn, round(CASE WHEN changed THEN char_accuracy ELSE stored END, 6) AS char_accuracy, round(word_similarity, 6) AS word_similarity, changed FROM st",
    "backfill_counts": f"{_STORED} SELECT count(*) FILTER (WHERE c) AS updated, count(*) FILTER (WHERE NOT c) AS skipped FROM (SELECT file, bool_or(changed) AS c FROM st GROUP BY file)",
    "legacy_accuracy": f"{_STORED} SELECT conv_id, turn, round(CASE WHEN stored = 0 AND hyp <> '' AND turn <> 2 THEN char_accuracy ELSE stored END, 6) AS char_accuracy FROM st",
    "row_selection": "SELECT doc_id AS row_idx, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)",
    "bool_parse": "SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 1, 2) THEN true WHEN doc_id % 10 IN (4, 5, 6) THEN false END AS public, doc_id % 10 IN (3, 7, 8, 9) AS failed FROM documents",
    "public_split": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id % 2 = 1 AS public, count(*) AS n, round(avg(word_similarity), 6) AS avg_word_similarity FROM f GROUP BY 1",
    "manifest_paths": "SELECT page_id AS id, url AS path, CASE WHEN regexp_replace(url, '/+$', '') = '' THEN '/' ELSE regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) END AS name, regexp_matches(url, '^https?://') AS remote FROM pages UNION ALL SELECT doc_id, 'data/' || source || '/' || doc_id || '.txt', doc_id || '.txt', false FROM documents",
    "clean_response": _clean(),
    "mask_secrets": f"SELECT page_id, {_masked('t')} AS line FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=ab' || page_id || '\" Bearer t.k-' || page_id || ' x-api-key:  s3 Ocp-Apim-Subscription-Key: z' || page_id AS t FROM pages)",
    "mask_secrets_documents": f"SELECT doc_id, {_masked('text')} AS text FROM documents",
    "fix_ampersands": f"SELECT page_id, {_AMP.format('html')} AS html FROM pages",
    "escape_spans": "SELECT page_id, '<span id=''a''><b>x</b> &lt; ' || replace(url, '<', '&lt;') || '</span>tail < ' || page_id || '</span>' || chr(10) || 'plain < line > ' || page_id AS markup FROM pages",
    "chat_usage": "SELECT conv_id, turn, CASE WHEN conv_id % 9 <> 0 THEN text END AS text, CASE WHEN conv_id % 9 <> 0 THEN length(text) ELSE 0 END AS input_tokens, CASE WHEN conv_id % 9 <> 0 THEN turn ELSE 0 END AS output_tokens FROM conversations",
    "event_keys": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "read_lines": "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS text FROM conversations",
    "error_kinds": "SELECT event_id, CASE WHEN s IN (401, 403) THEN 'authentication' WHEN s IN (408, 504) THEN 'timeout' WHEN s = 429 THEN 'rate_limited' WHEN s IN (400, 404, 405, 409, 413, 422) THEN 'invalid_request' ELSE 'upstream' END AS kind, s AS status, s IN (408, 504, 429) OR s >= 500 AS retryable FROM (SELECT event_id, 395 + event_id % 120 AS s FROM events)",
    "upload_names": "SELECT event_id, ['image.jpg', 'image.png', 'image.webp', 'image.jp2', 'image.img', 'image.img', 'image.img'][event_id % 7 + 1] AS name, ['image/jpeg', 'image/png', 'image/webp', 'image/jp2', NULL, 'image/x-own', NULL][event_id % 7 + 1] AS media_type FROM events",
    # the characters that 500 bytes hold; a character cut through is U+FFFD
    "truncate_body": "SELECT doc_id, CASE WHEN strlen(text) > 500 THEN text[1:k] || CASE WHEN strlen(text[1:k]) < 500 THEN chr(65533) ELSE '' END || '... (truncated)' ELSE text END AS body FROM (SELECT doc_id, text, list_max(list_filter(range(0, 501), lambda n: strlen(text[1:n]) <= 500)) AS k FROM documents)",
    "size_filter": f"SELECT * FROM ({_BOXES}) WHERE w BETWEEN 8 AND 30 AND h BETWEEN 10 AND 20",
    "text_pixels": "SELECT (l_partkey % 256 + l_suppkey % 256 + l_quantity::BIGINT) * 257 // 3 < 32768 AS dark, count(*) AS n FROM lineitem GROUP BY 1",
    "merge_boxes": f"{_WORDS} SELECT page, word, x, y, w, h, n FROM words",
    "line_runs": f"WITH {_bands(20)}, n AS (SELECT *, coalesce((abs(y - lag(y) OVER (PARTITION BY page ORDER BY pos)) >= 20)::BIGINT, 1) AS new FROM o) SELECT page, (sum(new) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS line, x, y, w, h FROM n",
    "box_envelope": f"SELECT page, {_ENVELOPE} FROM ({_BOXES}) GROUP BY page",
    "line_fold": f"{_FOLD} SELECT page, line, x, y, w, h, n FROM lines",
    "crop_boxes": f"SELECT page, x, y, w, h, CASE WHEN w > 10 THEN greatest(0, x - 10) END AS crop_x, CASE WHEN w > 10 THEN greatest(0, y - 10) END AS crop_y, CASE WHEN w > 10 THEN w + 10 END AS crop_w, CASE WHEN w > 10 THEN h + 20 END AS crop_h FROM ({_BOXES})",
    "distribute_words": "SELECT conv_id, turn, i AS slot, array_to_string(w[i * q + least(i, r) + 1 : i * q + least(i, r) + q + CASE WHEN i < r THEN 1 ELSE 0 END], ' ') AS words FROM (SELECT conv_id, turn, w, len(w) // (conv_id % 13 + 1) AS q, len(w) % (conv_id % 13 + 1) AS r, unnest(range(0, conv_id % 13 + 1)) AS i FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations))",
    "hocr_pages": f"{_WORDS} SELECT page, {_DOC[0]} || coalesce(string_agg({_SPAN.format(n='word', t=chr(39) + 'a &amp; b <' + chr(39) + ' || n')}, chr(10) ORDER BY word) FILTER (WHERE n <> 2), '') || {_DOC[1]} AS hocr FROM words GROUP BY page",
    "hocr_tree": f"{_FOLD} SELECT page, line AS number, x, y, w, h, 'line_' || line AS text FROM lines",
    "segment_check": f"SELECT page, count(*) AS n, bool_and(w > 5 AND h <= 26) AS valid FROM ({_BOXES}) GROUP BY page",
    "manifest_rows": """SELECT (row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1)::BIGINT AS row_idx,
  CASE WHEN doc_id % 9 = 0 THEN 'data/a "b",' || chr(10) || doc_id || '.png' ELSE 'data/' || doc_id || '.png' END AS image, 'data/t/' || doc_id || '.txt' AS transcript,
  [true, false, true, NULL][doc_id % 4 + 1] AS public, CASE WHEN doc_id % 9 = 0 THEN 'a "b",' || chr(10) ELSE '' END || doc_id || '.png' AS identifier,
  CASE WHEN doc_id % 4 = 3 THEN 'invalid boolean: maybe' END AS error FROM documents""",
    "transcript_join": "SELECT doc_id, '/t/' || doc_id || '.txt' AS transcript, text AS ref FROM documents WHERE lang <> 'fr'",
    "transcript_missing": "SELECT doc_id, '/t/' || doc_id || '.txt' AS transcript, 'failed to read /t/' || doc_id || '.txt' AS error FROM documents WHERE lang = 'fr'",
    "store_scan": "SELECT conv_id || '.yaml' AS file, 'm:' || conv_id AS model, 't' || turn AS identifier, turn % 10 / 10 AS char_similarity, 0.0::DOUBLE AS char_accuracy, length(text) AS input_tokens, 0::BIGINT AS output_tokens FROM conversations WHERE conv_id % 11 <> 0",
    "store_names": "SELECT page_id, replace(url, ':', '_') || '.yaml' AS file FROM pages",
    "parts_usage": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND trim(text, ' ') <> '' THEN text ELSE '' END AS text, length(text) AS input_tokens, turn AS output_tokens FROM conversations",
    "blocks_usage": "SELECT conv_id, turn, text, turn AS input_tokens, 0::BIGINT AS output_tokens FROM conversations",
    "generate_usage": "SELECT conv_id, turn, text, length(text) AS input_tokens, 0::BIGINT AS output_tokens FROM conversations",
    "token_expiry": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id * 7 END AS expires FROM events",
    "bounded_base64": "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text END AS text FROM documents",
    "basic_hocr": f"{_FOLD} SELECT page, {_DOC[0]} || string_agg({_SPAN.format(n='line', t=chr(39) + 'line_' + chr(39) + ' || line')}, chr(10) ORDER BY line) || {_DOC[1]} AS hocr FROM lines GROUP BY page",
    "components": "SELECT p_partkey AS part, p_partkey % 40 + 5 AS x, p_partkey % 30 + 4 AS y, p_partkey % 39 + 9 AS w, p_partkey % 3 + 10 AS h FROM part",
    "cost_report": f"""{_scored(_PLAIN(_TURNS))}, t AS (SELECT count(*) AS n, avg(input_tokens) AS i, avg(output_tokens) AS o FROM f WHERE input_tokens > 0 OR output_tokens > 0),
l AS (SELECT [format('Documents analyzed: {{}}', n), format('Average input tokens per document: {{:.2f}}', i), format('Average output tokens per document: {{:.2f}}', o), format('Average total tokens per document: {{:.2f}}', i + o),
  'Input token price: $2.50 per 1M tokens', 'Output token price: $10.00 per 1M tokens', format('Input cost: ${{:.6f}}', i / 1e6 * 2.5), format('Output cost: ${{:.6f}}', o / 1e6 * 10), format('Total cost: ${{:.6f}}', i / 1e6 * 2.5 + o / 1e6 * 10),
  format('Input cost of 5000 documents: ${{:.2f}}', i / 1e6 * 2.5 * 5000), format('Output cost of 5000 documents: ${{:.2f}}', o / 1e6 * 10 * 5000), format('Total cost of 5000 documents: ${{:.2f}}', (i / 1e6 * 2.5 + o / 1e6 * 10) * 5000)] AS x FROM t)
SELECT k - 1 AS n, x[k] AS line FROM (SELECT x, unnest(range(1, 13)) AS k FROM l)""",
    "summary_report": f"""{_scored(_PLAIN(_TURNS))}, l AS (SELECT ['=== SUMMARY STATISTICS ===', format('Total Evaluations: {{}}', count(*)), format('Average Character Similarity: {{:.3f}}', avg(char_similarity)), format('Average Character Accuracy: {{:.3f}}', avg(char_accuracy)),
  format('Average Word Similarity: {{:.3f}}', avg(word_similarity)), format('Average Word Accuracy: {{:.3f}}', avg(word_accuracy)), format('Average Word Error Rate: {{:.3f}}', avg(word_error_rate))] AS x FROM f)
SELECT k - 1 AS n, x[k] AS line FROM (SELECT x, unnest(range(1, 8)) AS k FROM l)""",
    "manifest_scan": "SELECT doc_id, text, 'say \"' || lang || '\",' || chr(10) || source AS said, true AS numbered FROM documents",
    "external_eval": f"{_scored(_PLAIN(_TURNS))} SELECT conv_id, turn, false AS failed, {_ALL} FROM f WHERE conv_id % 10 <> 3 UNION ALL BY NAME SELECT conv_id, turn, true AS failed FROM f WHERE conv_id % 10 = 3",
    "image_join": "SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN '' ELSE to_base64(encode(html)) END) AS base64_md5, CASE WHEN page_id % 3 = 0 THEN 0 ELSE strlen(html) END AS n_bytes FROM pages",
    "stored_transcripts": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN text END AS ref FROM conversations",
    "store_round_trip": "SELECT conv_id || '.yaml' AS file, turn AS pos, 'm:' || conv_id AS model, 't' || turn AS identifier, text AS response, CASE WHEN conv_id % 5 = 0 THEN 1.0 ELSE turn % 8 / 8 END::DOUBLE AS char_similarity, role = 'user' AS public, length(text) AS input_tokens, '|' AS ignore, '5m0s' AS timeout FROM conversations",
    "store_listing": "SELECT DISTINCT conv_id || '.yaml' AS file FROM conversations",
    "manifest_short": """WITH r AS (SELECT doc_id, length(source) = 4 AS short, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx FROM documents)
SELECT 'external' AS kind, row_idx, 'a/' || doc_id || '.png' AS transcript, 't/' || doc_id || '.txt' AS transcription, doc_id || '.png' AS identifier FROM r
UNION ALL SELECT 'eval', row_idx, 'a/' || doc_id || '.png', 't/' || doc_id || '.txt', doc_id || '.png' FROM r WHERE NOT short""",
    "line_words": f"""{_FOLD}, l AS (SELECT page, line, n, sum(n) OVER (PARTITION BY page ORDER BY line) AS upto FROM lines),
w AS (SELECT page, x, y, w, h, row_number() OVER (PARTITION BY page ORDER BY pos) AS at FROM o)
SELECT l.page, l.line, (w.at - l.upto + l.n)::BIGINT AS i, w.x, w.y, w.w, w.h FROM l JOIN w ON w.page = l.page AND w.at > l.upto - l.n AND w.at <= l.upto""",
    "service_urls": """WITH m AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN replace(url, '://', '://u:p@') WHEN 3 THEN replace(url, '/en/', '/e%6E/') WHEN 4 THEN replace(url, 'example.net', 'run.app') ELSE url END AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/@?#]+(/[^?#%]*)?$') THEN rtrim(u, '/') || '/v1/a%20b' END AS endpoint,
  CASE WHEN regexp_matches(u, '^https://[^/?#]*[.]run[.]app([/?#]|$)') THEN regexp_extract(u, '^(https://[^/?#]*)', 1) ELSE '' END AS audience FROM m""",
    "request_check": """WITH m AS (SELECT conv_id, turn, conv_id % 7 <> 0 AND turn >= 1 AND conv_id % 5 <> 0 AND conv_id % 3 <> 0 AS other,
  CASE turn % 5 WHEN 0 THEN true WHEN 4 THEN strlen(text) <= 1024 AND NOT regexp_matches(text, '^\\s|\\s$|[\\r\\n]') ELSE false END AS named, turn % 5 = 3 AS nameless FROM conversations)
SELECT conv_id, turn, other AND named AS valid, other AND (named OR nameless) AS valid_without_model FROM m""",
    "stored_durations": """WITH s AS (SELECT o_orderkey, o_orderkey % 20011 AS halves FROM orders), t AS (SELECT o_orderkey, halves / 2 AS seconds, halves // 7200 AS h, halves // 120 % 60 AS m, halves % 120 AS rest FROM s)
SELECT o_orderkey, CASE WHEN seconds = 0.5 THEN '500ms' ELSE CASE WHEN h > 0 THEN h || 'h' || m || 'm' WHEN m > 0 THEN m || 'm' ELSE '' END || rest // 2 || CASE WHEN rest % 2 = 1 THEN '.5' ELSE '' END || 's' END AS text, seconds::DOUBLE AS seconds FROM t""",
}
