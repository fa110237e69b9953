"""SQL (DuckDB) that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from ..functions import text as T
from ..operators.detect import MARKERS, TABLE_ROW
from ..operators.metrics import SCRIPTS, STOPWORDS
from ..operators.profile import marker_words
from ..operators.scoring import SPEC
from ..operators.verdicts import CATEGORIES
from .inputs import DECISIONS, LAYOUT, PAIRS, WORDS, cells_sql, fold_sql, lines_sql, words_sql

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_MIXED = " + ".join(rf"regexp_matches(w, '\p{{{s}}}')::INT" for s in SCRIPTS)
_TRANS = f"'{T.ACCENTED}', '{T.PLAIN}'"


_METRICS = rf"""base AS (SELECT doc_id, text, length(text) AS n_chars, list_filter({lines_sql("text")}, lambda x: NOT regexp_matches(x, '{T.TABULAR}')) AS pl FROM (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS text FROM documents)),
toks AS (SELECT *, array_to_string(pl, chr(10)) AS prose, regexp_extract_all(text, '{T.LETTERS}') AS letters,
  regexp_extract_all(lower(array_to_string(pl, chr(10))), '{T.WORDS}') AS words, regexp_extract_all(array_to_string(pl, chr(10)), '{T.LETTERS}') AS plain,
  list_filter(list_transform(pl, lambda x: trim(x, ' ')), lambda x: x <> '') AS ll, n_chars < 200 AS too_short FROM base),
lang AS (SELECT *, CASE WHEN NOT too_short AND len(l4) > 0 AND len(list_filter(l4, lambda w: w IN ({_STOP})))::DOUBLE / len(l4) > 0.08 THEN 'en' ELSE 'unknown' END AS language FROM
  (SELECT *, regexp_extract_all(lower(substr(text, 1, 4000)), '{T.LETTERS}') AS l4 FROM toks)),
tails AS (SELECT *, words[floor(len(words) * (1 - 0.2::DOUBLE))::BIGINT + 1:] AS tail FROM lang),
lruns AS (SELECT doc_id, max(c) AS best FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, i, l, i - row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS g FROM
  (SELECT doc_id, unnest(ll) AS l, generate_subscripts(ll, 1) AS i FROM lang)) GROUP BY doc_id, l, g) GROUP BY doc_id),
sruns AS (SELECT doc_id, max(c) AS best FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
  (SELECT doc_id, unnest(plain) AS w, generate_subscripts(plain, 1) AS i FROM lang) WHERE length(w) = 1) GROUP BY doc_id, g) GROUP BY doc_id),
grams AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS g FROM tails) GROUP BY doc_id, g) GROUP BY doc_id),
tgrams AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(tail) - 6), lambda i: array_to_string(tail[i:i + 7], ' '))) AS g FROM tails) GROUP BY doc_id, g) GROUP BY doc_id),
metrics AS (SELECT t.doc_id, n_chars, CASE WHEN n_chars > 0 THEN length(text) - length(replace(text, chr(10), '')) + 1 ELSE 0 END AS n_lines,
  CASE WHEN NOT too_short THEN len(letters) END AS n_tokens, CASE WHEN NOT too_short THEN len(words) END AS n_prose_tokens, language, too_short,
  CASE WHEN NOT too_short THEN CASE WHEN len(letters) = 0 THEN 0 ELSE len(list_filter(letters, lambda w: ({_MIXED}) > 1))::DOUBLE / len(letters) END END AS script_mix_ratio,
  CASE WHEN NOT too_short AND language = 'en' THEN CASE WHEN len(list_filter(plain, lambda w: length(w) >= 4)) = 0 THEN 0 ELSE
    len(list_filter(plain, lambda w: length(w) >= 4 AND NOT regexp_matches(translate(lower(w), {_TRANS}), '[aeiouy]')))::DOUBLE / len(list_filter(plain, lambda w: length(w) >= 4)) END END AS vowelless_ratio,
  CASE WHEN NOT too_short THEN CASE WHEN len(words) < 16 OR coalesce(g.c, 0) < 2 THEN 0 ELSE least(1.0::DOUBLE, g.c * 8.0::DOUBLE / len(words)) END END AS top_ngram_coverage,
  CASE WHEN NOT too_short THEN CASE WHEN len(words) < 32 OR len(tail) < 16 OR coalesce(tg.c, 0) < 2 THEN 0 ELSE least(1.0::DOUBLE, tg.c * 8.0::DOUBLE / len(tail)) END END AS tail_ngram_coverage,
  CASE WHEN NOT too_short THEN CASE WHEN len(ll) < 4 THEN 0 ELSE (lr.best - 1)::DOUBLE / len(ll) END END AS dup_line_run,
  CASE WHEN NOT too_short THEN len(regexp_extract_all(text, '{T.JUNK}'))::DOUBLE / n_chars END AS junk_char_rate,
  CASE WHEN NOT too_short THEN len(regexp_extract_all(text, '{T.MOJIBAKE}'))::DOUBLE / n_chars END AS mojibake_rate,
  CASE WHEN NOT too_short THEN CASE WHEN len(letters) = 0 THEN 0 ELSE list_sum(list_transform(letters, lambda w: length(w)))::DOUBLE / len(letters) END END AS mean_token_len,
  CASE WHEN NOT too_short THEN CASE WHEN len(plain) < 10 THEN 0 ELSE coalesce(sr.best, 0)::DOUBLE / len(plain) END END AS short_token_run
  FROM tails t LEFT JOIN lruns lr USING (doc_id) LEFT JOIN sruns sr USING (doc_id) LEFT JOIN grams g USING (doc_id) LEFT JOIN tgrams tg USING (doc_id))"""
_NAMES = ["script_mix_ratio", "vowelless_ratio", "top_ngram_coverage", "tail_ngram_coverage", "dup_line_run", "junk_char_rate", "mojibake_rate", "mean_token_len", "short_token_run"]
_VALUES = "vals AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS metric, {n}::DOUBLE AS value FROM metrics WHERE NOT too_short AND {n} IS NOT NULL" for n in _NAMES) + ")"
_BASELINE = """sorted AS (SELECT metric, list_sort(list(value)) AS v, median(value) AS median, count(*) AS n, quantile_cont(value, 0.99) AS p99 FROM vals GROUP BY metric HAVING count(*) >= 20),
scales AS (SELECT s.metric, s.median, s.n, median(abs(x.value - s.median)) AS mad, any_value(s.v[3 * s.n // 4 + 1] - s.v[s.n // 4 + 1]) AS iqr, any_value(s.p99) AS p99 FROM sorted s JOIN vals x USING (metric) GROUP BY ALL),
baseline AS (SELECT metric, median, CASE WHEN mad > 0 THEN mad WHEN iqr > 0 THEN iqr / 1.35 WHEN p99 > median THEN (p99 - median) / 2.33 END AS mad, n FROM scales)"""
_SPEC = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {w}::DOUBLE, {d})" for m, (w, d) in SPEC.items()) + ") t(metric, weight, direction))"
_SCORES = """zs AS (SELECT doc_id, weight, greatest(0.0, least(6.0, CASE WHEN direction = 0 THEN abs(0.6745 * (value - median) / mad) ELSE 0.6745 * (value - median) / mad END)) AS z
  FROM vals JOIN baseline USING (metric) JOIN spec USING (metric) WHERE mad IS NOT NULL),
scores AS (SELECT doc_id, round(sum(weight * z) / sum(weight), 4) AS risk_score, count(*) AS n_metrics_used FROM zs GROUP BY doc_id)"""


def _rounded(names: list[str], source: str, others: str, where: str = "") -> str:
    return f"SELECT {others}, {', '.join(f'round({n}, 9) AS {n}' for n in names)} FROM {source} {where}"


def _scramble(source: str) -> str:
    prose = f"array_to_string(list_filter({lines_sql('text')}, lambda x: NOT regexp_matches(x, '{TABLE_ROW}')), chr(10))"
    changes = "list_sum(list_transform(range(1, length(w)), lambda i: (regexp_matches(w[i], '[A-Z]') <> regexp_matches(w[i + 1], '[A-Z]'))::INT))"
    return rf"""sp AS (SELECT doc_id, {prose} AS p FROM {source}),
scr AS (SELECT doc_id, n_words, CASE WHEN n_words >= 50 THEN h ELSE [] END AS h FROM (SELECT doc_id, len(list_filter(regexp_extract_all(p, '[^\s]+'), lambda w: regexp_matches(w, '\p{{L}}'))) AS n_words,
  list_filter(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{6,}}') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND {changes} >= 5 AND {changes} >= 0.5 * length(w)) AS h FROM sp))"""


_DEGENERATE = rf"""cells AS (SELECT doc_id, unnest(c) AS value, generate_subscripts(c, 1) AS i, len(c) AS n FROM (SELECT doc_id, r,
  list_filter(flatten(list_transform(r, lambda x: list_transform(string_split_regex(trim(x, ' '), '\s*\|\s*|\t+|\s{{2,}}'), lambda c: trim(c, ' ')))), lambda c: c <> '') AS c FROM rws WHERE len(r) >= 3) WHERE len(c) >= 12),
cnt AS (SELECT doc_id, value, count(*) AS c, min(i) AS f, any_value(n) AS n FROM cells WHERE length(value) <= 3 AND translate(value, '{MARKERS}', '') <> '' GROUP BY ALL),
deg AS (SELECT doc_id, value, c::DOUBLE / n AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS k FROM cnt) WHERE k = 1 AND c::DOUBLE / n >= 0.6)"""

_DEG_TEXT = "text || chr(10) || 'a | 17 | 17' || chr(10) || '17 | 17 | 17' || chr(10) || '17 | 17 | b' || chr(10) || '17 | 17 | 17' || chr(10) || '17 | 17 | 17' || chr(10) || '17 | 17 | 17'"
_FOUND = """found AS (SELECT doc_id, 'invented_words' AS kind, 'high' AS severity FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 'dropped_words', 'medium' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'spelling_variants', 'low' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'repetition_loop', 'high' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'unheard_of', 'medium' FROM documents WHERE doc_id % 13 = 0)"""
_HIDDEN = "hidden AS (SELECT unnest([" + ", ".join(f"'{k}'" for _, (kinds, on) in CATEGORIES.items() if not on for k in kinds.split()) + "]) AS kind)"


def _verdicts(found: str) -> str:
    return f"SELECT doc_id, CASE WHEN bool_or(severity = 'high') THEN 'reject' ELSE 'review' END AS verdict, array_to_string(list_sort(list(DISTINCT kind)), ', ') AS kinds FROM {found} GROUP BY doc_id"


def _all(found: str, docs: str = "documents") -> str:
    return f"SELECT d.doc_id, coalesce(v.verdict, 'ok') AS verdict, coalesce(v.kinds, '') AS kinds FROM {docs} d LEFT JOIN ({_verdicts(found)}) v USING (doc_id)"


_BALANCE = f"""tw AS (SELECT doc_id, unnest({words_sql('text')}) AS word, generate_subscripts({words_sql('text')}, 1) - 1 AS i FROM pairs),
tc AS (SELECT doc_id, word, count(*) AS n, min(i) AS first_at FROM tw GROUP BY ALL),
sc AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({words_sql('source')}) AS word FROM pairs) GROUP BY ALL),
balance AS (SELECT doc_id, word, greatest(coalesce(tc.n, 0) - coalesce(sc.n, 0), 0) AS extra, greatest(coalesce(sc.n, 0) - coalesce(tc.n, 0), 0) AS lost, first_at FROM tc FULL JOIN sc USING (doc_id, word))"""

_CELLS = f"""tcell AS (SELECT doc_id, cell - 1 AS cell, {fold_sql('chunk')} AS letters FROM (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS cell FROM (SELECT doc_id, {cells_sql('TEXT_')} AS c FROM pairs))),
scell AS (SELECT doc_id, {fold_sql('chunk')} AS letters FROM (SELECT doc_id, unnest({cells_sql('SOURCE_')}) AS chunk FROM pairs)),
known AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(letters) - 8), lambda i: substr(letters, i, 10))) AS s FROM scell),
hits AS (SELECT doc_id, cell, i - 1 AS i FROM (SELECT doc_id, cell, unnest(list_transform(range(1, length(letters) - 8), lambda i: substr(letters, i, 10))) AS s, unnest(range(1, length(letters) - 8)) AS i FROM tcell) SEMI JOIN known USING (doc_id, s)),
letters AS (SELECT doc_id, cell, length(letters) AS n, unnest(range(0, length(letters))) AS p FROM tcell),
cov AS (SELECT l.doc_id, l.cell, l.n, l.p, EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = l.doc_id AND h.cell = l.cell AND h.i BETWEEN l.p - 9 AND l.p) AS hit FROM letters l)"""
_CELLS_FAST = _CELLS[: _CELLS.index("cov AS")] + """marks AS (SELECT doc_id, cell, p, max(i) OVER (PARTITION BY doc_id, cell ORDER BY p ROWS UNBOUNDED PRECEDING) AS last, n FROM (SELECT l.doc_id, l.cell, l.n, l.p, h.i FROM letters l LEFT JOIN hits h ON h.doc_id = l.doc_id AND h.cell = l.cell AND h.i = l.p)),
cov AS (SELECT doc_id, cell, n, p, coalesce(last > p - 10, false) AS hit FROM marks)"""
_CELLS_TEXT = _CELLS_FAST.replace("TEXT_", "text").replace("SOURCE_", "source")
_CELLS_SOURCE = _CELLS_FAST.replace("TEXT_", "source").replace("SOURCE_", "text")


def _unmatched(min_run: int) -> str:
    return f"""gaps AS (SELECT doc_id, cell, n, min(p) AS start, count(*) AS c FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, cell ORDER BY p) AS g FROM cov WHERE NOT hit) GROUP BY doc_id, cell, n, g),
tot AS (SELECT doc_id, cell, n, sum(c) AS m, min(start) AS f FROM gaps GROUP BY ALL),
runs AS (SELECT doc_id, cell, f AS start, m AS n FROM tot WHERE n >= 30 AND m > 0.5 * n UNION ALL
  SELECT g.doc_id, g.cell, g.start, g.c FROM gaps g JOIN tot t USING (doc_id, cell) WHERE NOT (t.n >= 30 AND t.m > 0.5 * t.n) AND g.c >= {min_run} AND t.n >= {min(min_run, 30)})"""


_EDGE = "(bottom < 0.1 * page_height OR top > (1 - 0.1) * page_height)"


def _signature(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\d+', '#', 'g'), '\s+', ' ', 'g'), '^[^\p{{L}}\p{{N}}_]+', ''), '[^\p{{L}}\p{{N}}_]+$', '')"


_HEADS = rf"""sigs AS (SELECT *, {_signature('text')} AS sig FROM layout),
hd AS (SELECT doc_id, sig, count(*) AS n_pages, max(top) - min(top) AS spread FROM (SELECT doc_id, sig, page, arg_min(top, line) AS top FROM sigs WHERE {_EDGE} AND size <= 10.5 AND sig <> '' AND length(sig) < 200 GROUP BY ALL) GROUP BY ALL),
heads AS (SELECT doc_id, sig, n_pages FROM hd JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM layout GROUP BY doc_id) USING (doc_id) WHERE n_pages >= greatest(2, round_even(0.45 * n, 0)) AND spread <= 12)"""
_HEADINGS = r"""edges AS (SELECT *, list_sort(list(x1) OVER w) AS xs, min(x0) OVER w AS "left" FROM layout WINDOW w AS (PARTITION BY doc_id, page)),
rights AS (SELECT *, xs[floor(0.9 * (len(xs) - 1))::INT + 1] AS "right" FROM edges),
headed AS (SELECT *, length(text) <= 90 AND x1 < "right" - 0.2 * greatest("right" - "left", 1.0) AND (size > 10.8 OR bold OR (text = upper(text) AND regexp_matches(text, '\p{Lu}') AND length(text) > 3)) AS heading FROM rights)"""
_BULLET = T.BULLET.replace("'", "''")
_TERMINAL = T.TERMINAL.replace("'", "''")
_LOWER = T.LOWER_START.replace("'", "''")
_MARKS = ", ".join(f"('{k}', '{w}')" for k, w in marker_words() if k in ("eng", "fra", "spa", "deu"))
_VOCAB = rf"""wd AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{T.LETTERS}'), lambda w: length(w) >= 2)) AS word FROM documents)"""
_SUSPICIOUS = rf"""{_VOCAB}, known AS (SELECT word FROM wd GROUP BY word HAVING count(DISTINCT doc_id) >= 2),
seq AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS bef FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM
  (SELECT doc_id, list_filter(regexp_extract_all(text, '{T.LETTERS}'), lambda w: length(w) >= 2) AS l FROM documents))),
susp AS (SELECT DISTINCT doc_id, word FROM seq WHERE length(word) >= 5 AND word = lower(word) AND regexp_matches(word, '\p{{Ll}}') AND word NOT IN (SELECT word FROM known)
  AND NOT (regexp_matches(coalesce(bef, ''), '^\p{{Lu}}') AND replace(lower(coalesce(bef, '')), 'ß', 'ss') NOT IN (SELECT word FROM known)))"""
_SUMMARY = f"""{_FOUND}, {DECISIONS}, checks AS ({_all('found', '(SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)')}), soft AS (SELECT * FROM found WHERE severity <> 'low'),
triage AS ({_all('soft', '(SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)')}),
summ AS (SELECT *, CASE decision WHEN 'rejected' THEN 0 WHEN 'needs_work' THEN 1 WHEN 'accepted' THEN 2 ELSE 3 END AS decision_rank, CASE tool_verdict WHEN 'reject' THEN 0 WHEN 'review' THEN 1 WHEN 'unknown' THEN 2 WHEN 'ok' THEN 3 ELSE 4 END AS verdict_rank FROM
 (SELECT d.doc_id, coalesce(c.verdict, t.verdict, '') AS tool_verdict, coalesce(c.kinds, t.kinds, '') AS problems, coalesce(x.decision, '') AS decision, coalesce(x.reviewer, '') AS reviewer
  FROM documents d LEFT JOIN checks c USING (doc_id) LEFT JOIN triage t USING (doc_id) LEFT JOIN decisions x USING (doc_id)))"""


def _anchored(k: int) -> str:
    grams = lambda x: f"list_transform(range(1, len({x}) - {k - 2}), lambda i: array_to_string({x}[i:i + {k - 1}], ' '))"
    return f"""u{k} AS (SELECT doc_id, g, min(j) AS j FROM (SELECT doc_id, unnest({grams('s')}) AS g, unnest(range(1, len(s) - {k - 2})) - 1 AS j FROM w) GROUP BY doc_id, g HAVING count(*) = 1),
        m{k} AS (SELECT doc_id, i, j FROM (SELECT doc_id, unnest({grams('t')}) AS g, unnest(range(1, len(t) - {k - 2})) - 1 AS i FROM w) JOIN u{k} USING (doc_id, g)),
        a{k} AS (SELECT doc_id, i + d AS "at", arg_min(j + d, i) AS source_at FROM (SELECT *, unnest(range(0, {k})) AS d FROM m{k}) GROUP BY doc_id, i + d)"""



def unfound_sql(pairs: str) -> str:
    """CTEs up to unf (doc_id, line, n_cells, n_unfound): the table rows of a relation of text and source that the source lacks."""
    covered = "len(list_filter(range(1, length(x) + 1), lambda p: len(list_filter(range(greatest(1, p - 9), least(p, length(x) - 9) + 1), lambda i: contains(k, substr(x, i, 10)))) > 0))"
    gone = f"CASE WHEN length(x) < 20 THEN NOT contains(s, x) ELSE 2 * (length(x) - {covered}) > length(x) END"
    return f"""ur AS (SELECT doc_id, {fold_sql('source')} AS s, array_to_string(list_transform({cells_sql('source')}, lambda c: {fold_sql('c')}), '|') AS k, string_split(text, chr(10)) AS l FROM {pairs}),
  us_ AS (SELECT doc_id, s, k, unnest(l) AS row_, generate_subscripts(l, 1) - 1 AS line FROM ur),
  uc AS (SELECT doc_id, s, k, line, list_filter(list_transform(string_split_regex(row_, '[\t|]'), lambda x: {fold_sql('x')}), lambda x: x <> '') AS c FROM us_ WHERE regexp_matches(row_, '[\t|]')),
  unf AS (SELECT doc_id, line, len(c) AS n_cells, len(list_filter(c, lambda x: {gone})) AS n_unfound FROM uc WHERE len(c) >= 2 AND len(list_filter(c, lambda x: {gone})) >= greatest(2, 0.5 * len(c)))"""


ORACLES: dict[str, str] = {
    "audit_metrics": f"WITH {_METRICS} {_rounded(_NAMES, 'metrics', 'doc_id, n_chars, n_lines, n_tokens, n_prose_tokens, language, too_short')}",
    "audit_baseline": f"WITH {_METRICS}, {_VALUES}, {_BASELINE} SELECT metric, round(median, 9) AS median, round(mad, 9) AS mad, n FROM baseline WHERE mad IS NOT NULL",
    "audit_scores": f"WITH {_METRICS}, {_VALUES}, {_BASELINE}, {_SPEC}, {_SCORES} SELECT doc_id, round(risk_score, 3) AS risk_score, n_metrics_used FROM scores",
    "audit_triage": f"""WITH {_METRICS}, {_VALUES}, {_BASELINE}, {_SPEC}, {_SCORES}, {_scramble('documents')} SELECT doc_id, too_short, round(risk_score, 3) AS risk_score,
        CASE WHEN too_short THEN 'too_short' WHEN coalesce(len(h), 0) >= 2 THEN 'scrambled' WHEN risk_score >= (SELECT quantile_cont(risk_score, 0.95) FROM scores) THEN 'review' ELSE 'ok' END AS verdict
        FROM metrics LEFT JOIN scores USING (doc_id) LEFT JOIN scr USING (doc_id)""",
    "quick_triage": f"""WITH {_METRICS}, {_scramble('documents')}, rws AS (SELECT doc_id, list_filter({lines_sql('text')}, lambda x: regexp_matches(x, '{T.TABULAR}')) AS r FROM documents), {_DEGENERATE},
        found AS (SELECT doc_id, 'repetition_loop' AS kind, 'high' AS severity FROM metrics WHERE top_ngram_coverage > 0.45 OR tail_ngram_coverage > 0.55
          UNION ALL SELECT doc_id, 'mixed_scripts', 'high' FROM metrics WHERE script_mix_ratio > 0.02 UNION ALL SELECT doc_id, 'garbled_characters', 'high' FROM metrics WHERE mojibake_rate > 0.001
          UNION ALL SELECT doc_id, 'control_characters', 'medium' FROM metrics WHERE junk_char_rate > 0.005 UNION ALL SELECT doc_id, 'letter_spacing', 'medium' FROM metrics WHERE short_token_run > 0.10
          UNION ALL SELECT doc_id, 'degenerate_table', 'medium' FROM deg UNION ALL SELECT doc_id, 'scrambled_text', CASE WHEN len(h) >= 2 THEN 'high' ELSE 'medium' END FROM scr WHERE len(h) >= 1) {_all('found')}""",
    "prose_lines": f"""SELECT doc_id, len(l) AS n_lines, len(p) AS n_prose, length(array_to_string(p, chr(10))) AS n_chars FROM
        (SELECT doc_id, {lines_sql('text')} AS l, list_filter({lines_sql('text')}, lambda x: NOT regexp_matches(x, '{T.TABULAR}')) AS p FROM documents)""",
    "ngram_coverage": f"WITH {_METRICS} {_rounded(['top_ngram_coverage', 'tail_ngram_coverage'], 'metrics', 'doc_id', 'WHERE NOT too_short')}",
    "dup_line_run": f"WITH {_METRICS} {_rounded(['dup_line_run'], 'metrics', 'doc_id', 'WHERE NOT too_short')}",
    "short_token_run": f"WITH {_METRICS} {_rounded(['short_token_run'], 'metrics', 'doc_id', 'WHERE NOT too_short')}",
    "degenerate_table": f"""WITH made AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {_DEG_TEXT} ELSE text END AS text FROM documents),
        rws AS (SELECT doc_id, list_filter({lines_sql('text')}, lambda x: regexp_matches(x, '{T.TABULAR}')) AS r FROM made), {_DEGENERATE} SELECT doc_id, value, round(share, 9) AS share FROM deg""",
    "scrambled": f"""WITH made AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' aBcDeFgH tHeReFoRe Ordinary UPPERCASE' ELSE text END AS text FROM documents), {_scramble('made')}
        SELECT doc_id, n_words, len(h) AS n_scrambled, array_to_string(h[1:6], ', ') AS sample FROM scr""",
    "control_chars": f"""WITH made AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN substr(text, 1, 40) || chr(1) || chr(65533) || chr(2) || substr(text, 41) ELSE text END AS text FROM documents),
        c AS (SELECT doc_id, text, len(regexp_extract_all(text, '{T.JUNK}')) AS n FROM made)
        SELECT doc_id, n AS n_junk, round(n::DOUBLE / length(text), 9) AS junk_char_rate, instr(text, regexp_extract(text, '{T.JUNK}')) - 1 AS first_at FROM c WHERE n::DOUBLE / length(text) > 0.005""",
    "repeated_line": f"""WITH l AS (SELECT doc_id, text, trim(unnest(p), ' ') AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, text, list_filter({lines_sql('text')}, lambda x: NOT regexp_matches(x, '{T.TABULAR}')) AS p FROM documents)),
        c AS (SELECT doc_id, line, count(*) AS times, min(i) AS f, any_value(text) AS text FROM l WHERE length(line) > 3 GROUP BY doc_id, line HAVING count(*) >= 3),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, f) AS k FROM c)
        SELECT doc_id, line, times, instr(substr(text, instr(text, line) + length(line)), line) + instr(text, line) + length(line) - 2 AS second_at FROM b WHERE k = 1""",
    "invented_words": f"""WITH {PAIRS}, {_BALANCE} SELECT doc_id, sum(extra)::BIGINT AS n, array_to_string(list(word ORDER BY first_at)[1:8], ', ') AS sample FROM balance WHERE extra > 0 GROUP BY doc_id""",
    "lost_words": f"""WITH {PAIRS}, {_BALANCE} SELECT doc_id, sum(lost)::BIGINT AS n, array_to_string(list(word ORDER BY lost DESC, word)[1:8], ', ') AS sample FROM balance WHERE lost > 0 GROUP BY doc_id""",
    "hyphen_joins": f"""WITH pairs AS (SELECT doc_id, regexp_replace(text, '([a-z]{{3}}) ([a-z]{{3}})', '\\1\\2', 'g') AS text, text AS source FROM documents), {_BALANCE},
        cuts AS (SELECT doc_id, word, unnest(range(1, length(word))) AS i FROM balance WHERE extra > 0),
        j AS (SELECT c.doc_id, c.word, c.i FROM cuts c JOIN balance a ON a.doc_id = c.doc_id AND a.word = substr(c.word, 1, c.i) AND a.lost > 0 JOIN balance b ON b.doc_id = c.doc_id AND b.word = substr(c.word, c.i + 1) AND b.lost > 0)
        SELECT doc_id, word, substr(word, 1, min(i)) || '+' || substr(word, min(i) + 1) AS parts FROM j GROUP BY doc_id, word""",
    "invented_numerals": rf"""WITH {PAIRS}, t AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS "at" FROM (SELECT doc_id, regexp_extract_all(text, '{T.NUMBER}') AS l FROM pairs)),
        s AS (SELECT doc_id, value, count(*) AS known FROM (SELECT doc_id, unnest(regexp_extract_all(source, '{T.NUMBER}')) AS value FROM pairs) GROUP BY ALL)
        SELECT doc_id, value, "at" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY "at") AS k FROM t) LEFT JOIN s USING (doc_id, value) WHERE k > coalesce(known, 0)""",
    "retention": rf"""WITH {PAIRS}, r AS (SELECT doc_id, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(source, '[^\p{{L}}\p{{N}}]', '', 'g')), 0) AS ratio FROM pairs)
        SELECT doc_id, round(ratio, 9) AS ratio, CASE WHEN ratio < 0.98 THEN 'retention_low' WHEN ratio > 1.02 THEN 'retention_high' ELSE 'ok' END AS finding FROM r WHERE ratio IS NOT NULL""",
    "removed_words": f"""WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {words_sql('text')} AS l FROM documents))
        SELECT doc_id, count(*) AS n, sum(i)::BIGINT AS places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY i) AS k FROM w) WHERE k > CASE WHEN word IN ('the', 'of') THEN 2 ELSE 0 END GROUP BY doc_id""",
    "shingle_coverage": f"WITH {PAIRS}, {_CELLS_TEXT} SELECT doc_id, count(*) AS n_letters, count(*) FILTER (WHERE hit) AS n_covered FROM cov GROUP BY doc_id",
    "unmatched_runs": f"WITH {PAIRS}, {_CELLS_TEXT}, {_unmatched(25)} SELECT doc_id, cell, start, n::BIGINT AS n FROM runs",
    "missing_text": f"WITH {PAIRS}, {_CELLS_SOURCE}, {_unmatched(60)} SELECT doc_id, cell, start, n::BIGINT AS n FROM runs",
    "invented_passages": f"""WITH {PAIRS}, {_CELLS_TEXT}, {_unmatched(25)}, p AS (SELECT doc_id, letters AS passage, count(*) AS times, min(cell) AS first_cell FROM tcell SEMI JOIN runs USING (doc_id, cell) GROUP BY ALL)
        SELECT doc_id, passage, times, first_cell FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_cell) AS k FROM p) WHERE k <= 60""",
    "word_coverage": f"""WITH {PAIRS}, w AS (SELECT doc_id, {words_sql('text')} AS t, {words_sql('source')} AS s FROM pairs),
        known AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(s) - 1), lambda i: array_to_string(s[i:i + 2], ' '))) AS g FROM w),
        hits AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g, unnest(range(1, len(t) - 1)) AS i FROM w) SEMI JOIN known USING (doc_id, g)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id)
        SELECT doc_id, round(CASE WHEN len(t) < 3 OR len(s) < 3 THEN 1.0 ELSE coalesce(n, 0)::DOUBLE / len(t) END, 9) AS share FROM w LEFT JOIN c USING (doc_id)""",
    "repeated_passages": f"""WITH {PAIRS}, t AS (SELECT doc_id, i - 1 AS cell, {fold_sql('chunk')} AS letters FROM (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, {cells_sql('text')} AS c FROM pairs))),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, letters ORDER BY cell) AS nth, count(*) OVER (PARTITION BY doc_id, letters) AS times FROM t WHERE length(letters) >= 40),
        c AS (SELECT k.*, (length(s) - length(replace(s, letters, ''))) // length(letters) AS in_source FROM k JOIN (SELECT doc_id, {fold_sql('source')} AS s FROM pairs) USING (doc_id) WHERE times > 1)
        SELECT doc_id, cell, times, in_source::BIGINT AS in_source FROM c WHERE in_source > 0 AND nth > in_source""",
    "absent_numbers": rf"""WITH {PAIRS}, r AS (SELECT doc_id, text, array_to_string(list_transform(regexp_extract_all(source, '\d(?:[\d.,/''’ ]*\d)?'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), '|') AS runs FROM pairs),
        v AS (SELECT doc_id, runs, unnest(regexp_extract_all(text, '{T.NUMBER}')) AS value, generate_subscripts(regexp_extract_all(text, '{T.NUMBER}'), 1) - 1 AS "at" FROM r)
        SELECT doc_id, value, "at" FROM v WHERE len(list_filter(string_split_regex(value, '[-/]'), lambda p: regexp_replace(p, '[^0-9]', '', 'g') <> '' AND NOT contains(runs, regexp_replace(p, '[^0-9]', '', 'g')))) > 0""",
    "unfound_rows": f"""WITH {PAIRS}, m AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'zyxw | vutsr | qqpp | a' || chr(10) || 'in | the | of' ELSE text END AS text FROM pairs), {unfound_sql('m')} SELECT doc_id, line, n_cells, n_unfound FROM unf""",
    "spelling_variants": rf"""WITH {PAIRS}, src AS (SELECT doc_id, near, min(i) AS i FROM (SELECT doc_id, {fold_sql('w')} AS near, i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(source, '{T.LETTERS}') AS l FROM pairs))) WHERE length(near) >= 4 GROUP BY ALL),
        folded AS MATERIALIZED (SELECT doc_id, {fold_sql('source')} AS s, regexp_extract_all(text, '{T.LETTERS}') AS ws FROM pairs),
        own AS MATERIALIZED (SELECT DISTINCT doc_id, {fold_sql('w')} AS word FROM (SELECT doc_id, unnest(ws) AS w FROM folded)),
        mine AS (SELECT doc_id, word FROM own JOIN folded USING (doc_id) WHERE length(word) >= 4 AND NOT contains(s, word)),
        a AS (SELECT DISTINCT doc_id, word, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS d FROM mine),
        b AS (SELECT DISTINCT doc_id, near, i, unnest(list_concat([near], list_transform(range(1, length(near) + 1), lambda i: substr(near, 1, i - 1) || substr(near, i + 1)))) AS d FROM src)
        SELECT doc_id, word, arg_min(near, i) AS near FROM a JOIN b USING (doc_id, d) GROUP BY doc_id, word""",
    "set_aside": f"""WITH {LAYOUT}, l AS (SELECT *, (bottom - top) <= 2.5 * (x1 - x0) AS flat FROM layout WHERE text NOT LIKE 'Report %' AND text NOT LIKE '- %'),
        p AS (SELECT *, quantile_cont(CASE WHEN flat THEN size END, 0.5) OVER w AS mid, sum(flat::INT) OVER w AS nf FROM l WINDOW w AS (PARTITION BY doc_id, page)),
        q AS (SELECT *, max(CASE WHEN flat AND size >= 0.9 * mid THEN bottom END) OVER (PARTITION BY doc_id, page) AS ln FROM p),
        r AS (SELECT doc_id, page, line, CASE WHEN NOT flat THEN 'margin' WHEN flat AND nf >= 4 AND size < 0.9 * mid AND top >= ln AND top > page_height / 2 THEN 'footnote' END AS reason FROM q) SELECT * FROM r WHERE reason IS NOT NULL""",
    "anchors": f"""WITH {PAIRS}, w AS (SELECT doc_id, {words_sql('text')} AS t, {words_sql('source')} AS s FROM pairs), {_anchored(5)}, {_anchored(3)},
        n5 AS (SELECT doc_id, count(*) AS n FROM a5 GROUP BY doc_id), n3 AS (SELECT doc_id, count(*) AS n FROM a3 GROUP BY doc_id),
        pick AS (SELECT doc_id, coalesce(n5.n, 0) >= 0.3 * len(t) OR coalesce(n3.n, 0) <= coalesce(n5.n, 0) AS five FROM w LEFT JOIN n5 USING (doc_id) LEFT JOIN n3 USING (doc_id)),
        a AS (SELECT a5.* FROM a5 JOIN pick USING (doc_id) WHERE five UNION ALL SELECT a3.* FROM a3 JOIN pick USING (doc_id) WHERE NOT five)
        SELECT doc_id, count(*) AS n, sum("at")::BIGINT AS places, sum(source_at)::BIGINT AS source_places FROM a GROUP BY doc_id""",
    "line_pages": f"""WITH {LAYOUT}, v AS (SELECT doc_id, line // 5 AS line, page, count(*) AS n FROM layout WHERE line % 4 <> 0 GROUP BY ALL),
        b AS (SELECT doc_id, line, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n DESC, page) AS k FROM v) WHERE k = 1),
        l AS (SELECT DISTINCT doc_id, line // 5 AS line FROM layout)
        SELECT doc_id, line, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 1) AS page FROM l LEFT JOIN b USING (doc_id, line)""",
    "finding_pages": """WITH b AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        o AS (SELECT doc_id, block, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS n FROM b),
        sp AS (SELECT doc_id, block // 8 + 1 AS page, s, s + n AS e FROM o WHERE block % 3 <> 1),
        pt AS (SELECT doc_id, unnest(range(0, length(text) + 1, 97)) AS pos FROM documents),
        x AS (SELECT p.doc_id, p.pos, coalesce((SELECT arg_min(page, s * 100000 + page) FROM sp WHERE sp.doc_id = p.doc_id AND p.pos >= s AND p.pos < e), (SELECT arg_max(page, s * 100000 + page) FROM sp WHERE sp.doc_id = p.doc_id AND s <= p.pos)) AS page FROM pt p)
        SELECT doc_id, count(*) AS n, sum(page)::BIGINT AS pages, sum(pos * coalesce(page, 0))::BIGINT AS mix FROM x GROUP BY doc_id""",
    "region_boxes": f"""WITH {LAYOUT}, r AS (SELECT doc_id, unnest(range(0, length(text) + 1, 500)) AS range_id FROM documents)
        SELECT r.doc_id, range_id, page, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM r JOIN layout l ON l.doc_id = r.doc_id AND line * 40 < range_id + 130 AND line * 40 + 38 > range_id GROUP BY ALL""",
    "page_ranges": f"""WITH {LAYOUT}, p AS (SELECT DISTINCT doc_id, page FROM layout WHERE page % 5 <> 3), g AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p) GROUP BY doc_id, g)
        SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM g GROUP BY doc_id""",
    "block_offsets": """WITH b AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        o AS (SELECT doc_id, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS n FROM b)
        SELECT doc_id, max(s + n)::BIGINT AS n, sum(s)::BIGINT AS starts FROM o GROUP BY doc_id""",
    "gutter": f"""WITH {WORDS}, r AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, page, row ORDER BY x0, x1) AS nx, count(*) OVER (PARTITION BY doc_id, page, row) AS k FROM words),
        st AS (SELECT doc_id, page, count(*) AS nw, count(DISTINCT CASE WHEN k >= 2 THEN row END) AS nr, median(CASE WHEN k >= 2 AND nx > x1 THEN nx - x1 END) AS unit, min(x0) AS lo, max(x1) AS hi FROM r GROUP BY ALL HAVING nw >= 40 AND nr >= 6),
        o AS (SELECT doc_id, page, row, min(x1) AS a, min(nx) AS b FROM r JOIN st USING (doc_id, page) WHERE nx - x1 >= greatest(8.0, 2.5 * coalesce(unit, 3.0)) GROUP BY ALL HAVING count(*) = 1),
        e AS (SELECT doc_id, page, a AS x, 1 AS d FROM o UNION ALL SELECT doc_id, page, b, -1 FROM o),
        s AS (SELECT *, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS cur, coalesce(lead(x) OVER w, x) AS nxt FROM e WINDOW w AS (PARTITION BY doc_id, page ORDER BY x, d)),
        b AS (SELECT doc_id, page, cur, x, nxt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cur DESC, x, nxt DESC) AS k FROM s WHERE d = 1) WHERE k = 1),
        m AS (SELECT doc_id, page, (x + nxt) / 2 AS gutter, nw FROM b JOIN st USING (doc_id, page) WHERE cur >= greatest(3, floor(0.45 * nr)) AND ((x + nxt) / 2 - lo) / greatest(hi - lo, 1.0) BETWEEN 0.3 AND 0.7)
        SELECT doc_id, page, round(gutter, 9) AS gutter FROM m JOIN words USING (doc_id, page) GROUP BY doc_id, page, gutter, nw HAVING count(*) FILTER (WHERE x1 <= gutter) >= 0.2 * nw AND count(*) FILTER (WHERE x0 >= gutter) >= 0.2 * nw""",
    "reading_order": f"""WITH {LAYOUT}, c AS (SELECT *, CASE WHEN line % 7 = 0 THEN -1 ELSE line % 2 END AS col FROM layout),
        b AS (SELECT *, (SELECT count(*) FROM c s WHERE s.doc_id = c.doc_id AND s.page = c.page AND s.col = -1 AND s.top <= CASE WHEN c.col = -1 THEN c.top ELSE (c.top + c.bottom) / 2 END) AS band FROM c)
        SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, col, top, x0, line) AS ord FROM b""",
    "headings": f"WITH {LAYOUT}, {_HEADINGS} SELECT doc_id, page, line FROM headed WHERE heading",
    "line_breaks": f"""WITH {LAYOUT}, {_HEADINGS}, s AS (SELECT *, top - lag(top) OVER w AS step, top - lag(bottom) OVER w AS gap, lag(x0) OVER w AS p0, lag(line) OVER w AS pl, lag(size) OVER w AS ps, lag(heading) OVER w AS ph, lag(x1) OVER w AS px, lag(text) OVER w AS pt, greatest("right" - "left", 1.0) AS span FROM headed WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
        q AS (SELECT doc_id, page, coalesce(median(CASE WHEN step > 0 AND step < 40 THEN step END), 12.0) AS pitch FROM s GROUP BY ALL),
        b AS (SELECT doc_id, page, line, coalesce(pl IS NULL OR step > 1.45 * pitch OR gap > 8.5 OR abs(size - ps) > 1.0 OR heading OR ph OR regexp_matches(text, '{_BULLET}') OR (x0 > p0 + greatest(0.018 * span, 3.0) AND px > "right" - 0.05 * span) OR px < "right" - 0.28 * span OR (px < "right" - 0.1 * span AND regexp_matches(pt, '{_TERMINAL}')), true)::INT AS b FROM s JOIN q USING (doc_id, page))
        SELECT doc_id, page, line, sum(b) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS para FROM b""",
    "running_heads": f"WITH {LAYOUT}, {_HEADS} SELECT doc_id, sig, n_pages FROM heads",
    "stripped_heads": rf"""WITH {LAYOUT}, {_HEADS}, g AS (SELECT s.doc_id, s.text FROM sigs s LEFT JOIN heads h ON h.doc_id = s.doc_id AND h.sig = s.sig
        WHERE (h.sig IS NOT NULL AND size <= 10.5) OR ({_EDGE} AND length(text) <= 24 AND regexp_matches(text, '(?i)^[\s\[\(\-–—]*(?:(?:page|p|pp|pag|pág|seite|str)\.?\s*)?(?:\d{{1,4}}|[ivxlcdm]+)(?:\s*(?:/|\||of|de|sur|von|out\s+of)\s*(?:\d{{1,4}}|[ivxlcdm]+))?[\s\]\)\-–—\.]*$')))
        SELECT doc_id, count(*) AS n_dropped, sum(length(regexp_replace(text, '\s+', '', 'g')))::BIGINT AS chars, sum(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')))::BIGINT AS alnum FROM g GROUP BY doc_id""",
    "page_joins": rf"""WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
        b AS (SELECT doc_id, n // 30 AS block, n // 30 // 2 + 1 AS page, array_to_string(list(w ORDER BY n), ' ') AS text FROM w GROUP BY ALL),
        j AS (SELECT *, lag(text) OVER o AS pt, lag(page) OVER o AS pp FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY block)),
        f AS (SELECT *, CASE WHEN coalesce(page <> pp AND NOT regexp_matches(pt, '{_TERMINAL}') AND NOT regexp_matches(text, '{_BULLET}') AND (regexp_matches(text, '{_LOWER}') OR regexp_matches(pt, '[-‐‑]$')), false) THEN 0 ELSE 1 END AS fresh FROM j),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS g FROM f)
        SELECT doc_id, min(block) AS block, array_to_string(list(text ORDER BY block), ' ') AS text FROM g GROUP BY doc_id, g""",
    "assembled": r"""WITH b AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list(t ORDER BY i), chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') || chr(10) AS text FROM b WHERE trim(t, ' ') <> '' GROUP BY doc_id)
        SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM a""",
    "words_outside_tables": f"""WITH {WORDS} SELECT doc_id, page, count(*) AS n FROM (SELECT *, 72.0 + 13.0 * (row % 20) AS top, 82.0 + 13.0 * (row % 20) AS bottom FROM words)
        WHERE NOT (page % 2 = 1 AND x0 >= 99 AND x1 <= 301 AND top >= 89 AND bottom <= 161) GROUP BY ALL""",
    "visual_rows": f"WITH {WORDS} SELECT doc_id, page, count(DISTINCT row) AS rows FROM words GROUP BY ALL",
    "table_columns": f"""WITH {WORDS}, f AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, row) <= 6 THEN 0 ELSE 1 END AS f FROM words),
        g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY x0, row ROWS UNBOUNDED PRECEDING) AS g FROM f), c AS (SELECT doc_id, page, g, avg(x0) AS c FROM g GROUP BY ALL), l AS (SELECT doc_id, page, list(c ORDER BY g) AS cs FROM c GROUP BY ALL),
        n AS (SELECT doc_id, page, row, len(cs) AS k, list_position(list_transform(cs, lambda c: abs(c - x0)), list_min(list_transform(cs, lambda c: abs(c - x0)))) - 1 AS col FROM g JOIN l USING (doc_id, page))
        SELECT doc_id, page AS seg, row, max(k) AS n_columns, array_to_string(list(col ORDER BY col), ' ') AS cols FROM n GROUP BY ALL""",
    "dominant_angles": f"""WITH {WORDS}, a AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN 90 WHEN word % 5 = 0 THEN 0 ELSE 0 END AS angle FROM words),
        x AS (SELECT doc_id, page, round_even(degrees(atan2(CASE WHEN page % 3 = 0 THEN 1.0 WHEN word % 5 = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN page % 3 = 0 THEN 0.0 ELSE 1.0 END)) / 90, 0)::BIGINT * 90 % 360 AS angle FROM words),
        c AS (SELECT doc_id, page, angle, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT doc_id, page, arg_max(angle, n) AS angle, max(n) AS n, sum(n) AS s FROM c GROUP BY ALL)
        SELECT doc_id, page, angle FROM t WHERE n > 0.5 * s AND angle <> 0""",
    "pdf_risk": f"""WITH {LAYOUT}, p AS (SELECT doc_id, page, sum(length(text)) AS c, count(*) FILTER (WHERE size < 9) AS small, count(*) FILTER (WHERE bold) AS rul, count(DISTINCT x0) AS edges FROM layout GROUP BY ALL),
        q AS (SELECT doc_id, CASE WHEN page % 4 = 0 THEN 0 ELSE c END AS c, small, rul, edges, CASE WHEN page % 5 = 0 THEN 800.0::DOUBLE ELSE 600.0::DOUBLE END AS w, page % 6 = 0 AS rot, CASE WHEN doc_id % 3 = 0 THEN 150 ELSE 300 END AS dpi FROM p),
        s AS (SELECT doc_id, count(*) FILTER (WHERE c < 20)::DOUBLE / count(*) AS nt, coalesce(sum(small)::DOUBLE / nullif(sum(c), 0), 0) AS sm, count(*) FILTER (WHERE rot)::DOUBLE / count(*) AS ro, count(*) FILTER (WHERE w > 700)::DOUBLE / count(*) AS la,
          least(1.0::DOUBLE, sum(rul)::DOUBLE / count(*) / 20 * 0.6::DOUBLE + sum(edges)::DOUBLE / count(*) / 25 * 0.4::DOUBLE) AS td, least(1.0::DOUBLE, coalesce(sum(c)::DOUBLE / sum(w * 700 / 5184), 0) / 400) AS xd, count(*) FILTER (WHERE dpi < 200)::DOUBLE / count(*) AS ld FROM q GROUP BY doc_id),
        g AS (SELECT *, (1.5::DOUBLE * least(1.0, sm) + 1.5::DOUBLE * ro + 0.8::DOUBLE * la + 1.2::DOUBLE * td + 0.8::DOUBLE * xd + 1.5::DOUBLE * ld) AS acc FROM s)
        SELECT doc_id, round((2.0::DOUBLE * nt + acc) / 9.9::DOUBLE, 9) AS susceptibility, round(acc / 7.9::DOUBLE, 9) AS geometry_risk, CASE WHEN nt <= 0.5 THEN 'diff_vs_text_layer' WHEN acc / 7.9 >= 0.2 THEN 'self_consistency' ELSE 'intrinsic_only' END AS recommended_check FROM g""",
    "lang_markers": f"""WITH marks AS (SELECT * FROM (VALUES {_MARKS}) t(code, word)), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zAà-öø-ÿ'']+')) AS word FROM documents),
        n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id HAVING count(*) >= 25), h AS (SELECT doc_id, code, count(*) AS c FROM w JOIN marks USING (word) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER o AS k, lead(c) OVER o AS nx FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY c DESC, code)),
        s AS (SELECT n.doc_id, code, coalesce(c, 0)::DOUBLE / n AS share, coalesce(nx, 0)::DOUBLE / n AS second FROM n LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (doc_id))
        SELECT doc_id, CASE WHEN share >= 0.02 AND share >= 1.6::DOUBLE * second THEN code END AS code, round(share, 9) AS share FROM s""",
    "layer_judge": f"""WITH {LAYOUT}, p AS (SELECT doc_id, page, n * 9 AS c, CASE WHEN doc_id % 3 = 0 THEN n WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS l FROM (SELECT doc_id, page, count(*) AS n FROM layout GROUP BY ALL)),
        u AS (SELECT doc_id, page, sum(c) OVER (o ROWS UNBOUNDED PRECEDING) AS c, sum(l) OVER (o ROWS UNBOUNDED PRECEDING) AS l, row_number() OVER o AS n, lead(page) OVER o IS NULL AS last FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page)),
        e AS (SELECT *, l::DOUBLE / c AS share, c >= 150 OR n >= 3 AS enough FROM u),
        v AS (SELECT doc_id, page, CASE WHEN enough AND share >= 0.04 THEN 'poor' WHEN enough AND (share < 0.02 OR n >= 6) THEN 'sound' WHEN last AND (enough OR c >= 30) AND share >= 0.04 THEN 'poor' WHEN last AND (enough OR c >= 30) THEN 'sound' END AS vd FROM e)
        SELECT doc_id, coalesce(arg_min(vd, page) FILTER (WHERE vd IS NOT NULL), 'undecided') AS verdict, min(page) FILTER (WHERE vd IS NOT NULL) AS at_page FROM v GROUP BY doc_id""",
    "ocr_mass": f"""WITH {WORDS}, p AS (SELECT doc_id, page, k AS pass, 50.0::DOUBLE + (word * 7 + doc_id * k) % 50 AS conf FROM words, (VALUES (1), (2)) t(k) WHERE k = 1 OR word % 4 <> 0),
        s AS (SELECT doc_id, page, pass, sum(conf) AS mass, avg(conf) AS mean FROM p GROUP BY ALL), q AS (SELECT *, bool_or(pass = 1 AND mean >= 75) OVER (PARTITION BY doc_id, page) AS sure FROM s)
        SELECT doc_id, page, pass::BIGINT AS pass, mass FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY mass DESC, pass) AS k FROM q WHERE NOT sure OR pass = 1) WHERE k = 1""",
    "needs_ocr": rf"WITH {LAYOUT}, p AS (SELECT doc_id, page, sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')))::BIGINT AS n_letters FROM layout GROUP BY ALL) SELECT * FROM p WHERE n_letters < 20",
    "strip_html": r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '(?i)</?(?:br|sup|sub|b|i|u|em|strong|span|div|p|font|small|big|code|pre|table|thead|tbody|tr|td|th|ul|ol|li|a|img|hr|h[1-6])(?:[^A-Za-z0-9_>][^>]*)?>', '', 'g') AS text FROM pages""",
    "vocabulary": f"WITH {_VOCAB} SELECT word, count(DISTINCT doc_id) AS n_documents FROM wd GROUP BY word",
    "suspicious": f"WITH {_SUSPICIOUS} SELECT doc_id, word FROM susp",
    "unexpected_words": f"WITH {_SUSPICIOUS} SELECT doc_id, count(*) AS n, array_to_string(list(word ORDER BY word)[1:8], ', ') AS sample FROM susp GROUP BY doc_id HAVING count(*) >= 3",
    "all_verdicts": f"WITH {_FOUND} {_all('found')}",
    "visible_verdicts": f"WITH {_FOUND}, {_HIDDEN}, seen AS (SELECT * FROM found ANTI JOIN hidden USING (kind)) {_all('seen')}",
    "hidden_verdicts": f"""WITH {_FOUND}, {_HIDDEN}, rest AS (SELECT * FROM found ANTI JOIN hidden USING (kind)), v AS ({_verdicts('rest')}), t AS (SELECT DISTINCT doc_id FROM found SEMI JOIN hidden USING (kind))
        SELECT d.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN coalesce(v.verdict, 'ok') WHEN d.doc_id % 2 = 0 THEN 'reject' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)""",
    "worst_by_kind": f"""WITH {_FOUND}, f AS (SELECT * FROM found UNION ALL SELECT doc_id, kind, CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'low' END FROM found)
        SELECT doc_id, kind, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity FROM f GROUP BY ALL""",
    "cache_hits": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS hit FROM documents",
    "latest_decisions": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "moved_folders": """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id % 9 <> 0 OR source = 'src3') AS m FROM documents GROUP BY source)
        SELECT 'old/' || source AS old, 'new/' || source AS "new", round(m::DOUBLE / n + 0.01::DOUBLE, 9) AS share FROM s WHERE m::DOUBLE / n >= 0.8""",
    "summary": f"WITH {_SUMMARY} SELECT doc_id, tool_verdict, problems, decision, reviewer, decision_rank::BIGINT AS decision_rank, verdict_rank::BIGINT AS verdict_rank FROM summ",
    "summary_counts": f"""WITH {_SUMMARY}, p AS (SELECT 'files' AS what, '' AS value FROM summ UNION ALL SELECT 'decided', '' FROM summ WHERE decision <> '' UNION ALL SELECT 'overruled', '' FROM summ WHERE decision <> '' AND (tool_verdict = 'ok') <> (decision = 'accepted')
        UNION ALL SELECT 'by_decision', decision FROM summ WHERE decision <> '' UNION ALL SELECT 'by_verdict', CASE WHEN tool_verdict = '' THEN 'unknown' ELSE tool_verdict END FROM summ UNION ALL SELECT 'reviewers', reviewer FROM summ WHERE reviewer <> ''
        UNION ALL SELECT 'by_problem', k FROM (SELECT unnest(string_split(problems, ', ')) AS k FROM summ) WHERE k <> '') SELECT what, value, count(*) AS n FROM p GROUP BY ALL""",
    "review_queue": f"WITH {_SUMMARY} SELECT doc_id, tool_verdict, problems FROM summ WHERE decision = '' ORDER BY verdict_rank, doc_id LIMIT 100",
    "with_problem": f"WITH {_SUMMARY} SELECT doc_id, tool_verdict FROM summ WHERE list_contains(string_split(problems, ', '), 'dropped_words')",
    "quality_gate": f"""WITH {_FOUND}, c AS (SELECT doc_id, bool_or(severity = 'high') AS h, count(*) AS n FROM found GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN coalesce(h, false) OR d.doc_id % 8 >= 6 THEN 'reject' WHEN n > 0 OR d.doc_id % 8 >= 3 THEN 'review' ELSE 'ok' END AS verdict, coalesce(n, 0) AS n_findings, (d.doc_id % 8)::DOUBLE AS risk_score FROM documents d LEFT JOIN c USING (doc_id)""",
    "recognition_findings": f"""WITH {LAYOUT}, p AS (SELECT DISTINCT doc_id, page FROM layout), b AS (SELECT doc_id, count(*) FILTER (WHERE doc_id % 5 <> 0 AND page % 4 = 0) AS m, count(*) FILTER (WHERE doc_id % 5 = 0) AS l FROM p GROUP BY doc_id)
        SELECT doc_id, 'model_pages' AS kind, 'high' AS severity FROM b WHERE m > 0 UNION ALL SELECT doc_id, 'ocr_confidence', 'medium' FROM b WHERE doc_id % 5 <> 0 AND doc_id % 4 < 2 UNION ALL SELECT doc_id, 'no_text_layer', 'high' FROM b WHERE l = 0""",
    "scan_route": """SELECT doc_id, CASE WHEN floor(length(text) * (doc_id % 10) / 10.0)::DOUBLE / nullif(length(text), 0) < 0.6 THEN 'scan_mismatch' ELSE 'compare' END AS route FROM documents""",
    "demoted": f"""WITH {LAYOUT}, p AS (SELECT DISTINCT doc_id, page FROM layout) SELECT doc_id, page, 'not_in_scan' AS kind, CASE WHEN page % 2 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'low' END WHEN doc_id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM p""",
    "sideways_pages": f"""WITH {LAYOUT}, s AS (SELECT doc_id, page, min(line) AS first_line, max(line) AS last_line FROM layout GROUP BY ALL HAVING NOT bool_or(page % 3 <> 0 AND line % 2 = 0))
        SELECT doc_id, page, first_line, last_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM s) WHERE k <= 60""",
    "retention_stats": rf"""WITH {LAYOUT}, x AS (SELECT doc_id, line, length(regexp_replace(text, '\s+', '', 'g')) AS c, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS a FROM layout)
        SELECT doc_id, round(least(1.0::DOUBLE, sum(CASE WHEN line % 5 <> 0 OR line % 10 = 0 THEN c ELSE 0 END)::DOUBLE / nullif(sum(c), 0)), 9) AS kept_ratio, round(sum(CASE WHEN line % 5 <> 0 OR line % 10 = 0 THEN a ELSE 0 END)::DOUBLE / nullif(sum(a), 0), 9) AS alnum_ratio FROM x GROUP BY doc_id""",
}
