"""Registered queries of the document check, its findings' places, and what lists and summaries show of it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import catalogue, unicode
from ..functions import text as T
from ..operators import check, contain, detect, fidelity, lexicon, metrics, places, report, scoring, verdicts
from . import inputs, oracles
from .inputs import LAYOUT, PAIRS, fold_sql, words_sql
from .oracles import ORACLES
from .pages import _with
from .queries import _rounded, query

# text functions


@_with(r"""WITH m AS (SELECT doc_id, replace(text, chr(10), ' ' || chr(13) || chr(10)) || ' ﬁn so­ft e' || chr(769) AS text FROM documents),
    c AS (SELECT doc_id, replace(replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), 'ﬁ', 'fi'), chr(173), '') AS t FROM m)
    SELECT doc_id, sha256(nfc_normalize(trim(regexp_replace(t, '[ \t]+', ' ', 'g'), ' '))) AS digest FROM c""")
def flat_references(spark, d):
    made = inputs.documents(spark, d).select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.lit(" ﬁn so­ft é")).alias("text"))
    clean = unicode.normalised(made.select("doc_id", T.flat_reference(F.col("text")).alias("text")))
    return clean.select("doc_id", F.sha2("text", 256).alias("digest"))


@_with(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([a-z]{3})([a-z]{3})', '\1-' || chr(10) || '\2', 'g'), '([\p{L}\p{N}_])[-‐‑]\s+([a-zà-öø-ÿ])', '\1\2', 'g')) AS digest FROM documents")
def dehyphenated(spark, d):
    made = F.regexp_replace("text", "([a-z]{3})([a-z]{3})", "$1-\n$2")
    return inputs.documents(spark, d).select("doc_id", F.sha2(T.dehyphenated(made), 256).alias("digest"))


@_with("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'e' || chr(769)) WHEN doc_id % 3 = 1 THEN text || chr(8491) || chr(8486) || chr(4370) || chr(4449) || chr(63744) ELSE text END AS text FROM documents)")
def composed_texts(spark, d):
    k = F.col("doc_id") % 3
    made = F.when(k == 0, F.replace("text", F.lit("e"), F.lit("é"))).when(k == 1, F.concat("text", F.lit("ÅΩ하豈"))).otherwise(F.col("text"))
    return unicode.normalised(inputs.documents(spark, d).withColumn("text", made)).select("doc_id", F.sha2("text", 256).alias("digest"))


@_with("SELECT doc_id, sha256(replace(lower(nfc_normalize(replace(replace(text, 'e', 'e´'), '´', chr(769)))), 'ß', 'ss')) AS digest FROM documents")
def composed_marks(spark, d):
    return inputs.documents(spark, d).select("doc_id", F.sha2(unicode.composed_marks(F.replace("text", F.lit("e"), F.lit("e´"))), 256).alias("digest"))


@_with("SELECT doc_id, sha256(strip_accents(translate(text, '“”„‘’–—…€½', ''))) AS digest FROM documents")
def unaccented(spark, d):
    return inputs.documents(spark, d).select("doc_id", F.sha2(unicode.stripped(F.translate("text", "“”„‘’–—…€½", "")), 256).alias("digest"))


@_with("SELECT doc_id, format('{:,}', doc_id * 977) || ' letters that the source doesn''t have: ' || left(text, 5) AS english, 'il manque ' || replace(format('{:,}', doc_id * 977), ',', chr(160)) || ' lettres de la source' AS french, 'no such key' AS unknown FROM documents")
def rendered_findings(spark, d):
    params = {"n": F.col("doc_id") * 977, "sample": F.left("text", F.lit(5))}
    return inputs.documents(spark, d).select("doc_id", catalogue.rendered("invented_text", params).alias("english"), catalogue.rendered("missing_from_text", params, "fr").alias("french"), catalogue.rendered("no such key", params).alias("unknown"))


# metrics


@_with(rf"""SELECT doc_id, lang, CASE WHEN length(t) >= 200 THEN round(CASE WHEN len(p) = 0 THEN 0 ELSE len(list_filter(p, lambda w: NOT regexp_matches(translate(lower(w), '{T.ACCENTED}', '{T.PLAIN}'), '[aeiouy]')))::DOUBLE / len(p) END, 9) END AS vowelless_ratio,
    CASE WHEN length(t) >= 200 THEN round(length(t)::DOUBLE / nullif(doc_id % 4, 0), 9) END AS chars_per_page
    FROM (SELECT doc_id, lang, t, list_filter(regexp_extract_all(array_to_string(list_filter({inputs.lines_sql('t')}, lambda x: NOT regexp_matches(x, '{T.TABULAR}')), chr(10)), '{T.LETTERS}'), lambda w: length(w) >= 4) AS p FROM (SELECT doc_id, lang, nfc_normalize(text) AS t FROM documents))""")
def vowelless_by_language(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 4).alias("pages"))
    rows = metrics.text_metrics(docs, language_column="lang", pages_column="pages")
    return _rounded(rows.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "vowelless_ratio", "chars_per_page"))


@_with(f"SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 0 THEN 'error' ELSE a.verdict END AS verdict FROM documents d LEFT JOIN ({ORACLES['audit_triage'].replace('FROM documents)', 'FROM documents WHERE doc_id % 50 <> 0)')}) a USING (doc_id)")
def audit_with_errors(spark, d):
    docs = inputs.documents(spark, d)
    errors = docs.filter("doc_id % 50 = 0").select("doc_id", F.lit("unreadable").alias("error"))
    return scoring.audit(metrics.text_metrics(docs), detect.scramble_scan(docs), errors).select("doc_id", "verdict")


@query
def audit_complete(spark, d):
    """The audit on all metrics, compression and characters per page too."""
    docs = inputs.documents(spark, d).withColumn("pages", F.floor(F.size(F.split("text", "\n")) / 8) + 1)
    rows = scoring.audit(metrics.text_metrics(docs, pages_column="pages", compressed=True), detect.scramble_scan(docs))
    return rows.select("doc_id", F.round("risk_score", 3).alias("risk_score"), "n_metrics_used", "risk_reasons", "verdict")


# places of damage

_DAMAGED = """dam AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || ' so p' || chr(1072) || 'ypal and g' || chr(1086) || 'od' WHEN 1 THEN text || ' cafÃ© it' WHEN 2 THEN substr(text, 1, 30) || chr(1) || substr(text, 31) WHEN 3 THEN text || chr(10) || 't h e  t e x t' || chr(10) || 'x'
  WHEN 4 THEN text || chr(10) || 'again this line' || chr(10) || 'again this line' || chr(10) || 'again this line' || chr(10) || 'again this line' WHEN 5 THEN text || ' aBcDeFgH tHeReFoRe' ELSE text || ' ' || substr(text, 1, 400) END AS text FROM documents)"""


def _start_sql(x: str, pattern: str, nth: str) -> str:
    return f"(coalesce(list_sum(list_transform(string_split_regex({x}, '{pattern}')[1:{nth} + 1], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({x}, '{pattern}')[1:{nth}], lambda s: length(s))), 0))"


def _damaged(spark, d):
    k = F.col("doc_id") % 7
    text = F.col("text")
    made = (
        F.when(k == 0, F.concat(text, F.lit(" so pаypal and gоod"))).when(k == 1, F.concat(text, F.lit(" cafÃ© it"))).when(k == 2, F.concat(F.substring(text, 1, 30), F.lit("\x01"), F.substring(text, 31, 1 << 30)))
        .when(k == 3, F.concat(text, F.lit("\nt h e  t e x t\nx"))).when(k == 4, F.concat(text, F.lit("\nagain this line" * 4))).when(k == 5, F.concat(text, F.lit(" aBcDeFgH tHeReFoRe"))).otherwise(F.concat(text, F.lit(" "), F.substring(text, 1, 400)))
    )
    return inputs.documents(spark, d).withColumn("text", made)


_CHANGES = "list_sum(list_transform(range(1, length(w)), lambda i: (regexp_matches(w[i], '[A-Z]') <> regexp_matches(w[i + 1], '[A-Z]'))::INT))"


@_with(
    rf"""WITH {_DAMAGED}, b AS MATERIALIZED (SELECT doc_id, text, array_to_string(list_filter({inputs.lines_sql('text')}, lambda x: NOT regexp_matches(x, '{T.TABULAR}')), chr(10)) AS prose FROM dam),
    t AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{T.LETTERS}') AS letters, regexp_extract_all(prose, '{T.LETTERS}') AS plain, regexp_extract_all(text, '{T.WORDS}') AS words, list_filter(list_transform(string_split(prose, chr(10)), lambda x: trim(x, ' ')), lambda x: length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) > 3) AS ll FROM b),
    ln AS (SELECT doc_id, line, n FROM (SELECT doc_id, line, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS k FROM (SELECT doc_id, unnest(ll) AS line, generate_subscripts(ll, 1) AS i FROM t) GROUP BY doc_id, line) WHERE k = 1 AND n >= 3),
    lp AS (SELECT doc_id, line, n, instr(text, line) + length(line) AS after, instr(substr(text, instr(text, line) + length(line)), line) AS nx FROM ln JOIN t USING (doc_id)),
    loop1 AS (SELECT doc_id, (after + nx - 2)::BIGINT AS s, length(line) AS len, n FROM lp WHERE nx > 0),
    gr AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(list_transform(words[i:i + 7], lambda w: replace(lower(w), 'ß', 'ss')), ' '))) AS g, unnest(range(1, len(words) - 6)) - 1 AS i FROM t WHERE len(words) >= 16),
    gc AS (SELECT doc_id, n, sec FROM (SELECT doc_id, g, count(*) AS n, list_sort(list(i))[2] AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS k FROM gr GROUP BY doc_id, g) WHERE k = 1 AND n >= 2),
    loop2 AS (SELECT doc_id, {_start_sql('text', T.WORDS, 'sec')} AS s, {_start_sql('text', T.WORDS, '(sec + 7)')} + length(words[sec + 8]) AS e, n FROM gc JOIN t USING (doc_id) ANTI JOIN loop1 USING (doc_id)),
    mx AS (SELECT doc_id, text, list_filter(list_zip(range(0, len(letters)), letters), lambda z: ({oracles._MIXED.replace('(w,', '(z[2],')}) > 1) AS m FROM t),
    r1 AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, unnest(plain) AS w, generate_subscripts(plain, 1) - 1 AS i FROM t) WHERE length(w) = 1),
    r2 AS (SELECT doc_id, n, f FROM (SELECT doc_id, count(*) AS n, min(i) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS k FROM r1 GROUP BY doc_id, g) WHERE k = 1 AND n > 1),
    r3 AS (SELECT doc_id, n, text, substr(prose, ({_start_sql('prose', T.LETTERS, 'f')} + 1)::BIGINT, ({_start_sql('prose', T.LETTERS, '(f + n - 1)')} + 1 - {_start_sql('prose', T.LETTERS, 'f')})::BIGINT) AS snip FROM r2 JOIN t USING (doc_id)),
    od AS (SELECT doc_id, text, list_filter(regexp_extract_all(prose, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{6,}}') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND {_CHANGES} >= 5 AND {_CHANGES} >= 0.5 * length(w)) AS h FROM t)
    SELECT doc_id, 'repetition_loop' AS kind, s AS char_start, s + len AS char_end, n FROM loop1 UNION ALL SELECT doc_id, 'repetition_loop', s::BIGINT, e::BIGINT, n FROM loop2
    UNION ALL SELECT doc_id, 'mixed_scripts', ({_start_sql('text', T.LETTERS, 'm[1][1]')})::BIGINT, ({_start_sql('text', T.LETTERS, 'm[1][1]')} + length(m[1][2]))::BIGINT, len(m) FROM mx WHERE len(m) > 0
    UNION ALL SELECT doc_id, 'garbled_characters', instr(text, regexp_extract(text, '{T.MOJIBAKE}')) - 1, instr(text, regexp_extract(text, '{T.MOJIBAKE}')) - 1 + length(regexp_extract(text, '{T.MOJIBAKE}')), len(regexp_extract_all(text, '{T.MOJIBAKE}')) FROM t WHERE regexp_matches(text, '{T.MOJIBAKE}')
    UNION ALL SELECT doc_id, 'control_characters', instr(text, regexp_extract(text, '{T.JUNK}')) - 1, instr(text, regexp_extract(text, '{T.JUNK}')), len(regexp_extract_all(text, '{T.JUNK}')) FROM t WHERE regexp_matches(text, '{T.JUNK}')
    UNION ALL SELECT doc_id, 'letter_spacing', instr(text, snip) - 1, instr(text, snip) - 1 + length(snip), n FROM r3 WHERE instr(text, snip) > 0
    UNION ALL SELECT doc_id, 'scrambled_text', instr(text, h[1]) - 1, instr(text, h[1]) - 1 + length(h[1]), len(h) FROM od WHERE len(h) > 0"""
)
def damage_places(spark, d):
    return places.damage_places(_damaged(spark, d)).drop("sample")


@_with("""SELECT doc_id, word, instr(text, word) - 1 AS char_start, instr(text, word) - 1 + length(word) AS char_end FROM documents, (VALUES ('the'), ('de'), ('zzz')) v(word) WHERE instr(text, word) > 0""")
def token_places(spark, d):
    docs = inputs.documents(spark, d)
    words = docs.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("de"), F.lit("zzz"), F.lit("the"))).alias("word"))
    return places.token_places(docs, words)


@_with(f"""WITH x AS ({ORACLES["degenerate_table"]}), m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {oracles._DEG_TEXT} ELSE text END AS text FROM documents),
    r AS (SELECT doc_id, value, text, list_filter({inputs.lines_sql('text')}, lambda l: regexp_matches(l, '{T.TABULAR}') AND (length(l) - length(replace(l, value, ''))) / length(value) >= 2) AS h FROM x JOIN m USING (doc_id)) SELECT doc_id, value, instr(text, h[1]) - 1 AS char_start FROM r""")
def table_places(spark, d):
    made = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\na | 17 | 17\n17 | 17 | 17\n17 | 17 | b\n17 | 17 | 17\n17 | 17 | 17\n17 | 17 | 17"))).otherwise(F.col("text"))
    docs = inputs.documents(spark, d).withColumn("text", made)
    return places.table_places(docs, detect.degenerate_tables(docs))


@_with(rf"""SELECT doc_id, words FROM (SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]), ' ') AS words FROM
    (SELECT doc_id, list_filter(regexp_extract_all(text || ' rhythms brrrr NGRBTX brrrr', '{T.LETTERS}'), lambda w: length(w) >= 5 AND regexp_full_match(w, '[A-Za-z]+') AND NOT regexp_matches(lower(w), '[aeiouy]')) AS w FROM documents)) WHERE words <> ''""")
def vowelless_words(spark, d):
    return places.vowelless_words(inputs.documents(spark, d).withColumn("text", F.concat("text", F.lit(" rhythms brrrr NGRBTX brrrr"))))


@_with(f"WITH {oracles._SUSPICIOUS}, p AS (SELECT doc_id, word, instr(text, word) - 1 AS s FROM susp JOIN documents USING (doc_id)) SELECT doc_id, arg_min(word, lpad(s::VARCHAR, 9, '0') || word) AS word, min(s) AS char_start FROM p WHERE s >= 0 GROUP BY doc_id")
def first_suspicious(spark, d):
    docs = inputs.documents(spark, d)
    return lexicon.first_place(docs, lexicon.suspicious(docs, lexicon.vocabulary(docs, min_documents=2)))


# parts of the check

_UNCOVERED = f"""uw AS (SELECT doc_id, {words_sql('text')} AS t, {words_sql('source')} AS s FROM pairs),
  uk AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(s) - 1), lambda i: array_to_string(s[i:i + 2], ' '))) AS g FROM uw),
  uh AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g, unnest(range(1, len(t) - 1)) AS i FROM uw) SEMI JOIN uk USING (doc_id, g)),
  ub AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS p FROM uw WHERE len(t) >= 3 AND (len(s) >= 3 OR len(s) = 0)) ANTI JOIN uh USING (doc_id, p))"""


@_with(f"WITH {PAIRS}, {_UNCOVERED} SELECT doc_id, min(p) - 1 AS start, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM ub) GROUP BY doc_id, g")
def uncovered_words(spark, d):
    return contain.uncovered_words(inputs.pairs(spark, d), "text", "source")


@_with(f"WITH r AS ({ORACLES['unfound_rows']}), g AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM r) SELECT doc_id, min(line) AS first, max(line) AS last, count(*) AS n FROM g GROUP BY doc_id, g")
def unfound_tables(spark, d):
    made = inputs.pairs(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nzyxw | vutsr | qqpp | a\nin | the | of"))).otherwise(F.col("text")))
    return contain.merged(contain.unfound_rows(made, "text", "source"), "line")


@_with(f"WITH r AS ({ORACLES['repeated_passages']}), g AS (SELECT doc_id, cell, cell - row_number() OVER (PARTITION BY doc_id ORDER BY cell) AS g FROM r) SELECT doc_id, min(cell) AS first, max(cell) AS last, count(*) AS n FROM g GROUP BY doc_id, g")
def duplicated_blocks(spark, d):
    return contain.merged(contain.repeated_passages(inputs.pairs(spark, d), "text", "source"), "cell")


def _cells_of(size: int, text: str, source: str) -> str:
    """The SQL of covered letters for another size of shingle, or other sides."""
    sql = (oracles._CELLS_TEXT if text == "text" else oracles._CELLS_SOURCE).replace("length(letters) - 8", f"length(letters) - {size - 2}").replace("substr(letters, i, 10)", f"substr(letters, i, {size})").replace("p - 10", f"p - {size}")
    return sql


def _runs(size: int, min_run: int, text: str, source: str, names: str) -> str:
    """CTEs with all names suffixed, so that several stand in one query: runs{names} has doc_id, cell, start, n, stop."""
    sql = f"{_cells_of(size, text, source)}, {oracles._unmatched(min_run)}"
    sql = sql.replace("SELECT doc_id, cell, f AS start, m AS n FROM tot", "SELECT doc_id, cell, f AS start, m AS n, x AS stop FROM tot").replace("SELECT g.doc_id, g.cell, g.start, g.c FROM gaps", "SELECT g.doc_id, g.cell, g.start, g.c, g.start + g.c FROM gaps").replace("min(start) AS f FROM gaps", "min(start) AS f, max(start + c) AS x FROM gaps")
    for name in ("tcell", "scell", "known", "hits", "letters AS (", "marks", "cov", "gaps", "tot", "runs", "FROM letters l"):
        if name == "letters AS (":
            sql = sql.replace("letters AS (SELECT doc_id, cell, length", f"lett{names} AS (SELECT doc_id, cell, length")
        elif name == "FROM letters l":
            sql = sql.replace(name, f"FROM lett{names} l")
        else:
            sql = re.sub(rf"\b{name}\b", f"{name}{names}", sql)
    return sql


def _absent(runs: str, misread: bool, where: str) -> str:
    """Absent numbers outside the runs, as a query of doc_id, cell, value."""
    digits = "regexp_replace(q, '[^0-9]', '', 'g')"
    near = f" AND NOT (length({digits}) >= 2 AND len(list_filter(string_split(rr, '|'), lambda r: length(r) = length({digits}) AND len(list_filter(range(1, length(r) + 1), lambda i: substr(r, i, 1) <> substr({digits}, i, 1))) <= 1)) > 0)" if misread else ""
    return rf"""SELECT n.doc_id, n.cell, n.value FROM (SELECT doc_id, cell, rr, value, length({fold_sql('substr(chunk, 1, st)')}) AS a, length({fold_sql('substr(chunk, 1, st)')}) + length({fold_sql('value')}) AS b FROM
      (SELECT doc_id, cell, chunk, rr, v[k + 1] AS value, ({_start_sql('chunk', T.NUMBER, 'k')})::BIGINT AS st FROM (SELECT *, unnest(range(0, len(v))) AS k FROM
        (SELECT doc_id, i - 1 AS cell, chunk, rr, regexp_extract_all(chunk, '{T.NUMBER}') AS v FROM (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) AS i, rr FROM (SELECT doc_id, {inputs.cells_sql('text')} AS c, array_to_string(list_transform(regexp_extract_all(source, '\d(?:[\d.,/''’ ]*\d)?'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), '|') AS rr FROM pairs WHERE {where})))))) n
      WHERE len(list_filter(string_split_regex(value, '[-/]'), lambda q: {digits} <> '' AND NOT contains(rr, {digits}){near})) > 0 AND NOT EXISTS (SELECT 1 FROM {runs} r WHERE r.doc_id = n.doc_id AND r.cell = n.cell AND n.a < r.stop AND n.b > r.start)"""


@_with(f"WITH {PAIRS}, {_runs(10, 25, 'text', 'source', '1')} {_absent('runs1', False, 'true')}")
def numbers_outside_passages(spark, d):
    docs = inputs.pairs(spark, d)
    return contain.absent_in(docs, "text", "source", contain.unmatched(docs, "text", "source"))


@_with(f"WITH pairs AS (SELECT doc_id, regexp_replace(text, '([0-9])([0-9])', '\\1' || (doc_id % 10), 'g') AS text, text AS source FROM documents), none AS (SELECT 0 AS doc_id, 0 AS cell, 0 AS start, 0 AS stop WHERE false) {_absent('none', True, 'true')}")
def misread_numbers(spark, d):
    docs = inputs.documents(spark, d)
    made = docs.select("doc_id", F.regexp_replace(F.col("text"), F.lit("([0-9])([0-9])"), F.concat(F.lit("$1"), (F.col("doc_id") % 10).cast("string"))).alias("text"), F.col("text").alias("source"))
    none = made.limit(0).select("doc_id", *[F.lit(0).alias(c) for c in ("cell", "start", "stop")])
    return contain.absent_in(made, "text", "source", none, misread=True)


def _compared(spark, d):
    """Pairs with a route: of ten documents one without a source, one with too little of it, one badly read, three read from a scan (one of another text)."""
    k = F.col("doc_id") % 10
    docs = inputs.pairs(spark, d)
    source = F.when(k == 0, F.lit(None)).when(k == 1, F.substring("source", 1, 10)).when(k == 4, F.reverse("source")).otherwise(F.col("source"))
    return docs.select("doc_id", "text", source.alias("source"), k.isin(2, 3, 4, 5).alias("recognised"), F.when(k == 2, 0.4).when(k == 3, 0.7).when(k.isin(4, 5), 0.9).alias("conf"))


_ROUTED = rf"""cmp AS MATERIALIZED (SELECT doc_id, text, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN substr(source, 1, 10) WHEN 4 THEN reverse(source) ELSE source END AS source, doc_id % 10 IN (2, 3, 4, 5) AS rec, CASE doc_id % 10 WHEN 2 THEN 0.4 WHEN 3 THEN 0.7 WHEN 4 THEN 0.9 WHEN 5 THEN 0.9 END AS conf FROM pairs0),
  us AS (SELECT *, length(regexp_replace(coalesce(source, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) >= 0.2 * greatest(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')), 1) AS ok FROM cmp),
  nt AS MATERIALIZED (SELECT *, CASE WHEN source IS NULL THEN 'no_source' WHEN rec AND (conf < 0.6 OR NOT ok) THEN 'scan_unreadable' WHEN NOT ok THEN 'scan_unchecked' END AS notice FROM us),
  rt AS MATERIALIZED (SELECT *, CASE WHEN notice IS NOT NULL THEN 'none' WHEN rec THEN 'recognised' ELSE 'text_layer' END AS route FROM nt)"""


@_with(f"WITH {PAIRS.replace('pairs AS', 'pairs0 AS')}, {_ROUTED} SELECT doc_id, route, notice FROM rt")
def check_routes(spark, d):
    return check.routes(_compared(spark, d))


_LOOPS = rf"""lw AS MATERIALIZED (SELECT doc_id, {words_sql('text')} AS w, {fold_sql('source')} AS s FROM cmp WHERE source IS NOT NULL),
  lg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g, unnest(range(1, len(w) - 6)) AS i FROM lw),
  lt AS (SELECT doc_id, g, n FROM (SELECT doc_id, g, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS k FROM lg GROUP BY doc_id, g) WHERE k = 1),
  unloop AS (SELECT doc_id FROM lt JOIN lw USING (doc_id) WHERE {fold_sql('g')} <> '' AND 2 * ((length(s) - length(replace(s, {fold_sql('g')}, ''))) / length({fold_sql('g')})) >= n)"""


@_with(f"WITH {PAIRS.replace('pairs AS', 'pairs0 AS')}, {_ROUTED}, {_LOOPS} SELECT doc_id FROM unloop")
def unlooped(spark, d):
    return check.unlooped(_compared(spark, d))


@_with(rf"""WITH m AS (SELECT doc_id, array_to_string(list_filter({inputs.lines_sql("(text || chr(10) || 'aBcDeFgH tHeReFoRe')")}, lambda x: NOT regexp_matches(x, '{detect.TABLE_ROW}')), chr(10)) AS prose, CASE WHEN doc_id % 2 = 0 THEN text || ' abcdefgh' ELSE text END AS source FROM documents)
    SELECT doc_id, len(list_filter(list_filter(regexp_extract_all(prose, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{6,}}') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND {_CHANGES} >= 5 AND {_CHANGES} >= 0.5 * length(w)), lambda w: NOT contains({fold_sql('source')}, {fold_sql('w')}))) AS n FROM m""")
def unscrambled(spark, d):
    docs = inputs.documents(spark, d)
    source = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" abcdefgh"))).otherwise(F.col("text"))
    return check.unscrambled(docs.select("doc_id", F.concat("text", F.lit("\naBcDeFgH tHeReFoRe")).alias("text"), source.alias("source")))


def _over(name: str, where: str, sql: str) -> str:
    """A registered query's SQL with its pairs read from the routed ones."""
    return f"{name} AS ({sql.replace(PAIRS, f'pairs AS (SELECT doc_id, text, source FROM rt WHERE {where})')})"


_LONG = f"length({fold_sql('source')}) >= 10"
_EXACT, _SCAN = f"route = 'text_layer' AND {_LONG}", f"route = 'recognised' AND length({fold_sql('source')}) >= 8 AND length({fold_sql('text')}) > 0"
_UNFOUND = f"WITH {PAIRS}, {oracles.unfound_sql('pairs')} SELECT doc_id, line FROM unf"
_SCANNED = f"""WITH {PAIRS}, {_runs(8, 40, 'text', 'source', '8')}, tl AS (SELECT doc_id, sum(length(letters)) AS n FROM tcell8 GROUP BY doc_id), gn AS (SELECT doc_id, sum(n) AS g FROM runs8 GROUP BY doc_id)"""

@_with(
    f"""WITH {PAIRS.replace('pairs AS', 'pairs0 AS')}, {_ROUTED}, {_over('iv', _EXACT, ORACLES['unmatched_runs'])}, {_over('ms', _EXACT, ORACLES['missing_text'])}, {_over('uf', _EXACT, _UNFOUND)}, {_over('rp', _EXACT, ORACLES['repeated_passages'])}, {_over('sv', _EXACT, ORACLES['spelling_variants'])},
    {_over('an', _EXACT, f"WITH {PAIRS}, {_runs(10, 25, 'text', 'source', '1')} {_absent('runs1', False, 'true')}")},
    {_over('mm', _SCAN, f"{_SCANNED} SELECT tl.doc_id FROM tl LEFT JOIN gn USING (doc_id) WHERE 1 - coalesce(g, 0)::DOUBLE / n < 0.6")}, {_over('ns', _SCAN, f"{_SCANNED} SELECT doc_id FROM runs8")}, {_over('sm', _SCAN, f"WITH {PAIRS}, {_runs(8, 60, 'source', 'text', '9')} SELECT doc_id FROM runs9")},
    {_over('sn', _SCAN, f"{_SCANNED} {_absent('runs8', True, 'true')}")}
    SELECT DISTINCT doc_id, 'invented_text' AS kind, 'high' AS severity FROM iv UNION SELECT DISTINCT doc_id, 'missing_from_text', 'medium' FROM ms UNION SELECT DISTINCT doc_id, 'unfound_table', 'medium' FROM uf UNION SELECT DISTINCT doc_id, 'duplicated_words', 'medium' FROM rp
    UNION SELECT DISTINCT doc_id, 'spelling_variants', 'low' FROM sv UNION SELECT DISTINCT doc_id, 'invented_numbers', 'high' FROM an UNION SELECT doc_id, 'scan_mismatch', 'high' FROM mm UNION SELECT DISTINCT doc_id, 'not_in_scan', 'high' FROM ns ANTI JOIN mm USING (doc_id)
    UNION SELECT DISTINCT doc_id, 'missing_from_text', 'medium' FROM sm ANTI JOIN mm USING (doc_id) UNION SELECT DISTINCT doc_id, 'invented_numbers', 'medium' FROM sn ANTI JOIN mm USING (doc_id)
    UNION SELECT doc_id, 'scan_unchecked', 'medium' FROM rt WHERE notice = 'scan_unreadable' UNION SELECT doc_id, 'scan_unchecked', 'low' FROM rt WHERE notice = 'scan_unchecked' UNION SELECT doc_id, 'ocr_confidence', 'medium' FROM rt WHERE route = 'recognised' AND conf < 0.75"""
)
def comparison_findings(spark, d):
    """What the comparison with the source adds to the findings of the text alone."""
    docs = _compared(spark, d)
    placed = check.placed(docs)
    parts = [check.exact_findings(placed.filter("route = 'text_layer'")), check.recognised_findings(placed.filter("route = 'recognised'"))]
    found = parts[0].unionByName(parts[1]).select("doc_id", "kind", "severity")
    return found.unionByName(check.route_findings(placed))


@query
def document_check(spark, d):
    """The whole check: findings of the text alone, settled by the source, of the comparison, and of the vocabulary; then the verdict of what a reader looks for."""
    docs = _compared(spark, d)
    found = check.check(docs, lexicon.vocabulary(docs.select("doc_id", "text"), min_documents=2))
    return verdicts.all_verdicts(docs, found, verdicts.hidden_kinds(spark))


@_with(f"SELECT doc_id, verdict, kinds FROM ({oracles._all('cf')}) x".replace("FROM cf", f"FROM ({ORACLES['comparison_findings']})"))
def comparison_verdicts(spark, d):
    return verdicts.all_verdicts(inputs.documents(spark, d), comparison_findings(spark, d))


@query
def word_findings(spark, d):
    return check.word_findings(inputs.pairs(spark, d))


@query
def reconciled_words(spark, d):
    """Words cut in two and three in the source, whole in the text."""
    docs = inputs.documents(spark, d)
    made = docs.select("doc_id", "text", F.regexp_replace("text", "([a-z]{3})([a-z]{3})([a-z]{2})", "$1 $2 $3").alias("source"))
    total = lambda c: F.aggregate("balance", F.lit(0).cast("long"), lambda a, x: a + x[c]).alias(c)
    return fidelity.reconciled(fidelity.balances(made, "text", "source")).filter(F.size("balance") > 0).select("doc_id", *map(total, ("joins", "extra", "lost")))


@query
def passage_places(spark, d):
    docs = inputs.pairs(spark, d)
    return contain.run_places(docs, contain.unmatched(docs, "text", "source"), "text")


@_with("""WITH f AS (SELECT doc_id, kind, severity, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 5 END AS page, s AS char_start FROM documents, (VALUES ('a', 'low', 5), ('b', 'high', 70), ('c', 'medium', NULL), ('d', 'high', 10)) v(kind, severity, s))
    SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, page NULLS LAST, coalesce(char_start, 0), kind) AS ord FROM f""")
def ranked_findings(spark, d):
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(a).cast("int").alias("char_start")) for k, s, a in (("a", "low", 5), ("b", "high", 70), ("c", "medium", None), ("d", "high", 10))])
    found = inputs.documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5).alias("page"), F.explode(rows).alias("f")).select("doc_id", "page", "f.*")
    return check.ranked(found).select("doc_id", "kind", "ord")


@_with(f"""WITH {LAYOUT}, run AS (SELECT DISTINCT doc_id, page AS cell, page * 100 AS a, page * 100 + 80 AS b FROM layout WHERE page % 2 = 1), aside AS (SELECT DISTINCT doc_id, page * 100 AS a, page * 100 + 10 * (page % 7) AS b FROM layout),
    reg AS (SELECT doc_id, line * 12 AS a, line * 12 + 11 AS b, page, x0, top, x1, bottom FROM layout), g AS (SELECT r.doc_id, r.cell, r.a, r.b, sum(greatest(least(r.b, s.b) - greatest(r.a, s.a), 0)) AS gone FROM run r LEFT JOIN aside s ON s.doc_id = r.doc_id GROUP BY ALL),
    k AS (SELECT * FROM g WHERE coalesce(gone, 0) <= 0.5 * (b - a)), h AS (SELECT k.doc_id, k.cell, reg.page, min(x0) AS x0, min(top) AS top FROM k JOIN reg ON reg.doc_id = k.doc_id AND reg.a < k.b AND reg.b > k.a GROUP BY ALL),
    f AS (SELECT doc_id, cell, arg_min(page, page) AS page, arg_min(x0, page) AS x0, arg_min(top, page) AS top FROM h GROUP BY ALL) SELECT k.doc_id, k.cell, page, x0, top FROM k LEFT JOIN f USING (doc_id, cell)""")
def placed_missing(spark, d):
    lines = inputs.layout_lines(spark, d)
    pages = lines.select("doc_id", "page").distinct()
    runs = pages.filter("page % 2 = 1").select("doc_id", F.col("page").alias("cell"))
    cells = runs.select("doc_id", "cell", (F.col("cell") * 100).alias("char_start"), (F.col("cell") * 100 + 80).alias("char_end"))
    aside = pages.select("doc_id", (F.col("page") * 100).alias("char_start"), (F.col("page") * 100 + 10 * (F.col("page") % 7)).alias("char_end"))
    regions = lines.select("doc_id", "page", (F.col("line") * 12).alias("char_start"), (F.col("line") * 12 + 11).alias("char_end"), "x0", "top", "x1", "bottom")
    return check.placed_missing(runs, cells, aside, regions).select("doc_id", "cell", "page", "x0", "top")


# lists and summaries


@_with("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'text_layer' WHEN doc_id % 3 = 0 THEN 'model' WHEN doc_id % 3 = 1 THEN 'recognised' WHEN doc_id % 2 = 0 THEN 'text_layer' ELSE 'none' END AS checked_against FROM documents""")
def checked_against(spark, d):
    i = F.col("doc_id")
    sources = F.when(i % 3 == 0, F.array(F.lit("extracted"), F.lit("recognised_model"))).when(i % 3 == 1, F.array(F.lit("recognised_tesseract"))).when(i % 2 == 0, F.array(F.lit("extracted")))
    return report.checked_against(inputs.documents(spark, d).select("doc_id", F.when(i % 4 == 0, "text_layer").when(i % 8 == 1, "").alias("reference"), sources.alias("sources")))


_STATES = """st AS (SELECT doc_id, doc_id % 13 = 0 AS own, doc_id % 3 = 0 AS r, doc_id % 5 = 0 AS s, doc_id % 2 = 0 AS t, CASE WHEN doc_id % 4 = 0 THEN 'reject' ELSE 'review' END AS rv, CASE doc_id % 6 WHEN 0 THEN ['invented_words'] WHEN 3 THEN ['spelling_variants'] ELSE ['dropped_words', 'unheard_of'] END AS k, CASE doc_id % 6 WHEN 0 THEN 'high' ELSE 'medium' END AS sv FROM documents),
  sh AS (SELECT *, list_filter(k, lambda x: x NOT IN ('spelling_variants', 'dropped_words')) AS vis, len(list_filter(k, lambda x: x IN ('spelling_variants', 'dropped_words'))) > 0 AS hid FROM st),
  vd AS (SELECT *, CASE WHEN len(vis) > 0 AND sv = 'high' THEN 'reject' WHEN len(vis) > 0 THEN 'review' ELSE 'ok' END AS own_v FROM sh),
  stt AS (SELECT doc_id, CASE WHEN r OR s THEN CASE WHEN NOT hid THEN rv ELSE own_v END WHEN t THEN own_v ELSE 'unknown' END AS verdict, own OR r OR s AS analysed, own OR CASE WHEN r THEN doc_id % 9 <> 0 ELSE s AND doc_id % 10 = 0 END AS compared, CASE WHEN r OR s OR t THEN array_to_string(list_sort(vis), ', ') ELSE '' END AS problems FROM vd)"""


def _states(spark, d):
    i = F.col("doc_id")
    entry = lambda *kinds, s: F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.lit(s)] * len(kinds)))
    severities = F.when(i % 6 == 0, entry("invented_words", s="high")).when(i % 6 == 3, entry("spelling_variants", s="medium")).otherwise(entry("dropped_words", "unheard_of", s="medium"))
    files = inputs.documents(spark, d).select("doc_id", (i % 13 == 0).alias("own"), severities.alias("severities"), F.when(i % 4 == 0, "reject").otherwise("review").alias("recorded"))
    records = files.filter("doc_id % 3 = 0").withColumn("reference", F.when(i % 9 != 0, "text_layer"))
    summaries = files.filter("doc_id % 5 = 0").withColumn("compared", i % 10 == 0)
    return report.states(files, records, summaries, files.filter("doc_id % 2 = 0"), ["spelling_variants", "dropped_words"])


@_with(f"WITH {_STATES} SELECT * FROM stt")
def file_states(spark, d):
    return _states(spark, d)


@_with(f"WITH {_STATES}, {inputs.DECISIONS} SELECT doc_id, CASE WHEN coalesce(decision, '') <> '' THEN decision WHEN NOT compared THEN CASE WHEN verdict IN ('reject', 'review') THEN verdict WHEN verdict = 'ok' THEN 'uncompared' ELSE 'unknown' END ELSE verdict END AS mark FROM stt LEFT JOIN decisions USING (doc_id)")
def row_marks(spark, d):
    return report.marks(_states(spark, d).join(inputs.decisions(spark, d), "doc_id", "left"))


@_with(f"""WITH {_STATES}, {inputs.DECISIONS} SELECT doc_id, verdict FROM (SELECT *, CASE WHEN NOT compared AND verdict = 'ok' THEN 'unknown' ELSE verdict END AS v FROM stt LEFT JOIN decisions USING (doc_id))
    ORDER BY coalesce(decision, '') <> '', NOT analysed, CASE v WHEN 'reject' THEN 0 WHEN 'review' THEN 1 WHEN 'ok' THEN 3 ELSE 2 END, doc_id LIMIT 100""")
def reading_queue(spark, d):
    return report.reading_queue(_states(spark, d).join(inputs.decisions(spark, d), "doc_id", "left"), 100).select("doc_id", "verdict")


@_with(f"WITH {oracles._FOUND}, w AS (SELECT doc_id, string_agg(kind, ', ' ORDER BY kind) AS kinds, string_agg(kind || '=' || severity, ', ' ORDER BY kind) AS severities FROM found GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'unknown' END AS verdict, coalesce(kinds, '') AS kinds, coalesce(severities, '') AS severities, doc_id % 3 = 0 AS compared FROM documents LEFT JOIN w USING (doc_id)")
def index_lines(spark, d):
    from .queries import _findings

    docs, found = _findings(spark, d)
    i = F.col("doc_id")
    rows = report.index_lines(docs.select("doc_id", F.when(i % 2 == 0, "review").alias("verdict"), F.when(i % 3 == 0, "text_layer").when(i % 3 == 1, "none").alias("reference")), found)
    return rows.withColumn("severities", F.array_join(F.array_sort(F.transform(F.map_entries("severities"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", "))


@_with(f"WITH {inputs.DECISIONS} SELECT d.doc_id, decision, reviewer, CASE WHEN decision IS NOT NULL THEN 'ok' END AS tool_said FROM documents d LEFT JOIN decisions USING (doc_id)")
def reviewed(spark, d):
    made = inputs.decisions(spark, d).withColumns({"note": F.lit(None).cast("string"), "at": F.lit("2020-01-01T00:00:00Z")})
    rows = report.reviewed(inputs.documents(spark, d).select("doc_id", F.lit("ok").alias("verdict")), made)
    return rows.select("doc_id", F.col("review.verdict").alias("decision"), F.col("review.reviewer").alias("reviewer"), F.col("review.tool_said").alias("tool_said"))


@_with("SELECT count(*) FILTER (WHERE doc_id % 7 <> 0) AS converted, count(*) FILTER (WHERE doc_id % 7 = 0) AS failed, count(*) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 3 < 2) AS needs_review FROM documents")
def batch_outcome(spark, d):
    i = F.col("doc_id")
    return report.outcome(inputs.documents(spark, d).select(F.when(i % 7 == 0, "unreadable").alias("error"), F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, "review").when(i % 3 == 1, "reject").otherwise("ok").alias("verdict")))
