"""The document check, places of damage, options, texts and sinks, against plain Python."""

import json
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusguard import cli, settings
from corpusguard.functions import catalogue, repair, unicode
from corpusguard.functions import text as T
from corpusguard.operators import check, contain, fidelity, gate, layout, lexicon, markup, places, profile, recognition, report, scoring, spans
from corpusguard.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_what_nfc_can_change_is_seen(spark):
    """Every code point that NFC changes, or that can join the one before it, is among COMPOSABLE."""
    changing = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (unicodedata.normalize("NFC", c) != c or unicodedata.combining(c))]
    rows = frame(spark, [(i, c) for i, c in enumerate(changing)], "doc_id int, text string")
    missed = rows.filter(~F.col("text").rlike(unicode.COMPOSABLE)).collect()
    # marks newer than the JVM's Unicode tables stay as they are
    assert all(unicodedata.normalize("NFC", r.text) == r.text for r in missed)
    texts = ["plain", "é é", "하", "하", "Å", ""]
    got = {r.doc_id: r.text for r in unicode.normalised(frame(spark, [*enumerate(texts), (9, None)], "doc_id int, text string")).collect()}
    assert got == {**{i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}, 9: None}


def test_folded_letters_and_their_places(spark):
    texts = ["Straße 12", "cafÃ© now", "été ٣ ﬁ", "", "A-b"]
    got = [r.f for r in frame(spark, list(enumerate(texts)), "i int, t string").orderBy("i").select(unicode.folded_with_places("t").alias("f")).collect()]
    plain = [r.f for r in frame(spark, list(enumerate(texts)), "i int, t string").orderBy("i").select(repair.folded("t").alias("f")).collect()]
    assert [g.letters for g in got] == plain == ["strasse12", "cafenow", "ete3fi", "", "ab"]
    for text, g in zip(texts, got, strict=True):
        assert len(g.places) == len(g.letters) and g.places == sorted(g.places) and all(text[p].isalnum() or ord(text[p]) > 127 for p in g.places)


def test_mixed_scripts_by_name(spark):
    words = ["plain", "été", "pаypal", "1ª", "漢字", "カタかな", "Ωμέγα"]
    got = [r.m for r in frame(spark, list(enumerate(words)), "i int, w string").orderBy("i").select(unicode.mixes_scripts("w").alias("m")).collect()]
    assert got == [False, False, True, True, False, True, False]


def test_places_of_damage(spark):
    base = "Some quiet words stand here and nothing is wrong with any of them at all."
    texts = {1: base, 2: f"{base} a pаypal bill", 3: f"{base} cafÃ© it", 4: f"{base}\x07 bell", 5: f"{base}\nt h e  t e x t\nend", 6: f"{base}\nline of it\nline of it\nx\nline of it", 7: f"{base} aBcDeFgH", 8: "aa bb cc dd ee ff gg hh between aa bb cc dd ee ff gg hh"}
    got = {(r.doc_id, r.kind): texts[r.doc_id][r.char_start : r.char_end] for r in places.damage_places(frame(spark, list(texts.items()), "doc_id int, text string")).collect()}
    assert got == {
        (2, "mixed_scripts"): "pаypal", (3, "garbled_characters"): "Ã©", (4, "control_characters"): "\x07", (5, "letter_spacing"): "t h e  t e x t", (6, "repetition_loop"): "line of it", (7, "scrambled_text"): "aBcDeFgH", (8, "repetition_loop"): "aa bb cc dd ee ff gg hh",
    }
    second = {r.doc_id: r.char_start for r in places.damage_places(frame(spark, list(texts.items()), "doc_id int, text string")).collect() if r.kind == "repetition_loop"}
    assert second[6] == texts[6].index("line of it", texts[6].index("line of it") + 5) and second[8] == texts[8].rindex("aa")


def test_cells_and_passages_stand_where_they_are_said_to(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("ab \t|\n.é", k=3000))
    rows = frame(spark, [(1, text), (2, ""), (3, None)], "doc_id int, text string")
    chunks = [c for part in re.split(r"[\t|\n]", text) for c in re.split(" {2,}", part) if re.search(r"\S", c)]
    got = contain.cell_spans(rows, "text").orderBy("cell").collect()
    assert [r.chunk for r in got] == chunks and all(text[r.char_start : r.char_start + len(r.chunk)] == r.chunk for r in got)
    source = "The council adopted the decision on the second day of its meeting, as the agenda had foreseen."
    added = "Nobody has ever seen purple elephants dance upon frozen lakes"
    docs = frame(spark, [(1, f"{source[:40]}\n{source[40:]} {added}.", source)], "doc_id int, text string, source string")
    place = contain.run_places(docs, contain.unmatched(docs, "text", "source"), "text").first()
    held = docs.first().text[place.char_start : place.char_end]
    assert added in held and not held[0].isspace() and len(held) < len(added) + 25


def test_words_that_explain_each_other(spark):
    rows = [(1, "matter of concern matter", "mat ter of con cern mat"), (2, "alpha", "beta"), (3, "abcabc", "abc abc abc"), (4, "whole", "who le le")]
    balance = fidelity.word_balance(frame(spark, rows, "doc_id int, text string, source string"), "text", "source")
    got = {}
    for r in fidelity.reconciled(balance).collect():
        e, lost, j = got.get(r.doc_id, (0, 0, 0))
        got[r.doc_id] = e + r.extra, lost + r.lost, j + r.joins
    assert got == {1: (1, 1, 2), 2: (1, 1, 0), 3: (0, 1, 1), 4: (0, 1, 1)}


def compared(spark, rows):
    return frame(spark, rows, "doc_id int, text string, source string, recognised boolean, conf double")


def test_the_whole_check(spark):
    body = " ".join(f"sentence number {i} speaks of fisheries and of nothing else in year {1900 + i}." for i in range(20))
    wrong = "Purple elephants invented this passage without any source whatever it may be."
    rows = [(1, body, body, False, None), (2, f"{body}\n{wrong}", body, False, None), (3, body, None, False, None), (4, body, "x", False, None), (5, body, body[::-1], True, 0.9), (6, body, body, True, 0.4), (7, body, body, True, 0.7), (8, f"{body} LexUriServXyZ", f"{body} LexUriServXyZ", False, None)]
    docs = compared(spark, rows)
    routes = {r.doc_id: (r.route, r.notice) for r in check.routes(docs).collect()}
    assert routes == {1: ("text_layer", None), 2: ("text_layer", None), 3: ("none", "no_source"), 4: ("none", "scan_unchecked"), 5: ("recognised", None), 6: ("none", "scan_unreadable"), 7: ("recognised", None), 8: ("text_layer", None)}
    known = lexicon.vocabulary(docs.select("doc_id", "text"))
    found = {(r.doc_id, r.kind): r.severity for r in check.check(docs, known).collect()}
    loops = {i for i, k in found if k == "repetition_loop"}
    assert 1 not in loops and found[2, "invented_text"] == "high" and found[4, "scan_unchecked"] == "low" and found[5, "scan_mismatch"] == "high"
    assert found[6, "scan_unchecked"] == "medium" and found[7, "ocr_confidence"] == "medium" and (8, "scrambled_text") not in found
    assert not [k for i, k in found if i == 1] and [k for i, k in found if i == 7] == ["ocr_confidence"]


def test_numbers_against_a_scan(spark):
    docs = compared(spark, [(1, "in 1984 and 2,001 or 77", "in 1934 and 2001", True, 0.9)])
    none = docs.limit(0).select("doc_id", *[F.lit(0).alias(c) for c in ("cell", "start", "stop")])
    assert [r.value for r in contain.absent_in(docs, "text", "source", none).orderBy("value").collect()] == ["1984", "77"]
    assert [r.value for r in contain.absent_in(docs, "text", "source", none, misread=True).collect()] == ["77"]


def test_anchors_try_shorter_runs(spark):
    source = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(1, source, source), (2, "one two three x four five six y seven eight nine", source)], "doc_id int, text string, source string")
    got = {}
    for r in spans.anchors(docs, "text", "source").collect():
        got.setdefault(r.doc_id, {})[r.at] = r.source_at
    assert got[1] == {i: i for i in range(10)} and got[2] == {0: 0, 1: 1, 2: 2, 4: 3, 5: 4, 6: 5, 8: 6, 9: 7, 10: 8}


def test_tables_that_line_up(spark):
    cells = [(1, 1, r, x, f"c{r}{k}") for r in range(3) for k, x in enumerate((10.0 + r, 100.0, 200.0))] + [(1, 2, r, 10.0 + 40 * r + 90 * k, "w") for r in range(4) for k in range(3)] + [(1, 3, 0, 10.0, "a"), (1, 3, 0, 90.0, "b"), (1, 3, 1, 10.0, "c")]
    got = layout.reconstructed_tables(frame(spark, cells, "doc_id int, seg int, row int, x double, text string")).collect()
    assert [(r.seg, r.rows) for r in got] == [(1, [[f"c{r}{k}" for k in range(3)] for r in range(3)])]
    shown = frame(spark, [(g.rows,) for g in got], "rows array<array<string>>").select(repair.table_renderer(40)("rows").alias("t")).first().t
    assert shown.split("\n")[:2] == ["c00 | c01 | c02", "----+-----+----"]


def test_recognition_policy(spark):
    rows = [(1, 1, 1, 1, 1, 1, "word", 0, 0, 10, 20, 30.0), (1, 1, 1, 1, 1, 2, "|", 20, 0, 2, 30, 10.0), (1, 1, 1, 1, 1, 3, ".", 30, 0, 2, 9, 95.0)]
    got = {r.text: r.size for r in recognition.kept_words(frame(spark, rows, "doc_id int, page int, block int, par int, line int, word int, text string, left int, top int, width int, height int, conf double")).collect()}
    assert set(got) == {"word", "."} and all(abs(s - 30 * 0.24 * 1.05) < 1e-9 for s in got.values())
    trial = frame(spark, [(1, "the of and to in that is for with as by this are be on it from which or an at the of and to in that is"), (2, "xx"), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.language for r in recognition.trial_languages(trial, ["eng", "fra"]).collect()} == {1: "eng", 2: "eng+fra", 3: "eng"}


def test_mark_up_rules(spark):
    cases = {
        "![pic](u) a [link](u) and [ref][1] <https://x.org> note[^1]": " a link and ref https://x.org note[1]", "[^1](u)": "^1", "**bold *nested* text** and _it_": "bold nested text and it", r"\*kept\* and \_x\_": "*kept* and _x_", "`code` $$x+1$$ $x_1$ costs $5 and $6": "code x+1 x_1 costs $5 and $6",
        "~~2017~~2020": "~~2017~~2020", "a<br>b<b>c</b><x>d</x>": "a bc<x>d</x>", r"$\text{ab}_1$": "ab_1",
    }
    got = {r.a: r.b for r in frame(spark, [(c,) for c in cases], "a string").select("a", markup.strip_markdown(F.col("a")).alias("b")).collect()}
    assert got == cases
    struck = frame(spark, [("~~old~~new",)], "a string").select(markup.strip_markdown(F.col("a"), strike=True).alias("b")).first().b
    assert struck == "oldnew"
    blocks = markup.markdown_blocks(frame(spark, [(1, "Title\n=====\ntext one\ntext two\n\n- item\n> said\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n# code\n```\n# Head")], "doc_id int, text string")).orderBy("block").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading", "Title"), ("para", "text one\ntext two"), ("bullet", "item"), ("quote", "said"), ("table", "| a | b |\n| 1 | 2 |"), ("code", "# code"), ("heading", "Head")]


def test_options_and_profiles(tmp_path):
    options, typed, rest = settings.parsed(["in", "--profile", "agreements", "--no-join-pages", "--ocr-dpi", "200", "--service-key", "s3"])
    assert (options.keep_sideways, options.join_pages, options.ocr_dpi, rest, typed) == (True, False, 200, ["in"], {"profile", "join_pages", "ocr_dpi", "service_key"})
    assert settings.parsed(["--profile", "agreements", "--no-keep-sideways"])[0].keep_sideways is False
    assert settings.with_profile(settings.Options(profile="unheard of")).keep_sideways is False
    kept = settings.recorded(options)
    assert "service_key" not in kept and "inputs" not in kept and kept["ocr_candidates"] == ["eng"] and "s3" not in repr(options)
    path = str(tmp_path / "deep" / "preferences.json")
    assert settings.load_preferences(path) == {} and settings.save_preferences(path, {"language": "fr", "service_key": "s3"})
    assert settings.load_preferences(path) == {"language": "fr"}
    (tmp_path / "bad.json").write_text("{")
    assert settings.load_preferences(str(tmp_path / "bad.json")) == {} and not settings.save_preferences("/proc/none/x.json", {})


def test_catalogue(spark):
    assert catalogue.missing_keys() == [] and catalogue.missing_keys({"en": {"a": "", "b": ""}, "fr": {"a": ""}}) == [("fr", "b")]
    assert catalogue.language_of({"language": "fr"}) == "fr" and catalogue.language_of({"language": "tlh"}) == "en"
    row = frame(spark, [(21605, 0.425)], "n int, p double").select(catalogue.rendered("files", {"n": F.col("n")}, "fr").alias("a"), catalogue.rendered("scan_mismatch", {"pct": F.col("p")}).alias("b"), catalogue.rendered("files", {}).alias("c")).first()
    assert (row.a, row.b, row.c) == ("21 605 fichiers", "only 42% of the text is in the scan", "{n} files")


def test_sinks_and_sources(spark, tmp_path):
    rows = frame(spark, [("a", 1.0, "review"), ("b", None, "too_short"), ("c", 2.0, "review")], "doc_id string, risk_score double, verdict string")
    files.write_audit_csv(rows, str(tmp_path / "audit"), "risk_score", frame(spark, [("d", "unreadable")], "doc_id string, error string"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "audit").glob("part-*")))
    assert text.startswith("﻿doc_id,verdict,risk_score,error") and re.findall(r"^(?:﻿)?([a-d]),", text, re.M)[:2] == ["c", "a"] and "d,,,unreadable" in text
    done = files.write_texts(frame(spark, [("x.txt", "one\n\ntwo\n\n"), ("no/such/../\0", "bad")], "file string, text string"), str(tmp_path / "out")).collect()
    assert (tmp_path / "out" / "x.txt").read_bytes() == b"one\n\ntwo\n" and [r.error is None for r in sorted(done, key=lambda r: r.file != "x.txt")] == [True, False]
    for name in ("a.PDF", "b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = [r.path.rsplit("/", 1)[-1] for r in files.targets(spark, [str(tmp_path), "/gone/z.pdf", "/gone/y.txt"]).collect()]
    assert found == ["a.PDF", "b.pdf", "z.pdf"]
    texts = frame(spark, [("/d/t/one.txt", "/old/one.pdf"), ("/d/t/two.txt", None), ("/d/t/three.txt", "/r/three.pdf")], "path string, recorded string")
    present = frame(spark, [("/d/one.pdf",), ("/d/t/pdf/two.pdf",), ("/r/three.pdf",), ("/d/t/three.pdf",)], "path string")
    assert {r.path: r.source for r in files.find_sources(texts, present).collect()} == {"/d/t/one.txt": "/d/one.pdf", "/d/t/two.txt": "/d/t/pdf/two.pdf", "/d/t/three.txt": "/r/three.pdf"}
    named = files.match_sources(frame(spark, [("Café.txt",)], "file string"), frame(spark, [("/p/CAFÉ.pdf", 1)], "path string, priority int")).first()
    assert named.source == "/p/CAFÉ.pdf"
    files.write_records(frame(spark, [(1, "ok"), (2, None)], "doc_id int, verdict string"), str(tmp_path / "records"))
    assert {(r.doc_id, r.verdict) for r in files.read_records(spark, str(tmp_path / "records"), "doc_id int, verdict string").collect()} == {(1, "ok"), (2, None)}
    base = frame(spark, [("m", 1.0, 0.5, 30)], "metric string, median double, mad double, n long")
    files.write_baseline(base, str(tmp_path / "base"))
    assert files.read_baseline(spark, str(tmp_path / "base")).collect() == base.collect()


def test_files_that_a_parser_rejects(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"12345")
    (tmp_path / "bad.pdf").write_bytes(b"1234567")
    got = {r.path.rsplit("/", 1)[-1]: (r.n, r.error is None) for r in files.read_parsed(spark, str(tmp_path), lambda raw: [{"n": 10 // (len(raw) - 7)}], "n long").collect()}
    assert got == {"good.pdf": (-5, True), "bad.pdf": (None, False)}


def test_audit_of_unreadable_documents(spark):
    from corpusguard.operators import metrics

    docs = frame(spark, [(i, f"words of document {i} " * (20 + i)) for i in range(30)], "doc_id long, text string")
    errors = frame(spark, [(7, "unreadable"), (99, "gone")], "doc_id long, error string")
    got = {r.doc_id: r.verdict for r in scoring.audit(metrics.text_metrics(docs), None, errors).collect()}
    assert got[7] == got[99] == "error" and len(got) == 31 and set(got.values()) > {"error"}


def test_gate_counts_scrambled_text_once(spark):
    docs, scores = frame(spark, [(1,), (2,)], "doc_id long"), frame(spark, [(1, 0.0), (2, 3.5)], "doc_id long, risk_score double")
    found = frame(spark, [(1, "scrambled_text", "medium"), (1, "scrambled_text", "high"), (1, "a", "low"), (1, "a", "low")], "doc_id long, kind string, severity string")
    assert {r.doc_id: (r.verdict, r.n_findings) for r in gate.gate(docs, found, scores).collect()} == {1: ("reject", 3), 2: ("review", 0)}


def test_type3_fonts_count(spark):
    pages = frame(spark, [(1, 500, 0, 0, 3, 600.0, 700.0, False, 300, True), (2, 500, 0, 0, 3, 600.0, 700.0, False, 300, False)], "doc_id long, n_chars int, small int, rulings int, col_edges int, width double, height double, rotated boolean, dpi int, type3 boolean")
    assert {r.doc_id: r.has_type3_font for r in profile.page_signals(pages).collect()} == {1: 1.0, 2: 0.0}


def test_states_of_files(spark):
    files_ = frame(spark, [(1, False), (2, True), (3, False)], "doc_id long, own boolean")
    records = frame(spark, [(2, "reject", {"invented_words": "high"}, "text_layer")], "doc_id long, recorded string, severities map<string,string>, reference string")
    empty = frame(spark, [], "doc_id long, recorded string, severities map<string,string>, compared boolean")
    triage = frame(spark, [(1, {"dropped_words": "medium"})], "doc_id long, severities map<string,string>")
    got = {r.doc_id: (r.verdict, r.analysed, r.compared, r.problems) for r in report.states(files_, records, empty, triage, ["dropped_words"]).collect()}
    assert got == {1: ("ok", False, False, ""), 2: ("reject", True, True, "invented_words"), 3: ("unknown", False, False, "")}


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "texts"
    folder.mkdir()
    for i in range(3):
        (folder / f"t{i}.txt").write_text("All is well in this text of some words. " * (i + 1))
    (folder / "loop.txt").write_text("the same words come again and again here " * 60)
    assert cli.main(["check", str(folder), "-o", str(tmp_path / "checked")]) == 1
    assert cli.main(["relist", str(tmp_path / "checked"), "--quiet"]) == 1
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["doc_id"] for x in shown] == ["loop.txt"]
    assert cli.main([str(folder)]) == 1 and len([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]) == 4
    assert cli.main(["vocabulary", str(folder), "-o", str(tmp_path / "words")]) == 0
    assert {r.word for r in spark.read.parquet(str(tmp_path / "words")).collect()} >= {"all", "words"}
    assert cli.main(["convert", str(folder), "-o", str(tmp_path / "plain")]) == 0 and len(list((tmp_path / "plain").glob("*.txt"))) == 4
    assert cli.main(["audit", str(folder), "-o", str(tmp_path / "audit")]) == 0 and cli.main(["summary", str(folder)]) == 0
    pairs = frame(spark, [(1, "one text " * 40, "one text " * 40)], "doc_id long, text string, source string")
    pairs.write.parquet(str(tmp_path / "pairs.parquet"))
    assert cli.main(["compare", str(tmp_path / "pairs.parquet")]) in (0, 1)
    assert cli.main(["no such command", "x", "y"]) == 2


@pytest.mark.parametrize("size", [8, 10])
def test_covered_letters_against_python(spark, size):
    rng = random.Random(size)
    letters = lambda n: "".join(rng.choices("abcé漢", k=n))
    rows = []
    for i in range(60):
        theirs = [letters(rng.randrange(0, 60)) for _ in range(rng.randrange(0, 6))]
        mine = [letters(rng.randrange(0, 40)) for _ in range(rng.randrange(0, 4))] + [t[rng.randrange(0, 10) :] for t in theirs]
        rows.append((i, mine, theirs))
    got = {r.i: [(g.cell, g.start, g.n) for g in r.gaps] for r in frame(spark, rows, "i int, mine array<string>, theirs array<string>").repartition(3).select("i", contain.uncovered(size)("mine", "theirs").alias("gaps")).collect()}
    for i, mine, theirs in rows:
        known, wanted = {t[k : k + size] for t in theirs for k in range(len(t) - size + 1)}, []
        for c, x in enumerate(mine):
            held = [any(x[k : k + size] in known for k in range(max(0, p - size + 1), p + 1) if k + size <= len(x)) for p in range(len(x))]
            starts = [p for p in range(len(x)) if not held[p] and (p == 0 or held[p - 1])]
            wanted += [(c, p, next((q for q in range(p, len(x)) if held[q]), len(x)) - p) for p in starts]
        assert got[i] == wanted


def test_digits_and_words(spark):
    row = frame(spark, [("٣١ and ４２",)], "t string").select(T.ascii_digits(F.col("t")).alias("a")).first()
    assert row.a == "31 and 42"
    counts = Counter(r.word for r in lexicon.vocabulary(frame(spark, [(1, "aa bb aa"), (2, "bb")], "doc_id long, text string")).collect())
    assert counts == {"aa": 1, "bb": 1}


def test_routes_and_findings_move_no_text(spark):
    docs = frame(spark, [(1, "some text here and more", "some text here and more", False, None), (2, "some text", None, False, None), (3, "some text", "some text", True, 0.4), (4, "some text", "some text", True, 0.7)], "doc_id int, text string, source string, recognised boolean, conf double")
    rows = check.placed(docs)
    for made in (rows, check.routes(docs), check.route_findings(rows)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.route, r.notice) for r in rows.orderBy("doc_id").collect()] == [(1, "text_layer", None), (2, "none", "no_source"), (3, "none", "scan_unreadable"), (4, "recognised", None)]
    assert sorted(map(tuple, check.route_findings(rows).collect())) == sorted(map(tuple, check.route_findings(docs, check.routes(docs)).collect())) == [(3, "scan_unchecked", "medium"), (4, "ocr_confidence", "medium")]
    marks = frame(spark, [("İ--ß.",), ("ab-",), ("",), (None,)], "t string")
    assert [r.a for r in marks.select(check._lettered("t", 3).alias("a")).collect()] == [True, False, False, False]
