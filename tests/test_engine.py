"""Detectors and expressions: a quiet and a firing case each, against plain Python."""

import gzip
import re

from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.operators import contain, detect, fidelity, layout, lexicon, markup, metrics, profile, scoring, spans, store, verdicts
from corpusguard.sources import files
from corpusguard.streaming import decisions


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_expressions(spark):
    assert one(spark, "Page  12 of 30!", T.signature) == "page # of"
    assert one(spark, "ﬁne­ text \n", T.clean) == "fine text"
    assert one(spark, "Straße", T.casefold) == "strasse"
    assert one(spark, "Él niño 12", T.fold) == "elnino12"
    assert one(spark, "abc", T.deletions) == ["bc", "ac", "ab"]
    assert one(spark, "1 234,5 and 7", T.digit_runs) == "12345|7"
    for a, b, joined in [("exam-", "ple here", "example here"), ("Franco-", "German", "Franco-German"), ("one", "two", "one two")]:
        row = spark.createDataFrame([(a, b)], "a string, b string").select(T.join_lines(F.col("a"), F.col("b")).alias("j")).first()
        assert row.j == joined
    for text, yes in [("- 12 -", True), ("Page iv", True), ("3 of 10", True), ("see 12 above", False), ("Page", False)]:
        assert one(spark, text, lambda c: c.rlike(T.PAGE_NUMBER)) is yes


def test_page_numbers_as_in_sql(spark):
    for text, yes in [("Dem.", False), ("Cimi.", True), ("iiii", True), ("PÁG. 3", True), ("12\x85", False), ("12\x0b", False), ("d de m", True), ("[3 / 12]", True)]:
        assert one(spark, text, lambda c: c.rlike(T.PAGE_NUMBER)) is yes, text


def test_texts_are_composed_in_pieces(spark):
    from corpusguard.functions import repair

    texts = [None if k % 7 == 0 else "" if k % 7 == 1 else f"e\u0301 {k}" for k in range(3 * repair.TEXTS + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.t for r in rows.select("doc_id", repair.nfc(F.col("text")).alias("t")).collect()}
    assert got == {k: t and t.replace("e\u0301", "é") for k, t in enumerate(texts)}


def test_control_characters_of_empty_texts(spark):
    rows = spark.createDataFrame([(1, ""), (2, "a\x01b"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_junk, r.first_at) for r in detect.control_characters(rows).collect()] == [(2, 1, 1)]


def test_metrics_against_python(spark):
    loop = "the same eight words are said here again " * 40
    rows = spark.createDataFrame([(1, loop), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in metrics.text_metrics(rows).collect()}
    assert got[1].top_ngram_coverage == 1.0 and got[1].language == "en" and not got[1].too_short
    assert got[2].too_short and got[2].top_ngram_coverage is None and got[3].n_chars == 0 and got[3].n_lines == 0
    ratio = rows.filter("doc_id = 1").select(metrics.gzip_ratio("text")).first()[0]
    assert ratio == len(gzip.compress(loop.encode(), 6)) / len(loop)


def test_detectors(spark):
    sound = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    rows = spark.createDataFrame([(1, sound), (2, sound + " aBcDeFgH tHeReFoRe"), (3, "x y z\n" + "same line of text\n" * 30)], "doc_id long, text string")
    found = {(r.doc_id, r.kind) for r in detect.quick_findings(rows).collect()}
    assert (2, "scrambled_text") in found and (3, "repetition_loop") in found and not [k for d, k in found if d == 1]
    second = detect.repeated_lines(rows).collect()
    assert [(r.doc_id, r.times) for r in second] == [(3, 30)]
    assert "x y z\nsame line of text\n"[6:].startswith("same") and second[0].second_at == 6 + len("same line of text\n")


def test_baseline_needs_rows_and_uses_a_fallback(spark):
    rows = [("a", float(i)) for i in range(40)] + [("b", 0.0)] * 39 + [("b", 1.0)] + [("c", 1.0)] * 5
    got = {r.metric: r for r in scoring.baseline(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert got["a"].median == 19.5 and got["a"].mad == 10.0 and "c" not in got
    assert got["b"].median == 0.0 and abs(got["b"].mad - 0.61 / 2.33) < 1e-9


def test_unmatched_against_python(spark):
    import random

    rng = random.Random(7)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    pairs = []
    for i in range(20):
        source = " ".join(rng.choices(words, k=30))
        text = source[: rng.randrange(20, 90)] + " " + " ".join(rng.choices(["zulu", "yankee", "xray"], k=rng.randrange(0, 9)))
        pairs.append((i, text, source))
    frame = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_letters, r.n_covered) for r in contain.coverage(frame, "text", "source").collect()}
    for i, text, source in pairs:
        a, b = (re.sub(r"[^a-z]", "", x) for x in (text, source))
        known = {b[k : k + 10] for k in range(len(b) - 9)}
        flags = [False] * len(a)
        for k in range(len(a) - 9):
            if a[k : k + 10] in known:
                flags[k : k + 10] = [True] * 10
        assert got[i] == (len(a), sum(flags))


def test_numbers_and_joins(spark):
    rows = spark.createDataFrame([(1, "in 1999 and 2001, 2001", "in 1999 and 2001"), (2, "an example", "an exam ple")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.value, r.at) for r in fidelity.invented_numerals(rows, "text", "source").collect()] == [(1, "2001", 2)]
    balance = fidelity.word_balance(rows, "text", "source")
    assert [(r.doc_id, r.word, r.parts) for r in fidelity.hyphen_joins(balance).collect()] == [(2, "example", "exam+ple")]


def test_balances_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "an example of examples", "an exam ple of of"), (2, "same", "same"), (3, None, "gone gone"), (4, "", ""), (5, "new", None)], "doc_id long, text string, source string")
    held = fidelity.balances(rows, "text", "source")
    for made in (held, fidelity.hyphen_joins(held), fidelity.invented_words(held), fidelity.lost_words(held), fidelity.reconciled(held)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.word, r.extra, r.lost, r.first_at) for r in fidelity.word_balance(rows, "text", "source").collect())
    assert got == [(1, "exam", 0, 1, None), (1, "example", 1, 0, 1), (1, "examples", 1, 0, 3), (1, "of", 0, 1, 2), (1, "ple", 0, 1, None), (3, "gone", 0, 2, None), (5, "new", 1, 0, 0)]
    # a word is explained as often as its parts are there, and documents apart from each other
    many = spark.createDataFrame([(1, "abcd abcd abcd", "ab cd ab cd"), (2, "abcd", "ab"), (3, "x", "x cd")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.word, r.extra, r.lost, r.joins) for r in fidelity.reconciled(fidelity.word_balance(many, "text", "source")).orderBy("doc_id", "word").collect()] == [(1, "abcd", 1, 0, 2), (2, "ab", 0, 1, 0), (2, "abcd", 1, 0, 0), (3, "cd", 0, 1, 0)]


def test_spelling_variants_stay_in_their_row(spark):
    def around(w):
        return {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}

    import random

    deal = random.Random(3)
    words = ["".join(deal.choice("abc") for _ in range(deal.choice([3, 4, 5, 6, 70, 71]))) for _ in range(60)]
    changed = [w[: len(w) // 2] + deal.choice(["", "d", "da"]) + w[len(w) // 2 + deal.choice([0, 1]) :] for w in words]
    rows = spark.createDataFrame([(1, " ".join(changed + ["ΟΔΟΣ", "Straßen"]), " ".join(words + ["ΟΔΟΣΑ", "strassem"])), (2, "thqe the", None), (3, None, "the")], "doc_id long, text string, source string")
    found = contain.spelling_variants(rows, "text", "source")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    mine, theirs = [*changed, "οδος", "strassen"], [*words, "οδοσα", "strassem"]
    wanted = {}
    for w in mine:
        if len(w) >= 4 and w not in "".join(theirs):
            near = next((n for n in theirs if len(n) >= 4 and around(w) & around(n)), None)
            if near:
                wanted[w] = near
    assert len(wanted) > 20 and {r.word: r.near for r in found.collect()} == wanted


def test_spans(spark):
    placed = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 3000)], "doc_id long, page long, char_start long, char_end long")
    points = spark.createDataFrame([(1, 1, 5), (1, 2, 15), (1, 3, 2500)], "doc_id long, point_id long, pos long")
    assert {r.point_id: r.page for r in spans.point_in_span(points, placed).collect()} == {1: 1, 2: 1, 3: 2}
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5, 7, 8)], "doc_id long, page long")
    assert spans.page_ranges(pages).first().ranges == "1-3, 5, 7-8"


def test_layout(spark):
    blocks = [(1, 0, 1, "It goes on and", False), (1, 1, 2, "on over here.", False), (1, 2, 3, "new one", False)]
    got = layout.page_joins(spark.createDataFrame(blocks, "doc_id long, block long, page long, text string, heading boolean"))
    assert [r.text for r in got.orderBy("block").collect()] == ["It goes on and on over here.", "new one"]
    chars = spark.createDataFrame([(1, 1, 0.0, 1.0)] * 3 + [(1, 1, 1.0, 0.0)], "doc_id long, page long, a double, b double")
    assert [(r.page, r.angle) for r in layout.dominant_angle(chars).collect()] == [(1, 90)]


def test_markup(spark):
    assert one(spark, "<p>a<br>b</p><script>x</script> 1 < 2", markup.strip_html) == "a b<script>x</script> 1 < 2"
    assert one(spark, r"**bold** and *it* [link](u) `code` \*kept\* $5 and $6", markup.strip_markdown) == "bold and it link code *kept* $5 and $6"
    rows = spark.createDataFrame([(1, "# Head\n\ntext one\ntext two\n\n- a\n- b\n```\n# code\n```")], "doc_id long, text string")
    assert [(r.kind, r.text) for r in markup.markdown_blocks(rows).orderBy("block").collect()] == [("heading", "Head"), ("para", "text one\ntext two"), ("bullet", "a"), ("bullet", "b"), ("code", "# code")]


def test_alignment_of_long_texts(spark, tmp_path):
    import difflib
    import random

    from corpusguard.plans import inputs
    from corpusguard.plans.queries import QUERIES

    rng = random.Random(4)
    words = ["the", *("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(300))]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(6, 14)))
    texts = [(i, "\n".join(line() for _ in range(4 if i < 5 else 120))) for i in range(15)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.similarity, r.deleted, r.inserted) for r in QUERIES["alignment"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(15))
    for r in inputs.pairs(spark, str(tmp_path)).collect():
        match = difflib.SequenceMatcher(None, *(re.findall(r"[^\W_]+", x.casefold()) for x in (r.source, r.text)), autojunk=False)
        ops = match.get_opcodes()
        gone = max((j - i for op, i, j, _, _ in ops if op in ("delete", "replace")), default=0)
        new = max((m - k for op, _, _, k, m in ops if op in ("insert", "replace")), default=0)
        assert got[r.doc_id] == (match.ratio(), gone, new)


def test_matcher_gives_the_blocks_of_difflib(monkeypatch):
    import difflib
    import random

    from corpusguard.functions import repair

    rng = random.Random(6)
    for trial in range(120):
        monkeypatch.setattr(repair, "SMALL", rng.choice([0, 100, 1 << 15]))
        words = [f"w{k}" for k in range(rng.choice([2, 5, 50, 500]))]
        a = rng.choices(words, k=rng.randrange(0, 300))
        b = list(a) if trial % 8 else rng.choices(words, k=100)
        for _ in range(rng.randrange(0, 12)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(0, 30)] = rng.choices([*words, "new"], k=rng.randrange(0, 30))
        assert repair.Matcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_glyph_codes_of_long_texts(spark, tmp_path):
    import random
    from collections import Counter

    from corpusguard.plans.queries import QUERIES

    rng = random.Random(9)
    plain = ["".join(rng.choices("abcde", k=rng.randrange(2, 6))) for _ in range(60)]
    marked = ["quiet", "aqua", "equal", "qqab", "cq", "q", "qq", "aqbq", "bad", "bqd", "quit", "suit", "opaque"]
    texts = []
    for i in range(30):
        late = rng.sample(marked, rng.randrange(0, 7))
        texts.append((i, " ".join([*rng.choices(plain, k=700 if i % 2 else 20), *late])))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = set()
    for i, text in texts:
        votes, words = Counter(), set(text.split())
        for w in words:
            fits = [t for t in words if len(t) == len(w) and all(x in ("q", y) for x, y in zip(w, t, strict=True))] if "q" in w else []
            if len(fits) == 1:
                votes.update(y for x, y in zip(w, fits[0], strict=True) if x == "q")
        letter, n = max(votes.items(), key=lambda v: (v[1], v[0]), default=("", 0))
        if n >= 2 and n >= 0.8 * votes.total():
            wanted.add((i, "(cid:17)", letter))
    assert any(i % 2 for i, _, _ in wanted)
    assert {tuple(r) for r in QUERIES["glyph_codes"](spark, str(tmp_path)).collect()} == wanted


def test_layer_verdict_is_the_first_that_holds(spark):
    pages = [(1, p, 60, 5) for p in range(1, 8)] + [(2, 1, 20, 0)] + [(3, p, 100, 3 if p < 3 else 0) for p in range(1, 8)]
    got = {r.doc_id: (r.verdict, r.at_page) for r in profile.layer_verdicts(spark.createDataFrame(pages, "doc_id long, page long, confident int, lacking int")).collect()}
    assert got == {1: ("poor", 3), 2: ("undecided", None), 3: ("sound", 4)}


def test_suspicious_words(spark):
    known = spark.createDataFrame([("ordinary",), ("words",)], "word string")
    rows = spark.createDataFrame([(1, "ordinary blorptic words Dissostichus mawsoni Ordinary fnordly")], "doc_id long, text string")
    assert sorted(r.word for r in lexicon.suspicious(rows, known).collect()) == ["blorptic", "fnordly"]


def test_verdicts_and_state(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    found = spark.createDataFrame([(1, "spelling_variants", "low"), (2, "invented_words", "high")], "doc_id long, kind string, severity string")
    got = {r.doc_id: r.verdict for r in verdicts.all_verdicts(docs, found, verdicts.hidden_kinds(spark)).collect()}
    assert got == {1: "ok", 2: "reject", 3: "ok"}
    log = spark.createDataFrame([("a", "ok", 1, 1), ("a", "bad", 1, 2), ("b", "ok", 3, 1)], "file string, verdict string, at long, seq long")
    assert {r.file: r.verdict for r in store.latest(log, "file", "at", "seq").collect()} == {"a": "bad", "b": "ok"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één\r\ntwo".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 \x81")
    got = {r.file: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "één\ntwo", "b.txt": "café \u0081"}
    assert files.read_baseline(spark, str(tmp_path / "none")) is None
    parsed = files.read_parsed(spark, str(tmp_path), lambda raw: [{"n": 1 // (len(raw) - 7)}], "n long", "*.txt").collect()
    assert sorted((r.n, r.error) for r in parsed) == [(-1, None), (0, None)]


def test_streams(spark, tmp_path):
    folder, table, mark = (str(tmp_path / x) for x in ("log", "table", "mark"))
    row = lambda file, verdict, at, seq: (file, verdict, "r", "", at, seq)
    spark.createDataFrame([row("a", "rejected", "2026-01-01", 1), row("b", "accepted", "2026-01-01", 2)], decisions.LOG).write.json(folder)
    decisions.keep_latest(decisions.decision_stream(spark, folder), table, mark).awaitTermination()
    spark.createDataFrame([row("a", "accepted", "2026-01-02", 3)], decisions.LOG).write.mode("append").json(folder)
    decisions.keep_latest(decisions.decision_stream(spark, folder), table, mark).awaitTermination()
    assert {r.file: r.verdict for r in decisions.read_latest(spark, table).collect()} == {"a": "accepted", "b": "accepted"}
    events = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (1, "2026-01-01 02:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in decisions.sessions(events).collect()) == [1, 2]
