"""Personal data replaced by keyed, type-consistent surrogates (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Titles by gender; a name is taken for one where a title stands before it.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "κυρία"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κύριος"], "n": ["Dr", "Prof"]}
#: Phrases that a name follows, where no title does.
PHRASES = ["[Mm]y name is", "[Ii]ch heiße", "[Mm]ein Name ist", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Mm]i nombre es", "[Мм]еня зовут", "[Μμ]ε λένε"]
#: Titles before names of scripts without capitals (one word or two are the name), and after names of those without spaces.
UNCASED = {"f": ["السيدة", "גברת", "श्रीमती"], "m": ["السيد", "מר", "श्री"], "n": ["الدكتور", "الدكتورة", "डॉ"]}
AFTER = {"f": ["女士", "小姐", "太太"], "m": ["先生"], "n": ["さん", "様", "氏", "씨", "님"]}
_any = lambda titles: "(?:" + "|".join(t for ts in titles.values() for t in ts) + ")"
_TITLE = _any(TITLES) + r"\.?"
_FRONT = "(?:" + _TITLE + "|" + "|".join(PHRASES) + ")"
_UNCASED = _any(UNCASED)
_WORD = r"[\p{L}\p{M}]+"
_AFTER = _any(AFTER)
#: Kind and pattern, in order of preference at one place. A secret's keyword, and a name's title or phrase, stay.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)+",
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9+/_.-]{8,}(?<![.])",
    "key": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "local": r"(?<![\p{L}\p{N}+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<![\p{L}\p{N}.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d\d-\d{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "name": rf"(?<!\p{{L}})(?:{_FRONT} {_NAME}(?: {_NAME}){{0,2}}|{_UNCASED} {_WORD}(?: {_WORD})?)",
    "name after": rf"(?:[\p{{IsHan}}\p{{IsKatakana}}ー]{{2,4}}|\p{{IsHangul}}{{2,4}} ?){_AFTER}",
}
#: No kind but a name begins after a letter or digit of ASCII; tested once, it ends most attempts at once. What else may not stand before is told by the patterns.
ANY = r"(?<![A-Za-z])(?:(?<![0-9])(?:" + "|".join(p for k, p in PATTERNS.items() if not k.startswith("name")) + ")|" + PATTERNS["name"] + ")|" + PATTERNS["name after"]
#: What a text with an entity must hold: a digit, an at, an equals or colon sign, the start of an access key, or what makes a name one. Other texts aren't searched.
HINT = r"[0-9@=:]|A(?:KIA|SIA)|(?<!\p{L})(?=[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts})) + "])" + _TITLE + r" \p{Lu}|(?:" + "|".join(PHRASES) + ") |" + _UNCASED + " |" + _AFTER
#: Letters that stand for one another in names, beside those of the ranges below. What is in none of them stays.
ALPHABETS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóú", "àèìòù", "äëïöü", "âêîôû", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "אבגדהוזחטיכלמנסעפצקרשת", "अआइईउऊएऐओऔ", "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"]
#: First code point and number of the scripts whose letters stand for one another whatever they are.
RANGES = [(0x4E00, 20902), (0xAC00, 11172), (0x30A1, 86), (0x3041, 86)]
#: Rounds of the permutation each way.
ROUNDS = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: it is the one element of an array that use is mapped over."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(m: Column) -> Column:
    """The first kind whose pattern the match fulfils by its shape."""
    out = F.when(m.contains("@"), "email")
    out = out.when(m.rlike(r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:]"), "secret")
    out = out.when(m.rlike("^A(KIA|SIA)[A-Z0-9]{16}$"), "key").when(m.rlike(r"^[A-Z]{2}\d\d"), "iban").when(m.startswith("+"), "phone")
    out = out.when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
    out = out.when(m.rlike(r"^(\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}$"), "local").when(m.rlike(r"^\d"), "card")
    return out.otherwise("name")


def _split(m: Column, kind: Column) -> tuple[Column, Column, Column]:
    """What stays in front, the part that is replaced, and what stays behind."""
    front = F.when(kind == "secret", F.regexp_extract(m, r"^[^=:]*[=:][ \t]*[\"']?", 0)).when(kind == "name", F.regexp_extract(m, rf"^(?:{_FRONT}|{_UNCASED}) ", 0)).otherwise("")
    after = F.when((kind == "name") & (front == ""), F.regexp_extract(m, rf" ?{_AFTER}$", 0)).otherwise("")
    return front, F.substring(m, F.length(front) + 1, F.length(m) - F.length(front) - F.length(after)), after


def _gender(front: Column, after: Column) -> Column:
    """f, m, or n where the title tells none."""
    out = F.lit("n")
    for gender in "mf":
        before = "|".join(TITLES[gender]) + "|" + "|".join(UNCASED[gender])
        out = F.when(front.rlike(rf"^({before})\.? $") | after.rlike("(" + "|".join(AFTER[gender]) + ")$"), gender).otherwise(out)
    return out


def _norm(kind: Column, value: Column) -> Column:
    """One form for all ways of writing an entity."""
    lower = F.lower(value)
    return F.when(kind.isin("email", "ip", "secret") | _is_name(kind), lower).otherwise(F.regexp_replace(lower, r"[^\p{L}\p{N}]", ""))


def _is_name(kind: Column) -> Column:
    return kind.startswith("given") | (kind == "family")


def _cell(place: Column, size: Column, base: Column | int = 0, letters: str = "") -> Column:
    """A place of an entity: which of its `size` values it has (one: it stays), the first one's code point, or their alphabet."""
    return F.struct(place.cast("int").alias("v"), size.cast("int").alias("r"), (base if isinstance(base, Column) else F.lit(base)).cast("int").alias("b"), F.lit(letters).alias("a"))


def _cells(kind: Column, norm: Column) -> Column:
    """The places of an entity. Those of an address are its numbers, by their digits; all others' are characters."""
    one = F.lit(1)

    def number(o: Column) -> Column:
        value, digits = o.cast("int"), F.length(o)
        least = F.when(digits == 1, 0).when(digits == 2, 10).otherwise(100)
        return _cell(value - least, F.when(digits == 1, 10).when(digits == 2, 90).otherwise(156), least)

    def character(c: Column, i: Column) -> Column:
        code, n = F.ascii(c), F.length(norm)
        stays = (kind.isin("phone", "card") & (i == 0)) | (kind.isin("key", "iban") & (i < 4)) | ((kind == "card") & (i == n - 1))
        # an address keeps its last label, a name its last letter, which often tells the gender
        stays = stays | ((kind == "email") & (i >= n - F.length(F.substring_index(norm, ".", -1)))) | (_is_name(kind) & (i == n - 1) & ~c.rlike(r"[\p{IsHan}\p{IsHangul}\p{IsKatakana}]"))
        first = ((kind == "phone") & (i == 1)) | ((kind == "local") & (i == 0))
        out = F.when(stays, _cell(F.lit(0), one, code))
        out = out.when(c.rlike("^[0-9]$"), F.when(first & (code < 50), _cell(code - 48, F.lit(2), 48)).when(first, _cell(code - 50, F.lit(8), 50)).otherwise(_cell(code - 48, F.lit(10), 48)))
        for letters in ALPHABETS:
            out = out.when(_is_name(kind) & F.lit(letters).contains(c), _cell(F.instr(F.lit(letters), c) - 1, F.lit(len(letters)), 0, letters))
        for low, count in RANGES:
            out = out.when(_is_name(kind) & code.between(low, low + count - 1), _cell(code - low, F.lit(count), low))
        # digits and letters of hexadecimal numbers stay such
        low = F.when(kind == "secret", F.when(code < 103, 97).otherwise(103)).otherwise(97)
        out = out.when(~_is_name(kind) & c.rlike("^[a-z]$"), _cell(code - low, F.when(kind == "secret", F.when(code < 103, 6).otherwise(20)).otherwise(26), low))
        return out.otherwise(_cell(F.lit(0), one, code))

    def shaped(f: Callable[[Column], Column] | Callable[[Column, Column], Column], items: Column) -> Column:
        return F.transform(F.filter(items, lambda c: c != ""), f)

    return F.when(kind == "ip", shaped(number, F.split(norm, r"\."))).otherwise(shaped(character, F.split(norm, "")))


def _permuted(cells: Column, kind: Column, key: str) -> Column:
    """The cells with other values: a keyed permutation of all entities of a shape, none of which it leaves as it is.

    Rounds add to every other cell what a keyed digest of the cells between gives, so each can be undone. The last cell
    that can change is then stepped on by one, and the rounds are undone: the way there and back makes a permutation
    of it in which, as in the step, nothing stays.
    """
    there = [(k, k % 2, 1) for k in range(ROUNDS)]
    rounds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(parity).alias("parity"), F.lit(sign).alias("sign")) for k, parity, sign in [*there, (0, 0, 0), *[(k, p, -1) for k, p, _ in reversed(there)]]])

    def one(acc: Column, turn: Column) -> Column:
        shown = F.transform(acc, lambda c, i: F.concat_ws(":", F.when(i % 2 == turn["parity"], F.lit("")).otherwise(c["v"].cast("string")), c["b"].cast("string"), c["a"]))
        seed = F.when(turn["sign"] != 0, F.sha2(F.concat_ws("\u0000", F.lit(key), kind, turn["k"].cast("string"), F.array_join(shown, ",")).cast("binary"), 256)).otherwise("")
        last = F.array_max(F.transform(acc, lambda c, i: F.when(c["r"] > 1, i).otherwise(-1)))

        def changed(x: Column) -> Callable[[Column, Column], Column]:
            def cell(c: Column, i: Column) -> Column:
                add = F.when(turn["sign"] == 0, F.when(i == x["last"], 1).otherwise(0)).otherwise(turn["sign"] * F.when(i % 2 == turn["parity"], F.pmod(F.xxhash64(x["seed"], i), c["r"]).cast("int")).otherwise(0))
                return F.struct(F.pmod(c["v"] + add, c["r"]).cast("int").alias("v"), c["r"].alias("r"), c["b"].alias("b"), c["a"].alias("a"))

            return cell

        return _let(F.struct(seed.alias("seed"), last.alias("last")), lambda x: F.transform(acc, changed(x)))

    return F.aggregate(rounds, cells, one)


def _shown(cells: Column, kind: Column) -> Column:
    """What the cells stand for, one string each."""
    return F.transform(cells, lambda c: F.when(kind == "ip", (c["b"] + c["v"]).cast("string")).when(c["a"] != "", F.substring(c["a"], c["v"] + 1, F.lit(1))).otherwise(_character(c["b"] + c["v"])))


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _luhn(body: Column) -> Column:
    """The last digit that makes the digits before it a valid card number."""
    digits = F.filter(F.reverse(F.split(body, "")), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10))


def _iban_check(plain: Column) -> Column:
    """The check digits that make an account number valid."""
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2), F.lit("00"))
    rest = F.aggregate(
        F.filter(F.split(F.upper(turned), ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.lit(98) - rest


def _checked(kind: Column, norm: Column, new: Column) -> Column:
    """The new number with check digits as right, or as far from right, as those of the old."""
    n = F.length(norm)
    body = lambda x: F.substring(x, F.lit(1), n - 1)
    card = F.concat(body(new), F.pmod(F.substring(norm, n, F.lit(1)).cast("int") - _luhn(body(norm)) + _luhn(body(new)), F.lit(10)).cast("string"))
    check = F.pmod(F.substring(norm, 3, 2).cast("int") - _iban_check(norm) + _iban_check(new), F.lit(100))
    iban = F.concat(F.substring(new, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(new, F.lit(5), n))
    return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(new)


def _surrogate_norm(kind: Column, norm: Column, key: str) -> Column:
    """The surrogate in the form of _norm(). A name of an unknown script, which has no place that can change, becomes digits of a digest."""

    def made(cells: Column) -> Column:
        plain = _let(_shown(_permuted(cells, kind, key), kind), lambda x: F.when(kind == "ip", F.array_join(x, ".")).otherwise(F.array_join(x, "")))
        digest = F.concat(F.lit("na"), F.substring(F.sha2(F.concat_ws("\u0000", F.lit(key), kind, norm).cast("binary"), 256), 1, 16))
        return F.when(F.exists(cells, lambda c: c["r"] > 1), plain).otherwise(digest)

    return _let(_let(_cells(kind, norm), made), lambda new: _checked(kind, norm, new))


def _written(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate as the entity was written: with its capitals, and its marks where the norm has none."""

    def cased(c: Column, to: Column) -> Column:
        return F.when(c != F.lower(c), F.upper(to)).otherwise(to)

    by_place = F.transform(F.split(new, ""), lambda to, i: cased(F.substring(value, i + 1, F.lit(1)), to))
    number = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda i: _let(F.substring(value, i, F.lit(1)), lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), cased(c, F.substring(new, F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^\p{L}\p{N}]", "")), F.lit(1)))).otherwise(c)),
    )
    return F.when(kind == "ip", new).otherwise(F.array_join(F.when(kind.isin("email", "secret") | _is_name(kind), by_place).otherwise(number), ""))


def _surrogate(kind: Column, value: Column, key: str) -> Column:
    """What stands for an entity written as `value`."""
    return _let(_surrogate_norm(kind, _norm(kind, value), key), lambda new: _written(kind, value, new))


def _entities(text: Column) -> Column:
    """Array of (match, front, after, parts) of all entities in a text, in order; parts are (kind, value), one of a name for each word, the last being the family's."""

    def of(m: Column) -> Column:
        kind = _kind(m)
        front, value, after = _split(m, kind)
        parts = F.split(value, " ")
        gender = _gender(front, after)
        names = F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, "family").otherwise(F.concat(F.lit("given "), gender)).alias("kind"), p.alias("value")))
        return F.struct(m.alias("match"), front.alias("front"), after.alias("after"), F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value")))).alias("parts"))

    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, of)


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind, surrogate and n of the surrogates that two different entities of docs would share: no rows, unless a digest of a name of an unknown script repeats."""
    body = F.coalesce(F.col(text), F.lit(""))
    # explode_outer: before a plain explode Spark would test the array's size, and compute it twice
    found = docs.select(F.explode_outer(F.flatten(F.transform(_entities(body), lambda e: e["parts"]))).alias("e")).filter("e is not null")
    entities = found.select("e.kind", _norm(F.col("e.kind"), F.col("e.value")).alias("norm")).distinct()
    drawn = entities.select("kind", _surrogate_norm(F.col("kind"), F.col("norm"), key).alias("surrogate"))
    return drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1")


def replace_entities(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """id, text with every detected entity replaced, and n_entities.

    Kinds: PATTERNS. A surrogate has the entity's kind, length, case and marks (names: script, vowels for vowels, and
    the ending that tells the gender; cards and account numbers: check digits as valid as they were; addresses: as many
    digits). It depends on the secret `key` and the entity alone, so an entity has one surrogate in all documents,
    however it is written. All entities of a shape are permuted by a keyed permutation that leaves none as it is, so no
    two entities of a kind share a surrogate, without a table of those in use; a surrogate can be what another document
    really had, which no longer stands there. check looks for shared surrogates all the same, before anything is
    replaced, and raises if it finds one. Texts without entities come back as they were; a null text stays null and an
    empty one empty; each row, whatever its id, gives a row; other columns don't matter; no rows give no rows.
    """
    if check and collisions(docs, key, text).limit(1).count():
        raise RuntimeError("two entities would share a surrogate: choose another key")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"), _entities(body).alias("_found"))

    def written(e: Column) -> Column:
        return F.concat(e["front"], F.array_join(F.transform(e["parts"], lambda p: _surrogate(p["kind"], p["value"], key)), " "), e["after"])

    between = F.split(F.col("text"), ANY, -1)
    joined = F.concat(F.array_join(F.transform(F.arrays_zip(between.alias("plain"), F.transform("_found", written).alias("new")), lambda z: F.concat(z["plain"], F.coalesce(z["new"], F.lit("")))), ""))
    return rows.select(F.col("_id").alias(id_column), F.when(F.size("_found") > 0, joined).otherwise(F.col("text")).alias("text"), F.size("_found").alias("n_entities"))
