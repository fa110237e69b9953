"""Normal forms, offset maps and catalogue texts: what needs Unicode tables that the JVM's functions don't offer."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .repair import CHUNK, nfc, repaired_chunk

#: What a text must hold for NFC to change it: marks, conjoining Hangul, and signs that stand for others. None is below
#: U+0300, which one test tells; Java asks the parts of a class one after the other.
COMPOSABLE = r"[\x{300}-\x{10FFFF}&&[\p{M}\x{0340}-\x{0345}\x{0374}\x{037E}\x{0387}\x{0898}-\x{0FFF}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{10A00}-\x{1E9FF}\x{2F800}-\x{2FA1D}]]"
#: Spacing marks that a recogniser sets for combining ones.
FOLDED = StructType([StructField("letters", StringType()), StructField("places", ArrayType(IntegerType()))])
SPACING = {"´": "́", "`": "̀", "¨": "̈", "ˆ": "̂", "˜": "̃", "¸": "̧"}


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text in NFC. Only texts that can change go through Python; the others never leave the JVM."""
    odd = F.coalesce(F.col(text).rlike(COMPOSABLE), F.lit(False))
    return docs.filter(~odd).unionByName(docs.filter(odd).withColumn(text, nfc(F.col(text))))


def composed_marks(c: Column) -> Column:
    """Spacing marks as combining ones, then composed and case folded, as readings and text layers are compared."""
    for sign, mark in SPACING.items():
        c = F.replace(c, F.lit(sign), F.lit(mark))
    return F.replace(F.lower(nfc(c)), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def stripped(text: pd.Series) -> pd.Series:
    """The text without its accents, of whatever script."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _script(char: str) -> str:
    name = unicodedata.name(char, "")
    first = name.split(" ")[0].split("-")[0]
    return "UNKNOWN" if not name else "INHERITED" if first in ("MODIFIER", "COMBINING") else first


@F.arrow_udf(BooleanType())
def mixes_scripts(words: pa.Array) -> pa.Array:
    """Whether a word's letters have names of more than one script (a sign named by another word than a script counts as one of its own)."""
    kept: dict[str, str] = {}

    def one(word: str | None) -> bool | None:
        if word is None or word.isascii():
            return None if word is None else False
        for c in word:
            if c not in kept:
                kept[c] = _script(c)
        return len({kept[c] for c in word} - {"INHERITED", "COMMON"}) > 1

    return pa.array([one(w) for w in words.to_pylist()], pa.bool_())


@F.arrow_udf(FOLDED)
def folded_with_places(text: pa.Array) -> pa.Array:
    """Letters and digits alone (repaired, decomposed, without marks, case folded, digits as 0-9), and the place in the text that each comes from."""
    out = []
    for t in text.to_pylist():
        letters, places = [], []
        at = 0
        for m in [*CHUNK.finditer(t or ""), None]:
            parts = [(k, t[k]) for k in range(at, m.start() if m else len(t or ""))]
            if m:
                fixed = repaired_chunk(m)
                # a repaired chunk is shorter than what stood there: its letters take its places from the first on
                parts += [(m.start() + min(k, m.end() - m.start() - 1), c) for k, c in enumerate(fixed)]
                at = m.end()
            for k, c in parts:
                for x in unicodedata.normalize("NFKD", c):
                    if x.isdecimal():
                        found = str(unicodedata.decimal(x))
                    elif unicodedata.combining(x):
                        continue
                    else:
                        found = "".join(y for y in x.casefold() if y.isalnum())
                    letters.append(found)
                    places += [k] * len(found)
        out.append({"letters": "".join(letters), "places": places})
    return pa.array(out, pa.struct([("letters", pa.string()), ("places", pa.list_(pa.int32()))]))
