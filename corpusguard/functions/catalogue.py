"""Texts shown to readers, by language: templates filled from a finding's parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates by language and key; {n} is a whole number, {pct} a percentage, others are put in as they are.
CATALOGUES = {
    "en": {
        "invented_text": "{n} letters that the source doesn't have: {sample}", "missing_from_text": "{n} letters of the source are missing", "invented_numbers": "numbers not in the source: {sample}",
        "repetition_loop": "the same words {n} times", "scan_mismatch": "only {pct} of the text is in the scan", "verdict": "{verdict}", "files": "{n} files",
    },
    "fr": {
        "invented_text": "{n} lettres que la source n'a pas : {sample}", "missing_from_text": "il manque {n} lettres de la source", "invented_numbers": "nombres absents de la source : {sample}",
        "repetition_loop": "les mêmes mots {n} fois", "scan_mismatch": "seulement {pct} du texte se trouve dans le scan", "verdict": "{verdict}", "files": "{n} fichiers",
    },
}
DEFAULT = "en"


def missing_keys(catalogues: dict[str, dict[str, str]] = CATALOGUES) -> list[tuple[str, str]]:
    """(language, key) of all keys that one catalogue has and another lacks."""
    every = set().union(*catalogues.values()) if catalogues else set()
    return sorted((language, key) for language, held in catalogues.items() for key in every - held.keys())


def language_of(preferences: dict) -> str:
    """The preferred language if there is a catalogue for it."""
    found = preferences.get("language", DEFAULT)
    return found if found in CATALOGUES else DEFAULT


def number(c: Column, language: str = DEFAULT) -> Column:
    """A whole number in groups of three: 21,605 in English, with a no-break space in French."""
    grouped = F.format_number(c.cast("long"), 0)
    return F.replace(grouped, F.lit(","), F.lit(" ")) if language == "fr" else grouped


def percent(c: Column) -> Column:
    return F.concat(F.format_number(F.bround(c * 100, 0).cast("long"), 0), F.lit("%"))


def rendered(key: str, params: dict[str, Column], language: str = DEFAULT) -> Column:
    """A key's template in a language (English where that lacks it) with its parameters; an unknown key is shown as it is,
    and so is a template whose parameters aren't all given."""
    template = CATALOGUES.get(language, {}).get(key) or CATALOGUES[DEFAULT].get(key)
    if template is None:
        return F.lit(key)
    parts = re.split(r"\{(\w+)\}", template)
    if not set(parts[1::2]) <= params.keys():
        return F.lit(template)
    shown = {"n": lambda c: number(c, language), "pct": percent}
    return F.concat(*[F.lit(p) if k % 2 == 0 else shown.get(p, lambda c: c.cast("string"))(params[p]) for k, p in enumerate(parts)])
