"""Options of a run, and profiles that set some of them for a kind of document."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """All options with their defaults. Frozen: a run's plans are made from one set."""

    inputs: tuple[str, ...] = ()
    out: str | None = None
    recursive: bool = False
    columns: str = "auto"
    tables: str = "lines"
    table_markers: bool = False
    keep_bullets: bool = True
    page_marks: bool = False
    keep_hyphens: bool = False
    keep_headers: bool = False
    keep_sideways: bool = False
    join_pages: bool = True
    strip_strikethrough: bool = False
    width: int = 100
    x_tol: float | None = None
    y_tol: float = 3.0
    ocr: str = "auto"
    ocr_engine: str = "model"
    ocr_language: str = "auto"
    ocr_languages: str = "eng,fra,spa"
    ocr_dpi: int = 300
    ocr_min_conf: float = 40.0
    ocr_retry_below: float = 75.0
    ocr_deskew: bool = True
    ocr_remove_rules: bool = True
    ocr_candidates: tuple[str, ...] = ("eng",)
    ocr_trial_language: str = "eng"
    service_key: str = field(default="", repr=False)
    service_model: str = ""
    service_batch_pages: int = 40
    profile: str = "decisions"
    verbose: bool = False


#: Choices of options that have a few.
CHOICES = {"columns": ("auto", "1", "2"), "tables": ("lines", "text", "none"), "ocr": ("auto", "off", "always")}
#: Options that are never written anywhere.
SECRET = ("service_key",)


@dataclass(frozen=True)
class Profile:
    """Defaults for one kind of document, and whether a paragraph may go on over a page into an article's opening."""

    defaults: dict
    respect_openers: bool = False
    provisional: bool = False


_COMMON = {"keep_headers": False, "join_pages": True, "page_marks": False, "tables": "lines"}
PROFILES = {
    "decisions": Profile({**_COMMON, "keep_sideways": False}),
    # text printed sideways in an annex is more often part of it than not, and losing content is the worse error
    "agreements": Profile({**_COMMON, "keep_sideways": True}, respect_openers=True, provisional=True),
}


def with_profile(options: Options, explicit: set[str] = frozenset()) -> Options:
    """options with the defaults of their profile (an unknown one: decisions), but for those set on purpose."""
    chosen = PROFILES.get(options.profile, PROFILES["decisions"])
    return replace(options, **{k: v for k, v in chosen.defaults.items() if k not in explicit})


def parser() -> argparse.ArgumentParser:
    """Flags for all options: switches for booleans (--x and --no-x), values for the others."""
    out = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    for f in fields(Options):
        flag, kind = "--" + f.name.replace("_", "-"), f.type
        if f.name == "inputs":
            continue
        if kind == "bool":
            out.add_argument(flag, dest=f.name, action=argparse.BooleanOptionalAction)
        elif kind.startswith("tuple"):
            out.add_argument(flag, dest=f.name, type=lambda s: tuple(s.split(",")))
        else:
            out.add_argument(flag, dest=f.name, type={"int": int, "float": float, "float | None": float}.get(kind, str), choices=CHOICES.get(f.name))
    return out


def parsed(argv: Sequence[str]) -> tuple[Options, set[str], list[str]]:
    """(options under their profile, names of those typed, arguments left over): only typed flags are in the namespace, so they are the explicit ones."""
    known, rest = parser().parse_known_args(list(argv))
    typed = vars(known)
    return with_profile(replace(Options(), **typed), set(typed)), set(typed), rest


def recorded(options: Options) -> dict:
    """Options as a record keeps them: no secrets, no lists but the candidate languages."""
    plain = {k: v for k, v in asdict(options).items() if k not in SECRET}
    return {k: list(v) if k == "ocr_candidates" else v for k, v in plain.items() if not isinstance(v, (tuple, list, dict)) or k == "ocr_candidates"}


def load_preferences(path: str) -> dict:
    """What was saved; nothing if the file is absent or isn't JSON."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save_preferences(path: str, preferences: dict) -> bool:
    """Write them in one step (a file beside, then renamed), without secrets; False if that can't be done."""
    kept = {k: v for k, v in preferences.items() if k not in SECRET}
    try:
        place = Path(path)
        place.parent.mkdir(parents=True, exist_ok=True)
        beside = place.with_suffix(place.suffix + ".new")
        beside.write_text(json.dumps(kept, indent=2), encoding="utf-8")
        beside.replace(place)
    except OSError:
        return False
    return True
