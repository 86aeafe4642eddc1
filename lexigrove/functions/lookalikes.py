"""Repair of letters that a text layer took from the wrong script: Greek shapes for Latin or Cyrillic letters, and twins.

A Greek shape is a lookalike when it stands for a letter in the tables below. What it stands for depends on the nearest
real letters to both sides; formula signs and real Greek letters on either side leave it alone. Every text is read once
in each direction, so the work grows with its length only.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a Greek shape stands for among Latin letters, and among Cyrillic ones.
TO_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεκμνορσςτυχιΓΣΔΠ", "ABEZHIKMNOPTYXagekmvopsstyxiGSDP"))
TO_CYRILLIC = dict(zip("βησςρτμαεοκχδφγιΑΒΕΗΙΚΜΟΡΤΥΧΔΓΘΛΞΠΣΦΨΩ", "виссртмаеоквгфгиАВЕНИКМОРТУХДГОЛЭПСФЧО"))
ABBREVIATIONS = {"τ.δ.": "т.д.", "τ.ε.": "т.е.", "τ.κ.": "т.к.", "τ. δ.": "т. д.", "τ. ε.": "т. е.", "τ. κ.": "т. к."}
# Letters of one shape in both scripts.
TWINS = ("ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху")
# Signs that are no script of their own, and signs of formulas.
PASSED = frozenset(" \t\n\r\u00a0.,;:!?\"'«»“”„()[]{}…·-/\\'’`´§¶№—–−•")
FORMULA = frozenset("=<>≤≥≠≈±∓×÷·∙*^_~∼≅≡∝∞∫∑∏√∂∇∈∉⊂⊃∧∨¬|∥°′″")
LOOKALIKES = frozenset(TO_LATIN) | frozenset(TO_CYRILLIC)

_LATIN, _CYRILLIC, _BLOCK, _EDGE = "latin", "cyrillic", "block", "edge"
_CLASS = "[" + "".join(sorted(LOOKALIKES)) + "]"
_HAS = re.compile(_CLASS)
_ABBREVIATED = re.compile(rf"(?:{_CLASS}|[.,])+")
_CODE = re.compile(rf"(?:{_CLASS}|\d|[-_/])+")


def _kind(ch: str) -> str:
    """Script of a character: latin, cyrillic, block (ends the search), '' (is passed)."""
    if ch in LOOKALIKES or ch in PASSED or ch.isspace() or ch.isdigit():
        return ""
    if "A" <= ch <= "Z" or "a" <= ch <= "z":
        return _LATIN
    if "Ѐ" <= ch <= "ӿ":
        return _CYRILLIC
    category = unicodedata.category(ch)
    if ch in FORMULA or category == "Sm" or "GREEK" in unicodedata.name(ch, ""):
        return _BLOCK
    return "" if category[0] in "PS" else _BLOCK


def _kinds(text: str) -> list[str]:
    known: dict[str, str] = {}
    out = [known[c] if c in known else known.setdefault(c, _kind(c)) for c in text]
    for i, k in enumerate(out):
        # a Latin letter that stands alone is a marker, not the script of the sentence
        if k == _LATIN and not any((c.isdigit() or "A" <= c <= "Z" or "a" <= c <= "z") for c in (text[i - 1 : i] + text[i + 1 : i + 2])):
            out[i] = ""
    return out


def _nearest(kinds: list[str], backward: bool) -> list[tuple[str, int]]:
    """For every place, the nearest kind that is not passed on one side, and how many steps away."""
    n = len(kinds)
    out, found, at = [("", 0)] * n, _EDGE, n if backward else -1
    for i in range(n - 1, -1, -1) if backward else range(n):
        out[i] = (found, abs(i - at)) if found != _EDGE else (_EDGE, n + 1)
        if kinds[i]:
            found, at = kinds[i], i
    return out


def _digit_ahead(text: str, backward: bool) -> list[bool]:
    """Whether a digit is the first thing on one side that is not passed."""
    out, found = [False] * len(text), False
    for i in range(len(text) - 1, -1, -1) if backward else range(len(text)):
        out[i] = found
        c = text[i]
        if c.isdigit():
            found = True
        elif not (c in LOOKALIKES or c in PASSED or c.isspace() or unicodedata.category(c)[0] in "PS"):
            found = False
    return out


def _bracketed(text: str) -> set[int]:
    """Places of characters that stand alone between parentheses, but for signs that are passed."""
    out: set[int] = set()
    for m in re.finditer(r"\(([^()]*)\)", text):
        inner = [i for i in range(m.start(1), m.end(1)) if not (text[i] in PASSED or text[i].isspace())]
        if len(inner) == 1:
            out.add(inner[0])
    return out


def _marked(pattern: re.Pattern, text: str, good) -> set[int]:
    return {i for m in pattern.finditer(text) if good(m[0]) for i in range(m.start(), m.end())}


def repair(text: str | None) -> str | None:
    """Greek lookalikes as the letters they stand for; formulas keep theirs. Null stays null."""
    if not text:
        return text
    for a, b in ABBREVIATIONS.items():
        text = text.replace(a, b)
    if not _HAS.search(text):
        return text
    kinds = _kinds(text)
    left, right = _nearest(kinds, False), _nearest(kinds, True)
    before, behind = _digit_ahead(text, False), _digit_ahead(text, True)
    alone = _bracketed(text)
    codes = _marked(_CODE, text, lambda s: any(c.isdigit() for c in s) and any(c in LOOKALIKES and c.isupper() for c in s))
    short = _marked(_ABBREVIATED, text, lambda s: sum(c in LOOKALIKES for c in s) >= 2)
    out = list(text)
    for m in _HAS.finditer(text):
        i, c = m.start(), m[0]
        (a, near), (b, far) = left[i], right[i]
        latin, cyrillic = TO_LATIN.get(c), TO_CYRILLIC.get(c)
        sides = {a, b}
        if _BLOCK in sides:
            continue
        if c == "η":
            new = cyrillic
        elif c in "ιΙ" and i in alone:
            new = latin
        elif i in codes and latin:
            new = latin
        elif sides >= {_LATIN, _CYRILLIC}:
            nearer = cyrillic and near == far or (a if near < far else b) == _CYRILLIC and near != far
            new = (cyrillic or latin) if nearer else (latin or cyrillic)
        elif _CYRILLIC in sides:
            new = cyrillic
        elif _LATIN in sides:
            new = latin or cyrillic
        elif i in short:
            new = latin or cyrillic
        elif cyrillic and (before[i] or behind[i]):
            new = cyrillic
        else:
            new = None if latin else cyrillic
        out[i] = new or c
    return "".join(out)


_LETTER = {"cyr": re.compile("[Ѐ-ӿ]"), "lat": re.compile("[A-Za-z]")}
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_TO_CYRILLIC, _TO_LATIN = str.maketrans(*TWINS), str.maketrans(*TWINS[::-1])


def unify_token(token: str) -> str:
    """A token of two characters or more, without Greek, in the script that six tenths of its letters have."""
    if len(token) < 2 or _GREEK.search(token):
        return token
    n = sum(map(str.isalpha, token)) or 1
    cyr, lat = (len(p.findall(token)) / n for p in _LETTER.values())
    if cyr >= 0.6 and lat:
        return token.translate(_TO_CYRILLIC)
    return token.translate(_TO_LATIN) if lat >= 0.6 and cyr else token


_SPACED = re.compile(r"(?<![\w])(?:[A-Za-zА-Яа-яЁё]\s+){2,}[A-Za-zА-Яа-яЁё](?![\w])")
# Running headers and footers of scans.
BOILERPLATE = (r"www\.vokb-la\.spb\.ru.*|.*Самол[её]т своими руками.*", r"(?:СК[БВ]|CK[BV])\s*[\"«]?Вулкан-Авиа[\"»]?")
_BOILERPLATE = re.compile("|".join(f"(?:{p})" for p in BOILERPLATE), re.I)


def collapse_spaced(text: str) -> str:
    """Three or more single letters with blanks between become a word."""
    return _SPACED.sub(lambda m: "".join(m[0].split()), text)


def strip_boilerplate(text: str) -> str:
    return "\n".join(x for x in text.splitlines() if not _BOILERPLATE.fullmatch(x.strip())).strip()


def normalize_ocr(text: str | None, recover_greek: bool = False) -> str | None:
    """Composed letters, spaced words joined, boilerplate gone, white space tidied, tokens in one script.

    ``recover_greek`` also turns isolated letters of formula-like texts into Greek ones; off by default, since a whole
    page counts as formula-like as soon as it holds one sign.
    """
    if text is None:
        return None
    text = strip_boilerplate(collapse_spaced(unicodedata.normalize("NFC", text)))
    text = "\n".join(re.sub(r"[ \t]+", " ", x).rstrip() for x in text.replace("\u00a0", " ").splitlines()).strip()
    text = re.sub(r"\S+", lambda m: unify_token(m[0]), text)
    if recover_greek:
        from lexigrove.functions.symbols import recover

        text = recover(text)
    return text


def _column(f, kind: str = "string"):
    def apply(c: Column) -> Column:
        """As an Arrow UDF: whole batches cross to Python, null in, null out."""

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return run(c)

    return apply


repaired = _column(repair)
nfc = _column(lambda s: unicodedata.normalize("NFC", s))
ocr_normalized = _column(normalize_ocr)
spaced_collapsed = _column(collapse_spaced)
boilerplate_stripped = _column(strip_boilerplate)
tokens_unified = _column(lambda s: re.sub(r"\S+", lambda m: unify_token(m[0]), s))
