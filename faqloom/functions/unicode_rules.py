"""Unicode rules as Spark expressions, generated from the Unicode database when a plan is built.

Spark has no normal-form function.  Both rules the tokenizers need can be said with built-in string functions:

* accent folding (canonical decomposition, then drop non-spacing marks) is ``translate`` for every code point that
  folds to at most one character, arithmetic for Hangul syllables and ``replace`` for the few others;
* canonical composition, seen through an ASCII-only filter, is one regular expression: a letter disappears when a
  following mark would be composed with it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
NON_ASCII = r"[^\x00-\x7F]"
BEYOND_FIRST_BLOCKS = r"[\x{400}-\x{10FFFF}]"


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def char_class(points: list[int]) -> str:
    """Code points as the inside of a Java character class, runs as ranges."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters that change, their one-character images; a shorter image string deletes the tail), long images."""
    single, dropped, longer = [], [], []
    for p in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= p <= 0xDFFF or HANGUL_FIRST <= p <= HANGUL_LAST:
            continue
        c = chr(p)
        image = "".join(m for m in unicodedata.normalize("NFD", c) if unicodedata.category(m) != "Mn")
        if image == c:
            continue
        if not image:
            dropped.append(c)
        elif len(image) == 1:
            single.append((c, image))
        else:
            longer.append((c, image))
    source = "".join(c for c, _ in single) + "".join(dropped)
    return source, "".join(i for _, i in single), tuple(longer)


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _hangul_to_jamo(c: Column) -> Column:
    s = F.ascii(c) - HANGUL_FIRST
    tail = s % 28
    return F.when(
        F.ascii(c).between(HANGUL_FIRST, HANGUL_LAST),
        F.concat(
            _utf16((F.floor(s / 588) + 0x1100).cast("bigint")),
            _utf16((F.floor((s % 588) / 28) + 0x1161).cast("bigint")),
            F.when(tail > 0, _utf16((tail + 0x11A7).cast("bigint"))).otherwise(F.lit("")),
        ),
    ).otherwise(c)


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without the non-spacing marks; ASCII text is passed through untouched."""
    source, image, longer = _fold_tables()
    rare_class = "[" + char_class([ord(c) for c, _ in longer]) + rf"\x{{{HANGUL_FIRST:X}}}-\x{{{HANGUL_LAST:X}}}]"

    def fold(t: Column) -> Column:
        simple = F.translate(t, source, image)
        rare = simple
        for c, to in longer:
            rare = F.replace(rare, F.lit(c), F.lit(to))
        rare = F.array_join(F.transform(F.split(rare, ""), _hangul_to_jamo), "")
        return (
            F.when(F.octet_length(t) == F.length(t), t)  # ASCII has a byte for each character
            .when(t.rlike(BEYOND_FIRST_BLOCKS) & t.rlike(rare_class), rare)
            .otherwise(simple)
        )

    return bind(text, fold)


@lru_cache(maxsize=2)
def _composing_letter(lower: bool) -> str:
    """Pattern: an ASCII letter and the marks up to one that composes with it.

    A mark is blocked only by an earlier mark of its own combining class, so the mark must be the first of its class.
    """
    by_class: dict[int, list[int]] = {}
    for p in range(0x80, sys.maxunicode + 1):
        k = unicodedata.combining(chr(p))
        if k:
            by_class.setdefault(k, []).append(p)
    cases: dict[tuple[int, tuple[int, ...]], list[str]] = {}
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        for k, marks in by_class.items():
            hits = tuple(m for m in marks if len(unicodedata.normalize("NFC", letter + chr(m))) == 1)
            if hits:
                cases.setdefault((k, hits), []).append(letter)
    every = [p for ps in by_class.values() for p in ps]
    parts = []
    for (k, hits), letters in cases.items():
        others = [p for p in every if unicodedata.combining(chr(p)) != k]
        parts.append(f"[{''.join(letters)}][{char_class(others)}]*[{char_class(list(hits))}]")
    # lower-casing the dotted capital I gives back a plain i, so there the letter stays
    dotted = "(?!I\\x{307})" if lower else ""
    return dotted + "(?:" + "|".join(parts) + ")"


def compose_for_ascii(text: Column, lower: bool = False) -> Column:
    """Canonical composition as far as an ASCII-only filter can see it."""

    def compose(t: Column) -> Column:
        kelvin = F.replace(t, F.lit("\u212a"), F.lit("K"))
        return (
            F.when(~t.rlike(NON_ASCII), t)
            .when(t.rlike(r"\p{M}"), F.regexp_replace(kelvin, _composing_letter(lower), "é"))
            .otherwise(kelvin)
        )

    return bind(text, compose)
