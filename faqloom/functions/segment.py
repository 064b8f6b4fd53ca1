"""Word segmentation by rules: prefixes, suffixes, infixes and exceptions, as one expression inside the JVM.

A piece between blanks loses the signs it begins and ends with, each a token; what an exception or a whole-word rule knows
stays in one; the rest is cut at contractions and at signs between letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faqloom.functions.unicode_rules import bind

#: Signs that a word loses in front and behind.
PREFIX = r"""["'“”‘’«»‹›„‚`(\[{<$£€¥§#&*…]"""
SUFFIX = r"""["'“”‘’«»‹›`)\]}>,.;:!?%*…]"""
#: Abbreviations that keep their full stop.  Fixed values.
ABBREVIATIONS = (
    "mr ms mrs dr prof st jr sr vs etc e.g i.e a.m p.m inc ltd co corp no vol fig jan feb mar apr jun jul aug sep sept oct "
    "nov dec"
).split()
EXCEPTION = rf"(?i)^(?:(?:{'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)})[.]|(?:\p{{L}}[.])+)\z"
#: Addresses, mail addresses and numbers stay whole.
WHOLE = r"(?i)^(?:(?:[a-z][a-z0-9+.-]*://|www[.])[^\s]+|[\w.+-]+@[\w-]+(?:[.][\w-]+)+|[+-]?[0-9]+(?:[.,:/-][0-9]+)*)\z"
#: What comes apart inside a word: the pattern and what takes its place.
SPLITS = (
    (r"(--+|[-/~=&]|…|[.][.]+)", " $1 "),
    (r"(\p{L})([,:;?!])(\p{L})", "$1 $2 $3"),
    (r"(\p{Ll})([.])(\p{Lu})", "$1 $2 $3"),
    (r"(?i)(\p{L})(n['’]t)(\z|[^\p{L}\p{N}])", "$1 $2$3"),
    (r"(?i)([\p{L}\p{N}])(['’](?:s|m|d|re|ve|ll))(\z|[^\p{L}\p{N}])", "$1 $2$3"),
    (r"(?i)^(can)(not)\z", "$1 $2"),
    (r"(?i)^(gon|wan)(na)\z", "$1 $2"),
    (r"(?i)^(got)(ta)\z", "$1 $2"),
)
#: Most words need none of it.
PLAIN = r"^[\p{L}\p{N}]+\z"
JOINED = ("cannot", "gonna", "wanna", "gotta")
SUFFIX_PARTS = r"[.][.]+|(?s:.)"


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _core(word: Column) -> Column:
    cut = word
    for pattern, by in SPLITS:
        cut = F.regexp_replace(cut, pattern, by)
    pieces = F.filter(F.split(cut, " +"), lambda p: p != "")
    return F.when(word == "", F.array().cast("array<string>")).when(word.rlike(WHOLE), F.array(word)).otherwise(pieces)


def _segments(piece: Column) -> Column:
    front = F.regexp_extract(piece, f"^{PREFIX}+", 0)
    rest = F.regexp_replace(piece, f"^{PREFIX}+", "")

    def behind(r: Column) -> Column:
        end = F.regexp_extract(r, rf"{SUFFIX}+\z", 0)
        stripped = F.concat(_core(F.regexp_replace(r, rf"{SUFFIX}+\z", "")), _parts(end, SUFFIX_PARTS))
        return F.when(r.rlike(EXCEPTION), F.array(r)).otherwise(stripped)

    return F.concat(_parts(front, "(?s:.)"), bind(rest, behind))


def segment_words(text: Column) -> Column:
    """The tokens of a text in order; null gives null."""
    pieces = F.filter(F.split(text, r"[\s\x{2028}\x{2029}]+"), lambda p: p != "")
    simple = lambda p: p.rlike(PLAIN) & ~F.lower(p).isin(*JOINED)
    return F.flatten(F.transform(pieces, lambda p: F.when(simple(p), F.array(p)).otherwise(_segments(p))))
