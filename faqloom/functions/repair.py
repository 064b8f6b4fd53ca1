"""Repair of text whose UTF-8 bytes were read as Latin-1 or Windows-1252, by byte round trips inside the JVM.

A run of characters that, as bytes, is well-formed UTF-8 beyond ASCII is suspicious.  Its candidate is what these bytes say
as UTF-8.  A run costs one per sequence of bytes, a candidate one per character that is rare in any text; the cheaper one
stays.  What was damaged several times takes several rounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faqloom.functions.unicode_rules import bind

# The characters of Windows-1252 for the bytes 80 to 9F that it defines, and these bytes.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)


def _byte(low: int, high: int) -> str:
    """A class of the characters that stand for bytes from ``low`` to ``high``."""
    more = "".join(c for c, b in zip(CP1252, CP1252_BYTES) if low <= ord(b) <= high)
    return rf"[\x{{{low:X}}}-\x{{{high:X}}}{more}]"


_NEXT = _byte(0x80, 0xBF)
#: Well-formed sequences of two, three and four bytes.  Fixed by UTF-8.
SEQUENCE = "|".join((
    _byte(0xC2, 0xDF) + _NEXT,
    _byte(0xE0, 0xE0) + _byte(0xA0, 0xBF) + _NEXT,
    _byte(0xE1, 0xEC) + _NEXT + _NEXT,
    _byte(0xED, 0xED) + _byte(0x80, 0x9F) + _NEXT,
    _byte(0xEE, 0xEF) + _NEXT + _NEXT,
    _byte(0xF0, 0xF0) + _byte(0x90, 0xBF) + _NEXT + _NEXT,
    _byte(0xF1, 0xF3) + _NEXT + _NEXT + _NEXT,
    _byte(0xF4, 0xF4) + _byte(0x80, 0x8F) + _NEXT + _NEXT,
))
#: What any sequence begins with: most texts hold none, and this is found out in one look at each character.
BEGINNING = _byte(0xC2, 0xF4) + _NEXT
#: A run is judged in parts of so many sequences, which bounds the matcher's depth.
RUN = f"(?:{SEQUENCE}){{1,16}}"
#: What a candidate pays for: controls, phonetic and modifier letters, combining marks, rare letters, scripts that hardly
#: anyone damages, private and unassigned characters.
RARE = (
    r"[\x{80}-\x{9F}\x{180}-\x{24F}\x{250}-\x{36F}\x{370}-\x{385}\x{3CF}-\x{3FF}\x{460}-\x{48F}\x{492}-\x{5CF}\x{600}-\x{60B}"
    r"\x{6D6}-\x{8FF}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFC}\x{FFFE}-\x{FFFF}\x{E0000}-\x{10FFFF}]"
)
#: A capital and a sign that often stand together undamaged cost nothing: «NÄ», Ä®.
AT_HOME = r"[\x{C4}-\x{DF}][«»®©°]"
ROUNDS = 3


def _fixed(run: Column) -> Column:
    raw = F.encode(F.translate(run, CP1252, CP1252_BYTES), "ISO-8859-1")
    candidate = F.decode(raw, "UTF-8")
    cost = F.regexp_count(run, F.lit(SEQUENCE)) - F.regexp_count(run, F.lit(AT_HOME))
    return bind(candidate, lambda c: F.when(F.regexp_count(c, F.lit(RARE)) < cost, c).otherwise(run))


def repair_text(text: Column, rounds: int = ROUNDS) -> Column:
    """The text with every suspicious run in its cheaper form; null stays null, whole text stays as it is."""
    if not rounds:
        return text

    def round_of(t: Column) -> Column:
        fixed = F.array_join(F.zip_with(
            F.split(t, RUN, -1), F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), _fixed),
            lambda between, run: F.concat(between, F.coalesce(run, F.lit("")))), "")
        return F.when(t.rlike(BEGINNING) & t.rlike(RUN), repair_text(fixed, rounds - 1)).otherwise(t)

    return bind(text, round_of)
