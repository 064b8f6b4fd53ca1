"""Text normalisation and token-stage expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.functions.unicode_rules import bind, compose_for_ascii, strip_accents

# Tokens the sub-word tokenizer and the word-level tokenizer never split or fold.
SUBWORD_PROTECTED = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
WORD_PROTECTED = ("<unk>", "<eos>", "<formula>")

# Code-point ranges that count as CJK ideographs.
CJK_CLASS = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
# Every ASCII sign that is neither letter, digit nor space, and the Unicode punctuation classes.
PUNCT = r"!-/:-@\[-`{-~\p{P}"
# After cleaning, the white space that is left is the blank and the two Unicode line separators.
BLANKS = " \u2028\u2029"
# Latin text without control characters needs no cleaning.
NEEDS_CLEANING = r"[\x00-\x1F\x7F-\xA0\xAD\x{250}-\x{10FFFF}]"
BEYOND_LATIN = r"[\x{3000}-\x{10FFFF}]"
# A token is one punctuation character or a run of anything else that is not white space.  Small letters are no punctuation;
# named first, most characters take one comparison.
TOKEN = rf"[a-z[^{BLANKS}{PUNCT}]]+|[{PUNCT}]"


def normalize_question(text: Column, lower: bool = False) -> Column:
    """Composed text, a space before each of ``. ! ?``, every other non-alphanumeric run one space."""
    out = compose_for_ascii(text, lower)
    if lower:
        out = F.lower(out)
    # The patterns of the three steps.
    out = F.regexp_replace(out, r"([.!?])", r" $1")
    out = F.regexp_replace(out, r"[^a-zA-Z0-9.!?]+", " ")
    # link markup: the angle brackets are already gone, so this step never finds anything; the order is the contract
    return F.regexp_replace(out, r"<a.*</a>", "url")


def apply_columns(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    """Apply one Column function to the chosen columns of a table."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def standardize_text(text: Column) -> Column:
    """Dashes, ellipsis and acute accents to ASCII, sign runs set apart, white space regular."""
    # The replaced characters, the signs that are set apart, and the patterns of white space.
    out = F.translate(text, "—–―´", "---'")
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, r"""([-~!";?+,)(\\/*\[\]}{|_])\1*""", " $0 ")  # a run of one sign
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", " \n ")
    out = F.regexp_replace(out, r"(?U)[^\S\n]{2,}|[^\S\n ]", " ")  # a single blank stays
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Tabs, line ends and space separators to blanks; other control and unassigned characters dropped."""

    def clean(t: Column) -> Column:
        blanks = F.regexp_replace(t, r"[\t\n\r\p{Zs}]", " ")
        return F.when(t.rlike(NEEDS_CLEANING), F.regexp_replace(blanks, r"[\x{FFFD}\p{C}]", "")).otherwise(t)

    return bind(text, clean)


def isolate_cjk(text: Column) -> Column:
    return bind(
        text,
        lambda t: F.when(t.rlike(BEYOND_LATIN), F.regexp_replace(t, f"([{CJK_CLASS}])", " $1 ")).otherwise(t),
    )


def fold_token(text: Column) -> Column:
    return strip_accents(F.lower(text))


def split_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"([{PUNCT}])", " $1 ")


def split_words(text: Column) -> Column:
    """White-space separated words of cleaned text."""
    return bind(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{BLANKS}]+")),
    )


def _token_array(cleaned: Column, protected: Sequence[str], fold: bool) -> Column:
    """Split cleaned text to tokens.  Folding and punctuation work character by character, so a line without a
    protected token takes them as a whole; only the rare other lines go word by word."""
    names = "|".join(p.replace("[", r"\[").replace("]", r"\]") for p in protected)
    opening = protected[0][0]  # a plain search for the bracket they all begin with spares most lines the pattern

    def finish(t: Column) -> Column:
        return F.regexp_extract_all(fold_token(t) if fold else t, F.lit(TOKEN), F.lit(0))

    def word_by_word(t: Column) -> Column:
        return F.flatten(
            F.transform(split_words(t), lambda w: F.when(w.isin(*protected), F.array(w)).otherwise(finish(w)))
        )

    return bind(cleaned, lambda t: F.when(F.contains(t, F.lit(opening)) & t.rlike(names), word_by_word(t)).otherwise(finish(t)))


def basic_token_array(text: Column, lower: bool = True) -> Column:
    """Tokens ahead of sub-word splitting."""
    ready = bind(
        text, lambda t: F.when(t.rlike(NEEDS_CLEANING), isolate_cjk(clean_text(t))).otherwise(t)
    )
    return _token_array(ready, SUBWORD_PROTECTED, lower)


def word_token_array(
    text: Column,
    lower: bool = False,
    delimiter: str | None = None,
    add_eos: bool = False,
    add_double_eos: bool = False,
) -> Column:
    """Word-level tokens, with an end marker or sentence markers on both ends (both ends win)."""
    line = F.btrim(clean_text(text), F.lit(BLANKS))
    if delimiter is None:
        tokens = _token_array(line, WORD_PROTECTED, lower)
    else:
        # characters, or fields of a literal separator: no white-space splitting, blanks stay symbols
        pieces = F.when(line == "", F.array().cast("array<string>")).otherwise(
            F.filter(F.split(line, ""), lambda c: c != "")
            if delimiter == ""
            else F.split(line, r"\Q" + delimiter + r"\E")
        )

        def parts(s: Column) -> Column:
            body = fold_token(s) if lower else s
            marked = F.regexp_replace(body, f"([{PUNCT}])", "\x00$1\x00")
            return F.when(s.isin(*WORD_PROTECTED), F.array(s)).otherwise(
                F.filter(F.split(marked, "\x00"), lambda c: c != "")
            )

        tokens = F.flatten(F.transform(pieces, parts))
    if add_double_eos:
        return F.concat(F.array(F.lit("<S>")), tokens, F.array(F.lit("<S>")))
    if add_eos:
        return F.concat(tokens, F.array(F.lit("<eos>")))
    return tokens
