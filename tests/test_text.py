import random
import re

from pyspark.sql import functions as F

from faqloom.functions import text as T
from faqloom.functions.repair import repair_text
from faqloom.functions.unicode_rules import compose_for_ascii, strip_accents
from tests import plain

ALPHABET = (
    "abcdeIKSZ.!?,-;\"'()[]<>/0 9\t\n\r  　\u0000​�K"
    "éÉçñüÅİßΣσςАЙй中文한글각ア̸̧̣́̇̌ऩ"
    "—–―…´~+|_*\\{}\U00020000\U0001f600क़"
)


def texts(n=400, seed=3):
    rnd = random.Random(seed)
    rows = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(n)]
    guarded = ["[UNK]", " [MASK] ", "[unk]", "x[SEP]", "<eos>", "<unk>"]
    return rows + [r + " " + rnd.choice(guarded) + " " + r for r in rows]


def run(spark, rows, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("t"))).collect())]


def test_golden_rows(spark):
    assert run(spark, ["Héllo, [UNK] 中文!", "[unk]"], T.basic_token_array) == [
        ["hello", ",", "[UNK]", "中", "文", "!"], ["[", "unk", "]"]]
    assert run(spark, ["Hello, world! Café?", '<a href="x">y</a>'], T.normalize_question) == [
        "Hello world ! Caf ?", " a href x y a "]
    assert run(spark, ["a—b…"], T.standardize_text) == ["a - b..."]
    assert run(spark, ["x y"], lambda c: T.word_token_array(c, add_eos=True, add_double_eos=True)) == [
        ["<S>", "x", "y", "<S>"]]


def test_basic_tokens_match_plain_python(spark):
    rows = texts()
    assert run(spark, rows, T.basic_token_array) == [plain.basic_tokens(t) for t in rows]
    assert run(spark, rows, lambda c: T.basic_token_array(c, lower=False)) == [
        plain.basic_tokens(t, lower=False) for t in rows]


def test_accent_folding(spark):
    rows = [chr(p) for p in range(0x80, 0x3100) if plain.category(chr(p)) not in ("Cn", "Cs")]
    rows += ["한국어 é", "각", "क़́x", "Å"]
    import unicodedata

    want = ["".join(c for c in unicodedata.normalize("NFD", t) if plain.category(c) != "Mn") for t in rows]
    assert run(spark, rows, strip_accents) == want


def test_normalisation_matches_plain_python(spark):
    rows = texts()
    for lower in (False, True):
        got = run(spark, rows, lambda c: T.normalize_question(c, lower))
        assert got == [plain.normalize(t, lower) for t in rows]


def test_standardise_matches_plain_python(spark):
    rows = [re.sub("[ \u0000]", "", t) for t in texts()]
    assert run(spark, rows, T.standardize_text) == [plain.standardize(t) for t in rows]


def test_character_and_separator_tokens(spark):
    assert run(spark, [" ab c. "], lambda c: T.word_token_array(c, delimiter="")) == [["a", "b", " ", "c", "."]]
    assert run(spark, ["a.b|c d|"], lambda c: T.word_token_array(c, delimiter="|")) == [["a", ".", "b", "c d"]]
    assert run(spark, ["\U00020000b"], lambda c: T.word_token_array(c, delimiter="")) == [["\U00020000", "b"]]
    assert run(spark, [""], lambda c: T.word_token_array(c, add_eos=True)) == [["<eos>"]]


def test_standardised_text_keeps_runs_of_one_sign_and_single_blanks(spark):
    text = "a--~b  c\t\u00a0d e\u00a0f **!! \\\\ || __ x\n \n y"
    row = spark.createDataFrame([(text,)], "t string").select(T.standardize_text(F.col("t"))).first()
    assert row[0] == "a -- ~ b c d e f ** !! \\\\ || __ x \n y"


def test_repair_looks_at_the_text_of_each_round(spark):
    def damaged(t, times):
        for _ in range(times):
            t = t.encode().decode("latin-1")
        return t

    rows = [(n, damaged("«über» schön – naïve Ärger", n)) for n in range(4)] + [(9, "Ãber NÄ» ok"), (10, None)]
    got = dict(spark.createDataFrame(rows, "n int, t string").select("n", repair_text(F.col("t"))).collect())
    assert all(got[n] == "«über» schön – naïve Ärger" for n in range(4)) and got[9] == "Ãber NÄ» ok" and got[10] is None
