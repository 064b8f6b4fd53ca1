import random

import pytest
from pyspark.sql import functions as F

from faqloom.functions.repair import repair_text
from faqloom.functions.segment import segment_words


def run(spark, rows, fn):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.x for r in table.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


SEGMENTS = {
    "I don't think we can't, won't.": "I do n't think we ca n't , wo n't .",
    "Mr. Smith's dog (the U.S. one) isn't well-known...": "Mr. Smith 's dog ( the U.S. one ) is n't well - known ...",
    "\"Hello,\" she said: 'go!'": "\" Hello , \" she said : ' go ! '",
    "See https://a.b/c?d=1, or www.x.org/y-z; mail bo.b@x.co.uk!": "See https://a.b/c?d=1 , or www.x.org/y-z ; mail bo.b@x.co.uk !",
    "3.5% of $1,000 at 10:30 a.m.": "3.5 % of $ 1,000 at 10:30 a.m.",
    "cannot gonna and/or end.Start x,y": "can not gon na and / or end . Start x , y",
    "“Quoted” … l'été they'll we’ve": "“ Quoted ” … l'été they 'll we ’ve",
    "O'Neil rock'n'roll don'té": "O'Neil rock'n'roll don'té",
    "x": "x", "": "", " \t ": "", "((": "( (", "...": "...",
}


def test_segments(spark):
    assert run(spark, [*SEGMENTS, None], segment_words) == [*(v.split(" ") if v else [] for v in SEGMENTS.values()), None]


def test_segments_keep_every_sign(spark):
    r = random.Random(3)
    rows = ["".join(r.choice(["a", "Bc", "'", ".", ",", "-", " ", "n't", "'s", "(", "”", "3", "/", "é", "\n", "…"]) for _ in range(30)) for _ in range(200)]
    for text, tokens in zip(rows, run(spark, rows, segment_words)):
        assert "".join(tokens) == "".join(text.split()) and all(tokens)


WHOLE = ["café", "naïve “quotes” – dash €", "Привет мир", "emoji 😀 ok", "日本語", "MARQUÉ® «NÄ» SÃO Ñ»", "plain", "", "Ã", "â€", "Ελλάδα", "שלום", "Łódź ěščř"]


def damaged(text, times, code):
    for _ in range(times):
        text = text.encode().decode(code)
    return text


@pytest.mark.parametrize("times", [0, 1, 2])
def test_repair_gives_the_text_back(spark, times):
    assert run(spark, [damaged(t, times, "latin-1") for t in WHOLE], repair_text) == WHOLE


def test_repair_of_windows_text(spark):
    rows = ["It’s “so” — €5…", "déjà vu", "Fußgänger", "œuvre"]
    assert run(spark, [damaged(t, 1, "cp1252") for t in ("It’s — €5…", "Fußg", "œuvre")], repair_text) == ["It’s — €5…", "Fußg", "œuvre"]
    assert run(spark, [*rows, None], repair_text) == [*rows, None]


def test_repair_of_long_runs(spark):
    text = "日本語中文" * 20_000  # one run of 100,000 sequences
    plan = spark.createDataFrame([(damaged(text, 1, "latin-1"),)], "t string").select(repair_text(F.col("t")).alias("x"))
    assert plan.first().x == text and "Python" not in plan._jdf.queryExecution().toString()
