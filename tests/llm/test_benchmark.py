import hashlib
import re

import pytest

from faqloom.llm import common, decontaminate
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, size=10):
    ws, hit, names = words(text), set(), set()
    for item, item_text in items:
        iw = words(item_text)
        n = min(size, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        at = [i for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in grams] if grams else []
        hit |= {p for i in at for p in range(i, i + n)}
        if at and item is not None:
            names.add(str(item))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def items(rows):
    long = next(r[1] for r in rows if len(words(r[1])) > 60)
    passage = " ".join(words(long)[5:40])
    return [(1, passage), (20, passage.upper() + " and more words that nobody has"), (3, "two, words!"), (4, "tie tie"), (5, None),
            (6, " .,; "), (None, "one"), (3, "tie  tie tie"), (7, "never seen anywhere"), (11, "中文 😀 end")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_report(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rows = cases.rows()
    known = items(rows)
    bench = spark.createDataFrame(known, "item_id bigint, text string")
    got = decontaminate.report(cases.docs(spark), bench).collect()
    want = sorted(str((d, *plain(t, known))) for d, t, *_ in rows)
    assert sorted(str((g.doc_id, g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated)) for g in got) == want
    assert any(g.n_items > 1 for g in got)


def test_whole_windows_only(spark):
    known = [(1, " ".join(f"w{i}" for i in range(30)))]
    bench = spark.createDataFrame(known, "item_id bigint, text string")
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 9), (3, 13), (0, 30), (21, 30), (20, 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {g.doc_id: g.n_hit for g in decontaminate.report(docs, bench).collect()}
    assert got == {0: 0, 1: 10, 2: 30, 3: 0, 4: 10}


def test_clean(spark):
    rows = cases.rows()
    known = items(rows)
    bench = spark.createDataFrame(known, "item_id bigint, text string")
    docs = cases.docs(spark)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((d, t)) for d, t, *_ in rows if not plain(t, known)[4])
    cut = decontaminate.clean(docs, bench, remove="spans").collect()
    assert len(cut) == len(rows)
    free = {str((d, t)) for d, t, *_ in rows if not plain(t, known)[4]}
    assert free <= {str((r.doc_id, r.text)) for r in cut}
    assert sum(len(words(r.text)) for r in cut) == sum(plain(t, known)[0] - plain(t, known)[1] for _, t, *_ in rows)


def test_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(g.contaminated for g in decontaminate.report(cases.docs(spark), bench).collect())
    assert decontaminate.report(cases.none(spark), bench).count() == 0
    assert decontaminate.clean(cases.none(spark), bench).count() == 0


def test_no_python_in_the_plan(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = decontaminate.report(cases.docs(spark), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
