import random

import pytest
from pyspark.sql import functions as F

from faqloom.operators import augment as A
from faqloom.operators import ordering as O
from faqloom.operators import splits as P
from faqloom.plans.rows import log_lines
from faqloom.sources import files as L
from faqloom.sources.tables import faq_pairs


def test_running_total_does_not_depend_on_partitions(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 9)}", i, rnd.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    want, so_far = {}, {}
    for g, k, v in rows:
        want[k] = so_far.get(g, 0)
        so_far[g] = want[k] + v
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        cut = O.quantile_buckets(df, "k")
        got = O.running_total(cut, F.col("v"), ["k"], ["bucket"], "before", group=["g"], group_total="all").collect()
        assert {r.k: r.before for r in got} == want and all(r.all == so_far[r.g] for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_sample_and_splits(spark):
    df = spark.range(1000)
    ranked = {r.id: r.position for r in O.random_rank(df, ["id"], 42).collect()}
    assert sorted(ranked.values()) == list(range(1000))
    for n in (0, 1, 333, 1000):
        got = {r.id for r in P.sample_n(df, ["id"], n).collect()}
        assert got == {i for i, at in ranked.items() if at < n}
    with pytest.raises(Exception, match="cannot draw"):
        P.sample_n(df, ["id"], 1001).collect()
    exact = P.split_exact(df.limit(999), ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in exact} == {"train": 599, "dev": 200, "test": 200}
    small = {r.id: r.split for r in P.split_hash(df.filter("id < 100"), ["id"]).collect()}
    assert small.items() <= {r.id: r.split for r in P.split_hash(df, ["id"]).collect()}.items()
    order = [r.id for r in P.shuffle_rows(df, ["id"]).collect()]
    assert order == sorted(ranked, key=ranked.get)


def test_match_keys_like_brute_force(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 60))) for _ in range(150)] + ["common start " + str(i) for i in range(80)]
    keys = {t[i : i + k] for t in rnd.sample(texts, 60) for i in [rnd.randint(0, 5)] for k in (1, 3, 5, 9, 17, 40)} - {""}
    keys |= {"zzz", "common start ", "a.b", "%"}
    kd = spark.createDataFrame([(k,) for k in keys], "key string")
    td = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    got = {(r.key, r.text_id) for r in A.match_keys(kd, td).collect()}
    assert got == {(k, i) for k in keys for i, t in enumerate(texts) if k in t}


def test_sections(spark):
    log = [
        (0, " preface"), (0, "'Permutations of 'how to pay':"), (0, "Found 2"), (0, " 'pay how"), (0, "to pay"), (0, " "),
        (0, "=================="), (0, "Permutations of 'cut off':"), (0, "Found 1"), (0, "x"),
        (0, "Permutations of 'again':"), (0, "Found"), (0, "old"), (0, "=========="),
        (1, "Permutations of 'again':"), (1, "Found"), (1, "new"), (1, "newer"), (1, "=========="),
    ]
    n = {}
    rows = [(f, n.setdefault(f, []).append(0) or len(n[f]) - 1, line) for f, line in log]
    df = spark.createDataFrame(rows, "file long, line_no long, line string")
    blocks = A.section_blocks(df)
    assert {(r.key, r.file, r.n_lines) for r in blocks.collect()} == {("how to pay", 0, 3), ("again", 1, 2)}
    body = A.section_variants(df, blocks).orderBy("key", "line_no").collect()
    assert [(r.key, r.variant) for r in body] == [
        ("again", "new"), ("again", "newer"), ("how to pay", "pay how"), ("how to pay", "to pay"), ("how to pay", "")]


def test_a_repeated_key_keeps_its_first_place(spark):
    heads = ["pay", "how", "pay"]
    log = [(0, 4 * i + j, x) for i, k in enumerate(heads) for j, x in enumerate((f"Permutations of '{k}':", "Found", f"{k} {i}", "=" * 12))]
    blocks = A.section_blocks(spark.createDataFrame(log, "file long, line_no long, line string"))
    assert {(r.key, r.block, r.first_block) for r in blocks.collect()} == {("pay", 2, 0), ("how", 1, 1)}
    found = A.match_keys(blocks.select("key"), spark.createDataFrame([(1, "how to pay")], "text_id long, text string"))
    got = A.unique_key_matches(found, blocks.select("key", "first_file", "first_block")).collect()
    assert [(r["class"], r.key) for r in got] == [(1, "how")]


def test_log_files_go_by_number(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"output_success_{n}.txt").write_text(f"Permutations of 'same':\nFound\nfrom {n}\n==========\n")
    log = L.log_files(spark, str(tmp_path / "*.txt"))
    assert sorted({r.file for r in log.collect()}) == list(range(12))
    assert A.section_blocks(log).select("file", "first_file").collect() == [(11, 0)]


def test_long_replies_and_conversations_have_names_of_their_own(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2400)] + [
        (2, 0, "user", "other"), (2, 1, "assistant", "\n".join(f"l{i}" for i in range(100_001))), (2, 2, "user", "next"), (2, 3, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = faq_pairs(spark, str(tmp_path))
    assert pairs.count() == pairs.select("faq_id").distinct().count() == 1202
    blocks = A.section_blocks(log_lines(spark, str(tmp_path))).collect()
    assert len(blocks) == 1202 and {r.n_lines for r in blocks} == {1, 100_001}


def test_unique_matches_and_draws(spark):
    matches = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("c", 3)], "key string, text_id long")
    place = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9)], "key string, first_block int")
    got = A.unique_key_matches(matches, place).collect()
    assert [(r["class"], r.key) for r in got] == [(1, "b")]
    variants = spark.createDataFrame([(1, 0, " v0 "), (1, 1, "v1")], "class long, line_no long, variant string")
    questions = spark.createDataFrame([(1, "one"), (2, "two")], "class long, question string")
    rows = A.permute_augment(questions, A.number_variants(variants), sample=50, permutations=3).collect()
    assert len(rows) == 100
    for r in rows:
        first, *others = r.question.split(" ")
        assert first in (("v0", "v1") if r["class"] == 1 else ("two",)) and set(others) <= {"v0", "v1"}
        assert r.classes == [r["class"], 1, 1]
    assert {r.question.split(" ")[0] for r in rows if r["class"] == 1} == {"v0", "v1"}


def test_draws_are_neither_grouped_nor_sorted_again(spark):
    variants = spark.createDataFrame([(1, 0, " v0 "), (1, 1, "v1"), (3, 0, "w")], "class long, line_no long, variant string")
    questions = spark.createDataFrame([(1, "one"), (2, "two"), (2, None), (3, "x")], "class long, question string")
    rows = A.permute_augment(questions, A.number_variants(variants), sample=20)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "draw" in line], plan
    got = rows.collect()
    assert len(got) == 80 and {r.draw for r in got} == set(range(20))
    for r in got:
        if r["class"] == 2:  # asked twice: the slots of both, and the question where there is no variant
            assert r.classes[:2] == [2, 2] and r.classes[2] == r.classes[3] and r.question.split()[:-2] in ([], ["two", "two"])
        else:
            assert len(r.classes) == 2 and r.question.split()[0] in {1: ("v0", "v1"), 3: ("w",)}[r["class"]]


def test_draws_do_not_cross_the_network(spark, monkeypatch):
    """Parts of few classes, few draws at a time: the same rows as by hand, and no shuffle behind the draws."""
    from hashlib import md5

    for name, value in (("PART_BYTES", 60), ("DRAWS_TOGETHER", 70), ("BATCH_CLASSES", 1)):
        monkeypatch.setattr(A, name, value, raising=False)
    kinds = {f"c{c}": [f"v{c}.{i}" if (c + i) % 5 else None for i in range(1 + c % 4)] for c in range(12)}
    variants = spark.createDataFrame(
        [(c, i, len(v), t) for c, v in kinds.items() for i, t in enumerate(v)] + [(None, 0, 1, "lost")], "class string, idx long, n long, variant string")
    asked = [(f"c{c}", f"q{c}") for c in range(3, 15)]
    rows = A.permute_augment(spark.createDataFrame(asked, "class string, question string"), variants, sample=20, permutations=3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "class_no" not in plan

    def u(*keys):
        return int(md5("|".join(map(str, (42, *keys))).encode()).hexdigest()[:8], 16) / 2**32

    order = sorted([*kinds, None], key=lambda c: (md5("|".join(["42"] + [c] * (c is not None)).encode()).hexdigest(), c or ""))
    want = []
    for c, question in asked:
        for d in range(20):
            picks = [order[int(u(c, d, slot, "class") * len(order))] for slot in (1, 2)]
            if None in picks:  # a class without a name is numbered and never met
                continue
            own = kinds[c][int(u(c, d, 0, "variant") * len(kinds[c]))] if c in kinds else question
            words = [own] + [kinds[p][int(u(c, d, s, "variant") * len(kinds[p]))] for s, p in enumerate(picks, 1)]
            want.append((c, d, [c, *picks], " ".join(w for w in words if w is not None)))
    assert sorted(map(tuple, rows.collect())) == sorted(want) and 150 < len(want) < 240
