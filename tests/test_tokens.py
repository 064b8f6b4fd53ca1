import random

import pytest
from pyspark.sql import functions as F

from faqloom.operators import lookup as lookup_module
from faqloom.operators import tokens as K
from faqloom.operators import vocab as V
from faqloom.operators.lookup import lookup
from tests import plain


def words_df(spark, words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")


def vocab_df(spark, tokens):
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def test_wordpiece_golden_and_random(spark):
    vocab = ["[UNK]", "un", "##aff", "##able", "a", "##a", "b", "##b", "##ab", "ab", "ba", "##bab", "é", "##é"]
    rnd = random.Random(1)
    words = {"unaffable", "unaffx", "x" * 101, "ab" * 50, "ab" * 51, "[UNK]"}
    words |= {"".join(rnd.choice("abbaéx"[: rnd.choice([2, 5, 6])]) for _ in range(rnd.randint(1, 12))) for _ in range(300)}
    got = K.wordpiece_dictionary(words_df(spark, sorted(words)), vocab_df(spark, vocab), 6).collect()
    assert {r.word: r.pieces for r in got} == {w: plain.wordpiece(w, set(vocab)) for w in words}
    assert all([vocab.index(p) for p in r.pieces] == r.ids for r in got)


def test_bpe_golden_and_random(spark):
    rnd = random.Random(2)
    symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    merges = [("l", "o"), ("lo", "w</w>")]
    while len(merges) < 40:
        left, right = rnd.choice(symbols), rnd.choice(symbols)
        if (left, right) in merges or left.endswith("</w>"):
            continue
        merges.append((left, right))
        symbols.append(left + right)
    rnd.shuffle(merges)
    ranks = {m: i for i, m in enumerate(merges)}
    words = {"low", "a", "aaa", "aaaa"} | {
        "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(300)}
    table = spark.createDataFrame([(a, b, i) for (a, b), i in ranks.items()], "left string, right string, rank int")
    got = K.bpe_dictionary(words_df(spark, sorted(words)), table, 40).collect()
    assert {r.word: r.pieces for r in got} == {w: plain.bpe(w, ranks) for w in words}


def test_vocab_golden(spark):
    rows = [(0, 0, i, t) for i, t in enumerate("b a a c b".split())]
    tokens = spark.createDataFrame(rows, "doc_id long, line_no int, pos int, token string")
    counted = V.counts_with_first_place(tokens, ["doc_id", "line_no", "pos"])
    small = V.build_vocab(counted, ["<eos>"], max_size=2, min_freq=1)
    assert sorted((r.id, r.token) for r in small.collect()) == [(0, "<eos>"), (1, "b"), (2, "a")]
    whole = V.build_vocab(counted, ["<eos>", "c"])
    assert sorted((r.id, r.token) for r in whole.collect()) == [(0, "<eos>"), (1, "c"), (2, "b"), (3, "a")]


def test_whole_vocab_ranks_like_most_common(spark):
    rnd = random.Random(5)
    rows = [(d, 0, p, f"t{int(rnd.paretovariate(0.6)) % 900}") for d in range(60) for p in range(80)]
    tokens = spark.createDataFrame(rows, "doc_id long, line_no int, pos int, token string")
    from collections import Counter

    counter = Counter(t for *_, t in rows)
    want = [t for t, _ in counter.most_common()]
    got = V.build_vocab(V.counts_with_first_place(tokens, ["doc_id", "line_no", "pos"])).orderBy("id").collect()
    assert [r.token for r in got] == want and [r.id for r in got] == list(range(len(want)))


@pytest.mark.parametrize("rows", [500_000, 10])
def test_lookup_with_one_hot_key(spark, monkeypatch, rows):
    monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(lookup_module, "HOT_KEYS", 5)
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    entries = spark.range(2500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.lit(1).alias("w"))
    entries = entries.unionByName(spark.createDataFrame([("hot", -1, 1000)], "k string, v long, w int"))
    got = {r.id: r.v for r in lookup(facts, entries, "k", ["v"], "w").collect()}
    want = {i: -1 if i % 3 == 0 else (i if i < 2500 else None) for i in range(3000)}
    assert got == want
    assert {r.id: r.v for r in lookup(facts, entries, "k", ["v"]).collect()} == want


def test_out_of_vocabulary_rules(spark):
    tokens = spark.createDataFrame([("a",), ("z",)], "token string")
    vocab = vocab_df(spark, ["<unk>", "a"])
    ids = lambda df: {r.token: r.id for r in df.collect()}
    assert ids(V.encode(tokens, vocab, "zero")) == {"a": 1, "z": 0}
    unk = V.id_of(vocab, V.require_unknown(vocab))
    assert ids(V.encode(tokens, vocab, "token", unknown_id=unk)) == {"a": 1, "z": 0}
    with pytest.raises(Exception, match="not in the vocabulary"):
        V.encode(tokens, vocab, "error").collect()
    with pytest.raises(Exception, match="out of vocabulary"):
        V.decode(spark.createDataFrame([(9,)], "id int"), vocab).collect()
    with pytest.raises(ValueError):
        V.require_unknown(vocab_df(spark, ["a"]))


def test_decode_text(spark):
    df = spark.createDataFrame([(["do</w>", "n't</w>", "stop</w>", ".</w>"],)], "t array<string>")
    assert df.select(V.pieces_to_text(F.col("t"), True)).first()[0] == "don't stop."
    assert df.select(V.words_to_text(F.col("t"))).first()[0] == "do</w> n't</w> stop</w> .</w>"


def test_large_dictionaries_meet_whole_lists(spark, monkeypatch):
    """Neither token rows nor heavy words cross the network: same ids and pieces as by a broadcast."""
    from faqloom.operators import corpora as C
    from faqloom.operators import lookup as L

    rows = [(i, " ".join(["the"] * (i % 4) + [f"w{j}" for j in range(i % 7)])) for i in range(60)] + [(99, None), (100, "")]
    lines = spark.createDataFrame(rows, "doc_id long, line string")
    vocab = spark.createDataFrame([("the", 1, 9)] + [(f"w{j}", j + 2, 1) for j in range(5)], "token string, id int, cnt long")
    want = sorted(map(tuple, C.encode_lines(lines, vocab, ["doc_id"], "token", 0).collect()))
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    got = C.encode_lines(lines, vocab, ["doc_id"], "token", 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_probe" not in plan
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="not in the vocabulary"):
        C.encode_lines(lines, vocab, ["doc_id"]).collect()
    pieces = spark.createDataFrame([("a", ["a", "b"]), ("c", [])], "token string, pieces array<string>")
    lists = spark.createDataFrame([(1, ["a", "c", "a"]), (2, []), (3, None), (4, ["z", None])], "k long, words array<string>")
    got = {r.k: r.got for r in L.lookup_lists(lists, "words", pieces, "token", "pieces", "got").collect()}
    assert got == {1: [["a", "b"], [], ["a", "b"]], 2: [], 3: None, 4: [None, None]}


def test_lists_are_packed_where_they_lie(spark, monkeypatch):
    from faqloom.operators import lookup as L

    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "PACK_ELEMENTS", 3)
    rows = [(i % 5, None if i % 11 == 0 else [["a", "b", None, "z"][(i * j) % 4] for j in range(i % 7)]) for i in range(60)]
    lists = spark.createDataFrame(rows, "k long, words array<string>").repartition(3)
    entries = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    got = L.lookup_lists(lists, "words", entries, "token", "id", "ids")
    assert "words" not in got._jdf.queryExecution().optimizedPlan().toString()  # lists themselves are not shuffled
    want = [(k, None if w is None else [{"a": 1, "b": 2}.get(t) for t in w]) for k, w in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_long_lists_are_answered_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from faqloom.operators import lookup as L

    monkeypatch.setattr(L, "PACK_ELEMENTS", 4)
    lists = [["a"] * n for n in (1, 3, 9, 0)] + [None] + [["b"] * n for n in (2, 2, 1)]
    few = list(L._few(pa.RecordBatch.from_pydict({"k": range(8), "words": lists}), "words"))
    assert [b.column("k").to_pylist() for b in few] == [[0, 1], [2], [3, 4, 5, 6], [7]]
    assert list(L._few(few[0].slice(0, 0), "words")) == []
    words = pa.table({"_key": ["a"], "_value": [7]})
    got = [x for b in few for x in L._filled(pa.Table.from_batches([b]), "words", ["k"], words, "ids").column("ids").to_pylist()]
    assert got == [w and [7 if t == "a" else None for t in w] for w in lists]


def test_tasks_follow_the_size_of_the_files(spark, monkeypatch, tmp_path):
    from faqloom import session
    from faqloom.sources.tables import documents

    spark.range(2000).selectExpr("id AS doc_id", "sha2(string(id), 256) AS text").write.parquet(f"{tmp_path}/a b/documents.parquet")
    monkeypatch.setattr(session, "TASK_BYTES", 500)
    assert documents(spark, f"{tmp_path}/a b", regroup=True).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_byte_pairs_by_lists_are_those_by_broadcast(spark, monkeypatch, tmp_path):
    from faqloom.operators import lookup as L
    from faqloom.plans import text as T

    rows = [(i, " ".join(f"lower{j} newest, wide{j % 3}" for j in range(i % 5))) for i in range(20)] + [(50, None), (51, ""), (52, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = (T.bpe, T.bpe_encode_ids, T.bpe_decode, T.encode_strict)
    want = [sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in queries]
    assert T.bpe_texts(spark, str(tmp_path)).columns == ["doc_id", "words"]  # worked out once for all of them
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert [sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in queries] == want and all(want)


def test_large_piece_tables_meet_whole_lines(spark, monkeypatch, tmp_path):
    """Token rows do not cross the network to meet their pieces, also where documents repeat."""
    from faqloom.operators import lookup as L
    from faqloom.plans import text as T

    rows = [(i, " ".join(f"lower{j} newest, wide{j % 3}" for j in range(i % 5)) + "\n\nend") for i in range(20)]
    rows += [(3, "lower1 newest"), (3, "lower1 newest"), (50, None), (51, ""), (52, "one " + "x" * 120), (None, "wide1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = (T.wordpiece, T.drop_stopwords)
    want = [sorted(map(repr, map(tuple, q(spark, str(tmp_path)).collect()))) for q in queries]
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert "_probe" not in T.wordpiece(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert [sorted(map(repr, map(tuple, q(spark, str(tmp_path)).collect()))) for q in queries] == want and all(want)


def test_byte_pair_texts_are_not_sorted_together_from_pieces(spark, tmp_path):
    """Texts are read off whole lists; documents of one number are merged by place, as their rows would be."""
    from faqloom.plans import text as T

    rows = [(i, " ".join(f"lower{j} newest, wide{j % 3}" for j in range(i % 5))) for i in range(20)] + [(50, None), (51, ""), (52, "<s> one")]
    for name, extra in (("once", []), ("twice", [(4, "lower newest"), (3, None), (6, rows[6][1]), (None, "a b"), (None, "cd")])):
        root = f"{tmp_path}/{name}"
        spark.createDataFrame(rows + extra, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
        by_rows = V.gather(T.bpe(spark, root), "token", ["doc_id"], ["pos", "piece_no"], "tokens")
        want = by_rows.select("doc_id", V.pieces_to_text(F.col("tokens"), tidy=True)).collect()
        for query in (T.decode_text_pieces, T.bpe_decode):
            got = query(spark, root)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" not in plan and ("collect_list" in plan) == (name == "twice")
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want))) and len(want) > 15


def test_counts_of_lists_are_those_of_rows(spark):
    """Sums and first places without a row per token, also for repeated and missing document numbers."""
    import pyarrow as pa

    rows = [(i % 5 if i % 7 else None, i % 3, [f"w{j * i % 4}" for j in range(i % 6)]) for i in range(60)] + [(9, 0, None)]
    lists = spark.createDataFrame(rows, "doc_id long, line_no int, tokens array<string>").repartition(4)
    tokens = lists.select("doc_id", "line_no", F.posexplode("tokens").alias("pos", "token"))
    want = V.counts_with_first_place(tokens, ["doc_id", "line_no", "pos"])
    got = V.counts_of_lists(lists, ["doc_id", "line_no"])
    assert sorted(got.collect()) == sorted(want.collect())
    part = pa.Table.from_pydict({"d": [3, None, 1], "tokens": [["a", "b"], [], ["b", "a", "b"]]})
    counted = [b.to_pylist() for b in V._counted(iter(part.to_batches()), ["d"], "tokens")]
    assert sorted(tuple(r.values()) for b in counted for r in b) == [(1, 0, "b", 3), (1, 1, "a", 2)]


def test_lines_are_not_sorted_together_from_tokens(spark, tmp_path):
    from faqloom.plans import text as T

    rows = [(i, "b", f"one two {i}\n\nTwo one <eos> two") for i in range(9)]
    for name, extra in (("once", []), ("twice", [(4, "c", "two\none"), (4, "c", None)])):
        root = f"{tmp_path}/{name}"
        spark.createDataFrame(rows + extra, "doc_id long, source string, text string").write.parquet(f"{root}/documents.parquet")
        df = T.decode_text(spark, root)
        assert ("collect_list" in df._jdf.queryExecution().toString()) == (name == "twice")
        got = {(r.doc_id, r.line_no): r.text for r in df.collect()}
        assert len(got) == 18 + (name == "twice") and got[3, 2] == "two one two"
        assert got.get((4, 1)) == (None if name == "once" else "one")
        assert got[4, 0] == ("one two <unk>" if name == "once" else "one two two <unk>")


def test_training_tokens_are_dealt_out(spark, tmp_path, monkeypatch):
    """A file of one row group has many splits and one task with rows."""
    from faqloom.plans import training as R

    rows = [(i, f"text {i}" * 50, "en", "s") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stop(spark, root, name, build):
        seen.append(build().select(F.spark_partition_id()).distinct().count())
        raise StopIteration

    monkeypatch.setattr(R, "made_once", stop)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(StopIteration):
            R.trained(spark, str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen[0] > 1


def test_counts_of_a_part_do_not_move_its_words():
    """Words are coded where they lie: at most one copy of a part's words is made, and first places go by the order of the places."""
    import pyarrow as pa

    made = pa.Table.from_pydict({"d": [3, None, 1, 2, 1], "l": [0, 0, 5, 0, 4], "tokens": [["a", "b"], [], ["b", "a", "b"], None, ["c", "b"]]})
    parts = pa.concat_tables([made.slice(0, 2), made.slice(2)])
    got = sorted(tuple(r.values()) for r in V._part_counts(parts, ["d", "l"], "tokens").to_pylist())
    assert got == [(1, 4, 0, "c", 1), (1, 4, 1, "b", 4), (1, 5, 1, "a", 2)]
    words = pa.array([f"{i % 50:040}" for i in range(300_000)])
    rows = pa.Table.from_arrays([pa.array(range(3000, 0, -1)), pa.ListArray.from_arrays(pa.array(range(0, 300_001, 100), pa.int32()), words)], ["d", "tokens"])
    before = pa.default_memory_pool()
    watched = pa.proxy_memory_pool(before)
    pa.set_memory_pool(watched)
    try:
        V._part_counts(rows, ["d"], "tokens")
    finally:
        pa.set_memory_pool(before)
    assert watched.max_memory() < 1.5 * rows.nbytes


def test_lists_are_filled_in_the_task(spark, monkeypatch):
    """Elements that the dictionary lacks get their value where the others do, and no list is built a second time."""
    from faqloom.operators import corpora as C
    from faqloom.operators import lookup as L

    lists = spark.createDataFrame([(1, ["a", "z", None]), (2, []), (3, None), (4, ["b"])], "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    for rows in (L.BROADCAST_ROWS, 0):
        monkeypatch.setattr(L, "BROADCAST_ROWS", rows)
        for rule, number, want in (("token", 9, [5, 9, 9]), ("zero", None, [5, 0, 0])):
            df = C.encode_lists(lists, vocab, rule, number)
            assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
            assert sorted(map(tuple, df.collect())) == [(1, want), (4, [6])]


def test_large_shared_tables_are_packed_tight(spark, tmp_path):
    from faqloom.plans import text as T

    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert all(".zstd." in f for f in T.line_tokens(spark, str(tmp_path)).inputFiles())
