from pyspark.sql import functions as F

from faqloom.operators import urls as U
from faqloom.operators import vocab as V
from faqloom.sources import files as R
from faqloom.sources import sinks as W


def test_line_numbers_across_splits(spark, tmp_path):
    want = []
    for name in ("a.txt", "b.txt"):
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(3000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += [(name, i, t) for i, t in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = R.file_lines(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in got) == sorted(want)
    flat = {r.line_no: r.line for r in R.numbered_lines(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [flat[i] for i in range(6000)] == [t for *_, t in want]


def test_answers_vocabulary_and_merges(spark, tmp_path):
    (tmp_path / "answers.txt").write_text("first\n\n  \nsecond\n")
    got = R.answer_lines(spark, str(tmp_path / "answers.txt")).orderBy("label_id").collect()
    assert [(r.label_id, r.answer) for r in got] == [(0, "first"), (1, "second")]
    (tmp_path / "vocab.txt").write_text("a\nb \na\n")
    rows = V.vocab_from_lines(R.numbered_lines(spark, str(tmp_path / "vocab.txt"))).collect()
    assert {r.token: r.id for r in rows} == {"a": 2, "b": 1}
    (tmp_path / "words.txt").write_text("<unk> 9\nb 3\nb 1\nc\n")
    words = V.vocab_from_first_field(R.numbered_lines(spark, str(tmp_path / "words.txt")))
    assert {r.token: r.id for r in words.collect()} == {"<unk>": 0, "b": 1, "c": 2}
    (tmp_path / "merges.txt").write_text("#version: 0.2\nl o\nlo w</w>\n")
    merges = R.merge_file(spark, str(tmp_path / "merges.txt")).orderBy("rank").collect()
    assert [tuple(r) for r in merges] == [("l", "o", 0), ("lo", "w</w>", 1)]
    (tmp_path / "vocab.json").write_text('{"low</w>": 0, "l": 1}')
    assert {tuple(r) for r in R.json_vocab(spark, str(tmp_path / "vocab.json")).collect()} == {("low</w>", 0), ("l", 1)}
    (tmp_path / "faq.json").write_text('{"Q1": {"question": "q", "answer": "a"}}\nnot json\n')
    assert [tuple(r) for r in R.faq_json(spark, str(tmp_path / "faq.json")).collect()] == [("Q1", "q", "a")]


def test_labelled_csv_with_quotes_and_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text(',class,question\n0,"[3, 17]","say ""hi""\nthere"\n1,[2],plain\n')
    rows = R.labelled_csv(spark, str(tmp_path / "q.csv")).orderBy("guid").collect()
    assert [(r.guid, r.labels, r.question) for r in rows] == [(0, [3, 17], 'say "hi"\nthere'), (1, [2], "plain")]


def test_cached_table_survives_a_half_written_one(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    def get(n):
        return W.cached_table(spark, str(tmp_path), {"n": n}, build).count()

    assert get(1) == 3 and get(1) == 3 and len(calls) == 1
    assert get(2) == 3 and len(calls) == 2
    half = [p for p in tmp_path.iterdir()][0]
    broken = tmp_path / "other" / half.name
    (broken / "_temporary").mkdir(parents=True)
    assert W.cached_table(spark, str(tmp_path / "other"), {"n": 1}, build).count() == 3


def test_url_keys(spark):
    rows = spark.createDataFrame([("a", None, "s3://b/x/y.tar.GZ"), ("a", "", "https://h/.hid")], "url string, etag string, p string")
    got = rows.select(U.cache_key(F.col("url"), F.col("etag")), U.file_extension(F.col("p")), *U.bucket_and_path(F.col("p"))).collect()
    digest = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    assert [tuple(r) for r in got] == [(digest, ".gz", "b", "x/y.tar.GZ"), (digest, "", "h", ".hid")]
    assert U.url_index(rows.limit(0).withColumn("page_id", F.lit(1)), "page_id").count() == 0


def test_half_written_cache_is_built_again(spark, tmp_path):
    import os
    import shutil

    calls = []

    def build():
        calls.append(1)
        return spark.range(40).repartition(4)

    params = {"input": "numbers"}
    assert W.cached_table(spark, str(tmp_path), params, build).count() == 40
    assert W.cached_table(spark, str(tmp_path), params, build).count() == 40 and len(calls) == 1
    path = next(tmp_path.iterdir())
    os.remove(path / "_SUCCESS")
    os.remove(next(path.glob("part-*")))
    assert W.cached_table(spark, str(tmp_path), params, build).count() == 40 and len(calls) == 2
    shutil.rmtree(path)
    (path).mkdir()
    (path / "part-0.parquet").write_text("broken")
    assert W.cached_table(spark, str(tmp_path), params, build).count() == 40


def test_streams_read_folders_and_files(spark, tmp_path):
    from faqloom.streaming import jobs as J

    spark.range(100).selectExpr("id doc_id", "'a b' text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = str(tmp_path / "counts")
    J.count_tokens(J.table_stream(spark, str(tmp_path), "documents"), out, str(tmp_path / "state"))
    assert {r.token: r.n for r in J.latest_counts(spark, out).collect()} == {"a": 100, "b": 100}
    single = next((tmp_path / "documents.parquet").glob("part-*"))
    one = tmp_path / "one"
    one.mkdir()
    single.rename(one / "documents.parquet")
    n = spark.read.parquet(str(one / "documents.parquet")).count()
    J.count_tokens(J.table_stream(spark, str(one), "documents"), str(one / "counts"), str(one / "state"))
    assert {r.token: r.n for r in J.latest_counts(spark, str(one / "counts")).collect()} == {"a": n, "b": n}


def test_byte_pair_ids_give_the_texts_back(spark):
    """Every symbol has an id of its own: decoding gives each standardised document back, whatever characters it holds."""
    import __spark_entry__ as entry

    root, queries = "/root/testdata/sf0.001", entry.queries()
    whole = {r.doc_id: r.text for r in queries["decode_text_pieces"](spark, root).collect()}
    assert {r.doc_id: r.text for r in queries["bpe_decode"](spark, root).collect()} == whole and len(whole) > 100
    ids = queries["bpe_encode_ids"](spark, root)
    assert ids.filter("id = 0").count() == 0  # kept for what is unknown


def test_cache_names_follow_the_input(spark, tmp_path):
    """The digest of a table's files: the same for the same files, another one for other data under the same path."""
    from faqloom.sources.tables import input_files

    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    first = input_files(spark.read.parquet(path))
    assert first == input_files(spark.read.parquet(path))
    spark.range(6).write.mode("overwrite").parquet(path)
    assert first != input_files(spark.read.parquet(path))
