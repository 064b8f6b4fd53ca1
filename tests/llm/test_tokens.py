import public_tokenizers
from tokenizers import Tokenizer

from faqloom.llm import token_counts
from faqloom.session import scratch_path
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text, tokenizer):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_and_cache(spark):
    rows = cases.rows() + [(9001, "a <|endoftext|> b<|endoftext|>", "", "", 0, 0, "", "", 0, ""), (9002, "it's 'tis  2024!\n\n x", "", "", 0, 0, "", "", 0, "")]
    docs = spark.createDataFrame(rows, cases.DOCS)
    tokenizer, cache = Tokenizer.from_file(PATH), scratch_path(spark, "token-cache-test")
    want = sorted(str((d, len((t or "").encode()), plain(t, tokenizer), plain(t, tokenizer) > 512)) for d, t, *_ in rows)
    for _ in range(2):
        got = token_counts.token_counts(docs, PATH, cache).collect()
        assert sorted(str(tuple(g)) for g in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})  # each text once, and nothing was added by the second run
    more = spark.createDataFrame([(1, rows[0][1]), (2, "new text")], "doc_id bigint, text string")
    token_counts.token_counts(more, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    other = token_counts.token_counts(more, public_tokenizers.path("word_bpe_49k.json"), cache).collect()
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((g.doc_id, g.n_tokens) for g in other) == [(1, plain(rows[0][1], words)), (2, plain("new text", words))]


def test_pieces_count_as_the_whole():
    tokenizer = Tokenizer.from_file(PATH)
    text = " ".join(["Don't stop", "it's 12 a b", "naïve  café", "x\n\ny z", "<|endoftext|>", "...!? ok"] * 400)
    parts = list(token_counts.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(plain(p, tokenizer) for p in parts) == plain(text, tokenizer)
    assert list(token_counts.pieces("no_blank" * 100, 10)) == ["no_blank" * 100]


def test_nothing(spark):
    assert token_counts.token_counts(cases.none(spark), PATH, scratch_path(spark, "token-cache-none")).count() == 0
