import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faqloom.llm import byte_pairs as B
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = B.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RANKS, public_tokenizers.PATTERN)


def plain(text):
    text = text or ""
    ids = LIBRARY.encode_ordinary(text)
    return len(ids), *(hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode()))


def awkward(seed=3, size=20_000):
    r = random.Random(seed)
    some = ["don't", "''s", " 're ", "x" * 700, " " * 400, "\n\n \t", "12345" * 90, "!?" * 200, "'", "ÄÖ", "中文字", "😀", "a b", "\x1c\x85", "'ll'll"]
    return "".join(r.choice(some) for _ in range(size // 60))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(text):
    assert ENCODER.ids(text).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é'", min_size=1, max_size=300))
def test_long_pieces_merge_as_short_ones(text):
    raw = text.encode()
    assert B.merge_long(raw, RANKS) == LIBRARY._encode_single_piece(raw) if raw not in RANKS else True


def test_classes_cover_every_character():
    every = "".join(f"a{chr(i)}1" for i in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 101)])
    assert ENCODER.ids(every).tolist() == LIBRARY.encode_ordinary(every)


@pytest.mark.parametrize("size, overlap", [(1 << 15, 256), (97, 31), (40, 40), (16, 5)])
def test_digests(spark, size, overlap):
    rows = cases.rows(n=12) + [(7001, awkward(), "", "", 0, 0, "", "", 0, ""), (7002, "A" * 3000 + " b", "", "", 0, 0, "", "", 0, ""),
                               (7003, awkward(), "", "", 0, 0, "", "", 0, ""), (7004, " " * 900 + "x", "", "", 0, 0, "", "", 0, "")]
    if size < 50:
        rows = [r for r in rows if len(r[1] or "") < 30_000]
    got = B.digests(spark.createDataFrame(rows, cases.DOCS).repartition(3), RANKS, public_tokenizers.PATTERN, size, overlap)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], *plain(r[1]))) for r in rows)


def test_parts_of_a_long_text(spark):
    text = awkward(9, 6000)
    short, long_, parts = B.encode(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), RANKS,
                                   public_tokenizers.PATTERN, 128, 32)
    assert short.count() == 0 and long_.count() == 2 and long_.select("text_key").distinct().count() == 1
    got = sorted((p.part, p.ids) for p in parts.collect())
    assert len(got) > 10 and [i for _, ids in got for i in ids] == LIBRARY.encode_ordinary(text)
    back = b"".join(r.bytes for r in B.decode(parts, RANKS).orderBy("part").collect())
    assert back.decode() == text


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="ranks do not have"):
        B.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), RANKS).collect()


def test_nothing(spark):
    assert B.digests(cases.none(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    from faqloom.llm.queries import QUERIES

    root = "/root/testdata/sf0.001"
    want = [(r.doc_id, *plain(r.text)) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_byte_pairs"](spark, root).collect())) == sorted(want)
