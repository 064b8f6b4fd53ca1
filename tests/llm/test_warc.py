import base64
import gzip
import hashlib
import random

import pytest

from faqloom.llm import warc
from faqloom.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, data string, last int, chunk_no string"


def rows():
    r = random.Random(2)
    texts = ["".join(r.choice("abc é中😀\r\n") for _ in range(r.randint(1, 400))) for _ in range(40)]
    texts += [texts[0]] * 5 + [None, "", None, "x" * 5000, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"]
    out = [(100 - i, f"http://a.example/{i}\r\nx", t, "d", 1, "c") for i, t in enumerate(texts)]
    return out + [(None, None, texts[0], None, None, None), (None, None, "alone", None, None, None), (None, "u", "alone", None, None, None),
                  (out[3][0], "again", texts[3], None, None, None)]


def plain(rows, least):
    raw = [(p, (t or "").encode()) for p, _, t, *_ in rows]
    out = []
    for page, data in raw:
        first = min((p for p, d in raw if d == data and p is not None), default=None)
        again = len(data) >= least and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least,size,large", [(0, 7, False), (200, 1 << 20, False), (0, 7, True)])
def test_round_trip(spark, monkeypatch, least, size, large):
    if large:  # types too many to broadcast: repeated pages stay where they are read, the rest is shuffled
        monkeypatch.setattr(warc, "is_small", lambda df: False)
        monkeypatch.setattr(warc, "HOT_KEYS", 1)
    monkeypatch.setattr(warc, "ROTATE", 300)
    monkeypatch.setattr(warc, "CHUNK", size)
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.archive(pages, folder, least, size)
    files = manifest.collect()
    assert len(files) > 1 or size > 100
    assert sum(f.records for f in files) == len(rows())
    chunks = warc.read_archives(manifest, folder)
    ends = chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(e)) for e in ends) == plain(rows(), least)
    # stored payloads come back byte for byte
    stored = {}
    for c in sorted(chunks.filter("record_type = 'response'").collect(), key=lambda c: c.chunk_no):
        stored.setdefault(c.record_id, {})[c.chunk_no] = bytes(c.data)
    whole = {b"".join(v for _, v in sorted(s.items())) for s in stored.values()}
    assert {(t or "").encode() for _, _, t, *_ in rows()} == whole


def test_members_are_gzip(spark):
    pages = spark.createDataFrame([(1, "http://x.example/", "hello")], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc-test")
    path = warc.archive(pages, folder).first().path
    with gzip.open(path) as f:
        text = f.read().decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\nhello\r\n\r\n")


def test_damage_is_noticed(spark):
    stream = __import__("io").BytesIO(gzip.compress(
        warc._header(1, "u", "response", None, 5, warc.base32(hashlib.sha1(b"hello").digest())) + b"hellx\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.records(stream))


def test_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
