"""WARC archives through a table of record chunks.

A payload is a run of rows (record, chunk number, bytes) of bounded size.  Digests are carried from chunk to chunk, the
writer streams chunks into a gzip member per record, and the reader streams members back as chunk rows with the digest
so far, so no task holds a whole payload of its own making.  Of records with equal payloads the one with the smallest
page id is stored, the others are revisits of it.

Files go to a folder all executors share, through Arrow's file systems.  A task writes files of its own attempt and names
them in a manifest that Spark commits; files of a lost attempt are in no manifest and are never read.

Defined cases: a null payload is an empty one; a null page id is larger than any other, and among null ids only all are
responses; rows that repeat id and payload are written one by one with the same record id and type; a null url has no
target header; line ends in a url are percent-encoded; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.llm.common import HOT_KEYS, is_small, join_counts
from faqloom.session import materialize, scratch_path

CHUNK = 1 << 20
#: A task starts another archive once one has so many compressed bytes.
ROTATE = 512 << 20
DATE = "1970-01-01T00:00:00Z"
GZIP = 31
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, records bigint, bytes bigint"
CHUNKS = (
    "record_id string, page_id bigint, url string, record_type string, refers_to bigint, chunk_no bigint, data binary, "
    "payload_bytes bigint, payload_digest string, last boolean"
)


def chunked(df: DataFrame, payload: str, size: int = CHUNK) -> DataFrame:
    """Every row as rows of its payload's bytes: chunk_no from 0, data, last.  An empty payload has one empty chunk."""
    raw = df.withColumn("_raw", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")).drop(payload)
    last = F.greatest(F.ceil(F.octet_length("_raw") / F.lit(size)).cast("int") - 1, F.lit(0))
    rows = raw.withColumn("_last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    data = F.substring(F.col("_raw"), F.col("chunk_no") * size + 1, F.lit(size))
    return rows.withColumn("data", data).withColumn("last", F.col("chunk_no") == F.col("_last")).drop("_raw", "_last")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_digests(chunks: DataFrame) -> DataFrame:
    """Chunk rows in order -> page_id, payload_key, payload_bytes, payload_digest per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "payload_key", "chunk_no", "data", "last")))
            for page_id, key, no, data, last in rows:
                if no == 0:
                    sha, size = hashlib.sha1(), 0
                sha.update(data)
                size += len(data)
                if last:
                    out.append((page_id, key, size, base32(sha.digest())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["page_id", "payload_key", "payload_bytes", "payload_digest"],
            )

    columns = chunks.select("page_id", "payload_key", "chunk_no", "data", "last")
    return columns.mapInArrow(run, "page_id bigint, payload_key bigint, payload_bytes bigint, payload_digest string")


def record_types(digests: DataFrame, least: int = 0) -> DataFrame:
    """Per distinct (page_id, payload): record_type and, for revisits, the id of the page stored."""
    firsts = digests.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
    firsts = materialize(firsts, "warc-firsts")
    known = join_counts(digests.distinct(), firsts, "payload_digest", "rows", ["first_id"])
    again = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select(
        *digests.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record_key() -> Column:
    """One text for a page id, null or not, and a payload's key."""
    return F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), F.col("payload_key").cast("string"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def _header(page_id, url, kind, refers_to, size, digest) -> bytes:
    block = HTTP % size
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", size),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block) + (size if kind == "response" else 0)),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        lines.append(("X-Page-Id", page_id))
    if kind == "revisit":
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", refers_to),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


class Archives:
    """Gzip members, one per record, in files of about ``ROTATE`` bytes."""

    def __init__(self, folder: str):
        self.files, self.folder = pafs.FileSystem.from_uri(folder)
        self.out, self.done = None, []

    def begin(self, header: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/part-{uuid.uuid4().hex}.warc.gz"  # a name of this attempt alone
            self.out, self.records = self.files.open_output_stream(self.path, compression=None), 0
        self.member = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        self.records += 1
        self.write(header)

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self.out.write(self.member.flush())
        if self.out.tell() >= ROTATE:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.done.append((self.path, self.records, size))
            self.out = None


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Chunk rows in order, with record_type, refers_to and the digest of the whole payload -> manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for batch in batches:
            for row in batch.to_pylist():
                stored = row["record_type"] == "response"
                if row["chunk_no"] == 0:
                    archives.begin(_header(row["page_id"], row["url"], row["record_type"], row["refers_to"],
                                           row["payload_bytes"], row["payload_digest"]))
                if stored:
                    archives.write(row["data"])
                if row["last"]:
                    archives.end()
        archives.close()
        cells = [pa.array([r[i] for r in archives.done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cells, ["path", "records", "bytes"])

    columns = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "last")
    data = F.when(F.col("record_type") == "response", F.col("data")).alias("data")
    return chunks.select(*columns, data).mapInArrow(run, MANIFEST)


class Members:
    """The bytes of an archive, member after member, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.inflate, self.buffer, self.raw = stream, zlib.decompressobj(GZIP), b"", b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(GZIP)
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    return False
            piece = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof and self.inflate.unused_data:
                self.raw = b""
            if piece:
                self.buffer += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the archive."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes in pieces."""
        while size:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends inside a record")
            piece, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(piece)
            yield piece


def records(stream) -> Iterator[tuple]:
    """The chunk rows of an archive, in the order of CHUNKS; ``payload_bytes`` and ``payload_digest`` are those so far,
    and for a revisit those it names."""
    members = Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        base = (fields["WARC-Record-ID"], page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                refers and int(refers))
        declared, whole = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        http = members.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http)
        sha, size, no = hashlib.sha1(), 0, 0
        if base[3] == "revisit":
            yield (*base, 0, None, whole, declared, True)
        elif not left:
            yield (*base, 0, b"", 0, base32(sha.digest()), True)
        for no, piece in enumerate(members.take(left)):
            sha.update(piece)
            size += len(piece)
            yield (*base, no, piece, size, base32(sha.copy().digest()), size == left)
        if base[3] == "response" and (size, base32(sha.digest())) != (whole, declared):
            raise ValueError(f"record {base[0]} does not hold the payload it names")
        for _ in members.take(4):  # the two line ends behind a record
            pass


def read_archives(manifest: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunk table of all archives in a manifest; without ``data`` only each record's last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        kinds = [(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
                  [c.split()[1]]) for c in CHUNKS.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds]
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for row in records(stream):
                        if not data and not row[-1]:
                            continue
                        row = row if data else (*row[:6], None, *row[7:])
                        rows.append(row)
                        held += len(row[6] or b"") + 1
                        if held >= 4 * CHUNK or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                yield packed(rows)

    paths = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return paths.mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, folder: str, least: int = 0, size: int = CHUNK) -> DataFrame:
    """Write a record per page (page_id, url, html) and return the manifest."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html",
        F.xxhash64(F.coalesce("html", F.lit("")), F.length("html")).alias("payload_key"),
    )
    digests = materialize(payload_digests(chunked(rows, "html", size)), "warc-digests")
    types = record_types(digests, least).withColumn("_key", record_key())
    times = digests.groupBy(record_key().alias("_key")).agg(F.count("*").alias("_times"))
    types = materialize(types.join(times, "_key"), "warc-types")
    numbered = rows.withColumn("_record", F.monotonically_increasing_id())
    parts = chunked(numbered, "html", size).withColumn("_key", record_key())
    known = types.drop("page_id", "payload_key", "_times")
    if is_small(types):  # chunks stay where and as they are read
        typed = parts.join(F.broadcast(known), "_key")
    else:
        # what repeats most stays where it is read, too; any other key holds less than a thousandth of the rows
        hot = types.filter("_times > 1").orderBy(F.desc("_times"), "_key").limit(HOT_KEYS)
        near = parts.join(F.broadcast(hot.select(*known.columns)), "_key")
        rest = parts.join(F.broadcast(hot.select("_key")), "_key", "left_anti").join(known.hint("merge"), "_key")
        typed = near.unionByName(rest.sortWithinPartitions("_record", "chunk_no"))
    typed = typed.drop("_key")
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path)
    return materialize(write_archives(typed, folder), "warc-manifest")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = archive(pages, folder, least)
    back = read_archives(manifest, folder, data=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * i // 4, 2))::INTEGER >> (3 - 5 * i % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
