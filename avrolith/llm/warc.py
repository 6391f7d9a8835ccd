"""WARC archives and their chunked record table.

write_archives() writes one gzip member per record into archive files in a shared
folder, each file first under a name of its own and then renamed, so that a lost
or repeated task leaves no half-written archive. read_chunks() streams archives
back as rows (record id, chunk number, bytes) with the running digest; a payload
of any size needs memory for one chunk only. read_records() sums up the chunk rows of each
record: the length of their bytes, and the digest that the last one carries. Archives of other
writers are read too: records of any type, without digests or with other ids.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the
largest id is the response, the others are revisits of it and carry no payload.

Skew: equal payloads meet as digests, pre-aggregated; hot ones come back by
lookup_join. No payload is shuffled by its digest.

Defined results: null html is the empty payload; rows with repeated ids give a
record each (of equal payloads all rows of the largest id are responses); an
empty table gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import lookup_join, materialize, scratch_path, text_buffers

MIN_REVISIT = 1000
CHUNK = 256 << 10
#: Compressed bytes read at once; what a short member leaves of them is copied.
READ = 32 << 10
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_LEVEL = 4


def filesystem(uri: str):
    """The pyarrow file system and path of a folder's URI (file, s3, gs, hdfs, ...)."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):  # Hadoop's names of S3
        uri = "s3://" + uri.split("://", 1)[1]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record_head(record_id: str, kind: str, url: str | None, digest: str, refers_to: str | None, length: int, payload_length: int) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (id long, url, payload string or binary, digest, refers_to long, kind)
    into folder; one row (archive, records) per archive file. Runs when it is evaluated; evaluate it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temp = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        final = f"{root}/part-{part:06d}.warc.gz"
        count = 0
        with files.open_output_stream(temp) as out:
            for batch in batches:
                raw, off = text_buffers(batch.column(2))
                view = memoryview(raw)
                columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
                for i, (rid, url, digest, refers, kind) in enumerate(zip(*columns)):
                    size = int(off[i + 1] - off[i])
                    length = 0 if kind == "revisit" else size
                    head = record_head("" if rid is None else str(rid), kind, url, digest, None if refers is None else str(refers), length, size)
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    pieces = [packer.compress(head)]
                    for at in range(int(off[i]), int(off[i]) + length, CHUNK):
                        pieces.append(packer.compress(view[at : min(at + CHUNK, int(off[i]) + length)]))
                        if len(pieces) > 16:
                            out.write(b"".join(pieces))
                            pieces = []
                    pieces += [packer.compress(b"\r\n\r\n"), packer.flush()]
                    out.write(b"".join(pieces))
                    count += 1
        files.move(temp, final)
        yield pa.RecordBatch.from_arrays([pa.array([final.rsplit("/", 1)[1]]), pa.array([count], pa.int64())], names=["archive", "records"])

    return records.select("id", "url", "payload", "digest", "refers_to", "kind").mapInArrow(run, "archive string, records long")


class _Stream:
    """Inflated bytes of a file of gzip members (or of a plain one), read in bounded pieces."""

    def __init__(self, file):
        self.file, self.unzip, self.raw, self.data, self.done = file, None, b"", b"", False
        head = file.read(READ)
        self.plain = head[:2] != b"\x1f\x8b"
        self.raw = head

    def _more(self) -> bool:
        while not self.done:
            if not self.raw:
                self.raw = self.file.read(READ)
                if not self.raw:
                    self.done = True
                    if self.unzip is not None:
                        raise ValueError("the archive ends within a record")
                    return False
            if self.plain:
                self.data, self.raw = self.data + self.raw, b""
                return True
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.raw, CHUNK)
            self.raw = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.raw, self.unzip = self.unzip.unused_data, None
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.data.find(mark, start)) < 0:
            start = max(0, len(self.data) - len(mark))
            if not self._more():
                if self.data.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record's head")
                return None
        got, self.data = self.data[:at], self.data[at + len(mark) :]
        return got

    def take(self, size: int) -> bytes:
        if not self.data and not self._more():
            raise ValueError("the archive ends within a payload")
        got, self.data = self.data[:size], self.data[size:]
        return got


def stream_records(file, keep_bytes: bool = True, chunk: int = CHUNK):
    """(head fields, chunk number, bytes, is last, length so far, digest object) of each chunk of
    each record of an open archive. An empty payload has one empty chunk."""
    source = _Stream(file)
    while True:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if not length.isdecimal():
            raise ValueError("a WARC record without a length")
        left = int(length)
        digest, number, done = hashlib.sha1(), 0, 0
        pending: list[bytes] = []
        held = 0
        while True:
            while left and held < chunk:
                piece = source.take(min(left, chunk - held))
                digest.update(piece)
                left -= len(piece)
                held += len(piece)
                if keep_bytes:
                    pending.append(piece)
            done += held
            yield fields, number, b"".join(pending), left == 0, done, digest
            pending, held, number = [], 0, number + 1
            if not left:
                break
        source.until(b"\r\n\r\n")


_CHUNKS = "archive string, record long, record_id string, record_type string, refers_to string, payload_digest string, payload_length long, chunk int, is_last boolean, length_so_far long, digest_so_far string, bytes binary"


def read_chunks(archives: DataFrame, folder: str, keep_bytes: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives (column archive: file names in folder). record counts the records of an archive."""
    schema = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("chunk", pa.int32()), ("is_last", pa.bool_()), ("length_so_far", pa.int64()), ("digest_so_far", pa.string()), ("bytes", pa.binary())])

    def bare(value: str | None) -> str | None:
        return value[10:-1] if value is not None and value.startswith("<urn:page:") else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        rows: list[tuple] = []
        held = 0

        def flush():
            columns = zip(*rows) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                record = -1
                with files.open_input_stream(f"{root}/{name}") as file:
                    for fields, number, data, last, done, digest in stream_records(file, keep_bytes, chunk):
                        record += number == 0
                        known = fields.get("warc-payload-digest")
                        rows.append((name, record, bare(fields.get("warc-record-id")), fields.get("warc-type"), bare(fields.get("warc-refers-to")), known and known.removeprefix("sha1:"), int(fields.get("x-payload-length", fields["content-length"])), number, last, done, digest.hexdigest(), data if keep_bytes else None))
                        held += len(data)
                        if held > 4 << 20 or len(rows) >= 10000:
                            yield flush()
                            rows, held = [], 0
        yield flush()

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, _CHUNKS)


def read_records(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """One row per record, from its chunk rows: the length of all their bytes, and the digest of the
    whole payload, which the last one carries. Chunks meet in the task that read them."""
    head = ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]
    chunks = read_chunks(archives, folder, chunk=chunk).withColumn("size", F.octet_length("bytes").cast("long")).drop("bytes")
    last = F.max_by(F.struct(*head, "digest_so_far"), "chunk").alias("last")
    sums = chunks.groupBy("archive", "record").agg(F.sum("size").alias("length_so_far"), F.count(F.lit(1)).alias("chunks"), last)
    return sums.select("archive", "record", *[f"last.{c}" for c in head], "length_so_far", "last.digest_so_far", "chunks")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages as records: id, url, payload, digest, kind, refers_to."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    keyed = base.select("id", F.octet_length("payload").alias("size"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("full")).where(F.col("size") >= min_revisit)
    groups = materialize(keyed.groupBy("full").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    # Groups of copies are few next to the pages; only their members' ids are joined, not their payloads.
    total = pages.count()
    twins = lookup_join(keyed.where("id is not null").select("id", "full").withColumn("spread", F.xxhash64("id")), groups, ["full"], "n", total, "spread")
    revisits = twins.where("id <> keeper").select("id", F.col("full").alias("twin"), "keeper").distinct()
    full = F.sha2("payload", 256)
    out = base.withColumn("digest", F.sha1("payload")).withColumn("full", full).join(revisits.select(F.col("id").alias("r_id"), "twin", "keeper"), (F.col("id") == F.col("r_id")) & (F.col("full") == F.col("twin")), "left")
    return out.select("id", "url", "payload", "digest", F.col("keeper").alias("refers_to"), F.when(F.col("keeper").isNull(), "response").otherwise("revisit").alias("kind"))


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write pages into archives in folder (default: a new one in the shared folder) and
    read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the payload read; a revisit, which
    has no payload of its own, takes them from its head.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archives = materialize(write_archives(plan_records(pages, **columns), folder), "archives")
    records = read_records(archives, folder)
    own = F.col("record_type") == "response"
    return records.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("long").alias("page_id"),
        F.when(own, F.col("length_so_far")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
