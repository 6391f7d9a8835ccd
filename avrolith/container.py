"""Container files: header, blocks, splits and recovery from damage."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from avrolith.codecs import codec_name, decompress
from avrolith.errors import AuthenticationError, BadBlock, CodecError, ConfigurationError, DecodeError, ParseError, SourceError, SourceNotFoundError, SourcePermissionError

MAGIC = b"Obj\x01"
SYNC = 16
READ = 1 << 20
#: Records from which on a block is not believed, where the marker before it is wrong.
SUSPECT_COUNT = 10_000_000


def open_file(path: str, options: dict | None = None):
    """A seekable binary file; local, or of any store that pyarrow has a file system for (s3a:// is s3://)."""
    try:
        if "://" not in path and not path.startswith("file:"):
            return open(path, "rb")
        files, inner = filesystem(path, options)
        return files.open_input_file(inner)
    except FileNotFoundError as e:
        raise SourceNotFoundError(f"no such file: {path}") from e
    except PermissionError as e:
        raise SourcePermissionError(f"may not read: {path}") from e
    except (OSError, ValueError) as e:
        if any(x in str(e) for x in ("ACCESS_DENIED", "Forbidden", "InvalidAccessKey", "SignatureDoesNotMatch")):
            raise AuthenticationError(f"{path}: {e}") from e
        raise SourceError(f"{path}: {e}") from e


def filesystem(path: str, options: dict | None = None):
    from pyarrow import fs

    if path.startswith(("s3://", "s3a://")):
        o = options or {}
        retry = fs.AwsStandardS3RetryStrategy(max_attempts=int(o.get("max_retries", 2)) + 1)
        scheme, _, endpoint = (o.get("endpoint") or "").rpartition("://")
        known = {"access_key": o.get("aws_access_key_id"), "secret_key": o.get("aws_secret_access_key"), "session_token": o.get("aws_session_token"), "region": o.get("region"), "endpoint_override": endpoint, "scheme": scheme}
        return fs.S3FileSystem(retry_strategy=retry, **{k: v for k, v in known.items() if v}), path.split("://", 1)[1]
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def size_of(file) -> int:
    at = file.tell()
    size = file.seek(0, os.SEEK_END)
    file.seek(at)
    return size


class Bytes:
    """Buffered reads with a position."""

    def __init__(self, file, at: int = 0):
        self.file, self.size = file, size_of(file)
        self.seek(at)

    def seek(self, at: int) -> None:
        if hasattr(self, "base") and self.base <= at <= self.base + len(self.data):
            self.at = at - self.base
            return
        self.base, self.data, self.at = at, b"", 0
        self.file.seek(at)

    @property
    def position(self) -> int:
        return self.base + self.at

    def fill(self, n: int) -> None:
        while len(self.data) - self.at < n:
            more = self.file.read(max(READ, n - (len(self.data) - self.at)))
            if not more:
                raise ParseError(f"the file ends at {self.size}, within a block or header")
            self.base += self.at
            self.data, self.at = self.data[self.at :] + more, 0

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.size - self.position:
            raise ParseError(f"{n} bytes are announced at {self.position}, the file has {self.size}")
        self.fill(n)
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def long(self) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data):
                self.fill(1)
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise ParseError("a number is longer than 10 bytes")


@dataclass
class Header:
    schema_json: str
    codec: str
    sync: bytes
    metadata: dict[str, bytes]
    start: int
    size: int


def read_header(file, path: str = "") -> Header:
    source = Bytes(file)
    if source.size < 4 or source.take(4) != MAGIC:
        raise ParseError(f"not an Avro container file: {path}")
    metadata: dict[str, bytes] = {}
    while count := source.long():
        if count < 0:
            count = -count
            source.long()
        for _ in range(count):
            key = source.take(source.long()).decode("utf-8")
            metadata[key] = source.take(source.long())
    if "avro.schema" not in metadata:
        raise ParseError(f"no schema in the header: {path}")
    codec = codec_name(metadata.get("avro.codec", b"null").decode("utf-8"))
    sync = source.take(SYNC)
    return Header(metadata["avro.schema"].decode("utf-8"), codec, sync, metadata, source.position, source.size)


def first_block(file, header: Header, start: int) -> int:
    """Where the first block begins that belongs to a range from start on: behind a sync marker."""
    if start <= header.start:
        return header.start
    found = find_sync(file, header.sync, start - SYNC)
    return header.size if found is None else found + SYNC


def block_index(file, header: Header, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """(offset, records) of every block that begins in [start, end), by hopping over the payloads."""
    at, out = first_block(file, header, start), []
    stop = header.size if end is None else min(end, header.size)
    source = Bytes(file, at)
    while at < stop:
        source.seek(at)
        count, size = source.long(), source.long()
        end = source.position + size
        if count < 0 or size < 0 or end + SYNC > header.size:
            raise ParseError(f"malformed block at {at}")
        source.seek(end)
        if source.take(SYNC) != header.sync:
            raise ParseError(f"wrong sync marker at {end}")
        out.append((at, count))
        at = end + SYNC
    return out


def find_sync(file, sync: bytes, at: int) -> int | None:
    """Where the first sync marker at or after `at` begins."""
    file.seek(at)
    held, base = b"", at
    while more := file.read(READ):
        held += more
        found = held.find(sync)
        if found >= 0:
            return base + found
        base += max(0, len(held) - SYNC + 1)
        held = held[-(SYNC - 1) :]
    return None


def blocks(file, header: Header, start: int = 0, end: int | None = None, limit: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, records, payload) of the blocks that begin in [start, end); damage raises."""
    end = header.size if end is None else end
    source = Bytes(file, first_block(file, header, start))
    while source.position < min(end, header.size):
        at = source.position
        count, size = source.long(), source.long()
        if count < 0 or size < 0:
            raise ParseError(f"negative count or size in the block at {at}")
        data = source.take(size)
        if source.take(SYNC) != header.sync:
            raise ParseError(f"wrong sync marker after the block at {at}")
        yield at, count, decompress(header.codec, data, limit)


def tolerant_blocks(file, header: Header, path: str, report, limit: int | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(index, offset, records, payload) of the blocks that can be read; damage goes to
    report(BadBlock) and the scan goes on at the next sync marker that fits.

    Of a range [start, end) these are the blocks that begin in it behind a sound marker, and those
    that follow without one: no other range finds them. Indexes count from the range's first
    block; the generator returns how many there were."""
    end = header.size if end is None else end
    source = Bytes(file, first_block(file, header, start))
    index, sound = 0, True  # whether the marker before the block is right
    while (at := source.position) < header.size and (at < end or not sound):
        try:
            count, size = source.long(), source.long()
            if count < 0 or size < 0 or size > header.size:
                raise ParseError(f"impossible block of {count} records and {size} bytes")
            if not sound and (count >= SUSPECT_COUNT or (size == 0 and count > 0)):
                raise ParseError(f"implausible block of {count} records and {size} bytes")
            data = source.take(size)
            after = source.position
            mark = source.take(SYNC)
        except ParseError as e:
            report(BadBlock("BlockParseFailed", index, None, at, str(e), path))
            index, sound = index + 1, True
            found = find_sync(file, header.sync, at)
            if found is None:
                return index
            source = Bytes(file, found + SYNC)
            continue
        sound = mark == header.sync
        if not sound:
            report(BadBlock("InvalidSyncMarker", index, None, after, "the sync marker does not match the header's", path))
            inner = find_sync(file, header.sync, at)
            if inner is not None and inner < after:  # the size was wrong: a marker stands inside
                source, index, sound = Bytes(file, inner + SYNC), index + 1, True
                continue
            # a marker that begins within the place of the wrong one: bytes were lost or added before it
            near = inner is not None and inner < after + SYNC
            source, sound = Bytes(file, inner + SYNC if near else after + SYNC), near
        try:
            yield index, at, count, decompress(header.codec, data, limit)
        except CodecError as e:
            report(BadBlock("DecompressionFailed", index, None, at, str(e), path))
        index += 1
    return index


__all__ = ["ConfigurationError", "DecodeError", "Header", "block_index", "blocks", "find_sync", "open_file", "read_header", "tolerant_blocks"]
