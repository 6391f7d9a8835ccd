"""The six block codecs, with a limit on what a block may inflate to."""

from __future__ import annotations

import bz2
import lzma
import zlib

from avrolith.errors import CodecError

CODECS = ("null", "deflate", "snappy", "zstandard", "bzip2", "xz")
DEFAULT_LIMIT = 512 << 20


def codec_name(name: str) -> str:
    name = "zstandard" if name == "zstd" else name
    if name not in CODECS:
        raise CodecError(f"unsupported codec {name!r}")
    return name


def decompress(codec: str, data: bytes, limit: int | None = DEFAULT_LIMIT) -> bytes:
    try:
        return _DECODERS[codec](bytes(data), limit)
    except CodecError:
        raise
    except Exception as e:
        raise CodecError(f"{codec}: {e}") from e


def compress(codec: str, data: bytes) -> bytes:
    return _ENCODERS[codec](data)


def _checked(out: bytes, limit: int | None, whole: bool = True) -> bytes:
    if limit is not None and len(out) > limit:
        raise CodecError(f"block inflates to more than {limit} bytes")
    if not whole:
        raise CodecError("compressed block is cut off")
    return out


def _inflate(data: bytes, limit: int | None) -> bytes:
    unzip = zlib.decompressobj(-15)
    out = unzip.decompress(data, 0 if limit is None else limit + 1)
    return _checked(out, limit, unzip.eof or (limit is not None and len(out) > limit))


def _snappy(data: bytes, limit: int | None) -> bytes:
    import pyarrow as pa

    if len(data) < 5:
        raise CodecError("snappy block is too short")
    body, size, shift = data[:-4], 0, 0
    for b in body[:5]:
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    if limit is not None and size > limit:
        raise CodecError(f"block inflates to {size} bytes, more than {limit}")
    out = pa.Codec("snappy").decompress(body, size, asbytes=True)
    if zlib.crc32(out) != int.from_bytes(data[-4:], "big"):
        raise CodecError("snappy checksum does not match")
    return out


def _zstd(data: bytes, limit: int | None) -> bytes:
    import io

    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as stream:
        return _checked(stream.read(-1 if limit is None else limit + 1), limit)


def _bzip2(data: bytes, limit: int | None) -> bytes:
    unzip = bz2.BZ2Decompressor()
    out = unzip.decompress(data, -1 if limit is None else limit + 1)
    return _checked(out, limit, unzip.eof or (limit is not None and len(out) > limit))


def _xz(data: bytes, limit: int | None) -> bytes:
    unzip = lzma.LZMADecompressor()
    out = unzip.decompress(data, -1 if limit is None else limit + 1)
    return _checked(out, limit, unzip.eof or (limit is not None and len(out) > limit))


def _snappy_encode(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("snappy").compress(data, asbytes=True) + zlib.crc32(data).to_bytes(4, "big")


def _deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def _zstd_encode(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


_DECODERS = {"null": lambda d, limit: d, "deflate": _inflate, "snappy": _snappy, "zstandard": _zstd, "bzip2": _bzip2, "xz": _xz}
_ENCODERS = {"null": bytes, "deflate": _deflate, "snappy": _snappy_encode, "zstandard": _zstd_encode, "bzip2": bz2.compress, "xz": lzma.compress}
