"""Exceptions and the record of a bad block."""

from __future__ import annotations

from dataclasses import asdict, dataclass


class AvroError(Exception):
    """Base of all errors of this package."""


class DecodeError(AvroError):
    """A record's bytes do not follow the schema."""


class ParseError(AvroError):
    """A file header or block is malformed."""


class SourceError(AvroError):
    """A source can't be read."""


class SchemaError(AvroError):
    """A schema is invalid, unsupported, or does not fit another one."""


class CodecError(AvroError):
    """A block can't be decompressed."""


class AuthenticationError(SourceError):
    """A store refuses the credentials."""


class SourceNotFoundError(SourceError, FileNotFoundError):
    """A file does not exist, or a pattern matches none."""


class SourcePermissionError(SourceError, PermissionError):
    """A file may not be read."""


class ConfigurationError(AvroError, ValueError):
    """An argument is out of range."""


@dataclass(frozen=True)
class BadBlock:
    """What was skipped in a tolerant read."""

    kind: str  # InvalidSyncMarker, DecompressionFailed, BlockParseFailed, RecordDecodeFailed, SchemaViolation
    block_index: int
    record_index: int | None
    file_offset: int
    message: str
    filepath: str

    def to_dict(self) -> dict:
        return asdict(self)

    def __str__(self) -> str:
        record = "" if self.record_index is None else f", record {self.record_index}"
        return f"[{self.kind}] {self.filepath}: block {self.block_index}{record}, offset {self.file_offset}: {self.message}"
