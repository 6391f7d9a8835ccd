"""Avro container files for PySpark."""

from avrolith.api import AvroReader, MultiAvroReader, collect_batches, read_avro, read_avro_schema, scan_avro, scan_avro_errors, sink_batches
from avrolith.errors import AuthenticationError, AvroError, BadBlock, CodecError, ConfigurationError, DecodeError, ParseError, SchemaError, SourceError, SourceNotFoundError, SourcePermissionError
from avrolith.schema import check_compatibility, evolve, parse_schema, to_json, validate_compatibility

__all__ = ["AuthenticationError", "AvroError", "AvroReader", "BadBlock", "CodecError", "ConfigurationError", "DecodeError", "MultiAvroReader", "ParseError", "SchemaError", "SourceError", "SourceNotFoundError", "SourcePermissionError", "check_compatibility", "collect_batches", "evolve", "parse_schema", "read_avro", "read_avro_schema", "scan_avro", "scan_avro_errors", "sink_batches", "to_json", "validate_compatibility"]
