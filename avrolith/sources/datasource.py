"""The Spark data source: splits of files, decoded to Arrow batches on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from avrolith.container import blocks, open_file, read_header, tolerant_blocks
from avrolith.decode import Decoder
from avrolith.errors import AvroError, BadBlock, CodecError, DecodeError, ParseError
from avrolith.lockstep import LEAST_LANES, Damage, LockstepDecoder, fits
from avrolith.schema import as_record, parse_schema

ERROR_SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("block_index", T.LongType()), T.StructField("record_index", T.LongType()), T.StructField("file_offset", T.LongType()), T.StructField("message", T.StringType()), T.StructField("filepath", T.StringType())]
)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None
    first_row: int = 0
    rows: int | None = None  # read no more than this

    def __init__(self, path, start, end, first_row=0, rows=None):
        super().__init__((path, start))
        self.path, self.start, self.end, self.first_row, self.rows = path, start, end, first_row, rows


#: Inflated bytes of the blocks that are decoded together; more only until there are LANES blocks.
GROUP_BYTES, MOST_BYTES, LANES = 32 << 20, 64 << 20, 64
#: Inflated bytes of the records of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def _gathered(found, rows: int | None) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of blocks to decode together, up to so many rows in all."""
    held: list = []
    size = seen = 0
    try:
        for block in found:
            held.append(block)
            size += len(block[3])
            seen += block[2]
            if rows is not None and seen >= rows:
                break
            if size >= MOST_BYTES or (size >= GROUP_BYTES and len(held) >= LANES):
                yield held
                held, size = [], 0
    except AvroError:
        if held:
            yield held
        raise
    if held:
        yield held


def read_split(split: Split, columns: list[str] | None, *, nanos: str = "micros", ignore_errors: bool = False, limit: int | None = None, batch_size: int = 100_000, storage: dict | None = None, report=None, ended=None) -> Iterator[tuple[list[pa.Array], int, list[str]]]:
    """(arrays, rows, names) of the records of a split. ended, if given, gets the number of its blocks (of a tolerant read)."""
    report = report or (lambda bad: None)
    left = split.rows
    try:
        with open_file(split.path, storage) as file:
            header = read_header(file, split.path)
            record = as_record(parse_schema(header.schema_json))
            decoder = Decoder(record, columns, nanos)
            names = [f.name for f in decoder.fields]
            wide = LockstepDecoder(record, columns, nanos) if fits(record) else None

            def tolerant():
                n = yield from tolerant_blocks(file, header, split.path, report, limit, split.start, split.end)
                if ended:
                    ended(n)

            found = tolerant() if ignore_errors else ((i, at, n, data) for i, (at, n, data) in enumerate(blocks(file, header, split.start, split.end, limit)))
            if left is not None and left <= 0:
                return
            # damaged blocks have fewer records than they announce, so a tolerant read can't tell before
            for group in _gathered(found, None if ignore_errors else left):
                counts = [count for _, _, count, _ in group]
                if left is not None and not ignore_errors:
                    counts = np.diff(np.minimum(np.cumsum([0, *counts]), left)).tolist()
                arrays, done = None, sum(counts)
                if wide is not None and len(group) >= LEAST_LANES:
                    try:
                        arrays = wide.arrays([data for *_, data in group], counts)
                    except (Damage, pa.ArrowInvalid, DecodeError, IndexError, ValueError, ArithmeticError):
                        pass  # one by one
                if arrays is None:
                    outs, done = decoder.buffers(), 0
                    for (index, at, _, data), count in zip(group, counts):
                        n, error = decoder.decode(data, count, outs)
                        if error is not None:
                            if not ignore_errors:
                                raise DecodeError(f"{split.path}: block at {at}, record {n}: {error}")
                            report(BadBlock("RecordDecodeFailed", index, n, at, str(error), split.path))
                        done += n
                    arrays = decoder.arrays(outs)
                if left is not None:
                    done = min(done, left)
                    left -= done
                step = max(1, min(batch_size, max(1000, BATCH_BYTES * max(1, done) // (1 + sum(len(data) for *_, data in group)))))
                for at in range(0, done, step):
                    n = min(step, done - at)
                    yield [a.slice(at, n) for a in arrays], n, names
                if left is not None and left <= 0:
                    return
    except (ParseError, CodecError) as e:
        if str(split.path) in str(e):
            raise
        raise type(e)(f"{split.path}: {e}") from e


class AvroSource(DataSource):
    """format("avrolith"). Options are made by avrolith.scan_avro."""

    @classmethod
    def name(cls) -> str:
        return "avrolith"

    def schema(self):
        return T._parse_datatype_json_string(self.options["schema"])

    def reader(self, schema):
        options = dict(self.options)
        return (_FilteringReader if json.loads(options["plan"]).get("pushdown") else _Reader)(schema, options)


def byte_splits(files, split_bytes: int) -> list[tuple]:
    """Even byte ranges of about split_bytes of (path, data start, size); a block belongs to the range
    in which it begins. No block is read for this."""
    out = []
    for path, _, size in files:
        pieces = max(1, round(size / split_bytes))
        cuts = [size * i // pieces for i in range(pieces + 1)]
        out += [(path, a, b, 0, None) for a, b in zip(cuts, cuts[1:])]
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        self.plan = json.loads(options["plan"])
        self.kept: list[_Kept] = []

    def partitions(self):
        if "files" in self.plan:
            return [Split(*s) for s in byte_splits(self.plan["files"], self.plan["split_bytes"])]
        return [Split(*s) for s in self.plan["splits"]]

    def read(self, split: Split):
        plan = self.plan
        bad: list[BadBlock] = []
        errors = plan.get("mode") == "errors"
        index, path = plan.get("row_index"), plan.get("path_column")
        columns = [n for n in self.names if n not in (index, path)]
        out = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema.fields])
        row = split.first_row
        count: list[int] = []
        try:
            for arrays, n, names in read_split(split, plan["columns"] if errors else columns, nanos=plan["nanos"], ignore_errors=plan["ignore_errors"], limit=plan["max_block_size"], batch_size=plan["batch_size"], storage=plan["storage"], report=bad.append, ended=count.append):
                if errors:
                    continue
                have = dict(zip(names, arrays))
                if index is not None:
                    have[index] = pa.array(np.arange(row, row + n))
                    row += n
                if path is not None:
                    have[path] = pa.repeat(pa.scalar(split.path, pa.string()), n)
                batch = pa.RecordBatch.from_arrays([have[c] for c in self.names], schema=out)
                for kept in self.kept:
                    batch = batch.filter(kept(batch))
                yield batch
        except AvroError as e:
            if not plan["ignore_errors"]:
                raise
            bad.append(BadBlock("BlockParseFailed", 0, None, 0, str(e), split.path))
        if errors:  # the last row says how many blocks the split has
            rows = [b.to_dict() | {"split": split.start} for b in bad] + [{"block_index": sum(count), "filepath": split.path, "split": split.start}]
            yield pa.RecordBatch.from_pylist(rows, schema=out)


class _FilteringReader(_Reader):
    def pushFilters(self, filters):
        """Rows that a filter surely drops stay in the worker that decodes them (after they were
        numbered and limited). Spark applies all filters again."""
        types = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            plain = f.child if isinstance(f, Not) else f
            name = plain.attribute[0] if len(plain.attribute) == 1 else None
            if isinstance(types.get(name), _FILTERED) and type(plain) in _TESTS:
                self.kept.append(_Kept(f))
            yield f


#: Types whose comparisons are the same in Arrow and Spark.
_FILTERED = (T.BooleanType, T.IntegerType, T.LongType, T.StringType, T.BinaryType, T.DateType)
_TESTS = {
    EqualTo: lambda x, f: pc.equal(x, _value(f.value, x)),
    GreaterThan: lambda x, f: pc.greater(x, _value(f.value, x)),
    GreaterThanOrEqual: lambda x, f: pc.greater_equal(x, _value(f.value, x)),
    LessThan: lambda x, f: pc.less(x, _value(f.value, x)),
    LessThanOrEqual: lambda x, f: pc.less_equal(x, _value(f.value, x)),
    In: lambda x, f: pc.is_in(x, pa.array([v for v in f.value if v is not None], x.type)),
    IsNull: lambda x, f: pc.is_null(x),
    IsNotNull: lambda x, f: pc.is_valid(x),
    StringStartsWith: lambda x, f: pc.starts_with(x, f.value),
    StringEndsWith: lambda x, f: pc.ends_with(x, f.value),
    StringContains: lambda x, f: pc.match_substring(x, f.value),
}


def _value(value, column):
    return pa.scalar(value, column.type)


class _Kept:
    """A filter as a test of batches; null counts as false, below a negation too."""

    def __init__(self, f):
        self.negated = isinstance(f, Not)
        self.filter = f.child if self.negated else f

    def __call__(self, batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(batch.schema.get_field_index(self.filter.attribute[0]))
        found = _TESTS[type(self.filter)](column, self.filter)
        if self.negated:
            found = pc.invert(found)
            if isinstance(self.filter, In):
                found = pc.and_(found, pc.is_valid(column))
        return pc.fill_null(found, False)


def _arrow(t):
    from avrolith.schema import arrow_type

    return arrow_type(t)
