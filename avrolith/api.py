"""scan_avro and its relatives."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from avrolith import plans
from avrolith.codecs import DEFAULT_LIMIT
from avrolith.errors import AvroError, BadBlock, ConfigurationError, SchemaError
from avrolith.schema import Schema, arrow_type, evolve, parse_schema, readable, spark_fields
from avrolith.sources import header_of, paths_of, pick_columns, schema_of
from avrolith.sources.datasource import ERROR_SCHEMA, AvroSource, Split, read_split

MAX_OFFSET = 2**32 - 1


def _check(n_rows, offset, batch_size) -> None:
    if n_rows is not None and (not isinstance(n_rows, int) or n_rows < 0):
        raise ConfigurationError(f"n_rows is a whole number of at least 0, not {n_rows!r}")
    if not isinstance(offset, int) or not 0 <= offset <= MAX_OFFSET:
        raise ConfigurationError(f"row_index_offset lies between 0 and {MAX_OFFSET}, not {offset!r}")
    if not isinstance(batch_size, int) or batch_size < 1:
        raise ConfigurationError(f"batch_size is at least 1, not {batch_size!r}")


def _count_rows(columns, limit, storage):
    def count(path: str, start: int, stop: int) -> int:
        return sum(n for _, n, _ in read_split(Split(path, start, stop), columns, ignore_errors=True, limit=limit, storage=storage))

    return count


def scan_avro(
    spark: SparkSession,
    source,
    *,
    columns=None,
    n_rows: int | None = None,
    row_index_name: str | None = None,
    row_index_offset: int = 0,
    glob: bool = True,
    include_file_paths: str | None = None,
    ignore_errors: bool = False,
    storage_options: dict | None = None,
    buffer_blocks: int = 4,
    buffer_bytes: int = 64 << 20,
    read_chunk_size: int | None = None,
    batch_size: int = 100_000,
    max_block_size: int | None = DEFAULT_LIMIT,
    nanos: str = "micros",
    reader_schema=None,
    split_bytes: int | None = None,
    pushdown: bool = False,
    _mode: str = "rows",
) -> DataFrame:
    """A DataFrame over Avro container files.

    columns: names or 0-based indexes, kept in schema order; only these are decoded, so give
    them here if few are needed. n_rows: rows in all, before any filter. row_index_name:
    first column, running over all files in order. include_file_paths: name of a last
    column with each row's file. ignore_errors: skip damage (see scan_avro_errors).
    nanos: 'long' keeps nanosecond timestamps as numbers. split_bytes: size of a
    partition's part of a file (default: by the input and the cores, 1 to 128 MB). reader_schema: evolve to it.
    pushdown: apply filters above the scan where records are decoded as well, so that fewer rows leave the
    worker; this turns on spark.sql.python.filterPushdown.enabled in the session.
    buffer_blocks, buffer_bytes and read_chunk_size are accepted and have no effect.
    """
    _check(n_rows, row_index_offset, batch_size)
    paths = paths_of(source, glob, storage_options)
    found = plans.headers(spark, paths, storage_options)
    split_bytes = split_bytes or plans.split_size(found, spark.sparkContext.defaultParallelism)
    record: Schema = plans.unified(found)
    picked = pick_columns(record, columns)
    if _mode == "errors" and picked is None:
        picked = readable(record)
    fields = spark_fields(record, picked, nanos)
    decoded = [f.name for f in fields]
    taken = {f.name for f in fields}
    for name in (row_index_name, include_file_paths):
        if name is not None and name in taken:
            raise SchemaError(f"column {name!r} is there already")
    if row_index_name is not None:
        fields = [T.StructField(row_index_name, T.LongType()), *fields]
    if include_file_paths is not None:
        fields = [*fields, T.StructField(include_file_paths, T.StringType())]
    numbered = n_rows is not None or row_index_name is not None
    if _mode == "errors":
        fields = [*ERROR_SCHEMA.fields, T.StructField("split", T.LongType())]
    splits = None
    if numbered and _mode != "errors":
        splits = plans.counted_splits(spark, found, storage_options, split_bytes, n_rows, row_index_offset, ignore_errors, _count_rows(decoded, max_block_size, storage_options))
    chosen = {"files": [(p, start, size) for p, _, start, size in found], "split_bytes": split_bytes} if splits is None else {"splits": splits}
    plan = chosen | {"nanos": nanos, "ignore_errors": ignore_errors or _mode == "errors", "max_block_size": max_block_size, "batch_size": batch_size, "storage": storage_options, "row_index": row_index_name, "path_column": include_file_paths, "mode": _mode, "columns": decoded, "pushdown": pushdown}
    schema = T.StructType(fields)
    if splits == []:
        return spark.createDataFrame([], schema)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AvroSource)
    hidden = not fields
    if hidden:  # rows without columns are counted by a row number
        schema = T.StructType([T.StructField("__row", T.LongType())])
        plan["row_index"] = "__row"
    df = spark.read.format("avrolith").schema(schema).option("schema", schema.json()).option("plan", json.dumps(plan)).load()
    if hidden:
        return df.select()
    if _mode == "errors":
        return _numbered_errors(df)
    if reader_schema is not None:
        target = reader_schema if isinstance(reader_schema, Schema) else parse_schema(reader_schema)
        df = evolve(df, record, target)
    return df


def _numbered_errors(df: DataFrame) -> DataFrame:
    """Error rows with block indexes of the whole file: the blocks of earlier splits are added."""
    earlier = Window.partitionBy("filepath").orderBy("split").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("block_index"))).over(earlier), F.lit(0))
    return df.withColumn("block_index", F.col("block_index") + before).where("kind is not null").drop("split")


def read_avro(spark: SparkSession, source, **options) -> DataFrame:
    """scan_avro, checked at once: unreadable headers and columns raise here in either case."""
    return scan_avro(spark, source, **options)


def scan_avro_errors(spark: SparkSession, source, **options) -> DataFrame:
    """What a scan with ignore_errors skips: kind, block_index, record_index, file_offset, message, filepath."""
    return scan_avro(spark, source, _mode="errors", **options)


def read_avro_schema(source, *, storage_options: dict | None = None, nanos: str = "micros") -> T.StructType:
    """The Spark schema of the first file, from its header."""
    path = source if isinstance(source, str) or hasattr(source, "__fspath__") else next(iter(source))
    return T.StructType(spark_fields(schema_of(header_of(str(path), storage_options)), None, nanos))


def sink_batches(df: DataFrame, callback, *, batch_size: int = 100_000) -> int:
    """Calls callback(pyarrow.RecordBatch) for all rows of df where they are, on the executors, in batches of
    up to batch_size rows; returns the number of rows. A task that is repeated calls again."""

    def run(batches):
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                callback(batch.slice(at, batch_size))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def collect_batches(df: DataFrame, *, batch_size: int = 100_000):
    """An iterator over df's rows as pyarrow.RecordBatch of up to batch_size rows, in the order of its
    partitions. The driver holds a partition at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, batch_size))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    for row in df.mapInArrow(run, "batch binary").toLocalIterator():
        with pa.ipc.open_stream(bytes(row.batch)) as stream:
            yield from stream


class MultiAvroReader:
    """Iterates over Arrow record batches of files on this machine, in order."""

    def __init__(self, source, *, batch_size: int = 100_000, n_rows: int | None = None, row_index_name: str | None = None, row_index_offset: int = 0, glob: bool = True, include_file_paths: str | None = None, ignore_errors: bool = False, projected_columns=None, storage_options: dict | None = None, max_block_size: int | None = DEFAULT_LIMIT, nanos: str = "micros", buffer_blocks: int = 4, buffer_bytes: int = 64 << 20, read_chunk_size: int | None = None):
        _check(n_rows, row_index_offset, batch_size)
        self._paths = paths_of(source, glob, storage_options)
        found = plans.headers(None, self._paths, storage_options)
        self._record: Schema = plans.unified(found)
        self.schema = found[0][1]
        names = [f.name for f in self._record.fields]
        self._columns = names if projected_columns is None else [n for n in names if n in set(projected_columns)]
        self._options = {"nanos": nanos, "ignore_errors": ignore_errors, "limit": max_block_size, "batch_size": batch_size, "storage": storage_options}
        self.batch_size, self.errors, self.rows_read = batch_size, [], 0
        self._n_rows, self._index, self._offset, self._path = n_rows, row_index_name, row_index_offset, include_file_paths
        self.current_source_index, self.is_finished = 0, False
        self._batches = self._run()

    @property
    def schema_dict(self) -> dict:
        return json.loads(self.schema)

    @property
    def spark_schema(self) -> T.StructType:
        fields = spark_fields(self._record, self._columns, self._options["nanos"])
        fields = [T.StructField(self._index, T.LongType()), *fields] if self._index else fields
        return T.StructType([*fields, T.StructField(self._path, T.StringType())] if self._path else fields)

    @property
    def total_sources(self) -> int:
        return len(self._paths)

    @property
    def error_count(self) -> int:
        return len(self.errors)

    @property
    def pending_records(self) -> int:
        return 0

    def _run(self):
        schema = pa.schema([(f.name, arrow_type(f.dataType)) for f in self.spark_schema.fields])
        for i, path in enumerate(self._paths):
            self.current_source_index = i
            left = None if self._n_rows is None else self._n_rows - self.rows_read
            if left is not None and left <= 0:
                break
            try:
                for arrays, n, names in read_split(Split(path, 0, None, 0, left), self._columns, report=self.errors.append, **self._options):
                    have = dict(zip(names, arrays))
                    if self._index:
                        first = self._offset + self.rows_read
                        have[self._index] = pa.array(np.arange(first, first + n))
                    if self._path:
                        have[self._path] = pa.repeat(pa.scalar(path, pa.string()), n)
                    self.rows_read += n
                    yield pa.RecordBatch.from_arrays([have[f.name] for f in schema], schema=schema)
            except AvroError as e:
                if not self._options["ignore_errors"]:
                    raise
                self.errors.append(BadBlock("BlockParseFailed", 0, None, 0, str(e), path))

    def __iter__(self):
        return self

    def __next__(self) -> pa.RecordBatch:
        try:
            return next(self._batches)
        except StopIteration:
            self.is_finished = True
            raise

    def close(self) -> None:
        self._batches.close()
        self.is_finished = True

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class AvroReader(MultiAvroReader):
    """The same for a single file."""

    def __init__(self, path, **options):
        super().__init__([path], glob=False, **options)


__all__ = ["AvroReader", "MultiAvroReader", "collect_batches", "sink_batches", "read_avro", "read_avro_schema", "scan_avro", "scan_avro_errors"]
