"""Planning of a scan: splits, row numbers and limits, before anything is decoded."""

from __future__ import annotations

from avrolith.container import block_index, open_file, read_header
from avrolith.errors import AvroError
from avrolith.sources import header_of, schema_of, unify
from avrolith.sources.datasource import byte_splits

SPLIT_BYTES = 128 << 20
#: Up to so many files are opened by the driver; more by a Spark job.
DRIVER_FILES = 64
#: Heads of blocks in up to so many splits and bytes are read by the driver; more by a Spark job.
DRIVER_SPLITS, DRIVER_BYTES = 16, 64 << 20


def split_size(found, cores: int) -> int:
    """Two splits a core, of 4 MB to SPLIT_BYTES each."""
    total = sum(size for _, _, _, size in found)
    return min(SPLIT_BYTES, max(4 << 20, -(-total // (2 * max(1, cores)))))


def headers(spark, paths: list[str], storage: dict | None) -> list[tuple[str, str, int, int]]:
    """(path, schema JSON, data start, size) of each file."""

    def one(path):
        h = header_of(path, storage)
        return path, h.schema_json, h.start, h.size

    if spark is None or len(paths) <= DRIVER_FILES:
        return [one(p) for p in paths]

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([one(p) for p in batch.path], columns=["path", "schema", "start", "size"])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000))
    found = {r.path: tuple(r) for r in table.mapInPandas(run, "path string, schema string, start long, size long").collect()}
    return [found[p] for p in paths]


def unified(found) -> object:
    import types

    return unify([(path, schema_of(types.SimpleNamespace(schema_json=text))) for path, text, _, _ in found])


def counted_splits(spark, found, storage, split_bytes: int, n_rows: int | None, offset: int, tolerant: bool, count_rows) -> list[tuple]:
    """Splits with the number of their first row, cut after n_rows rows. Of sound files only the
    heads of blocks are read; damaged blocks yield fewer rows than they announce, so a
    tolerant read counts by decoding. With n_rows, splits are counted in growing runs until
    there are enough."""

    def one(path, start, stop):
        if tolerant:
            return count_rows(path, start, stop)
        with open_file(path, storage) as file:
            return sum(n for _, n in block_index(file, read_header(file, path), start, stop))

    def run(batches):
        for batch in batches:
            yield batch.assign(rows=[one(*x) for x in zip(batch.path, batch.start, batch.stop)])

    splits = [s[:3] for s in byte_splits([(p, start, size) for p, _, start, size in found], split_bytes)]
    out, row, at, step = [], 0, 0, len(splits) if n_rows is None else DRIVER_SPLITS
    while at < len(splits) and (n_rows is None or row < n_rows):
        part = splits[at : at + step]
        at, step = at + step, step * 4
        if spark is None or (len(part) <= DRIVER_SPLITS and not tolerant and sum(stop - start for _, start, stop in part) <= DRIVER_BYTES):
            counts = [one(*s) for s in part]
        else:
            table = spark.createDataFrame([(i, *s) for i, s in enumerate(part)], "i long, path string, start long, stop long").repartition(min(len(part), 1000))
            counts = [r.rows for r in sorted(table.mapInPandas(run, "i long, path string, start long, stop long, rows long").select("i", "rows").collect())]
        for (path, start, stop), rows in zip(part, counts):
            take = rows if n_rows is None else min(rows, n_rows - row)
            if take > 0:
                out.append((path, start, stop, offset + row, take))
            row += take
    return out


__all__ = ["AvroError", "counted_splits", "headers", "unified"]
