"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Equal blocks get the
same integer name: distinct blocks are dealt by hash, sorted within their
partition and numbered in sorted order. Then adjacent names are paired and the
distinct pairs are named in the same way, until one name is left. With the number
of blocks it is the document's identity; it is equal for equal texts and for no
others, since every name stands for one sequence of bytes (no digest decides).

Skew: a task first gives equal blocks one local reference, so a block that a
third of all rows share is shuffled once a task, not once a row; pairs are made
distinct before they are shuffled; group sizes are pre-aggregated.

Defined results: a null text is the empty text; a null id belongs to its text's
group but stays only if no other id does; repeated rows (same id and text) count
one by one in group_size and share kept; an empty table gives an empty
result. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import lookup_join, materialize, shuffle_partitions, text_buffers

BLOCK_BYTES = 16384
#: Bytes of distinct blocks that a task holds to find local repeats.
LOCAL_BYTES = 32 << 20

_BLOCKS = "row long, id long, sha string, n_blocks int, pos int, ref long, block binary"


def _cut(block_bytes: int, local_bytes: int):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("sha", pa.string()), ("n_blocks", pa.int32()), ("pos", pa.int32()), ("ref", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row = next_ref = base
        seen: dict[bytes, int] = {}
        held = 0
        out: list[list] = [[] for _ in schema]
        size = 0

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            out, size = [[] for _ in schema], 0
            return batch

        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            view = memoryview(raw)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                start, end = int(off[i]), int(off[i + 1])
                count = max(1, -(-(end - start) // block_bytes))
                sha = hashlib.sha256(view[start:end]).hexdigest()
                for pos in range(count):
                    block = bytes(view[start + pos * block_bytes : min(end, start + (pos + 1) * block_bytes)])
                    ref = seen.get(block)
                    new = ref is None
                    if new:
                        if held > local_bytes:
                            seen.clear()
                            held = 0
                        ref = next_ref
                        next_ref += 1
                        seen[block] = ref
                        held += len(block) + 100
                        size += len(block)
                    for column, value in zip(out, (row, doc_id, sha if pos == 0 else None, count, pos, ref, block if new else None)):
                        column.append(value)
                row += 1
                if size > 4 << 20 or len(out[0]) >= 20000:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def _number_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, block) sorted by block -> (ref, name): equal blocks, equal names."""
    name = (TaskContext.get().partitionId() << 40) - 1
    last = None
    for batch in batches:
        names = []
        for block in batch.column(1).to_pylist():
            if last is None or block != last:
                name += 1
                last = block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], names=["ref", "name"])


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per row of docs: row, id, sha, n_blocks, name. (n_blocks, name) is
    the collision-free identity of the text."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = materialize(keyed.mapInArrow(_cut(block_bytes, local_bytes), _BLOCKS), "blocks")
    names = blocks.where("block is not null").select("ref", "block").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_number_sorted, "ref long, name long")
    level = materialize(blocks.select("row", "n_blocks", "pos", "ref").join(names, "ref").select("row", "n_blocks", F.col("n_blocks").alias("left"), "pos", "name"), "names")
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    named = level.where("left = 1")
    while most > 1:
        pairs = (
            level.where("left > 1")
            .groupBy("row", "n_blocks", "left", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pair_names = pairs.select("a", "b").distinct().repartition(parts, "a", "b").sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
        level = materialize(pairs.join(pair_names, ["a", "b"]).select("row", "n_blocks", F.expr("cast((left + 1) div 2 as int)").alias("left"), "pos", "name"), "pairs")
        named = named.unionByName(level.where("left = 1"))
        most = (most + 1) // 2
    return blocks.where("pos = 0").select("row", "id", "sha").join(named.select("row", "n_blocks", "name"), "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the largest id with the same text),
    group_size, kept, text_sha256. See the module for nulls and repeated rows."""
    found = materialize(identities(docs, id_col, text_col, block_bytes), "identities")
    groups = materialize(found.groupBy("n_blocks", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    total = found.count()
    joined = lookup_join(found, groups, ["n_blocks", "name"], "group_size", total, "row")
    return joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
