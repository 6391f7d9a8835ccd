"""Helpers shared by the corpus operators: tables in the shared folder, joins
that stand a hot key, and byte access to Arrow text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more rows than an even share of a shuffle partition has, or
#: more than 1/HOT_SHARE of all rows; so there are fewer hot keys than partitions (or HOT_SHARE).
HOT_SHARE = 1000

_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a
    temporary one of our own only where the cluster names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="avrolith-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/avrolith-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the session may be gone by now
        pass


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back. This cuts
    the lineage: lost executors cost no recomputation of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more, not even on recomputation: what
    was made of them has been materialised. Others are left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            remove_path(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot(count: str, total: int, spark: SparkSession) -> Column:
    """Whether a key with so many of total rows is hot."""
    return F.col(count) * max(HOT_SHARE, shuffle_partitions(spark)) > F.lit(total)


def lookup_join(big: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: str) -> DataFrame:
    """Inner join of big with table, whose keys are unique and not null; count
    holds how many rows of big have the key, of total rows.

    Hot keys (see HOT_SHARE; fewer than there are shuffle partitions) are
    broadcast; all other keys go through a shuffle. Rows with a hot key get a
    key of their own there (from the long column spread), so that they don't
    meet in one task.
    """
    values = [c for c in table.columns if c not in keys]
    is_hot = hot(count, total, big.sparkSession)
    hot_ones = table.where(is_hot).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot"))
    # -1 by way of the count: the optimizer would fold a literal and shuffle by the keys alone
    cold = table.where(~is_hot).select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.least(F.col(count), F.lit(-1)).cast("long").alias("__own"), F.struct(*values).alias("__cold"))
    out = big.join(F.broadcast(hot_ones), [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys], "left")
    own = F.when(F.col("__hot").isNull(), F.lit(-1).cast("long")).otherwise(F.abs(F.col(spread)))
    out = out.withColumn("__own_l", own)
    out = out.join(cold, [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__own_l") == F.col("__own")], "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    out = out.withColumn("__found", found).where(F.col("__found").isNotNull())
    return out.select(*big.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.uint64, odd: np.uint64) -> np.ndarray:
    """64-bit hashes of spans of bytes, mixed after every eight of them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix64(sizes.astype(np.uint64) + key)
    left = np.arange(len(sizes))
    while len(left := left[sizes[left] > 0]):
        chunk = eight[starts[left]] & _LOW_BYTES[np.minimum(sizes[left], 8)]
        out[left] = mix64(out[left] * odd + chunk)
        starts, sizes = starts + 8, sizes - 8
    return out


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def texts(arr: pa.Array) -> list[str]:
    """Python strings of a string array; invalid UTF-8 becomes U+FFFD, null is empty."""
    try:
        return [x or "" for x in arr.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in arr.cast(pa.binary()).to_pylist()]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of up to limit bytes, one text at least."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        out.append((start, end))
        start = end
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a fresh uint64 array (changed in place)."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
