"""Queries over Avro scans, each with SQL for the tables they were written from.

The tables are exported to Avro once per folder of input and scanned from there.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from avrolith import testing
from avrolith.api import AvroReader, MultiAvroReader, collect_batches, read_avro, read_avro_schema, scan_avro, scan_avro_errors, sink_batches
from avrolith.container import block_index, filesystem, open_file, read_header
from avrolith.errors import AvroError
from avrolith.schema import check_compatibility, parse_schema

_exports: dict[tuple, str] = {}
_own_dirs: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir), a temporary one
    where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="avrolith-")
        _own_dirs[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/avro-{uuid.uuid4().hex}"


def _exists(path: str) -> bool:
    files, inner = filesystem(path)
    return files.get_file_info(inner).type != pa.fs.FileType.NotFound


def export(spark: SparkSession, sf_dir: str, table: str, key: str, *, tag: str = "", make=None, **options) -> str:
    """Folder of a table's Avro files. make: a change of the DataFrame before it is written."""
    name = (spark.sparkContext.applicationId, sf_dir, table, tag, str(sorted((k, str(v)) for k, v in options.items() if k not in ("convert", "schema"))))
    if name not in _exports or not _exists(_exports[name]):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        _exports[name] = testing.export_avro(make(df) if make else df, _folder(spark), key, **options)
    return _exports[name]


def _lineitem(spark, sf_dir, **options):
    folder = export(spark, sf_dir, "lineitem", "k", make=lambda df: df.withColumn("k", F.expr("l_orderkey * 10 + l_linenumber")))
    return scan_avro(spark, f"{folder}/*.avro", **options)


def _orders(spark, sf_dir, **options):
    return scan_avro(spark, f"{export(spark, sf_dir, 'orders', 'o_orderkey', files=3)}/*.avro", **options)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, l_orderkey * 10 + l_linenumber AS k FROM lineitem")
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir)


@query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def scan_project(spark, sf_dir):
    return _lineitem(spark, sf_dir, columns=["l_shipdate", "l_orderkey", "l_quantity"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project_by_index(spark, sf_dir):
    return _orders(spark, sf_dir, columns=[3, 0])


@query("SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def read_project_filter(spark, sf_dir):
    return read_avro(spark, f"{export(spark, sf_dir, 'orders', 'o_orderkey', files=3)}/*.avro", columns=["o_orderkey", "o_totalprice", "o_orderstatus"]).where("o_orderstatus = 'F'").select("o_totalprice", "o_orderkey")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n,
          round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship(spark, sf_dir):
    df = _lineitem(spark, sf_dir, columns=["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    return (
        df.where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
    )


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_FILTERS = {
    "filter_eq": "o_orderstatus = 'F'",
    "filter_gt": "o_totalprice > 200000",
    "filter_lt": "o_totalprice < 20000",
    "filter_and_or_not": "(o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT (o_orderpriority <> '1-URGENT')",
    "filter_in": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_between": "o_totalprice BETWEEN 50000 AND 100000",
    "filter_is_not_null": "o_custkey IS NOT NULL AND o_orderstatus = 'O'",
}
for _name, _where in _FILTERS.items():
    QUERIES[_name] = lambda spark, sf_dir, w=_where: _orders(spark, sf_dir, columns=_ORDER.split(", ")).where(w).select(*_ORDER.split(", "))
    ORACLES[_name] = f"SELECT {_ORDER} FROM orders WHERE {_where}"


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'A') AND starts_with(p_brand, 'Brand#1') AND regexp_matches(p_name, '[aeiou]')")
def filter_strings(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "part", "p_partkey", files=1) + "/*.avro")
    return df.where(F.col("p_type").contains("A") & F.col("p_brand").startswith("Brand#1") & F.col("p_name").rlike("[aeiou]")).select("p_partkey", "p_type")


_NUMBERED = "WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"


@query(f"{_NUMBERED} SELECT o_orderkey, o_totalprice FROM t WHERE rn < 5000 AND o_totalprice > 100000")
def n_rows_then_filter(spark, sf_dir):
    return _orders(spark, sf_dir, n_rows=5000, columns=["o_orderkey", "o_totalprice"]).where("o_totalprice > 100000")


@query(f"{_NUMBERED} SELECT rn AS idx, o_orderkey FROM t")
def row_index(spark, sf_dir):
    return _orders(spark, sf_dir, row_index_name="idx", columns=["o_orderkey"])


@query(f"{_NUMBERED} SELECT rn + 1000 AS idx, o_orderkey, o_orderstatus FROM t WHERE rn % 7 = 3")
def row_index_offset(spark, sf_dir):
    return _orders(spark, sf_dir, row_index_name="idx", row_index_offset=1000, columns=["o_orderkey", "o_orderstatus"]).where("(idx - 1000) % 7 = 3")


@query(f"{_NUMBERED} SELECT o_orderkey FROM t WHERE rn >= 1200 AND rn < 1300")
def slice_rows(spark, sf_dir):
    return _orders(spark, sf_dir, row_index_name="idx", columns=["o_orderkey"], n_rows=1300).where("idx >= 1200").select("o_orderkey")


@query("SELECT count(*) AS n FROM orders")
def count_without_columns(spark, sf_dir):
    return _orders(spark, sf_dir, columns=[]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 3 AS files, count(*) AS n FROM orders")
def file_paths(spark, sf_dir):
    df = _orders(spark, sf_dir, include_file_paths="path", columns=["o_orderkey"])
    return df.agg(F.countDistinct("path").cast("int").alias("files"), F.count("o_orderkey").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_sort(spark, sf_dir):
    return _orders(spark, sf_dir, columns=["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM orders GROUP BY 1")
def group_mean_count(spark, sf_dir):
    return _orders(spark, sf_dir, columns=["o_orderpriority", "o_totalprice"]).groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS least, count(*) - count(o_custkey) AS nulls FROM orders")
def sum_min_nulls(spark, sf_dir):
    return _orders(spark, sf_dir).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("least"), F.count_if(F.col("o_custkey").isNull()).alias("nulls"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_columns(spark, sf_dir):
    return _orders(spark, sf_dir, columns=["o_orderstatus", "o_orderpriority"]).distinct()


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_vertical(spark, sf_dir):
    folder = export(spark, sf_dir, "region", "r_regionkey", files=1)
    return scan_avro(spark, folder + "/part-00000.avro").unionByName(scan_avro(spark, [folder + "/*.avro"]))


for _codec in ("null", "deflate", "snappy", "zstandard", "bzip2", "xz"):
    QUERIES[f"codec_{_codec}"] = lambda spark, sf_dir, c=_codec: scan_avro(spark, export(spark, sf_dir, "customer", "c_custkey", files=1, codec=c, block_rows=300) + "/*.avro")
    ORACLES[f"codec_{_codec}"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def field_order_drift(spark, sf_dir):
    a = export(spark, sf_dir, "nation", "n_nationkey", files=1)
    b = export(spark, sf_dir, "nation", "n_nationkey", tag="turned", files=1, make=lambda df: df.select("n_regionkey", "n_name", (F.col("n_nationkey") + 100).alias("n_nationkey")))
    return scan_avro(spark, [f"{a}/part-00000.avro", f"{b}/part-00000.avro"])


@query("SELECT o_orderkey FROM orders")
def glob_braces(spark, sf_dir):
    return scan_avro(spark, export(spark, sf_dir, "orders", "o_orderkey", files=3) + "/part-0000{0,1,2}.avro", columns=["o_orderkey"])


@query("SELECT o_orderkey FROM orders")
def glob_recursive(spark, sf_dir):
    above, _, folder = export(spark, sf_dir, "orders", "o_orderkey", files=3).rpartition("/")
    return scan_avro(spark, f"{above}/**/{folder}/*.avro", columns=["o_orderkey"])


_TYPES = {
    "type": "record",
    "name": "Types",
    "fields": [
        {"name": "id", "type": "long"},
        {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}},
        {"name": "price_fixed", "type": {"type": "fixed", "name": "D8", "size": 8, "logicalType": "decimal", "precision": 14, "scale": 2}},
        {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        {"name": "at_ms", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "at_us", "type": {"type": "long", "logicalType": "local-timestamp-micros"}},
        {"name": "at_ns", "type": {"type": "long", "logicalType": "local-timestamp-nanos"}},
        {"name": "clock", "type": {"type": "int", "logicalType": "time-millis"}},
        {"name": "status", "type": {"type": "enum", "name": "Status", "symbols": ["F", "O", "P"]}},
        {"name": "raw", "type": {"type": "fixed", "name": "Raw", "size": 4}},
        {"name": "guid", "type": {"type": "fixed", "name": "Guid", "size": 16, "logicalType": "uuid"}},
        {"name": "span", "type": {"type": "fixed", "name": "Span", "size": 12, "logicalType": "duration"}},
        {"name": "big", "type": {"type": "bytes", "logicalType": "big-decimal"}},
    ],
}


def _typed(row: dict) -> dict:
    cents = round(row["o_totalprice"] * 100)
    us = row["o_orderdate"]
    n = row["o_orderkey"]
    raw = cents.to_bytes(8, "big", signed=True)
    return {
        "id": n,
        "price": raw,
        "price_fixed": raw,
        "day": us // 86_400_000_000,
        "at_ms": us // 1000,
        "at_us": us,
        "at_ns": us * 1000 + 7,
        "clock": n % 86_400_000,
        "status": row["o_orderstatus"] if row["o_orderstatus"] in "FOP" else "P",
        "raw": (n % 2**31).to_bytes(4, "big"),
        "guid": n.to_bytes(16, "big"),
        "span": (n % 5).to_bytes(4, "little") + (n % 28).to_bytes(4, "little") + (n % 1000).to_bytes(4, "little"),
        "big": testing.long(8) + raw + testing.long(2),
    }


@query(
    """SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(round(o_totalprice * 100) AS BIGINT) AS cents_fixed,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, epoch_ms(o_orderdate) AS at_ms, epoch_us(o_orderdate) AS at_us, epoch_us(o_orderdate) AS at_ns,
       (o_orderkey % 86400000) * 1000 AS clock, CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN o_orderstatus ELSE 'P' END AS status,
       upper(printf('%08x', (o_orderkey % 2147483648)::BIGINT)) AS raw, '00000000-0000-0000-0000-' || printf('%012x', o_orderkey::BIGINT) AS guid,
       ((o_orderkey % 5) * 30 + o_orderkey % 28) * 86400000 + o_orderkey % 1000 AS span_ms,
       CAST(round(o_totalprice * 100) AS BIGINT) AS big_cents FROM orders"""
)
def logical_types(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "orders", "o_orderkey", tag="types", schema=_TYPES, convert=_typed) + "/*.avro")
    micros = lambda c: F.expr(f"unix_micros(cast({c} as timestamp))")
    return df.select(
        "id",
        (F.col("price") * 100).cast("long").alias("cents"),
        (F.col("price_fixed") * 100).cast("long").alias("cents_fixed"),
        F.col("day").cast("string").alias("day"),
        F.expr("unix_millis(at_ms)").alias("at_ms"),
        micros("at_us").alias("at_us"),
        micros("at_ns").alias("at_ns"),
        "clock",
        "status",
        F.hex("raw").alias("raw"),
        "guid",
        F.expr("cast(cast(extract(day from span) as long) * 86400000 + extract(hour from span) * 3600000 + extract(minute from span) * 60000 + extract(second from span) * 1000 as long)").alias("span_ms"),
        (F.col("big").cast("decimal(20,2)") * 100).cast("long").alias("big_cents"),
    )


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 5) AS first, len(embedding) AS n FROM embeddings")
def nested_array(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "embeddings", "vec_id") + "/*.avro")
    return df.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").cast("long").alias("n"))


@query("SELECT label, count(*) AS n, round(sum(x), 2) AS total FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def explode_array(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "embeddings", "vec_id") + "/*.avro", columns=["embedding", "label"])
    return df.select("label", F.explode("embedding").alias("x")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 2).alias("total"))


def _nest(df):
    return df.select("c_custkey", F.struct("c_name", "c_nationkey", F.struct("c_acctbal").alias("money")).alias("who"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("tags"))


def _nest_row(row):
    return row | {"tags": dict(row["tags"])}


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def nested_struct_map(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "customer", "c_custkey", tag="nest", make=_nest, convert=_nest_row) + "/*.avro")
    return df.select("c_custkey", F.col("who.c_name").alias("name"), F.col("who.money.c_acctbal").alias("balance"), F.col("tags")["segment"].alias("segment"))


_TREE = {"type": "record", "name": "Node", "fields": [{"name": "id", "type": "long"}, {"name": "next", "type": ["null", "Node"]}]}


def _tree(row):
    return {"id": row["n_nationkey"], "next": {"id": row["n_regionkey"], "next": None}}


@query("SELECT n_nationkey AS id, n_regionkey AS next_id FROM nation")
def recursive_json(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "nation", "n_nationkey", tag="tree", schema=_TREE, convert=_tree, files=1) + "/*.avro")
    return df.select("id", F.get_json_object("next", "$.id").cast("int").alias("next_id"))


def _sparse(df):
    return df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def nullable_union(spark, sf_dir):
    return scan_avro(spark, export(spark, sf_dir, "orders", "o_orderkey", tag="sparse", make=_sparse) + "/*.avro", columns=["o_orderkey", "o_custkey"])


def damaged(spark, sf_dir, kind: str = "payload") -> str:
    """customer in blocks of 40 rows, with the third block broken: its payload, its sync marker,
    its size, or (uncompressed) the length of a string in its first record."""
    codec = "null" if kind == "record" else "deflate"
    folder = export(spark, sf_dir, "customer", "c_custkey", tag="damaged", files=1, codec=codec, block_rows=40)
    broken = f"{folder}/broken-{kind}.avro"
    if not _exists(broken):
        with open_file(f"{folder}/part-00000.avro") as f:
            found = block_index(f, read_header(f))
            f.seek(0)
            data = bytearray(f.read())
        at, after = found[2][0], found[3][0]
        if kind == "payload":
            for i in range(at + 12, at + 40):
                data[i] ^= 0xAA
        elif kind == "marker":
            data[after - 16] ^= 0xFF
        elif kind == "size":  # a block of 40 records and 2 ** 33 bytes
            data[at : at + 6] = testing.long(40) + testing.long(2**33)[:5]
        else:
            head = at + len(testing.long(40)) + len(testing.long(after - at))
            data[head + 8 : head + 12] = b"\xff" * 4
        files, inner = filesystem(broken)
        with files.open_output_stream(inner + ".tmp") as f:
            f.write(bytes(data))
        files.move(inner + ".tmp", inner)
    return broken


@query("WITH t AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer) SELECT c_custkey, c_name FROM t WHERE NOT (rn >= 80 AND rn < 120)")
def skip_damage(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir), ignore_errors=True, columns=["c_custkey", "c_name"])


@query("SELECT 'DecompressionFailed' AS kind, 2 AS block_index")
def bad_block_report(spark, sf_dir):
    return scan_avro_errors(spark, damaged(spark, sf_dir)).select("kind", F.col("block_index").cast("int").alias("block_index"))


_EVOLVED = {"type": "record", "name": "Row", "fields": [{"name": "key", "aliases": ["n_nationkey"], "type": ["null", "long"]}, {"name": "n_name", "type": ["null", "string"]}, {"name": "added", "type": "string", "default": "none"}]}


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name, 'none' AS added FROM nation")
def evolution(spark, sf_dir):
    return scan_avro(spark, export(spark, sf_dir, "nation", "n_nationkey", files=1) + "/*.avro", reader_schema=parse_schema(_EVOLVED))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_star(spark, sf_dir):
    customer = scan_avro(spark, export(spark, sf_dir, "customer", "c_custkey", files=1, codec="snappy", block_rows=300) + "/*.avro", columns=["c_custkey", "c_nationkey"])
    nation = scan_avro(spark, export(spark, sf_dir, "nation", "n_nationkey", files=1) + "/*.avro")
    joined = _orders(spark, sf_dir, columns=["o_custkey", "o_totalprice"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders QUALIFY rk <= 2")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _orders(spark, sf_dir, columns=["o_orderkey", "o_custkey", "o_totalprice"]).select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rk")).where("rk <= 2")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def sql_rollup(spark, sf_dir):
    view = f"orders_{uuid.uuid4().hex}"
    _orders(spark, sf_dir, columns=["o_orderstatus", "o_orderpriority"]).createOrReplaceTempView(view)
    return spark.sql(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {view} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 10")
def sink_parquet(spark, sf_dir):
    out = _folder(spark)
    df = scan_avro(spark, export(spark, sf_dir, "part", "p_partkey", files=1) + "/*.avro", columns=["p_partkey", "p_size"])
    df.where("p_size > 10").withColumn("p_size", F.col("p_size").cast("long")).write.parquet(out)
    return spark.read.parquet(out)


# --- what is left of the scan's surface ----------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def filter_is_null(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "orders", "o_orderkey", tag="sparse", make=_sparse) + "/*.avro", columns=["o_orderkey", "o_custkey", "o_totalprice"])
    return df.where("o_custkey IS NULL").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def filter_enum(spark, sf_dir):
    df = scan_avro(spark, export(spark, sf_dir, "orders", "o_orderkey", tag="types", schema=_TYPES, convert=_typed) + "/*.avro", columns=["id", "status"])
    return df.where("status IN ('F', 'O') AND status <> 'P'")


@query(f"{_NUMBERED} SELECT o_orderkey FROM t WHERE rn >= (SELECT count(*) FROM t) - 25")
def tail_rows(spark, sf_dir):
    df = _orders(spark, sf_dir, row_index_name="idx", columns=["o_orderkey"])
    return df.orderBy(F.desc("idx")).limit(25).select("o_orderkey")


@query(f"{_NUMBERED} SELECT o_orderkey FROM t WHERE rn < 10")
def head_rows(spark, sf_dir):
    return _orders(spark, sf_dir, n_rows=10, columns=["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE false")
def empty_result(spark, sf_dir):
    return _orders(spark, sf_dir, n_rows=0, columns=["o_orderkey", "o_totalprice"])


@query("SELECT o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 100000")
def select_in_any_order(spark, sf_dir):
    return _orders(spark, sf_dir).where("o_totalprice > 100000").select("o_orderpriority", "o_orderkey")


def _listed(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) AS t(nr, name, type)")
def file_schema(spark, sf_dir):
    folder = export(spark, sf_dir, "orders", "o_orderkey", files=3)
    found = read_avro_schema(f"{folder}/part-00001.avro")
    assert found == scan_avro(spark, f"{folder}/*.avro").schema
    return _listed(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(found.fields)], "nr int, name string, type string")


@query("SELECT 'avro.codec' AS key, 'deflate' AS value UNION ALL SELECT 'fields', '5' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM customer")
def header_metadata(spark, sf_dir):
    path = export(spark, sf_dir, "customer", "c_custkey", files=1, codec="deflate", block_rows=300) + "/part-00000.avro"
    with open_file(path) as f:
        head = read_header(f)
        rows = sum(n for _, n in block_index(f, head))
    fields = len(json.loads(head.metadata["avro.schema"])["fields"])
    return _listed(spark, [("avro.codec", head.metadata["avro.codec"].decode()), ("fields", str(fields)), ("rows", str(rows))], "key string, value string")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def large_block(spark, sf_dir):
    return scan_avro(spark, export(spark, sf_dir, "customer", "c_custkey", files=1, codec="null", block_rows=1 << 30) + "/*.avro", max_block_size=None)


def _of_batches(spark, batches, schema):
    tables = [pa.Table.from_batches([b]) for b in batches]
    return spark.createDataFrame(pa.concat_tables(tables)) if tables else spark.createDataFrame([], schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def reader_single(spark, sf_dir):
    with AvroReader(export(spark, sf_dir, "nation", "n_nationkey", files=1) + "/part-00000.avro", batch_size=7) as reader:
        return _of_batches(spark, reader, reader.spark_schema)


@query(f"{_NUMBERED} SELECT rn + 5 AS idx, o_orderkey, o_orderpriority FROM t WHERE rn < 2500")
def reader_many(spark, sf_dir):
    folder = export(spark, sf_dir, "orders", "o_orderkey", files=3)
    with MultiAvroReader(f"{folder}/*.avro", projected_columns=["o_orderkey", "o_orderpriority"], row_index_name="idx", row_index_offset=5, n_rows=2500, batch_size=999) as reader:
        return _of_batches(spark, reader, reader.spark_schema)


@query("SELECT 1000 AS batch_size, true AS within, count(*) AS rows_read, 3 AS total_sources, 0 AS errors, true AS is_finished, 0 AS pending FROM orders")
def reader_properties(spark, sf_dir):
    with MultiAvroReader(export(spark, sf_dir, "orders", "o_orderkey", files=3) + "/*.avro", batch_size=1000) as r:
        most = max(b.num_rows for b in r)
        row = (r.batch_size, most <= 1000, r.rows_read, r.total_sources, r.error_count, r.is_finished, r.pending_records)
    return _listed(spark, [row], "batch_size int, within boolean, rows_read long, total_sources int, errors int, is_finished boolean, pending int")


@query("SELECT 0 AS stray_rows, true AS small, count(*) AS n FROM orders")
def batch_sizes(spark, sf_dir):
    """Batches of a scan as its consumer gets them."""
    sizes = [b.num_rows for b in collect_batches(_orders(spark, sf_dir, columns=["o_orderkey"]), batch_size=500)]
    return _listed(spark, [(0, max(sizes) <= 500, sum(sizes))], "stray_rows int, small boolean, n long")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def collect_in_batches(spark, sf_dir):
    df = _orders(spark, sf_dir, columns=["o_orderkey", "o_totalprice"]).where("o_totalprice > 200000")
    return _of_batches(spark, collect_batches(df, batch_size=100), df.schema)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sink_in_batches(spark, sf_dir):
    """A callback on the executors that writes every batch as a Parquet file."""
    out = _folder(spark)
    df = _orders(spark, sf_dir, columns=["o_orderkey", "o_totalprice", "o_orderstatus"]).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")

    def write(batch):
        import pyarrow.parquet as pq

        files, root = filesystem(out)
        files.create_dir(root, recursive=True)
        pq.write_table(pa.Table.from_batches([batch]), f"{root}/{uuid.uuid4().hex}.parquet", filesystem=files)

    n = sink_batches(df, write, batch_size=700)
    return spark.read.schema(df.schema).parquet(out) if n else df


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def cached_scan(spark, sf_dir):
    """A scan that is planned once and read by two branches."""
    df = _orders(spark, sf_dir, columns=["o_orderkey", "o_orderstatus"])
    return df.where("o_orderkey % 2 = 0").unionByName(df.where("o_orderkey % 2 <> 0")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- damage ---------------------------------------------------------------------------------

_CUSTOMERS = "WITH t AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer)"


@query(f"{_CUSTOMERS} SELECT c_custkey, c_name FROM t")
def skip_wrong_marker(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir, "marker"), ignore_errors=True, columns=["c_custkey", "c_name"])


@query(f"{_CUSTOMERS} SELECT c_custkey, c_name FROM t WHERE NOT (rn >= 80 AND rn < 120)")
def skip_wrong_size(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir, "size"), ignore_errors=True, columns=["c_custkey", "c_name"])


@query(f"{_CUSTOMERS} SELECT c_custkey, c_name FROM t WHERE NOT (rn >= 80 AND rn < 120)")
def skip_wrong_record(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir, "record"), ignore_errors=True, columns=["c_custkey", "c_name"])


@query("WITH t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer), s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM t WHERE NOT (rn >= 80 AND rn < 120)) SELECT idx, c_custkey FROM s WHERE idx < 130")
def skip_damage_numbered(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir), ignore_errors=True, columns=["c_custkey"], row_index_name="idx", n_rows=130, split_bytes=1500)


@query(f"{_CUSTOMERS} SELECT c_custkey, c_name FROM t WHERE NOT (rn >= 80 AND rn < 120)")
def skip_damage_in_splits(spark, sf_dir):
    return scan_avro(spark, damaged(spark, sf_dir), ignore_errors=True, columns=["c_custkey", "c_name"], split_bytes=700)


@query("SELECT * FROM (VALUES ('payload', 'DecompressionFailed', 2), ('marker', 'InvalidSyncMarker', 2), ('size', 'BlockParseFailed', 2), ('record', 'RecordDecodeFailed', 2)) AS t(damage, kind, block_index)")
def bad_block_kinds(spark, sf_dir):
    out = None
    for kind in ("payload", "marker", "size", "record"):
        one = scan_avro_errors(spark, damaged(spark, sf_dir, kind), split_bytes=900).select(F.lit(kind).alias("damage"), "kind", F.col("block_index").cast("int").alias("block_index"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(ceil(count(*) / 40) AS INT) AS blocks, 'DecompressionFailed' AS kind FROM customer")
def decompression_limit(spark, sf_dir):
    """All blocks inflate to more than is allowed."""
    folder = export(spark, sf_dir, "customer", "c_custkey", tag="damaged", files=1, codec="deflate", block_rows=40)
    found = scan_avro_errors(spark, f"{folder}/part-00000.avro", max_block_size=100)
    return found.groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("blocks"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM customer")
def skip_null_records(spark, sf_dir):
    """Blocks of records of nulls have no bytes, and are as sound as any."""
    schema = {"type": "record", "name": "Nulls", "fields": [{"name": "nothing", "type": "null"}]}
    folder = export(spark, sf_dir, "customer", "c_custkey", tag="nulls", files=1, codec="null", block_rows=50, schema=schema, convert=lambda r: {"nothing": None})
    return scan_avro(spark, f"{folder}/*.avro", ignore_errors=True).where("nothing IS NULL").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('payload', 'CodecError'), ('marker', 'ParseError'), ('size', 'ParseError'), ('record', 'DecodeError'), ('missing', 'SourceNotFoundError'), ('column', 'SchemaError'), ('rows', 'ConfigurationError'), ('magic', 'ParseError')) AS t(damage, error)")
def strict_errors(spark, sf_dir):
    """What a strict read raises."""
    folder = export(spark, sf_dir, "nation", "n_nationkey", files=1)
    text = f"{folder}/not-avro.txt"
    if not _exists(text):
        files, inner = filesystem(text)
        with files.open_output_stream(inner) as f:
            f.write(b"not a container file")

    def read(path, **options):
        with AvroReader(path, **options) as reader:
            for _ in reader:
                pass

    tries = {kind: lambda k=kind: read(damaged(spark, sf_dir, k)) for kind in ("payload", "marker", "size", "record")}
    tries |= {"missing": lambda: read(f"{folder}/no.avro"), "column": lambda: scan_avro(spark, f"{folder}/*.avro", columns=["nope"]), "rows": lambda: scan_avro(spark, f"{folder}/*.avro", n_rows=-1), "magic": lambda: read(text)}
    rows = []
    for name, go in tries.items():
        try:
            go()
            rows.append((name, "none"))
        except AvroError as e:
            rows.append((name, type(e).__name__))
    return _listed(spark, rows, "damage string, error string")


# --- schemas --------------------------------------------------------------------------------

_INNER = {"type": "record", "name": "Who", "fields": [{"name": "name", "type": "string"}, {"name": "nation", "type": "int"}, {"name": "grade", "type": {"type": "enum", "name": "Grade", "symbols": ["LOW", "MID", "HIGH"]}}]}
_WRITTEN = {"type": "record", "name": "Customer", "fields": [{"name": "id", "type": "long"}, {"name": "who", "type": ["null", _INNER]}, {"name": "old", "type": {"type": "array", "items": "Who"}}, {"name": "tags", "type": {"type": "map", "values": "float"}}]}
_WANTED = {
    "type": "record",
    "name": "Customer",
    "fields": [
        {"name": "id", "type": "double"},
        {"name": "person", "aliases": ["who"], "type": ["null", {"type": "record", "name": "Who", "fields": [{"name": "grade", "type": {"type": "enum", "name": "Grade", "symbols": ["LOW", "HIGH", "OTHER"], "default": "OTHER"}}, {"name": "country", "aliases": ["nation"], "type": "long"}, {"name": "title", "type": "string", "default": "none"}]}]},
        {"name": "old", "type": {"type": "array", "items": "Who"}},
        {"name": "tags", "type": {"type": "map", "values": "double"}},
    ],
}


def _person(row):
    who = {"name": row["c_name"], "nation": row["c_nationkey"], "grade": ("LOW", "MID", "HIGH")[row["c_custkey"] % 3]}
    return {"id": row["c_custkey"], "who": who if row["c_custkey"] % 5 else None, "old": [who], "tags": {"half": 0.5 * (row["c_custkey"] % 8)}}


@query(
    """SELECT CAST(c_custkey AS DOUBLE) AS id, CASE WHEN c_custkey % 5 <> 0 THEN g END AS grade, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS country,
       CASE WHEN c_custkey % 5 <> 0 THEN 'none' END AS title, g AS old_grade, CAST(c_nationkey AS BIGINT) AS old_country, 0.5 * (c_custkey % 8)::DOUBLE AS half
       FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'OTHER' ELSE 'HIGH' END AS g FROM customer)"""
)
def nested_evolution(spark, sf_dir):
    """Aliases, promotions, defaults and enum defaults inside records, arrays and maps."""
    folder = export(spark, sf_dir, "customer", "c_custkey", tag="people", files=2, schema=_WRITTEN, convert=_person)
    df = scan_avro(spark, folder + "/*.avro", reader_schema=parse_schema(_WANTED))
    return df.select("id", "person.grade", "person.country", "person.title", F.col("old")[0]["grade"].alias("old_grade"), F.col("old")[0]["country"].alias("old_country"), F.col("tags")["half"].alias("half"))


@query(
    """SELECT * FROM (VALUES ('int to long', ''), ('long to int', 'TypeMismatch'), ('new field', 'MissingDefault'), ('new field with default', ''), ('other name', 'NameMismatch'),
       ('fewer symbols', 'MissingSymbol'), ('fewer symbols with default', ''), ('other size', 'SizeMismatch'), ('narrower union', 'UnionMismatch'), ('other scale', 'LogicalMismatch'), ('string to bytes', '')) AS t(change, reasons)"""
)
def compatibility(spark, sf_dir):
    enum = lambda symbols, **more: {"type": "enum", "name": "E", "symbols": symbols, **more}
    record = lambda *fields, name="R": {"type": "record", "name": name, "fields": list(fields)}
    decimal = lambda scale: {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": scale}
    a = {"name": "a", "type": "int"}
    cases = {  # reader, writer
        "int to long": ("long", "int"),
        "long to int": ("int", "long"),
        "new field": (record(a, {"name": "b", "type": "int"}), record(a)),
        "new field with default": (record(a, {"name": "b", "type": "int", "default": 1}), record(a)),
        "other name": (record(a, name="S"), record(a)),
        "fewer symbols": (enum(["x"]), enum(["x", "y"])),
        "fewer symbols with default": (enum(["x"], default="x"), enum(["x", "y"])),
        "other size": ({"type": "fixed", "name": "F", "size": 4}, {"type": "fixed", "name": "F", "size": 5}),
        "narrower union": (["null", "int"], ["null", "string"]),
        "other scale": (decimal(2), decimal(3)),
        "string to bytes": ("bytes", "string"),
    }
    rows = [(name, ",".join(sorted({x.reason for x in check_compatibility(parse_schema(r), parse_schema(w))}))) for name, (r, w) in cases.items()]
    return _listed(spark, rows, "change string, reasons string")


@query("SELECT count(*) AS n, 3 AS files FROM orders")
def object_store(spark, sf_dir):
    """Files of an object store, found by a pattern; two requests are refused first."""
    folder = export(spark, sf_dir, "orders", "o_orderkey", files=3)
    objects = {}
    for i in range(3):
        with open_file(f"{folder}/part-{i:05d}.avro") as f:
            objects[f"bucket/data/part-{i}.avro"] = f.read()
    with testing.MockStore(objects | {"bucket/data/other.txt": b""}, failures=2, access_key="key") as store:
        options = {"endpoint": store.endpoint, "aws_access_key_id": "key", "aws_secret_access_key": "secret", "region": "us-east-1", "max_retries": 5}
        with MultiAvroReader("s3a://bucket/data/part-[0-9].avro", storage_options=options, projected_columns=["o_orderkey"]) as reader:
            n = sum(b.num_rows for b in reader)
            return _listed(spark, [(n, reader.total_sources)], "n long, files int")


_PUSHED = {
    "pushed_equal": "o_orderpriority = '1-URGENT'",
    "pushed_range": "o_orderkey > 500 AND o_orderkey <= 1500 AND o_totalprice > 50000",
    "pushed_in": "o_orderstatus IN ('F', 'P') AND NOT o_orderpriority IN ('2-HIGH', '5-LOW')",
    "pushed_strings": "starts_with(o_orderpriority, '1') OR contains(o_orderpriority, 'LOW')",
    "pushed_null": "o_custkey IS NOT NULL AND o_orderpriority <> '3-MEDIUM'",
}
for _name, _where in _PUSHED.items():
    QUERIES[_name] = lambda spark, sf_dir, w=_where: _orders(spark, sf_dir, pushdown=True, columns=_ORDER.split(", ")).where(w.replace("starts_with(", "startswith(")).select(*_ORDER.split(", "))
    ORACLES[_name] = f"SELECT {_ORDER} FROM orders WHERE {_where}"


@query(f"{_NUMBERED} SELECT rn AS idx, o_orderkey FROM t WHERE rn < 1000 AND o_orderkey % 2 = 0 AND o_orderstatus = 'O'")
def pushed_after_limit(spark, sf_dir):
    """Rows are numbered and limited before any filter."""
    df = _orders(spark, sf_dir, pushdown=True, columns=["o_orderkey", "o_orderstatus"], row_index_name="idx", n_rows=1000)
    return df.where("o_orderstatus = 'O' AND o_orderkey % 2 = 0").select("idx", "o_orderkey")
