"""Times headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set input and cores.

Avro files are exported before timing starts. The four scenarios at the end have the shapes of
"""

from __future__ import annotations

import json
import os
import time

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from avrolith import scan_avro, testing
from avrolith.container import filesystem, read_header
from avrolith.operators import queries as q

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SCENARIO_ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))
REPEATS = 10
HEADLINE = ["scan_full", "scan_project", "flagship", "filter_and_or_not", "row_index", "count_without_columns", "codec_snappy", "codec_deflate", "explode_array", "nested_struct_map", "join_star", "window_rank"]


def repeat_blocks(folder):
    """Each file of a folder with its blocks REPEATS times over: rows to scan, without encoding them all."""
    files, root = filesystem(folder)
    for info in files.get_file_info(fs.FileSelector(root)):
        with files.open_input_file(info.path) as f:
            start = read_header(f).start
            f.seek(0)
            data = f.read()
        with files.open_output_stream(info.path) as out:
            out.write(data[:start] + data[start:] * REPEATS)


def scenarios(spark):
    n = SCENARIO_ROWS // REPEATS
    base = spark.range(n, numPartitions=8)
    kinds = ["id * 7", "concat('value', id)", "id * 0.5D", "cast(id % 100000 as int)", "id % 2 = 0", "cast(id as float)", "cast(concat('b', id) as binary)"]
    simple = base.selectExpr("id", "concat('name', id) as name", "cast(id % 1000 as int) as number", "cast(id as float) as score", "id * 0.1D as value", "id % 3 = 0 as active")
    wide = base.select("id", *[F.expr(kinds[i % 7]).alias(f"c{i}") for i in range(1, 100)])
    nested = base.selectExpr(
        "id",
        "concat('name', id) as name",
        "named_struct('street', concat('street', id), 'city', concat('city', id % 1000), 'zip', cast(id % 99999 as string), 'place', if(id % 3 = 0, null, named_struct('lat', id * 0.1D, 'lon', id * 0.2D))) as address",
        "transform(sequence(0, cast(id % 3 as int)), i -> named_struct('kind', 'mail', 'value', concat('m', id), 'first', i = 0)) as contacts",
        "slice(array('a', 'b', concat('t', id)), 1, cast(id % 4 as int)) as tags",
        "map('k', concat('v', id), 'l', 'w') as meta",
        "if(id % 2 = 0, id * 0.3D, null) as score",
    )
    out = {}
    for name, df in (("simple", simple), ("wide", wide), ("complex", nested)):
        convert = (lambda r: r | {"meta": dict(r["meta"])}) if name == "complex" else None
        # blocks of 16,000 bytes, as the baseline's files have
        folder = testing.export_avro(df, q._folder(spark), "id", files=8, block_rows=1 << 30, block_bytes=16_000, convert=convert)
        repeat_blocks(folder)
        out[name] = lambda f=folder: scan_avro(spark, f + "/*.avro")
        if name == "wide":
            out["projection"] = lambda f=folder: scan_avro(spark, f + "/*.avro", columns=["id", "c20", "c40", "c60", "c80"])
    return out


def timed(make) -> float:
    best = []
    for _ in range(3):
        t = time.time()
        make().write.format("noop").mode("overwrite").save()
        best.append(time.time() - t)
    return round(sorted(best)[1], 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run = lambda f=q.QUERIES[name]: f(spark, SF)
        run().write.format("noop").mode("overwrite").save()
        times[name] = timed(run)
    for name, make in scenarios(spark).items():
        make().write.format("noop").mode("overwrite").save()
        times[f"baseline_{name}_{SCENARIO_ROWS}"] = timed(make)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
