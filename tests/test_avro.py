"""The Avro scan: types, codecs, sources, errors, schemas."""

import json
import math
import random
import warnings

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import avrolith as av
from avrolith import testing
from avrolith.codecs import compress, decompress
from avrolith.container import block_index, read_header
from avrolith.decode import Decoder
from avrolith.lockstep import Damage, LockstepDecoder
from avrolith.schema import as_record, parse_schema, to_json
from avrolith.sources import expand_braces, paths_of
from avrolith.sources.datasource import Split, byte_splits, read_split

PEOPLE = {"type": "record", "name": "Person", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": "string"}]}
ROWS = [{"id": i, "name": n} for i, n in enumerate("Alice Bob Charlie Diana Eve Frank Grace".split(), 1)]


@pytest.fixture
def people(tmp_path):
    path = str(tmp_path / "people.avro")
    testing.write_avro(path, PEOPLE, ROWS, block_rows=3)
    return path


def decode_one(schema, value, **options):
    record = as_record(parse_schema(schema))
    row = value if record.name != "_SyntheticRecord" else {"value": value}
    decoder = Decoder(record)
    outs = decoder.buffers()
    done, error = decoder.decode(testing.encode(record, row, **options), 1, outs)
    assert (done, error) == (1, None)
    return [a.to_pylist()[0] for a in decoder.arrays(outs)]


def test_scan(spark, people):
    df = av.scan_avro(spark, people)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(r["id"], r["name"]) for r in ROWS]
    assert av.read_avro_schema(people) == df.schema


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard", "zstd", "bzip2", "xz"])
def test_codecs(spark, tmp_path, codec):
    path = str(tmp_path / "x.avro")
    testing.write_avro(path, PEOPLE, ROWS * 100, codec=codec, block_rows=50)
    assert av.scan_avro(spark, path).count() == 700


@pytest.mark.parametrize("codec", ["deflate", "snappy", "zstandard", "bzip2", "xz"])
def test_codec_limits_and_damage(codec):
    packed = compress(codec, b"x" * 10_000)
    assert decompress(codec, packed, 10_000) == b"x" * 10_000
    with pytest.raises(av.CodecError):
        decompress(codec, packed, 9_999)
    with pytest.raises(av.CodecError):
        decompress(codec, b"\xff" * 20)


def test_snappy_checksum():
    packed = bytearray(compress("snappy", b"hello"))
    packed[-1] ^= 1
    with pytest.raises(av.CodecError, match="checksum"):
        decompress("snappy", packed)


@pytest.mark.parametrize("split", [40, 64, 100, 1000])
def test_splits_read_every_row_once(spark, tmp_path, split):
    path = str(tmp_path / "x.avro")
    testing.write_avro(path, PEOPLE, [{"id": i, "name": str(i)} for i in range(500)], block_rows=7)
    assert sorted(r.id for r in av.scan_avro(spark, path, split_bytes=split).collect()) == list(range(500))


def test_columns(spark, people):
    assert av.scan_avro(spark, people, columns=["name"]).columns == ["name"]
    assert av.scan_avro(spark, people, columns=[1, 0]).columns == ["id", "name"]
    for bad in (["nope"], [2], [-1]):
        with pytest.raises(av.SchemaError):
            av.scan_avro(spark, people, columns=bad)
    assert av.scan_avro(spark, people, columns=[]).count() == 7


def test_row_index_limit_and_paths(spark, people, tmp_path):
    other = str(tmp_path / "other.avro")
    testing.write_avro(other, {**PEOPLE, "fields": PEOPLE["fields"][::-1]}, [{"id": 8, "name": "Heidi"}])
    empty = str(tmp_path / "empty.avro")
    testing.write_avro(empty, PEOPLE, [])
    df = av.scan_avro(spark, [people, empty, other], row_index_name="i", row_index_offset=5, include_file_paths="p", split_bytes=30)
    assert df.columns == ["i", "id", "name", "p"]
    assert [(r.i, r.id, r.p) for r in df.orderBy("i").collect()] == [(i + 4, i, people if i < 8 else other) for i in range(1, 9)]
    assert [r.id for r in av.scan_avro(spark, [people, other], n_rows=4).orderBy("id").collect()] == [1, 2, 3, 4]
    assert av.scan_avro(spark, people, n_rows=0).columns == ["id", "name"]
    assert av.scan_avro(spark, people, n_rows=0).count() == 0


@pytest.mark.parametrize("options", [{"n_rows": -1}, {"row_index_offset": -1}, {"row_index_offset": 2**32}, {"batch_size": 0}])
def test_bad_arguments(spark, people, options):
    with pytest.raises(ValueError):
        av.scan_avro(spark, people, **options)


def test_sources(spark, people, tmp_path):
    assert paths_of([people, people]) == [people]
    assert paths_of(str(tmp_path / "*.avro")) == [people]
    assert expand_braces("a{b,c{d,e}}") == ["ab", "acd", "ace"]
    with pytest.raises(FileNotFoundError):
        av.scan_avro(spark, str(tmp_path / "no*.avro"))
    with pytest.raises(av.SourceNotFoundError):
        av.scan_avro(spark, str(tmp_path / "no.avro"))
    with pytest.raises(ValueError):
        av.scan_avro(spark, [])
    with pytest.raises(TypeError):
        av.scan_avro(spark, 5)
    odd = str(tmp_path / "a[1].avro")
    testing.write_avro(odd, PEOPLE, ROWS)
    assert av.scan_avro(spark, odd, glob=False).count() == 7


def test_unlike_files(spark, people, tmp_path):
    other = str(tmp_path / "other.avro")
    testing.write_avro(other, {"type": "record", "name": "Person", "fields": [{"name": "id", "type": "int"}, {"name": "name", "type": "string"}]}, [{"id": 1, "name": "x"}])
    with pytest.raises(av.SchemaError):
        av.scan_avro(spark, [people, other])


@pytest.mark.parametrize(
    "schema, value, expected",
    [
        ("null", None, None), ("boolean", True, True), ("int", -(2**31), -(2**31)), ("long", 2**63 - 1, 2**63 - 1), ("long", -(2**63), -(2**63)), ("double", -0.0, -0.0), ("float", math.inf, math.inf), ("bytes", b"\0\xff", b"\0\xff"), ("string", "a\0é🙂", "a\0é🙂"),
        (["null", "int"], None, None), (["int", "null"], 7, 7), (["int"], 7, 7), (["null"], None, None),
        ({"type": "enum", "name": "E", "symbols": ["A", "B"]}, "B", "B"), ({"type": "fixed", "name": "F", "size": 3}, b"abc", b"abc"),
        ({"type": "bytes", "logicalType": "nonsense"}, b"x", b"x"), ({"type": {"type": "string"}}, "x", "x"),
    ],
)
def test_values(schema, value, expected):
    assert decode_one({"type": "record", "name": "R", "fields": [{"name": "value", "type": schema}]}, {"value": value}) == [expected]


@pytest.mark.parametrize("sized", [False, True])
def test_nested(sized):
    schema = {"type": "record", "name": "R", "fields": [
        {"name": "a", "type": {"type": "array", "items": {"type": "array", "items": "int"}}},
        {"name": "m", "type": {"type": "map", "values": {"type": "array", "items": "string"}}},
        {"name": "r", "type": ["null", {"type": "record", "name": "S", "fields": [{"name": "x", "type": ["null", "double"]}]}]},
        {"name": "again", "type": ["null", "S"]},
    ]}
    row = {"a": [[1, 2], [], [3]], "m": {"é": ["a"], "b": []}, "r": {"x": None}, "again": {"x": 2.5}}
    assert decode_one(schema, row, sized=sized) == [row["a"], list(row["m"].items()), row["r"], row["again"]]
    record = parse_schema(schema)
    only_last = Decoder(record, ["again"])
    outs = only_last.buffers()
    assert only_last.decode(testing.encode(record, row, sized), 1, outs) == (1, None)
    assert outs == [[{"x": 2.5}]]


def test_recursion():
    schema = {"type": "record", "name": "T", "fields": [{"name": "v", "type": "int"}, {"name": "kids", "type": {"type": "array", "items": "T"}}]}
    v, kids = decode_one(schema, {"v": 1, "kids": [{"v": 2, "kids": []}]})
    assert (v, [json.loads(k) for k in kids]) == (1, [{"v": 2, "kids": []}])


def test_unsupported():
    for schema in ({"type": "array", "items": "int"}, {"type": "map", "values": "int"}, {"type": "record", "name": "R", "fields": []}):
        with pytest.raises(av.SchemaError):
            as_record(parse_schema(schema))


def test_wide_union_fails_only_if_used(spark, tmp_path):
    path = str(tmp_path / "u.avro")
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}, {"name": "u", "type": ["int", "string"]}]}
    testing.write_avro(path, schema, [{"a": 1, "u": 2}])
    with pytest.raises(av.SchemaError):
        av.scan_avro(spark, path)
    assert av.scan_avro(spark, path, columns=["a"]).collect()[0].a == 1


def test_top_level_primitive(spark, tmp_path):
    path = tmp_path / "p.avro"
    path.write_bytes(testing.header("int") + testing.block(2, testing.long(5) + testing.long(-6)))
    assert [r.value for r in av.scan_avro(spark, path).collect()] == [5, -6]


def damage(path, at_block, change):
    with open(path, "rb") as f:
        found = block_index(f, read_header(f))
        f.seek(0)
        data = bytearray(f.read())
    end = found[at_block + 1][0] if at_block + 1 < len(found) else len(data)
    change(data, found[at_block][0], end)
    with open(path, "wb") as f:
        f.write(data)


@pytest.mark.parametrize("kind", ["sync", "payload", "cut", "record"])
def test_damage(spark, tmp_path, kind):
    path = str(tmp_path / "x.avro")
    testing.write_avro(path, PEOPLE, [{"id": i, "name": "n" * 20} for i in range(300)], codec="null" if kind == "record" else "deflate", block_rows=50)

    def change(data, at, end):
        if kind == "sync":
            for i in range(end - 16, end):
                data[i] ^= 0xFF
        elif kind == "payload":
            for i in range(at + 10, at + 30):
                data[i] ^= 0xAA
        elif kind == "cut":
            del data[at + 20 :]
        else:
            data[at + 6] = 0xFF  # a string length runs away in the first records

    damage(path, 2, change)
    with pytest.raises(Exception):
        av.scan_avro(spark, path).collect()
    ids = {r.id for r in av.scan_avro(spark, path, ignore_errors=True).collect()}
    assert set(range(100)) <= ids and (kind == "cut" or set(range(150, 300)) <= ids)
    errors = av.scan_avro_errors(spark, path).collect()
    assert len(errors) >= 1 and errors[0].filepath == path
    reader = av.AvroReader(path, ignore_errors=True, row_index_name="i")
    rows = [r for b in reader for r in b.to_pylist()]
    assert reader.error_count == len(errors) and [r["i"] for r in rows] == list(range(len(ids)))
    numbered = av.scan_avro(spark, path, ignore_errors=True, row_index_name="i")
    assert sorted(r.i for r in numbered.collect()) == list(range(len(ids)))


def test_bad_magic(spark, tmp_path):
    path = tmp_path / "x.avro"
    path.write_bytes(b"Bad\0" + b"x" * 100)
    for tolerant in (False, True):
        with pytest.raises(av.ParseError):
            av.scan_avro(spark, path, ignore_errors=tolerant)


def test_reader(people):
    with av.MultiAvroReader([people], batch_size=2, projected_columns=["name", "unknown"], n_rows=5, include_file_paths="p") as reader:
        names = [r["name"] for b in reader for r in b.to_pylist()]
        assert names == [r["name"] for r in ROWS[:5]]
        assert reader.is_finished and reader.rows_read == 5 and reader.total_sources == 1
        assert reader.spark_schema.fieldNames() == ["name", "p"] and reader.schema_dict["name"] == "Person"


def test_schema_names():
    nested = parse_schema({"type": "record", "name": "a.R", "fields": [{"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X"]}}, {"name": "f", "type": "E"}]})
    assert nested.fields[0].schema.name == "a.E" and nested.fields[1].schema is nested.fields[0].schema
    with pytest.raises(av.SchemaError):
        parse_schema({"type": "record", "name": "1bad", "fields": []}, strict=True)
    with pytest.raises(av.SchemaError):
        parse_schema(["int", "int"], strict=True)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        parse_schema(["int", "int"])
    assert seen
    for bad in ("{", {"type": "array"}, {"type": "enum", "name": "E", "symbols": []}, "Unknown", {"type": "int", "logicalType": "timestamp-millis"}):
        with pytest.raises(av.SchemaError):
            parse_schema(bad)
    again = parse_schema(to_json(nested))
    assert to_json(again) == to_json(nested)


def test_compatibility():
    p = parse_schema
    assert av.check_compatibility(p("double"), p("int")) == []
    assert [x.reason for x in av.check_compatibility(p("int"), p("long"))] == ["TypeMismatch"]
    new = {**PEOPLE, "fields": [*PEOPLE["fields"], {"name": "age", "type": "int"}]}
    assert [(x.path, x.reason) for x in av.check_compatibility(p(new), p(PEOPLE))] == [("/age", "MissingDefault")]
    a, b = ({"type": "enum", "name": "E", "symbols": s} for s in (["A"], ["A", "B"]))
    assert [x.reason for x in av.check_compatibility(p(a), p(b))] == ["MissingSymbol"]
    assert av.check_compatibility(p({**a, "default": "A"}), p(b)) == []
    assert [x.reason for x in av.check_compatibility(p({"type": "fixed", "name": "F", "size": 2}), p({"type": "fixed", "name": "F", "size": 3}))] == ["SizeMismatch"]
    with pytest.raises(av.SchemaError):
        av.validate_compatibility(p("int"), p("string"))


def test_evolution(spark, people):
    reader = {"type": "record", "name": "Person", "fields": [{"name": "full_name", "aliases": ["name"], "type": "string"}, {"name": "id", "type": "double"}, {"name": "tags", "type": {"type": "array", "items": "string"}, "default": ["x"]}]}
    got = av.scan_avro(spark, people, reader_schema=reader).orderBy("id").first()
    assert got.asDict() == {"full_name": "Alice", "id": 1.0, "tags": ["x"]}


def test_java_writer(spark, tmp_path):
    """Files of the JVM's own Avro library."""
    jvm = spark.sparkContext._jvm
    schema = jvm.org.apache.avro.Schema.Parser().parse(json.dumps(PEOPLE))
    for codec in ("null", "deflate", "snappy", "zstandard", "bzip2", "xz"):
        path = str(tmp_path / f"{codec}.avro")
        writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(schema))
        writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString(codec))
        writer.create(schema, jvm.java.io.File(path))
        for r in ROWS:
            record = jvm.org.apache.avro.generic.GenericData.Record(schema)
            record.put("id", jvm.java.lang.Long(r["id"]))
            record.put("name", r["name"])
            writer.append(record)
        writer.close()
        assert [tuple(r) for r in av.scan_avro(spark, path).orderBy("id").collect()] == [(r["id"], r["name"]) for r in ROWS]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(st.characters(exclude_categories=["Cs"])), st.none() | st.floats(allow_nan=False), st.lists(st.booleans())), max_size=20))
def test_round_trip(rows):
    schema = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}, {"name": "c", "type": ["null", "double"]}, {"name": "d", "type": {"type": "array", "items": "boolean"}}]}
    record = parse_schema(schema)
    dicts = [dict(zip("abcd", r)) for r in rows]
    decoder = Decoder(record)
    outs = decoder.buffers()
    data = b"".join(testing.encode(record, r) for r in dicts)
    assert decoder.decode(data, len(rows), outs) == (len(rows), None)
    assert [list(x) for x in zip(*outs)] == [list(r) for r in rows]
    if data:  # a cut block never yields a wrong record
        outs = decoder.buffers()
        done, error = decoder.decode(data[:-1], len(rows), outs)
        assert error is not None and [list(x) for x in zip(*outs)] == [list(r) for r in rows[:done]]


# --- lockstep decoding ------------------------------------------------------------------------

ALL_TYPES = {
    "type": "record",
    "name": "All",
    "fields": [
        {"name": "a", "type": "long"}, {"name": "i", "type": "int"}, {"name": "b", "type": "boolean"}, {"name": "f", "type": "float"}, {"name": "d", "type": "double"}, {"name": "s", "type": "string"}, {"name": "y", "type": "bytes"}, {"name": "nl", "type": "null"},
        {"name": "u", "type": ["null", "long"]}, {"name": "us", "type": ["string", "null"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["x", "y", "z"]}}, {"name": "fx", "type": {"type": "fixed", "name": "F", "size": 3}},
        {"name": "arr", "type": {"type": "array", "items": "string"}},
        {"name": "ua", "type": ["null", {"type": "array", "items": ["null", {"type": "record", "name": "In", "fields": [{"name": "p", "type": ["null", "int"]}, {"name": "q", "type": {"type": "array", "items": "long"}}]}]}]},
        {"name": "m", "type": {"type": "map", "values": ["null", "double"]}}, {"name": "rec", "type": {"type": "record", "name": "Rec", "fields": [{"name": "x", "type": "long"}, {"name": "z", "type": ["null", "string"]}]}},
        {"name": "dec", "type": {"type": "bytes", "logicalType": "decimal", "precision": 20, "scale": 2}}, {"name": "decf", "type": ["null", {"type": "fixed", "name": "DF", "size": 9, "logicalType": "decimal", "precision": 20, "scale": 3}]},
        {"name": "uu", "type": {"type": "fixed", "name": "U", "size": 16, "logicalType": "uuid"}}, {"name": "du", "type": {"type": "fixed", "name": "Du", "size": 12, "logicalType": "duration"}},
        {"name": "dt", "type": ["null", {"type": "int", "logicalType": "date"}]}, {"name": "tm", "type": {"type": "int", "logicalType": "time-millis"}}, {"name": "ts", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "tn", "type": {"type": "long", "logicalType": "local-timestamp-nanos"}},
        {"name": "bd", "type": {"type": "bytes", "logicalType": "big-decimal"}},
    ],
}


def any_row(rng):
    number = lambda: rng.choice([0, 1, -1, 63, 64, -64, -65, 300, -5000, 2**20, 2**31, -(2**45), 2**55, 2**56, 2**62, 2**63 - 1, -(2**63), rng.getrandbits(rng.randint(1, 62))])
    text = lambda: rng.choice(["", "a", "é🙂", "x" * rng.randint(0, 200)])
    few = lambda make, most: [make() for _ in range(rng.randint(0, most))]
    return {
        "a": number(), "i": max(-(2**31), min(2**31 - 1, number())), "b": rng.random() < 0.5, "f": rng.random(), "d": rng.random(), "s": text(), "y": text().encode(), "nl": None, "u": rng.choice([None, number()]), "us": rng.choice([None, text()]), "e": rng.choice("xyz"), "fx": b"abc",
        "arr": few(text, 4), "ua": rng.choice([None, few(lambda: rng.choice([None, {"p": rng.choice([None, 5]), "q": few(number, 3)}]), 3)]), "m": {f"k{j}": rng.choice([None, 1.5]) for j in range(rng.randint(0, 3))}, "rec": {"x": number(), "z": rng.choice([None, text()])},
        "dec": rng.randint(-(10**18), 10**18).to_bytes(rng.choice([8, 9, 16]), "big", signed=True), "decf": rng.choice([None, rng.randint(-(10**19), 10**19).to_bytes(9, "big", signed=True)]), "uu": rng.randbytes(16), "du": b"".join(rng.randrange(1000).to_bytes(4, "little") for _ in range(3)),
        "dt": rng.choice([None, rng.randint(-10000, 30000)]), "tm": rng.randint(0, 86399999), "ts": rng.randint(-(10**12), 10**13), "tn": rng.randint(-(10**18), 10**18), "bd": testing.long(2) + b"\x01\x00" + testing.long(1),
    }


def one_by_one(record, columns, blocks, counts):
    decoder = Decoder(record, columns)
    outs = decoder.buffers()
    for data, n in zip(blocks, counts):
        if decoder.decode(data, n, outs) != (n, None):
            return None
    return decoder.arrays(outs)


@pytest.mark.parametrize("seed", range(12))
def test_lockstep_like_one_by_one(seed):
    rng = random.Random(seed)
    record = as_record(parse_schema(ALL_TYPES))
    counts = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
    blocks = [b"".join(testing.encode(record, any_row(rng), sized=seed % 2 == 0) for _ in range(c)) for c in counts]
    columns = None if seed % 3 else [f["name"] for f in ALL_TYPES["fields"] if rng.random() < 0.4]
    counts = [max(0, c - rng.randint(0, 3)) for c in counts] if seed % 5 == 0 else counts
    got = LockstepDecoder(record, columns).arrays(blocks, counts)
    for x, y in zip(got, one_by_one(record, columns, blocks, counts), strict=True):
        x.validate(full=True)
        assert x.type == y.type and x.equals(y)


def test_lockstep_damage():
    """Bytes changed at random: either damage, or what one by one gives."""
    rng = random.Random(5)
    record = as_record(parse_schema(ALL_TYPES))
    found = 0
    for trial in range(150):
        counts = [rng.randint(1, 5) for _ in range(4)]
        blocks = [bytearray(b"".join(testing.encode(record, any_row(rng), sized=trial % 2 == 0) for _ in range(c))) for c in counts]
        for _ in range(3):
            data = rng.choice(blocks)
            data[rng.randrange(len(data))] = rng.randrange(256)
        if trial % 4 == 0:
            del blocks[0][rng.randrange(len(blocks[0])) :]
        blocks = [bytes(x) for x in blocks]
        try:
            got = LockstepDecoder(record, None).arrays(blocks, counts)
        except (Damage, pa.ArrowInvalid, av.DecodeError, IndexError, ValueError, ArithmeticError):
            found += 1
            continue
        want = one_by_one(record, None, blocks, counts)
        assert want is not None and all(x.equals(y) or repr(x.to_pylist()) == repr(y.to_pylist()) for x, y in zip(got, want))
    assert 20 < found < 150


@pytest.mark.parametrize("rows", [None, 1, 777, 2900])
def test_lockstep_scan(spark, tmp_path, rows):
    path = str(tmp_path / "x.avro")
    rng = random.Random(1)
    written = [any_row(rng) | {"i": i} for i in range(3000)]
    testing.write_avro(path, ALL_TYPES, written, codec="snappy", block_rows=17)
    df = av.scan_avro(spark, path, columns=["i", "s", "ua"], n_rows=rows, row_index_name="n", batch_size=100)
    got = df.orderBy("n").collect()
    assert [(r.n, r.i, r.s, None if r.ua is None else [x and x.asDict() for x in r.ua]) for r in got] == [(i, x["i"], x["s"], x["ua"]) for i, x in enumerate(written[:rows])]


def test_encoder():
    rng = random.Random(2)
    record = as_record(parse_schema(ALL_TYPES))
    put = testing.encoder(record)
    for _ in range(50):
        row = any_row(rng)
        assert bytes(put(row, bytearray())) == testing.encode(record, row)


# --- damage over splits, stores, batches -------------------------------------------------------


@pytest.mark.parametrize("split", [60, 333, 5000])
def test_tolerant_splits_read_what_one_reads(tmp_path, split):
    """Damage of any kind: the splits of a file give the rows and errors of the whole file."""
    rng = random.Random(split)
    for trial in range(40):
        path = str(tmp_path / f"{trial}.avro")
        testing.write_avro(path, PEOPLE, [{"id": i, "name": "n" * rng.randint(0, 30)} for i in range(300)], codec="null" if trial % 2 else "deflate", block_rows=20)
        with open(path, "rb") as f:
            start = read_header(f).start
            data = bytearray(open(path, "rb").read())
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(start, len(data))
            data[at : at + rng.randint(1, 20)] = rng.randbytes(rng.choice([0, 1, 7]))
        with open(path, "wb") as f:
            f.write(data)

        def read(pieces):
            rows, errors = [], []
            for _, a, b, *_ in pieces:
                blocks = []
                for arrays, _, _ in read_split(Split(path, a, b), ["id"], ignore_errors=True, report=lambda e: errors.append((e.kind, e.file_offset)), ended=blocks.append):
                    rows += arrays[0].to_pylist()
            return rows, sorted(errors)

        assert read(byte_splits([(path, start, len(data))], split)) == read([(path, 0, None)])


def test_sound_blocks_are_never_suspected(tmp_path):
    path = str(tmp_path / "x.avro")
    schema = {"type": "record", "name": "N", "fields": [{"name": "nothing", "type": "null"}]}
    with open(path, "wb") as f:
        f.write(testing.header(schema) + testing.block(12_000_000, b"") + testing.block(3, b""))
    with av.AvroReader(path, ignore_errors=True, batch_size=20_000_000) as reader:
        assert sum(b.num_rows for b in reader) == 12_000_003 and not reader.errors


def test_object_store(tmp_path):
    path = str(tmp_path / "x.avro")
    testing.write_avro(path, PEOPLE, ROWS * 40, block_rows=9)
    data = open(path, "rb").read()
    with testing.MockStore({"b/d/part-0.avro": data, "b/d/part-1.avro": data, "b/d/e/part-7.avro": data, "b/z.txt": b""}, failures=2, access_key="k") as store:
        options = {"endpoint": store.endpoint, "aws_access_key_id": "k", "aws_secret_access_key": "x", "region": "us-east-1", "max_retries": 5}
        assert paths_of("s3://b/d/part-[!1-9].avro", True, options) == ["s3://b/d/part-0.avro"]
        assert paths_of("s3a://b/**/part-*.avro", True, options) == ["s3a://b/d/e/part-7.avro", "s3a://b/d/part-0.avro", "s3a://b/d/part-1.avro"]
        with av.MultiAvroReader("s3a://b/d/*.avro", storage_options=options) as reader:
            assert sum(b.num_rows for b in reader) == 2 * 7 * 40
        with pytest.raises(av.SourceNotFoundError):
            av.read_avro_schema("s3://b/none.avro", storage_options=options)
        with pytest.raises(av.SourceNotFoundError):
            paths_of("s3://b/q*.avro", True, options)
        with pytest.raises(av.AuthenticationError):
            av.read_avro_schema("s3://b/d/part-0.avro", storage_options=options | {"aws_access_key_id": "q"})
        store.failures = 1 << 30
        with pytest.raises(av.SourceError):
            av.read_avro_schema("s3://b/d/part-0.avro", storage_options=options | {"max_retries": 0})
