"""A plain encoder, for fixtures and round-trip queries only."""

from __future__ import annotations

import json
import struct

from avrolith.codecs import compress
from avrolith.schema import Schema, parse_schema

SYNC = bytes.fromhex("DEADBEEFCAFEBABE123456789ABCDEF0")


def long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63) if n < 0 else n << 1
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(s: Schema, v, sized: bool = False) -> bytes:
    """One value. sized: arrays and maps in the form with byte sizes. A union takes the first
    branch for None if that is null, else the first other one."""
    k = s.kind
    if k == "recursive":
        return encode(s.target, v, sized)
    if k == "null":
        return b""
    if k == "boolean":
        return b"\x01" if v else b"\x00"
    if k in ("int", "long"):
        return long(v)
    if k in ("float", "double"):
        return struct.pack("<f" if k == "float" else "<d", v)
    if k == "string":
        raw = v.encode("utf-8")
        return long(len(raw)) + raw
    if k == "bytes":
        return long(len(v)) + bytes(v)
    if k == "fixed":
        return bytes(v)
    if k == "enum":
        return long(s.symbols.index(v))
    if k == "union":
        at = next(i for i, b in enumerate(s.branches) if (b.kind == "null") == (v is None))
        return long(at) + encode(s.branches[at], v, sized)
    if k == "record":
        return b"".join(encode(f.schema, v[f.name], sized) for f in s.fields)
    parts = [encode(s.items, x, sized) for x in v] if k == "array" else [long(len(n.encode())) + n.encode() + encode(s.items, x, sized) for n, x in v.items()]
    if not parts:
        return b"\x00"
    body = b"".join(parts)
    return (long(-len(parts)) + long(len(body)) if sized else long(len(parts))) + body + b"\x00"


_TWO = [bytes((z & 0x7F | 0x80, z >> 7)) for z in range(1 << 14)]


def _put_long(out: bytearray, z: int) -> None:
    z &= (1 << 64) - 1
    while z >= 0x80:
        out.append(z & 0x7F | 0x80)
        z >>= 7
    out.append(z)


def encoder(s: Schema):
    """A function (value, bytearray) that appends what encode() gives, made for one schema."""
    lines: list[str] = ["def put(v0, out):"]
    names: dict = {"_two": _TWO, "_put": _put_long, "_encode": encode, "_f": struct.Struct("<f").pack, "_d": struct.Struct("<d").pack}
    count = iter(range(1, 1 << 30))

    def emit(depth: int, line: str) -> None:
        lines.append("    " * depth + line)

    def number(depth: int, value: str) -> None:
        z = f"z{next(count)}"
        emit(depth, f"{z} = ({value} << 1) ^ ({value} >> 63)")
        emit(depth, f"if {z} < 128: out.append({z})")
        emit(depth, f"elif {z} < 16384: out += _two[{z}]")
        emit(depth, f"else: _put(out, {z})")

    def value(s: Schema, depth: int, v: str) -> None:
        k = s.kind
        if k in ("int", "long"):
            number(depth, v)
        elif k == "boolean":
            emit(depth, f"out.append(1 if {v} else 0)")
        elif k in ("float", "double"):
            emit(depth, f"out += _{k[0]}({v})")
        elif k in ("string", "bytes"):
            raw = f"b{next(count)}"
            emit(depth, f"{raw} = {v}.encode()" if k == "string" else f"{raw} = {v}")
            number(depth, f"len({raw})")
            emit(depth, f"out += {raw}")
        elif k == "record":
            for f in s.fields:
                inner = f"v{next(count)}"
                emit(depth, f"{inner} = {v}[{f.name!r}]")
                value(f.schema, depth, inner)
            if not s.fields:
                emit(depth, "pass")
        elif k == "union" and [b.kind for b in s.branches].count("null") == 1 and len(s.branches) == 2:
            null = 0 if s.branches[0].kind == "null" else 1
            emit(depth, f"if {v} is None: out.append({2 * null})")
            emit(depth, "else:")
            emit(depth + 1, f"out.append({2 - 2 * null})")
            value(s.branches[1 - null], depth + 1, v)
        else:
            holder = f"S{next(count)}"
            names[holder] = s
            emit(depth, f"out += _encode({holder}, {v})")

    value(s, 1, "v0")
    emit(1, "return out")
    exec(compile("\n".join(lines), "<encoder>", "exec"), names)  # source made from the schema's shape; names enter only through repr
    return names["put"]


def block(count: int, payload: bytes, codec: str = "null", sync: bytes = SYNC) -> bytes:
    data = compress("zstandard" if codec == "zstd" else codec, payload)
    return long(count) + long(len(data)) + data + sync


def header(schema, codec: str = "null", sync: bytes = SYNC) -> bytes:
    pairs = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    body = b"".join(long(len(k)) + k.encode() + long(len(v)) + v for k, v in pairs.items())
    return b"Obj\x01" + long(len(pairs)) + body + b"\x00" + sync


def write_avro(path, schema, rows, codec: str = "null", block_rows: int = 1000, sized: bool = False) -> None:
    parsed = parse_schema(schema)
    rows = list(rows)
    with open(path, "wb") as f:
        f.write(header(schema, codec))
        for i in range(0, len(rows), block_rows):
            part = rows[i : i + block_rows]
            f.write(block(len(part), b"".join(encode(parsed, r, sized) for r in part), codec))


class MockStore:
    """An object store of one process that speaks enough of the S3 protocol for tests: list, head, and
    ranged reads of objects {"bucket/key": bytes}. `failures` requests are refused with 503 first,
    those with another key than `access_key` (if given) with 403."""

    def __init__(self, objects: dict[str, bytes], failures: int = 0, access_key: str | None = None):
        import http.server
        import threading
        import urllib.parse
        from xml.sax.saxutils import escape

        store = self
        self.objects, self.failures, self.requests = objects, failures, 0

        class Handler(http.server.BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *args):
                pass

            def answer(self, status: int, body: bytes = b"", size: int | None = None, **headers):
                self.send_response(status)
                for k, v in {"Content-Length": str(len(body) if size is None else size), "ETag": '"0"', "Last-Modified": "Thu, 01 Jan 1970 00:00:00 GMT", **headers}.items():
                    self.send_header(k.replace("_", "-"), v)
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(body)

            def do_HEAD(self):
                self.do_GET()

            def do_GET(self):
                store.requests += 1
                if store.failures > 0:
                    store.failures -= 1
                    return self.answer(503, b"<Error><Code>SlowDown</Code></Error>")
                if access_key is not None and f"Credential={access_key}/" not in self.headers.get("Authorization", ""):
                    return self.answer(403, b"<Error><Code>InvalidAccessKeyId</Code></Error>")
                url = urllib.parse.urlsplit(self.path)
                name = urllib.parse.unquote(url.path).strip("/")
                asked = dict(urllib.parse.parse_qsl(url.query, keep_blank_values=True))
                if "list-type" in asked:
                    prefix, cut = asked.get("prefix", ""), asked.get("delimiter")
                    keys = sorted(k.partition("/")[2] for k in store.objects if k.startswith(f"{name}/{prefix}"))
                    deeper = sorted({prefix + k[len(prefix) :].partition(cut)[0] + cut for k in keys if cut in k[len(prefix) :]}) if cut else []
                    here = [k for k in keys if not any(k.startswith(d) for d in deeper)]
                    items = "".join(f"<Contents><Key>{escape(k)}</Key><Size>{len(store.objects[f'{name}/{k}'])}</Size></Contents>" for k in here)
                    items += "".join(f"<CommonPrefixes><Prefix>{escape(d)}</Prefix></CommonPrefixes>" for d in deeper)
                    body = f"<ListBucketResult><Name>{name}</Name><KeyCount>{len(here) + len(deeper)}</KeyCount><IsTruncated>false</IsTruncated>{items}</ListBucketResult>"
                    return self.answer(200, body.encode(), Content_Type="application/xml")
                data = store.objects.get(name)
                if data is None:
                    known = name in {k.partition("/")[0] for k in store.objects}
                    return self.answer(200 if known else 404, b"" if known or self.command == "HEAD" else b"<Error><Code>NoSuchKey</Code></Error>")
                span = self.headers.get("Range")
                if span and self.command == "GET":
                    first, _, last = span.removeprefix("bytes=").partition("-")
                    part = data[int(first) : int(last) + 1 if last else None]
                    return self.answer(206, part, Content_Range=f"bytes {first}-{int(first) + len(part) - 1}/{len(data)}")
                return self.answer(200, data if self.command == "GET" else b"", size=len(data))

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.endpoint = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        self.server.shutdown()
        self.server.server_close()


# --- tables of any size, written by the executors -----------------------------


def avro_schema_of(fields, name: str = "Row") -> dict:
    """A record schema for a Spark StructType, with unions with null for nullable fields."""

    def field(f, path):
        t = one(f.dataType, path)
        return {"name": f.name, "type": ["null", t] if f.nullable else t}

    def one(t, path):
        kind = t.typeName()
        if kind == "array":
            return {"type": "array", "items": one(t.elementType, path)}
        if kind == "map":
            return {"type": "map", "values": one(t.valueType, path)}
        if kind == "struct":
            return {"type": "record", "name": path, "fields": [field(f, f"{path}_{f.name}") for f in t.fields]}
        if kind == "timestamp_ntz":
            return {"type": "long", "logicalType": "local-timestamp-micros"}
        if kind == "timestamp":
            return {"type": "long", "logicalType": "timestamp-micros"}
        if kind == "date":
            return {"type": "int", "logicalType": "date"}
        return {"integer": "int", "long": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes", "boolean": "boolean"}[kind]

    return {"type": "record", "name": name, "fields": [field(f, f"{name}_{f.name}") for f in fields]}


def export_avro(df, folder: str, key: str, schema: dict | None = None, codec: str = "snappy", files: int = 2, block_rows: int = 1000, convert=None, block_bytes: int | None = None) -> str:
    """Write df, sorted by key over all files, as part-00000.avro and so on, into a folder that
    executors can write to (a path or URI). convert, if given, makes a row's dict what the schema
    expects. A block ends at block_rows rows, or at block_bytes bytes before compression."""
    import uuid

    import pyarrow as pa
    from pyspark import TaskContext

    from avrolith.container import filesystem

    schema = schema or avro_schema_of(df.schema.fields)

    def run(batches):
        put = encoder(parse_schema(schema))
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        final = f"{root}/part-{part:05d}.avro"
        temp = f"{root}/.{part:05d}-{uuid.uuid4().hex}"
        total = held = 0
        data = bytearray()

        with files.open_output_stream(temp) as f:
            f.write(header(schema, codec))
            for batch in batches:
                columns = []
                for c in batch.columns:
                    if pa.types.is_timestamp(c.type):
                        c = c.cast(pa.int64())
                    elif pa.types.is_date32(c.type):
                        c = c.cast(pa.int32())
                    columns.append(c)
                for row in pa.RecordBatch.from_arrays(columns, names=batch.schema.names).to_pylist():
                    put(convert(row) if convert else row, data)
                    held += 1
                    total += 1
                    if held == block_rows or (block_bytes and len(data) >= block_bytes):
                        f.write(block(held, bytes(data), codec))
                        held, data = 0, bytearray()
            if held:
                f.write(block(held, bytes(data), codec))
        files.move(temp, final)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["rows"])

    dealt = df.repartitionByRange(files, key).sortWithinPartitions(key) if files > 1 else df.coalesce(1).sortWithinPartitions(key)
    dealt.mapInArrow(run, "rows long").agg({"rows": "sum"}).collect()
    return folder
