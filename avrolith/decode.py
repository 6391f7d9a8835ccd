"""Record decoding: a schema is compiled to one Python function that walks a block and
appends to a list per selected column; other fields are skipped by type."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import struct

import pyarrow as pa

from avrolith.errors import DecodeError
from avrolith.schema import Schema, arrow_type, spark_type

_EPOCH = datetime.datetime(1970, 1, 1)
_CONTEXT = decimal.Context(prec=100_000)


def _long(buf, p: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[p]
        p += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return (value >> 1) ^ -(value & 1), p
        shift += 7
        if shift > 63:
            raise DecodeError("a number is longer than 10 bytes")


def _text(raw) -> str:
    return str(raw, "utf-8")


def _decimal(raw: bytes, scale: int) -> decimal.Decimal:
    if len(raw) > 16:
        raise DecodeError("a decimal is longer than 16 bytes")
    return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-scale, _CONTEXT)


def _big_decimal(raw: bytes) -> str:
    size, p = _long(raw, 0)
    unscaled = int.from_bytes(raw[p : p + size], "big", signed=True)
    scale, _ = _long(raw, p + size)
    return format(decimal.Decimal(unscaled).scaleb(-scale, _CONTEXT), "f")


def _uuid(raw: bytes) -> str:
    h = raw.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _duration(raw: bytes) -> int:
    months, days, millis = struct.unpack("<III", raw)
    return ((months * 30 + days) * 86_400_000 + millis) * 1000


class _Writer:
    """Generates the source of a decoder. Functions get (buf, p) as a bytes object and a place."""

    def __init__(self, nanos: str):
        self.lines: list[str] = []
        self.names: dict[str, object] = {"_long": _long, "_text": _text, "_decimal": _decimal, "_big": _big_decimal, "_uuid": _uuid, "_duration": _duration, "DecodeError": DecodeError, "_f": struct.Struct("<f").unpack_from, "_d": struct.Struct("<d").unpack_from, "_json": _to_json_text}
        self.nanos, self.n = nanos, 0

    def new(self, prefix: str = "v") -> str:
        self.n += 1
        return f"{prefix}{self.n}"

    def emit(self, depth: int, line: str) -> None:
        self.lines.append("    " * depth + line)

    def long(self, depth: int, var: str) -> None:
        self.emit(depth, f"{var} = buf[p]; p += 1")
        self.emit(depth, f"if {var} < 128: {var} = ({var} >> 1) ^ -({var} & 1)")
        self.emit(depth, f"else: {var}, p = _long(buf, p - 1)")

    def take(self, depth: int, size: str) -> None:
        self.emit(depth, f"if {size} < 0 or p + {size} > end: raise DecodeError('a value runs over the end of its block')")

    def value(self, s: Schema, depth: int, var: str | None) -> None:
        """Lines that put the value into var, or skip it if var is None."""
        k, e = s.kind, self.emit
        v = var or self.new("s")
        if k == "null":
            if var:
                e(depth, f"{var} = None")
        elif k == "boolean":
            e(depth, f"{v} = buf[p]; p += 1")
            e(depth, f"if {v} > 1: raise DecodeError('a boolean is neither 0 nor 1')")
            if var:
                e(depth, f"{var} = {var} == 1")
        elif k in ("int", "long"):
            self.long(depth, v)
            if k == "int":
                e(depth, f"if not -2147483648 <= {v} <= 2147483647: raise DecodeError('an int is out of range')")
            else:
                e(depth, f"if not -9223372036854775808 <= {v} <= 9223372036854775807: raise DecodeError('a long is out of range')")
            scale = {"time-millis": "* 1000", "timestamp-millis": "* 1000", "local-timestamp-millis": "* 1000"}.get(s.logical or "")
            if s.logical in ("timestamp-nanos", "local-timestamp-nanos") and self.nanos != "long":
                scale = "// 1000"
            if var and scale:
                e(depth, f"{var} = {var} {scale}")
        elif k in ("float", "double"):
            size = 4 if k == "float" else 8
            self.take(depth, str(size))
            if var:
                e(depth, f"{var} = _{k[0]}(buf, p)[0]")
            e(depth, f"p += {size}")
        elif k in ("bytes", "string"):
            n = self.new("n")
            self.long(depth, n)
            self.take(depth, n)
            if var:
                raw = f"buf[p:p + {n}]"
                wrap = {"decimal": f"_decimal({raw}, {s.scale})", "big-decimal": f"_big({raw})"}.get(s.logical if k == "bytes" else "", raw if k == "bytes" else f"_text({raw})")
                e(depth, f"{var} = {wrap}")
            e(depth, f"p += {n}")
        elif k == "fixed":
            self.take(depth, str(s.size))
            if var:
                raw = f"buf[p:p + {s.size}]"
                wrap = {"decimal": f"_decimal({raw}, {s.scale})", "uuid": f"_uuid({raw})", "duration": f"_duration({raw})"}.get(s.logical or "", raw)
                e(depth, f"{var} = {wrap}")
            e(depth, f"p += {s.size}")
        elif k == "enum":
            symbols = self.new("E")
            self.names[symbols] = tuple(s.symbols)
            self.long(depth, v)
            e(depth, f"if not 0 <= {v} < {len(s.symbols)}: raise DecodeError('an enum index is out of range')")
            if var:
                e(depth, f"{var} = {symbols}[{v}]")
        elif k == "union":
            i = self.new("u")
            self.long(depth, i)
            for at, branch in enumerate(s.branches):
                e(depth, f"{'if' if at == 0 else 'elif'} {i} == {at}:")
                e(depth + 1, "pass")
                self.value(branch, depth + 1, var)
            e(depth, "else: raise DecodeError('a union index is out of range')")
        elif k in ("array", "map"):
            c, z = self.new("c"), self.new("z")
            if var:
                e(depth, f"{var} = []" if k == "array" else f"{var} = {{}}")
            e(depth, "while True:")
            self.long(depth + 1, c)
            e(depth + 1, f"if {c} == 0: break")
            e(depth + 1, f"if {c} < 0:")
            e(depth + 2, f"{c} = -{c}")
            self.long(depth + 2, z)
            if not var:
                self.take(depth + 2, z)
                e(depth + 2, f"p += {z}")
                e(depth + 2, "continue")
            e(depth + 1, f"for _ in range({c}):")
            if k == "map":
                key, n = self.new("k"), self.new("n")
                self.long(depth + 2, n)
                self.take(depth + 2, n)
                e(depth + 2, f"{key} = _text(buf[p:p + {n}]); p += {n}")
            item = self.new("i") if var else None
            e(depth + 2, "if p > end: raise DecodeError('an array or map runs over the end of its block')")
            self.value(s.items, depth + 2, item)
            if var:
                e(depth + 2, f"{var}.append({item})" if k == "array" else f"{var}[{key}] = {item}")
            if var and k == "map":
                e(depth, f"{var} = list({var}.items())")
        elif k == "record":
            parts = []
            for f in s.fields:
                item = self.new("r") if var else None
                self.value(f.schema, depth, item)
                parts.append(f"{f.name!r}: {item}")
            if var:
                e(depth, f"{var} = {{{', '.join(parts)}}}")
        elif k == "recursive":
            holder = self.new("R")
            self.names[holder] = _Lazy(s.target)
            e(depth, f"{v}, p = {holder}(buf, p)")
            if var:
                e(depth, f"{var} = _json({var})")
        else:
            raise AssertionError(k)


class _Lazy:
    """Decodes a value to what JSON can hold; used where a type contains itself."""

    def __init__(self, schema: Schema):
        self.schema, self.code = schema, None

    def __call__(self, buf, p):
        return _json_value(self.schema, buf, p)


def _json_value(s: Schema, buf, p: int):
    k = s.kind
    if k == "recursive":
        return _json_value(s.target, buf, p)
    if k == "null":
        return None, p
    if k == "boolean":
        return buf[p] == 1, p + 1
    if k in ("int", "long"):
        return _long(buf, p)
    if k in ("float", "double"):
        size = 4 if k == "float" else 8
        value = struct.unpack_from("<f" if k == "float" else "<d", buf, p)[0]
        return (value if math.isfinite(value) else None), p + size
    if k in ("bytes", "string", "fixed"):
        size, p = (s.size, p) if k == "fixed" else _long(buf, p)
        raw = buf[p : p + size]
        if len(raw) < size or size < 0:
            raise DecodeError("a value runs over the end of its block")
        p += size
        if k == "string":
            return _text(raw), p
        if s.logical == "decimal":
            return str(_decimal(raw, s.scale)), p
        if s.logical == "big-decimal":
            return _big_decimal(raw), p
        if s.logical == "uuid":
            return _uuid(raw), p
        if s.logical == "duration":
            return dict(zip(("months", "days", "milliseconds"), struct.unpack("<III", raw))), p
        return base64.b64encode(raw).decode(), p
    if k == "enum":
        i, p = _long(buf, p)
        if not 0 <= i < len(s.symbols):
            raise DecodeError("an enum index is out of range")
        return s.symbols[i], p
    if k == "union":
        i, p = _long(buf, p)
        if not 0 <= i < len(s.branches):
            raise DecodeError("a union index is out of range")
        return _json_value(s.branches[i], buf, p)
    if k in ("array", "map"):
        out: list | dict = [] if k == "array" else {}
        while True:
            count, p = _long(buf, p)
            if not count:
                return out, p
            if count < 0:
                count = -count
                _, p = _long(buf, p)
            for _ in range(count):
                if k == "map":
                    size, p = _long(buf, p)
                    key, p = _text(buf[p : p + size]), p + size
                item, p = _json_value(s.items, buf, p)
                if k == "array":
                    out.append(item)
                else:
                    out[key] = item
    out = {}
    for f in s.fields:
        out[f.name], p = _json_value(f.schema, buf, p)
    return out, p


def _to_json_text(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


class Decoder:
    """Decodes blocks of a record schema into Arrow arrays of the selected columns."""

    def __init__(self, record: Schema, columns: list[str] | None = None, nanos: str = "micros"):
        self.fields = [f for f in record.fields if columns is None or f.name in columns]
        wanted = {f.name for f in self.fields}
        w = _Writer(nanos)
        w.emit(0, "def decode(buf, count, outs):")
        w.emit(1, "p, done, end = 0, 0, len(buf)")
        for i in range(len(self.fields)):
            w.emit(1, f"a{i} = outs[{i}].append")
        w.emit(1, "try:")
        w.emit(2, "for done in range(count):")
        adds, at = [], 0
        for f in record.fields:
            if f.name in wanted:
                var = w.new()
                w.value(f.schema, 3, var)
                adds.append(f"a{at}({var})")
                at += 1
            else:
                w.value(f.schema, 3, None)
        w.emit(3, "if p > end: raise DecodeError('a record runs over the end of its block')")
        for add in adds:  # only after the whole record was read: a bad one leaves nothing
            w.emit(3, add)
        w.emit(2, "return count, None")
        w.emit(1, "except (DecodeError, IndexError, ValueError, ArithmeticError) as e:")
        w.emit(2, "return done, e if isinstance(e, DecodeError) else DecodeError(str(e) or 'malformed value')")
        exec(compile("\n".join(w.lines), "<decoder>", "exec"), w.names)  # source made from the schema's shape; names enter only through repr
        self.decode = w.names["decode"]
        self.types = [arrow_type(spark_type(f.schema, nanos)) for f in self.fields]

    def buffers(self) -> list[list]:
        return [[] for _ in self.fields]

    def arrays(self, outs: list[list]) -> list[pa.Array]:
        try:
            return [pa.array(values, t) for values, t in zip(outs, self.types)]
        except (pa.ArrowInvalid, OverflowError) as e:
            raise DecodeError(f"a value is out of its type's range: {e}") from e
