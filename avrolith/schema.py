"""Avro schemas: parsing, JSON, Spark types, compatibility and evolution."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

from avrolith.errors import SchemaError

PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
#: Promotions from a writer's type to a reader's.
PROMOTIONS = {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")
MISSING = object()


@dataclass
class Field:
    name: str
    schema: "Schema"
    default: object = MISSING
    aliases: list[str] = field(default_factory=list)
    doc: str | None = None
    order: str = "ascending"


@dataclass
class Schema:
    """kind is a primitive's name, record, enum, array, map, union, fixed, or recursive."""

    kind: str
    name: str | None = None
    fields: list[Field] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    default: object = MISSING
    items: "Schema | None" = None
    branches: list["Schema"] = field(default_factory=list)
    size: int = 0
    logical: str | None = None
    precision: int = 0
    scale: int = 0
    aliases: list[str] = field(default_factory=list)
    doc: str | None = None
    target: "Schema | None" = field(default=None, repr=False, compare=False)

    @property
    def nullable(self) -> bool:
        return self.kind == "null" or (self.kind == "union" and any(b.kind == "null" for b in self.branches))

    def plain(self) -> "Schema":
        """The single non-null branch of a union, else the schema itself."""
        if self.kind != "union":
            return self
        rest = [b for b in self.branches if b.kind != "null"]
        if len(rest) > 1:
            raise SchemaError(f"unsupported type: union of {[b.name or b.kind for b in rest]}")
        return rest[0] if rest else Schema("null")


def parse_schema(text, strict: bool = False) -> Schema:
    """A schema from JSON text or what json.loads gives. References to named types become
    the type itself, or 'recursive' inside it."""
    if isinstance(text, (str, bytes)):
        try:
            text = json.loads(text)
        except ValueError:
            if isinstance(text, bytes) or not _NAME.fullmatch(text):
                raise SchemaError("a schema is not valid JSON") from None
    return _Parser(strict).parse(text, None)


class _Parser:
    def __init__(self, strict: bool):
        self.strict, self.named, self.open = strict, {}, set()

    def complain(self, message: str) -> None:
        if self.strict:
            raise SchemaError(message)
        warnings.warn(message, stacklevel=4)

    def full(self, name: str, space: str | None) -> str:
        return name if "." in name or not space else f"{space}.{name}"

    def parse(self, s, space: str | None) -> Schema:
        if isinstance(s, str):
            if s in PRIMITIVES:
                return Schema(s)
            name = self.full(s, space)
            name = name if name in self.named else s
            if name not in self.named:
                raise SchemaError(f"unknown type {s!r}")
            if name in self.open:
                return Schema("recursive", name=name, target=self.named[name])
            return self.named[name]
        if isinstance(s, list):
            branches = [self.parse(x, space) for x in s]
            if any(b.kind == "union" for b in branches):
                self.complain("a union directly holds a union")
            keys = [b.name or b.kind for b in branches]
            if len(set(keys)) < len(keys):
                self.complain(f"a union repeats a type: {keys}")
            return Schema("union", branches=branches)
        if not isinstance(s, dict) or "type" not in s:
            raise SchemaError(f"not a schema: {s!r}")
        kind = s["type"]
        if isinstance(kind, (dict, list)) or kind not in (*PRIMITIVES, "record", "error", "enum", "fixed", "array", "map"):
            return self.parse(kind, space)
        if kind in ("array", "map"):
            key = "items" if kind == "array" else "values"
            if key not in s:
                raise SchemaError(f"{kind} without {key!r}")
            return Schema(kind, items=self.parse(s[key], space))
        out = Schema("record" if kind == "error" else kind, doc=s.get("doc"))
        if kind not in PRIMITIVES:
            if not isinstance(s.get("name"), str) or not s["name"]:
                raise SchemaError(f"{kind} without a name")
            name = s["name"]
            if not _NAME.fullmatch(name):
                self.complain(f"invalid name {name!r}")
            out.name = name if "." in name else self.full(name, s.get("namespace", space))
            space = out.name.rpartition(".")[0] or None
            out.aliases = [self.full(a, space) for a in s.get("aliases", [])]
            if out.name in self.named:
                self.complain(f"type {out.name!r} is defined twice")
            self.named[out.name] = out
        if out.kind == "record":
            if not isinstance(s.get("fields"), list):
                raise SchemaError(f"record {out.name!r} without fields")
            self.open.add(out.name)
            for f in s["fields"]:
                if not isinstance(f, dict) or "name" not in f or "type" not in f:
                    raise SchemaError(f"record {out.name!r} has a malformed field")
                if not _NAME.fullmatch(f["name"]) or "." in f["name"]:
                    self.complain(f"invalid field name {f['name']!r}")
                kind_ = f["type"]
                if isinstance(kind_, str) and any(k in f for k in ("items", "values", "symbols", "size")) and kind_ in ("array", "map", "enum", "fixed"):
                    kind_ = f  # written flat in the field
                out.fields.append(Field(f["name"], self.parse(kind_, space), f.get("default", MISSING), list(f.get("aliases", [])), f.get("doc"), f.get("order", "ascending")))
            self.open.discard(out.name)
            names = [f.name for f in out.fields]
            if len(set(names)) < len(names):
                raise SchemaError(f"record {out.name!r} repeats a field")
        elif kind == "enum":
            out.symbols = list(s.get("symbols") or [])
            out.default = s.get("default", MISSING)
            if not out.symbols or len(set(out.symbols)) < len(out.symbols):
                raise SchemaError(f"enum {out.name!r} has no or repeated symbols")
        elif kind == "fixed":
            if not isinstance(s.get("size"), int) or s["size"] < 0:
                raise SchemaError(f"fixed {out.name!r} without a size")
            out.size = s["size"]
        if isinstance(s.get("logicalType"), str):
            out.logical = s["logicalType"]
            self.logical(out, s)
        return out

    def logical(self, out: Schema, s: dict) -> None:
        kind, name = out.kind, out.logical
        if name == "decimal":
            if kind not in ("bytes", "fixed"):
                raise SchemaError(f"decimal on {kind}")
            out.precision, out.scale = s.get("precision", 0), s.get("scale", 0)
            if not isinstance(out.precision, int) or not 1 <= out.precision or not 0 <= out.scale <= out.precision:
                raise SchemaError("decimal needs a precision of at least 1 and a scale up to it")
            if out.precision > 38:
                raise SchemaError(f"decimal precision {out.precision} is over 38")
        elif name == "uuid" and not (kind == "string" or (kind == "fixed" and out.size == 16)):
            raise SchemaError(f"uuid on {kind}")
        elif name == "duration" and not (kind == "fixed" and out.size == 12):
            raise SchemaError("duration needs a fixed of 12 bytes")
        elif name == "big-decimal" and kind != "bytes":
            raise SchemaError(f"big-decimal on {kind}")
        elif name in _LOGICAL_BASE and kind != _LOGICAL_BASE[name]:
            raise SchemaError(f"{name} on {kind}")


_LOGICAL_BASE = {"date": "int", "time-millis": "int", "time-micros": "long"} | {f"{z}timestamp-{u}": "long" for z in ("", "local-") for u in ("millis", "micros", "nanos")}


def to_json(s: Schema, _seen: set | None = None):
    """What json.dumps turns into the schema's JSON."""
    seen = _seen if _seen is not None else set()
    if s.kind == "recursive" or (s.name and s.name in seen):
        return s.name
    if s.kind == "union":
        return [to_json(b, seen) for b in s.branches]
    if s.kind in ("array", "map"):
        return {"type": s.kind, "items" if s.kind == "array" else "values": to_json(s.items, seen)}
    out: dict = {"type": s.kind}
    if s.name:
        seen.add(s.name)
        out["name"] = s.name
    if s.aliases:
        out["aliases"] = s.aliases
    if s.doc is not None:
        out["doc"] = s.doc
    if s.kind == "record":
        out["fields"] = []
        for f in s.fields:
            one = {"name": f.name, "type": to_json(f.schema, seen)}
            one |= {} if f.default is MISSING else {"default": f.default}
            one |= {"aliases": f.aliases} if f.aliases else {}
            one |= {"doc": f.doc} if f.doc is not None else {}
            one |= {"order": f.order} if f.order != "ascending" else {}
            out["fields"].append(one)
    elif s.kind == "enum":
        out["symbols"] = s.symbols
        out |= {} if s.default is MISSING else {"default": s.default}
    elif s.kind == "fixed":
        out["size"] = s.size
    if s.logical:
        out["logicalType"] = s.logical
        if s.logical == "decimal":
            out |= {"precision": s.precision, "scale": s.scale}
    return s.kind if out == {"type": s.kind} else out


# --- Spark and Arrow types ----------------------------------------------------


def as_record(s: Schema) -> Schema:
    """The top-level record; other types become a record of one field `value`."""
    if s.kind in ("array", "map"):
        raise SchemaError(f"a top-level {s.kind} can't be read as a table")
    if s.kind != "record":
        return Schema("record", name="_SyntheticRecord", fields=[Field("value", s)])
    if not s.fields:
        raise SchemaError(f"record {s.name!r} has no fields")
    return s


def spark_type(s: Schema, nanos: str = "micros") -> T.DataType:
    """The Spark type of values. nanos: 'micros' (cut) or 'long' for nanosecond timestamps."""
    s = s.plain()
    k, logical = s.kind, s.logical
    if logical == "decimal":
        return T.DecimalType(s.precision, s.scale)
    if logical in ("uuid", "big-decimal"):
        return T.StringType()
    if logical == "date":
        return T.DateType()
    if logical in ("time-millis", "time-micros"):
        return T.LongType()
    if logical in ("timestamp-nanos", "local-timestamp-nanos") and nanos == "long":
        return T.LongType()
    if logical and logical.startswith("timestamp-"):
        return T.TimestampType()
    if logical and logical.startswith("local-timestamp-"):
        return T.TimestampNTZType()
    if logical == "duration":
        return T.DayTimeIntervalType()
    if k == "record":
        return T.StructType([T.StructField(f.name, spark_type(f.schema, nanos), True, _metadata(f.schema)) for f in s.fields])
    if k == "array":
        return T.ArrayType(spark_type(s.items, nanos), s.items.nullable)
    if k == "map":
        return T.MapType(T.StringType(), spark_type(s.items, nanos), s.items.nullable)
    return _SPARK[k]()


_SPARK = {"null": T.NullType, "boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "bytes": T.BinaryType, "fixed": T.BinaryType, "string": T.StringType, "enum": T.StringType, "recursive": T.StringType}


def _metadata(s: Schema) -> dict | None:
    rest = [b for b in s.branches if b.kind != "null"] if s.kind == "union" else [s]
    if len(rest) == 1 and rest[0].kind == "enum":
        return {"avro.enum.symbols": rest[0].symbols}
    if len(rest) == 1 and rest[0].kind == "fixed" and not rest[0].logical:
        return {"avro.fixed.size": rest[0].size}
    return None


def spark_fields(record: Schema, columns: list[str] | None = None, nanos: str = "micros") -> list[T.StructField]:
    return [T.StructField(f.name, spark_type(f.schema, nanos), True, _metadata(f.schema)) for f in record.fields if columns is None or f.name in columns]


def readable(record: Schema) -> list[str]:
    """Names of the fields whose types Spark can hold."""
    out = []
    for f in record.fields:
        try:
            spark_type(f.schema)
        except SchemaError:
            continue
        out.append(f.name)
    return out


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.MapType):
        return pa.map_(pa.string(), arrow_type(t.valueType))
    if isinstance(t, T.DecimalType):
        return pa.decimal128(t.precision, t.scale)
    return _ARROW[type(t)]


_ARROW = {T.NullType: pa.null(), T.BooleanType: pa.bool_(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.StringType: pa.string(), T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", "UTC"), T.TimestampNTZType: pa.timestamp("us"), T.DayTimeIntervalType: pa.duration("us")}


# --- compatibility ------------------------------------------------------------


@dataclass(frozen=True)
class Incompatibility:
    path: str
    reason: str  # TypeMismatch, MissingDefault, NameMismatch, MissingSymbol, SizeMismatch, UnionMismatch, LogicalMismatch
    message: str


def check_compatibility(reader: Schema, writer: Schema) -> list[Incompatibility]:
    """Why data of the writer's schema can't be read with the reader's; empty if it can."""
    out: list[Incompatibility] = []
    _check(reader, writer, "", out, set())
    return out


def validate_compatibility(reader: Schema, writer: Schema) -> None:
    if found := check_compatibility(reader, writer):
        raise SchemaError("; ".join(f"{x.path or '/'}: {x.message}" for x in found))


def _same_name(r: Schema, w: Schema) -> bool:
    short = lambda n: (n or "").rpartition(".")[2]
    return short(r.name) == short(w.name) or w.name in r.aliases or short(w.name) in map(short, r.aliases)


def _check(r: Schema, w: Schema, path: str, out: list, seen: set) -> None:
    r, w = r.target or r, w.target or w
    if (id(r), id(w)) in seen:
        return
    seen.add((id(r), id(w)))
    add = lambda reason, message: out.append(Incompatibility(path, reason, message))
    if w.kind == "union":
        for i, b in enumerate(w.branches):
            _check(r, b, f"{path}/{i}", out, seen)
        return
    if r.kind == "union":
        if not any(not _quiet(b, w, seen) for b in r.branches):
            add("UnionMismatch", f"no branch of the reader's union takes {w.name or w.kind}")
        return
    if r.kind != w.kind:
        if (w.kind, r.kind) not in PROMOTIONS:
            add("TypeMismatch", f"{w.kind} can't be read as {r.kind}")
        return
    if r.logical == "decimal" and w.logical == "decimal" and (r.precision, r.scale) != (w.precision, w.scale):
        add("LogicalMismatch", "decimals differ in precision or scale")
    if r.kind in ("record", "enum", "fixed") and not _same_name(r, w):
        add("NameMismatch", f"{w.name} can't be read as {r.name}")
        return
    if r.kind == "record":
        have = {f.name: f for f in w.fields}
        for f in r.fields:
            match = next((have[n] for n in (f.name, *f.aliases) if n in have), None)
            if match is not None:
                _check(f.schema, match.schema, f"{path}/{f.name}", out, seen)
            elif f.default is MISSING:
                out.append(Incompatibility(f"{path}/{f.name}", "MissingDefault", "the writer lacks the field and it has no default"))
    elif r.kind == "enum":
        missing = [x for x in w.symbols if x not in r.symbols]
        if missing and r.default is MISSING:
            add("MissingSymbol", f"the reader lacks symbols {missing}")
    elif r.kind == "fixed" and r.size != w.size:
        add("SizeMismatch", f"{w.size} bytes can't be read as {r.size}")
    elif r.kind in ("array", "map"):
        _check(r.items, w.items, f"{path}/*", out, seen)


def _quiet(r: Schema, w: Schema, seen: set) -> list:
    found: list = []
    _check(r, w, "", found, set(seen))
    return found


def evolve(df, writer: Schema, reader: Schema):
    """df, read with the writer's schema, as the reader's: fields matched by name or alias at every
    depth, promoted, and filled with defaults; symbols that the reader lacks become its default."""
    from pyspark.sql import functions as F

    validate_compatibility(reader, writer)
    have = {f.name: f for f in writer.fields}
    columns = [x.alias(f.name) for f, x in zip(reader.fields, _resolved_fields(reader, writer, lambda n: F.col(f"`{n}`")))]
    extra = [c for c in df.columns if c not in have]  # row index and file path
    return df.select(*[c for c in extra if df.columns.index(c) == 0], *columns, *[c for c in extra if df.columns.index(c) > 0])


def _resolved_fields(reader: Schema, writer: Schema, column_of) -> list:
    """Columns of the reader's fields; column_of gives the writer's by name."""
    have = {f.name: f for f in writer.fields}
    out = []
    for f in reader.fields:
        match = next((have[n] for n in (f.name, *f.aliases) if n in have), None)
        value = _default(f.schema, f.default) if match is None else _resolved(f.schema, match.schema, column_of(match.name))
        out.append(value.cast(spark_type(f.schema)))
    return out


def _resolved(reader: Schema, writer: Schema, value):
    """A column of the writer's type as the reader's."""
    from pyspark.sql import functions as F

    r, w = reader.plain(), writer.plain()
    if r.kind == "enum" and w.kind == "enum" and r.default is not MISSING and any(x not in r.symbols for x in w.symbols):
        return F.when(value.isNull() | value.isin(r.symbols), value).otherwise(F.lit(r.default))
    if to_json(r) == to_json(w) or w.kind != r.kind:
        return value  # cast promotes
    if r.kind == "record":
        inner = [x.alias(f.name) for f, x in zip(r.fields, _resolved_fields(r, w, value.getField))]
        return F.when(value.isNotNull(), F.struct(*inner)) if writer.nullable else F.struct(*inner)
    if r.kind == "array":
        return F.transform(value, lambda x: _resolved(r.items, w.items, x).cast(spark_type(r.items)))
    if r.kind == "map":
        return F.transform_values(value, lambda _, x: _resolved(r.items, w.items, x).cast(spark_type(r.items)))
    return value


def _default(s: Schema, value):
    from pyspark.sql import functions as F

    s = s.branches[0] if s.kind == "union" else s  # a union's default is of its first branch
    if value is None or s.kind == "null":
        return F.lit(None)
    if s.kind in ("bytes", "fixed"):
        return F.lit(value.encode("latin-1"))
    if s.kind == "array":
        return F.array(*[_default(s.items, v).cast(spark_type(s.items)) for v in value]) if value else F.from_json(F.lit("[]"), spark_type(s))
    if s.kind == "map":
        parts = [x for k, v in value.items() for x in (F.lit(k), _default(s.items, v).cast(spark_type(s.items)))]
        return F.create_map(*parts) if parts else F.from_json(F.lit("{}"), spark_type(s))
    if s.kind == "record":
        return F.struct(*[_default(f.schema, value.get(f.name, None if f.default is MISSING else f.default)).cast(spark_type(f.schema)).alias(f.name) for f in s.fields])
    return F.lit(value)
