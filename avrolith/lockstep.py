"""Decoding of many blocks at once: one lane a block, one numpy step a field.

At any time every lane stands at the same field of its block's next record, so the cost of
interpreting the schema is shared by all lanes. Values are kept in the order in
which they are decoded and put into the order of records at the end. Whatever looks like damage
raises Damage, and the caller decodes the blocks one by one, which also says where it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from avrolith.schema import Schema, arrow_type, spark_type

#: Fewer lanes than this aren't worth a numpy step.
LEAST_LANES = 16


class Damage(Exception):
    """Some block can't be decoded."""


_STOP = np.uint64(0x8080808080808080)
_ONE = np.uint64(1)
_FOLDS = [(np.uint64(a), np.uint64(b), np.uint64(s)) for a, b, s in ((0x007F007F007F007F, 0x7F007F007F007F00, 1), (0x00003FFF00003FFF, 0x3FFF00003FFF0000, 2), (0x000000000FFFFFFF, 0x0FFFFFFF00000000, 4))]
_SEVEN = np.uint64(0x7F7F7F7F7F7F7F7F)
_U7, _U63 = np.uint64(7), np.uint64(63)
_SMALL = ((np.arange(256) >> 1) ^ -(np.arange(256) & 1)).astype(np.int64)


class _Bytes:
    """The blocks, one after another, padded so that a step over the end reads zeros."""

    def __init__(self, blocks: list[bytes], pad: int):
        self.data = np.frombuffer(b"".join(blocks) + bytes(pad + 16), np.uint8)
        size = len(self.data)
        self.u64 = np.ndarray((size - 7,), "<u8", self.data, strides=(1,))
        self.u32 = np.ndarray((size - 3,), "<u4", self.data, strides=(1,))

    def skip(self, p: np.ndarray) -> np.ndarray:
        """Places after the numbers at p."""
        if self.data.take(p).max() < 128:
            return p + 1
        stop = ~self.u64[p] & _STOP
        size = (np.bitwise_count((stop & -stop) - _ONE) >> 3).astype(np.int64) + 1
        if not stop.all():
            long = np.flatnonzero(stop == 0)
            _, end = self._long(p[long])
            size[long] = end - p[long]
        return p + size

    def long(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The zigzag numbers at p, and the places after them."""
        first = self.data.take(p)
        if first.max() < 128:
            return _SMALL.take(first), p + 1
        word = self.u64[p]
        stop = ~word & _STOP
        stop &= -stop
        below = stop - _ONE
        size = (np.bitwise_count(below) >> 3).astype(np.int64) + 1
        x = word & below & _SEVEN
        for low, high, by in _FOLDS:
            x = (x & low) | ((x & high) >> by)
        out = (x >> _ONE).view(np.int64) ^ -(x & _ONE).view(np.int64)
        if not stop.all():
            long = np.flatnonzero(stop == 0)
            out[long], end = self._long(p[long])
            size[long] = end - p[long]
        return out, p + size

    def _long(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of 9 or 10 bytes."""
        x = np.zeros(len(p), np.uint64)
        end = p + 10
        for i in range(10):
            b = self.data[p + i]
            on = end > p + i
            x[on] |= (b[on] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * i)
            end = np.where(on & (b < 128), p + i + 1, end)
            if i == 9 and (on & (b > 1)).any():
                raise Damage("a number is longer than 64 bits")
        return (x >> _ONE).view(np.int64) ^ -(x & _ONE).view(np.int64), end


class _Node:
    """Decodes one type for one lane at least; keeps the values of its slots, numbered as they are decoded."""

    def __init__(self, schema: Schema, nanos: str):
        self.schema, self.type = schema, arrow_type(spark_type(schema, nanos))

    def clear(self) -> None:
        self.held: list = []

    def joined(self) -> np.ndarray:
        return self.held[0] if len(self.held) == 1 else np.concatenate(self.held) if self.held else np.zeros(0, np.int64)


class _Null(_Node):
    def decode(self, b: _Bytes, p, end):
        return p

    skip = decode

    def array(self, order):
        return pa.nulls(len(order))


class _Boolean(_Node):
    def skip(self, b, p, end):
        if b.data.take(p).max() > 1:
            raise Damage("a boolean is neither 0 nor 1")
        return p + 1

    def decode(self, b, p, end):
        self.held.append(b.data.take(p))
        return self.skip(b, p, end)

    def array(self, order):
        return pa.array(self.joined()[order].astype(bool))

    def masked(self, order, valid):
        return pa.array(_spread(self.joined()[order], valid).astype(bool), mask=~valid)


def _spread(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(valid), values.dtype)
    out[valid] = values
    return out


class _Integer(_Node):
    def __init__(self, schema: Schema, nanos: str):
        super().__init__(schema, nanos)
        logical = schema.logical or ""
        self.times = 1000 if logical in ("time-millis", "timestamp-millis", "local-timestamp-millis") else 1
        self.by = 1000 if logical in ("timestamp-nanos", "local-timestamp-nanos") and nanos != "long" else 1
        self.stored = pa.int32() if self.type in (pa.int32(), pa.date32()) else pa.int64()

    def skip(self, b, p, end):
        return b.skip(p)

    def decode(self, b, p, end):
        value, p = b.long(p)
        self.held.append(value)
        return p

    def _values(self, order):
        out = self.joined()[order]
        if self.schema.kind == "int" and len(out) and (out.min() < -(2**31) or out.max() >= 2**31):
            raise Damage("an int is out of range")
        if self.times > 1:
            if len(out) and max(-int(out.min()), int(out.max())) > 2**63 // self.times - 1:
                raise Damage("a time is out of range")
            out = out * self.times
        return out // self.by if self.by > 1 else out

    def array(self, order):
        return pa.array(self._values(order), self.stored).view(self.type)

    def masked(self, order, valid):
        return pa.array(_spread(self._values(order), valid), self.stored, mask=~valid).view(self.type)


class _Float(_Node):
    def __init__(self, schema: Schema, nanos: str):
        super().__init__(schema, nanos)
        self.size = 4 if schema.kind == "float" else 8

    def skip(self, b, p, end):
        return p + self.size

    def decode(self, b, p, end):
        self.held.append((b.u32 if self.size == 4 else b.u64)[p])
        return p + self.size

    def _values(self, order):
        return self.joined()[order].astype("<u4" if self.size == 4 else "<u8", copy=False).view(np.float32 if self.size == 4 else np.float64)

    def array(self, order):
        return pa.array(self._values(order))

    def masked(self, order, valid):
        return pa.array(_spread(self._values(order), valid), mask=~valid)


class _Span(_Node):
    """bytes, string and fixed, with their logical types."""

    def clear(self):
        self.held, self.ends = [], []

    def _ends(self, b, p, end):
        if self.schema.kind == "fixed":
            return p, p + self.schema.size
        size, p = b.long(p)
        after = p + size
        if size.min() < 0 or (after > end).any():
            raise Damage("a value runs over the end of its block")
        return p, after

    def skip(self, b, p, end):
        return self._ends(b, p, end)[1]

    def decode(self, b, p, end):
        p, after = self._ends(b, p, end)
        self.bytes = b
        self.held.append(p)
        self.ends.append(after)
        return after

    def _spans(self, order):
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.joined()[order], (self.ends[0] if len(self.ends) == 1 else np.concatenate(self.ends))[order]

    def _raw(self, start, end) -> pa.Array:
        """The bytes between the places, which ascend: every second of the spans that they cut the blocks into."""
        if not len(start):
            return pa.array([], pa.binary())
        cuts = np.empty(2 * len(start) + 1, np.int32)
        cuts[:-1:2], cuts[1::2], cuts[-1] = start, end, end[-1]
        both = pa.Array.from_buffers(pa.binary(), 2 * len(start), [None, pa.py_buffer(cuts), pa.py_buffer(self.bytes.data)])
        return both.take(pa.array(np.arange(0, 2 * len(start), 2)))

    def array(self, order):
        from avrolith import decode

        start, end = self._spans(order)
        kind, logical, n = self.schema.kind, self.schema.logical, len(order)
        if logical == "decimal" and kind in ("bytes", "fixed"):
            size = end - start
            if size.max(initial=0) > 16:
                raise Damage("a decimal is longer than 16 bytes")
            if not n:
                return pa.array([], self.type)
            at = end[:, None] - 1 - np.arange(16)
            inside = at >= start[:, None]
            digits = self.bytes.data[np.where(inside, at, 0)]
            negative = (size > 0) & (self.bytes.data[start] > 127)
            digits = np.where(inside, digits, np.where(negative, 255, 0)[:, None]).astype(np.uint8)
            top = 10**self.schema.precision
            if self.schema.precision < 38 and self._over(digits, top):
                raise Damage("a decimal has too many digits")
            return pa.Array.from_buffers(self.type, n, [None, pa.py_buffer(np.ascontiguousarray(digits))])
        if kind == "fixed" and logical == "uuid":
            raw = self.bytes.data[start[:, None] + np.arange(16)] if n else np.zeros((0, 16), np.uint8)
            digits = np.stack([raw >> 4, raw & 15], axis=2).reshape(n, 32)
            text = np.full((n, 36), ord("-"), np.uint8)
            text[:, [*range(8), *range(9, 13), *range(14, 18), *range(19, 23), *range(24, 36)]] = np.frombuffer(b"0123456789abcdef", np.uint8)[digits]
            return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, 36 * n + 1, 36, dtype=np.int32)), pa.py_buffer(text)])
        if kind == "fixed" and logical == "duration":
            months, days, millis = (self.bytes.u32[start + i].astype(np.int64) for i in (0, 4, 8))
            days += months * 30
            if days.max(initial=0) > 2**63 // 86_400_000_000 - 60:
                raise Damage("a duration is out of range")
            return pa.array((days * 86_400_000 + millis) * 1000).view(self.type)
        raw = self._raw(start, end)
        if logical == "big-decimal" and kind == "bytes":
            return pa.array([decode._big_decimal(x) for x in raw.to_pylist()], self.type)
        return raw.cast(pa.string()) if kind == "string" else raw

    @staticmethod
    def _over(digits: np.ndarray, top: int) -> bool:
        """Whether a number of 16 bytes, lowest first, has an absolute value of top or more."""
        words = np.ascontiguousarray(digits).view("<u8").reshape(-1, 2)
        low, high = words[:, 0], words[:, 1].view(np.int64)
        size = high.astype(np.float64) * 2.0**64 + low
        near = np.flatnonzero(np.abs(size) >= top * (1 - 1e-9))
        return any(abs((int(high[i]) << 64) + int(low[i])) >= top for i in near)


class _Enum(_Node):
    def skip(self, b, p, end):
        return self._walk(b, p)[1]

    def _walk(self, b, p):
        value, p = b.long(p)
        if value.min() < 0 or value.max() >= len(self.schema.symbols):
            raise Damage("an enum index is out of range")
        return value, p

    def decode(self, b, p, end):
        value, p = self._walk(b, p)
        self.held.append(value)
        return p

    def array(self, order):
        return pa.array(self.schema.symbols, pa.string()).take(pa.array(self.joined()[order]))


class _Union(_Node):
    """Of null and at most one other type, if decoded; of any types, if skipped."""

    def __init__(self, schema: Schema, nanos: str, skipped: bool):
        if not skipped:
            super().__init__(schema, nanos)
        self.branches = [node(x, nanos, skipped) for x in schema.branches]
        self.real = [i for i, x in enumerate(schema.branches) if x.kind != "null"]

    def clear(self):
        self.held = []
        for x in self.branches:
            x.clear()

    def _walk(self, b, p, end, step: str):
        which, p = b.long(p)
        low, high = which.min(), which.max()
        if low < 0 or high >= len(self.branches):
            raise Damage("a union index is out of range")
        if low == high:
            return which, getattr(self.branches[low], step)(b, p, end)
        for i, branch in enumerate(self.branches):
            own = np.flatnonzero(which == i)
            if len(own):
                p[own] = getattr(branch, step)(b, p[own], end[own])
        return which, p

    def skip(self, b, p, end):
        return self._walk(b, p, end, "skip")[1]

    def decode(self, b, p, end):
        which, p = self._walk(b, p, end, "decode")
        self.held.append(np.isin(which, self.real) if len(self.real) != 1 else which == self.real[0])
        return p

    def array(self, order):
        if not self.real:
            return pa.nulls(len(order))
        child, held = self.branches[self.real[0]], self.joined().astype(bool)
        valid = held[order]
        if held.all():
            return child.array(order)
        inner = (np.cumsum(held) - 1)[order[valid]]
        if hasattr(child, "masked"):
            return child.masked(inner, valid)
        return child.array(inner).take(pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid))


class _Record(_Node):
    def __init__(self, schema: Schema, nanos: str, skipped: bool):
        if not skipped:
            super().__init__(schema, nanos)
        self.fields = [node(f.schema, nanos, skipped) for f in schema.fields]
        self.names = [f.name for f in schema.fields]

    def clear(self):
        for f in self.fields:
            f.clear()

    def skip(self, b, p, end):
        for f in self.fields:
            p = f.skip(b, p, end)
        return p

    def decode(self, b, p, end):
        for f in self.fields:
            p = f.decode(b, p, end)
        return p

    def array(self, order):
        return pa.StructArray.from_arrays([f.array(order) for f in self.fields], fields=list(self.type))


class _List(_Node):
    """Arrays, and maps as arrays of keys and values."""

    def __init__(self, schema: Schema, nanos: str, skipped: bool):
        if not skipped:
            super().__init__(schema, nanos)
        self.map = schema.kind == "map"
        self.parts = [node(Schema("string"), nanos, skipped)] * self.map + [node(schema.items, nanos, skipped)]

    def clear(self):
        self.owners, self.slots = [], 0
        for x in self.parts:
            x.clear()

    def _walk(self, b, p, end, step: str):
        p = p.copy()
        todo = np.arange(len(p))
        while len(todo):
            count, at = b.long(p[todo])
            if count.min() < 0:
                sized = count < 0
                count = np.abs(count)
                size, after = b.long(at[sized])
                if (size < 0).any() or (after + size > end[todo[sized]]).any():
                    raise Damage("an array or map runs over the end of its block")
                at[sized] = after
                if step == "skip":
                    at[sized] += size
                    count[sized] = -1
            if (count > end[todo] - at).any():
                raise Damage("an array or map has more items than its block has bytes")
            p[todo] = at
            todo, count = todo[count != 0], count[count != 0]
            items = count.copy()
            while (own := np.flatnonzero(items > 0)).size:
                lanes = todo[own]
                q, stop = p[lanes], end[lanes]
                if (q >= stop).any() and (q > stop).any():
                    raise Damage("an array or map runs over the end of its block")
                if step == "decode":
                    self.owners.append(self.slots + lanes)
                for part in self.parts:
                    q = getattr(part, step)(b, q, stop)
                p[lanes] = q
                items[own] -= 1
        return p

    def skip(self, b, p, end):
        return self._walk(b, p, end, "skip")

    def decode(self, b, p, end):
        out = self._walk(b, p, end, "decode")
        self.slots += len(p)
        return out

    def array(self, order):
        owner = np.concatenate(self.owners) if self.owners else np.zeros(0, np.int64)
        counts = np.bincount(owner, minlength=self.slots)
        rank = np.empty(self.slots, np.int64)
        rank[order] = np.arange(len(order))
        inner = np.argsort(rank[owner], kind="stable")
        offsets = np.concatenate([[0], np.cumsum(counts[order])])
        if offsets[-1] >= 2**31:
            raise Damage("too many items for one batch")
        parts = [x.array(inner) for x in self.parts]
        offsets = pa.array(offsets, pa.int32())
        if not self.map:
            return pa.ListArray.from_arrays(offsets, parts[0], type=self.type)
        names = parts[0].dictionary_encode().indices.to_numpy().astype(np.int64)
        keyed = rank[owner][inner] * (int(names.max(initial=0)) + 1) + names
        if len(np.unique(keyed)) < len(keyed):
            raise Damage("a map repeats a key")  # one by one: the last value counts
        return pa.MapArray.from_arrays(offsets, *parts, type=self.type)


def node(schema: Schema, nanos: str, skipped: bool):
    k = schema.kind
    if k == "union":
        return _Union(schema, nanos, skipped)
    if k == "record":
        return _Record(schema, nanos, skipped)
    if k in ("array", "map"):
        return _List(schema, nanos, skipped)
    return _KINDS[k](schema, nanos)


_KINDS = {"null": _Null, "boolean": _Boolean, "int": _Integer, "long": _Integer, "float": _Float, "double": _Float, "bytes": _Span, "string": _Span, "fixed": _Span, "enum": _Enum}


def fits(schema: Schema) -> bool:
    """Whether the type can be decoded in lanes: without recursion."""
    if schema.kind == "recursive":
        return False
    inner = [*[f.schema for f in schema.fields], *schema.branches, *([schema.items] if schema.items else [])]
    return all(map(fits, inner))


def _reach(schema: Schema) -> int:
    """Bytes that a record's numbers and fixed parts can lead beyond the end of a block."""
    if schema.kind == "fixed":
        return schema.size
    inner = [*[f.schema for f in schema.fields], *schema.branches, *([schema.items] if schema.items else [])]
    return 20 + sum(map(_reach, inner))


class LockstepDecoder:
    """Arrow arrays of the selected columns from many blocks of a record schema."""

    def __init__(self, record: Schema, columns: list[str] | None, nanos: str = "micros"):
        self.steps = []
        self.columns = []
        for f in record.fields:
            taken = columns is None or f.name in columns
            one = node(f.schema, nanos, not taken)
            self.steps.append(one.decode if taken else one.skip)
            if taken:
                self.columns.append(one)
        self.pad = _reach(record)

    def arrays(self, blocks: list[bytes], counts: list[int]) -> list[pa.Array]:
        """The columns of the first counts[i] records of each block, in order."""
        for column in self.columns:
            column.clear()
        sizes = np.array([len(x) for x in blocks], np.int64)
        if sizes.sum() + self.pad >= 2**31 - 64:
            raise Damage("too many bytes for one batch")
        count = np.array(counts, np.int64)
        bytes_ = _Bytes(blocks, self.pad)
        ends = np.cumsum(sizes)
        lanes = np.argsort(-count, kind="stable")  # those with records left are always the first
        p, end, left = (ends - sizes)[lanes], ends[lanes], count[lanes]
        active = np.searchsorted(-left, -np.arange(int(count.max(initial=0))), side="left")
        for n in active.tolist():
            q, stop = p[:n], end[:n]
            for step in self.steps:
                q = step(bytes_, q, stop)
            if (q > stop).any():
                raise Damage("a record runs over the end of its block")
            p[:n] = q
        # the slot of the r-th record of a lane is that of the lane in the r-th step
        before = np.concatenate([[0], np.cumsum(active)])
        place = np.empty(len(lanes), np.int64)
        place[lanes] = np.arange(len(lanes))
        total = int(count.sum())
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        order = before[nth] + np.repeat(place, count)
        return [column.array(order) for column in self.columns]
