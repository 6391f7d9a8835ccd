"""Near-duplicate detection with SetSketch registers.

Each text becomes the set of its word shingles, told apart by the words themselves. A set's sketch holds, for each of
M registers, the minimum of exponential variates of its elements, truncated
to whole powers of BASE (two bytes): mergeable, and equal for two sets with
a probability that rises with their Jaccard similarity. Equal sets (of one size and one keyed
128-bit digest) are worked off once, as one class. Bands of ROWS registers give buckets of
candidates. Within a bucket the similarity of pairs is estimated by maximum
likelihood from how many registers are smaller, equal and larger; a maximum
spanning forest of the pairs that may reach the threshold is kept and verified on
the full shingle sets of the texts, which no hash stands for. Pairs of members that the verified links leave in different
components are then estimated and verified one by one, so that no link which
could join two components is passed over; links inside a component aren't needed.

A pair at the threshold shares a bucket with probability 1 - 3e-6, and its
estimate stays above the margin with more than 5 standard deviations. BASE is so near
to 1 that sets of one size without a common element share a bucket with probability
3e-12: buckets of unrelated texts don't fill up as the input grows.

Skew: copies are one class before anything is paired; bucket sizes are
pre-aggregated and come back by lookup_join; a large bucket is cut into blocks
of about BLOCK members (and, where texts are read, of about BLOCK_SHINGLES shingles), and each block is joined into components by itself. Of a bucket
that still has several components, the members outside the largest are cut into blocks
of their own and compared crosswise with all blocks, within a task, which passes on
only links that join components. Members of the largest component aren't compared with
each other, so that where few others are left the work grows with the bucket's
size, not its square. No bucket is dropped or capped, and no group is expanded into
rows for its pairs.

Defined results: null and empty texts have an empty set, are linked with nothing
and form their own components, as do rows without an id; repeated rows have one component_id;
rows that repeat an id with different texts are linked each by its own text; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import discard, hot, lookup_join, materialize, mix64, shuffle_partitions, slices, span_hashes, text_buffers

SHINGLE = 5
THRESHOLD = 80  # per cent
M = 160
ROWS = 5
BASE = 1.01
RATE = 20.0
REGISTER = np.dtype("<u2")
MARGIN = 0.17
BLOCK = 512
#: Shingles whose texts a block holds, one text at least.
BLOCK_SHINGLES = 1 << 21
#: Ids among which a task contracts links at a time.
CONTRACT = 1 << 20

# --- shingles ---------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWER = 0x9E3779B97F4A7C15 | 1
_COEF = _RNG.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_KEY = b"near duplicates"
_LANES = _RNG.integers(1, 2**63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All words of some texts, in order, as numbers into the distinct ones (compared byte by
    byte), these, and where each text's begin (n + 1)."""
    base, end = int(offsets[0]), int(offsets[-1])
    data, off = raw[base:end], offsets - base
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    at = total[np.append(starts, n)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(starts, off)


def window_names(words: np.ndarray, k: int) -> np.ndarray:
    """A number for each window of k words: equal for equal windows and for no others."""
    names, width = words, 1
    while width < k and len(names):
        step = min(width, k - width)
        names = names[:-step] * (int(names.max()) + 1) + names[step:]
        width += step
        if width < k:
            names = pa.array(names).dictionary_encode().indices.to_numpy().astype(np.int64)
    return names


def _word_digests(distinct: pa.Array) -> np.ndarray:
    """Keyed 128-bit digests of words (2 x words), mixed in two lanes after every eight bytes."""
    data, off = text_buffers(distinct)
    return np.stack([span_hashes(data[off[0] : off[-1]], off[:-1] - off[0], np.diff(off), *lane) for lane in _LANES])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of some texts: 64-bit hashes of the distinct shingles, sorted in each text, one text after
    another; where each text's begin (n + 1); and a digest of each set, by 128 bits of every
    shingle (empty for empty sets). What is distinct is decided by the words."""
    words, distinct, first = words_of(raw, offsets)
    n, count = len(offsets) - 1, np.diff(first)
    names = window_names(words, k)
    lanes = _word_digests(distinct)[:, words] if len(words) else np.zeros((2, 0), np.uint64)
    hashes = []
    for lane in (0, 1):
        one = np.zeros(len(names), np.uint64)
        if len(names):
            for j in range(k):
                one += lanes[lane, j : len(words) - k + 1 + j] * _COEF[lane, j]
        hashes.append(mix64(one))
    pieces, sizes, digests = [], np.zeros(n, np.int64), []
    for i in range(n):
        a, have = first[i], count[i] - k + 1
        if have > 0:
            h, g, name = hashes[0][a : a + have], hashes[1][a : a + have], names[a : a + have]
            order = h.argsort()
            h, name = h[order], name[order]
            new = np.empty(have, bool)
            new[0] = True
            np.not_equal(name[1:], name[:-1], out=new[1:])
            if (h[1:] == h[:-1])[new[1:]].any():  # one hash of two shingles: by names
                order = order[np.lexsort((name, h))]
                h, name = hashes[0][a : a + have][order], names[a : a + have][order]
                new[1:] = name[1:] != name[:-1]
            own, other = h[new], g[order[new]]
        elif count[i]:
            own, other = (mix64((lanes[lane, a : first[i + 1]] * _COEF[lane, 16 : 16 + count[i]]).sum(keepdims=True) + np.uint64(count[i])) for lane in (0, 1))
        else:
            digests.append(b"")
            continue
        pieces.append(own)
        sizes[i] = len(own)
        digests.append(hashlib.blake2b(np.stack([own, other]).tobytes(), digest_size=16, key=_KEY).digest())
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]), digests


def exact_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sets of distinct shingles of some texts, as numbers that equal shingles share, and no others."""
    words, _, first = words_of(raw, offsets)
    names = window_names(words, k)
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            own = np.sort(names[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(np.array([-1 - short.setdefault(tuple(words[a:b].tolist()), len(short))], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


# --- sketches ---------------------------------------------------------------


def sketches(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers (texts x M, uint16) of the sets; empty sets have zeros.

    Each element is a Poisson process of rate M whose points fall into random
    registers; a register keeps the first point of all elements. Points beyond
    about ln(M) / size can't matter once every register is hit, so few points
    per set are made, whatever its size.
    """
    sizes = np.diff(begins)
    out = np.zeros((len(sizes), M), REGISTER)
    levels = np.frompyfunc(int.bit_length, 1, 1)(np.maximum(sizes, 0).astype(object)).astype(np.int64)
    for level in np.unique(levels[sizes > 0]):
        rows = np.flatnonzero(levels == level)
        step = max(1, (1 << 18) >> int(level))
        for i in range(0, len(rows), step):
            out[rows[i : i + step]] = _registers(elements, begins, sizes, rows[i : i + step])
    return out


def _registers(elements, begins, sizes, rows):
    reach = math.log(M) + 5.0
    first = np.full((len(rows), M), np.inf)
    todo = np.arange(len(rows))
    while len(todo):
        count = sizes[rows[todo]]
        owner = np.repeat(todo, count)
        where = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[rows[todo]], count)
        active = elements[where]
        limit = (reach / sizes[rows])[owner]
        time = np.zeros(len(active))
        mean = M * reach / count.min()
        step = int(min(64, max(2, mean)))
        k = 0
        while len(active):
            counter = np.arange(k + 1, k + step + 1, dtype=np.uint64) * np.uint64(_POWER)
            z = mix64(active[:, None] + counter[None, :])
            k += step
            points = time[:, None] + np.cumsum(-np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / M
            good = points <= limit[:, None]
            at = (owner[:, None] * M + ((z & np.uint64(0x7FF)) * np.uint64(M) >> np.uint64(11)).astype(np.int64))[good]
            np.minimum.at(first.reshape(-1), at, points[good])
            go = good[:, -1]
            active, owner, limit, time = active[go], owner[go], limit[go], points[go, -1]
        todo = np.flatnonzero(np.isinf(first).any(axis=1))
        first[todo] = np.inf
        reach *= 2
    return np.clip(np.floor(1 - np.log(first / RATE) / math.log(BASE)), 0, 65535).astype(REGISTER)


def _sketch_documents(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets, 1 << 20):
                elements, begins, digests = shingle_sets(raw, offsets[a : b + 1], k)
                regs = sketches(elements, begins)
                sums = np.frombuffer(b"".join(d or bytes(16) for d in digests), np.int64).reshape(-1, 2)
                flat = pa.py_buffer(np.ascontiguousarray(regs).tobytes())
                registers = pa.FixedSizeBinaryArray.from_buffers(pa.binary(M * REGISTER.itemsize), b - a, [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(begins), pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), registers], names=["doc_id", "h", "n", "s1", "s2", "regs"])

    return run


# --- joint estimation -------------------------------------------------------

_GRID = np.linspace(0, 1, 101)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of sizes n_a and n_b of which
    `larger` registers of a exceed b's and `smaller` are below them."""
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    share = _GRID[None, :] * top[:, None]
    log_b = math.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b
    up, down = p(u[:, None] - v[:, None] * share), p(v[:, None] - u[:, None] * share)
    same = np.clip(1 - up - down, 1e-12, 1)
    like = larger[:, None] * np.log(np.maximum(up, 1e-12)) + smaller[:, None] * np.log(np.maximum(down, 1e-12)) + (M - larger - smaller)[:, None] * np.log(same)
    return share[np.arange(len(u)), like.argmax(axis=1)]


def _estimates(regs_a, n_a, regs_b, n_b, threshold):
    """Estimates of rows of a against rows of b, pairwise; -1 where the sizes rule a link out."""
    larger = (regs_a > regs_b).sum(axis=1)
    smaller = (regs_a < regs_b).sum(axis=1)
    out = np.full(len(larger), -1.0)
    ok = 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    ok &= M - larger - smaller >= M // 3  # far below what the margin lets through
    for i in range(0, int(ok.sum()), 20000):
        at = np.flatnonzero(ok)[i : i + 20000]
        out[at] = estimate(larger[at], smaller[at], n_a[at], n_b[at])
    return out


def _forest(rep, n, regs, threshold):
    """Pairs of a maximum spanning forest of the pairs that may be linked (Prim)."""
    least = threshold / 100 - MARGIN
    k = len(rep)
    best, link = np.full(k, -1.0), np.zeros(k, np.int64)
    outside = np.ones(k, bool)
    at = 0
    while True:
        outside[at] = False
        rest = np.flatnonzero(outside)
        if not len(rest):
            return
        new = _estimates(regs[rest], n[rest], np.broadcast_to(regs[at], (len(rest), M)), np.full(len(rest), n[at]), threshold)
        better = new > best[rest]
        best[rest[better]] = new[better]
        link[rest[better]] = at
        at = int(rest[np.argmax(best[rest])])
        if best[at] >= least:
            yield int(rep[at]), int(rep[link[at]])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict]:
    """Groups of rows sorted by their first columns, with the rest as arrays."""
    held: list[pa.RecordBatch] = []

    def groups(table: pa.Table, all_of_it: bool):
        columns = [np.asarray(table.column(i).to_numpy()) for i in range(keys)]
        change = np.zeros(len(table), bool)
        if len(table):
            change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(table))
        if not all_of_it and len(starts):
            rest = table.slice(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        else:
            rest = None
        return starts, ends, rest

    table = None
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 4 * BLOCK and sum(b.nbytes for b in held) < 32 << 20:
            continue
        table = pa.Table.from_batches(held)
        starts, ends, rest = groups(table, False)
        yield from _slices(table, starts, ends)
        held = rest.combine_chunks().to_batches() if rest is not None else []
    if held:
        table = pa.Table.from_batches(held)
        starts, ends, _ = groups(table, True)
        yield from _slices(table, starts, ends)


def _slices(table: pa.Table, starts, ends):
    table = table.combine_chunks()
    columns = {}
    for name in table.column_names:
        c = table.column(name)
        if pa.types.is_binary(c.type):
            raw, off = text_buffers(c)
            columns[name] = raw[off[0] : off[-1]].view(REGISTER).reshape(-1, M)
        elif pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            columns[name] = text_buffers(c)
        else:
            columns[name] = c.to_numpy()
    for a, b in zip(starts, ends):
        yield {name: (c[0], c[1][a : b + 1]) if isinstance(c, tuple) else c[a:b] for name, c in columns.items()}


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a.min(axis=1)), pa.array(a.max(axis=1))], names=["a", "b"])


def _forests(threshold: int):
    def run(batches):
        pairs: list[tuple[int, int]] = []
        for g in _grouped(batches, 2):
            if len(g["rep"]) > 1:
                pairs.extend(_forest(g["rep"], g["n"], g["regs"], threshold))
            if len(pairs) > 50000:
                yield _pairs_out(pairs)
                pairs = []
        yield _pairs_out(pairs)

    return run


def _wanted(threshold: int):
    """For groups (bucket, block pair): the members that may be linked with one of another
    component, by pairs that share no earlier band (those are found there)."""
    least = threshold / 100 - MARGIN

    def run(batches):
        out: list[tuple] = []
        for g in _grouped(batches, 3):
            rep, n, regs, comp, side = (g[c] for c in ("rep", "n", "regs", "comp", "side"))
            if (comp == comp[0]).all():
                continue
            band, same = int(g["band"][0]), g["i"][0] == g["j"][0]
            mark = np.zeros(len(rep), bool)
            for x in range(len(rep)):
                other = np.flatnonzero((comp > comp[x]) & ((side != side[x]) | same))
                if len(other) and band:
                    early = (regs[other, : band * ROWS] == regs[x, : band * ROWS]).reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
                    other = other[~early]
                if len(other):
                    est = _estimates(regs[other], n[other], np.broadcast_to(regs[x], (len(other), M)), np.full(len(other), n[x]), threshold)
                    hit = other[est >= least]
                    mark[hit] = True
                    mark[x] |= len(hit) > 0
            at = np.flatnonzero(mark)
            if len(at):
                out.append((np.full(len(at), g["bucket"][0]), np.full(len(at), g["i"][0]), np.full(len(at), g["j"][0]), comp[at], rep[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "i", "j", "comp", "rep"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exactly, by matrix products over
    blocks of the elements that several sets have."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(x) for x in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    owner, number = owner[keep], (np.cumsum(often) - 1)[number[keep]]
    out = np.zeros((k, k), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [first, first + 4096])
        part = np.zeros((k, 4096), np.float32)
        part[owner[a:b], number[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _crosswise(k: int, threshold: int):
    """For groups (bucket, block pair) with texts: pairs of components that a link, verified on
    the full sets, joins; fewer than there are members."""

    def run(batches):
        pairs: list[tuple[int, int]] = []
        for g in _grouped(batches, 3):
            comp = g["comp"]
            sets = exact_sets(*g["text"], k)
            sizes = np.array([len(x) for x in sets])
            shared = shared_counts(sets)
            good = (100 * shared >= threshold * (sizes[:, None] + sizes[None, :] - shared)) & (comp[:, None] < comp[None, :]) & (shared > 0)
            joined = _Union()
            pairs.extend((int(comp[x]), int(comp[y])) for x, y in zip(*np.nonzero(good)) if joined.join(int(comp[x]), int(comp[y])))
        yield _pairs_out(pairs)

    return run


# --- verification -----------------------------------------------------------


def _verify(k: int, threshold: int):
    def run(batches):
        for batch in batches:
            left, right = text_buffers(batch.column(2)), text_buffers(batch.column(3))
            good = np.zeros(batch.num_rows, bool)
            both = left[1] + right[1]
            for i0, i1 in slices(both, 1 << 20):
                (raw_a, a), (raw_b, b) = ((raw[off[i0] : off[i1]], off[i0 : i1 + 1] - off[i0]) for raw, off in (left, right))
                sets = exact_sets(np.concatenate([raw_a, raw_b]), np.concatenate([a, b[1:] + a[-1]]), k)
                for i in range(i1 - i0):
                    x, y = sets[i], sets[i1 - i0 + i]
                    all_ = np.concatenate([x, y])
                    all_.sort()
                    shared = int((all_[1:] == all_[:-1]).sum())
                    good[i0 + i] = shared > 0 and 100 * shared >= threshold * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _texts(keyed: DataFrame, classes: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """(rep, text) of the classes wanted, each once: the text of the row of the class with the smallest id."""
    wanted = materialize(classes.select("rep", "id", "h", "copies").join(wanted, "rep"), "wanted-texts")
    # Rows that are repeated very often (no oftener than their class has copies) aren't shuffled.
    is_hot = hot("copies", total, keyed.sparkSession)
    often = F.broadcast(wanted.where(is_hot).select("rep", "id", "h"))
    once = F.first("text").alias("text")
    found = keyed.join(often, ["id", "h"]).groupBy("rep").agg(once)
    others = keyed.join(often, ["id", "h"], "left_anti").join(wanted.where(~is_hot).select("rep", "id", "h").hint("merge"), ["id", "h"])
    found = materialize(found.union(others.select("rep", "text")), "texts")
    whole = found.count() == wanted.count()
    discard(wanted)
    if whole:
        return found
    distinct = materialize(found.groupBy("rep").agg(once), "texts-once")  # a row that is repeated gave its text again
    discard(found)
    return distinct


def _links(pairs: DataFrame, keyed: DataFrame, classes: DataFrame, total: int, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked, on their full texts."""
    pairs = materialize(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    of = _texts(keyed, classes, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), total)
    # A text that very many pairs share is split by Spark's skew join: both sides are plain shuffles.
    text_a = of.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    text_b = of.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
    links = materialize(joined.mapInArrow(_verify(k, threshold), "a long, b long"), "links")
    discard(pairs, of)
    return links


# --- components -------------------------------------------------------------


class _Union(dict):
    """Union-find: the smallest number of each set is its root."""

    def root(self, x: int) -> int:
        up = self.setdefault(x, x)
        while up != self[up]:
            self[x] = self[up]
            x, up = up, self[up]
        return up

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in different sets."""
        a, b = self.root(x), self.root(y)
        self[max(a, b)] = min(a, b)
        return a != b


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (v smallest, u) with the components of the edges that a task has read, up to CONTRACT at a time."""

    def stars(sets: _Union) -> pa.RecordBatch:
        ids = np.fromiter(sets, np.int64, len(sets))
        roots = np.fromiter((sets.root(x) for x in list(sets)), np.int64, len(sets))
        rays = ids != roots
        return pa.RecordBatch.from_arrays([pa.array(roots[rays]), pa.array(ids[rays])], names=["v", "u"])

    sets = _Union()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(x, y)
        if len(sets) > CONTRACT:
            yield stars(sets)
            sets = _Union()
    yield stars(sets)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id in links (a, b) can reach. What a task reads is
    contracted to stars; alternating large-star and small-star steps join these. A star's
    centre may have any number of rays."""

    def with_least(edges: DataFrame) -> DataFrame:
        total = edges.count()
        least = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        return lookup_join(edges.withColumn("spread", F.xxhash64("u", "v")), least, ["u"], "n", total, "spread")

    edges = materialize(links.where("a <> b").select("a", "b").mapInArrow(_contract, "v long, u long").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = materialize(both, "both")
        large = materialize(with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before, both, large)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


# --- the operator -----------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. threshold is in per cent."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("id", F.xxhash64("text").alias("h"), "text")  # h: which of the texts of an id
    sketch = materialize(keyed.mapInArrow(_sketch_documents(k), "doc_id long, h long, n long, s1 long, s2 long, regs binary"), "sketches")
    total = sketch.count()

    sets = sketch.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("regs").alias("regs"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "n", "s1", "s2", F.col("least.doc_id").alias("id"), F.col("least.h").alias("h"), "copies", "regs"), "classes")
    n_classes = classes.count()

    width = ROWS * REGISTER.itemsize
    bands = [F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(M // ROWS)]
    entries = classes.select("rep", "n", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    sizes = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    n_entries = n_classes * (M // ROWS)
    members = lookup_join(entries.withColumn("spread", F.xxhash64("rep", "bucket")), sizes, ["bucket"], "size", n_entries, "spread")
    blocks = f"cast(ceil(size / {BLOCK}) as int)"
    members = members.select("rep", "n", "band", "bucket", F.expr(f"cast(pmod(xxhash64(rep, bucket, 7), {blocks}) as int)").alias("block"))
    members = materialize(members, "members")

    full = members.join(classes.select("rep", "regs"), "rep")
    sorted_ = full.select("bucket", "block", "rep", "n", "regs").repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block")
    links = _links(sorted_.mapInArrow(_forests(threshold), "a long, b long"), keyed, classes, total, k, threshold)
    comps = materialize(components(links), "components")
    discard(links)

    # What is left: buckets with members in different components.
    labelled = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = materialize(labelled.select("rep", "band", "bucket", F.coalesce("comp", "rep").alias("comp"), "n"), "labelled")
    by_comp = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    discard(members, sizes)
    open_ = by_comp.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("c", "comp", "w")).alias("top")).where("comps > 1")
    open_ = materialize(open_.select("bucket", "size", "weight", F.col("top.comp").alias("home"), F.col("top.c").alias("n_home"), F.col("top.w").alias("w_home")), "open")
    left = lookup_join(labelled.withColumn("spread", F.xxhash64("rep", "bucket")), open_, ["bucket"], "size", n_entries, "spread")
    # Blocks 0 .. strays - 1 hold members outside the largest component, the others the rest.
    cut = lambda c, w: F.expr(f"cast(greatest(ceil(({c}) / {BLOCK}), ceil(({w}) / {BLOCK_SHINGLES})) as int)")
    left = left.withColumn("strays", cut("size - n_home", "weight - w_home")).withColumn("homes", cut("n_home", "w_home"))
    single = f"size <= {BLOCK} and weight <= {BLOCK_SHINGLES}"
    block = f"case when {single} then 0 when comp <> home then cast(pmod(xxhash64(rep, bucket, 11), strays) as int) else strays + cast(pmod(xxhash64(rep, bucket, 11), homes) as int) end"
    others = f"case when {single} then array(0) when comp <> home then sequence(0, strays + homes - 1) else sequence(0, strays - 1) end"
    left = left.withColumn("block", F.expr(block)).withColumn("other", F.explode(F.expr(others)))
    left = left.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("cast(block <= other as int)").alias("side"), "band", "comp", "rep", "n").join(classes.select("rep", "regs"), "rep")
    left = left.select("bucket", "i", "j", "side", "band", "comp", "rep", "n", "regs").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    wanted = materialize(left.mapInArrow(_wanted(threshold), "bucket long, i int, j int, comp long, rep long"), "wanted")
    discard(labelled, open_)
    of = _texts(keyed, classes, wanted.select("rep").distinct(), total)
    full = wanted.join(of, "rep").select("bucket", "i", "j", "comp", "rep", "text").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = materialize(full.mapInArrow(_crosswise(k, threshold), "a long, b long"), "more-links")
    discard(of, wanted)

    # Components of components; each has the smallest id of its classes.
    classes = classes.select("rep", "id", "n", "s1", "s2", "copies").join(comps.withColumnRenamed("id", "of").withColumnRenamed("comp", "inner"), F.col("rep") == F.col("of"), "left").withColumn("inner", F.coalesce("inner", "rep"))
    roots = materialize(components(more).select(F.col("id").alias("of_inner"), F.col("comp").alias("root")), "roots")
    classes = materialize(classes.join(roots, F.col("inner") == F.col("of_inner"), "left").select("id", "n", "s1", "s2", "copies", F.coalesce("root", "inner").alias("comp")), "rooted")
    least = materialize(classes.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least-ids")
    classes = lookup_join(classes.withColumn("spread", F.xxhash64("id", "s1")), least, ["comp"], "members", n_classes, "spread").select("n", "s1", "s2", "copies", "component_id")
    rows = sketch.select("doc_id", "n", "s1", "s2")
    grouped = rows.where("n > 0 and doc_id is not null").withColumn("spread", F.xxhash64("doc_id"))
    linked = lookup_join(grouped, materialize(classes, "final-classes"), ["n", "s1", "s2"], "copies", total, "spread").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
