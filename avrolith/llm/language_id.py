"""Language identification with hyperdimensional profiles.

Every letter class has a fixed random vector of +1 and -1. An n-gram's vector
binds its letters' vectors, each permuted (rotated) by its place, by elementwise
product. Bundling (adding) n-gram vectors gives a language's prototype, and a
document is compared with the prototypes by cosine.

A document's bundle is the sum of the vectors of its distinct n-grams, by how often it has
them. Vectors of the first CACHED n-grams that a worker meets are kept, others are bound when
they are needed.

Letters are lower-cased; a-z have a class each, other letters share the rest;
everything else is one blank. Counts of n-grams by language are made over all
learnable rows, pre-aggregated in each task (of HELD_LANGUAGES at a time), so neither a hot source
nor a hot language gathers rows. What is broadcast is a prototype of DIMENSION numbers a language.

Defined results: null, empty and letterless texts get 'und' with score 0; ties go
to the language that sorts first; repeated rows each get a row; an empty table
gives an empty result; without any learnable row all rows get 'und'.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import slices, text_buffers

CLASSES = 64
DIMENSION = 2048
SEED = 9
GRAMS = CLASSES**3
HELD_LANGUAGES = 32
#: N-gram vectors that a worker keeps (DIMENSION bytes each).
CACHED = 1 << 14
_SLICE = 1 << 20


@functools.lru_cache(maxsize=1)
def _letter_classes() -> np.ndarray:
    """Class of every code point: 0 blank, 1-26 a-z, 27-63 other letters by their lower case."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (CLASSES - 27)
    return table


def _vectors(dimension: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2, (CLASSES, dimension), dtype=np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram numbers (rows)."""
    a, b, c = grams // CLASSES**2, grams // CLASSES % CLASSES, grams % CLASSES
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def gram_numbers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of some UTF-8 texts and where each text's begin. A blank stands
    before and after each text; runs of blanks count as one."""
    data = raw[int(offsets[0]) : int(offsets[-1])]
    off = offsets - offsets[0]
    n = len(off) - 1
    if len(data) and data.max() >= 0x80:
        lead = (data & 0xC0) != 0x80
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        if len(chars) != int(lead.sum()):  # invalid UTF-8: text by text
            parts = [np.frombuffer(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for i in range(n)]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            chars = np.concatenate(parts)
        else:
            off = np.concatenate([[0], np.cumsum(lead)])[off]
    else:
        chars = data
    classes = _letter_classes()[chars]
    padded = np.zeros(len(classes) + n + 1, np.uint8)
    where = np.arange(len(classes)) + np.repeat(np.arange(n), np.diff(off)) + 1
    padded[where] = classes
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    # every text starts at its own blank; equal blanks in a row were dropped, so count them
    starts = (off[:-1] + np.arange(n))
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    seq = padded[keep].astype(np.int32)
    first = kept_before[starts + 1] - 1  # the last blank kept at or before the text
    grams = seq[:-2] * (CLASSES * CLASSES) + seq[1:-1] * CLASSES + seq[2:] if len(seq) > 2 else np.zeros(0, np.int32)
    # n-grams may reach into the next text: those with a blank in the middle are blanked out
    grams = np.where(seq[1:-1] != 0, grams, 0) if len(seq) > 2 else grams
    return grams, np.minimum(first, len(grams))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        langs = batch.column(0).to_pylist()
        for a, b in slices(offsets, _SLICE):
            grams, begins = gram_numbers(raw, offsets[a : b + 1])
            ends = np.append(begins[1:], len(grams))
            names = sorted(set(langs[a:b]))
            which = np.repeat([names.index(x) for x in langs[a:b]], ends - begins)
            for i, name in enumerate(names):
                counts = np.bincount(grams[which == i], minlength=GRAMS)
                totals[name] = totals[name] + counts if name in totals else counts
            if len(totals) > HELD_LANGUAGES:
                yield from _counted(totals)
                totals = {}
    yield from _counted(totals)


def _counted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in totals.items():
        counts[0] = 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "gram", "n"])


class Bundler:
    """Bundles of documents, with the n-gram vectors that it has met."""

    def __init__(self, dimension: int):
        self.letters = _vectors(dimension)
        self.place = np.full(GRAMS, -1, np.int32)
        self.kept = np.zeros((0, dimension), np.int8)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.place[grams] < 0]
        room = CACHED - len(self.kept)
        if room > 0 and len(new):
            new = new[:room]
            self.place[new] = np.arange(len(self.kept), len(self.kept) + len(new))
            self.kept = np.concatenate([self.kept, gram_vectors(new, self.letters)])
        at = self.place[grams]
        out = self.kept[at]
        if (at < 0).any():
            out[at < 0] = gram_vectors(grams[at < 0], self.letters)
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct n-grams, by their counts."""
        out = np.zeros(self.letters.shape[1], np.float32)
        for a in range(0, len(grams), 4096):
            out += counts[a : a + 4096].astype(np.float32) @ self.vectors(grams[a : a + 4096]).astype(np.float32)
        return out


class Model:
    """Languages, sorted, and their unit prototypes (rows)."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes
        self.bundler = Bundler(prototypes.shape[1])

    @staticmethod
    def of(counts: dict[str, tuple[np.ndarray, np.ndarray]], dimension: int = DIMENSION) -> "Model":
        languages = sorted(counts)
        letters = _vectors(dimension)
        prototypes = np.zeros((len(languages), dimension))
        for i, lang in enumerate(languages):
            grams, n = counts[lang]
            for a in range(0, len(grams), 8192):
                # the square root keeps frequent n-grams from drowning the others
                prototypes[i] += np.sqrt(n[a : a + 8192]) @ gram_vectors(grams[a : a + 8192], letters).astype(np.float64)
        if len(languages) > 1:
            prototypes -= prototypes.mean(axis=0) * 0.5  # what all languages share tells nothing
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        return Model(languages, (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32))

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest language, its cosine, and whether the text has letters."""
        grams, begins = gram_numbers(raw, offsets)
        n = len(offsets) - 1
        ends = np.append(begins[1:], len(grams))
        cosine = np.zeros((n, len(self.languages)))
        real = np.zeros(n, np.int64)
        for i in range(n):
            own = np.sort(grams[begins[i] : ends[i]])
            own = own[np.searchsorted(own, 1) :]
            real[i] = len(own)
            if len(own):
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                bundle = self.bundler.bundle(own[heads], np.diff(np.append(heads, len(own))))
                norm = np.sqrt(bundle @ bundle)
                cosine[i] = self.prototypes @ bundle / norm if norm > 0 else 0
        best = cosine.argmax(axis=1) if len(self.languages) else np.zeros(n, np.int64)
        top = cosine[np.arange(n), best] if len(self.languages) else np.zeros(n)
        return best, np.clip(top, 0, 1), real > 0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> Model:
    """A model of all rows of docs with a language and a text. The driver gets n-gram
    counts only: at most CLASSES ** 3 a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    counts = {}
    langs = np.asarray(table.column("lang").to_pylist(), dtype=object)
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(grams[own])]
        counts[lang] = (grams[own].astype(np.int64), n[own].astype(float))
    return Model.of(counts, dimension)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (cosine, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, _SLICE):
                best, score, real = model.predict(raw, offsets[a : b + 1])
                known = real & bool(model.languages)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[np.where(known, best, len(model.languages))], pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))

