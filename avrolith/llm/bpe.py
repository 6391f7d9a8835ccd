"""BPE encoding and decoding.

Encoding follows the pretokens of the vocabulary's pattern. Within a
pretoken an Aho-Corasick automaton over all tokens gives the longest token at every
position; a left-to-right walk takes it if the pair with the token before
is compatible (merging the two tokens' bytes gives these two tokens again),
else the next shorter token, else it goes back one token. A sequence whose
adjacent pairs are all compatible is the one that merging gives, and each position
fails at most once, so the walk takes linear time. Compatible pairs are kept in
a table filled on demand. Decoding gathers token bytes through an offset table.

Texts are worked off in runs of pretokens with incremental digests, so a very
long text needs memory for one run only besides itself. The caches are
cleared when they hold CACHE_ENTRIES entries, and at the end of a task: a Python worker outlives
its tasks, and what it keeps counts as its executor's memory in whatever runs there next.

Defined results: a null or empty text has no tokens and the digests of no
bytes; added special tokens in a text are encoded as such; repeated rows each
get a row; an empty table gives an empty result; only the id and text columns are
read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from avrolith.llm.common import slices, text_buffers, texts

CACHE_ENTRIES = 400_000
#: Encoded rows are given out for so many bytes of text at a time, one row at least.
PIECE_BYTES = 4 << 20
#: Texts longer than this many characters are worked off in runs of pretokens.
LONG_TEXT = 1 << 20
RUN = 100_000

# The byte-level pattern of this kind of vocabulary, with \s written
# out as the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes
    stand for themselves, the others are numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Packed(dict):
    """Pretoken -> its ids as little-endian unsigned 32-bit integers. When full, it
    keeps what it holds as an older generation, from which words in use come back."""

    def __init__(self, encoder: "Encoder"):
        self.encoder = encoder
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            four = self.encoder.four
            packed = b"".join([four[i] for i in self.encoder.encode_bytes(word.encode("utf-8"))])
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Byte-level BPE of a tokenizers JSON file's content."""

    def __init__(self, content: str | bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or added prefix space is supported")
        for added in spec["added_tokens"]:
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError(f"unsupported added token {added['content']!r}")
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {added["content"]: added["id"] for added in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.rank = [-1] * size  # place of the merge that makes the token
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for place, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (ids[bytes(letters[c] for c in half)] for half in (left, right))
            whole = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merged.setdefault((a, b), place)
            if self.halves[whole] is None:
                self.rank[whole], self.halves[whole] = place, (a, b)
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            for end in range(len(token) - 1, 0, -1):
                if (prefix := ids.get(token[:end])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton.make_automaton()
        lengths = [len(b) for b in self.bytes_of]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.lengths = lengths
        self.four = [i.to_bytes(4, "little") for i in range(size)]
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.packed = _Packed(self)
        self.pretokens = regex.compile(_PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def forget(self) -> None:
        """Empty the caches."""
        self.packed.clear()
        self.packed.old = {}
        self.pairs.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives (left, right) again."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self._holds(left, right)
        return known

    def _holds(self, a: int, b: int) -> bool:
        # Undo the later merge on either side of the seam, again and again; a merge
        # across the seam that comes before what was undone would have been taken.
        # On the right side it also wins a tie, being further left.
        rank, halves, merged = self.rank, self.halves, self.merged
        bound = len(merged) + 1
        while True:
            across = merged.get((a, b))
            if across is not None and across < bound:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                bound, a = rank[a], halves[a][1]
            else:
                bound, b = rank[b] + 1, halves[b][0]

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        n = len(word)
        longest = [-1] * n
        reach = [0] * n
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        if n and reach[0] == n:
            return [longest[0]]
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        at, last = 0, -1
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if alive[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            elif out:
                # a dead end: go back and try a shorter token in place of the last
                alive[at] = 0
                out.pop()
                at -= lengths[last]
                token = shorter[last]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary can't spell this text")
        return out

    def runs(self, text: str) -> Iterator[bytes]:
        """The ids of a text, packed, in runs of bounded length."""
        pieces = [text]
        if self.specials is not None and any(s in text for s in self.special):
            pieces = self.specials.split(text)
        get = self.packed.__getitem__
        for piece in pieces:
            if piece in self.special:
                yield self.special[piece].to_bytes(4, "little")
            elif len(piece) <= LONG_TEXT:
                yield b"".join(map(get, self.pretokens.findall(piece)))
            else:
                run: list[str] = []
                for m in self.pretokens.finditer(piece):
                    run.append(m.group())
                    if len(run) == RUN:
                        yield b"".join(map(get, run))
                        run = []
                yield b"".join(map(get, run))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.runs(text)), dtype="<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Token bytes, one after another, gathered through the offset table."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(starts - (ends - lengths), lengths)
        shift += np.arange(ends[-1])
        return self.blob[shift].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


@contextmanager
def _task(content: bytes) -> Iterator[Encoder]:
    """The worker's encoder, whose caches go when the task ends."""
    encoder = encoder_of(content)
    try:
        yield encoder
    finally:
        encoder.forget()
        pa.default_memory_pool().release_unused()


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of PIECE_BYTES of a text column."""
    if batch.num_rows:
        for start, end in slices(text_buffers(batch.column(column))[1], PIECE_BYTES):
            yield batch.slice(start, end - start)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _content(spark, tokenizer: str | None):
    # A vocabulary file of a few MB, read by the driver: executors need no copy of it.
    with open(tokenizer or default_tokenizer(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", tokenizer: str | None = None, digest_col: str | None = None) -> DataFrame:
    """docs with ids_col: array<int>, the text's token ids, and with digest_col, if one is named: the
    SHA-256 of the bytes that these ids decode to (columns of these names are replaced)."""
    shared = _content(docs.sparkSession, tokenizer)

    added = [StructField(ids_col, ArrayType(IntegerType())), *([StructField(digest_col, StringType())] if digest_col else [])]
    fields = [f for f in docs.schema if f.name not in (ids_col, digest_col)]
    names = [f.name for f in fields]
    at = names.index(text_col)

    def run(batches):
        with _task(shared.value) as encoder:
            for batch in batches:
                for piece in _pieces(batch, at):
                    out, digests = [], []
                    for text in texts(piece.column(at)):
                        packed = list(encoder.runs(text))
                        out.append(np.frombuffer(b"".join(packed), dtype="<i4"))
                        if digest_col:
                            digest = hashlib.sha256()
                            for x in packed:
                                digest.update(encoder.decode_bytes(np.frombuffer(x, dtype="<u4").astype(np.int64)))
                            digests.append(digest.hexdigest())
                    new = [pa.array(out, pa.list_(pa.int32())), *([pa.array(digests, pa.string())] if digest_col else [])]
                    yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*names, *[f.name for f in added]])

    return docs.select(*names).mapInArrow(run, StructType([*fields, *added]))


def decode_documents(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """docs with text_col: the text that ids_col spells (null ids: empty)."""
    shared = _content(docs.sparkSession, tokenizer)
    names = [c for c in docs.columns if c != text_col]
    fields = [f for f in docs.schema if f.name != text_col]

    def run(batches):
        with _task(shared.value) as encoder:
            for batch in batches:
                # row by row from the buffers: a batch's ids as Python objects take ten times the memory
                rows = (x.values for x in batch.column(names.index(ids_col)))
                out = [encoder.decode(x.to_numpy()) if x is not None else "" for x in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text_col])

    return docs.select(*names).mapInArrow(run, StructType([*fields, StructField(text_col, StringType())]))


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; both ways are run over
    the whole text, the decoded bytes come from the ids."""
    shared = _content(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task(shared.value) as encoder:
            for batch in batches:
                counts, id_digests, text_digests = [], [], []
                for text in texts(batch.column(1)):
                    a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                    for packed in encoder.runs(text):
                        a.update(packed)
                        n += len(packed) // 4
                        b.update(encoder.decode_bytes(np.frombuffer(packed, dtype="<u4").astype(np.int64)))
                    counts.append(n)
                    id_digests.append(a.hexdigest())
                    text_digests.append(b.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
