"""Toxicity scores of restored text.

Words that look disguised (digits or symbols for letters, letters set apart or
split, letters repeated, letters masked) are restored by a noisy channel: every run of
equal characters becomes the letters it may stand for, once or twice, every '*' any one
letter, and Viterbi decoding finds the most likely spelling under a character trigram
model counted over all texts. Decoded are all words with a letter and a sign (also at
an end: with it and without), with signs between letters or with a letter twice in a row,
and all stretches of words of up to SHORT characters, where the spelling may
keep or drop each space. A letter that stands twice is decoded as twice meant and as
likely to be meant once (see DOUBLED). What consists of digits and signs only is no
word. The words as written and as restored are then scored.

The score is learned from labelled rows: every word and word beginning gets a
cautious log ratio of how many toxic and other texts have it (counted over all learnable
rows), a text is summed up by its words' ratios (how many lie in each of three tiers), and a
logistic regression on these sums, fitted on up to CALIBRATION rows of smallest hash, makes it a
probability. Which of CHOICES are the tiers is found by cross-validation over FOLDS parts of these rows.

Words and beginnings are counted by their full 64-bit hash: first those of toxic texts,
pre-aggregated in each task and summed up by a shuffle; then, of those that
3 toxic texts have, how many other texts have them. So hot sources and words gather
no rows, and what no toxic text holds is never shuffled. The driver gets CLASSES ** 3
counts, the features of 3 labelled toxic texts (which grow with the vocabulary of these
texts, not with the other rows) and the sums of at most CALIBRATION rows.

Defined results: null and empty texts get the score of a text without any toxic word;
repeated rows each get a row; labels join by id, null and repeated labels of an id
count as toxic if any is; an empty table gives an empty result; without toxic and
other labelled texts to learn from all scores are 0; rows that repeat an id with different texts
all count under its label; only the id, text and label columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import materialize, slices, span_hashes, text_buffers
from avrolith.llm.language_id import CLASSES, GRAMS, _letter_classes, gram_numbers

#: Features that a task holds to pre-aggregate counts.
HELD = 1 << 20
CALIBRATION = 20_000
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
_SLICE = 1 << 20

# Letters that digits and symbols stand for. '*' stands for any letter.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz"}
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if c.isascii()]] = True
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True
_SIGNS = "".join(LEET)
_PUNCTUATION = "\"'.,;:?#%&)]}"
#: Costs at which exactly two equal characters are taken for one letter: both readings are scored.
DOUBLED = (0.0, 4.0)
#: Characters of a word that may be a piece of a word.
SHORT = 3

# --- character model --------------------------------------------------------


class CharacterModel:
    """Trigram log probabilities over letter classes, interpolated with shorter ones."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        bi = tri.sum(axis=0)
        uni = bi.sum(axis=0) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 2 * p1) / (bi.sum(axis=1, keepdims=True) + 2)
        p3 = (tri + 2 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 2)
        # n-grams with a blank in the middle aren't counted: letters that begin a word
        first = tri[0].sum(axis=1) + p1
        first[0] = 1e-9
        p3[:, 0] = first / first.sum()
        self.log = np.log(p3).astype(np.float32)
        self.cache: dict[str, list[str]] = {}
        self.tails: dict[tuple[str, str, int], tuple[float, str]] = {}

    def readings(self, written: str) -> list[str]:
        """The likeliest spellings of a disguised word, in lower case, with and without the
        signs at its ends, or of a stretch of short words; no word of it as written."""
        known = self.cache.get(written)
        if known is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            core = written.strip(_PUNCTUATION)
            known = []
            plain = set("".join(c if c.isalpha() else " " for c in core).split())
            for form in dict.fromkeys((core, core.rstrip(_SIGNS), core.lstrip(_SIGNS), core.strip(_SIGNS))):
                if form not in plain and any(c.isalpha() for c in form):
                    for cost in DOUBLED:
                        known += [w for w in self._decode(form, cost).split() if len(w) > 2 and w not in plain and w not in known]
            if len(written) <= 64:
                self.cache[written] = known
        return known

    def restore(self, word: str) -> str:
        """The likeliest spelling of a disguised word, in lower case."""
        return self._decode(word)

    def _cost(self, a: str, b: str, c: str) -> float:
        classes = _letter_classes()
        return -float(self.log[classes[ord(a)], classes[ord(b)], classes[ord(c)]])

    def _masked(self, states: dict) -> dict:
        """The states after one '*' more: of each pair of last letters the best."""
        classes = _letter_classes()
        keys = list(states)
        before = np.array([states[k][0] for k in keys])
        a, b = (np.array([classes[ord(k[i])] for k in keys]) for i in (0, 1))
        total = before[:, None] + 2.0 - self.log[a, b, 1:27]
        last: dict[str, list[int]] = {}
        for i, k in enumerate(keys):
            last.setdefault(k[1], []).append(i)
        out = {}
        for q, rows in last.items():
            at = np.array(rows)[total[rows].argmin(axis=0)]
            for x, i in enumerate(at.tolist()):
                letter = LEET["*"][x]
                out[q, letter] = (float(total[i, x]), (states[keys[i]][1], letter))
        return out

    def _tail(self, a: str, b: str, n: int) -> tuple[float, str]:
        """Cost and letters of the likeliest n letters that end a word after a and b."""
        known = self.tails.get((a, b, n))
        if known is None:
            if len(self.tails) > 50_000:
                self.tails.clear()
            states = {(a, b): (0.0, ())}
            for _ in range(n):
                states = self._masked(states)
            known = self.tails[a, b, n] = self._best(states)
        return known

    def _best(self, states: dict) -> tuple[float, str]:
        best, link = min(((cost + self._cost(a, b, " "), link) for (a, b), (cost, link) in states.items()), key=lambda x: x[0])
        out = []
        while link:
            link, x = link
            out.append(x)
        return best, "".join(reversed(out))

    def _decode(self, word: str, doubled: float = 0.0) -> str:
        runs: list[tuple[str, int]] = []
        for c in word:
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        masked = runs.pop()[1] if runs and runs[-1][0] == "*" else 0
        # state: the last two letters -> (cost, link to the letters so far)
        states: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
        for c, n in runs:
            if c == "*":
                for _ in range(n):
                    states = self._masked(states)
                continue
            if c.isalpha():
                options = [(c, 0.0)]
            elif c in LEET:
                options = [(x, 0.5) for x in LEET[c]]
            elif c == " ":
                options = [("", 0.0), (" ", 0.0)]
            else:
                options = [("", 0.3)]
            spelled = []
            for x, cost in options:
                spelled.append((x, cost + (doubled if n == 2 and x.strip() else 0.0)))
                if n > 1 and x.strip():
                    spelled.append((x + x, cost))
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (a, b), (before, path) in states.items():
                for letters, cost in spelled:
                    total, p, q, link = before + cost, a, b, path
                    for x in letters:
                        total += self._cost(p, q, x)
                        p, q, link = q, x, (link, x)
                    held = new.get((p, q))
                    if held is None or total < held[0]:
                        new[p, q] = (total, link)
            states = new
        if masked:
            ends = [(cost + self._tail(a, b, masked)[0], a, b) for (a, b), (cost, _) in states.items()]
            _, a, b = min(ends)
            head = states[a, b]
            out, link = [], head[1]
            while link:
                link, x = link
                out.append(x)
            return "".join(reversed(out)) + self._tail(a, b, masked)[1]
        return self._best(states)[1]

    def choose(self, x: np.ndarray, extra: np.ndarray, cost: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Viterbi decoding of many sequences of letter classes x at once, where extra, a class,
        may stand before a letter or be left out at a cost (-1: none may): whether it stands."""
        log = self.log.ravel()
        size = np.diff(begins)
        order = np.argsort(size, kind="stable")
        size, at = size[order], begins[:-1][order]
        n, most = len(order), int(size.max(initial=0))
        alive = np.searchsorted(size, np.arange(most), side="right")
        x, extra = x.astype(np.int32), extra.astype(np.int32)
        # costs with the last extra left out and standing, and the two classes before the next letter
        c0, c1 = np.zeros(n, np.float32), np.full(n, np.inf, np.float32)
        a0, a1 = np.zeros(n, np.int32), np.zeros(n, np.int32)
        back = np.zeros((2, len(x)), bool)
        for i in range(most):
            k = int(alive[i])
            own = at[k:] + i
            y, e = x[own], extra[own]
            p0, p1, q0, q1 = c0[k:], c1[k:], a0[k:] * CLASSES, a1[k:] * CLASSES
            s, t = p0 - log[q0 + y], p1 - log[q1 + y]
            back[0, own] = t < s
            zero = np.minimum(s, t)
            one = np.full(n - k, np.inf, np.float32)
            has = np.flatnonzero(e >= 0)
            if len(has):
                zero[has] += cost[own[has]]
                f = e[has]
                s, t = p0[has] - log[q0[has] + f], p1[has] - log[q1[has] + f]
                back[1, own[has]] = t < s
                one[has] = np.minimum(s, t) - log[(a0[k:][has] % CLASSES * CLASSES + f) * CLASSES + y[has]]
            c0[k:], c1[k:] = zero, one
            a1[k:] = np.maximum(e, 0) * CLASSES + y
            a0[k:] = a0[k:] % CLASSES * CLASSES + y
        state = c1 - log[a1 * CLASSES] < c0 - log[a0 * CLASSES]
        out = np.zeros(len(x), bool)
        for i in range(most - 1, -1, -1):
            k = int(alive[i])
            own = at[k:] + i
            out[own] = state[k:]
            state[k:] = np.where(state[k:], back[1, own], back[0, own])
        return out


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(GRAMS, np.int64)
    for batch in batches:
        raw, offsets = text_buffers(batch.column(0))
        for a, b in slices(offsets, _SLICE):
            total += np.bincount(gram_numbers(raw, offsets[a : b + 1])[0], minlength=GRAMS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts: at most CLASSES ** 3 numbers."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = rows.mapInArrow(_count_characters, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAMS, np.int64)
    out[table.column("gram").to_numpy()] = table.column("n").to_numpy()
    return out


# --- words ------------------------------------------------------------------

_RNG = np.random.default_rng(661)
_KEYS = _RNG.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all letter runs of lower-case texts: hashes (words x (1 + beginnings)), how many of the
    columns hold (beginnings longer than the word don't), and the text's number."""
    n = len(data)
    width = 1 + len(BEGINNINGS)
    if not n:
        return np.zeros((0, width), np.uint64), np.zeros((0, width), bool), np.zeros(0, np.int64)
    inside = _LETTER_BYTE[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    edges = np.flatnonzero(edge)
    if len(cuts):
        edges = np.sort(np.concatenate([edges, cuts, cuts]))
    starts, ends = edges[0::2], edges[1::2]
    length = ends - starts
    out = np.empty((len(starts), width), np.uint64)
    holds = np.ones((len(starts), width), bool)
    out[:, 0] = span_hashes(data, starts, length, *_KEYS)
    for i, k in enumerate(BEGINNINGS, 1):
        holds[:, i] = length > k
        out[:, i] = span_hashes(data, starts, np.minimum(length, k), _KEYS[0] + np.uint64(k), _KEYS[1])
    return out, holds, np.searchsorted(off, starts, side="right") - 1


def _flat(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the ranges of UTF-8 bytes, a blank after each, and where each range begins."""
    size = ends - starts + 1
    last = np.cumsum(size)
    at = np.arange(int(last[-1])) + np.repeat(starts - (last - size), size)
    raw = np.append(data, np.uint8(0x20))[np.minimum(at, len(data))]
    raw[last - 1] = 0x20
    raw = np.where(_SPACE_BYTE[raw], np.uint8(0x20), raw)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = (raw & 0xC0) != 0x80
    begins = np.concatenate([[0], np.cumsum(first)[last - 1]])
    return chars, begins


def _words_of(chars: np.ndarray) -> list[str]:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "replace").split(" ")[:-1]


def _respelled(data, starts, ends, model: CharacterModel) -> tuple[list[str], np.ndarray]:
    """Words whose letters stand twice or more in a row as they were meant; of which range each is."""
    chars, begins = _flat(data, starts, ends)
    owner = np.repeat(np.arange(len(starts)), np.diff(begins))
    new = np.ones(len(chars), bool)
    new[1:] = (chars[1:] != chars[:-1]) | (chars[1:] == 0x20)
    heads = np.flatnonzero(new)
    run = np.diff(np.append(heads, len(chars)))
    letter, mine = chars[heads], owner[heads]
    real = letter != 0x20
    heads, run, letter, mine = heads[real], run[real], letter[real], mine[real]
    classes = _letter_classes()[letter].astype(np.int64)
    items = np.searchsorted(mine, np.arange(len(starts) + 1))
    extra = np.where(run > 1, classes, -1)
    words: list[str] = []
    which = []
    before = None
    for cost in DOUBLED:
        twice = model.choose(classes, extra, np.where(run == 2, cost, 0.0), items)
        other = (run > 1) & ~(twice & (run == 2))
        if before is not None:
            other &= np.isin(mine, mine[before != twice])
        before = twice
        changed = np.unique(mine[other])
        keep = np.isin(mine, changed)
        count = 1 + twice[keep].astype(np.int64)
        spelled = np.repeat(letter[keep], count)
        own = np.repeat(mine[keep], count)
        stop = np.searchsorted(own, changed, side="right")
        words += _words_of(np.insert(spelled, stop, 0x20))
        which.append(changed)
    return words, np.concatenate(which)


def _joined(data, starts, ends, model: CharacterModel) -> tuple[list[str], np.ndarray]:
    """Words that stretches of short words spell across their spaces; of which stretch each is."""
    chars, begins = _flat(data, starts, ends)
    owner = np.repeat(np.arange(len(starts)), np.diff(begins))
    classes = _letter_classes()[chars].astype(np.int64)
    at = np.flatnonzero(classes)
    if not len(at):
        return [], np.zeros(0, np.int64)
    mine = owner[at]
    gap = np.zeros(len(at), bool)
    gap[1:] = (np.diff(at) > 1) & (mine[1:] == mine[:-1])
    items = np.searchsorted(mine, np.arange(len(starts) + 1))
    border = model.choose(classes[at], np.where(gap, 0, -1), np.zeros(len(at)), items)
    head = border.copy()
    head[0] = True
    head[1:] |= mine[1:] != mine[:-1]
    word = np.cumsum(head) - 1
    size = np.bincount(word)
    across = np.bincount(word, weights=gap & ~border) > 0
    good = across & (size > 2)
    keep = good[word]
    stop = np.cumsum(size[good])
    return _words_of(np.insert(chars[at][keep], stop, 0x20)), mine[head][good]


def restored(data: np.ndarray, off: np.ndarray, model: CharacterModel) -> list[tuple[int, str]]:
    """(text, word) for every disguised word of lower-case texts."""
    n = len(data)
    if n < 3:
        return []
    inside = ~_SPACE_BYTE[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    edges = np.flatnonzero(edge)
    if len(cuts):
        edges = np.sort(np.concatenate([edges, cuts, cuts]))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return []
    text = np.searchsorted(off, starts, side="right") - 1

    letter = _LETTER_BYTE[data]
    sign = _LEET_BYTE[data]
    for mark in "€£¡":
        code = mark.encode()
        found = np.ones(n - len(code) + 1, bool)
        for i, byte in enumerate(code):
            found &= data[i : n - len(code) + 1 + i] == byte
        for at in np.flatnonzero(found).tolist():
            sign[at : at + len(code)], letter[at : at + len(code)] = True, False
    twice = np.zeros(n, bool)
    twice[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 0x80)
    # letters outside ASCII: two bytes and the same two again
    twice[3:] |= (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (data[2:-1] >= 0xC3) & (data[2:-1] < 0xE0)
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    fresh[starts] = letter[starts]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[ends] - total[starts]

    letters, signs, runs = count(letter), count(sign), count(fresh)
    # the first byte of a word repeats nothing of its own
    head = twice.copy()
    head[starts] = False
    pairs = count(head)
    whole = count((data & 0xC0) != 0x80)
    inner = (runs > 1) | (signs > 0)
    out: list[tuple[int, str]] = []
    for i in np.flatnonzero((letters > 0) & inner & (whole > 2)).tolist():
        t = int(text[i])
        out += [(t, w) for w in model.readings(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))]
    own = np.flatnonzero((pairs > 0) & ~inner & (whole > 2))
    if len(own):
        # the word's letters without what stands about them
        first = np.flatnonzero(fresh)
        last = np.flatnonzero(letter & ~np.append(letter[1:] & ~fresh[1:], False))
        at = np.searchsorted(first, starts[own])
        words, which = _respelled(data, first[at], np.minimum(last[at] + 1, ends[own]), model)
        out += zip(text[own][which].tolist(), words)

    core = count(letter & ((data & 0xC0) != 0x80)) + count(sign & ((data & 0xC0) != 0x80))
    short = (core > 0) & (core <= SHORT) & (whole <= 2 * SHORT)
    follows = np.zeros(len(starts), bool)
    follows[1:] = short[1:] & short[:-1] & (text[1:] == text[:-1])
    heads = np.flatnonzero(short & ~follows)
    if len(heads):
        tails = np.append(heads[1:], len(starts)) - 1
        steps = np.cumsum(follows)
        tails = heads + steps[tails] - steps[heads]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (letters, signs)]
        held, marks = (x[tails + 1] - x[heads] for x in sums)
        many = (tails > heads) & (held > 0)
        for i in np.flatnonzero(many & (marks > 0)).tolist():
            a, b = int(starts[heads[i]]), int(ends[tails[i]])
            stretch = " ".join(w.strip(_PUNCTUATION) for w in data[a:b].tobytes().decode("utf-8", "replace").split())
            out += [(int(text[heads[i]]), w) for w in model.readings(stretch)]
        plain = np.flatnonzero(many & (marks == 0))
        if len(plain):
            words, which = _joined(data, starts[heads[plain]], ends[tails[plain]], model)
            out += zip(text[heads[plain]][which].tolist(), words)
    return out


def _lowered(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return pa.array([(x or b"").decode("utf-8", "replace").lower() for x in column.cast(pa.binary()).to_pylist()], pa.string())


def _features(column: pa.Array, model: CharacterModel):
    """(first text, texts, hashes, holds, text of each word) of slices of a text column,
    words as written and as restored."""
    raw, offsets = text_buffers(_lowered(column))
    for a, b in slices(offsets, _SLICE):
        data, off = raw[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]
        hashes, holds, text = word_features(data, off)
        more = restored(data, off, model)
        if more:
            words = [w.encode("utf-8", "replace") for _, w in more]
            flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            h2, holds2, which = word_features(flat, begin)
            hashes, holds = np.concatenate([hashes, h2]), np.concatenate([holds, holds2])
            text = np.concatenate([text, np.array([t for t, _ in more])[which]])
        yield a, b - a, hashes, holds, text


# --- learning ---------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads, axis=0) if len(keys) else counts


def _counts_out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["feature", "n"])


def _texts_out(n: int) -> pa.RecordBatch:
    """How many texts there are, as a null feature."""
    return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["feature", "n"])


def _count_features(model_of):
    """How many texts have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = seen = 0
        for batch in batches:
            seen += batch.num_rows
            for _, _, hashes, holds, text in _features(batch.column(0), model):
                h, t = hashes[holds], np.broadcast_to(text[:, None], holds.shape)[holds]
                order = np.lexsort((t, h))
                h, t = h[order], t[order]
                new = np.ones(len(h), bool)  # once a text
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                held.append(h[new])
                size += len(held[-1])
                if size > HELD:
                    more = np.concatenate(held)
                    keys, counts = _summed(np.concatenate([keys, more]), np.concatenate([counts, np.ones(len(more), np.int64)]))
                    held, size = [], 0
                    if len(keys) > HELD:
                        yield _counts_out(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        more = np.concatenate([*held, np.zeros(0, np.uint64)])
        yield _counts_out(*_summed(np.concatenate([keys, more]), np.concatenate([counts, np.ones(len(more), np.int64)])))
        yield _texts_out(seen)

    return run


def _count_known(model_of, shared):
    """How many texts have each of the features of shared, which are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = model_of(), shared.value
        totals = np.zeros(len(known), np.int64)
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            for _, count, hashes, holds, text in _features(batch.column(0), model):
                h, t = hashes[holds], np.broadcast_to(text[:, None], holds.shape)[holds]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = known[at] == h
                pair = np.unique(at[own] * count + t[own])  # once a text
                totals += np.bincount(pair // count, minlength=len(known))
        at = np.flatnonzero(totals)
        yield _counts_out(known[at], totals[at])
        yield _texts_out(seen)

    return run


def log_ratios(other: np.ndarray, toxic: np.ndarray, n_other: int, n_toxic: int) -> np.ndarray:
    """Lower bounds of the log ratio of a feature's shares among toxic and other texts; 0 if not positive."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    bound = ratio - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return np.where((bound > 0) & (toxic >= 3), bound, 0).astype(np.float32)


#: Log ratios from which a word counts as weakly, clearly and surely toxic: what may be chosen.
CHOICES = ((1.0, 2.5, 4.0), (0.5, 1.5, 3.0), (0.5, 2.0, 3.5), (1.0, 2.0, 3.0), (1.5, 3.0, 4.5))
EDGES = tuple(sorted({t for c in CHOICES for t in c}))
FOLDS = 5
SUMS = len(CHOICES[0]) + 3
_X = [f"x{i}" for i in range(SUMS)]
#: What is counted of a text: words beyond each edge, the sum of the ratios, and words.
_COUNTS = [f"c{i}" for i in range(len(EDGES) + 2)]


class Weights:
    """Log ratios by feature, looked up by the full hash."""

    def __init__(self, features: np.ndarray, ratios: np.ndarray):
        order = np.argsort(features)
        self.features, self.ratios = features[order], ratios[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros(hashes.shape, np.float32)
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        return np.where(self.features[at] == hashes, self.ratios[at], np.float32(0))


def _counted(hashes, holds, text, count, weights) -> list[np.ndarray]:
    """Of each text: its words whose best ratio is beyond each edge, the sum of the ratios, and its words."""
    value = np.where(holds, weights.of(hashes), 0).max(axis=1) if len(hashes) else np.zeros(0)
    some = value > 0
    beyond = [np.bincount(text[some], weights=(value[some] > e).astype(float), minlength=count) for e in EDGES]
    return [*beyond, np.bincount(text[some], weights=value[some], minlength=count), np.bincount(text, minlength=count).astype(float)]


def _sums(counted: list[np.ndarray], tiers: tuple[float, ...]) -> np.ndarray:
    """Of each text: its words by tier of their best ratio, the sum of the ratios, that
    sum per word, and its words, all as logarithms."""
    total, words = counted[-2:]
    beyond = [counted[EDGES.index(t)] for t in tiers]
    inside = [a - b for a, b in zip(beyond, [*beyond[1:], 0.0])]
    return np.stack([*map(np.log1p, inside), np.log1p(total), np.log1p(200 * total / np.maximum(words, 20)), np.log1p(words)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, lightly penalised: weights, means, scales."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([*[0.5] * x.shape[1], 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def choose_tiers(counted: list[np.ndarray], y: np.ndarray) -> tuple[float, ...]:
    """Of CHOICES the tiers with the least loss of rows left out of the fit, fold by fold; of equals the first."""
    fold = np.arange(len(y)) % FOLDS
    losses = []
    for tiers in CHOICES:
        x, loss = _sums(counted, tiers), 0.0
        for k in range(FOLDS):
            own = fold == k
            if own.all() or not own.any():
                continue
            w, mean, scale = _fit(x[~own], y[~own])
            z = np.clip((x[own] - mean) / scale @ w[:-1] + w[-1], -30, 30)
            loss += np.log1p(np.exp(np.where(y[own] > 0, -z, z))).sum()
        losses.append(loss)
    return CHOICES[int(np.argmin(losses))]


_models: dict[int, CharacterModel] = {}


def _model_of(shared):
    def get() -> CharacterModel:
        key = shared.id if hasattr(shared, "id") else id(shared)
        if key not in _models:
            _models.clear()
            _models[key] = CharacterModel(shared.value)
        return _models[key]

    return get


def _sum_rows(model_of, weights, tiers: tuple[float, ...] | None = None):
    """The sums by tiers of each row, or what is counted of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            for a, count, hashes, holds, text in _features(batch.column(0), model):
                columns = _counted(hashes, holds, text, count, weights.value)
                if tiers:
                    columns = _sums(columns, tiers).T
                yield pa.RecordBatch.from_arrays([*[c.slice(a, count) for c in batch.columns[1:]], *map(pa.array, columns)], names=[*batch.schema.names[1:], *(_X if tiers else _COUNTS)])

    return run


def score(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", calibration: int = CALIBRATION) -> DataFrame:
    """Per row of docs: doc_id, score, predicted. labelled: (id_col, toxic) of the rows
    to learn from; only their texts in docs are used."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    counts = sc.broadcast(character_counts(docs, text_col))
    model_of = _model_of(counts)

    marks = labelled.where("toxic is not null").groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # the learnable texts are read three times: kept as one table, by shuffle at any size
    known = materialize(rows.join(marks.hint("merge"), F.col("doc_id") == F.col("l_id")).select("text", "toxic", "doc_id"), "learnable")

    def total(of: DataFrame, run) -> tuple[np.ndarray, np.ndarray, int]:
        """Features, sorted, in how many texts, and how many texts there are."""
        sums = of.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        got = sums.where("feature is null or n >= 3" if of is bad else "true").toArrow()
        real = got.filter(pc.is_valid(got.column("feature")))
        texts = pc.sum(got.filter(pc.is_null(got.column("feature"))).column("n")).as_py() or 0
        feature, n = real.column("feature").to_numpy().view(np.uint64), real.column("n").to_numpy()
        order = np.argsort(feature)
        return feature[order], n[order], texts

    bad = known.where("toxic = 1")
    nothing = rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    feature, toxic, n_toxic = total(bad, _count_features(model_of))
    if not n_toxic:
        return nothing
    candidates = sc.broadcast(feature if len(feature) else np.zeros(1, np.uint64))
    found, n, n_other = total(known.where("toxic = 0"), _count_known(model_of, candidates))
    if not n_other:
        return nothing
    other = np.zeros(len(feature), np.int64)
    if len(feature):
        other[np.searchsorted(feature, found)] = n
    ratios = log_ratios(other, toxic, n_other, n_toxic)
    weights = Weights(feature[ratios > 0], ratios[ratios > 0])
    shared = sc.broadcast(weights)

    # somewhat more than the sample by a bound on the hash, then exactly those of smallest hash
    bound = min(1.0, (1.2 * calibration + 200) / (n_other + n_toxic))
    near = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(77)), 1)).where(F.col("h") <= F.lit(min(int(bound * 2**63), 2**63 - 1)))
    counted = near.select("text", "toxic", "h").mapInArrow(_sum_rows(model_of, shared), "toxic int, h long, " + ", ".join(f"{c} double" for c in _COUNTS))
    got = counted.orderBy("h", "toxic", *_COUNTS).limit(calibration).toArrow()
    if not got.num_rows:
        return nothing
    y, counted = got.column("toxic").to_numpy().astype(float), [got.column(c).to_numpy() for c in _COUNTS]
    tiers = choose_tiers(counted, y)
    w, mean, scale = _fit(_sums(counted, tiers), y)

    summed = rows.mapInArrow(_sum_rows(model_of, shared, tiers), "doc_id long, " + ", ".join(f"{x} double" for x in _X))
    z = sum((F.lit(float(w[i] / scale[i])) * (F.col(f"x{i}") - float(mean[i])) for i in range(SUMS)), F.lit(float(w[SUMS])))
    scored = summed.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

