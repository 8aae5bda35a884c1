"""Benchmark decontamination by canonical templates.

Texts become typed tokens: numbers (digits, or number words), names (capitalised tokens), units, and other words, lower-cased. A
template puts one placeholder for each type; windows of WINDOW template tokens are hashed and joined with the benchmark's. Windows with
fewer than LITERAL plain words say too little as templates and stand for their literal tokens, so that a verbatim copy is always whole. Hits on one alignment of document and item, or on a chain of them that rises in both and shifts by DRIFT
tokens at most from hit to hit, are a leak if they cover COVERAGE of the item's tokens and the slots agree: an item's slot value stands for one value throughout the passage and the other way round, in more than AGREE of the slots. So
a question with other numbers, names or units is caught, and one whose slots are shuffled is not. All this is done twice, with tokens as they are and with runs of numbers or names as one token,
so that values may be longer or shorter.

The benchmark is indexed in parts of at most PART_BYTES, each broadcast to one pass over the documents; a benchmark of any size is
as many passes. Documents are never shuffled.

Defined results: null and empty texts leak nothing; an item shorter than WINDOW tokens is one window of its literal tokens, found where
all of them stand in a row; items without tokens, and null items, are found nowhere; rows that repeat give rows that repeat; a null doc_id passes through; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

WINDOW, LITERAL, COVERAGE, AGREE = 5, 3, 0.5, 0.8
#: Tokens by which the shift may change from one hit of a chain to the next.
DRIFT = 8
PART_BYTES = 32 << 20
#: Window pairs of texts and items in memory at once, one text's at least.
PAIRS = 1 << 20
U = np.uint64

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres".split()
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_JOINS = np.array([b in b".," for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
#: Placeholders, by kind: word (none), number, name, unit.
_SLOTS = K.mix64(np.arange(4, dtype=np.uint64) + U(77))


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(w) for w in raw])]
    return np.sort(K.span_hashes(data, off[:-1], off[1:]))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def typed_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind) of each token, the offsets of each text's tokens, and whether a token goes on with the run of numbers or names
    before it."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(off), np.int64), np.zeros(0, bool)
    digit = _DIGIT[data]
    starts, ends, at = K.word_spans(data, off, K.IS_WORD[data] | (_JOINS[data] & np.r_[False, digit[:-1]] & np.r_[digit[1:], False]))
    token = K.span_hashes(data, starts, ends)
    first, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    kind = np.zeros(len(token), np.int8)
    capital = _UPPER[first] & ~(_UPPER[second] & (ends - starts > 1))  # words all in capitals are plain
    kind[capital | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (ends - starts > 1))] = 2
    kind[_among(token, _hashes(UNITS))] = 3
    kind[_DIGIT[first] | _among(token, _hashes(NUMBER_WORDS))] = 1
    on = np.r_[False, (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 2)) & (starts[1:] == ends[:-1] + 1)][: len(kind)]
    on[at[:-1][at[:-1] < len(on)]] = False
    return token, kind, at, on


def folded(token: np.ndarray, kind: np.ndarray, at: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with each run of numbers or names as one, and the place of the first token of each."""
    head = np.flatnonzero(~on)
    if not len(head):
        return token, kind, at, head
    rank = np.arange(len(token)) - head[np.cumsum(~on) - 1]
    value = np.where(on, K.mix64(token + rank.astype(np.uint64) * U(0x9E3779B97F4A7C15)), token)
    return np.add.reduceat(value, head), kind[head], np.searchsorted(head, at), head


def template_windows(token: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first token) of each window: of its template, or of its literal tokens if plain words are too few."""
    code = np.where(kind == 0, token, _SLOTS[kind])
    h, to = K.shingles_of(code, at, WINDOW)
    counts = np.diff(to)
    place = K.ragged(at[:-1], counts)
    plain = np.r_[0, np.cumsum(kind == 0)]
    few = plain[place + WINDOW] - plain[place] < LITERAL
    if few.any():
        h[few] = K.mix64(K.shingles_of(token, at, WINDOW)[0][few] + U(WINDOW))
    return h, place


def short_windows(token: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first token) of each window of ``size`` literal tokens."""
    h, to = K.shingles_of(token, at, size)
    return h, K.ragged(at[:-1], np.diff(to))


class _View:
    """Template windows of items in one reading of their tokens."""

    def __init__(self, token: np.ndarray, kind: np.ndarray, at: np.ndarray):
        self.token, self.kind, self.at = token, kind, at
        h, place = template_windows(token, kind, at)
        order = np.argsort(h, kind="stable")
        self.hash, self.place = h[order], place[order]
        self.item = np.searchsorted(at, self.place, "right") - 1

    def leaks(self, token: np.ndarray, kind: np.ndarray, at: np.ndarray) -> dict:
        """(coverage, agreeing slots, slots, place of the first token) of each leak, by (text, item)."""
        h, place = template_windows(token, kind, at)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        some = hi > lo
        lo, count, place = lo[some], (hi - lo)[some], place[some]
        best: dict = {}
        if not len(lo):
            return best
        # Items of one template meet a text's window together; so many pairs at once, and whole texts.
        text = np.searchsorted(at, place, "right") - 1
        ends = np.r_[np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)]
        for i, j in K.slices(np.r_[0, np.cumsum(count)[ends - 1]], PAIRS):
            some = slice(int(ends[i - 1]) if i else 0, int(ends[j - 1]))
            self._align(best, lo[some], count[some], place[some], token, at)
        return best

    def _align(self, best: dict, lo: np.ndarray, count: np.ndarray, place: np.ndarray, token: np.ndarray, at: np.ndarray) -> None:
        hit, here = K.ragged(lo, count), np.repeat(place, count)
        item, there = self.item[hit], self.place[hit]
        text = np.searchsorted(at, here, "right") - 1
        shift = here - there
        order = np.lexsort((there, shift, item, text))
        text, item, there, here, shift = (x[order] for x in (text, item, there, here, shift))
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])]
        for g, (a, b), covered in self._enough(new, item, there):
            self._try(best, (int(text[a]), int(item[a])), covered, there[a:b], here[a:b], token)
        # Chains: what hits of a text and an item cover, whatever their shifts, bounds what a chain of them can.
        shifts = np.add.reduceat(new, np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        order = np.lexsort((here, there, item, text))
        text, item, there, here = (x[order] for x in (text, item, there, here))
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
        for g, (a, b), _ in self._enough(new, item, there):
            if shifts[g] > 1:
                size = int(self.at[item[a] + 1] - self.at[item[a]])
                for chain, covered in self._chains(there[a:b], here[a:b], size):
                    self._try(best, (int(text[a]), int(item[a])), covered, there[a:b][chain], here[a:b][chain], token)

    def _enough(self, new: np.ndarray, item: np.ndarray, there: np.ndarray):
        """(group, its range, covered tokens) of the groups whose hits cover COVERAGE of their item."""
        head = np.flatnonzero(new)
        step = np.where(new, WINDOW, np.minimum(WINDOW, there - np.r_[0, there[:-1]]))
        covered, size = np.add.reduceat(step, head), np.diff(self.at)[item[head]]
        ends = np.r_[head[1:], len(new)]
        for g in np.flatnonzero(covered >= COVERAGE * size):
            yield g, (head[g], ends[g]), int(covered[g])

    @staticmethod
    def _chains(there: np.ndarray, here: np.ndarray, size: int):
        """(hits, covered tokens) of the best chain to each last hit that covers COVERAGE and that no hit continues."""
        order = np.lexsort((there, here))
        t, d = there[order], here[order]
        score, back, ends = np.full(len(t), WINDOW), np.full(len(t), -1), np.ones(len(t), bool)
        first = np.searchsorted(d, d - size - DRIFT)
        for i in range(len(t)):
            a = first[i]
            ok = np.flatnonzero((d[a:i] < d[i]) & (t[a:i] < t[i]) & (np.abs(d[a:i] - t[a:i] - d[i] + t[i]) <= DRIFT)) + a
            if len(ok):
                gain = score[ok] + np.minimum(WINDOW, t[i] - t[ok])
                j = ok[len(ok) - 1 - int(np.argmax(gain[::-1]))]
                score[i], back[i], ends[j] = gain.max(), j, False
        for i in np.flatnonzero(ends & (score >= COVERAGE * size)):
            chain = []
            while i >= 0:
                chain.append(i)
                i = back[i]
            yield order[chain[::-1]], int(score[chain[0]])

    def _try(self, best: dict, key: tuple[int, int], covered: int, there: np.ndarray, here: np.ndarray, token: np.ndarray) -> None:
        """Keeps the hits as the pair's leak if their slots agree and they cover more than others."""
        places, at = np.unique((there[:, None] + np.arange(WINDOW)).ravel(), return_index=True)
        slot = self.kind[places] > 0
        ours, theirs = places[slot], (here[:, None] + np.arange(WINDOW)).ravel()[at][slot]
        agree = self.consistent(self.token[ours], token[theirs])
        if agree > AGREE * len(ours) or not len(ours):
            size = self.at[key[1] + 1] - self.at[key[1]]
            found = (float(covered / size), int(agree), len(ours), int(here[0]))
            best[key] = max(best.get(key, found), found, key=lambda f: (f[0], f[1], -f[3]))

    @staticmethod
    def consistent(ours: np.ndarray, theirs: np.ndarray) -> int:
        """Slots that follow the commonest one-to-one reading of values."""
        if not len(ours):
            return 0
        pairs, n = np.unique(np.stack([ours, theirs]), axis=1, return_counts=True)
        used: tuple[set, set] = (set(), set())
        agree = 0
        for i in np.argsort(-n, kind="stable"):
            a, b = pairs[:, i].tolist()
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                agree += int(n[i])
        return agree


class Index:
    """Template windows of a bounded part of the benchmark, with tokens as they are and with runs folded."""

    def __init__(self, ids: list[int], texts: pa.Array):
        self.ids = np.array(ids, np.int64)
        token, kind, at, on = typed_tokens(*K.text_buffer(texts))
        self.plain, self.folded = _View(token, kind, at), _View(*folded(token, kind, at, on)[:3])
        self.short = {}
        for n in range(1, WINDOW):
            which = np.flatnonzero(np.diff(at) == n)
            if len(which):
                h, place = short_windows(token, at, n)
                first = np.searchsorted(place, at[which])
                order = np.argsort(h[first], kind="stable")
                slots = (kind[at[which][:, None] + np.arange(n)] > 0).sum(axis=1)
                self.short[n] = h[first][order], which[order], slots[order]

    def leaks(self, data: np.ndarray, off: np.ndarray) -> list[tuple]:
        """(text, item id, coverage, agreeing slots, slots, first token) of each leak."""
        token, kind, at, on = typed_tokens(data, off)
        best = self.plain.leaks(token, kind, at)
        *runs, head = folded(token, kind, at, on)
        for key, found in self.folded.leaks(*runs).items():
            best.setdefault(key, (*found[:3], int(head[found[3]])))
        for n, (hashes, items, slots) in self.short.items():
            h, place = short_windows(token, at, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = hi > lo
            hit, here = K.ragged(lo[some], (hi - lo)[some]), np.repeat(place[some], (hi - lo)[some])
            for t, k, p in zip((np.searchsorted(at, here, "right") - 1).tolist(), hit.tolist(), here.tolist()):
                best.setdefault((t, int(items[k])), (1.0, int(slots[k]), int(slots[k]), p))
        return [(t, int(self.ids[i]), *found[:3], found[3] - int(at[t])) for (t, i), found in best.items()]


def _scan(index):
    def scan(batches):
        for batch in batches:
            data, off = K.text_buffer(batch.column("text"))
            ids, out = batch.column("doc_id").to_pylist(), []
            for a, b in K.slices(off):
                out += [(ids[a + t], *found) for t, *found in index.value.leaks(data[off[a] : off[b]], off[a : b + 1] - off[a])]
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "coverage", "slots_agreeing", "slots", "first_token"])

    return scan


def _indexes(benchmark: DataFrame):
    """The benchmark's indexes, broadcast, each of a part of at most about PART_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows["item_id"].to_pylist(), rows["text"].combine_chunks()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, slots_agreeing, slots, first_token: each benchmark item that a document holds."""
    schema = "doc_id long, item_id long, coverage double, slots_agreeing int, slots int, first_token long"
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in _indexes(benchmark):
        found = texts.mapInArrow(_scan(index), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are; no join and no shuffle."""
    for index in _indexes(benchmark):

        def keep(batches, index=index):
            for batch in batches:
                data, off = K.text_buffer(batch.column("text"))
                ok = np.ones(batch.num_rows, bool)
                for a, b in K.slices(off):
                    ok[[a + found[0] for found in index.value.leaks(data[off[a] : off[b]], off[a : b + 1] - off[a])]] = False
                yield batch.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
