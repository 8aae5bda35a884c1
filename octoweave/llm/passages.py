"""Near-duplicate passages by compact windows over five-word shingles.

For each hash function a document's Cartesian tree (each node the least hash of its range) says which subsequences share a min-hash:
all [i, j] with l <= i <= c <= j <= r have theirs at c. Only ranges (l, c, r) of at least WINDOW shingles matter, 50 words; their
centres are the minima of the WINDOW-long windows, and the tree is built over the centres alone, since a centre's nearest smaller
neighbour is a centre too.

1. Functions come in BANDS pairs. An interval join within the document finds where the compact windows of both functions of a pair
   hold a common subsequence of WINDOW shingles; such a region is named by its two min-hashes. Windows of similarity THRESHOLD share
   a name with probability 1 - (1 - THRESHOLD ** 2) ** BANDS, equal ones always.
2. Each task joins its regions of equal name to the first document among its own and sends one of them on; the same join follows
   over the corpus, in hash buckets: every region is joined to the first document of its name, a star and never all pairs, and a
   name held by any number of documents has one entry for each task.
3. Joined regions of two documents meet in a bucket of the pair. Those whose windows can lie side by side become stretches of one
   diagonal, overlaps merged. The second document's shingles come in pieces of PIECE, each made once and joined to all stretches
   that ask for it, so that a document with very many partners is a join that adaptive execution splits; the first document's block
   verifies. A passage is a window of WINDOW shingles in either document, at most DRIFT places off the diagonal, of which SHARED are
   in the other's: a Jaccard similarity of THRESHOLD, window against window.
4. The first document of a name need not hold what the others share, and what a second one shares with it need not be what a third
   shares with the second. Where the links so far leave the documents of a name in several connected groups, all its regions are put
   together again; equal regions of one group stand for one another, and regions of different groups are compared in blocks. A passage's
   window has MISSES shingles at most that are not shared, so that of any MISSES + 1 of them one is: each region looks up the least
   common ones of its windows, and meets those that hold one. Pairs in which a window of WINDOW has LIKELY hits by one byte a
   shingle are verified as in step 3, and those that join groups leave the task, a forest and never all pairs.

Documents that share a passage are linked; classes are connected components.

Defined results: null, empty and short texts have no passages; a null doc_id takes no part and has a null class; rows that share a
doc_id are one document, and each of their texts is compared; a passage repeated within one document is no link; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import buckets_for, components, drop, materialise, text_bytes

SHINGLE, WINDOW, THRESHOLD = 5, 46, 0.8
#: Pairs of hash functions.
BANDS = 3
#: Shingles that windows of equal length must share for a Jaccard similarity of THRESHOLD.
SHARED = int(np.ceil(2 * THRESHOLD * WINDOW / (1 + THRESHOLD)))
#: Places that shared shingles may lie off the diagonal; shingles of a piece.
DRIFT, PIECE = 8, 64
#: Hits by one byte a shingle that make a pair of the second round a candidate, fewer than SHARED; members of a block.
LIKELY, BLOCK_ROWS = 36, 2048
#: Shingles of a passage's window that need not be shared; starts of windows whose probes are chosen together.
MISSES, STEP = WINDOW - SHARED, 4
KEY_BYTES, HASH_BYTES = 5, 5
CHUNK_BYTES, BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20, 8 << 20
_PIECE = 1 << 20
U = np.uint64
_zip = pa.Codec("zstd", compression_level=3)

#: A joined pair of regions of one name: documents x >= z, name, and for each the place of the first function's centre and how far
#: before it the region's first and last windows start. Where x is z the document holds the name again: no pair, but a place for step 4.
EDGE = np.dtype([("x", "<i8"), ("z", "<i8"), ("k", "<u8"), ("xc", "<u4"), ("xa", "u1"), ("xb", "u1"), ("zc", "<u4"), ("za", "u1"), ("zb", "u1")])


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, each by itself, so that like bytes stand together."""
    whole = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(whole).to_bytes(8, "little") + bytes(_zip.compress(whole))


def expand(b: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(_zip.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little")), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


_WINDOW_KINDS = ["V5", "<i8", "<u4", "u1", "u1"]
_EDGE_KINDS = [EDGE.fields[name][0] for name in EDGE.names]


def nearest_smaller(v: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each, or -1; ``same``: it follows its predecessor within one document."""
    at = np.where(same, np.arange(len(v)) - 1, -1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[v[at[open_]] > v[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def compact_windows(shingles: np.ndarray, to: np.ndarray, f: int):
    """(min-hash, document, l, c, r) of the windows of WINDOW shingles at least for hash function f; places count within a document."""
    out, n = [], len(shingles) - WINDOW + 1
    for a in range(0, n, _PIECE):
        b = min(a + _PIECE, n)
        end = b + WINDOW - 1
        h = K.mix64(shingles[a:end] ^ U(0x9E3779B97F4A7C15 * (f + 1) % 2**64)) & U(0xFFFFFFFFFF000000)
        least = K.sliding_min(h | np.arange(end - a, dtype=np.uint64), WINDOW)
        first, last = int(np.searchsorted(to, a, "right")) - 1, int(np.searchsorted(to, b, "left"))
        ends = np.repeat(to[first + 1 : last + 1], np.diff(np.clip(to[first : last + 1], a, b)))
        least = least[ends - np.arange(a, b) >= WINDOW]
        if not len(least):
            continue
        value = least[np.r_[True, least[1:] != least[:-1]]]
        value = value[np.r_[True, value[1:] != value[:-1]]]
        c = (value & U(0xFFFFFF)).astype(np.int64) + a
        doc = np.searchsorted(to, c, "right") - 1
        lo, hi = np.maximum(to[doc], a), np.minimum(to[doc + 1], end)
        left = nearest_smaller(value, np.r_[False, doc[1:] == doc[:-1]])
        right = nearest_smaller(value[::-1], np.r_[False, doc[::-1][1:] == doc[::-1][:-1]])
        right = np.where(right >= 0, len(value) - 1 - right, -1)[::-1]
        out.append((K.mix64(shingles[c] + U(f)), doc, np.where(left >= 0, c[left] + 1, lo) - to[doc], c - to[doc], np.where(right >= 0, c[right] - 1, hi - 1) - to[doc]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64)]


def regions(shingles: np.ndarray, to: np.ndarray, band: int):
    """(name, document, c, a, b): where the compact windows of a band's two functions have common subsequences of WINDOW shingles. c is
    the first function's centre, a and b how far before it the first and last of those subsequences start."""
    sides = []
    for f in (2 * band, 2 * band + 1):
        key, doc, l, c, r = compact_windows(shingles, to, f)
        c, base = c + to[doc], to[doc]
        sides.append((key, doc, c, np.maximum(l + base, c - WINDOW + 1), np.minimum(c, r + base - WINDOW + 1)))
    (key, doc, c, lo, hi), (other, _, _, lo2, hi2) = sides
    if not len(key):
        return key, doc, c, c, c
    # Both lists of ranges are in order and without overlaps, so that their overlaps begin where a range of either begins.
    first = np.union1d(lo, lo2)
    i, j = np.searchsorted(lo, first, "right") - 1, np.searchsorted(lo2, first, "right") - 1
    last = np.minimum(hi[i], hi2[j])
    some = (i >= 0) & (j >= 0) & (first <= last)
    i, j, first, last = i[some], j[some], first[some], last[some]
    return K.mix64(K.mix64(key[i] + U(band)) + other[j]), doc[i], c[i] - to[doc[i]], c[i] - first, c[i] - last


def star(name, doc, c, a, b):
    """Joins each region to the first of its name; returns the edges, and which regions are first."""
    order = np.lexsort((c, doc, name))
    name, doc, c, a, b = (x[order] for x in (name, doc, c, a, b))
    new = np.r_[True, name[1:] != name[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    pick = np.flatnonzero(~new)
    h, edges = head[pick], np.zeros(len(pick), EDGE)
    for field, value in (("x", doc[pick]), ("z", doc[h]), ("k", name[pick]), ("xc", c[pick]), ("xa", a[pick]), ("xb", b[pick]), ("zc", c[h]), ("za", a[h]), ("zb", b[h])):
        edges[field] = value
    return edges, order[new]


def _pair_bucket(x: np.ndarray, z: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix64(K.mix64(x.astype(np.uint64)) + z.astype(np.uint64)) % U(buckets)).astype(np.int64)


def _edge_rows(edges: np.ndarray, buckets: int) -> list[tuple]:
    of = _pair_bucket(edges["x"], edges["z"], buckets)
    order = np.lexsort((edges["xc"], edges["z"], edges["x"], of))
    edges, of = edges[order], of[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else [0]
    return [(1, int(of[a]), int(b - a), squeeze([edges[a:b][name] for name in EDGE.names])) for a, b in zip(cuts[:-1], cuts[1:])]


def _packed(rows: list[tuple]) -> pa.Table:
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64()), "packed": pa.array([r[3] for r in rows], pa.binary())})


def _windows(buckets: int):
    def windows(batches):
        for batch in batches:
            data, off = K.text_buffer(batch.column("text"))
            ids = np.array(batch.column("node"))
            for i, j in K.slices(off, CHUNK_BYTES):
                parts = []
                for p, q in K.slices(off[i : j + 1]):
                    p, q = p + i, q + i
                    shingles, to = K.shingles_of(*K.words_of(data[off[p] : off[q]], off[p : q + 1] - off[p]), SHINGLE)
                    for band in range(BANDS):
                        name, doc, c, a, b = regions(shingles, to, band)
                        parts.append((name, ids[p:q][doc], c, a, b))
                name, doc, c, a, b = (np.concatenate(x) for x in zip(*parts))
                if not len(name):
                    continue
                edges, first = star(name, doc, c, a, b)
                of = (edges["k"] & U(0xFFFFFFFF)) % U(buckets)
                edges["k"] = (of << U(40)) | (edges["k"] >> U(24))
                rows = _edge_rows(edges, buckets)
                name, doc, c, a, b = (x[first] for x in (name, doc, c, a, b))
                of = ((name & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)
                order = np.lexsort((doc, of))
                of, name, doc, c, a, b = (x[order] for x in (of, name, doc, c, a, b))
                cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
                for p, q in zip(cuts[:-1], cuts[1:]):
                    columns = [np.frombuffer(K.pack_ints(name[p:q] >> U(24), KEY_BYTES), "V5"), doc[p:q].astype("<i8"), c[p:q].astype("<u4"), a[p:q].astype("u1"), b[p:q].astype("u1")]
                    rows.append((0, int(of[p]), int(q - p), squeeze(columns)))
                yield from _packed(rows).to_batches()

    return windows


def _join(buckets: int):
    def join(rows: pa.Table) -> pa.Table:
        if rows["kind"][0].as_py() == 1:
            return rows
        of = rows["bucket"][0].as_py()
        parts = [expand(p, n, _WINDOW_KINDS) for p, n in zip(rows["packed"].to_pylist(), rows["n"].to_pylist())]
        name, doc, c, a, b = (np.concatenate(x) for x in zip(*parts))
        edges, _ = star(K.unpack_ints(name.tobytes(), KEY_BYTES), doc, c.astype(np.int64), a, b)
        edges["k"] |= U(of) << U(40)
        return _packed(_edge_rows(edges, buckets))

    return join


def merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges within each group."""
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    top = int(hi.max()) + 2 if len(hi) else 1
    reach = np.maximum.accumulate(group * top + hi)
    new = np.r_[True, group[1:] * top + lo[1:] > reach[:-1] + 1] if len(lo) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return group[head], lo[head], reach[np.r_[head[1:] - 1, len(lo) - 1]] - group[head] * top if len(lo) else hi


def _edges(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    parts = [expand(p, n, _EDGE_KINDS) for p, n in zip(rows["packed"].to_pylist(), rows["n"].to_pylist())]
    e = np.zeros(sum(len(p[0]) for p in parts), EDGE)
    for name, column in zip(EDGE.names, zip(*parts)):
        e[name] = np.concatenate(column)
    return e


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's combination, and the first row of each."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    new[:1] = True
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


_ASKED = pa.schema([(n, pa.int64()) for n in ("x", "z", "d", "lo", "hi")])


def _stretches(x: np.ndarray, z: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """(x, z, d, lo, hi): unions of overlapping stretches of x on one diagonal d = place in z - place in x."""
    group, first = _numbered(x, z, d)
    group, lo, hi = merged(group, np.maximum(lo, 0), hi)
    of = first[group]
    return pa.table({"x": x[of], "z": z[of], "d": d[of].astype(np.int64), "lo": lo, "hi": hi}, schema=_ASKED)


def _meet(rows: pa.Table) -> pa.Table:
    """The stretches on which joined regions have windows side by side, or nearly."""
    e = _edges(rows)
    e = e[e["x"] != e["z"]]
    xa, xb, za, zb = (e[n].astype(np.int64) for n in ("xa", "xb", "za", "zb"))
    lo, hi = np.maximum(-xa, -za), np.minimum(-xb, -zb)
    near = hi - lo >= -DRIFT
    e, lo, hi = e[near], lo[near], hi[near]
    if not len(e):
        return _ASKED.empty_table()
    c = e["xc"].astype(np.int64)
    return _stretches(e["x"], e["z"], e["zc"].astype(np.int64) - c, c + np.minimum(lo, hi), c + np.maximum(lo, hi) + WINDOW - 1)


class _Block:
    """Shingles of a block's documents, made when first asked for."""

    def __init__(self, rows: pa.Table):
        self.data, self.off = K.text_buffer(rows["text"])
        self.row = {d: i for i, d in enumerate(rows["node"].to_pylist())}
        self.made: dict = {}

    def whole(self, node: int) -> np.ndarray:
        if node not in self.made:
            i = self.row[node]
            text = self.data[self.off[i] : self.off[i + 1]]
            self.made[node] = K.shingles_of(*K.words_of(text, np.array([0, len(text)])), SHINGLE)[0] >> U(24)
        return self.made[node]


_CUT = [("z", pa.int64()), ("piece", pa.int64()), ("shingles", pa.binary())]


def _cut(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """The wanted pieces of documents' shingles."""
    out = []
    if len(rows) and len(wanted):
        block = _Block(rows)
        for z, piece in zip(wanted["z"].to_pylist(), wanted["piece"].to_pylist()):
            out.append((z, piece, K.pack_ints(block.whole(z)[piece * PIECE : (piece + 1) * PIECE], HASH_BYTES)))
    return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(_CUT)})


#: No shingle is so large; what pads a first side equals nothing that pads a second.
_NONE, _PAD = U(2**63), U(2**62)


def passages_between(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) places of the passages in each row of x beside the same row of z, which has DRIFT places more on either side, so
    that place i of x is place i + DRIFT of z. From hit to hit, unions of windows that hold SHARED hits in both rows."""
    width = x.shape[1]
    if width < WINDOW or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    on_x, on_z = np.zeros(x.shape, bool), np.zeros(z.shape, bool)
    for shift in range(2 * DRIFT + 1):
        same = x == z[:, shift : shift + width]
        on_x |= same
        on_z[:, shift : shift + width] |= same
    total = [np.cumsum(np.pad(h, ((0, 0), (1, 0))), axis=1, dtype=np.int32) for h in (on_x, on_z[:, DRIFT : DRIFT + width])]
    row, at = np.nonzero(np.logical_and(*((t[:, WINDOW:] - t[:, :-WINDOW]) >= SHARED for t in total)))
    place = np.arange(width)
    after = np.minimum.accumulate(np.where(on_x, place, width)[:, ::-1], axis=1)[:, ::-1]
    before = np.maximum.accumulate(np.where(on_x, place, -1), axis=1)
    return merged(row, after[row, at], before[row, at + WINDOW - 1])


def _stacked(sides: list[np.ndarray], pad: np.uint64) -> np.ndarray:
    """Arrays as rows of one table."""
    size = np.array([len(a) for a in sides])
    out = np.full((len(sides), int(size.max())), pad)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(sides)
    return out


_LINK = [("bucket", pa.int64()), ("x", pa.int64()), ("z", pa.int64()), ("x_at", pa.list_(pa.int64())), ("z_at", pa.list_(pa.int64()))]


def _verify(buckets: int):
    """The passages of each pair: first and last shingle of each, in turn, in either document."""

    def verify(rows: pa.Table, met: pa.Table) -> pa.Table:
        out: dict = {}
        if len(rows) and len(met):
            _verified(rows, met, out)
        pairs = np.array([*out], np.int64).reshape(-1, 2)
        rows = [(int(k), *pair, *at) for k, (pair, at) in zip(_pair_bucket(*pairs.T, buckets), out.items())]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_LINK)})

    return verify


def _verified(rows: pa.Table, met: pa.Table, out: dict) -> None:
    block = _Block(rows)
    met = met.sort_by([(n, "ascending") for n in ("x", "z", "d", "lo", "piece")])
    x, z, d, lo, hi, piece = (np.array(met[n].combine_chunks()) for n in ("x", "z", "d", "lo", "hi", "piece"))
    raw, cuts = K.text_buffer(met["shingles"])
    raw, cuts = K.unpack_ints(raw.tobytes(), HASH_BYTES), cuts // HASH_BYTES
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (z[1:] != z[:-1]) | (d[1:] != d[:-1]) | (lo[1:] != lo[:-1])])
    ends = np.r_[new[1:], len(x)][: len(new)]
    length = hi[new] - lo[new] + 1
    # Stretches of like length are compared together.
    order = np.argsort(length, kind="stable")
    for i, j in K.slices(np.r_[0, np.cumsum(length[order])], 1 << 17):
        some = order[i:j]
        sides = []
        for k, n in zip(new[some].tolist(), ends[some].tolist()):
            ours = block.whole(int(x[k]))[lo[k] : hi[k] + 1]
            theirs = np.full(len(ours) + 2 * DRIFT, _NONE)
            have, base = raw[cuts[k] : cuts[n]], int(piece[k]) * PIECE - int(lo[k] + d[k]) + DRIFT
            a, b = max(base, 0), min(base + len(have), len(theirs))
            theirs[a:b] = have[a - base : b - base]
            sides.append((ours, theirs))
        for r, a, b in zip(*(v.tolist() for v in passages_between(_stacked([a for a, _ in sides], _PAD), _stacked([b for _, b in sides], _NONE)))):
            k = new[some[r]]
            on_x, on_z = out.setdefault((int(x[k]), int(z[k])), ([], []))
            on_x += (int(a + lo[k]), int(b + lo[k]))
            on_z += (int(a + lo[k] + d[k]), int(b + lo[k] + d[k]))


_REGION = pa.schema([("name", pa.int64()), ("node", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _members(batches):
    """The regions on either side of joined pairs, each once for a run of pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            e = _edges(batch.slice(i, 1))
            name = np.r_[e["k"], e["k"]].view(np.int64)
            node, c, a, b = (np.r_[e["x" + n], e["z" + n]].astype(np.int64) for n in ("", "c", "a", "b"))
            _, some = _numbered(name, node, c, a, b)
            name, node, c, a, b = (v[some] for v in (name, node, c, a, b))
            # Windows begin from c - a to c - b.
            yield pa.record_batch([name, node, c, c - a, c - b + WINDOW - 1], schema=_REGION)


def _filled(rows: pa.Table, some: pa.Table) -> pa.Table:
    """The regions with their shingles."""
    block = _Block(rows) if len(rows) and len(some) else None
    at = zip(*(some[n].to_pylist() for n in ("node", "lo", "hi")))
    return some.drop_columns(["block"]).append_column("shingles", pa.array([K.pack_ints(block.whole(node)[lo : hi + 1], HASH_BYTES) for node, lo, hi in at], pa.binary()))


def _likely(a: np.ndarray, held: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether a window of WINDOW of region x has LIKELY of its bytes in region z, for each pair."""
    there = np.zeros((len(x), 256), bool)
    there[np.nonzero(held[z])[0], a[z][held[z]]] = True
    hit = np.take_along_axis(there, a[x].astype(np.int64), axis=1) & held[x]
    total = np.zeros((len(x), a.shape[1] + 1), np.int16)
    np.cumsum(hit, axis=1, out=total[:, 1:])
    return (total[:, WINDOW:] - total[:, :-WINDOW]).max(axis=1) >= LIKELY


#: Regions stand in rows with their centre in column _CENTRE; none reaches further than WINDOW - 1 to either side.
_CENTRE = WINDOW - 1 + DRIFT
_WIDTH = 2 * _CENTRE + 1


def _side_by_side(a: np.ndarray, held: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether regions x and z, centre on centre, have windows of WINDOW that hold SHARED hits on both sides, for each pair."""
    core = slice(DRIFT, _WIDTH - DRIFT)
    ours, theirs = a[x], a[z]
    on_x, on_z = np.zeros(ours.shape, bool), np.zeros(ours.shape, bool)
    mine = held[x][:, core]
    for shift in range(2 * DRIFT + 1):
        at = slice(shift, shift + _WIDTH - 2 * DRIFT)
        same = (ours[:, core] == theirs[:, at]) & mine & held[z][:, at]
        on_x[:, core] |= same
        on_z[:, at] |= same
    total = [np.cumsum(np.pad(h, ((0, 0), (1, 0))), axis=1, dtype=np.int16) for h in (on_x, on_z)]
    return np.logical_and(*((t[:, WINDOW:] - t[:, :-WINDOW]) >= SHARED for t in total)).any(axis=1)


def _probes(often: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which places of each region, from its first on, are asked for: of any WINDOW in a row the MISSES + 1 least common, so that a window
    with SHARED hits has a hit among them."""
    asked = np.zeros(often.shape, bool)
    place = np.arange(WINDOW)
    for s in range(0, often.shape[1] - WINDOW + 1, STEP):
        # All windows that start from s to s + STEP - 1 hold the places of the first that are not before the last one's start.
        rows = np.flatnonzero(size >= s + WINDOW)
        inner = place >= np.minimum(STEP - 1, size[rows] - WINDOW - s)[:, None]
        rank = np.where(inner, often[rows, s : s + WINDOW] * WINDOW + place, np.iinfo(np.int64).max)
        asked[rows[:, None], s + np.argpartition(rank, MISSES, axis=1)[:, : MISSES + 1]] = True
    return asked


def _index(a: np.ndarray, held: np.ndarray, group: np.ndarray, first: np.ndarray, end: np.ndarray):
    """For each region how many candidates from ``first`` to before ``end`` it has, and a function that gives those of regions i to
    before j: all that hold one of its probes at most DRIFT places off, or the whole range, whichever is less to look at."""
    row, column = np.nonzero(held)
    key = group[row].astype(np.uint64) << U(8 * HASH_BYTES) | a[held]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    head, run = np.flatnonzero(new), np.zeros(len(key), np.int64)
    run[order] = np.cumsum(new) - 1
    size = held.sum(axis=1)
    start = np.r_[0, np.cumsum(size)[:-1]]
    often = np.zeros((len(size), int(size.max())), np.int64)
    often[np.arange(often.shape[1]) < size[:, None]] = np.diff(np.r_[head, len(key)])[run]
    ask = np.flatnonzero(_probes(often, size)[np.arange(often.shape[1]) < size[:, None]])
    # Who holds a shingle stands in order of regions.
    holder, place = row[order], column[order]
    lo = np.searchsorted(run[order] * len(size) + holder, run[ask] * len(size) + first[row[ask]])
    hi = np.searchsorted(run[order] * len(size) + holder, run[ask] * len(size) + end[row[ask]])
    asks = np.searchsorted(ask, np.r_[start, len(key)])
    found = np.diff(np.r_[0, np.cumsum(hi - lo)][asks])
    work = np.minimum(found, end - first)

    def candidates(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        plain = np.arange(i, j)[found[i:j] > work[i:j]]
        some = np.arange(asks[i], asks[j])
        some = some[found[row[ask[some]]] <= work[row[ask[some]]]]
        n = hi[some] - lo[some]
        x, at, of = np.repeat(row[ask[some]], n), np.repeat(column[ask[some]], n), K.ragged(lo[some], n)
        near = np.abs(place[of] - at) <= DRIFT
        n = end[plain] - first[plain]
        pair = np.unique(np.r_[x[near] * len(size) + holder[of[near]], np.repeat(plain, n) * len(size) + K.ragged(first[plain], n)])
        return pair // len(size), pair % len(size)

    return work, candidates


def _joins(rows: pa.Table) -> pa.Table:
    """Verified pairs of regions of one name, as many as join the components among a block's documents."""
    name, p, q, at, node, class_id, c, lo = (np.array(rows[n].combine_chunks()) for n in ("name", "p", "q", "at", "node", "class_id", "c", "lo"))
    order = np.lexsort((node, class_id, q, p, name))
    name, p, q, at, node, class_id, c, lo = (v[order] for v in (name, p, q, at, node, class_id, c, lo))
    data, off = K.text_buffer(rows["shingles"])
    size, first_ = np.diff(off)[order] // HASH_BYTES, off[:-1][order] // HASH_BYTES
    a = np.zeros((len(node), _WIDTH), np.uint64)
    column = np.arange(_WIDTH) - (_CENTRE - c + lo)[:, None]
    held = (column >= 0) & (column < size[:, None])
    a[held] = K.unpack_ints(data.tobytes(), HASH_BYTES)[K.ragged(first_, size)]
    small = a.astype(np.uint8)
    new = np.r_[True, (name[1:] != name[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    # Each region meets those of its name that are of earlier classes.
    own = new | np.r_[True, class_id[1:] != class_id[:-1]]
    first, end = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(own)[np.cumsum(own) - 1]
    work, candidates = _index(a, held, np.cumsum(new) - 1, first, end)
    out = []
    for i, j in K.slices(np.r_[0, np.cumsum(work)], 1 << 13):
        x, z = candidates(i, j)
        for k in range(0, len(x), 1 << 13):
            u, v = x[k : k + (1 << 13)], z[k : k + (1 << 13)]
            ok = (node[u] != node[v]) & (class_id[u] != class_id[v]) & ((p[u] == q[u]) | (at[u] != at[v]))
            u, v = u[ok], v[ok]
            for test, of in ((_likely, small), (_side_by_side, a)):
                if len(u):
                    ok = test(of, held, u, v)
                    u, v = u[ok], v[ok]
            for r, s in zip(u.tolist(), v.tolist()):
                if class_id[r] != class_id[s]:  # not joined meanwhile
                    old, least = max(class_id[r], class_id[s]), min(class_id[r], class_id[s])
                    class_id[class_id == old] = least
                    ours, theirs = np.where(held[r], a[r], _PAD)[None, DRIFT : _WIDTH - DRIFT], np.where(held[s], a[s], _NONE)[None]
                    _, lo_, hi_ = passages_between(ours, theirs)
                    found = np.stack([lo_, hi_], 1) - (WINDOW - 1)
                    out.append((0, int(node[r]), int(node[s]), (found + c[r]).ravel().tolist(), (found + c[s]).ravel().tolist()))
    return pa.table({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(_LINK)})


def passage_links(docs: DataFrame) -> DataFrame:
    """(a, b, a_at, b_at): documents a < b that share passages, and first and last word of each, in turn, in either document.

    Each document with a passage is linked to the first one that its regions met, and to others only where that leaves their groups
    apart, so that groups of documents stay connected.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    size = text_bytes(docs)
    blocks, buckets = buckets_for(size, BLOCK_BYTES), buckets_for(size, BUCKET_BYTES)
    node = F.xxhash64("doc_id", "text").alias("node")  # rows that share a doc_id have nodes of their own

    def block(of: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(of)), F.lit(blocks)).alias("block")

    packed, linked = "kind int, bucket long, n long, packed binary", "bucket long, x long, z long, x_at array<long>, z_at array<long>"
    rows = docs.select(node, "text")
    texts = rows.select(block("node"), "node", "text")
    edges = materialise(rows.mapInArrow(_windows(buckets), packed).groupBy("kind", "bucket").applyInArrow(_join(buckets), packed), "edges")

    asked = materialise(edges.groupBy("bucket").applyInArrow(_meet, "x long, z long, d long, lo long, hi long"), "asked")
    places = F.sequence(F.greatest(F.lit(0), F.expr(f"(lo + d - {DRIFT}) div {PIECE}")), F.greatest(F.lit(0), F.expr(f"(hi + d + {DRIFT}) div {PIECE}")))
    placed = asked.withColumn("piece", F.explode(places))
    wanted = placed.select("z", "piece").distinct().select(block("z"), "z", "piece")
    pieces = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_cut, "z long, piece long, shingles binary")
    met = placed.join(pieces.hint("merge"), ["z", "piece"]).select(block("x"), "x", "z", "d", "lo", "hi", "piece", "shingles")
    first = materialise(texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_verify(buckets), linked), "links")

    # All regions of the names whose documents the passages so far leave in several groups.
    members = edges.mapInArrow(_members, "name long, node long, c long, lo long, hi long").distinct()
    # A document's group is all that its links reach: what is joined by now is not compared again.
    groups = components(first, "x", "z").withColumnRenamed("node", "node_")
    members = materialise(members.join(groups, F.col("node") == F.col("node_"), "left").withColumn("class_id", F.coalesce("class_id", "node")).drop("node_"), "members")
    drop(edges, asked)
    spread = members.groupBy("name").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least <> most").select("name")
    placed = members.join(materialise(spread, "spread").hint("merge"), "name")
    filled = "name long, node long, class_id long, c long, lo long, hi long, shingles binary"
    mixed = texts.groupBy("block").cogroup(placed.select(block("node"), "name", "node", "class_id", "c", "lo", "hi").groupBy("block")).applyInArrow(_filled, filled)
    same = [F.xxhash64("shingles").alias("like"), (F.col("c") - F.col("lo")).alias("reach")]
    alike = materialise(mixed.groupBy("name", "class_id", *same).agg(F.min(F.struct("node", "c", "lo", "shingles")).alias("r")).select("name", "class_id", "r.*"), "alike")
    # A name's largest group meets all others, and not itself: its blocks come after theirs.
    sizes = alike.groupBy("name", "class_id").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("name").agg(F.sum("k").alias("n"), F.max("k").alias("k"), F.max_by("class_id", F.struct("k", "class_id")).alias("main"))
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    cut = alike.join(materialise(sizes, "sizes").hint("merge"), "name").withColumn("n", F.col("n") - F.col("k"))
    one, in_main = F.col("n") + F.col("k") <= BLOCK_ROWS, F.col("class_id") == F.col("main")
    cut = cut.withColumn("others", F.when(one, 1).otherwise(blocks_of("n"))).withColumn("blocks", F.when(one, 1).otherwise(F.col("others") + blocks_of("k")))
    at = F.when(in_main & ~one, F.col("others") + F.pmod(F.xxhash64("node"), F.col("blocks") - F.col("others"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    cut = cut.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("blocks")) - 1)))
    cut = cut.withColumn("p", F.least("at", "other")).withColumn("q", F.greatest("at", "other"))
    dealt = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("name"), F.lit(buckets))).otherwise(F.xxhash64("name", "p", "q")).alias("bucket")
    more = materialise(cut.select(dealt, "name", "p", "q", "at", "node", "class_id", "c", "lo", "shingles").groupBy("bucket").applyInArrow(_joins, linked), "links")
    drop(members, alike)

    names = docs.select(node, "doc_id").distinct()
    sides = [names.withColumnsRenamed({"node": n, "doc_id": f"{n}_id"}) for n in "xz"]
    links = first.unionByName(more).join(sides[0], "x").join(sides[1], "z").where("x_id <> z_id")
    links = links.select(F.when(F.col("x_id") < F.col("z_id"), F.struct(F.col("x_id").alias("a"), F.col("z_id").alias("b"), F.col("x_at").alias("a_at"), F.col("z_at").alias("b_at"))).otherwise(F.struct(F.col("z_id").alias("a"), F.col("x_id").alias("b"), F.col("z_at").alias("a_at"), F.col("x_at").alias("b_at"))).alias("l")).select("l.*")
    # A stretch of shingles ends SHINGLE - 1 words after its last one begins.
    words = {c: F.transform(F.flatten(F.collect_list(c)), lambda v, i: v + F.when(i % 2 == 1, SHINGLE - 1).otherwise(0)).alias(c) for c in ("a_at", "b_at")}
    return materialise(links.groupBy("a", "b").agg(*words.values()), "passages")


def passage_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group; its own if it shares nothing), n_links, and first_word and last_word: where the
    passages of its links begin and end (null without)."""
    links = passage_links(docs)
    groups = components(links)
    sides = links.select(F.col("a").alias("doc_id"), F.array_min("a_at").alias("lo"), F.array_max("a_at").alias("hi")).unionByName(links.select(F.col("b").alias("doc_id"), F.array_min("b_at").alias("lo"), F.array_max("b_at").alias("hi")))
    counts = sides.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"))
    known = groups.withColumnRenamed("node", "doc_id").join(counts, "doc_id", "left")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_word", "last_word")
