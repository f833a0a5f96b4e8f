"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The segmentations of a text are the leaves of a tree; a node fixes the last pieces of the text, and its log-probability is exact,
from forward sums over the lattice. Each node has a Gumbel variate that is the maximum of its leaves', so the best-first
(A-star) search over perturbed nodes has a tight bound and pops leaves in falling order: the k largest of all leaves' independent
Gumbel-perturbed log-probabilities, that is, k distinct segmentations drawn without replacement. Going down from a node, the child that
keeps the node's variate is drawn by its probability; the others get Gumbel variates truncated there.

Many texts are searched at once: their lattices are shared by distinct unit, and going down is a numpy step for all of them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import give_back, small_batches

#: Texts of about so many characters are searched together.
TOGETHER = 200_000
#: Units that a task keeps the lattice of.
KEPT = 15_000
#: No variate from 53-bit random numbers exceeds its location by more.
HIGHEST = 37.0
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In (0, 1), by a row's key and a place."""
    return ((_mix(key + at.astype(np.uint64) * _GOLDEN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@functools.cache
def _model(path: str, alpha: float):
    logp, byte = pieces.rank_log_probs(path, alpha)
    return _prefixes(path), logp.astype(np.float64), byte


@functools.cache
def _prefixes(path: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """The vocabulary's prefixes by length: the number of each first character, the sorted (prefix, next character) keys with the
    numbers they lead to, and by length and number the piece that ends there (-1: none)."""
    v = pieces.load(path)
    level: dict[str, int] = {"": 0}
    steps, ending, first = [], [], np.full(0x110000, -1, np.int32)
    for length in range(1, max(len(v.texts[i]) for i in v.matched) + 1):
        heads = sorted({v.texts[i][:length] for i in v.matched.tolist() if len(v.texts[i]) >= length})
        number = {h: n for n, h in enumerate(heads)}
        key = np.array([level[h[:-1]] << 21 | ord(h[-1]) for h in heads], np.int64)
        order = np.argsort(key)
        steps.append((key[order], np.arange(len(heads), dtype=np.int32)[order]))
        if length == 1:
            first[[ord(h) for h in heads]] = np.arange(len(heads))
        ending.append(np.full(len(heads), -1, np.int32))
        level = number
        for i in v.matched.tolist():
            if len(v.texts[i]) == length:
                ending[-1][number[v.texts[i]]] = i
    return first, steps, ending


def _matches(code: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, length and piece of every occurrence in the text, by end and then by falling length: all places go down the prefixes together."""
    first, steps, ending = _prefixes(path)
    at, state = np.arange(len(code)), first[code]
    ends, lengths, found = [], [], []
    for depth, (keys, to) in enumerate(steps, 1):
        if depth > 1:
            inside = at + depth <= len(code)
            at, state = at[inside], state[inside]
            key = state.astype(np.int64) << 21 | code[at + depth - 1]
            place = np.searchsorted(keys, key)
            place[place == len(keys)] = 0
            live = keys[place] == key
            at, state = at[live], to[place[live]]
        else:
            live = state >= 0
            at, state = at[live], state[live]
        if not len(at):
            break
        piece = ending[depth - 1][state]
        hit = piece >= 0
        ends.append(at[hit] + depth)
        lengths.append(np.full(int(hit.sum()), depth))
        found.append(piece[hit])
    if not ends:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32)
    end = np.concatenate(ends[::-1])
    order = np.argsort(end, kind="stable")
    return end[order], np.concatenate(lengths[::-1])[order], np.concatenate(found[::-1])[order]


@dataclass
class Lattice:
    """Edges of all distinct units, grouped by the node they end at; unit u has the nodes begin[u] to end[u]."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # by node, its first edge; first[node + 1] follows its last
    to: np.ndarray
    start: np.ndarray
    piece: np.ndarray  # -1 - code point for a character that no piece covers
    logq: np.ndarray  # of the edge, given the node it ends at
    upto: np.ndarray  # running sum of exp(logq) at the node


def build(words: list[str], path: str, alpha: float) -> Lattice:
    _, logp, byte = _model(path, alpha)
    text = "\n".join(words)  # no piece has a line end
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    nodes = len(text) + 1
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    to, length, piece = _matches(code, path)
    alone = np.ones(nodes - 1, bool)
    alone[to[length == 1] - 1] = False
    alone[end[:-1]] = False
    extra = np.flatnonzero(alone)
    width = 1 + (code[extra] > 0x7F) + (code[extra] > 0x7FF) + (code[extra] > 0xFFFF)
    at = np.searchsorted(to, extra + 1, side="right")
    to, start = np.insert(to, at, extra + 1).astype(np.int32), np.insert(to - length, at, extra).astype(np.int32)
    weight = np.insert(logp[piece], at, byte * width)
    piece = np.insert(piece, at, (-1 - code[extra]).astype(np.int32))
    # forward sums, all units by one position at a time
    level = to - np.repeat(begin, size + 1)[:nodes][to]
    order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(1, level.max(initial=0) + 2))
    alpha_, o_to, o_start, o_w = np.zeros(nodes), to[order], start[order], weight[order]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            continue
        v, t = o_w[a:b] + alpha_[o_start[a:b]], o_to[a:b]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        most = np.maximum.reduceat(v, head)
        alpha_[t[head]] = most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, np.diff(np.r_[head, b - a]))), head))
    logq = weight + alpha_[start] - alpha_[to]
    first = np.r_[0, np.cumsum(np.bincount(to, minlength=nodes))]
    upto, number = np.exp(logq), np.diff(first)
    at = first[:-1][number > 1]
    last = first[1:][number > 1] - 1
    while at.size:  # node by node, so that a sum doesn't depend on what else is searched
        upto[at + 1] += upto[at]
        at, last = (at + 1)[at + 1 < last], last[at + 1 < last]
    upto[first[1:][number > 0] - 1] = np.inf  # the last edge takes what rounding left
    return Lattice(begin, end, first, to, start, piece, logq, upto)


def _joined(one: Lattice, two: Lattice) -> Lattice:
    """Both lattices' units, those of one first."""
    nodes, edges = len(one.first) - 1, len(one.to)
    shifted = {"begin": nodes, "end": nodes, "to": np.int32(nodes), "start": np.int32(nodes)}  # fewer than 2**31 nodes: a text has fewer characters
    parts = {f: np.concatenate([getattr(one, f), getattr(two, f) + shifted.get(f, 0)]) for f in ("begin", "end", "to", "start", "piece", "logq", "upto")}
    return Lattice(first=np.concatenate([one.first[:-1], two.first + edges]), **parts)


class Lattices:
    """The units of one batch after another; units that come again are kept, up to a bound on memory, the others are built for their batch."""

    def __init__(self, path: str, alpha: float):
        self.path, self.alpha = path, alpha
        self.kept: dict[str, int] = {}
        self.lattice: Lattice | None = None
        self.met: set[str] = set()
        self.again: dict[str, None] = {}

    def of(self, units: list[str]) -> tuple[Lattice, np.ndarray]:
        """The lattice, and the number in it of each unit."""
        number = np.fromiter(map(self.kept.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return self.lattice, number
        words = [units[i] for i in missing.tolist()]
        fresh = dict.fromkeys(words)
        fresh = dict(zip(fresh, range(len(self.kept), len(self.kept) + len(fresh)), strict=True))
        number[missing] = np.fromiter(map(fresh.__getitem__, words), np.int64, len(words))
        new = build([pieces.SPACE + u for u in fresh], self.path, self.alpha)
        lattice = _joined(self.lattice, new) if self.lattice else new
        if len(self.kept) < KEPT:
            self.again.update(dict.fromkeys(u for u in fresh if u in self.met and len(u) <= 32))
            if len(self.met) > 4 * KEPT:
                self.met.clear()
            self.met.update(fresh)
            if len(self.again) >= 5_000:
                new = build([pieces.SPACE + u for u in self.again], self.path, self.alpha)
                self.kept |= dict(zip(self.again, range(len(self.kept), len(self.kept) + len(self.again)), strict=True))
                self.lattice = _joined(self.lattice, new) if self.lattice else new
                self.met.difference_update(self.again)
                self.again = {}
        return lattice, number


def _descend(lat: Lattice, node: np.ndarray, stop: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws edges from each node down to stop; at: the random place of stop. Gives the edges of all walks one after another, and each walk's number of edges."""
    live, edges, owners = np.flatnonzero(node > stop), [], []
    cur, low, key, place = node[live], stop[live], key[live], at[live]
    while live.size:
        u = _uniform(key, place + (cur - low))
        e = lat.first[cur]
        more = np.flatnonzero(u > lat.upto[e])
        while more.size:
            e[more] += 1
            more = more[u[more] > lat.upto[e[more]]]
        edges.append(e)
        owners.append(live)
        cur = lat.start[e]
        go = cur > low
        if not go.all():
            live, cur, low, key, place = live[go], cur[go], low[go], key[go], place[go]
    if not edges:
        return np.zeros(0, np.int64), np.zeros(len(node), np.int64)
    owner = np.concatenate(owners)
    number = np.bincount(owner, minlength=len(node))
    base, out = np.cumsum(number) - number, np.empty(len(owner), np.int64)
    for step, (e, o) in enumerate(zip(edges, owners, strict=True)):
        out[base[o] + step] = e
    return out, number


@dataclass
class Sample:
    """edges: from the text's end to its beginning; upto: number of edges at the end of each unit, in that order."""

    edges: np.ndarray
    upto: np.ndarray
    log_prob: float
    gumbel: float


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates of a location, given that they are below a bound."""
    return location - np.log(np.exp(location - bound) - np.log(u))


def _offer(lat: Lattice, heaps: list[list[tuple]], ds: list[int], turn: int, wanted: int, edges: np.ndarray, begins: np.ndarray, ends: np.ndarray, lp: np.ndarray, gumbel: np.ndarray, first_depth: np.ndarray, key: np.ndarray) -> None:
    """Puts what branches off the walked paths on their texts' heaps, as far down as one of the wanted best can be.

    All branches at a node stand as one, with the greatest of their variates; which branch has it is drawn when it is taken up.
    """
    logq = lat.logq[edges]
    run = np.r_[0.0, np.cumsum(logq)]
    open_, a, b = np.arange(len(ds)), 0, 256
    while open_.size:
        lo, hi = begins[open_] + a, np.minimum(begins[open_] + b, ends[open_])
        n = np.maximum(hi - lo, 0)
        of = np.repeat(open_, n)
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        off = -np.expm1(logq[at])
        some = off > 1e-300
        at, of, off = at[some], of[some], off[some]
        if len(at):
            depth = first_depth[of] + at - begins[of]
            value = _truncated(lp[of] + run[at] - run[begins[of]] + np.log(off), gumbel[of], _uniform(key[of], (depth << 16) + (1 << 60)))
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            width = np.diff(np.r_[heads, len(of)])
            for _ in range(wanted):
                most = np.maximum.reduceat(value, heads)
                best = np.flatnonzero((value == np.repeat(most, width)) & (value > -np.inf))
                for o, d, v, e in zip(of[best].tolist(), depth[best].tolist(), value[best].tolist(), edges[at[best]].tolist(), strict=True):
                    heapq.heappush(heaps[ds[o]], (-v, turn, d, (e,)))
                value[best] = -np.inf
        reached = (lp[open_] + run[np.minimum(begins[open_] + b, ends[open_])] - run[begins[open_]]).tolist()
        more = (begins[open_] + b < ends[open_]).tolist()
        keep = [i for i, o in enumerate(open_.tolist()) if more[i] and not (len(heaps[ds[o]]) >= wanted and reached[i] + HIGHEST < -heapq.nsmallest(wanted, heaps[ds[o]])[-1][0])]
        open_, a, b = open_[keep], b, b * 4


def _take(lat: Lattice, heap: list[tuple], samples: list[Sample], key: np.ndarray) -> tuple[float, Sample, int, int, float]:
    """The best branch: its variate, the sample it leaves, the depth, its edge and the log-probability upto it. The node's other branches go back."""
    v, of, depth, gone = heapq.heappop(heap)
    old = samples[of]
    node = int(lat.to[gone[0]])
    lo, hi = int(lat.first[node]), int(lat.first[node + 1])
    weight = np.exp(lat.logq[lo:hi])
    weight[[e - lo for e in gone]] = 0.0
    run = np.cumsum(weight)
    place = np.array([(depth << 16) + len(gone)])
    j = min(int(np.searchsorted(run, _uniform(key, place + (1 << 61))[0] * run[-1], side="right")), hi - lo - 1)
    while not weight[j]:
        j -= 1
    prior = float(lat.logq[old.edges[:depth]].sum())
    weight[j] = 0.0
    left = float(weight.sum())
    if left > 1e-300:
        again = _truncated(np.array([prior + math.log(left)]), np.array([-v]), _uniform(key, place + (1 << 62)))
        heapq.heappush(heap, (-float(again[0]), of, depth, (*gone, lo + j)))
    return -v, old, depth, lo + j, prior + float(lat.logq[lo + j])


def search(keys: np.ndarray, texts: list[str], k: int, lattices: Lattices) -> tuple[Lattice | None, list[list[Sample]], list[float]]:
    """Of each text its k best samples, best first, and the variate of the one after (-inf where there is none)."""
    spread = [pieces.units(t)[::-1] for t in texts]
    if not any(spread):
        return None, [[] for _ in texts], [-math.inf] * len(texts)
    lat, unit = lattices.of(list(itertools.chain.from_iterable(spread)))
    number = np.fromiter(map(len, spread), np.int64, len(texts))
    head = np.cumsum(number) - number
    size = lat.end[unit] - lat.begin[unit] + 1
    place = np.cumsum(size) - size
    place -= np.repeat(np.r_[place, 0][head], number)  # of a unit: its distance from the text's end
    doc = np.repeat(np.arange(len(texts)), number)
    samples: list[list[Sample]] = [[] for _ in texts]
    heaps: list[list[tuple]] = [[] for _ in texts]
    rest = [-math.inf] * len(texts)
    root = (-np.log(-np.log(_uniform(keys, np.full(len(texts), 1 << 50))))).tolist()
    none = np.zeros(0, np.int64)
    turn_keys = [_mix(keys + _mix(np.full(1, t + 1, np.uint64))) for t in range(k)]
    # to walk down next: text, variate, edges so far, their units' ends, their log-probability, unit to go on in, node (-1: its end)
    chosen = [(d, root[d], none, none, 0.0, 0, -1) for d in range(len(texts)) if number[d]]
    for turn in range(k):
        if not chosen:
            break
        ds = [c[0] for c in chosen]
        salt = turn_keys[turn][ds]
        frm = head[ds] + np.array([c[5] for c in chosen])
        left = head[ds] + number[ds] - frm
        starts = np.cumsum(left) - left
        occ = np.repeat(frm - starts, left) + np.arange(int(left.sum()))
        node, inside = lat.end[unit[occ]], np.array([c[6] for c in chosen])
        node[starts[inside >= 0]] = inside[inside >= 0]
        edges, per = _descend(lat, node, lat.begin[unit[occ]], np.repeat(salt, left), place[occ])
        upto = np.r_[0, np.cumsum(per)]
        begins, ends = upto[starts], upto[starts + left]
        for i, (d, g, before, units_before, lp, _, _) in enumerate(chosen):
            new = edges[begins[i] : ends[i]]
            whole = np.concatenate([before, new])
            marks = np.concatenate([units_before, len(before) + upto[starts[i] + 1 : starts[i] + left[i] + 1] - begins[i]])
            samples[d].append(Sample(whole, marks, lp + float(lat.logq[new].sum()), g))
        _offer(lat, heaps, ds, turn, k - turn, edges, begins, ends, np.array([c[4] for c in chosen]), np.array([c[1] for c in chosen]), np.array([len(c[2]) for c in chosen]), salt)
        chosen = []
        for d in ds:
            if turn + 1 == k:
                rest[d] = -heaps[d][0][0] if heaps[d] else -math.inf
            elif heaps[d]:
                branch = turn_keys[heaps[d][0][1]][d : d + 1]
                g, old, depth, edge, phi = _take(lat, heaps[d], samples[d], branch)
                at = int(np.searchsorted(old.upto, depth, side="right"))
                chosen.append((d, g, np.r_[old.edges[:depth], edge], old.upto[:at], phi, at, int(lat.start[edge])))
    return lat, samples, rest


def _ids(lat: Lattice, edges: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
    """Piece ids in text order; what no piece covers becomes byte pieces."""
    p = lat.piece[edges[::-1]]
    plain = (p < 0) & (p >= -128)
    p[plain] = byte_ids[-1 - p[plain]]
    for i in np.flatnonzero(p < 0)[::-1].tolist():
        p = np.concatenate([p[:i], byte_ids[list(chr(-1 - int(p[i])).encode())], p[i + 1 :]])
    return p.astype(np.int32)


@functools.cache
def _surfaces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces one after another, where each begins and how many it has."""
    v = pieces.load(path)
    out = [t.replace(pieces.SPACE, " ").encode() for t in v.texts]
    for b, i in enumerate(v.byte_ids.tolist()):
        out[i] = bytes([b])
    size = np.array([len(x) for x in out])
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum(size) - size, size


def decode(ids: np.ndarray, path: str) -> str:
    """The text of a sequence of piece ids; bytes that aren't UTF-8 become U+FFFD."""
    flat, begin, size = _surfaces(path)
    n = size[ids]
    upto = np.cumsum(n)
    at = np.arange(int(upto[-1]) if len(n) else 0) + np.repeat(begin[ids] - (upto - n), n)
    text = flat[at].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _keys(values: list, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(str(v), seed) for v in values), np.uint64, len(values))


def sample_texts(keys: np.ndarray, texts: list[str], k: int, path: str, alpha: float, lattices: Lattices | None = None) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(index of the text, number of the sample from 1, ids, log-probability, variate, inclusion probability), lazily. lattices: what earlier calls have left."""
    byte_ids, lattices = pieces.load(path).byte_ids, lattices or Lattices(path, alpha)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= TOGETHER):
            size += len(texts[b])
            b += 1
        lat, found, rest = search(keys[a:b], texts[a:b], k, lattices)
        for d, of in enumerate(found):
            if not of:
                yield a + d, 1, np.zeros(0, np.int32), 0.0, 0.0, 1.0
            for n, s in enumerate(of):
                kept = 1.0 if rest[d] == -math.inf else -math.expm1(-math.exp(min(s.log_prob - rest[d], 700.0)))
                yield a + d, n + 1, _ids(lat, s.edges, byte_ids), s.log_prob, s.gumbel, kept
        a = b


def sample_encode(docs: DataFrame, k: int, *, model: str | None = None, alpha: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row of docs and sample: doc_id, sample (1 to k, by falling variate), ids, log_prob, gumbel and inclusion.

    A text's lattice holds every piece of the vocabulary that occurs in it; a piece has a probability by its place among the
    scores (pieces.rank_log_probs). log_prob is the segmentation's, normalised over all segmentations of the text. inclusion is
    the probability that a segmentation of this log_prob is among the k, given the next variate; 1 where a text has no more than
    k segmentations. Rows that repeat an id and text get equal samples, whatever the partitioning. A null or empty text has the one
    empty segmentation. A null id seeds as "None". Other columns are ignored. Whole texts are segmented.

    digest: n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and decoded_sha256 in place of ids.
    No shuffle. A task holds the lattice of about 200,000 characters at once, or of one text where that is longer.
    """
    path = model or pieces.default_model()
    small_batches(docs.sparkSession, 500)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    own = "n_pieces int, ids_crc32 long, decoded_sha256 string" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(path, alpha)  # goes with the task: the worker process serves other tasks afterwards
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at, sample, got, scores = [], [], [], []
            for d, n, out, *s in sample_texts(_keys(ids.to_pylist(), seed), texts, k, path, alpha, lattices):
                at.append(d)
                sample.append(n)
                scores.append(s)
                got.append((len(out), zlib.crc32(out.astype("<i4").tobytes()), hashlib.sha256(decode(out, path).encode()).hexdigest()) if digest else out)
            columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)] if digest and got else [pa.array(got, pa.list_(pa.int32()))] if not digest else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.string())]
            floats = [pa.array([s[i] for s in scores], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(sample, pa.int32()), *columns, *floats], ["doc_id", "sample", *[c.split()[0] for c in own.split(", ")], "log_prob", "gumbel", "inclusion"])
            del texts, at, sample, got, scores, columns, floats
            give_back(collect=False)
        del lattices
        give_back()

    return src.mapInArrow(run, f"doc_id {kind}, sample int, {own}, log_prob double, gumbel double, inclusion double")


def decode_ids(encoded: DataFrame, *, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of the ids; null where ids is null."""
    path = model or pieces.default_model()

    @F.pandas_udf("string")
    def decoded(ids):
        return ids.map(lambda x: None if x is None else decode(np.asarray(x), path))

    return encoded.withColumn("decoded", decoded(F.col(ids_col)))
