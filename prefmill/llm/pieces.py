"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's segmentations form a lattice whose arcs are vocabulary pieces; a path's
probability is the product of its pieces' weights over the sum of all paths.
Drawing the ``k`` largest of (log probability + Gumbel noise) gives ``k`` distinct
segmentations without replacement. The noise is not drawn per path: a best-first
search keeps, per partial path, the largest perturbed value below it, sampled
top down. In units of ``t = exp(-value)`` this is short: the best leaf has
``t ~ Exp(1)``; what lies beside a partial path with probability mass ``m`` comes
``Exp(1) / m`` later than the node it leaves. Popping the earliest node and
following its best child to the end gives the next sample, exactly.

Weights: a piece of rank r in the vocabulary (its BPE order) has 1 / (r + 2); a
character without a piece of its own is spelled in byte pieces. Spaces become
U+2581 with one put in front; a U+2581 of the text itself is spelled in bytes, so
decoding gives the text back in every case.

All random numbers are hashes of (seed, row key, sample, place): a rerun or
another partitioning gives the same rows. Null texts count as empty; an empty
text has one segmentation of no pieces. Texts with fewer than ``k``
segmentations give fewer rows. A null key is hashed as a fixed number; rows with
equal keys and texts get equal samples. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import mix, new_run, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = """doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double,
    log_inclusion double, decoded boolean"""
SPACE, LITERAL, NEWLINE = 0x2581, 0x110001, 10
BATCH_CHARS = 1 << 19
# What leaves a path after its first NEAR arcs, where the mass is below exp(-FAR), comes after exp(FAR - 38) at the
# earliest, as 53 bits give no shorter wait; it is looked at only if that could be among the first.
NEAR, FAR = 128, 60.0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_NULL_KEY = 0x7FFFFFFFFFFFFFFF


class Vocabulary:
    """Pieces as a trie whose steps are looked up for many places at once."""

    def __init__(self, pieces: list[str], ranks: list[float]):
        self.first_byte = pieces.index("<0x00>")
        normal = range(self.first_byte + 256, len(pieces))
        nodes, steps = {"": 0}, {}
        for p in (pieces[i] for i in normal):
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    steps[nodes[p[:n - 1]] << 21 | ord(p[n - 1])] = nodes[p[:n]]
        self.slots, self.next = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, np.int64)
        for key, node in steps.items():
            slot = int(self._slot(np.array([key], np.int64))[0])
            while self.slots[slot] >= 0:
                slot = (slot + 1) & ((1 << 20) - 1)
            self.slots[slot], self.next[slot] = key, node
        self.piece_at = np.full(len(nodes), -1, np.int64)
        for i in normal:
            self.piece_at[nodes[pieces[i]]] = i
        self.log_weight = np.full(len(pieces), -math.log(len(pieces)) - 2)
        for i in normal:
            self.log_weight[i] = -math.log(ranks[i] + 2)
        self.longest = max(len(pieces[i]) for i in normal)
        spelled = [bytes([i - self.first_byte]) if self.first_byte <= i < self.first_byte + 256 else
                   pieces[i].replace("▁", " ").encode() for i in range(len(pieces))]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MUL) >> np.uint64(44)).astype(np.int64)

    def step(self, key: np.ndarray) -> np.ndarray:
        """The node a (node, character) leads to, or -1: a hash table probed for all at once."""
        slot = self._slot(key)
        found = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            here = self.slots[slot]
            hit = here == key
            found[open_[hit]] = self.next[slot[hit]]
            on = ~hit & (here >= 0)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & ((1 << 20) - 1)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces, without the space put in front."""
        return self.blob[ranges(self.start[ids], self.size[ids])].tobytes()[1:]

    def arcs(self, cp: np.ndarray, end: np.ndarray):
        """(start, end, piece) of all pieces in the units; -1 for a character to be spelled in bytes."""
        n = len(cp)
        at, state, length = np.arange(n, dtype=np.int32), np.zeros(n, np.int64), 0
        single = np.zeros(n, bool)
        found = []
        while len(at) and length < self.longest:
            state = self.step(state << 21 | cp[at + length])
            ok = state >= 0
            at, state, length = at[ok], state[ok], length + 1
            piece = self.piece_at[state]
            full = piece >= 0
            found.append((at[full], at[full] + length, piece[full]))
            if length == 1:
                single[at[full]] = True
            more = at + length < end[at]
            at, state = at[more], state[more]
        odd = np.flatnonzero(~single).astype(np.int32)
        found.append((odd, odd + 1, np.full(len(odd), -1)))
        return tuple(np.concatenate(c) for c in zip(*found))


class Lattice:
    """All distinct units of a batch, with the conditional probability of every arc."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.v = vocabulary
        joined = "".join([" " + t for t in texts])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        cp = np.where(cp == SPACE, LITERAL, np.where(cp == 32, SPACE, cp))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        doc_at = np.cumsum(sizes) - sizes
        space, line = cp == SPACE, cp == NEWLINE
        begins = np.zeros(len(cp), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begins[doc_at] = True
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(cp)))
        self.doc_word = np.searchsorted(at, np.append(doc_at, len(cp)))  # first word of each document
        unit, rep = self._distinct(cp, at, size)
        r_at, r_size = at[rep], size[rep]
        self.cp = cp[ranges(r_at, r_size)]
        last = np.cumsum(r_size)
        self.word_start, self.word_end = (last - r_size)[unit], last[unit]
        self._weigh(np.repeat(last, r_size))

    @staticmethod
    def _distinct(cp, at, size):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95 | 1, np.uint64))
            inside = np.arange(len(cp)) - np.repeat(at, size)
            h = np.add.reduceat(mix(cp.astype(np.uint64) + np.uint64(1)) * power[inside], at)
        _, rep, unit = np.unique(mix(h ^ size.astype(np.uint64)), return_index=True, return_inverse=True)
        same = (size[rep][unit] == size).all() and (cp[ranges(at[rep][unit], size)] == cp).all()
        return (unit, rep) if same else (np.arange(len(at)), np.arange(len(at)))

    def _weigh(self, end):
        """Backward sums over each unit, then arcs sorted by start with running probabilities."""
        start, stop, piece = self.v.arcs(self.cp, end)
        order = np.argsort(start, kind="stable")  # runs by piece length: merged
        start, stop, piece = start[order], stop[order], piece[order]
        self.arc_start, self.arc_end, self.piece = start, stop, piece
        weight = np.where(piece >= 0, self.v.log_weight[piece], self.v.log_weight[self.v.first_byte] * 3)
        left = end[start] - start
        small = len(left) and left.max() < 1 << 16  # sorted by radix
        order = np.argsort(left.astype(np.uint16) if small else left, kind="stable")
        o_start, o_weight, o_left = start[order], weight[order], left[order]
        o_stop = np.where(stop[order] == o_start + o_left, len(self.cp), stop[order])  # a unit's end is one place
        first = np.flatnonzero(new_run(o_start))  # first arc of each place, by the place's distance to the end
        place = o_start[first]
        count = np.diff(np.append(first, len(order)))
        steps = np.append(np.flatnonzero(new_run(o_left[first])), len(first)).tolist() if len(first) else [0]
        bounds = np.append(first, len(order))[steps].tolist()
        beta = np.zeros(len(self.cp) + 1)
        for a, b, lo, hi in zip(steps[:-1], steps[1:], bounds[:-1], bounds[1:]):  # one character from the end first, then two ...
            value = o_weight[lo:hi] + beta[o_stop[lo:hi]]
            o_weight[lo:hi] = value
            begin = first[a:b] - lo
            top = np.maximum.reduceat(value, begin)
            beta[place[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[a:b])), begin))
        total = np.empty(len(start))
        total[order] = o_weight
        self.node_arc = np.zeros(len(self.cp) + 1, np.int64)  # first arc of each place
        np.cumsum(np.bincount(start, minlength=len(self.cp)), out=self.node_arc[1:])
        total -= beta[start]
        self.logq = np.minimum(total, 0.0)
        q = np.exp(self.logq)
        run = np.cumsum(q)
        first = self.node_arc[:-1]
        inside = run - np.repeat(run[first] - q[first], np.diff(self.node_arc))
        inside[self.node_arc[1:] - 1] = 2.0
        self.reach = inside
        odd = np.flatnonzero(self.piece < 0)
        chars, which = np.unique(self.cp[self.arc_start[odd]], return_inverse=True)
        in_bytes = [list(chr(SPACE if c == LITERAL else c).encode()) for c in chars.tolist()]
        sizes = np.array([len(b) for b in in_bytes], np.int64)
        self.spelled = np.append(self.piece, np.array([self.v.first_byte + x for b in in_bytes for x in b], np.int64))
        self.spell_at, self.spell_size = np.arange(len(self.piece)), np.ones(len(self.piece), np.int64)
        self.spell_at[odd] = len(self.piece) + (np.cumsum(sizes) - sizes)[which]
        self.spell_size[odd] = sizes[which]

    def walk(self, word, cur, key):
        """Follow random arcs from place ``cur`` to the end of each word; arcs in the order of the words given."""
        end, rows, steps = self.word_end[word], np.arange(len(word)), []
        count = np.zeros(len(word), np.int64)
        while len(rows):
            u = (mix(key[rows] + np.uint64(len(steps) + 1) * _MUL) >> np.uint64(32)).astype(np.float64) / 2.0**32
            arc = self.node_arc[cur]
            past = np.flatnonzero(self.reach[arc] <= u)
            while len(past):
                arc[past] += 1
                past = past[self.reach[arc[past]] <= u[past]]
            steps.append((rows, arc))
            count[rows] += 1
            cur = self.arc_end[arc]
            on = cur < end[rows]
            rows, cur = rows[on], cur[on]
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for s, (rows, arc) in enumerate(steps):
            out[offset[rows] + s] = arc
        return out, np.append(offset, len(out))

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        return self.spelled[ranges(self.spell_at[arcs], self.spell_size[arcs])]


def _draw(*parts: int) -> float:
    """A uniform number in (0, 1) from integers."""
    h = 0
    for p in parts:
        h = ((h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 32
    h = (h * 0xC4CEB9FE1A85EC53) & 0xFFFFFFFFFFFFFFFF
    return ((h >> 11) + 0.5) / 2.0**53


def _arrivals(key: int, r: int, fresh: np.ndarray, before: np.ndarray, logq: np.ndarray, time: float) -> np.ndarray:
    """When the rest beside each arc ``fresh`` of a path comes."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        beside = before[fresh] + np.log(-np.expm1(logq[fresh]))
        noise = mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + (fresh + (r + 1) * (1 << 40)).astype(np.uint64) * _MUL)
        wait = -np.log(((noise >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        arrival = time + np.exp(np.minimum(np.log(wait) - beside, 700.0))
        arrival[~np.isfinite(beside)] = np.inf
    return arrival


def sample_batch(v: Vocabulary, keys: list[int], texts: list[str], k: int):
    """Per text a list of (ids, log probability, t) by rising t, and the t of the first sample not taken."""
    lattice = Lattice(v, texts)
    n = len(texts)
    heaps = [[] for _ in range(n)]
    taken: list[list] = [[] for _ in range(n)]
    key64 = mix(np.array(keys, np.uint64))
    everything = np.arange(n)
    word = np.arange(lattice.doc_word[-1])
    doc = np.repeat(everything, np.diff(lattice.doc_word))
    head: list = [np.zeros(0, np.int64)] * n
    times = [-math.log(_draw(x, 1)) for x in keys]
    cur, live = lattice.word_start[word], everything
    for r in range(k):
        with np.errstate(over="ignore"):
            local = (word - lattice.doc_word[doc]).astype(np.uint64)
            arcs, offset = lattice.walk(word, cur, mix(key64[doc] + np.uint64(r + 1) * _MUL) + mix(local))
        bound = offset[np.searchsorted(doc, np.append(live, n))]
        words, places, docs = [], [], []
        after = []
        for i, d in enumerate(live.tolist()):
            path = np.concatenate([head[d], arcs[bound[i]:bound[i + 1]]])
            logq = lattice.logq[path]
            before = np.cumsum(logq) - logq
            taken[d].append((path, float(logq.sum()), times[d]))
            want = k - r  # no more can still be popped, one of them only to learn its time
            fresh = np.arange(len(head[d]), len(path))
            short = len(fresh) > 2 * NEAR and before[fresh[NEAR]] < -FAR
            arrival = _arrivals(keys[d], r, fresh[:NEAR] if short else fresh, before, logq, times[d])
            best = np.argpartition(arrival, want - 1)[:want] if len(arrival) > want else np.arange(len(arrival))
            if short and not arrival[best].max() < math.exp(FAR - 40):
                arrival = _arrivals(keys[d], r, fresh, before, logq, times[d])
                best = np.argpartition(arrival, want - 1)[:want]
            for b in best.tolist():
                if math.isfinite(arrival[b]):
                    j = int(fresh[b])
                    heapq.heappush(heaps[d], (float(arrival[b]), len(taken[d]) - 1, j, (int(path[j]),), float(before[j])))
            if r + 1 == k or not heaps[d]:
                continue
            t, leaf, j, without, mass = heapq.heappop(heaps[d])
            node = int(lattice.arc_start[without[0]])
            choice = [a for a in range(int(lattice.node_arc[node]), int(lattice.node_arc[node + 1])) if a not in without]
            q = np.exp(lattice.logq[choice])
            pick = choice[min(int(np.searchsorted(np.cumsum(q), _draw(keys[d], r, j, 2) * q.sum(), side="right")), len(choice) - 1)]
            if len(choice) > 1:
                rest = math.log(max(q.sum() - math.exp(lattice.logq[pick]), 1e-300)) + mass
                later = t + math.exp(min(math.log(-math.log(_draw(keys[d], r, j, 3))) - rest, 700.0))
                heapq.heappush(heaps[d], (later, leaf, j, without + (pick,), mass))
            head[d] = np.append(taken[d][leaf][0][:j], pick)
            times[d] = t
            w, place = _next_place(lattice, head[d], d)
            mine = np.arange(w, lattice.doc_word[d + 1])
            start = lattice.word_start[mine]
            if place >= 0:
                start[0] = place
            words.append(mine)
            places.append(start)
            docs.append(np.full(len(mine), d))
            after.append(d)
        if not after:
            break
        word, cur, doc = np.concatenate(words), np.concatenate(places), np.concatenate(docs)
        live = np.array(after)
    out = []
    for d in range(n):
        limit = heaps[d][0][0] if heaps[d] else math.inf
        out.append(([(lattice.ids(p), lp, t) for p, lp, t in taken[d]], limit))
    return out


def _next_place(lattice: Lattice, path: np.ndarray, d: int) -> tuple[int, int]:
    """Where a partial path of document ``d`` goes on: a word, and the place inside it or -1 for its begin."""
    w, place = int(lattice.doc_word[d]), -1
    for end in lattice.arc_end[path].tolist():
        place = end
        if end == lattice.word_end[w]:
            w, place = w + 1, -1
    return w, place


def log_inclusion(log_prob: float, limit: float) -> float:
    """Log probability of being among the samples, given the time of the first one left out."""
    if math.isinf(limit):
        return 0.0
    x = log_prob + math.log(limit)
    return 0.0 if x > 5 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def load(path: str = MODEL):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n)], [-model.get_score(i) for i in range(n)]


def encode(docs: DataFrame, k: int = 2, seed: int = 11, model: str = MODEL) -> DataFrame:
    """Up to ``k`` segmentations per row, ``sample`` counting from 1 by falling perturbed value. One pass, no shuffle.

    The vocabulary (bounded: one model file) is read on the driver and shipped with the task.
    ``decoded`` tells that the pieces spell the text again.
    """
    pieces, ranks = load(model)

    def run(batches):
        v = Vocabulary(pieces, ranks)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            at = 0
            while at < len(texts):
                size, stop = 0, at
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < BATCH_CHARS):
                    size += len(texts[stop]) + 1
                    stop += 1
                yield _rows(v, ids[at:stop], texts[at:stop], k, seed)
                at = stop

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, SCHEMA)


def _rows(v, doc_ids, texts, k, seed):
    full = [i for i, t in enumerate(texts) if t]
    keys = [(int((_NULL_KEY if doc_ids[i] is None else doc_ids[i]) * 0x9E3779B97F4A7C15 + seed) & 0xFFFFFFFFFFFFFFFF) for i in full]
    got = dict(zip(full, sample_batch(v, keys, [texts[i] for i in full], k))) if full else {}
    cols: list[list] = [[] for _ in range(7)]
    arrays = []
    for i, t in enumerate(texts):
        samples, limit = got.get(i, ([(np.zeros(0, np.int64), 0.0, 1.0)], math.inf))
        raw = t.encode()
        for s, (ids, lp, time) in enumerate(samples, 1):
            arrays.append(ids)
            ok = (v.decode(ids) if len(ids) else b"") == raw
            for c, x in zip(cols, (doc_ids[i], s, len(ids), lp, -math.log(time), log_inclusion(lp, limit), ok)):
                c.append(x)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
    c = [pa.array(x, kind) for x, kind in zip(cols, kinds)]
    return pa.RecordBatch.from_arrays([c[0], c[1], ids, *c[2:]], [
        "doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "decoded"])


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Text of each list of pieces in column ``ids`` (null: empty), added as ``text``."""
    pieces, ranks = load(model)
    kind = "doc_id long, sample int, text string"

    def run(batches):
        v = Vocabulary(pieces, ranks)
        for batch in batches:
            texts = [v.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], ["doc_id", "sample", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("sample").cast("int"), "ids").mapInArrow(run, kind)
