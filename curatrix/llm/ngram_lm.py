"""LM scoring with an Elias-Fano n-gram trie.

Levels. Level 1 holds the hashes of all training words (one more token ends each document) with exact counts; a word's id is its rank.
Level ``k`` holds, for each node of level ``k - 1``, its successors: at level 2 the next word's id, from level 3 on its *rank among the successors
of the shorter context* (``w`` after ``u v`` is stored as the rank of ``w`` among the successors of ``v``). A level is one monotone sequence
``parent * width + child`` and one monotone sequence of pointers, both in Elias-Fano form, 8-bit codes of the smoothed probabilities
and of the weight left to the shorter context; all levels but the last have counts too. Levels are cut into shards by ranges of parents. Tasks send their counted n-grams as sorted runs, one for each shard; a task merges the runs
of a shard and writes it. Scoring tasks map all shards into memory and search them in one pass; nothing of them passes through the driver but the list of shards.

Model. ``P1`` is the add-one estimate; above it absolute discounting is interpolated: ``P(w|h) = (c(hw) - D) / c(h) + left(h) P(w|h')``. N-grams of order 2
and more are kept from ``min_count`` on; what is cut off adds to ``left(h)``, so probabilities still sum to one (but for the 8-bit grid). An n-gram can
only be that frequent if both shorter n-grams are, so higher levels count only those, which changes no result.

Null and empty texts have the end token alone. Rows with a null id belong to training. Repeated rows count as often as they stand.
Without training rows every token scores as unknown. Words are compared by 63-bit hashes.
"""

from __future__ import annotations

import ctypes
import json
import mmap
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from curatrix.llm import files
from curatrix.llm.text import SPACED, U, fresh, per_text, slices, word_hashes, words
from curatrix.session import materialize, tidy

END = 1
SLICE = 1 << 21
GRID, LOWEST = 255, -8.0
_ALL = U(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------------ Elias-Fano sequences
def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after another in 64-bit words."""
    out = np.zeros((len(values) * width + 63) // 64 + 2, U)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        low = values.astype(U)
        np.bitwise_or.at(out, word, low << shift)
        over = np.flatnonzero(shift.astype(np.int64) + width > 64)
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (U(64) - shift[over]))
    return out


def encode_sequence(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a monotone sequence of non-negative numbers: packed low bits, unary high bits, the ones before each 512 bits of these, and inside them before each 64."""
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> width).astype(np.int64)
    bits = n + (top >> width) + 2
    ones = high + np.arange(n)
    unary = np.zeros(-(-(bits // 64 + 3) // 8) * 8, U)
    np.bitwise_or.at(unary, ones >> 6, U(1) << (ones & 63).astype(U))
    each = np.bitwise_count(unary).reshape(-1, 8).astype(np.int64)
    inside = np.cumsum(each, axis=1)
    before = np.cumsum(inside[:, -1])
    return {"head": np.array([n, width, (top >> width) + 1], np.int64), "low": _packed(values & ((1 << width) - 1), width), "high": unary,
            "before": np.concatenate([[0], before[:-1]]), "inside": (inside - each).astype(np.uint16).ravel()}


_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the r-th set bit of a byte, at ``byte * 8 + r``.
_IN_BYTE = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[:8] for x in range(256)], np.uint8).ravel()


def _byte_counts(x: np.ndarray) -> np.ndarray:
    """In byte ``i`` the set bits of bytes 0 to ``i``."""
    x = x - ((x >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    return ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES


def _nth(word: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The place of the ``rest``-th set bit of each word, counted from 0."""
    counts, rest = _byte_counts(word), rest.astype(U)
    byte = np.bitwise_count(((rest * _ONES | _TOPS) - counts) & _TOPS).astype(U) << U(3)
    before = (counts << U(8)) >> byte & U(255)
    return byte.astype(np.int64) + _IN_BYTE[((word >> byte & U(255)) << U(3)) + rest - before]


class Joined:
    """Arrays of one kind that lie anywhere in memory, as the mapped files of a level do, read as one: a place counts from the lowest of them, ``at`` has the place where each begins.

    ``all`` does not hold the arrays; this object does and must outlive its use."""

    def __init__(self, arrays: list[np.ndarray]):
        self._kept = arrays
        kind, place = arrays[0].dtype, np.array([x.ctypes.data if len(x) else 0 for x in arrays], np.int64)
        low = int(place[place > 0].min(initial=np.iinfo(np.int64).max))
        if not place.any():
            self.all, self.at = np.zeros(1, kind), np.zeros(len(arrays), np.int64)
            return
        if any(x.dtype != kind or not x.flags.c_contiguous for x in arrays) or ((place[place > 0] - low) % kind.itemsize).any():
            raise ValueError("arrays of different kinds")
        self.at = np.maximum(place - low, 0) // kind.itemsize
        end = max(p + x.nbytes for p, x in zip(place.tolist(), arrays, strict=True) if len(x))
        self.all = np.frombuffer((ctypes.c_uint8 * (end - low)).from_address(low), kind)


class Sequences:
    """Queries on the arrays of ``encode_sequence`` of many shards, all shards in one pass. Bits and elements count on from shard to shard."""

    def __init__(self, maps: list[dict[str, np.ndarray]], name: str):
        self.n, self.width, self.tops = np.array([m[f"{name}.head"] for m in maps], np.int64).T.copy()
        self._joined = low, high, inside = [Joined([m[f"{name}.{k}"] for m in maps]) for k in ("low", "high", "inside")]
        blocks = np.array([len(m[f"{name}.before"]) for m in maps])
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self._block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        self._ones = np.concatenate([m[f"{name}.before"] + before for m, before in zip(maps, self.first.tolist(), strict=True)])
        self._zeros = None
        self._low, self._high, self._inside = low.all, high.all, inside.all
        # where a shard's words and counts lie, less the words that come before them in the count over all shards
        self._low_at, self._high_at, self._inside_at = low.at, high.at - 8 * self._block, inside.at - 8 * self._block
        self._mask = (np.int64(1) << self.width) - 1

    def _low_bits(self, shard: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Low bits of element ``at`` of its shard."""
        width = self.width[shard]
        place = at * width
        word, shift = (place >> 6) + self._low_at[shard], (place & 63).astype(U)
        # the part in the next word is moved by 64 less the shift in two steps, so that a shift of 0 leaves nothing
        value = (self._low[word] >> shift) | (self._low[word + 1] << U(1) << (U(63) - shift))
        return value.view(np.int64) & self._mask[shard]

    def _select(self, shard: np.ndarray, rank: np.ndarray, zero: bool) -> np.ndarray:
        """The bit, counted over all shards, of the one (or zero) of the given rank."""
        if zero and self._zeros is None:
            self._zeros = 512 * np.arange(len(self._ones)) - self._ones
        counts = self._zeros if zero else self._ones
        block = np.searchsorted(counts, rank, side="right") - 1
        rest = rank - counts[block]
        word, at = block << 3, self._inside_at[shard]
        before = np.zeros(len(rank), np.int64)
        for step in (4, 2, 1):
            own = self._inside[at + word + step].astype(np.int64)
            if zero:
                own = (((word & 7) + step) << 6) - own
            go = own <= rest
            word += go * step
            np.copyto(before, own, where=go)
        bits = self._high[self._high_at[shard] + word]
        return (word << 6) + _nth(~bits if zero else bits, rest - before)

    def values(self, shard: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Element ``at`` of each shard; sorted by shard and place."""
        place = self._select(shard, at + self.first[shard], False) - (self._block[shard] << 9)
        return ((place - at) << self.width[shard]) | self._low_bits(shard, at)

    def _from(self, shard: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of elements of the shard whose high part is below ``high``."""
        zero = np.maximum(high - 1, 0)
        start = self._block[shard] << 9
        place = self._select(shard, zero + start - self.first[shard], True) - start
        return np.where(high > 0, place - zero, 0)

    def find(self, shard: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The index of each value in its shard, -1 where it is not there: successor search inside the bucket of its high part. Sorted by shard and value but for what cannot be there."""
        out = np.full(len(values), -1, np.int64)
        high = values >> self.width[shard]
        live = np.flatnonzero((values >= 0) & (high < self.tops[shard]) & (self.n[shard] > 0))
        if not len(live):
            return out
        if len(live) < len(values):
            shard, values, high = shard[live], values[live], high[live]
        want = values & self._mask[shard]
        at = self._from(shard, high)
        bit = self._high_at[shard] + (self._block[shard] << 3) << 6
        # most buckets hold an element or none: a few steps along the unary bits settle them
        todo, now, place, own = np.arange(len(live)), at.copy(), at + high + bit, shard
        for _ in range(4):
            there = np.flatnonzero(self._high[place >> 6] >> (place & 63).astype(U) & U(1))
            todo, now, place, own = todo[there], now[there], place[there], own[there]
            if not len(todo):
                return out
            low, wanted = self._low_bits(own, now), want[todo]
            hit = np.flatnonzero(low == wanted)
            out[live[todo[hit]]] = now[hit]
            more = np.flatnonzero(low < wanted)
            todo, now, place, own = todo[more], now[more] + 1, place[more] + 1, own[more]
        a, end = now, self._from(own, high[todo] + 1)
        b = end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low_bits(own[open_], middle) < want[todo[open_]]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        there = np.flatnonzero(a < end)
        there = there[self._low_bits(own[there], a[there]) == want[todo[there]]]
        out[live[todo[there]]] = a[there]
        return out


class Sequence(Sequences):
    """A sequence alone."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        super().__init__([arrays], name)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.values(np.zeros(len(at), np.int64), at)

    def find(self, values: np.ndarray) -> np.ndarray:
        return super().find(np.zeros(len(values), np.int64), values)


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, aligned, behind a head that names them."""
    head, parts, at = {}, [], 0
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = [at, len(x), x.dtype.str]
        parts.append(raw + bytes(-len(raw) % 64))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def _unpack(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:  # a map without a descriptor of its own: a task maps thousands of shards
        data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {})), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8: 8 + size].tobytes())
    base = 8 + size
    return {name: np.asarray(data[base + at: base + at + n * np.dtype(kind).itemsize].view(kind)) if n else np.zeros(0, kind) for name, (at, n, kind) in head.items()}


def _code(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities on an even grid of logarithms; code 0 is probability 0."""
    with np.errstate(divide="ignore"):
        step = np.rint((np.log10(np.maximum(p, 0)) - LOWEST) / -LOWEST * (GRID - 1)) + 1
    return np.where(p > 0, np.clip(step, 1, GRID), 0).astype(np.uint8)


_VALUE = np.concatenate([[0.0], 10 ** (LOWEST - LOWEST * np.arange(GRID) / (GRID - 1))])


# ------------------------------------------------------------------ the trie in a task
class Trie:
    """All levels mapped into memory. ``shards[k]``: (first parent, nodes before, file) in order of parents. A lookup goes through all shards at once, so its cost does not depend on their number."""

    def __init__(self, folder: str, levels: list[list[tuple[int, int, str]]], widths: list[int]):
        self.widths = widths
        self.levels = []
        for shards in levels:
            maps = [_unpack(files.mapped(f"{folder}/{name}")) for _, _, name in shards]
            starts = Sequences(maps, "from") if maps and "from.head" in maps[0] else None
            self.levels.append((np.array([s[0] for s in shards], np.int64), np.array([s[1] for s in shards], np.int64), maps, Sequences(maps, "key") if maps else None, starts))
        self._arrays: dict[tuple[int, str], tuple[Joined, np.ndarray]] = {}

    def _joined(self, level: int, name: str) -> tuple[Joined, np.ndarray]:
        """An array of all shards of a level and its length in each."""
        if (level, name) not in self._arrays:
            own = [m[name] for m in self.levels[level][2]]
            self._arrays[level, name] = Joined(own), np.array([len(x) for x in own], np.int64)
        return self._arrays[level, name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of sorted hashes; -1 and 0 for unknown words."""
        first, before, maps, keys, _ = self.levels[0]
        if not maps:
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = np.maximum(np.searchsorted(first, hashes, side="right") - 1, 0)
        at = keys.find(shard, hashes - first[shard])
        ids = np.where(at >= 0, at + before[shard], -1)
        return ids, self.counts(ids)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids in any order, 0 for -1."""
        _, before, maps, _, _ = self.levels[0]
        if not maps:
            return np.zeros(len(ids), np.int64)
        count, _ = self._joined(0, "count")
        shard = np.maximum(np.searchsorted(before, ids, side="right") - 1, 0)
        return np.where(ids >= 0, count.all[(count.at - before)[shard] + np.maximum(ids, 0)], 0)

    def counts_of(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of sorted node numbers of a level."""
        _, before, maps, _, _ = self.levels[level]
        out = np.zeros(len(nodes), np.int64)
        cut = np.searchsorted(nodes, before).tolist() + [len(nodes)]
        for s in np.flatnonzero(np.diff(cut)).tolist():
            at = nodes[cut[s]: cut[s + 1]] - before[s]
            own = maps[s]["count"][at].astype(np.int64)
            if "large" in maps[s]:
                over = np.flatnonzero(own == _LARGE)
                own[over] = maps[s]["large"][np.searchsorted(maps[s]["large_at"], at[over])]
            out[cut[s]: cut[s + 1]] = own
        return out

    def children(self, level: int, parents: np.ndarray, kids: np.ndarray, last: bool = False):
        """``(node, rank among the parent's successors, probability, weight left)`` for different pairs sorted by parent and kid; node -1 if not kept. ``last`` leaves out node and rank."""
        first, before, maps, keys, starts = self.levels[level]
        if not len(parents):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        (left, sizes), (p, _) = self._joined(level, "left"), self._joined(level, "p")
        new = np.ones(len(parents), bool)
        new[1:] = parents[1:] != parents[:-1]
        own, back = parents[new], np.cumsum(new) - 1
        shard = np.maximum(np.searchsorted(first, own, side="right") - 1, 0)
        parent = own - first[shard]
        known = (parent >= 0) & (parent < sizes[shard])
        parent = np.where(known, parent, 0)
        weight = np.where(known, _VALUE[left.all[left.at[shard] + parent]], 1.0)
        value = np.where(known[back] & (kids >= 0), (parent * self.widths[level])[back] + kids, -1)
        shard_of = shard[back]
        at = keys.find(shard_of, value)
        hit = at >= 0
        chance = np.where(hit, _VALUE[p.all[p.at[shard_of] + np.maximum(at, 0)]], 0.0)
        if last:
            return None, None, chance, weight[back]
        node = np.where(hit, at + before[shard_of], -1)
        rank = np.where(hit, at - starts.values(shard, parent)[back], -1)
        return node, rank, chance, weight[back]


class Words:
    """Word ids and counts by hash, with a direct-mapped memo of recent words."""

    def __init__(self, trie: Trie, bits: int = 18):
        self.trie, self.mask = trie, (1 << bits) - 1
        self.hash, self.id, self.count = (np.full(1 << bits, x, np.int64) for x in (-1, -1, 0))

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = hashes & self.mask
        new = np.unique(hashes[self.hash[slot] != hashes])
        if len(new):
            ids, counts = self.trie.words(new)
            at = new & self.mask
            self.hash[at], self.id[at], self.count[at] = new, ids, counts
        ids, counts = self.id[slot], self.count[slot]
        lost = np.flatnonzero(self.hash[slot] != hashes)  # two new words of one slot
        if len(lost):
            at = np.searchsorted(new, hashes[lost])
            at = np.where(new[np.minimum(at, len(new) - 1)] == hashes[lost], at, -1)
            known = at >= 0
            both = self.trie.words(np.unique(hashes[lost[~known]])) if not known.all() else None
            ids_new, counts_new = self.trie.words(new)
            ids[lost[known]], counts[lost[known]] = ids_new[at[known]], counts_new[at[known]]
            if both:
                place = np.searchsorted(np.unique(hashes[lost[~known]]), hashes[lost[~known]])
                ids[lost[~known]], counts[lost[~known]] = both[0][place], both[1][place]
        return ids, counts


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of the tokens of a slice of texts, an end token after each text."""
    low, starts, ends, first = words(data, at, SPACED)
    bounds = first + np.arange(len(at))
    hashes = np.full(len(starts) + len(at) - 1, END, np.int64)
    inner = np.ones(len(hashes), bool)
    inner[bounds[1:] - 1] = False
    hashes[inner] = (word_hashes(low, starts, ends) >> U(1)).astype(np.int64)
    return hashes, bounds


class Numbers:
    """A slice of documents as word ids."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.ids = data.view(np.int64)
        self.bounds = at // 8
        self.after = np.arange(len(self.ids)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))  # tokens before it in its document

    def steps(self, trie: Trie, levels: int, nodes: bool = True):
        """For level 1, 2, ...: per token the lookup of itself after its context: ``(node, rank, probability, weight left)``; without ``nodes`` the last level leaves out the first two."""
        node, child = self.ids, self.ids
        for level in range(1, levels):
            parent = np.full(len(node), -1, np.int64)
            parent[1:] = node[:-1]
            parent[self.after < level] = -1
            asked = np.flatnonzero(parent >= 0)
            found = [np.full(len(node), -1, np.int64), np.full(len(node), -1, np.int64), np.zeros(len(node)), np.ones(len(node))]
            p, c = parent[asked], child[asked]
            wide = trie.widths[level] + 1
            if len(p) and int(p.max()) < (1 << 62) // wide:
                order = np.argsort(p * wide + c)
            else:
                order = np.lexsort((c, p))
            rows, p, c = asked[order], p[order], c[order]
            new = np.ones(len(rows), bool)
            new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
            back = np.cumsum(new) - 1
            for to, x in zip(found, trie.children(level, p[new], c[new], level == levels - 1 and not nodes), strict=True):
                if x is not None:
                    to[rows] = x[back]
            yield level, found
            node, child = found[0], found[1]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(np.concatenate([n for _, n in parts])[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


_tries: dict[str, object] = {}


def _trie(mark: str, folder: str, levels, widths) -> Trie:
    if mark not in _tries:
        _tries.clear()
        _tries[mark] = Trie(folder, levels, widths)
    return _tries[mark]


def _words(mark: str, *args) -> Words:
    if f"{mark}w" not in _tries:
        made = Words(_trie(mark, *args))
        _tries[f"{mark}w"] = made
    return _tries[f"{mark}w"]


class Model:
    """A trained trie: its folder, shards, widths and the training totals."""

    def __init__(self, folder: str):
        self.folder, self.levels, self.widths, self.tokens, self.vocabulary = folder, [], [], 0, 0
        self.mark = uuid.uuid4().hex

    def add(self, rows: list, width: int) -> None:
        """A level of shards, in order of parents."""
        before = np.concatenate([[0], np.cumsum([r["nodes"] for r in rows])]).astype(int).tolist()
        self.levels.append([(r["first"], b, r["name"]) for r, b in zip(rows, before, strict=False)])
        self.widths.append(width)

    def args(self):
        return f"{self.mark}{len(self.levels)}", self.folder, list(self.levels), list(self.widths)


_RUN = StructType([StructField("shard", LongType()), StructField("run", BinaryType())])
_SHARD = StructType([StructField("first", LongType()), StructField("nodes", LongType()), StructField("total", LongType()), StructField("widest", LongType()), StructField("name", StringType())])


#: Keys that a task counts before it sends them.
HELD = 3_000_000


def _fitting(n: np.ndarray) -> np.ndarray:
    """Non-negative numbers in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(int(n.max())))


def _run(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted different keys and their counts: the first key, then steps and counts in as few bytes as the largest of them needs."""
    steps, n = _fitting(np.diff(keys, prepend=keys[0])), _fitting(n)
    return np.array([len(keys), keys[0], steps.itemsize, n.itemsize], np.int64).tobytes() + steps.tobytes() + n.tobytes()


def _read_run(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, first, wide, wide_n = np.frombuffer(data, np.int64, 4).tolist()
    steps = np.frombuffer(data, f"u{wide}", size, 32)
    return np.cumsum(steps, dtype=np.int64) + first, np.frombuffer(data, f"u{wide_n}", size, 32 + size * wide)


def _count(rows: DataFrame, column: Column, keys, shard_of) -> DataFrame:
    """Keys and their numbers, summed inside each task, as one sorted run for each shard (``shard_of`` sorted keys); ``keys`` makes them of a slice."""

    def run(batches):
        parts: list = []
        size = 0

        def sent():
            k, n = _summed(parts)
            shard = shard_of(k)
            cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(k)]
            for a in range(0, len(cut) - 1, 64):
                some = list(zip(cut[a: a + 64], cut[a + 1: a + 65], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(shard[[x for x, _ in some]], pa.int64()), pa.array([_run(k[x:y], n[x:y]) for x, y in some], pa.binary())], names=_RUN.names)

        for batch in batches:
            for _, _, data, at in slices(batch.column(0), SLICE):
                own, n = np.unique(keys(data, at), return_counts=True)
                parts.append((own, n.astype(np.int32)))
                size += len(own)
                if size > HELD:
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield from sent()
                        parts, size = [], 0
        if size:
            yield from sent()

    return rows.select(column.alias("of")).mapInArrow(run, _RUN)


def _build(counted: DataFrame, shards: int, least: int, write) -> list:
    """The runs of each shard merged and written by ``write(shard, keys, counts)``; returns the shards' rows."""

    def run(batches):
        held: list = []
        now = None

        def flush():
            k, n = _summed(held)
            if least > 1:
                k, n = k[n >= least], n[n >= least]
            if len(k):
                yield pa.RecordBatch.from_pylist([write(now, k, n)], schema=_arrow)

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and shard != now:
                    yield from flush()
                    held = []
                now = shard
                held.append(_read_run(data.as_buffer()))
        if held:
            yield from flush()

    _arrow = pa.schema([(f.name, pa.string() if f.name == "name" else pa.int64()) for f in _SHARD.fields])
    dealt = counted.repartition(shards, "shard").sortWithinPartitions("shard")
    return sorted(materialize(dealt.mapInArrow(run, _SHARD)).collect(), key=lambda r: r["first"])


def _named(name: str, arrays: dict) -> dict:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def _sizes(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32 if n.max() < 1 << 32 else np.int64)


_LARGE = 255


def _short(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those that do not fit stand apart, with their places."""
    at = np.flatnonzero(n >= _LARGE)
    return {"count": np.minimum(n, _LARGE).astype(np.uint8), "large": _sizes(n[at]) if len(at) else np.zeros(0, np.uint32), "large_at": at.astype(np.int64)}


def vocabulary(docs: DataFrame, *, text: str = "text") -> Model:
    """Level 1: all words of all rows, counted."""
    spark = docs.sparkSession
    model = Model(files.shared_folder(spark, "trie"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = -(-(1 << 31) // shards)  # of the upper 31 bits of a hash

    def write(shard: int, k: np.ndarray, n: np.ndarray) -> dict:
        base = shard * span << 32
        name = files.write_file(model.folder, f"1-{shard}-{uuid.uuid4().hex}", _pack(_named("key", encode_sequence(k - base)) | {"count": n.astype(np.int64)}))
        return {"first": base, "nodes": len(k), "total": int(n.sum()), "widest": 0, "name": name}

    rows = _build(_count(docs, F.col(text).cast("string"), lambda data, at: token_hashes(data, at)[0], lambda k: (k >> 32) // span), shards, 1, write)
    model.add(rows, 1)
    model.tokens, model.vocabulary = sum(r["total"] for r in rows), sum(r["nodes"] for r in rows)
    return model


_NUMBERED = StructType([StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType())])


def numbered(docs: DataFrame, model: Model, *, text: str = "text", out: str = "numbers", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and a struct ``out``: the tokens' word ids (64 bits each, -1 if unknown), their number, the known ones, and the score of level 1."""
    args, n, v = model.args(), model.tokens, model.vocabulary

    def run(column: pa.Array) -> list[pa.Array]:
        lookup = _words(*args)
        made: list[list] = [[], [], [], []]
        for _, _, data, at in slices(column, SLICE):
            hashes, bounds = token_hashes(data, at)
            ids, counts = lookup(hashes)
            cut = bounds[:-1]
            made[0] += [ids[a:b].tobytes() for a, b in zip(cut, bounds[1:], strict=True)]
            made[1].append(np.diff(bounds))
            made[2].append(np.add.reduceat((counts > 0).astype(np.int64), cut))
            made[3].append(np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), cut))
        return [pa.array(made[0], pa.binary()), *[pa.array(np.concatenate(x)) for x in made[1:]]]

    return per_text(docs, text, run, _NUMBERED, out, keep)


def grow(model: Model, rows: DataFrame, ids: Column, *, order: int = 3, min_count: int = 2, discount: float = 0.75) -> Model:
    """Levels 2 to ``order`` from the word ids of all rows."""
    shards = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task holds one shard at a time
    parents, width = model.vocabulary, model.vocabulary
    for level in range(1, order):
        if not parents:
            break
        args, each = model.args(), -(-parents // shards)

        def keys(data, at, args=args, level=level, width=width):
            n = Numbers(data, at)
            node, rank = n.ids, n.ids
            if level > 1:
                for _, found in n.steps(_trie(*args), level):
                    node, rank = found[0], found[1]
            use = np.flatnonzero(n.after >= level)
            use = use[(node[use - 1] >= 0) & (rank[use] >= 0)]
            return node[use - 1] * width + rank[use]

        def write(shard: int, k: np.ndarray, n: np.ndarray, args=args, level=level, width=width, each=each, parents=parents) -> dict:
            base = shard * each
            many = min(each, parents - base)
            parent = k // width - base
            p = (n - discount) / np.maximum(_trie(*args).counts_of(level - 1, np.arange(base, base + many))[parent], 1)
            left = 1 - np.bincount(parent, weights=p, minlength=many)
            starts = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=many))])
            data = _named("key", encode_sequence(k - base * width)) | _named("from", encode_sequence(starts)) | {"p": _code(p), "left": _code(np.clip(left, 1e-8, 1))} | (_short(n) if level + 1 < order else {})
            name = files.write_file(model.folder, f"{level + 1}-{shard}-{uuid.uuid4().hex}", _pack(data))
            return {"first": base, "nodes": len(k), "total": int(n.sum()), "widest": int(np.diff(starts).max()), "name": name}

        done = _build(_count(rows, ids, keys, lambda k, span=width * each: k // span), shards, min_count, write)
        if not done:
            break
        model.add(done, width)
        parents, width = sum(r["nodes"] for r in done), max(r["widest"] for r in done)
    return model


def _stored(df: DataFrame, model: Model) -> DataFrame:
    """Written to the folder of the model: the words of each text are looked up once for all levels."""
    path = f"{model.folder}/rows-{uuid.uuid4().hex[:8]}"
    df.write.options(**{"parquet.enable.dictionary": "false", "compression": "zstd"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train(docs: DataFrame, *, text: str = "text", **options) -> Model:
    """Counts the n-grams of all rows and builds the trie."""
    with tidy(docs.sparkSession):
        model = vocabulary(docs, text=text)
        rows = _stored(numbered(docs, model, text=text, keep=[]), model)
        return grow(model, rows, F.col("numbers")["ids"], **options)


_SCORED = StructType([*_NUMBERED.fields[1:], StructField("score", DoubleType())])


def _score(rows: DataFrame, model: Model, numbers: str, out: str, keep: list[str]) -> DataFrame:
    """``keep`` and a struct ``out`` of the figures of numbered rows and their score."""
    args, n, v = model.args(), model.tokens, model.vocabulary
    source = rows.select(*[rows[c] for c in keep], *[rows[numbers][f.name].alias(f"{out}_{i}") for i, f in enumerate(_NUMBERED.fields)])
    schema = StructType([*source.schema.fields[: len(keep)], StructField(out, _SCORED, False)])

    def run(batches):
        trie = _trie(*args)
        for batch in batches:
            for row, end, data, at in slices(batch.column(len(keep)), SLICE):
                t = Numbers(data, at)
                p = (trie.counts(t.ids) + 1) / (n + v + 1)
                for _, found in t.steps(trie, len(args[2]), nodes=False):
                    p = found[2] + found[3] * p
                piece = batch.slice(row, end - row)
                score = pa.array(np.add.reduceat(np.log10(p), t.bounds[:-1]))
                figures = pa.StructArray.from_arrays([*[piece.column(len(keep) + i) for i in (1, 2, 3)], score], names=_SCORED.names)
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(keep))], figures], names=[*keep, out])

    return source.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, *, text: str = "text", out: str = "lm", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and a struct ``out``: ``n_tokens``, ``n_known``, ``base_score`` and ``score``."""
    keep = docs.columns if keep is None else keep
    name = fresh(docs, "_numbers")
    return _score(numbered(docs, model, text=text, out=name, keep=keep), model, name, out, keep)


def report(docs: DataFrame, **options) -> DataFrame:
    """Trains on the rows that are not held out and scores all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    with tidy(docs.sparkSession):
        model = vocabulary(docs.where(~F.col("held_out")))
        rows = _stored(numbered(docs, model, keep=["doc_id", "held_out"]), model)
        grow(model, rows.where(~F.col("held_out")), F.col("numbers")["ids"], **options)
    s = F.col("lm")
    return _score(rows, model, "numbers", "lm", ["doc_id", "held_out"]).select(
        "doc_id", "held_out", s["n_tokens"].alias("n_tokens"), s["n_known"].alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        s["base_score"].alias("base_score"), s["score"].alias("score"))
