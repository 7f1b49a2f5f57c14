"""A hierarchical navigable small-world graph over the unit vectors of one shard; searches and insertions run for a block of queries at once.

Nodes are numbered by falling level, so layer ``l`` holds the nodes below ``sizes[l]`` and a layer can be filled from top to bottom: nodes enter in blocks, each finds its neighbours among those
that came before through the layers above, and links go both ways. Links of a node are chosen for direction (a candidate that is nearer to a link already chosen than to the node waits), then
filled up with the nearest that waited.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

DEGREE, BUILD_BEAM, INSERT, QUERIES, PAIRS = 12, 40, 512, 256, 1 << 17


@dataclass
class Graph:
    """``units``: float32 rows; ``layers[0]``: links of all nodes, -1 where there are fewer."""

    units: np.ndarray
    layers: list[np.ndarray]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @staticmethod
    def load(units: np.ndarray, data: bytes) -> Graph:
        parts = np.load(io.BytesIO(data))
        return Graph(units, [parts[f"layer{i}"] for i in range(len(parts.files))])


def levels(n: int, seed: int) -> list[int]:
    """Nodes in each layer, bottom first: levels fall off by the degree."""
    drawn = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
    return [n] + [int((drawn >= level).sum()) for level in range(1, drawn.max(initial=0) + 1)]


def _best(sims: np.ndarray, width: int) -> np.ndarray:
    return np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def beam(units: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, floor: float | None = None, at_once: int = 3):
    """``(nodes, cosines)`` of the ``width`` best found for each query, unordered; with ``floor`` also ``(query, node)`` of all nodes met at that cosine or more.

    Each round opens the best unopened nodes of every beam. With ``floor`` every node at or above it is opened, inside the beam or not, so the beam's width never caps a result.
    """
    rows = np.arange(len(queries))
    seen, opened = np.zeros((len(queries), len(links)), bool), np.zeros((len(queries), len(links)), bool)
    pool = np.full((len(queries), width), -1, np.int64)
    sims = np.full((len(queries), width), -np.inf, np.float32)
    pool[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", queries, units[entry])
    seen[rows, entry] = True
    near = [(rows[sims[:, 0] >= floor], pool[sims[:, 0] >= floor, 0])] if floor is not None else []
    active = rows
    while True:
        waiting = np.where((pool[active] >= 0) & ~opened[active[:, None], pool[active]], sims[active], -np.inf)
        go = waiting.max(axis=1, initial=-np.inf) > -np.inf
        active, waiting = active[go], waiting[go]
        if not len(active):
            break
        pick = _best(waiting, min(at_once, width))
        real = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        node = np.where(real, np.take_along_axis(pool[active], pick, axis=1), 0)
        r, c = np.nonzero(real)
        opened[active[r], node[r, c]] = True
        step = np.where(real[:, :, None], links[node], -1).reshape(len(active), -1)
        step.sort(axis=1)
        new = (step >= 0) & ~seen[active[:, None], step]
        new[:, 1:] &= step[:, 1:] != step[:, :-1]
        r, c = np.nonzero(new)
        ids = step[r, c]
        seen[active[r], ids] = True
        found = np.full(step.shape, -np.inf, np.float32)
        found[r, c] = value = np.einsum("ij,ij->i", queries[active[r]], units[ids])
        if floor is not None:
            near.append((active[r[value >= floor]], ids[value >= floor]))
        all_sims, all_ids = np.concatenate([sims[active], found], axis=1), np.concatenate([pool[active], step], axis=1)
        keep = _best(all_sims, width)
        sims[active], pool[active] = np.take_along_axis(all_sims, keep, axis=1), np.take_along_axis(all_ids, keep, axis=1)
        pool[active] = np.where(sims[active] > -np.inf, pool[active], -1)
    if floor is None:
        return pool, sims
    at = 0
    while at < len(near):
        q, node = near[at]
        at += 1
        closed = ~opened[q, node]
        q, node = q[closed], node[closed]
        opened[q, node] = True
        for i in range(0, len(q), PAIRS // links.shape[1]):
            part = slice(i, i + PAIRS // links.shape[1])
            ids = links[node[part]].ravel()
            who = np.repeat(q[part], links.shape[1])
            new = (ids >= 0) & ~seen[who, ids]
            code = np.unique(who[new] * len(links) + ids[new])
            who, ids = code // len(links), code % len(links)
            seen[who, ids] = True
            value = np.einsum("ij,ij->i", queries[who], units[ids])
            near.append((who[value >= floor], ids[value >= floor]))
    return pool, sims, np.concatenate([x[0] for x in near]), np.concatenate([x[1] for x in near])


def chosen(units: np.ndarray, candidates: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """``width`` links of each row among its candidates (-1: none), spread over directions first, then the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
    out = np.full((len(candidates), width), -1, np.int32)
    for i in range(0, len(candidates), INSERT):
        c, s = candidates[i: i + INSERT], sims[i: i + INSERT]
        vectors = units[c]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            nearest = np.where(taken, between[:, j], -np.inf).max(axis=1)
            taken[:, j] = (c[:, j] >= 0) & (s[:, j] > nearest) & (taken.sum(axis=1) < width)
        first = np.argsort(np.where(taken, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
        out[i: i + INSERT, : first.shape[1]] = np.take_along_axis(c, first, axis=1)
    return out


def _link_back(units: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds ``source`` to the links of ``target``; nodes with too many choose anew."""
    width = links.shape[1]
    value = np.einsum("ij,ij->i", units[source], units[target])
    order = np.lexsort((-value, target))
    source, target, value = source[order], target[order], value[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    row = np.repeat(np.arange(len(nodes)), count)
    near = place < width
    come, sims = np.full((len(nodes), width), -1, np.int64), np.full((len(nodes), width), -np.inf, np.float32)
    come[row[near], place[near]], sims[row[near], place[near]] = source[near], value[near]
    for i in range(0, len(nodes), INSERT):
        n, c, s = nodes[i: i + INSERT], come[i: i + INSERT], sims[i: i + INSERT]
        have = links[n].astype(np.int64)
        c = np.where((c[:, :, None] == have[:, None, :]).any(axis=2), -1, c)
        own = np.where(have >= 0, np.einsum("id,ijd->ij", units[n], units[have]), -np.inf)
        links[n] = chosen(units, np.concatenate([have, c], axis=1), np.concatenate([own, np.where(c >= 0, s, -np.inf)], axis=1), width)


def build(units: np.ndarray, seed: int = 0) -> Graph:
    sizes = levels(len(units), seed)
    layers: list[np.ndarray] = []
    for level in range(len(sizes) - 1, -1, -1):
        n, width = sizes[level], DEGREE * (2 if level == 0 else 1)
        above = sizes[level + 1] if level + 1 < len(sizes) else 0
        links, start = np.full((n, width), -1, np.int32), 0
        while start < n:
            end = min(n, start + min(INSERT, max(DEGREE, start)))
            if start < above < end:
                end = above
            block = units[start:end]
            inside = (block @ block.T).astype(np.float32)
            np.fill_diagonal(inside, -np.inf)
            own = _best(inside, min(BUILD_BEAM, end - start))
            ids, sims = start + own, np.take_along_axis(inside, own, axis=1)
            ids, forward = np.where(sims > -np.inf, ids, -1), width * 2 // 3
            if start:
                entry = descend(units, layers, block) if start >= above else np.zeros(end - start, np.int64)
                found, cosines = beam(units, links[:start], block, entry, BUILD_BEAM)
                # Half of the links go to earlier nodes, so that a cluster which enters in one block does not become an island.
                earlier = chosen(units, found, cosines, forward // 2).astype(np.int64)
                ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([cosines, sims], axis=1)
                known = (ids[:, :, None] == earlier[:, None, :]).any(axis=2)
                ids, sims = np.where(known, -1, ids), np.where(known, -np.inf, sims)
                links[start:end, : forward // 2] = earlier
                links[start:end, forward // 2: forward] = chosen(units, ids, sims, forward - forward // 2)
            else:
                links[start:end, :forward] = chosen(units, ids, sims, forward)
            source, column = np.nonzero(links[start:end, :forward] >= 0)
            _link_back(units, links, source + start, links[source + start, column].astype(np.int64))
            start = end
        layers.insert(0, links)
    return Graph(units, layers)


def descend(units: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node that greedy steps through the given layers, top to bottom, end at."""
    at = np.zeros(len(queries), np.int64)
    for links in reversed(upper):
        at = beam(units, links, queries, at, 1)[0][:, 0]
    return at


def neighbours(graph: Graph, queries: np.ndarray, width: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """``(query, node)`` of the nodes found at cosine ``floor`` or more, for at most ``QUERIES`` queries."""
    entry = descend(graph.units, graph.layers[1:], queries)
    return beam(graph.units, graph.layers[0], queries, entry, width, floor)[2:]
