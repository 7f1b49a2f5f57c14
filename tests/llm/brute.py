"""Plain single-machine versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def contamination(docs, items, size=10):
    """``docs``, ``items``: (id, text). Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall(fold(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i: i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w = word.findall(fold(text))
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i: i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        yield doc, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def shingle_set(text: str | None, size: int) -> frozenset:
    w = spaced(text)
    return frozenset(tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, size=4, percent=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    docs = [(d, shingle_set(t, size)) for d, t in docs]
    at: dict = {}
    for n, (_, s) in enumerate(docs):
        for x in s:
            at.setdefault(x, []).append(n)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, (_, s) in enumerate(docs):
        shared: dict[int, int] = {}
        for x in s:
            for m in at[x]:
                if m < n:
                    shared[m] = shared.get(m, 0) + 1
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(docs[m][1]) - both):
                root[find(n)] = find(m)
    least: dict[int, int] = {}
    for n, (d, _) in enumerate(docs):
        least[find(n)] = min(d, least.get(find(n), d))
    return [(d, len(s), least[find(n)]) for n, (d, s) in enumerate(docs)]


def edited(docs):
    """(doc_id, n_chars, edited text, next text) for (doc_id, text) in ascending order."""
    docs = sorted((d, t or "") for d, t in docs)
    for n, (d, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        yield d, len(t), t[: len(t) - half] + after[:half], after


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def secrets(text: str | None):
    """(counts by kind, sorted base spans)."""
    text, spans = text or "", []
    kinds = (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        spans += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    counts = [sum(s[2] == k[0] for s in spans) for k in kinds]
    return counts, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
