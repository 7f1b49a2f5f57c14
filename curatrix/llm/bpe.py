"""BPE encoding and decoding: a minimal acyclic transducer holds the frequent words, other words are merged exactly.

The rules come from a public tokenizer file of the ``word end`` kind: NFC, white space removed, lower case, a split into words, byte
symbols, ranked merges. The most frequent words, counted over all documents (``lexicon`` of them at most, which only decides what is fast, never an id), are merged once and compiled into an automaton with shared suffixes. Counts on its arcs number
the words, the number selects the ids, and the arrays are mapped into memory by the tasks from the shared folder. Words that it lacks are merged
many at a time, always the lowest rank and of these the leftmost pair, as the plain algorithm does. Each worker keeps a bounded memo.

Null and empty texts, and texts of white space alone, have no ids and decode to the empty string. Texts are taken whole. Repeated rows get
equal ids, an empty table gives an empty result, and other columns pass through whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from curatrix.llm import files
from curatrix.llm.text import per_text, slices
from curatrix.session import materialize

_NONE = np.int32(2**31 - 1)
MEMO, TOGETHER = 150_000, 1 << 21


def _byte_chars() -> list[str]:
    """The printable stand-ins of bytes that byte-level vocabularies use: printable Latin-1 stays, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Splitter:
    """Normalised words of a text by the pattern and the normaliser of a tokenizer file.

    Texts go through the pattern itself. Characters that the library of the file treats otherwise than this process (its tables of characters may be of another age) are found once, by comparing both over all code
    points inside words, marks and pairs; a text that holds one goes through the library.
    """

    def __init__(self, spec: dict):
        pre = spec["pre_tokenizer"]
        first = next(p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split")
        if first["behavior"] != "Removed" or not first["invert"]:
            raise ValueError("a tokenizer file that keeps what its pattern matches is needed")
        bare = {"version": "1.0", "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": first, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.spec, self.pattern = json.dumps(bare), first["pattern"]["Regex"]
        self.other = ""
        self._prepare()

    def learn(self, spark: SparkSession) -> Splitter:
        """Finds the characters to leave to the library: a job over all code points, of which at most that many come back."""
        if self.spec not in _others:
            def run(batches):
                for batch in batches:
                    points = batch.column(0).to_pylist()
                    blocks = [points[i: i + 256] for i in range(0, len(points), 256)]
                    yield pa.RecordBatch.from_arrays([pa.array([p for b in blocks if self._differ(b) for p in b if self._differ([p])], pa.int64())], names=["point"])

            points = spark.range(0, 0x110000, 1, 32).where("id < 55296 or id >= 57344").mapInArrow(run, "point long").collect()
            _others[self.spec] = "".join(chr(r.point) for r in sorted(points))
        self.other = _others[self.spec]
        self._prepare()
        return self

    def _differ(self, points: list[int]) -> bool:
        """Inside a word a letter shows, among marks a digit; what is neither joins the marks."""
        text = "\n".join(f"a{chr(p)}a !{chr(p)}!" for p in points)
        return self.by_library(text) != self.by_pattern(text)

    def _prepare(self) -> None:
        self._word, self._library = regex.compile(self.pattern), Tokenizer.from_str(self.spec)
        # A class that reaches beyond the first plane is searched member by member: there a set tells.
        near = "".join(re.escape(c) for c in self.other if c <= "\uffff")
        self._odd, self._far, self._beyond = re.compile(f"[{near}]" if near else r"(?!)"), re.compile("[\U00010000-\U0010ffff]"), set(self.other)

    def _holds_other(self, text: str) -> bool:
        return bool(self._odd.search(text)) or not text.isascii() and not self._beyond.isdisjoint(self._far.findall(text))

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "pattern": self.pattern, "other": self.other}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def by_library(self, text: str) -> list[str]:
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))]

    def by_pattern(self, text: str) -> list[str]:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # a final sigma has a lower case of its own only in whole words; the tokenizer folds characters one by one
        return self._word.findall(text.lower() if "Σ" not in text else "".join([c.lower() for c in text]))

    def words(self, text: str) -> list[str]:
        return self.by_library(text) if self._holds_other(text) else self.by_pattern(text)


#: Characters found, by the rules they were found for.
_others: dict[str, str] = {}


class Rules:
    """Vocabulary and merges as arrays; small, so that it is broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, added = spec["model"], spec["added_tokens"]
        if model.get("end_of_word_suffix") != "</w>" or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("a tokenizer file with word ends and plain special tokens is needed")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, n in [*vocab.items(), *self.special.items()]:
            self.tokens[n] = token
        self.splitter = Splitter(spec)
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; the largest number where a pair has none or a side is missing (-1)."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge_one(self, word: bytes) -> tuple[int, ...]:
        """A heap of pairs over a linked list, for long words."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        first = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(ids)
            if j < len(ids):
                pair = ids[i], ids[j]
                if pair not in known:
                    known[pair] = int(self.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
                if known[pair] != _NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else len(ids)
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(x for x, ok in zip(ids, alive, strict=True) if ok)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many words: one merge in each word per step, words of like length together."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 36)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for start in range(0, len(rows), 8192):
                part = rows[start: start + 8192]
                n, wide = size[part], int(size[part].max())
                raw = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in part), np.uint8).reshape(len(part), wide)
                ids = np.where(np.arange(wide) < n[:, None], self.inner[raw], -1)
                ids[np.arange(len(part)), n - 1] = self.last[raw[np.arange(len(part)), n - 1]]
                done = self._steps(np.concatenate([ids, np.full((len(part), 2), -1, np.int32)], axis=1).astype(np.int32))
                for i, row, k in zip(part, done.tolist(), (done >= 0).sum(axis=1), strict=True):
                    out[i] = tuple(row[:k])
        for i in np.flatnonzero(size > 36):
            out[i] = self.merge_one(words[i])
        return out

    def _steps(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        columns, todo = np.arange(ids.shape[1]), np.arange(len(ids))
        while True:
            at = ranks[todo].argmin(axis=1)
            best = ranks[todo, at]
            todo, at, best = todo[best != _NONE], at[best != _NONE], best[best != _NONE]
            if not len(todo):
                return ids
            part, order = ids[todo], ranks[todo]
            part[np.arange(len(todo)), at] = self.made[best]
            move = np.minimum(columns + (columns > at[:, None]), ids.shape[1] - 1)
            part = np.take_along_axis(part, move, axis=1)
            order = np.take_along_axis(order, move[:, :-1].clip(max=order.shape[1] - 1), axis=1)
            row = np.arange(len(todo))
            order[row, at] = self.rank(part[row, at], part[row, at + 1])
            left = np.maximum(at - 1, 0)
            order[row, left] = np.where(at > 0, self.rank(part[row, left], part[row, left + 1]), order[row, left])
            ids[todo], ranks[todo] = part, order


def build_lexicon(words: Iterable[bytes], ids: dict[bytes, tuple[int, ...]], folder: str) -> None:
    """A minimal acyclic automaton of sorted words, state by state; equal right languages share a state, counts on arcs number the words."""
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    size: list[int] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []

    def close(node: list) -> int:
        signature = (node[0], tuple(node[1]))
        if signature not in register:
            register[signature] = len(arcs)
            arcs.append(signature[1])
            final.append(node[0])
            size.append(node[0] + sum(size[t] for _, t in signature[1]))
        return register[signature]

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        same = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])
    key, target, skip = [], [], []
    for state, out in enumerate(arcs):
        before = int(final[state])
        for label, t in out:
            key.append(state << 8 | label)
            target.append(t)
            skip.append(before)
            before += size[t]
    lists = [ids[w] for w in words]
    tables = {
        "key": np.array(key, np.int64), "target": np.array(target, np.uint32), "skip": np.array(skip, np.uint32), "final": np.array(final, bool), "root": np.array([root]),
        "from": np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.uint32), "ids": np.array(list(chain.from_iterable(lists)), np.int32)}
    for name, values in tables.items():
        buffer = pa.BufferOutputStream()
        np.save(buffer, values)
        files.write_file(folder, f"{name}.npy", buffer.getvalue().to_pybytes())


class Lexicon:
    """The automaton mapped into memory."""

    def __init__(self, folder: str):
        for name in ("key", "target", "skip", "final", "root", "from", "ids"):
            # still mapped, without the cost of the subclass at each access
            setattr(self, f"_{name}", np.load(files.mapped(f"{folder}/{name}.npy"), mmap_mode="r").view(np.ndarray))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon; all words advance by one byte at a time."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(n, int(self._root[0]), np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0) if len(self._key) else np.zeros(0, np.int64)
        done = np.zeros(n, bool)
        step = 0
        while len(live):
            key = state[live] << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
            hit = self._key[at] == key
            live, at = live[hit], at[hit]
            state[live] = self._target[at]
            number[live] += self._skip[at]
            step += 1
            end = size[live] == step
            done[live[end]] = self._final[state[live[end]]]
            live = live[~end]
        return np.where(done, number, -1)

    def ids(self, number: int) -> tuple[int, ...]:
        return next(self.all_ids(np.array([number])))

    def all_ids(self, numbers: np.ndarray) -> Iterator[tuple[int, ...]]:
        """The ids of each word by its number, read together."""
        start = self._from[numbers].astype(np.int64)
        size = self._from[numbers + 1] - start
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat = self._ids[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)].tolist()
        cut = bounds.tolist()
        return (tuple(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, rules: Rules, lexicon: Lexicon | None):
        self.rules, self.lexicon = rules, lexicon
        self.memo: dict[str, tuple[int, ...]] = {}
        self.texts = [str(n) for n in range(len(rules.tokens))]
        self._special = re.compile("|".join(re.escape(t) for t in sorted(rules.special, key=len, reverse=True))) if rules.special else None

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token stands after a space, which no word holds."""
        out: list[str] = []
        start = 0
        for m in self._special.finditer(text) if self._special else ():
            out += self.rules.splitter.words(text[start: m.start()])
            out.append(" " + m[0])
            start = m.end()
        return out + self.rules.splitter.words(text[start:]) if start else self.rules.splitter.words(text)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words into the memo."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(words)
        for w in [w for w in new if w[0] == " "]:
            self.memo[w] = (self.rules.special[w[1:]],)
        plain = [w for w in new if w[0] != " "]
        raw = [w.encode() for w in plain]
        number = self.lexicon.find(raw) if self.lexicon and raw else np.full(len(raw), -1)
        rest, found = np.flatnonzero(number < 0).tolist(), np.flatnonzero(number >= 0)
        if len(found):
            self.memo.update(zip([plain[i] for i in found.tolist()], self.lexicon.all_ids(number[found]), strict=True))
        self.memo.update(zip([plain[i] for i in rest], self.rules.merge_many([raw[i] for i in rest]), strict=True))

    def encode_all(self, texts: pa.Array) -> Iterator[list[int]]:
        """Ids of each text; the new words of a few megabytes are looked up and merged together."""
        for start, end, _, _ in slices(texts, TOGETHER):
            split = [self.split(t or "") for t in texts.slice(start, end - start).to_pylist()]
            self.learn(set(chain.from_iterable(split)))
            for words in split:
                yield list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join(map(self.rules.tokens.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def _codec(mark: str, rules, folder: str) -> Codec:
    if mark not in _codecs:
        _codecs.clear()
        _codecs[mark] = Codec(rules.value, Lexicon(folder))
    return _codecs[mark]


def _lexicon(docs: DataFrame, text: str, rules: Rules, lexicon: int) -> str:
    folder = files.shared_folder(docs.sparkSession, "lexicon")
    words = frequent_words(docs, text, rules, lexicon)
    build_lexicon(words, dict(zip(words, rules.merge_many(words), strict=True)), folder)
    return folder


def frequent_words(docs: DataFrame, text: str, rules: Rules, lexicon: int) -> list[bytes]:
    """The most frequent words of all rows, ``lexicon`` of them at most: of sixteen steps to each doubling of the count, those that fit whole. Sums by step and these words come to the driver, no more."""

    sent = docs.sparkSession.sparkContext.broadcast(rules)

    def count(column: pa.Array) -> list[pa.Array]:
        codec = Codec(sent.value, None)
        seen = Counter(chain.from_iterable(codec.split(t or "") for t in column.to_pylist()))
        for w in [w for w in seen if w[0] == " "]:
            del seen[w]
        pairs = pa.StructArray.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        return [pa.ListArray.from_arrays(pa.array([0] + [len(seen)] * len(column), pa.int32()), pairs)]

    kind = StructType([StructField("w", ArrayType(StructType([StructField("word", StringType()), StructField("n", LongType())])))])
    counts = materialize(per_text(docs.select(F.col(text).alias("t")), "t", count, kind, "c", []).select(F.explode("c.w").alias("w")).groupBy("w.word").agg(
        F.sum("w.n").alias("n")).withColumn("step", F.floor(F.log2("n") * 16)))
    room, least = lexicon, None
    for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        if r.words > room:
            break
        room, least = room - r.words, r.step
    return [] if least is None else [r.word.encode() for r in counts.where(F.col("step") >= least).select("word").collect()]


FIELDS = StructType([StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("ids_text", StringType()), StructField("decoded", StringType())])


def encoded(docs: DataFrame, rules_path: str, *, text: str = "text", out: str = "bpe", keep: list[str] | None = None, fields: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
            lexicon: int = 65_536) -> DataFrame:
    """The columns ``keep`` and a struct ``out`` of the wanted ``fields``: ``n_tokens``, ``ids``, ``ids_text`` (decimal, one space between), ``decoded``."""
    spark = docs.sparkSession
    rules = Rules(rules_path)
    rules.splitter.learn(spark)
    folder = _lexicon(docs, text, rules, lexicon)
    sent, mark = spark.sparkContext.broadcast(rules), uuid.uuid4().hex

    def run(column: pa.Array) -> list[pa.Array]:
        codec = _codec(mark, sent, folder)
        made = {f: [] for f in fields}
        for ids in codec.encode_all(column):
            if "n_tokens" in made:
                made["n_tokens"].append(len(ids))
            if "ids" in made:
                made["ids"].append(np.array(ids, np.int32))
            if "ids_text" in made:
                made["ids_text"].append(" ".join(map(codec.texts.__getitem__, ids)))
            if "decoded" in made:
                made["decoded"].append(codec.decode(ids))
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_text": pa.string(), "decoded": pa.string()}
        return [pa.array(made[f], kinds[f]) for f in fields]

    return per_text(docs, text, run, StructType([FIELDS[f] for f in fields]), out, keep)


def report(docs: DataFrame, rules_path: str, **options) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    e: Column = F.col("bpe")
    return encoded(docs.select("doc_id", "text"), rules_path, keep=["doc_id"], fields=("n_tokens", "ids_text", "decoded"), **options).select(
        "doc_id", e["n_tokens"].alias("n_tokens"), F.sha2(e["ids_text"], 256).alias("ids_sha256"), F.sha2(e["decoded"], 256).alias("decoded_sha256"))
