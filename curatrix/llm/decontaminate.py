"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items, each text scanned once.

A text is folded to ``" word word "`` (A-Z lower-cased, one space between words), so a window matches whole words only. The automaton
lives in the tasks; its patterns are broadcast in parts of ``part_chars`` characters, so what is sent is bounded whatever the size of the
benchmark: a benchmark beyond one part costs one more pass over the texts for each further part, and no pattern is left out.
Hits are word numbers, mapped to code points of the original text.

Null and empty texts have no words and no hits. Items without words have no windows. Repeated rows of documents get equal results;
repeated items count once by their id. Items with a null id are reported under the id ``""``. Empty tables give empty or clean results.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from curatrix.llm.text import ALNUM, buffers, fresh, per_text
from curatrix.session import materialize

_SPACE = bytes(32 if x == 0 else int(x) for x in ALNUM)
SPAN = StructType([StructField(n, LongType()) for n in ("word", "end_word", "start", "end")])
FIELDS = StructType([StructField("n_words", LongType()), StructField("hit", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))])
_automata: dict[str, object] = {}


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """``(pattern, n_words, items)``: the distinct windows of ``size`` consecutive words, with the ids of the items that hold them."""

    def cut(column: pa.Array) -> list[pa.Array]:
        found = []
        for t in column.to_pylist():
            w = (t or "").encode().translate(_SPACE).split()
            spans = [w[i: i + size] for i in range(max(1, len(w) - size + 1))] if w else []
            found.append([{"pattern": (b" " + b" ".join(s) + b" ").decode("latin-1"), "n_words": len(s)} for s in spans])
        return [pa.array(found, pa.list_(pa.struct([("pattern", pa.string()), ("n_words", pa.int64())])))]

    window = StructType([StructField("pattern", StringType()), StructField("n_words", LongType())])
    out = fresh(benchmark)
    cut_up = per_text(benchmark, text, cut, StructType([StructField("w", ArrayType(window))]), out, [key])
    return (cut_up.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.explode(F.col(out)["w"]).alias("w"))
            .groupBy("w.pattern", "w.n_words").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _automaton(part):
    """Built once in each worker for each broadcast part."""
    if part.id not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for n, (pattern, size, items) in enumerate(part.rows.value):
            built.add_word(pattern, (n, len(pattern), size, items))
        if len(built):
            built.make_automaton()
        _automata.clear()
        _automata[part.id] = built
    return _automata[part.id]


class _Part:
    """A broadcast list of patterns with an identity that survives pickling."""

    def __init__(self, rows):
        self.rows, self.id = rows, uuid.uuid4().hex


def _spans(text: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as word numbers and as code points of the original bytes."""
    inside = np.concatenate([[False], ALNUM[text] != 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"word": int(a), "end_word": int(b), "start": int(points[starts[a]]), "end": int(points[ends[b - 1]])}
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def _scan(part: _Part):
    def scan(column: pa.Array) -> list[pa.Array]:
        automaton = _automaton(part)
        data, at = buffers(column)
        counts, spans, items = [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            split = data[a:b].tobytes().translate(_SPACE).split()
            counts.append(len(split))
            found = list(automaton.iter((b" " + b" ".join(split) + b" ").decode("latin-1"))) if split and len(automaton) else []
            if not found:
                spans.append([])
                items.append([])
                continue
            gaps = np.concatenate([[0], np.cumsum([len(x) + 1 for x in split])])
            first = np.searchsorted(gaps, np.array([end - length + 1 for end, (_, length, _, _) in found]))
            step = np.zeros(len(split) + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + np.array([n for _, (_, _, n, _) in found]), -1)
            spans.append(_spans(data[a:b], np.cumsum(step[:-1]) > 0))
            seen = {n: ids for _, (n, _, _, ids) in found}
            items.append(sorted({x for ids in seen.values() for x in ids}))
        kind = pa.struct([(f.name, pa.int64()) for f in SPAN.fields])
        return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(items, pa.list_(pa.string()))]

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 10,
                  out: str = "contamination", keep: list[str] | None = None, part_chars: int = 4_000_000) -> DataFrame:
    """The columns ``keep`` and a struct ``out``: ``n_words``, ``hit`` (disjoint runs of hit words, as word numbers and as code points
    of the original) and ``items`` (ids as sorted strings)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    windows = materialize(item_windows(benchmark, item_key, item_text, size))
    chars = windows.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0
    parts = max(1, math.ceil(chars / part_chars))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(parts)))

    def part(n: int) -> _Part:
        rows = dealt.where(F.col("part") == n).select("pattern", "n_words", "items").collect()
        return _Part(spark.sparkContext.broadcast([tuple(r) for r in rows]))

    if parts == 1:
        return per_text(docs, text, _scan(part(0)), FIELDS, out, keep)
    names: list[str] = []
    for n in range(parts):
        names.append(fresh(docs, f"_part{n}"))
        docs = materialize(per_text(docs, text, _scan(part(n)), FIELDS, names[-1]))
    return docs.select(*keep, F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        _joined(F.flatten(F.array(*[F.col(c)["hit"] for c in names]))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in names])))).alias("items")).alias(out))


def _joined(runs: Column) -> Column:
    """Runs that overlap or follow one another, made one."""

    def add(got: Column, x: Column) -> Column:
        last = F.element_at(got, -1)
        longer = F.when(x["end_word"] > last["end_word"], x).otherwise(last)
        both = F.struct(last["word"].alias("word"), longer["end_word"].alias("end_word"), last["start"].alias("start"), longer["end"].alias("end"))
        return F.when((F.size(got) > 0) & (last["end_word"] >= x["word"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(both))).otherwise(F.concat(got, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.array().cast(ArrayType(SPAN)), add)


def n_hit(found: Column) -> Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(found["hit"], F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["word"])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: counts, digest of the item ids and verdict."""
    found = contamination(docs.select("doc_id", "text"), benchmark, out="found", keep=["doc_id"], **options)
    f = F.col("found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (F.size(f["hit"]) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, all columns as they came."""
    out = fresh(docs, "_found")
    found = contamination(docs, benchmark, out=out, **options)
    return found.where(F.size(F.col(out)["hit"]) == 0).drop(out)
