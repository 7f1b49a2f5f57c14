"""Spelling variants: pairs of words one insertion, deletion or replacement apart, found through pivotal grams, and the common form each rare word is led to.

Bigrams are ordered from rare to frequent over all words. The *prefix* of a word holds its first three bigrams in that order and all further occurrences of bigrams not above the third.
From the first three, two that share no character become its *pivots*: among all such pairs the one of least total frequency, by dynamic programming over the
positions. One edit cannot touch both pivots. So of two near words, the one whose third bigram ranks lower (or either, if equal) has a pivot that survives in the other word, and every
occurrence there of a bigram of that rank is in the other's prefix: looking each word's pivots up in the prefixes of all words finds every pair.

Position limits: a cut between the pivots splits the places of the edit. Behind the cut it leaves the first pivot at its place and all that comes before the cut as it is; before the cut it leaves all behind it, and the
second pivot moves with the length. A lookup is therefore an equality of bigram, place, length, distance to the cut and the hash of the part that has to be the same; distances to the cut are powers of two,
which keeps the entries of a prefix few. What meets is verified by edit distance. Nothing is cut off, and no pair of words is compared for sharing a block.

Pivots need three bigrams at positions that are not all neighbours, that is words of four code points; shorter ones raise. Words may hold any characters and be of any length; null and empty texts have no words; repeated
rows count each; a null id deletes nothing; ties between near words of equal counts go to the first in code-point order; an empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from curatrix.llm.text import U, mix, range_hashes
from curatrix.session import materialize

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bigrams are told apart by 16 bits, exactly for code points below 256; beyond, a shared number only adds candidates. The order is one table of this size at most.
KINDS = 1 << 16
EDITS, PREFIX = 1, 3
#: Change of length of a near word.
LONGER = (0, 1, -1)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``(word)``: the runs of letters of all whole texts, A-Z lower-cased; where ``every`` divides the CRC-32 of id and run, one code point is taken out."""
    runs = docs.select(F.col(key).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"({RUN})"))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    hashed = runs.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run")).alias("word"))


def lexicon(words: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)`` of the words long and frequent enough; counts are folded in each task before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and the bounds of each word."""
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def _bigrams(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kind, word, place)`` of every bigram."""
    size = np.diff(bounds)
    if len(size) and size.min() < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} code points")
    word = np.repeat(np.arange(len(size)), size - 1)
    place = np.arange(len(word)) - (bounds[:-1] - np.arange(len(size)))[word]
    at = bounds[:-1][word] + place
    return (points[at] * 256 + points[at + 1] + (points[at] >> 8) * 40503) % KINDS, word, place


def ranks(words: DataFrame) -> np.ndarray:
    """For each of the ``KINDS`` bigrams the number of words' occurrences, summed in tasks: 65,536 numbers at most reach the driver."""

    def run(batches):
        total = np.zeros(KINDS, np.int64)
        for batch in batches:
            kind, _, _ = _bigrams(*_points(batch.column(0)))
            total += np.bincount(kind, minlength=KINDS)
        kinds = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total[kinds])], names=["kind", "n"])

    counts = words.select("word").mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(KINDS, np.int64)
    out[counts.column("kind").to_numpy()] = counts.column("n").to_numpy()
    return out


def pivots(place: np.ndarray, weight: np.ndarray, picks: int = EDITS + 1, gram: int = 2) -> np.ndarray:
    """The ``picks`` columns of each row whose places are ``gram`` apart or more and whose weights sum to the least; ``place`` ascends in each row.

    ``best[i][j]``: least sum of ``i + 1`` picks of which the last is ``j``; the picks are traced back from the least of the last round.
    """
    rows, width = place.shape
    best, back = weight.astype(np.float64), []
    for _ in range(picks - 1):
        new, come = np.full((rows, width), np.inf), np.zeros((rows, width), np.int64)
        for j in range(width):
            before = np.where(place[:, j: j + 1] - place >= gram, best, np.inf)
            come[:, j] = before.argmin(axis=1)
            new[:, j] = before.min(axis=1) + weight[:, j]
        best = new
        back.append(come)
    chosen = [best.argmin(axis=1)]
    for come in reversed(back):
        chosen.append(come[np.arange(rows), chosen[-1]])
    return np.stack(chosen[::-1], axis=1)


def _entries(column: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, key, probe)``: the keys of the pivots (probe) and of the prefixes of the words of a batch."""
    points, bounds = _points(column)
    kind, word, place = _bigrams(points, bounds)
    size = np.diff(bounds)
    # rare first, then by kind: a total order of kinds
    rank = counts[kind] * KINDS + kind
    order = np.lexsort((place, rank, word))
    kind, word, place, rank = kind[order], word[order], place[order], rank[order]
    first = np.searchsorted(word, np.arange(len(size)))
    in_prefix = rank <= rank[first + PREFIX - 1][word]
    lead = first[:, None] + np.arange(PREFIX)
    by_place = np.take_along_axis(lead, place[lead].argsort(axis=1), axis=1)
    picked = np.take_along_axis(by_place, pivots(place[by_place], counts[kind[by_place]]), axis=1)
    steps = mix((points.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    start, end = bounds[:-1], bounds[1:]

    def key(at: np.ndarray, reach: np.ndarray, longer: int, behind: bool) -> np.ndarray:
        """Of the part before (``behind``: from) the cut, ``reach`` from the far end of the bigram."""
        w = word[at]
        cut = start[w] + place[at] + (2 - reach if behind else reach)
        part = range_hashes(steps, cut, end[w]) if behind else range_hashes(steps, start[w], cut)
        moved = place[at] + (longer if behind else 0)
        fields = [(kind[at] << 1) | behind, size[w] + longer, moved, reach]
        for field in fields:
            part = mix(part ^ (field.astype(U) * U(0x9E3779B97F4A7C15)))
        return part

    parts = []
    held, reach = np.flatnonzero(in_prefix), 2
    while reach <= size.max(initial=0):
        for behind in (False, True):
            fits = held[place[held] + 2 >= reach] if behind else held[place[held] + reach <= size[word[held]]]
            parts.append((word[fits], key(fits, np.full(len(fits), reach), 0, behind), False))
        reach *= 2
    left, right = picked[:, 0], picked[:, 1]
    before, behind = cuts(place[left], place[right], size[word[left]])
    parts += [(word[left], key(left, before, d, False), True) for d in LONGER] + [(word[right], key(right, behind, d, True), True) for d in LONGER]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])


def cuts(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reaches ``(a, b)``, powers of two: the part before ``left + a`` and the part from ``right + 2 - b`` do not overlap, so that one edit leaves one of them whole; the shorter is as long as can be."""
    room, best = right - left + 2, np.zeros(len(left), np.int64)
    before, behind = np.full(len(left), 2), np.full(len(left), 2)
    widest = [1 << k for k in range(1, int(room.max(initial=2)).bit_length() + 1)]
    for a in widest:
        for b in widest:
            shorter = np.minimum(left + a, size - right - 2 + b)
            better = (a + b <= room) & (shorter > best)
            best, before, behind = np.where(better, shorter, best), np.where(better, a, before), np.where(better, b, behind)
    return before, behind


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)`` in both directions for all near pairs of ``words(word, n)``; each word is listed once."""
    spread = words.sparkSession.sparkContext.broadcast(ranks(words))  # half a megabyte, whatever the input

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                piece = batch.slice(i, 1 << 14)
                at, key, probe = _entries(piece.column(0), spread.value)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(probe), piece.column(0).take(at), piece.column(1).take(at)], names=["key", "probe", "word", "n"])

    entries = words.select("word", "n").mapInArrow(run, StructType([StructField("key", LongType()), StructField("probe", BooleanType()), StructField("word", StringType()), StructField("n", LongType())]))
    held = entries.where("not probe").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = entries.where("probe").select("key", "word", "n").join(held, "key").where(near(F.col("word"), F.col("other")))
    both = met.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")).select("x.*")
    return both.repartition("word").dropDuplicates(["word", "other"])


def near(a: Column, b: Column) -> Column:
    """Exactly one code point inserted, deleted or replaced."""
    return (a != b) & (F.levenshtein(a, b, EDITS) == EDITS)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: each round doubles the step, so that chains of length c take log2(c) rounds; counts double along a chain, which bounds c by 63."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.alias("a").join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        at = materialize(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, least_ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``words(word, n)``."""
    words = materialize(words)
    near_ = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("other"))).alias("best"))
    led = F.when(-F.col("best.down") >= least_ratio * F.col("n"), F.col("best.other"))
    near_ = materialize(near_.select("word", "n_near", led.alias("form"), F.when(led.isNotNull(), -F.col("best.down")).alias("form_n")))
    lead = roots(near_.where("form is not null"))
    out = words.join(near_.join(lead, "word", "left"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(lexicon(occurrences(docs)))
