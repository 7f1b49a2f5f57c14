"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 40-bit hashes of a text's shingles (five words, split at white space, A-Z folded) in ascending order, as base64.
Sketches of parts merge into the sketch of the whole; two of them estimate resemblance, containment and the number of distinct shingles.
A sketch of fewer than ``k`` hashes holds the whole set, and estimates on it are exact.

Null and empty texts, and texts of white space alone, have the empty sketch ``""``; two empty sketches have likeness 1, an empty and another one 0.
A text of fewer words than a shingle has one shingle of all its words. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from curatrix.llm.text import U, per_text, shingle_sets

K, SIZE, BITS = 256, 5, 40
WIDE = BITS // 8


def _encode(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDE:]
    return base64.b64encode(raw.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, WIDE)
    return np.concatenate([np.zeros((len(raw), 8 - WIDE), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(U)


def _bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    """The smallest distinct 40-bit hashes of a sorted list of distinct 64-bit hashes."""
    top = hashes[: 2 * k] >> U(64 - BITS)
    top = top[np.concatenate([[True], top[1:] != top[:-1]])] if len(top) else top
    return top[:k]


def sketches(column: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    return [_bottom(s, k) for s in shingle_sets(column, size)]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of common hashes among the ``k`` smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k)) if len(b) else 0.0


def fingerprint(df: DataFrame, *, text: str = "text", out: str = "sketch", keep: list[str] | None = None, k: int = K, size: int = SIZE) -> DataFrame:
    """The columns ``keep`` and a struct ``out``: ``fingerprint`` and ``n_shingles`` (estimated)."""

    def run(column: pa.Array) -> list[pa.Array]:
        found = sketches(column, k, size)
        return [pa.array([_encode(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())]

    return per_text(df, text, run, StructType([StructField("fingerprint", StringType()), StructField("n_shingles", DoubleType())]), out, keep)


def merge(df: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """``key`` and the sketch ``fingerprint`` of the union of its parts.

    The hashes are exploded and ranked, and each task keeps ``k`` per key before the shuffle, so a key with any number of parts stays small.
    A key whose parts are all empty or null keeps the empty sketch; null is a key of its own.
    """
    raw = F.unbase64(F.coalesce(F.col(column), F.lit("")))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(raw) / WIDE - 1, F.lit(0)).cast("int")), lambda i: F.hex(F.substring(raw, i * WIDE + 1, F.lit(WIDE))))
    exploded = df.select(F.col(key).alias("key"), F.explode(hashes).alias("h")).distinct()
    ranked = exploded.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.expr("h = ''"), "h"))).where(F.col("n") <= k)
    joined = F.array_join(F.array_sort(F.collect_list("h")), "")
    return ranked.groupBy("key").agg(F.base64(F.unhex(joined)).alias("fingerprint")).select(F.col("key").alias(key), F.regexp_replace("fingerprint", r"\s", "").alias("fingerprint"))


def _ordered(docs: DataFrame, parts: int) -> DataFrame:
    """Rows cut into ranges of ascending ``doc_id``, in order inside each, and after each range a copy (``tail``) of the row that follows it."""
    ids = docs.select("doc_id")
    marks = [(i + 1) / parts for i in range(parts - 1)]
    cuts = sorted({*((ids.agg(F.percentile_approx("doc_id", marks, 10 * parts)).first()[0] or []) if marks else [])})

    def part(c: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= c)) if cuts else F.lit(0)

    firsts = {r.part: r.least for r in ids.groupBy(part(F.coalesce("doc_id", F.lit(-(2**63)))).alias("part")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("least")).collect()}
    own = part(F.col("order"))
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("order"))
    copy = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    homes = F.array(F.struct(own.cast("int").alias("part"), F.lit(False).alias("tail")))
    if copy is not None:
        back = F.element_at(copy, F.col("order")).cast("int")
        homes = F.when(F.col("order").isin(list(before)), F.concat(homes, F.array(F.struct(back.alias("part"), F.lit(True).alias("tail"))))).otherwise(homes)
    return rows.select("doc_id", "order", "text", F.explode(homes).alias("home")).select("home.part", "home.tail", "order", "doc_id", "text")


_REPORT = StructType([
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited", StringType()), StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()), StructField("n_shingles", DoubleType())])


def report(docs: DataFrame, *, k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last half comes from the start of the next document.

    The next document is found without a window over all rows: rows are dealt by ranges of ``doc_id`` (each text moves once), sorted, and streamed;
    the row after a range is copied into it. Rows of equal ``doc_id`` follow one another by text, a null id comes first.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = None  # part, doc_id, text, sketch of the row whose successor has not come yet
        ended = None  # a range whose copy of the following row has been used

        def rows(pending):
            edits = []
            for (_, t, _), (_, after, _) in pending:
                half = len(t) // 2
                edits.append(t[: len(t) - half] + after[:half])
            made = []
            for ((doc, t, own), (_, _, following)), text, other in zip(pending, edits, sketches(pa.array(edits, pa.large_string()), k, size), strict=True):
                made.append((doc, len(t), hashlib.sha256(text.encode()).hexdigest(), _encode(own), _encode(other), resemblance(own, other, k), resemblance(own, following, k), distinct(own, k)))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)], names=_REPORT.names)

        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                part, tail, doc = (piece.column(i).to_pylist() for i in (0, 1, 3))
                text = piece.column(4)
                pending = []
                for p, is_tail, d, t, own in zip(part, tail, doc, text.to_pylist(), sketches(text, k, size), strict=True):
                    if is_tail and ended == p:
                        continue
                    if held is not None and held[0] == p:
                        pending.append((held[1], (d, t, own)))
                    held, ended = (None, p) if is_tail else ((p, (d, t, own)), ended)
                if pending:
                    yield rows(pending)

    dealt = _ordered(docs, parts).repartition(parts // 4, "part").sortWithinPartitions("part", "tail", "order", "text")
    return dealt.mapInArrow(run, _REPORT).withColumnRenamed("edited", "edited_sha256")

