"""Quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

Each text is reduced once to a few statistics (lengths, character classes, repetition; ``STATISTICS``). They are centred and scaled by the mean and deviation over all documents
and mapped to ``cos(w x + b)`` with Gaussian ``w``, which approximates a Gaussian kernel. Every partition sums its part of the normal equations over the labelled rows, the driver solves a system whose size depends on the
number of features alone, and a pool-adjacent-violators fit on the labelled rows that the solution has not seen turns raw scores into probabilities. That fit runs on ``bins`` equal ranges of the raw score.

Labels come from any number of rows per key, conflicting ones count by their mean, null ones not at all. Neither key nor any other column enters a score. Null and empty texts have the statistics
of an empty text and get a score like others. Without labelled rows every score is 0.5. Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from curatrix.llm import files
from curatrix.llm.text import ALNUM, SPACED, byte_table, fresh, per_text, slices, word_hashes, words

_LINES = byte_table(b"\n")
_LINES[0] = 255
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": [32, 9, 13], "line": [10], "stop": [33, 46, 63], "comma": [44, 58, 59], "mark": [33], "bar": [124], "sign": [35, 36, 37, 38, 42, 64, 94, 95, 126, 43, 61],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "slash": [47, 92], "beyond": range(128, 256)}
STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_spread", "word_longest", *_CLASSES, "shouted", "signed", "bare", "distinct_words", "top_word", "repeated_lines", "line_length", "short_words", "entropy", "sign_runs")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    return np.concatenate([_statistics(data, at) for _, _, data, at in slices(column)] or [np.zeros((0, len(STATISTICS)))])


def _statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    low, starts, ends, first = words(data, at, SPACED)
    hashes, length, count = word_hashes(low, starts, ends), (ends - starts).astype(float), np.diff(first).astype(float)
    many = np.maximum(count, 1)
    member = np.zeros((len(_CLASSES), 256), bool)
    for row, codes in zip(member, _CLASSES.values(), strict=True):
        row[list(codes)] = True
    upper, letter, sign = member[0][data], (ALNUM[data] != 0), (member[list(_CLASSES).index("sign")] | member[list(_CLASSES).index("mark")] | member[list(_CLASSES).index("bar")])[data]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    in_word = lambda x: (s := sums(x))[ends] - s[starts]
    letters, shouts, signs = in_word(letter), in_word(upper), in_word(sign)
    line_low, line_starts, line_ends, line_first = words(data, at, _LINES)
    line_hashes, line_count = word_hashes(line_low, line_starts, line_ends), np.maximum(np.diff(line_first), 1)
    mean = _sums(length, first) / many
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(np.diff(line_first)), mean, np.sqrt(np.maximum(_sums(length**2, first) / many - mean**2, 0)),
        np.log1p([length[a:b].max() if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)]),
        *[_sums(row[data], at) / some for row in member],
        _sums((shouts > 1) & (shouts >= 0.7 * letters), first) / many, _sums(signs > 0, first) / many, _sums(letters == 0, first) / many]
    distinct, top, repeated, entropy = (np.zeros(len(size)) for _ in range(4))
    for r in range(len(size)):
        if count[r]:
            _, n = np.unique(hashes[first[r]: first[r + 1]], return_counts=True)
            distinct[r], top[r] = len(n) / count[r] ** 0.8, n.max() / count[r]
            repeated[r] = 1 - len(np.unique(line_hashes[line_first[r]: line_first[r + 1]])) / line_count[r]
            share = np.bincount(data[at[r]: at[r + 1]], minlength=256) / some[r]
            share = share[share > 0]
            entropy[r] = -(share * np.log2(share)).sum()
    run = np.zeros(len(data))
    run[1:] = sign[1:] & sign[:-1]
    columns += [distinct, top, repeated, np.log1p(_sums(line_ends - line_starts, line_first) / line_count), _sums(length <= 2, first) / many, entropy, _sums(run, at) / many]
    return np.stack(columns, axis=1)


class Model:
    """Scaling, random features, ridge weights and calibration; a few hundred kilobytes whatever the data."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int):
        random = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = random.normal(size=(len(mean), features)) / width
        self.shift = random.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a fiftieth of the raw score keeps the order where the calibration is flat."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def pool_adjacent_violators(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence next to ``y`` in weighted squares."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + v * w2) / (a[1] + w2), a[1] + w2, a[2] + n]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


_MATRIX = StructType([StructField("row", LongType()), StructField("sums", ArrayType(DoubleType()))])


def _features(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


def described(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, features)``, written to the shared folder: texts are read once for training and scoring."""
    out = fresh(docs, "_statistics")
    kind = StructType([StructField("features", ArrayType(FloatType()))])

    def run(column: pa.Array) -> list[pa.Array]:
        x = statistics(column).astype(np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

    made = per_text(docs, text, run, kind, out, [key]).select(F.col(key).alias("key"), F.col(out)["features"].alias("features"))
    folder = f"{files.shared_folder(docs.sparkSession, 'statistics')}/data"
    made.write.parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def fit(features: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", usable: Column | None = None, random_features: int = 128, width: float = 8.0, ridge: float = 1e-2, bins: int = 400, seed: int = 4) -> Model:
    """Trains on the labelled rows for which ``usable`` (a condition on the column ``key``) holds: three quarters for the weights, one for the calibration."""
    wanted = [F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(len(STATISTICS))] + [F.stddev_pop(F.col("features")[i]).alias(f"s{i}") for i in range(len(STATISTICS))]
    moments = [x or 0.0 for x in features.agg(*wanted).first()]
    model = Model(np.array(moments[: len(STATISTICS)]), np.array(moments[len(STATISTICS):]), random_features, width, seed)
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y")).where(F.col("y").isNotNull())
    rows = features.join(marks if usable is None else marks.where(usable), "key").select("features", "y", (F.pmod(F.xxhash64("key"), F.lit(4)) == 0).alias("check"))
    sent = features.sparkSession.sparkContext.broadcast(model)

    def sums(batches):
        total = None
        for batch in batches:
            z = sent.value.expand(_features(batch, "features"))
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            part = z.T @ np.concatenate([z, y[:, None]], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    def add(group: pa.Table) -> pa.Table:
        many = group.column("sums").combine_chunks()
        total = many.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"row": pa.array([group.column("row")[0].as_py()], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.where(~F.col("check")).mapInArrow(sums, _MATRIX).groupBy("row").applyInArrow(add, _MATRIX).orderBy("row").collect()
    if not parts:
        return model
    matrix = np.array([r["sums"] for r in parts])
    model.weights = np.linalg.solve(matrix[:, :-1] + ridge * np.eye(len(matrix)), matrix[:, -1])
    model.knots = _calibrate(rows.where("check"), model, bins)
    return model


def _calibrate(rows: DataFrame, model: Model, bins: int) -> tuple[np.ndarray, np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    low, high = -1.0, 2.0

    def place(batches):
        for batch in batches:
            raw = sent.value.raw(_features(batch, "features"))
            at = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(batch.schema.get_field_index("y"))], names=["bin", "y"])

    kind = StructType([StructField("bin", LongType()), StructField("y", DoubleType())])
    table = rows.mapInArrow(place, kind).groupBy("bin").agg(F.sum("y").alias("y"), F.count("y").alias("n")).orderBy("bin").collect()
    if len({r.y / r.n for r in table}) < 2:
        return model.knots
    at = low + (np.array([r.bin for r in table]) + 0.5) * (high - low) / bins
    n = np.array([r.n for r in table], float)
    return at, pool_adjacent_violators(np.array([r.y for r in table]) / n, n)


def scores(features: DataFrame, model: Model) -> DataFrame:
    """``(key, score)`` of described rows."""
    sent = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_features(batch, "features")))], names=["key", "score"])

    return features.select("key", "features").mapInArrow(run, StructType([features.schema["key"], StructField("score", DoubleType())]))


def scored(docs: DataFrame, model: Model, *, text: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and a struct ``out`` with the ``score`` of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, text, lambda column: [pa.array(sent.value.score(statistics(column)))], StructType([StructField("score", DoubleType())]), out, keep)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learns from the rows that are not held out and scores all rows."""
    features = described(docs)
    model = fit(features, labels, usable=~held_out(F.col("key")), **options)
    return scores(features, model).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they came."""
    model = fit(described(docs), labels, usable=~held_out(F.col("key")), **options)
    out = fresh(docs, "_quality")
    return scored(docs, model, out=out).where(F.col(out)["score"] >= 0.5).drop(out)
