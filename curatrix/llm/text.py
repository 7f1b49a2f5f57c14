"""Whole texts as Arrow buffers: slices of bounded size, words, word hashes and shingle hashes, all vectorised.

Texts stay UTF-8 bytes; a word alphabet is a table of 256 bytes (0: separator, else the folded byte), which is exact because every
byte of a non-ASCII character is 128 or more. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

U = np.uint64
SLICE_BYTES, BATCH_BYTES = 1 << 19, 1 << 22
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def byte_table(separators: bytes) -> np.ndarray:
    """Folds A-Z to lower case and marks the separators (and byte 0) with 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of anything but white space; a NUL byte is folded to 255, which UTF-8 never holds.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
SPACED[0] = 255
#: Words are runs of digits, letters and non-ASCII characters.
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_HASH = mix(np.arange(1, 257, dtype=U) * U(_STEP))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        steps[0] = 1
        _powers[str(base)] = have = np.cumprod(steps, dtype=U)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows with about ``most`` bytes at most; a longer text is a run alone."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[at[row]: at[end]], at[row: end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(folded bytes, starts, ends, first)``: words of row ``r`` are ``first[r]`` to ``first[r + 1]``."""
    low = table[data]
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = low != 0
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at] = True
    now = inside[1:-1]
    starts = np.flatnonzero(now & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(now & (~inside[2:] | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, at)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word from one running sum over the slice."""
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(len(low) + 1, dtype=U)
    np.cumsum(_BYTE_HASH[low] * _power(_STEP, len(low)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BACK, len(low))[starts])


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run ``starts`` to ``ends`` of 64-bit values; runs of equal values hash alike wherever they stand, empty ones to one number."""
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _power(_STEP, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BACK, len(values) + 1)[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle hashes, first)`` of ``size`` consecutive words inside a row; a row of fewer words, but not none, has one of all its words."""
    count = np.diff(first)
    take = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(take)])
    row = np.repeat(np.arange(len(count)), take)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    end = first[row + 1]
    padded = np.concatenate([hashes, np.zeros(size, U)])
    total = np.zeros(len(at), U)
    for j in range(size):
        part = padded[at + j] * U(pow(_STEP, j + 1, 1 << 64) | 1)
        total += np.where(at + j < end, part, U(0))
    return mix(total), bounds


def shingle_sets(column: pa.Array, size: int, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    for _, _, data, at in slices(column):
        low, starts, ends, first = words(data, at, table)
        sh, bounds = shingles(word_hashes(low, starts, ends), first, size)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(sh[a:b])


def fresh(df: DataFrame, name: str = "_llm") -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_text(df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: StructType, out: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and a struct ``out`` that ``fn`` makes of texts, a few megabytes at a time; no shuffle."""
    keep = df.columns if keep is None else keep
    source = df.select(*[df[c] for c in keep], df[text].cast("string").alias(mark := fresh(df, "_text")))
    schema = StructType([*source.schema.fields[:-1], StructField(out, fields, False)])
    names = [f.name for f in fields.fields]

    def run(batches):
        for batch in batches:
            for row, end, _, _ in slices(batch.column(len(keep)), BATCH_BYTES):
                piece = batch.slice(row, end - row)
                made = fn(piece.column(len(keep)))
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(keep))] + [pa.StructArray.from_arrays(made, names=names)], names=[*keep, out])

    return source.mapInArrow(run, schema)
