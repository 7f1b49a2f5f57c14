"""Range joins as equi-joins on a grid of several resolutions.

A box belongs to the size class of its longest side, and its class has cells at least that long, so a box lies in at most two cells of an axis, however large it is. Two boxes meet in the
cells of the larger one's class: each box is entered in the cells of its own class and, as a visitor, of every larger class that the other side has (one for each doubling of the length at most).
A pair counts in the first cell that it shares, so there is nothing to make distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def _class(axes: Sequence[tuple[Column, Column]], width: float, eps: float) -> Column:
    longest = F.greatest(*[high - low for low, high in axes], F.lit(0.0)) + 2 * eps
    return F.when(longest > width, F.ceil(F.log2(longest / width))).otherwise(0).cast("int")


def _classes(df: DataFrame) -> list[int]:
    """The size classes of a side: one number for each doubling of the length at most."""
    return sorted(r[0] for r in df.select("_class").distinct().collect() if r[0] is not None)


def _entered(df: DataFrame, axes: Sequence[tuple[Column, Column]], others: list[int], width: float, eps: float, prefix: str) -> DataFrame:
    visited = F.filter(F.array(*[F.lit(c) for c in others]).cast("array<int>"), lambda c: c > F.col("_class"))
    out = df.withColumns({f"_low{i}": low for i, (low, _) in enumerate(axes)} | {f"_high{i}": high for i, (_, high) in enumerate(axes)})
    for i in range(len(axes)):
        out = out.where(F.col(f"_low{i}") <= F.col(f"_high{i}"))
    out = out.withColumn("_at", F.explode(F.concat(F.array("_class"), visited))).withColumn("_step", F.lit(width) * F.pow(F.lit(2.0), F.col("_at")))
    for i in range(len(axes)):
        first, last = (F.floor(x / F.col("_step")) for x in (F.col(f"_low{i}") - eps, F.col(f"_high{i}") + eps))
        out = out.withColumn(f"_cell{i}", F.explode(F.sequence(first, last)))
    kept = ["_class", *[f"_low{i}" for i in range(len(axes))], *[c for c in df.columns if c != "_class"]]
    return out.select("_at", "_step", *[f"_cell{i}" for i in range(len(axes))], *[F.col(c).alias(f"{prefix}{c}") for c in kept])


def overlap_join(left: DataFrame, right: DataFrame, left_axes: Sequence[tuple[str, str]], right_axes: Sequence[tuple[str, str]], width: float, eps: float = 0.0, half_open: bool = False, dealt: bool = False, each: tuple[str, StructType, Callable] | None = None) -> DataFrame:
    """Pairs of rows whose boxes share a point, columns prefixed ``a_`` and ``b_``; ``width`` is the length of the finest cells.

    An axis is a pair of columns, low and high; a point names one column twice. Boxes are closed and ``eps`` wider at both ends; ``half_open`` leaves out the high end of the right side. Boxes with a null bound or whose high
    end lies below the low one meet nothing. ``dealt`` deals both sides by their cells: for sides of like size with many cells, which the planner may take for small and join in the few tasks that read the other one.
    ``each``, for a table met with itself, has the order, the result's schema and the function of ``self_pairs``.
    """
    if each is not None:
        return self_pairs(left, left_axes, each[0], width, eps, *each[1:])
    columns = lambda axes: [(F.col(low).cast("double"), F.col(high).cast("double")) for low, high in axes]
    a, b = columns(left_axes), columns(right_axes)
    left, right = left.withColumn("_class", _class(a, width, eps)), right.withColumn("_class", _class(b, width, eps))
    cells = [f"_cell{i}" for i in range(len(a))]
    other = _entered(right, b, _classes(left), width, eps, "b_").drop("_step")
    entered = _entered(left, a, _classes(right), width, eps, "a_").join(other.hint("merge") if dealt else other, ["_at", *cells])
    pairs = entered.where(F.col("_at") == F.greatest("a__class", "b__class"))
    for i, ((l0, l1), (r0, r1)) in enumerate(zip(left_axes, right_axes, strict=True)):
        first = F.floor((F.greatest(f"a__low{i}", f"b__low{i}") - eps) / F.col("_step"))
        below = F.col(f"a_{l0}") < F.col(f"b_{r1}") if half_open else F.col(f"a_{l0}") <= F.col(f"b_{r1}") + eps
        pairs = pairs.where((F.col(cells[i]) == first) & below & (F.col(f"a_{l1}") + eps >= F.col(f"b_{r0}")))
    return pairs.select(*[f"a_{c}" for c in left.columns if c != "_class"], *[f"b_{c}" for c in right.columns if c != "_class"])


#: Rows of a cell that one task pairs; a cell with more is cut into tiles of two groups of rows each.
CROWD = 20_000
#: Pairs looked at in one step of a task.
STEP = 100_000


def self_pairs(df: DataFrame, axes: Sequence[tuple[str, str]], order: str, width: float, eps: float, schema: StructType, made: Callable) -> DataFrame:
    """The pairs of ``overlap_join`` of a table with itself, the row with the lower ``order`` (different in all rows) first, paired in arrays inside the tasks and not as a row each.

    ``made(rows, a, b)`` turns row numbers of pairs in the record batch ``rows`` into arrays of ``schema``. Rows go once to each of their cells; a crowded cell is dealt in tiles, so no task holds more than two groups of it.
    """
    bounds = [(F.col(low).cast("double"), F.col(high).cast("double")) for low, high in axes]
    df = df.withColumn("_class", _class(bounds, width, eps))
    entered = _entered(df, bounds, _classes(df), width, eps, "")
    cells = ["_at", *[f"_cell{i}" for i in range(len(axes))]]
    crowded = entered.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("_groups")).where("_groups > 1")
    entered = entered.join(crowded, cells, "left").withColumn("_groups", F.coalesce("_groups", F.lit(1)))
    entered = entered.withColumn("_group", F.pmod(F.xxhash64(order), "_groups")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)))
    tile = [*cells, "_first", "_second"]
    entered = entered.withColumns({"_first": F.least("_group", "_other"), "_second": F.greatest("_group", "_other")}).drop("_groups", "_other")
    names = [c for c in df.columns if c != "_class"]
    dealt = entered.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile, order)

    def pairs(held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = lambda c: held.column(c).to_numpy(zero_copy_only=False)
        keys = np.stack([column(c).astype(np.int64) for c in tile])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        ends = np.repeat([*new, held.num_rows], np.diff([0, *new, held.num_rows]))
        step, group, own = column("_step"), column("_group"), column("_class")
        low, high = ([np.asarray(column(axis[end]), np.float64) for axis in axes] for end in range(2))
        rows = held.select(names)
        many = ends - np.arange(held.num_rows) - 1
        before = np.concatenate([[0], np.cumsum(many)])
        start = 0
        while start < held.num_rows:
            stop = max(start + 1, int(np.searchsorted(before, before[start] + STEP, side="right")) - 1)
            a = np.repeat(np.arange(start, stop), many[start:stop])
            b = np.arange(len(a)) - np.repeat(before[start:stop] - before[start], many[start:stop]) + a + 1
            # of different groups in a tile of two, and at least one of the class whose cells these are
            keep = ((group[a] != group[b]) | (keys[-2][a] == keys[-1][a])) & (np.maximum(own[a], own[b]) == keys[0][a])
            a, b = a[keep], b[keep]
            for i in range(len(axes)):
                keep = (low[i][a] <= high[i][b] + eps) & (high[i][a] + eps >= low[i][b])
                a, b = a[keep], b[keep]
                keep = np.floor((np.maximum(low[i][a], low[i][b]) - eps) / step[a]) == keys[1 + i][a]
                a, b = a[keep], b[keep]
            if len(a):
                yield from made(rows, a, b)
            start = stop

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in tile])
            last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # where the last tile of the batch begins
            ends = held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in tile)
            if last or ends:
                done = held if ends and not last else [*held, batch.slice(0, last)]
                yield from pairs(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
                held = [batch.slice(last)] if last else [batch]
            else:
                held.append(batch)
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.mapInArrow(run, schema)
