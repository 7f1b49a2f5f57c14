"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.session import materialize


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a frame (for plain file scans the bytes of the compressed files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise the planner decides and adaptive execution may change its mind.

    The estimate of a scan is the size of its compressed files, so the limit is far below what an executor can hold.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def _order(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def position(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Exact 1..n position in a total order, overall or inside each key, without a single-task window.

    Rows are range-partitioned on ``(keys, order)``, so a hot key spreads over many partitions; each
    partition numbers its own rows and adds the row counts of the earlier partitions of the same key.
    The range partitioning is materialised once, because both passes must see the same partitions.
    """
    order = _order(order)
    if not keys:
        return _numbered(df, order, name)
    ranged = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
    ranged = materialize(ranged.withColumn("_slice", F.spark_partition_id()))
    part = ["_slice", *keys]
    numbered = ranged.withColumn("_local", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
    sizes = ranged.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    joined = numbered.join(offsets.withColumnsRenamed({k: f"_o_{k}" for k in part}),
                           _null_safe(part, "_o_"), "left")
    ranked = joined.withColumn(name, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
    return ranked.drop("_slice", "_local", "_before", *[f"_o_{k}" for k in part])


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Overall positions with one shuffle: sorted ranges are numbered in place, and one row per range tells what comes before it."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    at = F.shiftright("_id", 33)
    sizes = ranged.groupBy(at.alias("_slice")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_slice", at).join(F.broadcast(before), "_slice")
    return joined.withColumn(name, F.col("_id") % (1 << 33) + F.col("_before") + 1).drop("_slice", "_before", "_id")


def _null_safe(columns: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return condition


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of equal names in which null equals null; the keys of the left side are kept."""
    other = right.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    joined = left.join(other, _null_safe(keys, "_o_"), how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_o_{k}" for k in keys])


def nest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], items: Sequence[str], name: str = "items",
    chunk: int = 10000,
) -> DataFrame:
    """Ordered array of structs per key, split into numbered chunks of at most ``chunk`` items.

    Keys whose row count is proven to be at most ``chunk`` are collected directly and give one row with
    ``chunk_no = 0``. The few larger keys are numbered by range partitions and give several rows, so no task
    ever holds more than one chunk. Nothing is dropped.
    """
    keys = list(keys)
    large = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).select(*keys))
    fields = list(dict.fromkeys([*order, *items]))

    def pack(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*fields)))
        return rows.groupBy(*by).agg(
            F.transform(packed, lambda x: F.struct(*[x[c].alias(c) for c in items])).alias(name))

    if large.isEmpty():
        return pack(df, keys).withColumn("chunk_no", F.lit(0))
    small = pack(df.join(small_side(large), keys, "left_anti"), keys).withColumn("chunk_no", F.lit(0))
    placed = position(df.join(small_side(large), keys, "left_semi"), order, keys, name="_at")
    placed = placed.withColumn("chunk_no", F.floor((F.col("_at") - 1) / chunk).cast("int"))
    return small.unionByName(pack(placed, [*keys, "chunk_no"]))


def first_values(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Per key: distinct count and the first ``n`` distinct values in order.

    Duplicates fold before the shuffle and the window keeps ``n`` rows per key and task, so neither a hot
    key nor many distinct values gather in one place.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_count"))
    head = (
        distinct.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(value))).where(F.col("_n") <= n)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
    )
    return null_safe_join(counts, head, list(keys))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each task to ``k`` rows per key before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*_order(order))))
    return ranked.where(F.col(name) <= k)


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(name))
