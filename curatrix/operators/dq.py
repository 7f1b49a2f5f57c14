"""Data-quality gates: rule lists per row, fail-closed conflicts, integrity counts and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions.ids import row_digest
from curatrix.functions.rules import compact


class DataQualityError(ValueError):
    """A gate found rows that must not pass."""


def with_errors(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "errors") -> DataFrame:
    """Messages of all broken rules; a rule that evaluates to null counts as broken."""
    messages = [F.when(~F.coalesce(condition, F.lit(False)), F.lit(message)) for condition, message in rules]
    return df.withColumn(name, compact(*messages))


def split_valid(df: DataFrame, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    return df.where(F.size(name) == 0).drop(name), df.where(F.size(name) > 0)


def conflicts(df: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Keys that occur with more than one payload."""
    payload = [c for c in df.columns if c not in key and c not in ignore]
    return (
        df.groupBy(*key).agg(F.count_distinct(row_digest(payload)).alias("payloads")).where(F.col("payloads") > 1)
    )


def fail_if_any(df: DataFrame, message: str, show: int = 5) -> None:
    """Raise when the frame has a row; only a few examples reach the driver."""
    examples = df.take(show)
    if examples:
        raise DataQualityError(f"{message}: {[r.asDict() for r in examples]}")


def dedup_or_fail(df: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Identical rows collapse; one key with two payloads raises when the result is evaluated.

    The check is part of the plan: the aggregate that collapses the rows also compares the payloads.
    """
    payload = [c for c in df.columns if c not in key and c not in ignore]
    body = F.struct(*[F.col(c) for c in df.columns if c not in key])
    digest = row_digest(payload)
    folded = df.withColumn("_d", digest).groupBy(*key).agg(
        F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.min_by(body, F.col("_d")).alias("_body")
    )
    guard = F.when(
        F.col("_low") != F.col("_high"),
        F.raise_error(F.concat(F.lit("conflicting payloads for key "), F.to_json(F.struct(*key)))),
    )
    checked = folded.withColumn("_body", F.coalesce(guard.cast(_type_of(folded, "_body")), F.col("_body")))
    return checked.select(*key, "_body.*").select(*df.columns)


def _type_of(df: DataFrame, name: str):
    return df.schema[name].dataType


def integrity_counts(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
    links: Sequence[tuple[str, str, str, str]] = (), required: Sequence[str] = (),
) -> DataFrame:
    """One row per table and check: rows, duplicate keys and orphan links ``(child, column, parent, column)``."""
    checks = []
    for name, df in tables.items():
        checks.append(df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(name).alias("table_name"), F.lit("rows").alias("check_name"), "value"))
        if name in keys:
            doubled = df.groupBy(*keys[name]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            checks.append(doubled.agg(F.count(F.lit(1)).alias("value")).select(
                F.lit(name).alias("table_name"), F.lit("duplicate_keys").alias("check_name"), "value"))
    for child, column, parent, parent_column in links:
        # Fold equal references first: the anti join then sees each key once.
        refs = tables[child].groupBy(F.col(column).alias("_ref")).agg(F.count(F.lit(1)).alias("n"))
        orphans = refs.join(tables[parent], F.col("_ref") == F.col(parent_column), "left_anti")
        checks.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(
            F.lit(child).alias("table_name"), F.lit(f"orphan_{column}").alias("check_name"), "value"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    if required:
        empty = (F.col("check_name") == "rows") & F.col("table_name").isin(*required) & (F.col("value") == 0)
        stop = F.raise_error(F.concat(F.lit("mandatory table is empty: "), F.col("table_name"))).cast("bigint")
        out = out.withColumn("value", F.when(empty, stop).otherwise(F.col("value")))
    return out


def summary(df: DataFrame, flags: Mapping[str, Column], distinct: Sequence[str] = ()) -> DataFrame:
    """One row: total, conditional counts and exact distinct counts."""
    counts = [F.count(F.lit(1)).alias("records")]
    counts += [F.count_if(condition).alias(name) for name, condition in flags.items()]
    counts += [F.count_distinct(c).alias(f"distinct_{c}") for c in distinct]
    return df.agg(*counts)
