"""Sinks: ordered layers, exact shards, atomic publication and run manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatrix.operators.dq import DataQualityError
from curatrix.operators.scale import position


def write_layer(df: DataFrame, path: str, order: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Range-sorted files; ``row_no`` keeps the total order because files are unordered. Returns the layer."""
    placed = position(df, order, name="row_no")
    placed.sortWithinPartitions("row_no").write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.schema(placed.schema).format(fmt).load(path)


def shard_numbers(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Shard id so that every shard but the last has exactly ``n`` rows."""
    if n <= 0:
        raise ValueError("shard size must be positive")
    placed = position(df, order, name="row_no")
    return placed.withColumn("shard", F.floor((F.col("row_no") - 1) / n).cast("int") + 1)


def write_fixed_shards(df: DataFrame, path: str, order: Sequence[str], n: int) -> None:
    name = F.concat(F.lit("records-part-"), F.lpad(F.col("shard").cast("string"), 2, "0"))
    shards = shard_numbers(df, order, n).withColumn("shard_name", F.when(F.col("shard") < 100, name).otherwise(
        F.concat(F.lit("records-part-"), F.col("shard").cast("string"))))
    shards.repartition("shard").sortWithinPartitions("shard", "row_no").drop("shard").write.mode("overwrite").partitionBy("shard_name").json(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """``(number, folder)`` of all commits, newest first; a commit that was not written to its end has no folder."""
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/_commits")
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name, length = status.getPath().getName(), int(status.getLen())
        if name.isdigit():
            stream = fs.open(status.getPath())
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") if length else ""
            stream.close()
            found.append((int(name), text[:-1] if text.endswith("\n") else None))
    return sorted(found, key=lambda c: -c[0])


def _commit(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """Takes the number, which only one writer can, and then names the folder."""
    fs, p = _hadoop(spark, f"{path.rstrip('/')}/_commits/{number:020d}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(f"{folder}\n".encode()))
    finally:
        out.close()


def publish(df: DataFrame, path: str, checks: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]] = (), keep: int = 2) -> int:
    """Write a version of its own, check what was written, then commit it; ``published`` reads the newest commit.

    Each check returns the offending rows; any row stops the publication. Returns the row count. The commit is the one step that counts: before it readers see the version before, after it the new one, so that a crash
    between any two steps leaves a readable table. Of two writers that began from the same commit one raises. Versions older than the ``keep`` newest commits are removed at the end.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    before = _commits(spark, root)
    number = before[0][0] + 1 if before else 1
    folder = f"data-{uuid.uuid4().hex}"
    fs, target = _hadoop(spark, f"{root}/{folder}")
    done = False
    try:
        df.write.mode("errorifexists").parquet(f"{root}/{folder}")
        written = spark.read.parquet(f"{root}/{folder}")
        for label, check in checks:
            bad = check(written).take(3)
            if bad:
                raise DataQualityError(f"{label}: {[r.asDict() for r in bad]}")
        rows = written.count()
        _commit(spark, root, number, folder)
        done = True
    finally:
        if not done and fs.exists(target) and folder not in [f for _, f in _commits(spark, root)]:
            fs.delete(target, True)
    after = _commits(spark, root)
    named = [c for c in after if c[1]]
    live = {f for _, f in named[:keep]}
    for n, f in after:
        if f not in live and n < named[0][0]:
            for old in ([f"{root}/{f}"] if f else []) + [f"{root}/_commits/{n:020d}"]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return rows


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version."""
    for _, folder in _commits(spark, path):
        if folder:
            return spark.read.parquet(f"{path.rstrip('/')}/{folder}")
    raise FileNotFoundError(f"nothing published at {path}")


def source_manifest(spark: SparkSession, paths: Mapping[str, str], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per source: files, bytes, content digest, rows and columns.

    File digests are folded with a constant-size digest, so a source of any size needs one pass.
    """
    from curatrix.functions.ids import set_digest

    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        line = F.concat_ws("|", F.regexp_extract("path", "([^/]+)$", 1), F.sha2("content", 256))
        stats = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), set_digest(line).alias("content_digest"))
        rows = tables[name].agg(F.count(F.lit(1)).alias("row_count"))
        part = stats.crossJoin(rows).select(F.lit(name).alias("source"), "*", F.array(*[F.lit(c) for c in tables[name].columns]).alias("column_names"))
        out = part if out is None else out.unionByName(part)
    return out


def run_manifest(sources: DataFrame, version: str, policy: str, checks: DataFrame) -> DataFrame:
    """One row: version, policy, sources and integrity checks of a run (both inputs are one row per source or check)."""
    s = sources.agg(F.array_sort(F.collect_list(F.struct(*sources.columns))).alias("sources"))
    c = checks.agg(F.array_sort(F.collect_list(F.struct(*checks.columns))).alias("integrity"))
    return s.crossJoin(c).select(F.lit(version).alias("processor_version"), F.lit(policy).alias("policy"), "sources", "integrity")


def observed(df: DataFrame, name: str, **metrics):
    """Attach run metrics to a frame that is written anyway: ``(frame, observation)``."""
    from pyspark.sql import Observation

    watch = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")] + [e.alias(k) for k, e in metrics.items()]
    return df.observe(watch, *exprs), watch
