"""File-source streams run with ``availableNow``; a restart resumes from the checkpoint."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curatrix.operators.dedup import exact_dedup
from curatrix.operators.dq import split_valid
from curatrix.operators.review import adjudicate, flatten_reviews, normalise_reviews, validate_reviews
from curatrix.operators.scale import null_safe_join
from curatrix.session import stored

#: Rows that a stateful task keeps under one key and hands on at once.
CHUNK = 10_000


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _read(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """The given folders and no others: the listing does not grow with the table around them."""
    return spark.read.schema(schema).parquet(*paths)


_HASHES = T.StructType([T.StructField("_h", T.LongType()), T.StructField("_at", T.LongType())])


def _runs(spark: SparkSession, filters: str, bucket: int, before: int) -> tuple[list[str], list[str]]:
    """Folders of a bucket's filter that batch ``before`` has to read, and those that an earlier full run has replaced."""
    found = sorted((int(m[1]), m[2] == "full", n) for n in _names(spark, f"{filters}/_b={bucket}") if (m := re.fullmatch(r"run=(\d+)-(part|full)", n)) and int(m[1]) < before)
    last = max((n for n, full, _ in found if full), default=-1)
    keep = [(n, full, name) for n, full, name in found if n > last or full and n == last]
    path = lambda name: f"{filters}/_b={bucket}/{name}"
    return [path(x[2]) for x in keep], [path(x[2]) for x in found if x not in keep]


def incremental_ingest(source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64, runs: int = 8) -> DataFrame:
    """Append rows with keys that were not processed before; a null key equals a null key and the first row per key counts.

    The target lies in ``buckets`` of the key's hash, ``_b=B/batch_id=N``, and ``target_keys`` holds a filter for each bucket: the hash of every key and the batch that brought it, as one run for each batch that
    touched the bucket. A batch reads the filters of the buckets it touches only; where a hash is known it opens the one folder that the filter names and compares the keys themselves. After
    ``runs`` runs a batch writes the bucket's filter as a whole; the next one that comes by removes what that replaced. So neither listing nor reading grows with the target, and a bucket's filter
    is its only index. A replayed batch sees the runs before it alone and overwrites its own folders, so that a restart never doubles rows. No key state has to fit in executor memory.
    """
    spark = source.sparkSession
    schema = source.schema
    filters = f"{target.rstrip('/')}_keys"
    hashed = F.xxhash64(*[F.col(k) for k in keys])

    def write(df: DataFrame, path: str, parts: Sequence[str]) -> None:
        df.repartition(parts[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = stored(exact_dedup(batch, keys, order).withColumn("_h", hashed).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int")))
        touched = [r[0] for r in fresh.select("_b").distinct().collect()]  # at most one number for each bucket
        full, open_, gone = [], [], []
        for b in touched:
            live, dead = _runs(spark, filters, b, batch_id)
            open_ += live
            gone += dead
            full += [b] if len(live) >= runs else []
        known = _read(spark, _HASHES, open_) if open_ else spark.createDataFrame([], _HASHES)
        hits = stored(fresh.select("_b", *keys, "_h").join(known, "_h"))
        paths = [f"{target}/_b={r[0]}/batch_id={r[1]}" for r in hits.select("_b", "_at").distinct().collect()]
        if paths:
            seen = _read(spark, schema, paths).select(*keys)
            fresh = stored(null_safe_join(fresh, seen, list(keys), "left_anti"))
        write(fresh.withColumn("batch_id", F.lit(batch_id)), target, ["_b", "batch_id"])
        run = fresh.select("_b", "_h", F.lit(batch_id).cast("long").alias("_at"), F.lit(f"{batch_id}-part").alias("run"))
        if full:
            whole = known.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int")).where(F.col("_b").isin(full))
            run = run.withColumn("run", F.when(F.col("_b").isin(full), f"{batch_id}-full").otherwise(F.col("run"))).unionByName(whole.withColumn("run", F.lit(f"{batch_id}-full")))
        write(run, filters, ["_b", "run"])
        for path in gone:
            fs, p = _files(spark, path)
            fs.delete(p, True)

    query = source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_b", T.IntegerType()), T.StructField("batch_id", T.LongType())])).parquet(target).drop("_b", "batch_id")


def _plain(value):
    """Arrays as lists and numbers of numpy as Python's; what pandas shows as not a number is null."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value]
    return None if pd.isna(value) else value.item() if isinstance(value, np.generic) else value


class _Reviews(StatefulProcessor):
    """Keeps the distinct rows of an item in numbered chunks and hands on all of them whenever the item gets rows; ``_new`` marks those that came now.

    A call to the state costs a round trip to the JVM, so it moves a chunk of rows at a time, never a row."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", T.StructType([T.StructField("number", T.LongType())]), T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = [*self.schema.names, "_new"]
        known: set[str] = set()
        number, last = -1, []
        for (at,), (data,) in self.chunks.iterator():
            held = pickle.loads(data)
            known.update(digest for *_, digest in held)
            if at > number:
                number, last = at, held
            yield pd.DataFrame([(*row, False) for *row, _ in held], columns=columns)
        if number < 0 or len(last) >= CHUNK:
            number, last = number + 1, []
        new: list[tuple] = []
        for part in rows:
            # by place: the last column may arrive under another name
            for *row, digest in part.itertuples(index=False, name=None):
                if digest in known:
                    continue
                known.add(digest)
                new.append((*map(_plain, row), digest))
                if len(last) + len(new) >= CHUNK:
                    yield self._add(number, last, new, columns)
                    number, last, new = number + 1, [], []
        if new:
            yield self._add(number, last, new, columns)

    def _add(self, number: int, last: list[tuple], new: list[tuple], columns: list[str]) -> pd.DataFrame:
        self.chunks.updateValue((number,), (pickle.dumps(last + new),))
        return pd.DataFrame([(*row, True) for *row, _ in new], columns=columns)

    def close(self) -> None:
        pass


def review_log_stream(source: DataFrame, log: str, status: str, checkpoint: str, flatten: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append-only review files: validate, keep the distinct rows of each item as keyed state, recompute only the touched items.

    A batch reads its own files and the state of the items they touch, never the log. New rows land under ``log/batch_id=N`` and statuses under ``status/batch_id=N``; ``latest_status`` reads the newest row per item.
    A replayed batch starts from the state before it and overwrites its folders.
    """
    spark = source.sparkSession
    if flatten is None:
        valid, _ = split_valid(validate_reviews(source))
        rows = flatten_reviews(normalise_reviews(valid))
    else:
        rows = flatten(source)
    rows = rows.select(*[F.col(c).cast("string").alias(c) if c == "created_at" else F.col(c) for c in rows.columns])
    keyed = rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256))
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], T.StructField("_new", T.BooleanType())])
    current = keyed.groupBy("item_id").transformWithStateInPandas(_Reviews(T.StructType(out.fields[:-1])), out, "Update", "None")

    def apply(batch: DataFrame, batch_id: int) -> None:
        # The stateful plan runs once; a folder that starts with an underscore is none of the log's.
        batch.write.mode("overwrite").parquet(f"{log}/_touched")
        touched = batch.sparkSession.read.schema(out).parquet(f"{log}/_touched")
        touched.where("_new").drop("_new").write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        adjudicate(touched.drop("_new")).write.mode("overwrite").parquet(f"{status}/batch_id={batch_id}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        current.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def latest_status(spark: SparkSession, status: str) -> DataFrame:
    rows = spark.read.parquet(status)
    rest = [c for c in rows.columns if c not in ("item_id", "batch_id")]
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select("item_id", "s.*")
