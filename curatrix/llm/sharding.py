"""Sharding: a two-pass external shuffle.

Pass 1 scatters the rows by a seeded hash into buckets that fit into memory (their number follows from the bytes of the texts). Pass 2 puts each bucket into a fixed order,
shuffles it by Fisher-Yates with a seed of its own, and writes it. A bucket's place in the whole follows from the sizes of the buckets before it, so all rows are numbered
without a sort of the whole, and shards are equal runs of numbers: their sizes differ by one row at most (law ``rows``).

The result depends on the seed and the rows, not on partitions or order of the input. Null texts have size 1 and CRC 0 and stay null; null keys are hashed like a value; repeated rows
are interchangeable and all kept; an empty table gives empty shards. Other columns are written as they are; the columns that are added get free names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from curatrix.llm import files
from curatrix.llm.text import fresh


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: the generator's in-place shuffle swaps each place with a random one not above it."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def shuffled(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 1, bucket_bytes: int = 1 << 25, shard: str = "shard", slot: str = "slot", size: str = "size", crc: str = "text_crc32") -> DataFrame:
    """All columns and ``size``, ``crc``, ``shard``, ``slot``."""
    spark = docs.sparkSession
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumns({size: F.octet_length(plain).cast("long") + 1, crc: F.crc32(plain)})
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bucket, start = fresh(rows, "_bucket"), fresh(rows, "_start")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(crc)), F.lit(buckets)).cast("int"))
    # one number for each bucket, a 16th of a millionth of the bytes of the input
    counts = {r[0]: r[1] for r in rows.groupBy(bucket).count().collect()}
    n = sum(counts.values())
    starts, at = [], 0
    for b in range(buckets):
        starts.append((b, at))
        at += counts.get(b, 0)
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, f"{bucket} int, {start} long")), bucket)
    names = [*docs.columns, size, crc]
    schema = StructType([*rows.select(*names).schema.fields, StructField(shard, IntegerType()), StructField(slot, LongType())])

    def run(group: pa.Table) -> pa.Table:
        b, first = group.column(bucket)[0].as_py(), group.column(start)[0].as_py()
        order = pc.sort_indices(group.select([key, crc]), sort_keys=[(key, "ascending"), (crc, "ascending")])
        table = group.take(order.take(pa.array(fisher_yates(group.num_rows, [seed, b])))).select(names)
        place = first + np.arange(group.num_rows)
        own = place * shards // n
        return table.append_column(shard, pa.array(own.astype(np.int32))).append_column(slot, pa.array(place - -(-own * n // shards)))

    return rows.groupBy(bucket).applyInArrow(run, schema)


def write(docs: DataFrame, folder: str, **options) -> None:
    """Writes the shards as Parquet folders ``shard=N``, rows of a file in the order of their slots."""
    done = shuffled(docs, **options)
    shard, slot = options.get("shard", "shard"), options.get("slot", "slot")
    done.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)


def report(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards of all documents and returns their place."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder = f"{files.shared_folder(spark, 'shards')}/data"
    write(docs, folder, **options)
    schema = StructType([*docs.schema.fields, StructField("size", LongType()), StructField("text_crc32", LongType()), StructField("slot", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(schema).parquet(folder).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
