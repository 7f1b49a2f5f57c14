"""Set operations, exact deduplication, content addressing and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from curatrix.operators.graph import connected_components
from curatrix.operators.scale import small_side
from curatrix.session import materialize


def union_sources(sources: Mapping[str, DataFrame], exclude: Sequence[str] = ()) -> DataFrame:
    """Same-shape records of several sources with their name; excluded sources are left out."""
    out = None
    for name, df in sources.items():
        if name in exclude:
            continue
        part = df.withColumn("source_file", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def key_comparison(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct key with ``missing`` (left only), ``extra`` (right only) or ``overlap``."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    both = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("overlap").alias("side"))


def exact_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in a total order, as a partial aggregate."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_b"))
    return picked.select(*keys, "_b.*").select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Last arrival wins per key; of rows that arrived at once, a change wins over the table, then a digest of the row decides."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "_new")]
    order = F.struct(F.col(arrival), F.col("_new"), F.sha2(F.to_json(F.struct(*rest)), 256).alias("_d"))
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    rows = rows.drop("_new")
    return picked.select(*keys, "_b.*").select(*rows.columns)


def content_address(df: DataFrame, ident: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Blob table (one row per digest) and occurrence table (every row stays)."""
    occurrences = df.withColumn("digest", F.sha2(content, 256))
    blobs = occurrences.groupBy("digest").agg(
        F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("occurrences"), F.max(F.octet_length(content)).alias("bytes"))
    return blobs, occurrences.drop(content)


def near_duplicate_pairs(df: DataFrame, ident: str, code: str, distance: int = 3, crowded: int = 2000) -> DataFrame:
    """Distinct 64-bit codes within a Hamming distance.

    Equal codes fold first, so copies never pair with each other. Of ``distance + 2`` bands at least two agree, so
    codes meet on a pair of bands. A band pair shared by more than ``crowded`` codes is split further by a second,
    interleaved banding of the same bits, of which two bands must agree as well; no pair is lost.
    """
    codes = materialize(df.select(F.col(code).alias("code")).where("code is not null").distinct())
    bands = distance + 2
    width = 64 // bands
    blocks = [((1 << (width if i < bands - 1 else 64 - width * (bands - 1))) - 1) << (i * width) for i in range(bands)]
    combs = [sum(1 << bit for bit in range(64) if bit % bands == r) for r in range(bands)]

    def band_pairs(masks: Sequence[int]) -> Column:
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        return F.explode(F.array(*[
            F.struct(F.lit(i * bands + j).alias("b"), F.col("code").bitwiseAND(F.lit(signed[i] | signed[j])).alias("v"))
            for i in range(bands) for j in range(i + 1, bands)]))

    banded = codes.select("code", band_pairs(blocks).alias("band"))
    hot = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("band"))

    def meet(rows: DataFrame, on: Sequence[str]) -> DataFrame:
        other = rows.select(F.col("code").alias("code_b"), *on)
        far = F.bit_count(F.col("code").bitwiseXOR(F.col("code_b")))
        pairs = rows.join(other, list(on)).where(F.col("code") < F.col("code_b")).withColumn("hamming", far)
        return pairs.where(F.col("hamming") <= distance).select(F.col("code").alias("code_a"), "code_b", "hamming")

    if hot.isEmpty():
        return meet(banded, ["band"]).distinct()
    cold = meet(banded.join(small_side(hot), "band", "left_anti"), ["band"])
    split = banded.join(small_side(hot), "band", "left_semi").select("code", "band", band_pairs(combs).alias("comb"))
    return cold.unionAll(meet(split, ["band", "comb"])).distinct()


def near_duplicate_groups(df: DataFrame, ident: str, code: str, distance: int = 3) -> DataFrame:
    """Review groups of records with close codes: ``(ident, code, group_code)``; nothing is removed, and a record without a code has no group code."""
    df = materialize(df.select(ident, code))
    edges = near_duplicate_pairs(df, ident, code, distance).select(F.col("code_a").alias("src"), F.col("code_b").alias("dst"))
    nodes = df.select(F.col(code).alias("node")).where("node is not null").distinct()
    labels = connected_components(nodes, edges).select(F.col("node").alias(code), F.col("component").alias("group_code"))
    return df.join(labels, code, "left")


def difference_hash(luma: DataFrame, asset: str) -> DataFrame:
    """64-bit difference hash from a 9 x 8 luminance table ``(asset, y, x, luma)``: bit set when the right one is darker."""
    w = W.partitionBy(asset, "y").orderBy("x")
    bit = luma.withColumn("_next", F.lead("luma").over(w)).where("x < 8 and y < 8")
    shift = 63 - (F.col("y") * 8 + F.col("x"))
    return bit.groupBy(asset).agg(F.bit_or(F.when(F.col("luma") > F.col("_next"), F.expr("shiftleft(1L, cast(63 - (y * 8 + x) as int))")).otherwise(F.lit(0).cast("long"))).alias("code"))
