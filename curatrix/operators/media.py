"""Pixel, mask, landmark and embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions.ids import stable_id
from curatrix.operators.ranges import overlap_join


def mask_overlap(masks: DataFrame, left: str, right: str, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Intersection over union of two roles of a table of set pixels ``(asset, role, y, x)``.

    Roles fold to flags per pixel, so one shuffle on the pixel replaces a join.
    """
    flags = masks.where(F.col("role").isin(left, right)).groupBy(*by, "y", "x").agg(
        F.max((F.col("role") == left).cast("int")).alias("a"), F.max((F.col("role") == right).cast("int")).alias("b"))
    out = flags.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("intersection"), F.count(F.lit(1)).alias("union"), F.sum("a").alias("reference"))
    empty = F.raise_error(F.lit(f"{left} is empty")).cast("double")
    return out.select(*by, "intersection", "union", F.when(F.col("reference") == 0, empty).otherwise(F.col("intersection") / F.col("union")).alias("iou"))


def print_containment(masks: DataFrame, art: str = "art_mask", safe: str = "safe_zone", keepout: str = "keepout_mask", by=("asset",)) -> DataFrame:
    """Share of art pixels inside the safe zone and outside the keep-out."""
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    flags = masks.where(F.col("role").isin(art, safe, keepout)).groupBy(*by, "y", "x").agg(has(art).alias("a"), has(safe).alias("s"), has(keepout).alias("k"))
    outside = (F.col("a") == 1) & ((F.col("s") == 0) | (F.col("k") == 1))
    out = flags.groupBy(*by).agg(F.sum("a").alias("art_pixels"), F.count_if(outside).alias("art_outside_safe_zone"), F.sum(F.col("a") * F.col("k")).alias("art_in_keepout"))
    empty = F.raise_error(F.lit("art mask is empty")).cast("double")
    return out.withColumn("print_zone_containment", F.when(F.col("art_pixels") == 0, empty).otherwise(1 - F.col("art_outside_safe_zone") / F.col("art_pixels")))


def landmark_error(landmarks: DataFrame, grid: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Mean and largest landmark distance over the image diagonal; both roles must carry the same labels.

    ``landmarks(asset, role, label, x, y)`` with roles ``reference`` and ``candidate``; ``grid(asset, w, h)``.
    """
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    pairs = landmarks.groupBy(*by, "label").agg(*[at(r, c).alias(f"{r[0]}{c}") for r in ("reference", "candidate") for c in ("x", "y")])
    lonely = F.col("rx").isNull() | F.col("cx").isNull()
    stop = F.raise_error(F.concat(F.lit("landmark labels differ: "), "label")).cast("double")
    distance = F.when(lonely, stop).otherwise(F.hypot(F.col("rx") - F.col("cx"), F.col("ry") - F.col("cy")))
    j = pairs.join(grid, list(by)).withColumn("d", distance / F.hypot("w", "h"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("landmark_count"), F.avg("d").alias("landmark_error"), F.max("d").alias("landmark_max_error"))


def pixel_region_join(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels inside declared rectangles ``(id, x0, y0, x1, y1)``, half-open: pixels meet rectangles on the cells of the rectangle's size class, 64 pixels the finest."""
    pairs = overlap_join(pixels, regions, [("x", "x"), ("y", "y")], [("x0", "x1"), ("y0", "y1")], 64.0, half_open=True)
    return pairs.select(*[F.col(f"a_{c}").alias(c) for c in pixels.columns], *[F.col(f"b_{c}").alias(c) for c in regions.columns])


def flat_colour_match(pixels: DataFrame, regions: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per region: matched share, largest channel delta, alpha range and unique colours.

    Equal colours fold to one row with a count before anything else.
    """
    delta = F.greatest(*[F.abs(F.col(c) - F.get("target", F.lit(i))) for i, c in enumerate("rgba")])
    colors = pixel_region_join(pixels, regions).groupBy(*by, "id", "r", "g", "b", "a", "target", "max_channel_delta", "minimum_match_fraction").agg(F.count(F.lit(1)).alias("n"))
    colors = colors.withColumn("d", delta)
    out = colors.groupBy(*by, "id", "minimum_match_fraction").agg(
        F.sum("n").alias("sampled_pixels"), F.sum(F.when(F.col("d") <= F.col("max_channel_delta"), F.col("n")).otherwise(0)).alias("matching_pixels"),
        F.max("d").alias("observed_max_channel_delta"), F.min("a").alias("alpha_min"), F.max("a").alias("alpha_max"), F.count(F.lit(1)).alias("unique_colours"))
    return out.withColumn("match_fraction", F.col("matching_pixels") / F.col("sampled_pixels")).withColumn(
        "passed", F.col("match_fraction") >= F.col("minimum_match_fraction"))


# Direction of each metric's threshold.
DIRECTIONS = {"silhouette_iou": "minimum", "print_zone_containment": "minimum", "landmark_error": "maximum", "landmark_max_error": "maximum"}


def threshold_checks(measurements: DataFrame, thresholds: dict[str, float], by: Sequence[str] = ("asset",)) -> DataFrame:
    """Pass flags and a status per asset from ``(asset, metric, value)``; a threshold without a measurement raises."""
    unknown = set(thresholds) - set(DIRECTIONS)
    if unknown:
        raise ValueError(f"unknown threshold metric: {sorted(unknown)}")
    if any(not 0 <= t <= 1 for t in thresholds.values()):
        raise ValueError("thresholds must lie in [0, 1]")
    listed = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(DIRECTIONS[m]).alias("direction"), F.lit(float(t)).alias("threshold")) for m, t in sorted(thresholds.items())]))
    wanted = measurements.select(*by).distinct().select(*by, listed.alias("t")).select(*by, "t.*")
    j = wanted.join(measurements, [*by, "metric"], "left")
    stop = F.raise_error(F.concat(F.lit("threshold has no measured input: "), "metric")).cast("boolean")
    ok = F.when(F.col("value").isNull(), stop).when(F.col("direction") == "minimum", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return j.withColumn("passed", ok)


def check_status(checks: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    return checks.groupBy(*by).agg(F.when(F.every("passed"), "technical_checks_passed").otherwise("technical_checks_failed").alias("status"))


def neighbours(pixels: DataFrame, asset: str, columns: Sequence[str]) -> DataFrame:
    """Every pixel with its right and lower neighbour (``x_``/``y_`` prefixed columns).

    Windows run along one row or one column of one image, never over a whole image.
    """
    row, column = W.partitionBy(asset, "y").orderBy("x"), W.partitionBy(asset, "x").orderBy("y")
    out = pixels
    for axis, w in (("x", row), ("y", column)):
        adjacent = F.lead(axis).over(w) == F.col(axis) + 1
        for c in columns:
            out = out.withColumn(f"{axis}_{c}", F.when(adjacent, F.lead(c).over(w)))
    return out


def pixel_features(pixels: DataFrame, asset: str = "asset", edge: float = 0.08, bins: int = 4, effective: float = 0.02) -> DataFrame:
    """Coverage, luminance, saturation, edges, mirror symmetry and palette entropy of ``(asset, y, x, r, g, b, a)``.

    Foreground is ``alpha > 16``. The palette counts fixed colour bins; image quantisation is not reproduced.
    """
    c = F.col
    p = pixels.withColumn("fg", c("a") > 16).withColumn("luma", (0.2126 * c("r") + 0.7152 * c("g") + 0.0722 * c("b")) / 255)
    p = p.withColumn("gray", F.floor((299 * c("r") + 587 * c("g") + 114 * c("b")) / 1000) / 255)
    mx, mn = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    p = p.withColumn("sat", F.when(mx > 0, (mx - mn) / mx).otherwise(0.0))
    near = neighbours(p, asset, ["gray", "fg"])
    hot = lambda axis: F.coalesce((F.abs(c("gray") - c(f"{axis}_gray")) > edge) & c("fg") & c(f"{axis}_fg"), F.lit(False))
    stats = near.groupBy(asset).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("fg").alias("foreground"), F.avg(F.when(c("fg"), c("luma"))).alias("mean_luminance"),
        F.stddev_pop(F.when(c("fg"), c("luma"))).alias("luminance_std"), F.avg(F.when(c("fg"), c("sat"))).alias("mean_saturation"),
        F.count_if(hot("x")).alias("_ex"), F.count_if(hot("y")).alias("_ey"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    # Mirror columns meet under one key: the smaller of x and its mirror image.
    sized = p.join(stats.select(asset, "width"), asset)
    fold = F.least(c("x"), c("width") - 1 - c("x"))
    mirror = sized.where((c("x") < F.floor(c("width") / 2)) | (c("x") >= c("width") - F.floor(c("width") / 2))).groupBy(asset, "y", fold.alias("_m")).agg(
        F.every("fg").alias("both"), F.count(F.lit(1)).alias("n"), *[(F.max(k) - F.min(k)).alias(f"d{k}") for k in "rgb"])
    sym = mirror.where("both and n = 2").groupBy(asset).agg(
        F.when(F.count(F.lit(1)) >= 10, 1 - F.avg((c("dr") + c("dg") + c("db")) / 3) / 255).alias("bilateral_symmetry"))
    step = 256 // bins
    colors = p.where("fg").groupBy(asset, *[F.floor(c(k) / step).alias(f"_{k}") for k in "rgb"]).agg(F.count(F.lit(1)).alias("n"))
    shares = colors.join(stats.select(asset, "foreground"), asset).withColumn("share", c("n") / c("foreground"))
    palette = shares.groupBy(asset).agg(
        F.count_if(c("share") >= effective).alias("palette_size_effective"), F.sum(-c("share") * F.log2("share")).alias("color_entropy"))
    total = F.greatest(c("_ex") + c("_ey"), F.lit(1))
    return stats.join(sym, asset, "left").join(palette, asset, "left").select(
        asset, "width", "height", (c("foreground") / c("pixels")).alias("coverage"), "mean_luminance", "luminance_std", "mean_saturation",
        ((c("_ex") + c("_ey")) / F.greatest("foreground", F.lit(1))).alias("edge_density"), (c("_ey") / total).alias("horizontal_edge_fraction"),
        (c("_ex") / total).alias("vertical_edge_fraction"), "bilateral_symmetry", "palette_size_effective", "color_entropy")


def foreground_bbox(pixels: DataFrame, asset: str = "asset", alpha: int = 20, distance: int = 45) -> DataFrame:
    """Normalised bounding box and occupancy: by alpha, or by colour distance to the median corner when opaque."""
    c = F.col
    size = pixels.groupBy(asset).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.min("a").alias("_amin"))
    p = pixels.join(size, asset)
    corner = c("x").isin(0) & c("y").isin(0) | ((c("x") == c("w") - 1) & (c("y") == 0)) | ((c("x") == 0) & (c("y") == c("h") - 1)) | (
        (c("x") == c("w") - 1) & (c("y") == c("h") - 1))
    back = p.where(corner).groupBy(asset).agg(*[F.median(k).alias(f"b{k}") for k in "rgb"])
    far = F.abs(c("r") - c("br")) + F.abs(c("g") - c("bg")) + F.abs(c("b") - c("bb")) > distance
    fg = p.join(back, asset, "left").where(F.when(c("_amin") < 255, c("a") > alpha).otherwise(F.coalesce(far, F.lit(False))))
    box = fg.groupBy(asset).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    r = lambda v, total: F.round(c(v) / c(total), 4)
    area = (c("x1") - c("x0")) * (c("y1") - c("y0")) / F.greatest(c("w") * c("h"), F.lit(1))
    return size.join(box, asset, "left").select(
        asset, r("x0", "w").alias("x0"), r("y0", "h").alias("y0"), r("x1", "w").alias("x1"), r("y1", "h").alias("y1"),
        F.coalesce(F.round(area, 4), F.lit(0.0)).alias("occupancy"))


def feature_delta(pairs: DataFrame, source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Deltas and ratios between source and target features ``edge_density``, ``palette``, ``occupancy``; zero guarded."""
    s = source.select(F.col(source.columns[0]).alias(source_key), *[F.col(c).alias(f"s_{c}") for c in ("edge_density", "palette", "occupancy")])
    t = target.select(F.col(target.columns[0]).alias(target_key), *[F.col(c).alias(f"t_{c}") for c in ("edge_density", "palette", "occupancy")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = pairs.join(s, source_key, "left").join(t, target_key, "left")
    return j.select(
        *pairs.columns, F.round(z("t_edge_density") - z("s_edge_density"), 5).alias("edge_delta"),
        F.when(z("s_edge_density") != 0, F.round(z("t_edge_density") / z("s_edge_density"), 4)).alias("edge_ratio"),
        (z("t_palette") - z("s_palette")).alias("palette_delta"), F.round(z("t_occupancy") - z("s_occupancy"), 4).alias("occupancy_delta"),
        ((z("s_edge_density") != 0) & (z("t_edge_density") < z("s_edge_density") * 0.85)).alias("lower_edge_density"),
        (z("t_palette") < z("s_palette")).alias("smaller_palette"), (F.abs(z("t_occupancy") - z("s_occupancy")) >= 0.15).alias("large_bbox_change"))


def embedding_index(df: DataFrame, ident: str, vector: str, model: str) -> DataFrame:
    """L2-normalised vectors with dimension and a stable record id."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    return df.select(ident, stable_id("embedding", F.lit(model), F.col(ident)).alias("record_id"), F.lit(model).alias("model"),
                     F.size(vector).alias("dimension"), norm.alias("norm"), unit.alias("unit"))


def cosine(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def image_part_index(images: DataFrame, parts: DataFrame, stem: str, part: str) -> DataFrame:
    """Image rows joined to a part table by stem, else by the stem without a view suffix."""
    keys = images.withColumn("_k2", F.regexp_replace(F.col(stem), r"(?i)[-_](front|back|reverse|[0-9]+)$", ""))
    p = lambda n: parts.select(F.col(part).alias(f"_p{n}"), F.struct(*parts.columns).alias(f"_r{n}")).dropDuplicates([f"_p{n}"])
    j = keys.join(p(1), F.col(stem) == F.col("_p1"), "left").join(p(2), F.col("_k2") == F.col("_p2"), "left")
    row = F.coalesce("_r1", "_r2")
    return j.select(*images.columns, row.alias("part"), row.isNotNull().alias("matched"))
