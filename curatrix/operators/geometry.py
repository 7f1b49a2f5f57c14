"""Meshes as triangle tables, boxes, range joins and landmark geometry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curatrix.operators.graph import connected_components, folded
from curatrix.operators.ranges import overlap_join

AXES = ("x", "y", "z")


def _point(i: int, axis: str) -> Column:
    return F.get("v", F.lit(i))[axis]


def mesh_bounds(triangles: DataFrame, by: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Bounds, size and centre of ``triangle(mesh_id, tri_id, v array<struct<x,y,z>>)`` tables."""
    low = {a: F.min(F.least(*[_point(i, a) for i in range(3)])) for a in AXES}
    high = {a: F.max(F.greatest(*[_point(i, a) for i in range(3)])) for a in AXES}
    out = triangles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("triangle_count"), *[low[a].alias(f"min_{a}") for a in AXES], *[high[a].alias(f"max_{a}") for a in AXES])
    for a in AXES:
        out = out.withColumn(f"size_{a}", F.col(f"max_{a}") - F.col(f"min_{a}")).withColumn(f"centre_{a}", (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2)
    return out


def part_bounds(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounds per ``(mesh, part label)``; ``labels(mesh_id, tri_id, part_id)``. Differing face sets raise."""
    j = faces.join(labels, ["mesh_id", "tri_id"], "full")
    stop = F.raise_error(F.concat(F.lit("face and label counts differ in "), F.col("mesh_id").cast("string"))).cast(labels.schema["part_id"].dataType)
    bad = F.col("v").isNull() | F.col("part_id").isNull()
    return mesh_bounds(j.withColumn("part_id", F.when(bad, stop).otherwise(F.col("part_id"))), ("mesh_id", "part_id"))


def _edges(triangles: DataFrame, digits: int) -> DataFrame:
    key = lambda i: F.struct(*[(F.round(_point(i, a), digits) + F.lit(0.0)).alias(a) for a in AXES])
    keyed = triangles.select("mesh_id", "tri_id", *[key(i).alias(f"k{i}") for i in range(3)])
    sides = F.array(*[F.struct(F.col(f"k{i}").alias("a"), F.col(f"k{(i + 1) % 3}").alias("b")) for i in range(3)])
    flat = keyed.select("mesh_id", "tri_id", F.explode(sides).alias("e"))
    return flat.select("mesh_id", "tri_id", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"),
                       F.when(F.col("e.a") <= F.col("e.b"), 1).otherwise(-1).alias("dir"))


def mesh_audit(triangles: DataFrame, digits: int = 7, area: float = 1e-10, volume: float = 1e-12) -> DataFrame:
    """Topology and quality of every mesh: boundary, non-manifold, winding, duplicates, volume, components."""
    edges = _edges(triangles, digits)
    corner = lambda i: F.struct(*[(F.round(_point(i, a), digits) + F.lit(0.0)).alias(a) for a in AXES])
    per_edge = edges.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("dir").alias("s"))
    topo = per_edge.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("unique_edges"), F.count_if(F.col("n") == 1).alias("boundary_edges"),
        F.count_if(F.col("n") > 2).alias("nonmanifold_edges"), F.count_if((F.col("n") == 2) & (F.abs("s") == 2)).alias("winding_conflicts"))
    vertices = triangles.select("mesh_id", F.explode(F.array(*[corner(i) for i in range(3)])).alias("p")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("unique_vertices"))
    d = lambda i, a: _point(i, a) - _point(0, a)
    cross = [d(1, "y") * d(2, "z") - d(1, "z") * d(2, "y"), d(1, "z") * d(2, "x") - d(1, "x") * d(2, "z"), d(1, "x") * d(2, "y") - d(1, "y") * d(2, "x")]
    double_area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    triple = (
        _point(0, "x") * (_point(1, "y") * _point(2, "z") - _point(1, "z") * _point(2, "y"))
        + _point(0, "y") * (_point(1, "z") * _point(2, "x") - _point(1, "x") * _point(2, "z"))
        + _point(0, "z") * (_point(1, "x") * _point(2, "y") - _point(1, "y") * _point(2, "x")))
    face = F.array_sort(F.array(*[corner(i) for i in range(3)]))
    shape = triangles.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("triangle_count"), F.count_if(double_area <= area).alias("degenerate_triangles"), (F.sum(triple) / 6).alias("signed_volume"))
    faces = triangles.select("mesh_id", face.alias("f")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_faces"))
    out = shape
    for side in (topo, vertices, faces, face_components(triangles, edges)):  # one row per mesh each: no side goes through the driver
        out = out.join(side.hint("merge"), "mesh_id")
    c = F.col
    closed = (c("boundary_edges") == 0) & (c("nonmanifold_edges") == 0)
    out = out.withColumn("duplicate_triangles", c("triangle_count") - c("_faces")).withColumn(
        "euler_characteristic", c("unique_vertices") - c("unique_edges") + c("triangle_count")).withColumn("closed", closed).drop("_faces")
    from curatrix.functions.rules import reasons

    return out.withColumn("errors", reasons(
        (c("boundary_edges") > 0, "open_boundary_edges"), (c("nonmanifold_edges") > 0, "nonmanifold_edges"),
        (c("winding_conflicts") > 0, "inconsistent_winding"), (c("duplicate_triangles") > 0, "duplicate_triangles"),
        (c("degenerate_triangles") > 0, "degenerate_triangles"), (c("components") != 1, "multiple_or_zero_disconnected_face_components"),
        (F.abs("signed_volume") <= volume, "zero_volume")))


#: Faces of the meshes that one task joins on the average; a single mesh of more goes through ``graph``.
TASK_FACES = 500_000


def face_components(triangles: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected face groups per mesh over shared edges; every face links to the first face of an edge only.

    No component leaves its mesh, so meshes are dealt whole and joined in their task; only meshes too large for that go through the components of a graph.
    """
    sizes = triangles.groupBy("mesh_id").agg(F.count_distinct("tri_id").alias("_faces"))
    total, most = sizes.agg(F.sum("_faces"), F.max("_faces")).first()
    first = F.min("tri_id").over(W.partitionBy("mesh_id", "lo", "hi"))
    links = edges.select("mesh_id", "tri_id", first.alias("_t")).where(F.col("tri_id") != F.col("_t"))
    if (most or 0) <= TASK_FACES:
        return _whole(sizes, links, total or 0)
    large = sizes.where(F.col("_faces") > TASK_FACES).select("mesh_id")
    node = lambda c: F.struct(F.col("mesh_id"), F.col(c).alias("tri_id"))
    of = lambda df, how: df.join(large, "mesh_id", how)
    labels = connected_components(of(triangles, "left_semi").select(node("tri_id").alias("node")), of(links, "left_semi").select(node("tri_id").alias("src"), node("_t").alias("dst")))
    counts = labels.select("node.mesh_id", "component").groupBy("mesh_id").agg(F.count_distinct("component").alias("components"))
    return counts.unionByName(_whole(of(sizes, "left_anti"), of(links, "left_anti"), total))


def _whole(sizes: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """Face groups of meshes whose links lie in one task: faces less those that hang on a smaller one."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            mesh, a, b = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
            mesh, faces = mesh.dictionary_encode(), pa.concat_arrays([a, b]).dictionary_encode()
            codes, width = mesh.indices.to_numpy().astype(np.int64), len(faces.dictionary)
            u, v = faces.indices.to_numpy().astype(np.int64).reshape(2, -1) + codes * width
            nodes, root = folded(u, v)
            merged = np.bincount(nodes[root != np.arange(len(nodes))] // width, minlength=len(mesh.dictionary))
            yield pa.RecordBatch.from_arrays([mesh.dictionary, pa.array(merged, pa.int64())], names=["mesh_id", "_merged"])

    merged = links.repartition(1 + total // TASK_FACES, "mesh_id").mapInArrow(run, StructType([links.schema["mesh_id"], StructField("_merged", LongType())]))
    return sizes.join(merged.hint("merge"), "mesh_id", "left").select("mesh_id", (F.col("_faces") - F.coalesce("_merged", F.lit(0))).alias("components"))


def apply_transform(vertices: DataFrame, transforms: DataFrame, key: str, matrix: str = "m") -> DataFrame:
    """3x4 affine per key on vertex rows ``(key, x, y, z)``."""
    at = lambda r, k: F.get(matrix, F.lit(r * 4 + k))
    j = vertices.join(transforms, key)
    new = [at(r, 0) * F.col("x") + at(r, 1) * F.col("y") + at(r, 2) * F.col("z") + at(r, 3) for r in range(3)]
    return j.select(*[c for c in vertices.columns if c not in AXES], *[n.alias(a) for n, a in zip(new, AXES)])


def transform_triangles(triangles: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Part triangles placed by ``flatten_hierarchy`` occurrences ``(root, part, m, flip)``; flipped faces reverse."""
    at = lambda r, k: F.get("m", F.lit(r * 4 + k))
    moved = F.transform("v", lambda p: F.struct(*[
        (at(r, 0) * p["x"] + at(r, 1) * p["y"] + at(r, 2) * p["z"] + at(r, 3)).alias(a) for r, a in enumerate(AXES)]))
    j = triangles.withColumnRenamed("mesh_id", "part").join(occurrences, "part")
    out = j.select(F.col("root").alias("mesh_id"), "part", "tri_id", moved.alias("v"), "flip")
    turned = F.array(F.get("v", F.lit(0)), F.get("v", F.lit(2)), F.get("v", F.lit(1)))
    return out.withColumn("v", F.when(F.col("flip"), turned).otherwise(F.col("v"))).drop("flip")


def aabb_overlap_join(left: DataFrame, right: DataFrame, ident: str, width: float, eps: float = 1e-9, self_join: bool = False, same: Column | None = None, corners: bool = False) -> DataFrame:
    """Pairs of boxes ``(ident, x0, x1, y0, y1, z0, z1)`` that overlap on all axes.

    Boxes meet on the cells of the larger one's size class (``ranges.overlap_join``), of which ``width`` is the finest: a crowded stretch of one axis is split by the other two, and a box over all
    cells still lies in eight at most. ``corners`` keeps both boxes in the columns of ``box_metrics``, so that pairs need not meet their boxes again.
    """
    axes = [(f"{a}0", f"{a}1") for a in AXES]
    kept = [ident, *[c for axis in axes for c in axis], *[c for c in left.columns if c == "owner"]]
    pairs = overlap_join(left.select(*kept), right.select(*kept), axes, axes, width, eps, dealt=self_join)
    if self_join:
        pairs = pairs.where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    if same is not None:
        pairs = pairs.where(same)
    kept = [f"{s}_{c}" for s in "ab" for axis in axes for c in axis] if corners else []
    return pairs.select(F.col(f"a_{ident}").alias("left_id"), F.col(f"b_{ident}").alias("right_id"), *kept)


def _triangle_boxes(triangles: DataFrame, *columns: str) -> DataFrame:
    low = lambda a: F.least(*[_point(i, a) for i in range(3)])
    high = lambda a: F.greatest(*[_point(i, a) for i in range(3)])
    return triangles.select(*columns, F.col("mesh_id").alias("owner"), *[f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, low), (1, high))])


def collision_candidates(triangles: DataFrame, width: float, eps: float = 1e-9) -> DataFrame:
    """Pairs of triangles of different parts whose boxes overlap; ``tri_id`` must be unique."""
    boxes = _triangle_boxes(triangles, "tri_id")
    return aabb_overlap_join(boxes, boxes, "tri_id", width, eps, True, F.col("a_owner") != F.col("b_owner"))


#: Triangles of a mesh that may lie in one row, so that two meshes meet as a pair of rows.
ROW_TRIANGLES = 256
#: Pairs of boxes compared in one step.
BOX_STEP = 100_000
_BOX = [f"{a}{i}" for a in AXES for i in range(2)]


def collision_counts(triangles: DataFrame, width: float, eps: float = 1e-9) -> DataFrame:
    """``(left_part, right_part, triangle_pairs)``: how many pairs ``collision_candidates`` has for two parts. Triangles of a part with equal boxes, as the two halves of a flat face, meet the others as one box with their number.

    Parts of few triangles are a row each: two of them meet once, by their bounds, and their boxes are compared there, so no pair of triangles is a row and nothing is summed over a shuffle. Pairs with a larger part go triangle by triangle.
    """
    axes = [(f"{a}0", f"{a}1") for a in AXES]
    boxes = _triangle_boxes(triangles)
    boxes = boxes.groupBy(*boxes.columns).agg(F.count(F.lit(1)).alias("n"))
    large = triangles.groupBy(F.col("mesh_id").alias("owner")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROW_TRIANGLES).select("owner")
    some = not large.isEmpty()
    few = boxes.join(large, "owner", "left_anti") if some else boxes
    for low, high in axes:
        few = few.where(F.col(low) <= F.col(high))
    ends = [f(c).alias(c) for low, high in axes for f, c in ((F.min, low), (F.max, high))]
    meshes = few.where("owner is not null").groupBy("owner").agg(*ends, F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in (*_BOX, "n")]))).alias("boxes"))
    out = overlap_join(meshes, meshes, axes, axes, width, eps, each=("owner", StructType([
        StructField("left_part", boxes.schema["owner"].dataType), StructField("right_part", boxes.schema["owner"].dataType), StructField("triangle_pairs", LongType())]), lambda rows, a, b: _box_counts(rows, a, b, eps)))
    if not some:
        return out
    # both orders of a pair of a larger part and another one; two larger ones count once
    c = F.col
    marked = boxes.join(large.withColumn("_large", F.lit(True)), "owner", "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
    pairs = overlap_join(marked.where("_large"), marked, axes, axes, width, eps, dealt=True).where((c("a_owner") < c("b_owner")) | (~c("b__large") & (c("a_owner") > c("b_owner"))))
    return out.unionByName(pairs.groupBy(F.least("a_owner", "b_owner").alias("left_part"), F.greatest("a_owner", "b_owner").alias("right_part")).agg(F.sum(c("a_n") * c("b_n")).alias("triangle_pairs")))


def _box_counts(rows: pa.RecordBatch, a: np.ndarray, b: np.ndarray, eps: float):
    """Pairs of owners and the number of pairs of their triangles whose boxes overlap; rows in which none do are left out."""
    lists = rows.column("boxes")
    width, at = len(_BOX) + 1, lists.offsets.to_numpy()
    values = np.ascontiguousarray(lists.values.to_numpy().reshape(-1, width).T)
    first, many = at[:-1] // width, np.diff(at) // width
    total = np.zeros(len(a), np.int64)
    kinds = many[a] * (ROW_TRIANGLES + 1) + many[b]
    for kind in np.unique(kinds):  # pairs of as many boxes each
        of = np.flatnonzero(kinds == kind)
        n, m = divmod(int(kind), ROW_TRIANGLES + 1)
        for start in range(0, len(of), step := max(1, BOX_STEP // (n * m))):
            now = of[start: start + step]
            p, q = (first[side[now]] + np.arange(k)[:, None] for side, k in ((a, n), (b, m)))  # (box, pair)
            met = np.ones((n, m, len(now)), bool)
            for low, high in ((values[i], values[i + 1]) for i in range(0, width - 1, 2)):
                met &= low[p][:, None] <= (high[q] + eps)[None]
                met &= (high[p] + eps)[:, None] >= low[q][None]
            total[now] = np.einsum("ijk,ik,jk->k", met, values[-1][p], values[-1][q]).astype(np.int64)
    some = np.flatnonzero(total)
    owner = rows.column("owner")
    if len(some):
        yield pa.RecordBatch.from_arrays([owner.take(pa.array(a[some])), owner.take(pa.array(b[some])), pa.array(total[some])], names=["left_part", "right_part", "triangle_pairs"])


def slice_range_join(items: DataFrame, heights: DataFrame, low: str, high: str, height: str, width: float) -> DataFrame:
    """Rows whose interval ``[low, high]`` contains a height: points meet intervals on the cells of the interval's size class, ``width`` the finest."""
    pairs = overlap_join(items, heights, [(low, high)], [(height, height)], width)
    return pairs.select(*[F.col(f"a_{c}").alias(c) for c in items.columns], *[F.col(f"b_{c}").alias(c) for c in heights.columns])


def mesh_profile(triangles: DataFrame, samples: int = 101, vertical: str = "z", front: str = "x", side: str = "y", eps: float = 1e-9) -> DataFrame:
    """Front and side span per normalised height of every mesh.

    Each triangle is expanded only to the sample heights it crosses, so the work follows the crossings. Bounds meet their triangles by a shuffle (or as they lie, where triangles
    are dealt by mesh): the planner takes a mesh for as small as its unexpanded row and would broadcast it. Heights that nothing crosses are added as rows without a point.
    """
    if len({vertical, front, side}) != 3 or samples < 2:
        raise ValueError("axes must be distinct and samples at least 2")
    bounds = mesh_bounds(triangles).select("mesh_id", F.col(f"min_{vertical}").alias("base"), F.col(f"size_{vertical}").alias("tall"))
    n = samples - 1
    low, high = F.least(*[_point(i, vertical) for i in range(3)]), F.greatest(*[_point(i, vertical) for i in range(3)])
    bounds = bounds.where("tall > 0")
    j = triangles.join(bounds.hint("merge"), "mesh_id")
    first = F.greatest(F.lit(0), F.floor((low - F.col("base")) / F.col("tall") * n - 1e-6)).cast("int")
    last = F.least(F.lit(n), F.ceil((high - F.col("base")) / F.col("tall") * n + 1e-6)).cast("int")
    cut = j.withColumn("step", F.explode(F.sequence(first, last))).withColumn("height_norm", F.col("step") / n)
    cut = cut.withColumn("plane", F.col("base") + F.col("height_norm") * F.col("tall"))
    points = []
    for i, k in ((0, 1), (1, 2), (2, 0)):
        da, db = _point(i, vertical) - F.col("plane"), _point(k, vertical) - F.col("plane")
        at = lambda t: F.struct(*[(_point(i, a) + t * (_point(k, a) - _point(i, a))).alias(a) for a in (front, side)])
        points += [F.when(F.abs(da) <= eps, at(F.lit(0.0))), F.when(F.abs(db) <= eps, at(F.lit(1.0))),
                   F.when(((da < -eps) & (db > eps)) | ((da > eps) & (db < -eps)), at((F.col("plane") - _point(i, vertical)) / (_point(k, vertical) - _point(i, vertical))))]
    flat = cut.select("mesh_id", "step", "height_norm", "tall", F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())).alias("p"))
    grid = bounds.select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"), "tall").withColumn("height_norm", F.col("step") / n)
    out = flat.unionByName(grid, allowMissingColumns=True).groupBy("mesh_id", "step", "height_norm", "tall").agg(
        *[f(f"p.{a}").alias(f"{name}_{m}") for name, a in (("front", front), ("side", side)) for m, f in (("min", F.min), ("max", F.max))])
    for name in ("front", "side"):
        out = out.withColumn(f"{name}_span", F.coalesce(F.col(f"{name}_max") - F.col(f"{name}_min"), F.lit(0.0))).withColumn(
            f"{name}_span_over_height", F.col(f"{name}_span") / F.col("tall"))
    return out.drop("tall")


def normalise_landmarks(landmarks: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Pixel landmarks to body-height units: x from the box centre, z up from its bottom."""
    j = landmarks.join(boxes, key)
    tall = F.col("bottom") - F.col("top")
    return j.select(key, "label", ((F.col("x_px") - (F.col("left") + F.col("right")) / 2) / tall).alias("x"),
                    ((F.col("bottom") - F.col("y_px")) / tall).alias("z"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def landmark_loss(observed: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Confidence-weighted mean squared distance per reference; ``model(label, mx, mz)``."""
    j = observed.join(model, "label").where("confidence > 0")
    mse = ((F.col("mx") - F.col("x")) * (F.col("mx") - F.col("x")) + (F.col("mz") - F.col("z")) * (F.col("mz") - F.col("z"))) / 2
    return j.groupBy(key).agg((F.sum(F.col("confidence") * mse) / F.sum("confidence")).alias("loss"), F.count(F.lit(1)).alias("matched_landmarks"))


def envelope_spans(df: DataFrame, key: str) -> DataFrame:
    """Silhouette spans over body height from maps of ``struct<low,high,confidence>`` and a box height."""
    part = lambda c, o: df.select(key, "body_height", F.explode(c).alias("name", "p")).withColumn("orientation", F.lit(o))
    flat = part("horizontal", "horizontal").unionByName(part("vertical", "vertical"))
    stop = F.raise_error(F.lit("invalid body box")).cast("double")
    tall = F.when(F.col("body_height") > 0, F.col("body_height")).otherwise(stop)
    span = F.col("p.high") - F.col("p.low")
    return flat.select(key, "name", "orientation", span.alias("span_px"), (span / tall).alias("span_over_body_height"), F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"))


def box_metrics(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Volumes, intersection, union box volume and IoU of two boxes in columns ``{a}_x0`` ..."""
    c = F.col
    volume = lambda s: (c(f"{s}_x1") - c(f"{s}_x0")) * (c(f"{s}_y1") - c(f"{s}_y0")) * (c(f"{s}_z1") - c(f"{s}_z0"))
    side = lambda ax: F.greatest(F.lit(0.0), F.least(c(f"{a}_{ax}1"), c(f"{b}_{ax}1")) - F.greatest(c(f"{a}_{ax}0"), c(f"{b}_{ax}0")))
    hull = lambda ax: F.greatest(c(f"{a}_{ax}1"), c(f"{b}_{ax}1")) - F.least(c(f"{a}_{ax}0"), c(f"{b}_{ax}0"))
    inter = side("x") * side("y") * side("z")
    out = pairs.withColumn("volume_a", volume(a)).withColumn("volume_b", volume(b)).withColumn("intersection", inter).withColumn(
        "union_box_volume", hull("x") * hull("y") * hull("z"))
    total = c("volume_a") + c("volume_b") - c("intersection")
    return out.withColumn("iou", F.when(total > 0, c("intersection") / total).otherwise(0.0))


def status_rollup(results: DataFrame, status: str) -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
