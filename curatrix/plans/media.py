"""Pixel, box and embedding operators over the driver tables."""

from pyspark.sql import functions as F

from curatrix.operators import geometry, media, neighbours
from curatrix.plans.registry import query

BOX_SQL = "select p_partkey as id, (p_partkey * 37 % 1009)::double as x0, (p_partkey * 37 % 1009 + 4 + p_size % 7)::double as x1, (p_partkey * 53 % 499)::double as y0, (p_partkey * 53 % 499 + 6 + p_size % 5)::double as y1, (p_size % 40)::double as z0, (p_size % 40 + 5)::double as z1 from part"


def boxes(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, z = k * 37 % 1009, k * 53 % 499, s % 40
    d = lambda c: c.cast("double")
    return t.part.select(k.alias("id"), d(x).alias("x0"), d(x + 4 + s % 7).alias("x1"), d(y).alias("y0"), d(y + 6 + s % 5).alias("y1"), d(z).alias("z0"), d(z + 5).alias("z1"))


OVERLAP_SQL = f"with b as ({BOX_SQL}) select a.id as left_id, b.id as right_id from b a join b b on a.id < b.id and a.x0 <= b.x1 + 1e-9 and a.x1 + 1e-9 >= b.x0 and a.y0 <= b.y1 + 1e-9 and a.y1 + 1e-9 >= b.y0 and a.z0 <= b.z1 + 1e-9 and a.z1 + 1e-9 >= b.z0"


@query("aabb_overlap_join", OVERLAP_SQL)
def aabb_overlap_join(t):
    return geometry.aabb_overlap_join(boxes(t), boxes(t), "id", 12.0, self_join=True)


@query("box_iou", f"""
with p as ({OVERLAP_SQL}), b as ({BOX_SQL}), j as (select left_id, right_id, a.x0 as ax0, a.x1 as ax1, a.y0 as ay0, a.y1 as ay1, a.z0 as az0, a.z1 as az1, b.x0, b.x1, b.y0, b.y1, b.z0, b.z1 from p join b a on a.id = left_id join b b on b.id = right_id),
 m as (select *, greatest(0.0, least(ax1, x1) - greatest(ax0, x0)) * greatest(0.0, least(ay1, y1) - greatest(ay0, y0)) * greatest(0.0, least(az1, z1) - greatest(az0, z0)) as i, (ax1 - ax0) * (ay1 - ay0) * (az1 - az0) as va, (x1 - x0) * (y1 - y0) * (z1 - z0) as vb,
   (greatest(ax1, x1) - least(ax0, x0)) * (greatest(ay1, y1) - least(ay0, y0)) * (greatest(az1, z1) - least(az0, z0)) as ub from j)
select left_id, right_id, va as volume_a, vb as volume_b, i as intersection, ub as union_box_volume, round(i / (va + vb - i), 6) as iou from m""")
def box_iou(t):
    b = boxes(t)
    pairs = geometry.aabb_overlap_join(b, b, "id", 12.0, self_join=True, corners=True)
    out = geometry.box_metrics(pairs)
    return out.select("left_id", "right_id", "volume_a", "volume_b", "intersection", "union_box_volume", F.round("iou", 6).alias("iou"))


@query("slice_range_join", f"with b as ({BOX_SQL}), h as (select distinct (n_nationkey * 2)::double as h from nation) select id, h as height from b join h on z0 <= h and h <= z1")
def slice_range_join(t):
    heights = t.nation.select((F.col("n_nationkey") * 2).cast("double").alias("height")).distinct()
    return geometry.slice_range_join(boxes(t), heights, "z0", "z1", "height", 8.0).select("id", "height")


PIXEL_SQL = "select l_orderkey % 97 as asset, (l_linenumber * 8 + l_suppkey % 8)::int as x, (l_partkey % 64)::int as y, (l_quantity * 5)::int as r, (l_partkey % 256)::int as g, (l_discount * 1000)::int as b, case when l_returnflag = 'N' then 0 else 255 end as a from lineitem"
REGION_SQL = "select n_nationkey as id, (n_nationkey % 5) * 12 as x0, (n_nationkey // 5) * 12 as y0, (n_nationkey % 5) * 12 + 16 as x1, (n_nationkey // 5) * 12 + 16 as y1 from nation"


def pixels(t):
    i = lambda c: c.cast("int")
    return t.lineitem.select((F.col("l_orderkey") % 97).alias("asset"), i(F.col("l_linenumber") * 8 + F.col("l_suppkey") % 8).alias("x"), i(F.col("l_partkey") % 64).alias("y"), i(F.col("l_quantity") * 5).alias("r"),
                             i(F.col("l_partkey") % 256).alias("g"), i(F.round(F.col("l_discount") * 1000)).alias("b"), F.when(F.col("l_returnflag") == "N", 0).otherwise(255).alias("a"))


def regions(t):
    k = F.col("n_nationkey")
    x, y = k % 5 * 12, F.expr("n_nationkey div 5 * 12").cast("int")
    return t.nation.select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 16).alias("x1"), (y + 16).alias("y1"), F.array(F.lit(100), F.lit(100), F.lit(50), F.lit(255)).alias("target"), F.lit(90).alias("max_channel_delta"), F.lit(0.05).alias("minimum_match_fraction"))


@query("pixel_region_join", f"with p as ({PIXEL_SQL}), q as ({REGION_SQL}) select id, count(*) as pixels, count(distinct asset) as assets from p join q on x >= x0 and x < x1 and y >= y0 and y < y1 group by 1")
def pixel_region_join(t):
    return media.pixel_region_join(pixels(t), regions(t)).groupBy("id").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("asset").alias("assets"))


@query("flat_colour_match", f"""with p as ({PIXEL_SQL}), q as ({REGION_SQL}), j as (select *, greatest(abs(r - 100), abs(g - 100), abs(b - 50), abs(a - 255)) as d from p join q on x >= x0 and x < x1 and y >= y0 and y < y1)
select asset, id, count(*) as sampled_pixels, count_if(d <= 90) as matching_pixels, max(d) as observed_max_channel_delta, min(a) as alpha_min, max(a) as alpha_max, count(distinct (r, g, b, a)) as unique_colours, round(count_if(d <= 90) / count(*), 6) as match_fraction, count_if(d <= 90) / count(*) >= 0.05 as passed from j group by 1, 2""")
def flat_colour_match(t):
    return media.flat_colour_match(pixels(t), regions(t)).drop("minimum_match_fraction").withColumn("match_fraction", F.round("match_fraction", 6))


MASK_SQL = f"m as (select distinct asset, x, y, case when r > 125 then 'reference_silhouette' else 'candidate_silhouette' end as role from ({PIXEL_SQL}))"


@query("mask_overlap", f"with {MASK_SQL}, f as (select asset, x, y, max((role = 'reference_silhouette')::int) as a, max((role = 'candidate_silhouette')::int) as b from m group by 1, 2, 3) select asset, sum(a * b)::bigint as intersection, count(*) as \"union\", round(sum(a * b) / count(*), 6) as iou from f group by 1")
def mask_overlap(t):
    m = pixels(t).select("asset", "x", "y", F.when(F.col("r") > 125, "reference_silhouette").otherwise("candidate_silhouette").alias("role"))
    return media.mask_overlap(m, "reference_silhouette", "candidate_silhouette").withColumn("iou", F.round("iou", 6))


@query("foreground_bbox", f"""with p as ({PIXEL_SQL}), s as (select asset, max(x) + 1 as w, max(y) + 1 as h from p group by 1), f as (select asset, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from p where a > 20 group by 1)
select asset, round(x0 / w, 4) as x0, round(y0 / h, 4) as y0, round(x1 / w, 4) as x1, round(y1 / h, 4) as y1, round((x1 - x0) * (y1 - y0) / (w * h), 4) as occupancy from s join f using (asset)""")
def foreground_bbox(t):
    return media.foreground_bbox(pixels(t))


@query("pixel_features")
def pixel_features(t):
    """Feature row per image over one pixel per position (the brightest line item wins a position)."""
    one = pixels(t).groupBy("asset", "y", "x").agg(F.max(F.struct("r", "g", "b", "a")).alias("p")).select("asset", "y", "x", "p.*")
    return media.pixel_features(one)


@query("feature_delta", """
with s as (select l_orderkey, l_partkey as sk, l_suppkey as tk from lineitem), a as (select p_partkey as sk, case when p_size % 9 = 0 then 0 else p_size / 50.0 end as e, p_size % 8 as p, p_size / 60.0 as o from part), b as (select s_suppkey as tk, (s_suppkey % 40) / 40.0 as e, s_suppkey % 6 as p, (s_suppkey % 10) / 10.0 as o from supplier)
select l_orderkey, sk, tk, round(b.e - a.e, 5)::double as edge_delta, case when a.e <> 0 then round(b.e / a.e, 4) end::double as edge_ratio, (b.p - a.p)::bigint as palette_delta, round(b.o - a.o, 4)::double as occupancy_delta, a.e <> 0 and b.e < a.e * 0.85 as lower_edge_density, b.p < a.p as smaller_palette, abs(b.o - a.o) >= 0.15 as large_bbox_change from s join a using (sk) join b using (tk)""")
def feature_delta(t):
    src = t.part.select("p_partkey", F.when(F.col("p_size") % 9 == 0, 0.0).otherwise(F.col("p_size") / 50.0).alias("edge_density"), (F.col("p_size") % 8).alias("palette"), (F.col("p_size") / 60.0).alias("occupancy"))
    tgt = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 40 / 40.0).alias("edge_density"), (F.col("s_suppkey") % 6).alias("palette"), (F.col("s_suppkey") % 10 / 10.0).alias("occupancy"))
    pairs = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("sk"), F.col("l_suppkey").alias("tk"))
    return media.feature_delta(pairs, src, tgt, "sk", "tk")


@query("embedding_index", """
with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings)
select vec_id, 'embedding-' || left(sha256(to_json(['embedding', 'driver-model', vec_id::varchar])), 24) as record_id, 'driver-model' as model, len(embedding)::int as dimension, round(norm, 5) as norm, round(embedding[1]::double / norm, 5) as first_value from n""")
def embedding_index(t):
    e = media.embedding_index(t.embeddings, "vec_id", "embedding", "driver-model")
    return e.select("vec_id", "record_id", "model", "dimension", F.round("norm", 5).alias("norm"), F.round(F.get("unit", F.lit(0)), 5).alias("first_value"))


@query("nearest_neighbours", """
with n as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings),
 p as (select a.vec_id as query_id, b.vec_id as neighbour_id, round(list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])), 6) as cosine from n a join n b on a.vec_id <> b.vec_id),
 r as (select *, row_number() over (partition by query_id order by cosine desc, neighbour_id) as rank from p)
select query_id, neighbour_id, cosine, rank::int as rank from r where rank <= 3""")
def nearest_neighbours(t):
    e = media.embedding_index(t.embeddings, "vec_id", "embedding", "driver-model")
    vectors = e.select("vec_id", "unit")
    return neighbours.nearest_neighbours(vectors, vectors, "vec_id", "unit", 3)


@query("status_rollup", "select o_orderstatus, count(*) as n from orders group by 1")
def status_rollup(t):
    return geometry.status_rollup(t.orders, "o_orderstatus")
