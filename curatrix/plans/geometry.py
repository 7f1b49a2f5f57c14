"""Meshes, hierarchies, landmarks and component rules derived from the driver tables."""

from pyspark.sql import functions as F

from curatrix.functions import components as C
from curatrix.operators import geometry, graph, media, queues, review
from curatrix.plans.media import BOX_SQL, MASK_SQL, boxes, pixels
from curatrix.plans.registry import query
from curatrix.sources import readers

# Corners of a box as (x, y, z) ends, and its twelve outward triangles.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
FACES = ((0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7))


# Meshes in one task: a box is a short row but makes twelve triangles.
TASK_MESHES = 10_000


def box_meshes(t):
    """Every part's box as a closed mesh of twelve triangles, dealt by mesh before the rows multiply."""
    corner = lambda c: F.struct(*[F.col(f"{a}{end}").alias(a) for a, end in zip("xyz", c)])
    faces = F.array(*[F.struct(F.lit(i).alias("tri_id"), F.array(*[corner(CORNERS[k]) for k in f]).alias("v")) for i, f in enumerate(FACES)])
    dealt = boxes(t).withColumnRenamed("id", "mesh_id").repartition(1 + t.part.count() // TASK_MESHES, "mesh_id")
    return dealt.select("mesh_id", F.explode(faces).alias("f")).select("mesh_id", "f.*")


@query("mesh_bounds", f"select id as mesh_id, 12 as triangle_count, x0 as min_x, x1 as max_x, y0 as min_y, y1 as max_y, z0 as min_z, z1 as max_z, x1 - x0 as size_x, y1 - y0 as size_y, z1 - z0 as size_z, (x0 + x1) / 2 as centre_x, (y0 + y1) / 2 as centre_y, (z0 + z1) / 2 as centre_z from ({BOX_SQL})")
def mesh_bounds(t):
    return geometry.mesh_bounds(box_meshes(t))


@query("mesh_audit", f"select id as mesh_id, 12 as triangle_count, 0 as degenerate_triangles, round((x1 - x0) * (y1 - y0) * (z1 - z0), 4) as signed_volume, 18 as unique_edges, 0 as boundary_edges, 0 as nonmanifold_edges, 0 as winding_conflicts, 8 as unique_vertices, 1 as components, 0 as duplicate_triangles, 2 as euler_characteristic, true as closed, '' as errors from ({BOX_SQL})")
def mesh_audit(t):
    return geometry.mesh_audit(box_meshes(t)).withColumn("errors", F.array_join("errors", ",")).withColumn("signed_volume", F.round("signed_volume", 4))


@query("mesh_profile", f"select id as mesh_id, step::int as step, round(x1 - x0, 6) as front_span, round(y1 - y0, 6) as side_span, round((x1 - x0) / (z1 - z0), 6) as front_span_over_height from ({BOX_SQL}), range(5) r(step)")
def mesh_profile(t):
    out = geometry.mesh_profile(box_meshes(t), 5)
    return out.select("mesh_id", "step", F.round("front_span", 6).alias("front_span"), F.round("side_span", 6).alias("side_span"), F.round("front_span_over_height", 6).alias("front_span_over_height"))


@query("part_bounds_by_label", f"select id as mesh_id, part_id::int as part_id, x0 as min_x, x1 as max_x, y0 as min_y, y1 as max_y, z0 as min_z, z1 as max_z, 6 as triangle_count from ({BOX_SQL}), range(2) r(part_id)")
def part_bounds_by_label(t):
    mesh = box_meshes(t)
    labels = mesh.select("mesh_id", "tri_id", F.expr("tri_id div 6").cast("int").alias("part_id"))
    return geometry.part_bounds(mesh, labels).select("mesh_id", "part_id", *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")], "triangle_count")


# Which box ends a triangle spans on each axis, for the SQL side.
SPANS = ", ".join("(" + ", ".join(str(f(CORNERS[k][a] for k in face)) for a in range(3) for f in (min, max)) + ")" for face in FACES)
COLLISION_SQL = f"""
with b as ({BOX_SQL}), f(xa, xb, ya, yb, za, zb) as (values {SPANS}),
 p as (select a.*, b.id as id2, b.x0 as u0, b.x1 as u1, b.y0 as v0, b.y1 as v1, b.z0 as w0, b.z1 as w1 from b a join b on a.id < b.id and a.x0 <= b.x1 + 1e-9 and a.x1 + 1e-9 >= b.x0 and a.y0 <= b.y1 + 1e-9 and a.y1 + 1e-9 >= b.y0 and a.z0 <= b.z1 + 1e-9 and a.z1 + 1e-9 >= b.z0),
 t as (select id, id2, x0 + f.xa * (x1 - x0) as a0, x0 + f.xb * (x1 - x0) as a1, y0 + f.ya * (y1 - y0) as b0, y0 + f.yb * (y1 - y0) as b1, z0 + f.za * (z1 - z0) as c0, z0 + f.zb * (z1 - z0) as c1,
   u0 + g.xa * (u1 - u0) as d0, u0 + g.xb * (u1 - u0) as d1, v0 + g.ya * (v1 - v0) as e0, v0 + g.yb * (v1 - v0) as e1, w0 + g.za * (w1 - w0) as h0, w0 + g.zb * (w1 - w0) as h1 from p, f, f as g)
select id as left_part, id2 as right_part, count(*) as triangle_pairs from t where a0 <= d1 + 1e-9 and a1 + 1e-9 >= d0 and b0 <= e1 + 1e-9 and b1 + 1e-9 >= e0 and c0 <= h1 + 1e-9 and c1 + 1e-9 >= h0 group by 1, 2"""


@query("collision_candidates", COLLISION_SQL)
def collision_candidates(t):
    """Triangle pairs of different parts with overlapping boxes, counted per pair of parts."""
    return geometry.collision_counts(box_meshes(t), 12.0)


@query("apply_transform", f"select id, 2 * x0 - y0 + 10 as x, x0 + y0 as y, 0.5 * z0 + id % 7 as z from ({BOX_SQL})")
def apply_transform(t):
    v = boxes(t).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))
    cells = [2.0, -1.0, 0.0, 10.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.5]
    m = boxes(t).select("id", F.array(*[F.lit(c) for c in cells], (F.col("id") % 7).cast("double")).alias("m"))
    return geometry.apply_transform(v, m, "id")


@query("hierarchy_flatten", """
with l as (select 'o' || l_orderkey as root, 'p' || l_partkey as part, l_quantity as dx, l_returnflag = 'R' as mirrored, p_brand, p_size from lineitem join part on l_partkey = p_partkey)
select 'o' || o_orderkey as root, 'o' || o_orderkey as part, 0 as depth, 0.0::double as x, false as flip, count(*) as n from orders group by 1, 2
union all select root, part, 1, dx, mirrored, count(*) from l group by 1, 2, 4, 5
union all select root, 'b' || p_brand, 2, dx + case when mirrored then -p_size else p_size end, mirrored, count(*) from l group by 1, 2, 4, 5""")
def hierarchy_flatten(t):
    """Orders place parts (some mirrored), parts place their brand's mould."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    move = lambda x, sx: F.array(sx, F.lit(0.0), F.lit(0.0), x.cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    one = F.lit(1.0)
    placed = t.lineitem.select(key("o", "l_orderkey").alias("parent"), key("p", "l_partkey").alias("child"), F.col("l_linenumber").alias("line_no"), move(F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)).alias("m"))
    mould = t.part.select(key("p", "p_partkey").alias("parent"), key("b", "p_brand").alias("child"), F.lit(1).alias("line_no"), move(F.col("p_size"), one).alias("m"))
    known = t.orders.select(key("o", "o_orderkey").alias("part")).unionByName(mould.select(F.col("parent").alias("part"))).unionByName(mould.select(F.col("child").alias("part")))
    out, _ = graph.flatten_hierarchy(t.orders.select(key("o", "o_orderkey").alias("part")), placed.unionByName(mould), known)
    return out.groupBy("root", "part", "depth", F.get("m", F.lit(3)).alias("x"), "flip").agg(F.count(F.lit(1)).alias("n"))


@query("landmark_error", """
with g as (select o_custkey as asset, o_orderpriority as label, min(o_totalprice) / 1000 as rx, max(o_totalprice) / 1000 as cx, min(o_orderkey) % 50 as ry, max(o_orderkey) % 50 as cy from orders group by 1, 2), d as (select asset, sqrt((rx - cx) * (rx - cx) + (ry - cy) * (ry - cy)) / sqrt(640.0 * 640 + 480 * 480) as d from g)
select asset, count(*) as landmark_count, round(avg(d), 6) as landmark_error, round(max(d), 6) as landmark_max_error from d group by 1""")
def landmark_error(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("asset"), F.col("o_orderpriority").alias("label")).agg(
        *[f(c).alias(n) for n, f, c in (("rx", F.min, "o_totalprice"), ("cx", F.max, "o_totalprice"), ("ry", F.min, "o_orderkey"), ("cy", F.max, "o_orderkey"))])
    role = lambda name, x, y: F.struct(F.lit(name).alias("role"), (F.col(x) / 1000).alias("x"), (F.col(y) % 50).cast("double").alias("y"))
    marks = g.select("asset", "label", F.explode(F.array(role("reference", "rx", "ry"), role("candidate", "cx", "cy"))).alias("p")).select("asset", "label", "p.*")
    grid = t.orders.select(F.col("o_custkey").alias("asset"), F.lit(640).alias("w"), F.lit(480).alias("h")).distinct()
    out = media.landmark_error(marks, grid)
    return out.select("asset", "landmark_count", F.round("landmark_error", 6).alias("landmark_error"), F.round("landmark_max_error", 6).alias("landmark_max_error"))


@query("threshold_checks", f"""with {MASK_SQL}, f as (select asset, x, y, max((role = 'reference_silhouette')::int) as a, max((role = 'candidate_silhouette')::int) as b from m group by 1, 2, 3), i as (select asset, sum(a * b) / count(*) as iou from f group by 1)
select asset, case when iou >= 0.05 then 'technical_checks_passed' else 'technical_checks_failed' end as status from i""")
def threshold_checks(t):
    m = pixels(t).select("asset", "x", "y", F.when(F.col("r") > 125, "reference_silhouette").otherwise("candidate_silhouette").alias("role"))
    iou = media.mask_overlap(m, "reference_silhouette", "candidate_silhouette").select("asset", F.lit("silhouette_iou").alias("metric"), F.col("iou").alias("value"))
    return media.check_status(media.threshold_checks(iou, {"silhouette_iou": 0.05}))


@query("print_containment", """
with p as (select distinct l_orderkey % 97 as asset, l_linenumber * 8 + l_suppkey % 8 as x, l_partkey % 64 as y, case when l_returnflag = 'R' then 'a' when l_returnflag = 'A' then 's' else 'k' end as role from lineitem),
 f as (select asset, x, y, max((role = 'a')::int) as a, max((role = 's')::int) as s, max((role = 'k')::int) as k from p group by 1, 2, 3)
select asset, sum(a)::bigint as art_pixels, count_if(a = 1 and (s = 0 or k = 1)) as art_outside_safe_zone, sum(a * k)::bigint as art_in_keepout, round(1 - count_if(a = 1 and (s = 0 or k = 1)) / sum(a), 6) as print_zone_containment from f group by 1""")
def print_containment(t):
    role = F.when(F.col("l_returnflag") == "R", "art_mask").when(F.col("l_returnflag") == "A", "safe_zone").otherwise("keepout_mask")
    m = t.lineitem.select((F.col("l_orderkey") % 97).alias("asset"), (F.col("l_linenumber") * 8 + F.col("l_suppkey") % 8).alias("x"), (F.col("l_partkey") % 64).alias("y"), role.alias("role"))
    return media.print_containment(m).withColumn("print_zone_containment", F.round("print_zone_containment", 6))


@query("normalise_landmarks", """select l_orderkey as ref, l_linenumber::varchar as label, round((l_quantity - (o_custkey % 40 + 60) / 2.0) / (100 + o_custkey % 9), 6) as x, round((110 + o_custkey % 9 - l_discount * 100) / (100 + o_custkey % 9), 6) as z, case when l_tax = 0 then 1.0 else l_tax end::double as confidence from lineitem join orders on l_orderkey = o_orderkey""")
def normalise_landmarks(t):
    return _landmarks(t).withColumn("x", F.round("x", 6)).withColumn("z", F.round("z", 6))


def _landmarks(t):
    k = F.col("o_custkey")
    box = t.orders.select(F.col("o_orderkey").alias("ref"), F.lit(0.0).alias("left"), F.lit(10.0).alias("top"), (k % 40 + 60).cast("double").alias("right"), (k % 9 + 110).cast("double").alias("bottom"))
    marks = t.lineitem.select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").cast("string").alias("label"), F.col("l_quantity").alias("x_px"), (F.col("l_discount") * 100).alias("y_px"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("confidence"))
    return geometry.normalise_landmarks(marks, box, "ref")


@query("landmark_loss", """
with n as (select l_orderkey as ref, l_linenumber as ln, (l_quantity - (o_custkey % 40 + 60) / 2.0) / (100 + o_custkey % 9) as x, (110 + o_custkey % 9 - l_discount * 100) / (100 + o_custkey % 9) as z, case when l_tax = 0 then 1.0 else l_tax end as c from lineitem join orders on l_orderkey = o_orderkey),
 m as (select l_linenumber as ln, avg(l_quantity) / 1000 as mx, avg(l_discount) as mz from lineitem group by 1)
select ref, round(sum(c * ((mx - x) * (mx - x) + (mz - z) * (mz - z)) / 2) / sum(c), 6) as loss, count(*) as matched_landmarks from n join m using (ln) group by 1""")
def landmark_loss(t):
    model = t.lineitem.groupBy(F.col("l_linenumber").cast("string").alias("label")).agg((F.avg("l_quantity") / 1000).alias("mx"), F.avg("l_discount").alias("mz"))
    return geometry.landmark_loss(_landmarks(t), model, "ref").withColumn("loss", F.round("loss", 6))


@query("envelope_spans", """select p_partkey, 'hip' as name, 'horizontal' as orientation, p_size::double as span_px, round(p_size / (50.0 + p_size), 6) as span_over_body_height, 1.0::double as confidence from part union all select p_partkey, 'leg', 'vertical', 2.0 * p_size, round(2.0 * p_size / (50.0 + p_size), 6), 0.5 from part""")
def envelope_spans(t):
    s = F.col("p_size").cast("double")
    span = lambda lo, hi, c: F.struct(lo.alias("low"), hi.alias("high"), c.cast("double").alias("confidence"))
    rows = t.part.select("p_partkey", (s + 50).alias("body_height"), F.create_map(F.lit("hip"), span(s, s * 2, F.lit(None))).alias("horizontal"), F.create_map(F.lit("leg"), span(F.lit(0.0), s * 2, F.lit(0.5))).alias("vertical"))
    return geometry.envelope_spans(rows, "p_partkey").withColumn("span_over_body_height", F.round("span_over_body_height", 6))


@query("image_part_index", """select l_orderkey, l_linenumber, 'P' || l_partkey || case when l_returnflag = 'R' then '-front' when l_returnflag = 'A' then '_2' else '' end as stem, p_size <= 40 as matched, case when p_size <= 40 then p_name end as part_name from lineitem join part on l_partkey = p_partkey""")
def image_part_index(t):
    tail = F.when(F.col("l_returnflag") == "R", "-front").when(F.col("l_returnflag") == "A", "_2").otherwise("")
    images = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string"), tail).alias("stem"))
    parts = t.part.select(F.concat(F.when(F.col("p_size") <= 40, "P").otherwise("Q"), F.col("p_partkey").cast("string")).alias("number"), "p_name")
    return media.image_part_index(images, parts, "stem", "number").select("l_orderkey", "l_linenumber", "stem", "matched", F.col("part.p_name").alias("part_name"))


@query("apply_corrections", """
with r as (select event_id, event_type as tab, 'User ' || user_id as name, printf('%.2f', value) as v from events),
 f as (select event_id as id, case when event_id % 5 = 0 then 'someone' when event_id % 5 = 1 then '' else ' user  ' || user_id end as expected, event_id % 2 = 0 as renames, event_id % 3 = 0 as clears, 'why ' || event_id % 4 as why from events where event_id % 7 < 4),
 j as (select r.*, f.*, id is not null and (expected = '' or expected <> 'someone') as ok from r left join f on id = event_id and tab <> 'view')
select event_id, case when not ok or not (renames or clears) then 'name=' || name || ';value=' || v else 'name=' || case when renames then 'renamed' else name end || ';value=' || case when clears then '' else v end end as fields,
 case when ok then concat_ws(';', case when renames then 'name=' || name end, case when clears then 'value=' || v end) end as original, case when ok then why end as rationale from j""")
def apply_corrections(t):
    """Fields of the event rows under a table of corrections; those that expect another name do not hold."""
    k = F.col("event_id")
    rows = t.events.select("event_id", F.col("event_type").alias("tab"), F.create_map(F.lit("name"), F.concat(F.lit("User "), "user_id"), F.lit("value"), F.format_string("%.2f", "value")).alias("fields"))
    none = F.create_map().cast("map<string,string>")
    wanted = t.events.select(
        # A correction names row and tab; those of other rows, and of the tab that has none, carry a key that no row has.
        F.when(k % 7 < 4, k).otherwise(-k - 1).alias("event_id"), F.when(F.col("event_type") == "view", "other").otherwise(F.col("event_type")).alias("tab"),
        F.when(k % 5 == 0, "someone").when(k % 5 == 1, "").otherwise(F.concat(F.lit(" user  "), "user_id")).alias("expected_name"), F.when(k % 2 == 0, F.create_map(F.lit("name"), F.lit("renamed"))).otherwise(none).alias("corrected"),
        F.when(k % 3 == 0, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias("cleared"), F.lit(0.9).alias("confidence"), F.concat(F.lit("why "), k % 4).alias("rationale"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    out = readers.apply_corrections(rows, wanted, ["event_id", "tab"], "name")
    return out.select("event_id", shown("fields").alias("fields"), F.when(F.col("correction").isNotNull(), shown("correction.original")).alias("original"), "correction.rationale")


@query("topology_rules", """
with l as (select l_orderkey, l_linenumber, l_partkey % 2 = 0 as std, l_returnflag = 'R' as bal, case when l_quantity < 10 then '' when l_quantity < 20 then 'helmet' when l_quantity < 30 then 'hood' when l_quantity < 40 then 'mask' else 'cowl' end as g from lineitem)
select l_orderkey, l_linenumber, case g when 'cowl' then 'head_plus_separate_cowl' when 'mask' then 'head_plus_separate_mask_untyped' when 'hood' then 'head_plus_separate_hood' when 'helmet' then 'head_plus_separate_helmet' else case when not std then 'dedicated_nonstandard_head_no_separate_headgear' when bal then 'standard_head_print_only' else 'unresolved_topology' end end as topology_class,
 (case g when 'cowl' then 0.99 when 'mask' then 0.88 when 'hood' then 0.90 when 'helmet' then 0.82 else case when not std then 0.99 when bal then 0.98 else 0.0 end end)::double as confidence from l""")
def topology_rules(t):
    q = F.col("l_quantity")
    gear = F.when(q < 10, F.lit(None)).when(q < 20, "Helmet Classic").when(q < 30, "Hood Basic").when(q < 40, "Mask Plain").otherwise("Cowl Pointed")
    part = lambda num, name: F.struct(num.alias("part_num"), F.lit(None).cast("string").alias("print_of"), name.alias("part_name"))
    heads = F.array(part(F.when(F.col("l_partkey") % 2 == 0, "3626c").otherwise("9999"), F.when(F.col("l_returnflag") == "R", "Minifig Head Balaclava").otherwise("Minifig Head")))
    gears = F.filter(F.array(part(F.lit("77"), gear)), lambda g: g["part_name"].isNotNull())
    out = t.lineitem.select("l_orderkey", "l_linenumber", C.topology(F.array(F.lit("modified_or_nonhuman_head")), heads, gears).alias("t"))
    return out.select("l_orderkey", "l_linenumber", "t.topology_class", "t.confidence")


@query("component_predicates", """
with p as (select p_partkey, case p_size % 5 when 0 then 'Minifig Head ' || p_name when 1 then 'Headwear Dome ' || p_name when 2 then 'Torso ' || p_name when 3 then 'Hat ' || p_name else 'Bubble Helmet' end as n, p_size % 5 as k from part)
select p_partkey, k = 0 as head, k = 2 as body, k in (1, 3, 4) as headgear, k in (1, 4) as enclosure from p""")
def component_predicates(t):
    k = F.col("p_size") % 5
    name = F.when(k == 4, F.lit("Bubble Helmet")).otherwise(F.concat(F.element_at(F.array(F.lit("Minifig Head "), F.lit("Headwear Dome "), F.lit("Torso "), F.lit("Hat "), F.lit("")), k + 1), F.col("p_name")))
    part = t.part.select("p_partkey", F.struct(F.lit("1").alias("part_num"), name.alias("part_name"), F.lit(None).cast("string").alias("print_of"), F.lit(None).cast("string").alias("component_role")).alias("c"))
    c = F.col("c")
    return part.select("p_partkey", C.is_head(c).alias("head"), C.is_body(c).alias("body"), C.is_headgear(c).alias("headgear"), C.is_enclosure(c).alias("enclosure"))


@query("map_columns_by_tab", """select event_id, case event_type when 'click' then 'name=' || user_id || ';value=' || printf('%.2f', value) else 'name=' || printf('%.2f', value) end as fields from events where event_type in ('click', 'view')""")
def map_columns_by_tab(t):
    cells = F.create_map(F.lit("A"), F.col("user_id").cast("string"), F.lit("B"), F.format_string("%.2f", "value"), F.lit("C"), F.lit(" "))
    rows = t.events.select("event_id", F.col("event_type").alias("tab"), cells.alias("cells"))
    mapping = t.spark.createDataFrame([("click", "name", "A"), ("click", "value", "B"), ("click", "note", "C"), ("view", "name", "B")], "tab string, field string, letter string")
    out = readers.map_columns_by_tab(rows, mapping, "tab", "cells", ["event_id"])
    flat = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("event_id", F.array_join(flat, ";").alias("fields"))


def _broken(rows: str, rules: dict[str, str], key: str = "id") -> str:
    """SQL of one row per broken rule: a rule that is false or null is broken."""
    listed = ", ".join(f"case when not coalesce({ok}, false) then '{code}' end" for code, ok in rules.items())
    return f"select distinct {key}, finding from (select {key}, unnest([{listed}]) as finding from {rows}) where finding is not null"


PERSON_SQL = {"reviewer.reviewer_id:empty": "trim(who) <> ''", "reviewer.reviewer_type:unknown": "kind in ('human', 'model', 'hybrid')"}
TEXTS_SQL = "len(list_filter({0}, lambda x: trim(x) = '')) = 0"
ASSET_SQL = """
r as (select case when k % 73 = 0 then ' ' else 'd' || k end as id, case when k % 37 = 0 then 'old' else 'body-architecture-sanitized-asset-review/v1' end as schema, case when k % 41 = 0 then 'maybe' when k % 3 = 0 then 'rejected' when k % 3 = 1 then 'revise' else 'approved' end as decision,
  case when k % 7 = 0 then upper(h) when k % 11 = 0 then sha256('stale') else h end as a, case when k % 13 = 0 then null else h end as b, case when k % 17 = 0 then 'short' else h end as c, k % 29 = 0 as nochecks, quality = 1 or k % 2 = 0 as clean, k % 19 = 0 as gap, k % 23 = 0 as more,
  case when k % 71 = 0 then null when k % 31 = 0 then ' ' else 'r' end as who, case when k % 71 = 0 then null when k % 43 = 0 then 'bot' when k % 2 = 0 then 'model' else 'human' end as kind, case when k % 4 > 0 then 'm' end as model, case when k % 5 > 0 then 'v' else '' end as revision, case when k % 47 > 0 then (k % 10) / 8.0 end as conf,
  case when n_chars % 13 = 0 then [' '] when n_chars % 4 = 0 then ['seen'] when n_chars % 53 > 0 then []::varchar[] end as notes, case when k % 59 > 0 then '2026-01-01' else '' end as stamp, k % 14 = 2 or k % 73 = 0 as lost, h
  from (select doc_id as k, quality, n_chars, sha256(text) as h from labels join documents using (doc_id)))"""


@query("asset_review_errors", f"with {ASSET_SQL} " + _broken("r", {
    "schema:unknown": "schema like 'body%'", "decision:unknown": "decision <> 'maybe'", "source_record_id:no_candidate": "decision <> 'approved' or not lost",
    **{f"{d}:differs": f"decision <> 'approved' or lost or {c} = h" for d, c in zip(review.ASSET_DIGESTS, "abc", strict=True)}, **{f"{d}:not_a_digest": f"regexp_full_match({c}, '[0-9a-f]{{64}}')" for d, c in zip(review.ASSET_DIGESTS, "abc", strict=True)},
    "checks:missing": "not nochecks", "checks:unknown": "nochecks or not more", **{f"checks.{c}:open": "not nochecks" if i else "not nochecks and not gap" for i, c in enumerate(review.ASSET_CHECKS)},
    "checks:fail_when_approved": "decision <> 'approved' or (not nochecks and not gap and clean)", "reviewer:missing": "who is not null", "source_record_id:empty": "id <> ' '", **PERSON_SQL, "reviewer.model_id:needed_for_model": "coalesce(kind, '') <> 'model' or model is not null",
    "reviewer.model_revision:needed_for_model": "coalesce(kind, '') <> 'model' or revision <> ''", "review_confidence:out_of_range": "conf between 0 and 1", "notes:not_texts": TEXTS_SQL.format("notes"), "notes:needed_unless_approved": "decision not in ('rejected', 'revise') or len(notes) > 0", "reviewed_at:empty": "stamp <> ''"}))
def asset_review_errors(t):
    """Asset reviews of all labelled documents, each rule broken by some; one row per broken rule."""
    docs = t.documents.select(F.col("doc_id").alias("k"), "n_chars", F.sha2("text", 256).alias("h"))
    k, n, h = F.col("k"), F.col("n_chars"), F.col("h")
    check = lambda i: F.when(F.lit(i > 0) | (k % 19 != 0), (F.col("quality") == 1) | (k % 2 == 0) | F.lit(i > 0))
    pairs = [v for i, c in enumerate(review.ASSET_CHECKS) for v in (F.lit(c), check(i))]
    rows = t.labels.join(docs, F.col("doc_id") == k).select(
        F.when(k % 73 == 0, " ").otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("source_record_id"), F.when(k % 37 == 0, "old").otherwise(review.ASSET_SCHEMA).alias("schema"),
        F.when(k % 41 == 0, "maybe").when(k % 3 == 0, "rejected").when(k % 3 == 1, "revise").otherwise("approved").alias("decision"),
        F.when(k % 7 == 0, F.upper(h)).when(k % 11 == 0, F.sha2(F.lit("stale"), 256)).otherwise(h).alias("source_file_sha256"), F.when(k % 13 != 0, h).alias("sanitized_pixel_sha256"), F.when(k % 17 == 0, "short").otherwise(h).alias("sanitized_png_sha256"),
        F.when(k % 29 != 0, F.map_concat(F.create_map(*pairs), F.when(k % 23 == 0, F.create_map(F.lit("more"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>")))).alias("checks"),
        F.when(k % 71 > 0, F.struct(F.when(k % 31 == 0, " ").otherwise("r").alias("reviewer_id"), F.when(k % 43 == 0, "bot").when(k % 2 == 0, "model").otherwise("human").alias("reviewer_type"), F.when(k % 4 > 0, "m").alias("model_id"), F.when(k % 5 > 0, "v").otherwise("").alias("model_revision"))).alias("reviewer"),
        F.when(k % 47 > 0, k % 10 / 8.0).alias("review_confidence"), F.when(n % 13 == 0, F.array(F.lit(" "))).when(n % 4 == 0, F.array(F.lit("seen"))).when(n % 53 > 0, F.array().cast("array<string>")).alias("notes"), F.when(k % 59 > 0, "2026-01-01").otherwise("").alias("reviewed_at"))
    candidates = docs.where(k % 14 != 2).select(F.concat(F.lit("d"), k.cast("string")).alias("source_record_id"), *[h.alias(d) for d in review.ASSET_DIGESTS])
    return review.asset_review_errors(rows, candidates).select(F.col("source_record_id").alias("id"), F.explode("errors").alias("finding")).distinct()


SOURCE_SQL = """
l as (select doc_id as k, quality, toxic, n_chars as n, sha256(text) as h from labels join documents using (doc_id)), m as (select * from l union all select * from l where toxic = 1),
r as (select case when k % 23 = 0 then 'x' || k else 'd' || k end as id, k % 23 > 0 as known, case when k % 11 = 0 then 'other' when k % 13 = 0 then ' ' else 's' || k end as sid, 's' || k as qid, case when k % 7 = 0 then upper(h) when k % 17 = 0 then sha256('x') else h end as a, h,
  case when k % 19 = 0 then 'maybe' when quality = 1 then 'approved_raw' else 'sanitization_required' end as status, case when k % 29 = 0 then 'yes' when k % 5 = 0 then 'false' when k % 5 = 1 then 'uncertain' else 'true' end as identity,
  ['front', 'front_3q', 'side', 'rear', 'multi_view_composite', 'uncertain', 'top'][(k % 7 + 1)::int] as view, case when k % 31 > 0 then (k % 6 <> 0)::varchar end as complete, case when k % 37 = 0 then [' '] when toxic = 1 then ['logo'] else []::varchar[] end as leak,
  case when n % 9 = 0 then ['hand'] when n % 67 > 0 then []::varchar[] end as confound, ['none', 'none', 'none', 'tight_figure_crop', 'mask_regions', 'replace_source', 'paint', 'none'][(k % 8 + 1)::int] as action, case when k % 43 > 0 then (quality = 1) <> (k % 41 = 0) end as allowed,
  case when k % 47 > 0 then (k % 10) / 8.0 end as conf, case when n % 13 = 0 then [' '] when n % 4 > 0 then []::varchar[] end as notes, case when k % 59 = 0 then ' ' else 'r' end as who, case when k % 53 = 0 then 'bot' when k % 3 = 0 then 'model' when k % 3 = 1 then 'hybrid' else 'human' end as kind,
  k % 4 > 0 as named, k % 61 > 0 as method from m)"""


def _approved(ok: str) -> str:
    return f"status <> 'approved_raw' or coalesce({ok}, false)"


@query("source_review_findings", f"with {SOURCE_SQL}, q as (select 'd' || doc_id as id from documents) " + _broken("r", {
    "source_record_id:unknown": "known", "source_id:empty": "trim(sid) <> ''", "source_id:differs": "not known or sid = qid", "source_file_sha256:differs": "not known or a = h", "source_file_sha256:not_a_digest": "regexp_full_match(a, '[0-9a-f]{64}')",
    "status:unknown": "status <> 'maybe'", "identity_match:unknown": "identity <> 'yes'", "primary_figure_complete:unknown": "complete is not null", "primary_view:unknown": "view <> 'top'", "visible_text_leakage:not_texts": TEXTS_SQL.format("leak"), "visual_confounders:not_texts": "confound is not null",
    "sanitization_action:unknown": "action <> 'paint'", "raw_model_input_allowed:missing": "allowed is not null", **PERSON_SQL, "reviewer.model:needed_for_model": "kind not in ('model', 'hybrid') or named", "reviewer.review_method:empty": "method",
    "review_confidence:out_of_range": "conf between 0 and 1", "notes:not_texts": TEXTS_SQL.format("notes"), "identity_match:against_approval": _approved("identity = 'true'"), "primary_figure_complete:against_approval": _approved("complete = 'true'"),
    "visible_text_leakage:against_approval": _approved("leak <> ['logo']"), "visual_confounders:against_approval": _approved("coalesce(confound <> ['hand'], true)"), "sanitization_action:against_approval": _approved("action = 'none'"), "raw_model_input_allowed:against_approval": _approved("allowed"),
    "raw_model_input_allowed:against_sanitization": "status <> 'sanitization_required' or not allowed", "sanitization_action:needed": "status <> 'sanitization_required' or action <> 'none'",
    "sanitization_action:replace_other_identity": "status <> 'sanitization_required' or identity <> 'false' or action = 'replace_source'"}) + """
union all select id, 'duplicate_review' from r group by 1 having count(*) > 1 union all select id, 'unreviewed_record' from q where id not in (select id from r)""")
def source_review_findings(t):
    """Source reviews of all labelled documents against a queue of all documents, each rule broken by some."""
    docs = t.documents.select(F.col("doc_id").alias("k"), F.col("n_chars").alias("n"), F.sha2("text", 256).alias("h"))
    k, n, h, none = F.col("k"), F.col("n"), F.col("h"), F.array().cast("array<string>")
    name = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    pick = lambda size, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % size).cast("int"))
    one = lambda v: F.array(F.lit(v))
    rows = t.labels.join(docs, F.col("doc_id") == k).select(
        F.when(k % 23 == 0, name("x")).otherwise(name("d")).alias("source_record_id"), F.when(k % 11 == 0, "other").when(k % 13 == 0, " ").otherwise(name("s")).alias("source_id"), F.when(k % 7 == 0, F.upper(h)).when(k % 17 == 0, F.sha2(F.lit("x"), 256)).otherwise(h).alias("source_file_sha256"),
        F.when(k % 19 == 0, "maybe").when(F.col("quality") == 1, "approved_raw").otherwise("sanitization_required").alias("status"), F.when(k % 29 == 0, "yes").when(k % 5 == 0, "false").when(k % 5 == 1, "uncertain").otherwise("true").alias("identity_match"),
        pick(7, "front", "front_3q", "side", "rear", "multi_view_composite", "uncertain", "top").alias("primary_view"), F.when(k % 31 > 0, (k % 6 != 0).cast("string")).alias("primary_figure_complete"),
        F.when(k % 37 == 0, one(" ")).when(F.col("toxic") == 1, one("logo")).otherwise(none).alias("visible_text_leakage"), F.when(n % 9 == 0, one("hand")).when(n % 67 > 0, none).alias("visual_confounders"),
        pick(8, "none", "none", "none", "tight_figure_crop", "mask_regions", "replace_source", "paint", "none").alias("sanitization_action"), F.when(k % 43 > 0, (F.col("quality") == 1) != (k % 41 == 0)).alias("raw_model_input_allowed"),
        F.when(k % 47 > 0, k % 10 / 8.0).alias("review_confidence"), F.when(n % 13 == 0, one(" ")).when(n % 4 > 0, none).alias("notes"), (F.col("toxic") == 1).alias("again"),
        F.struct(F.when(k % 59 == 0, " ").otherwise("r").alias("reviewer_id"), F.when(k % 53 == 0, "bot").when(k % 3 == 0, "model").when(k % 3 == 1, "hybrid").otherwise("human").alias("reviewer_type"), F.when(k % 4 > 0, "f").alias("model_family"), F.lit(None).cast("string").alias("model_id"), F.when(k % 61 > 0, "m").otherwise("").alias("review_method")).alias("reviewer"))
    queue = docs.select(name("d").alias("source_record_id"), name("s").alias("source_id"), h.alias("source_file_sha256"))
    return review.source_review_findings(queue, rows.unionAll(rows.where("again"))).withColumnRenamed("source_record_id", "id")


@query("family_class", """
with p as (select p_partkey, lower(p_type) as ty, p_size % 3 as k, p_size % 20 / 100.0 as margin from part)
select p_partkey, case k when 0 then 'suffix_catalog_text_match' when 1 then 'no_semantic_suffix' else 'suffix_not_resolved_in_supported_candidates' end as constraint_status,
 case when k = 2 then 'variant_constrained_physical_release_unresolved' when margin >= 0.10 then 'unique_physical_release_candidate' else 'physical_release_ambiguous_within_character_family' end as release_status, 1 as support_count from p""")
def family_class(t):
    k, kind = F.col("p_size") % 3, F.lower("p_type")
    words = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    cand = lambda i, w: F.struct(F.lit(i).alias("id"), F.array_join(w, " ").alias("name"), w.alias("words"), F.array_join(w, "").alias("compact"), none.alias("set_words"), none.alias("parts"))
    suffix = F.when(k == 0, F.array(kind)).when(k == 1, none).otherwise(F.array(F.lit("hoth")))
    rows = t.part.select(
        "p_partkey", words.alias("label_words"), F.replace("p_name", F.lit(" "), F.lit("")).alias("compact_label"), F.lit(False).alias("code_like"), suffix.alias("suffix_words"), F.array_join(suffix, "").alias("suffix_text"),
        (F.col("p_size") % 20 / 100.0).alias("margin"), F.array(cand("a", F.array_append(words, kind)), cand("b", F.array(kind, F.lit("zz")))).alias("candidates"))
    return queues.family_class(rows).select("p_partkey", "constraint_status", "release_status", "support_count")
