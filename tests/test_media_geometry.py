import itertools
import math
import random

import numpy as np
import pytest
from curatrix.operators import dedup, geometry, media, pages, ranges
from pyspark.sql import functions as F
from conftest import values


def masks(spark, **roles):
    rows = [("a", role, i // 2, i % 2) for role, cells in roles.items() for i in cells]
    return spark.createDataFrame(rows, "asset string, role string, y int, x int")


def test_mask_overlap_and_containment(spark):
    row = media.mask_overlap(masks(spark, r=[0, 1], c=[0, 2]), "r", "c").first()
    assert row.iou == pytest.approx(1 / 3)
    row = media.print_containment(masks(spark, art_mask=[0, 1, 2], safe_zone=[0, 1], keepout_mask=[1])).first()
    assert (row.art_outside_safe_zone, row.art_in_keepout) == (2, 1) and row.print_zone_containment == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="art mask is empty"):
        media.print_containment(masks(spark, safe_zone=[0])).collect()


def test_landmark_error(spark):
    rows = [("a", "reference", "eye", 0.0, 0.0), ("a", "candidate", "eye", 0.0, 0.5)]
    schema, grid = "asset string, role string, label string, x double, y double", spark.createDataFrame([("a", 2, 2)], "asset string, w int, h int")
    assert media.landmark_error(spark.createDataFrame(rows, schema), grid).first().landmark_error == pytest.approx(0.5 / math.sqrt(8))
    with pytest.raises(Exception, match="landmark labels differ"):
        media.landmark_error(spark.createDataFrame([*rows, ("a", "reference", "nose", 1.0, 1.0)], schema), grid).collect()


def test_thresholds(spark):
    m = spark.createDataFrame([("a", "silhouette_iou", 0.8), ("a", "landmark_error", 0.2), ("b", "silhouette_iou", 0.1), ("b", "landmark_error", 0.1)], "asset string, metric string, value double")
    checks = media.threshold_checks(m, {"silhouette_iou": 0.5, "landmark_error": 0.3})
    assert values(media.check_status(checks), "asset", "status") == [("a", "technical_checks_passed"), ("b", "technical_checks_failed")]
    with pytest.raises(ValueError):
        media.threshold_checks(m, {"bogus": 0.1})
    with pytest.raises(Exception, match="no measured input"):
        media.threshold_checks(m.where("metric <> 'landmark_error'"), {"landmark_error": 0.3}).collect()


def picture(spark, seed=0, w=12, h=10):
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 256, (h, w, 4))
    img[..., 3] = np.where(rng.random((h, w)) < 0.8, 255, 0)
    rows = [("a", y, x, *map(int, img[y, x])) for y in range(h) for x in range(w)]
    return img, spark.createDataFrame(rows, "asset string, y int, x int, r int, g int, b int, a int")


def test_pixel_features_equal_numpy(spark):
    img, df = picture(spark)
    row = media.pixel_features(df.repartition(3)).first()
    rgb, fg = img[..., :3].astype(float), img[..., 3] > 16
    luma = (rgb @ np.array([0.2126, 0.7152, 0.0722]))[fg] / 255
    gray = np.floor((299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]) / 1000) / 255
    ex = ((np.abs(np.diff(gray, axis=1)) > 0.08) & fg[:, 1:] & fg[:, :-1]).sum()
    ey = ((np.abs(np.diff(gray, axis=0)) > 0.08) & fg[1:] & fg[:-1]).sum()
    half = 6
    valid = fg[:, :half] & fg[:, ::-1][:, :half]
    diff = np.abs(rgb[:, :half] - rgb[:, ::-1][:, :half]).mean(axis=-1)[valid].mean()
    mx, mn = rgb.max(-1), rgb.min(-1)
    assert row.coverage == pytest.approx(fg.mean()) and row.mean_luminance == pytest.approx(luma.mean()) and row.luminance_std == pytest.approx(luma.std())
    assert row.mean_saturation == pytest.approx(np.where(mx > 0, (mx - mn) / np.maximum(mx, 1), 0)[fg].mean())
    assert row.edge_density == pytest.approx((ex + ey) / fg.sum()) and row.horizontal_edge_fraction == pytest.approx(ey / (ex + ey))
    assert row.bilateral_symmetry == pytest.approx(1 - diff / 255)


def test_foreground_bbox_by_alpha_and_by_colour(spark):
    cells = [("a", y, x, 0, 0, 0, 255 if 2 <= x <= 4 and 1 <= y <= 2 else 0) for y in range(5) for x in range(10)]
    cells += [("b", y, x, *((200, 0, 0) if x == 7 else (10, 10, 10)), 255) for y in range(5) for x in range(10)]
    df = spark.createDataFrame(cells, "asset string, y int, x int, r int, g int, b int, a int")
    got = {r.asset: (r.x0, r.y0, r.x1, r.y1, r.occupancy) for r in media.foreground_bbox(df).collect()}
    assert got == {"a": (0.2, 0.2, 0.5, 0.6, 0.12), "b": (0.7, 0.0, 0.8, 1.0, 0.1)}


def test_region_join_equals_brute_force(spark):
    rows, df = picture(spark, 3, 70, 70)
    regions = [("q", 1, 2, 68, 66), ("w", 60, 60, 70, 70), ("e", 0, 0, 1, 1), ("all", -5000, -5000, 90000, 90000), ("none", 5, 5, 5, 5), ("turned", 9, 9, 3, 3), ("null", None, 0, 9, 9)]
    got = {r.id: r["count"] for r in media.pixel_region_join(df, spark.createDataFrame(regions, "id string, x0 int, y0 int, x1 int, y1 int")).groupBy("id").count().collect()}
    assert got == {"q": 67 * 64, "w": 100, "e": 1, "all": 4900}


def test_image_part_index(spark):
    images = spark.createDataFrame([("3626bp01",), ("973-front",), ("none",)], "stem string")
    parts = spark.createDataFrame([("3626bp01", "Head"), ("973", "Torso")], "number string, name string")
    got = {r.stem: (r.matched, r.part.name if r.part else None) for r in media.image_part_index(images, parts, "stem", "number").collect()}
    assert got == {"3626bp01": (True, "Head"), "973-front": (True, "Torso"), "none": (False, None)}


def test_difference_hash_and_pairs(spark):
    rows = [("dark", y, x, float(9 - x)) for y in range(8) for x in range(9)] + [("light", y, x, float(x)) for y in range(8) for x in range(9)]
    got = dict(values(dedup.difference_hash(spark.createDataFrame(rows, "asset string, y int, x int, luma double"), "asset"), "asset", "code"))
    assert got == {"dark": -1, "light": 0}
    rng = random.Random(4)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(80)]
    codes += [c ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for c in codes[:40]] + codes[:10]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(set(codes), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    for crowded in (2000, 1):
        assert set(values(dedup.near_duplicate_pairs(df, "id", "code", 3, crowded), "code_a", "code_b")) == want
    groups = dedup.near_duplicate_groups(df, "id", "code", 3)
    assert groups.count() == len(codes) and groups.where("id in (0, 120)").select("group_code").distinct().count() == 1


CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
CORNER = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
TRI = "mesh_id string, tri_id int, v array<struct<x:double,y:double,z:double>>"


def mesh(name, faces, shift=0.0, start=0):
    return [(name, start + i, [(CORNER[k][0] + shift, float(CORNER[k][1]), float(CORNER[k][2])) for k in f]) for i, f in enumerate(faces)]


def test_mesh_audit(spark):
    two = mesh("two", CUBE) + mesh("two", CUBE, 5.0, 12)
    rows = mesh("cube", CUBE) + mesh("open", [f for f in CUBE if f not in ((4, 5, 6), (4, 6, 7))]) + two + mesh("flip", [(0, 1, 2)] + CUBE[1:])
    got = {r.mesh_id: r for r in geometry.mesh_audit(spark.createDataFrame(rows, TRI)).collect()}
    c = got["cube"]
    assert (c.triangle_count, c.unique_vertices, c.unique_edges, c.euler_characteristic, c.closed, c.components, c.errors) == (12, 8, 18, 2, True, 1, []) and c.signed_volume == pytest.approx(1.0)
    assert got["open"].boundary_edges == 4 and "open_boundary_edges" in got["open"].errors
    assert got["two"].components == 2 and got["flip"].winding_conflicts > 0


def test_mesh_bounds_profile_and_transform(spark):
    df = spark.createDataFrame(mesh("cube", CUBE), TRI)
    b = geometry.mesh_bounds(df).first()
    assert (b.min_x, b.max_z, b.size_y, b.centre_x, b.triangle_count) == (0.0, 1.0, 1.0, 0.5, 12)
    spans = [(r.step, r.front_span, r.side_span) for r in geometry.mesh_profile(df, 5).orderBy("step").collect()]
    assert spans == [(i, 1.0, 1.0) for i in range(5)]
    pts = spark.createDataFrame([("p", 1.0, 2.0, 3.0)], "k string, x double, y double, z double")
    m = spark.createDataFrame([("p", [0.0, -1.0, 0.0, 10.0, 1.0, 0.0, 0.0, 20.0, 0.0, 0.0, 2.0, 30.0])], "k string, m array<double>")
    assert tuple(geometry.apply_transform(pts, m, "k").first())[1:] == (8.0, 21.0, 36.0)
    labels = spark.createDataFrame([("cube", i, 0 if i < 6 else 1) for i in range(12)], "mesh_id string, tri_id int, part_id int")
    assert geometry.part_bounds(df, labels).count() == 2
    with pytest.raises(Exception, match="face and label counts differ"):
        geometry.part_bounds(df, labels.where("tri_id < 11")).collect()


def test_placed_triangles_flip(spark):
    tri = spark.createDataFrame(mesh("brick", CUBE[:1]), TRI)
    occ = spark.createDataFrame([("root", "brick", [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], True)], "root string, part string, m array<double>, flip boolean")
    row = geometry.transform_triangles(tri, occ).first()
    assert [(p.x, p.y) for p in row.v] == [(5.0, 0.0), (6.0, 0.0), (6.0, 1.0)]


def boxes(rng, n, sizes):
    for i in range(n):
        at, size = [rng.uniform(0, 20) for _ in range(3)], rng.choice(sizes)
        yield (i, *[v for x in at for v in (x, x + rng.uniform(0, size))])


BOX = "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"


def test_box_join_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [*boxes(rng, 150, [0.0, 1.0, 4.0, 4.0, 15.0, 300.0]), (150, *[-1e5, 1e5] * 3), (151, 3.0, 2.0, 0.0, 20.0, 0.0, 20.0), (152, None, 2.0, 0.0, 20.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, BOX)
    got = values(geometry.aabb_overlap_join(df, df, "id", 2.5, self_join=True), "left_id", "right_id")
    hit = lambda a, b: all(a[k] <= b[k + 1] + 1e-9 and a[k + 1] + 1e-9 >= b[k] for k in (1, 3, 5))
    assert sorted(got) == sorted((a[0], b[0]) for a, b in itertools.combinations(rows[:151], 2) if hit(a, b))


def test_a_box_over_all_cells_costs_few_rows(spark):
    df = spark.createDataFrame([*boxes(random.Random(3), 50, [1.0]), (50, *[-1e6, 1e6] * 3)], BOX)
    axes = [("x0", "x1"), ("y0", "y1"), ("z0", "z1")]
    made = [(F.col(a), F.col(b)) for a, b in axes]
    classed = df.withColumn("_class", ranges._class(made, 2.5, 0.0))
    entered = ranges._entered(classed, made, ranges._classes(classed), 2.5, 0.0, "a_")
    assert entered.where("a_id = 50").count() <= 8 and entered.count() <= 51 * 8 * 2


def test_slices_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, x := rng.uniform(0, 100), x + rng.choice([0.0, 0.5, 3.0, 60.0, 1000.0])) for i in range(80)]
    heights = [float(h) for h in range(0, 130, 3)]
    got = values(geometry.slice_range_join(spark.createDataFrame(items, "id int, z0 double, z1 double"), spark.createDataFrame([(h,) for h in heights], "height double"), "z0", "z1", "height", 2.0), "id", "height")
    assert got == sorted(((i, h) for i, a, b in items for h in heights if a <= h <= b), key=str)


def test_collision_candidates_skip_the_same_part(spark):
    df = spark.createDataFrame(mesh("a", CUBE[:2]) + mesh("b", CUBE[:2], 0.5, 100) + mesh("c", CUBE[:2], 9.0, 200), TRI)
    got = values(geometry.collision_candidates(df, 1.0), "left_id", "right_id")
    assert got == [(0, 100), (0, 101), (1, 100), (1, 101)]


def test_landmarks_and_envelopes(spark):
    lm = spark.createDataFrame([("r", "head", 60.0, 10.0, 0.5), ("r", "foot", 50.0, 110.0, None)], "ref string, label string, x_px double, y_px double, confidence double")
    box = spark.createDataFrame([("r", 0.0, 10.0, 100.0, 110.0)], "ref string, left double, top double, right double, bottom double")
    norm = geometry.normalise_landmarks(lm, box, "ref")
    assert values(norm, "label", "x", "z", "confidence") == [("foot", 0.0, 0.0, 1.0), ("head", 0.1, 1.0, 0.5)]
    model = spark.createDataFrame([("head", 0.1, 0.8), ("foot", 0.0, 0.0)], "label string, mx double, mz double")
    assert geometry.landmark_loss(norm, model, "ref").first().loss == pytest.approx(0.5 * 0.02 / 1.5)
    span = "map<string,struct<low:double,high:double,confidence:double>>"
    env = spark.createDataFrame([("r", 100.0, {"hip": (10.0, 60.0, None)}, {"leg": (50.0, 90.0, 0.5)})], f"ref string, body_height double, horizontal {span}, vertical {span}")
    assert values(geometry.envelope_spans(env, "ref"), "name", "span_over_body_height", "confidence") == [("hip", 0.5, 1.0), ("leg", 0.4, 0.5)]


HTML = """<html><head><meta property="og:image" content="/og.png"><meta name="description" content="Desc"><title> My  Page </title></head><body>
<img src="//cdn.test/a.jpg" srcset="/s1.webp 1x, /s2.webp 2x"><a href="../doc.pdf?x=1">Doc &amp; more</a><a href='files/b.png'>b</a><script>var u="https:\\/\\/x.test\\/images\\/z.jpg";</script></body></html>"""


def test_page_fixture(spark):
    df = spark.createDataFrame([(1, "https://h.test/a/b/page.html?q=1", HTML)], "page_id long, url string, html string")
    assets = set(values(pages.page_assets(df), "role", "asset_url"))
    assert assets == {("og:image", "https://h.test/og.png"), ("img_src", "https://cdn.test/a.jpg"), ("img_srcset", "https://h.test/s1.webp"), ("img_srcset", "https://h.test/s2.webp"),
                      ("anchor_asset", "https://h.test/a/doc.pdf?x=1"), ("anchor_asset", "https://h.test/a/b/files/b.png")}
    assert values(pages.pdf_links(df), "pdf_url") == [("https://h.test/a/doc.pdf?x=1",)] and pages.pdf_links(df, ["other.test"]).count() == 0
    found = {r.candidate: r.occurrences for r in pages.image_candidates(df).collect()}
    assert found["https://x.test/images/z.jpg"] == 1 and found["https://cdn.test/a.jpg"] == 2 and found["https://h.test/s2.webp"] == 1
    imgs = df.select(pages.page_images("html", "url").alias("i")).first().i
    assert imgs[0] == "https://h.test/og.png" and df.select(pages.preferred_page_image(pages.page_images("html", "url"), 99).alias("p")).first().p is None
    meta = df.select(*[c.alias(k) for k, c in pages.page_meta("html").items()]).first()
    assert (meta.title, meta.description, meta.og_title) == ("My Page", "Desc", None)
    assert [(a.href, a.text) for a in df.select(pages.anchors("html").alias("a")).first().a] == [("../doc.pdf?x=1", "Doc & more"), ("files/b.png", "b")]
    assert "var u" not in df.select(pages.visible_lines("html").alias("t")).first().t


def test_segments_and_policy(spark):
    text = "Updated as of May 2020.\nK 12 - Knight\nextra\nKF-3\nXP9: Pirate K12 Other"
    df = spark.createDataFrame([(text,)], "t string")
    got = [(s.serial, s.name) for s in df.select(pages.segments_between("t", "KF|K|XP").alias("s")).first().s]
    assert got == [("K12", "Knight"), ("KF3", None), ("XP9", "Pirate"), ("K12", "Other")]
    assert df.select(pages.updated_label("t").alias("u")).first().u == "May 2020"
    urls = spark.createDataFrame([("https://a.test/x",), ("http://a.test",), ("https://b.test",), ("https://",)], "u string")
    assert [r.r for r in urls.select(pages.url_policy("u", ["a.test"]).alias("r")).collect()] == [None, "non_https_url", "host_not_allowed", "no_hostname"]
