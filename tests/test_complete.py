"""Results above the limits that operators once had, and null keys."""

from curatrix.functions.reference import with_reference
from curatrix.operators import dedup, group, joins, pages, queues, rank, scale
import pytest
from pyspark.sql import functions as F


def _segments(spark, n, last):
    rows = [(i, 0, "K1", f"name {i:04d}") for i in range(n)] + [(n, 0, "K1", last), (n + 1, 0, "K2", ""), (n + 2, 1, None, "x")]
    return spark.createDataFrame(rows, "page_id long, pos int, serial string, name string")


def test_all_names_of_a_serial_count(spark):
    args = ("serial", "name", "page_id", "pos")
    names = group.serial_names(_segments(spark, 70, "last"), *args)
    assert [r.name for r in names.where("serial = 'K1'").orderBy("name_no").collect()] == [f"name {i:04d}" for i in range(70)] + ["last"]
    a, b = (group.catalog_digest(_segments(spark, 70, x), *args).first() for x in ("last", "other"))
    assert a.serials == b.serials == 3 and a.catalog_digest != b.catalog_digest
    seen = {r.serial: (r.name_count, r.first_name, r.name_status) for r in group.serial_observations(_segments(spark, 70, "last"), *args).collect()}
    assert seen == {"K1": (71, "name 0000", "conflicting_names"), "K2": (0, None, "blank_catalog_slot"), None: (1, "x", "named")}


def test_accessories_links_and_labels_are_complete(spark):
    parts = spark.range(1500).select(F.lit("e").alias("e"), F.lit("hat").alias("role"), F.col("id").alias("item"))
    assert group.component_accessories(parts, "e", "role", "item", ["hat"]).count() == 1500
    assert group.component_summary(parts, "e", "role", ["hat"]).first().accessory_count == 1500
    labels = spark.range(80).select(F.lit("g").alias("g"), F.concat(F.lit("a"), F.repeat(F.lit(" "), F.col("id").cast("int") + 1), F.lit("b")).alias("label"))
    found = queues.presentation_alias_audit(labels, "g", "label")
    assert found.count() == 80 and found.agg(F.max("label_no")).first()[0] == 80
    candidates = spark.createDataFrame([("s", "f", "r", 0.9)], "subject string, fig string, role string, score double")
    components = spark.range(90).select(F.lit("f").alias("fig"), F.lit("r").alias("component_role"), F.col("id").alias("component_id"), F.col("id").alias("part"), F.lit(None).cast("string").alias("print_of"))
    links = joins.expand_to_parts(candidates, components, spark.range(90).select(F.col("id").alias("part")), "subject", "fig", "part", "role", "component_role", "score", spark.createDataFrame([("r", "r")], "role string, component_role string"))
    assert links.count() == 90 and links.where("in_part_list").count() == 30


def test_addresses_of_any_depth(spark):
    row = spark.createDataFrame([("https://h.test/a/b/c/d/e.html",)], "url string")
    resolve = lambda ref: row.select(pages.resolve_url("url", F.lit(ref)).alias("u")).first().u
    assert resolve("../" * 11 + "q.png") == "https://h.test/q.png"
    assert resolve("x/" * 20 + "../" * 20 + "q.png?a=../b") == "https://h.test/a/b/c/d/q.png?a=../b"
    assert resolve("./../q/./r/..") == "https://h.test/a/b/c/q/"


def test_all_trailing_parentheses_are_read(spark):
    got = with_reference(spark.createDataFrame([("Tale #3 " + "(Digital) " * 7 + "(1999)",)], "t string"), "t").first().reference
    assert got.year_hint == 1999 and "(" not in (got.source_work or "")


def test_contexts_of_an_address_at_several_places(spark):
    html = "first <img src='https://h.test/a.png'> " + "x" * 400 + " second <img src='https://h.test/a.png'> "
    found = {r.candidate: r for r in pages.image_candidates(spark.createDataFrame([(1, "https://h.test/", html)], "page_id long, url string, html string")).collect()}
    r = found["https://h.test/a.png"]
    assert r.occurrences == 4 and any("first" in c for c in r.contexts) and any("second" in c for c in r.contexts)


def test_images_of_tags_in_any_order_of_attributes(spark):
    html = "<a href='x/y.JPG?q=1'>l</a><img alt=x data-src='d.png' src='s.png'><meta content='/t.png' name='twitter:image:src'><meta content='/og.png' property='og:image'><a href='page.html'>n</a>"
    images = spark.createDataFrame([("https://h.test/p/", html), ("https://h.test/", None)], "url string, html string").select(pages.page_images("html", "url").alias("i")).collect()
    assert images[0].i == ["https://h.test/og.png", "https://h.test/t.png", "https://h.test/p/d.png", "https://h.test/p/x/y.JPG?q=1"] and images[1].i == []


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "s", 1), (None, "t", 2), ("k", "s", 3), ("k", "s", 4)], "k string, source string, record long")
    assert {r.k: r.record_count for r in group.strict_duplicates(df, ["k"], "source", "record").collect()} == {None: 2, "k": 2}
    assert {r.k for r in scale.first_values(df, ["k"], "record", 1, "v").collect()} == {None, "k"}
    other = df.select("k", F.lit(1).alias("x")).distinct()
    assert scale.null_safe_join(df, other, ["k"]).count() == 4 and scale.null_safe_join(df, other, ["k"], "left_anti").count() == 0


def test_equal_arrivals_have_one_order(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    changes = spark.createDataFrame([("a", 1, "new")], "k string, at int, v string")
    made = [sorted(tuple(r) for r in dedup.upsert(table.repartition(n), changes, ["k"], "at").collect()) for n in (1, 3)]
    assert made[0] == made[1] and made[0][0] == ("a", 1, "new") and len(made[0]) == 2


def test_figures_out_of_range_raise(spark):
    names = ("width", "height", "identity_confidence", "view_confidence", "segmentation_confidence", "blur_score", "occlusion_score")
    row = lambda **x: spark.createDataFrame([("primary", *[x.get(n, 0.5) for n in names])], "authority string, " + ", ".join(f"{n} double" for n in names)).select(rank.evidence_score()).first()
    assert row(width=4000.0, height=None)
    for bad in (dict(view_confidence=1.5), dict(blur_score=-0.1), dict(identity_confidence=float("nan")), dict(width=float("inf"))):
        with pytest.raises(Exception, match="out of range"):
            row(**bad)


def test_geometry_links_are_three_lists(spark):
    links = spark.createDataFrame([("s", 1, "3626BP", 0.95, "f1", "strict_print_link"), ("s", 1, "3626bp", 0.99, "f2", "strict_print_link"), ("s", 2, "973", 0.5, "f1", "unverified_print_link"), ("s", 3, "970", 0.5, "f1", "base_substrate_link"), ("s", 4, "973", 0.5, "f1", "no_geometry")], "s string, component_id int, part string, score double, entity string, link_class string")
    assets = spark.createDataFrame([("3626bp", "a1"), ("3626BP", "a1"), ("3626bp", "a2"), ("973", "a3"), ("970", "a4"), ("970", None), (None, "a5")], "part string, asset string")
    got = {(r["list"], r.component_id, r.asset): r.entity for r in joins.geometry_links(links, assets, "s", "part", "asset").collect()}
    assert got == {(k, 1, a): "f2" for k in ("raw", "strict") for a in ("a1", "a2")} | {("raw", 2, "a3"): "f1", ("base", 3, "a4"): "f1"}
