import gzip
import hashlib
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from curatrix.operators import dq, graph, group, joins
from curatrix.operators.dq import DataQualityError
from curatrix.sources import readers, writers
from conftest import values

TABLES = {
    "minifigs": "fig_num,name,num_parts,img_url\nfig-1,Robot,3,https://x.test/1.png\n",
    "inventories": "id,version,set_num\n10,1,set-1\n11,1,fig-1\n",
    "inventory_minifigs": "inventory_id,fig_num,quantity\n10,fig-1,2\n",
    "inventory_parts": "inventory_id,part_num,color_id,quantity,is_spare,img_url\n11,p1,1,1,f,\n11,p2,1,1,f,\n11,p3,2,2,t,\n",
    "parts": "part_num,name,part_cat_id,part_material\np1,Minifig Head,1,Plastic\np2,\"Torso, printed\",2,Plastic\np3,Legs,3,Plastic\n",
    "part_relationships": "rel_type,child_part_num,parent_part_num\n",
    "elements": "element_id,part_num,color_id,design_id\n1,p1,1,9\n",
    "colors": "id,name,rgb,is_trans\n1,Red,FF0000,f\n2,Blue,0000FF,f\n",
    "sets": "set_num,name,year,theme_id,num_parts,img_url\nset-1,Castle,1999,2,100,\n",
    "themes": "id,name,parent_id\n1,Town,\n2,Knights,1\n",
}


@pytest.fixture()
def catalog(tmp_path):
    for name, text in TABLES.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return tmp_path


def census(tables):
    t = tables
    links = joins.star_join(
        t["minifigs"].select("fig_num"),
        [(t["inventory_minifigs"].select(F.col("fig_num").alias("f"), "inventory_id", "quantity"), F.col("fig_num") == F.col("f")),
         (t["inventories"].select(F.col("id").alias("iid"), F.col("set_num").alias("sn")), F.col("inventory_id") == F.col("iid")),
         (t["sets"].select("set_num", F.col("name").alias("set_name"), F.col("year").cast("int").alias("year"), "theme_id"), F.col("sn") == F.col("set_num"))],
        ["fig_num", "set_num", "set_name", "year", "theme_id", "quantity"])
    own = t["inventories"].select(F.col("id").alias("inventory_id"), F.col("set_num").alias("fig_num"))
    parts = t["inventory_parts"].join(own, "inventory_id").join(t["parts"].select("part_num", F.col("name").alias("part_name"), "part_cat_id"), "part_num", "left")
    lineage = graph.ancestry(t["themes"], "id", "parent_id", "name").withColumnRenamed("id", "theme_id")
    themes = links.select("fig_num", "theme_id").distinct().join(lineage, "theme_id")
    bounds = group.year_bounds(links, "fig_num", "year", "set_num")
    return group.nested_census(t["minifigs"].join(bounds, "fig_num", "left"), "fig_num", {
        "sets": (links.select("fig_num", "set_num", "set_name", "year", "theme_id").distinct(), ["year", "set_num"], ["set_num", "set_name", "year", "theme_id"]),
        "themes": (themes, ["theme_id"], ["theme_id", "lineage"]),
        "components": (parts, ["part_num", "color_id"], ["part_num", "color_id", "quantity", "is_spare", "part_name"])})


def test_catalogue_to_census(spark, catalog):
    tables = readers.scan_csv_catalog(spark, str(catalog))
    row = census(tables).first()
    assert (row.fig_num, row.first_year, row.last_year, row.member_count) == ("fig-1", 1999, 1999, 1)
    assert [s.set_num for s in row.sets] == ["set-1"]
    assert [[x.name for x in th.lineage] for th in row.themes] == [["Knights", "Town"]]
    assert [(c.part_num, c.part_name, c.is_spare) for c in row.components] == [("p1", "Minifig Head", "f"), ("p2", "Torso, printed", "f"), ("p3", "Legs", "t")]
    counts = dq.integrity_counts(tables, {"minifigs": ["fig_num"]}, [("inventory_minifigs", "fig_num", "minifigs", "fig_num")], ["minifigs", "sets"])
    found = {(r.table_name, r.check_name): r.value for r in counts.collect()}
    assert found[("minifigs", "rows")] == 1 and found[("minifigs", "duplicate_keys")] == 0 and found[("inventory_minifigs", "orphan_fig_num")] == 0


def test_gzip_bom_and_header_rules(spark, catalog):
    (catalog / "minifigs.csv.gz").write_bytes(gzip.compress("﻿Fig Num,Name,num-parts,img_url,2nd\nfig-9, Padded ,1,,x\n".encode()))
    with pytest.raises(ValueError, match="missing columns"):
        readers.scan_csv_catalog(spark, str(catalog), {"minifigs": ("fig_num", "colour")})
    row = readers.scan_csv_catalog(spark, str(catalog), {"minifigs": ("fig_num", "name", "num_parts")})["minifigs"].first()
    assert (row.fig_num, row.name, row.img_url, row.c_2nd) == ("fig-9", "Padded", None, "x")
    (catalog / "colors.csv").write_text("id,ID\n1,2\n")
    with pytest.raises(ValueError, match="duplicate headers"):
        readers.scan_csv_catalog(spark, str(catalog), {"colors": ("id",)})
    (catalog / "sets.csv").write_text("set_num,name\na,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.scan_csv_catalog(spark, str(catalog), {"sets": ("set_num",)})["sets"].collect()
    with pytest.raises(FileNotFoundError):
        readers.scan_csv_catalog(spark, str(catalog), {"nothing": ()})


def test_empty_mandatory_table_raises(spark, catalog):
    (catalog / "sets.csv").write_text("set_num,name,year,theme_id,num_parts,img_url\n")
    tables = readers.scan_csv_catalog(spark, str(catalog))
    with pytest.raises(Exception, match="mandatory table is empty: sets"):
        dq.integrity_counts(tables, {}, (), ["sets"]).collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": "x"}\n\n{"id": 2, "s": "y"}\n')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'{"id": 3, "s": "z"}\n'))
    df = readers.scan_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")], "id int, s string")
    assert values(df, "id", "s") == [(1, "x"), (2, "y"), (3, "z")]
    lines = readers.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, s string", line_numbers=True)
    assert values(lines, "id", "line_no") == [(1, 1), (2, 3)]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.scan_jsonl(spark, str(tmp_path / "bad.jsonl"), "id int").collect()


@pytest.mark.parametrize("doc", ['[{"id": 1}, {"id": 2}]', '{"meta": 3, "items": [{"id": 1}, {"id": 2}]}', '{"records": [{"id": 1}, {"id": 2}]}'])
def test_records_document(spark, tmp_path, doc):
    (tmp_path / "d.json").write_text(doc)
    assert values(readers.scan_records_document(spark, str(tmp_path / "d.json"), "struct<id:int>"), "id") == [(1,), (2,)]


def test_decision_files_keep_broken_ones(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"fig_num": "a", "n": 2}')
    (tmp_path / "zz.json").write_text("{oops")
    got = values(readers.scan_decision_files(spark, f"{tmp_path}/*.json", "fig_num:string, n:int"), "source_file", "fig_num", "n", "parse_error")
    assert got == [("ok.json", "a", 2, False), ("zz.json", None, None, True)]


def test_file_tree_scores_and_forms(spark, tmp_path):
    (tmp_path / "minifig" / "head").mkdir(parents=True)
    (tmp_path / "minifig" / "head" / "face.png").write_bytes(b"png!")
    (tmp_path / "minifig" / "head" / "face.svg").write_text("<svg/>")
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    tree = readers.scan_file_tree(spark, str(tmp_path), hash_under=50)
    got = {r.relative_path: r for r in tree.collect()}
    assert got["big.bin"].sha256 is None and got["big.bin"].top_folder == "" and got["big.bin"].asset_class == "other"
    assert got["minifig/head/face.png"].sha256 == hashlib.sha256(b"png!").hexdigest() and got["minifig/head/face.png"].asset_class == "raster_image"
    scored = {r.relative_path: r.score for r in readers.score_tree(tree, ["minifig", "head"], ["face"]).collect()}
    assert scored == {"minifig/head/face.png": 73, "minifig/head/face.svg": 58}
    forms = {r.relative_stem: sorted(r.files) for r in readers.form_groups(tree).collect()}
    assert forms["minifig/head/face"] == ["png", "svg"]


def test_zip_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a/one.png", b"1" * 10)
        z.writestr("two.txt", b"2" * 100)
    got = {r.entry: r for r in readers.scan_zip_entries(spark, str(tmp_path / "b.zip"), hash_under=50).collect()}
    assert got["a/one.png"].sha256 == hashlib.sha256(b"1" * 10).hexdigest() and got["a/one.png"].asset_class == "raster_image"
    assert got["two.txt"].hash_status == "skipped_large_entry" and got["two.txt"].bytes == 100


def test_headered_text(spark, tmp_path):
    (tmp_path / "3626p01.dat").write_text("0 Minifig Head with Smile Pattern\n0 Name: 3626p01.dat\n0 Author: Someone\n0 !LDRAW_ORG Part\n0 !LICENSE CC\n0 !KEYWORDS face, smile\n0 !KEYWORDS grin\n1 16 0 0 0\n")
    (tmp_path / "3001.dat").write_text("0 Brick 2 x 4\n0 Name: 3001.dat\n")
    df = readers.scan_headered_text(spark, str(tmp_path))
    row = readers.select_catalog(df, "patterned").first()
    assert (row.description, row.name, row.author, row.org, row.license, row.keywords) == ("Minifig Head with Smile Pattern", "3626p01.dat", "Someone", "Part", "CC", ["face", "grin", "smile"])
    assert readers.select_catalog(df, "all").count() == 2 and readers.select_catalog(df, "minifig").count() == 1


def test_svg_profile(spark, tmp_path):
    (tmp_path / "smile front.svg").write_text('<svg><!-- <path/> --><path fill="#000" stroke="none"/><path style="fill:#fff"/><circle fill="#000"/></svg>')
    row = readers.svg_element_profile(spark, str(tmp_path)).first()
    assert row.elements == {"circle": 1, "path": 2, "svg": 1} and row.fills == {"#000": 2, "#fff": 1} and row.strokes == {"none": 1}
    assert row.side_hint == "front" and row.filename_words == ["smile", "front"]


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 10
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 77, 99) + b"\0" * 8
    vp8x = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    vp8l = b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + ((49) | (39 << 14)).to_bytes(4, "little")
    vp8 = b"RIFF" + b"\0" * 4 + b"WEBPVP8 " + b"\0" * 4 + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 64, 32)
    files = {"png": png, "gif": gif, "jpeg": jpeg, "vp8x": vp8x, "vp8l": vp8l, "vp8": vp8, "txt": b"hello world, no image"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: (r.image_format, r.width, r.height, r.error) for r in readers.image_headers(df).collect()}
    assert got == {"png": ("png", 640, 480, None), "gif": ("gif", 30, 20, None), "jpeg": ("jpeg", 99, 77, None), "vp8x": ("webp", 300, 200, None), "vp8l": ("webp", 50, 40, None),
                   "vp8": ("webp", 64, 32, None), "txt": (None, None, None, "unsupported_image_format")}


def test_corrections_hold_only_for_the_expected_name(spark):
    rows = spark.createDataFrame([(i, {"name": n, "hue": "red"}) for i, n in enumerate(["Käpt'n  Blau", "other", None, "kept", "x"])] + [(None, {"name": "null row"})], "row long, fields map<string,string>")
    fixes = spark.createDataFrame([(0, "KÄPT'N BLAU", {"hue": "blue", "mood": "calm"}, ["name"], 0.8, "seen"), (1, "someone", {"hue": "blue"}, [], 0.8, "seen"), (2, "any", {"hue": "blue"}, ["hue"], 0.8, None), (4, " ", None, None, None, "empty"), (None, "", {"hue": "grey"}, [], 1.0, "null key")],
                                  "row long, expected_name string, corrected map<string,string>, cleared array<string>, confidence double, rationale string")
    got = {r["row"]: r for r in readers.apply_corrections(rows, fixes, ["row"], "name").collect()}
    assert got[0].fields == {"name": None, "hue": "blue", "mood": "calm"} and got[0].correction.original == {"name": "Käpt'n  Blau", "hue": "red", "mood": None} and got[0].correction.rationale == "seen"
    assert got[1].correction is None and got[1].fields["hue"] == "red" and got[3].correction is None
    assert got[2].fields["hue"] is None and got[4].fields == {"name": "x", "hue": "red"} and got[4].correction.rationale == "empty" and got[None].fields["hue"] == "grey"
    with pytest.raises(Exception, match="two corrections"):
        readers.apply_corrections(rows, fixes.unionAll(fixes), ["row"], "name").collect()


def test_map_columns_by_tab(spark):
    rows = spark.createDataFrame([(1, "DC", {"A": "Name", "B": "First Appearance"}), (2, "DC", {"A": "Robin", "B": " "}), (3, "MV", {"C": "Hulk"}), (4, "XX", {"A": "?"})], "row int, tab string, cells map<string,string>")
    mapping = spark.createDataFrame([("DC", "name", "A"), ("DC", "first_appearance", "B"), ("MV", "name", "C")], "tab string, field string, letter string")
    got = {r.row: r.fields for r in readers.map_columns_by_tab(rows, mapping, "tab", "cells", ["row"]).collect()}
    assert got == {2: {"name": "Robin"}, 3: {"name": "Hulk"}}


def test_flatten_scalars(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x", "d": [true, null]}}')], "id int, payload string")
    assert values(readers.flatten_scalars(df, "id", "payload"), "path", "value") == [("a", "1"), ("b.c", "x"), ("b.d[0]", "true"), ("b.d[1]", None)]
    with pytest.raises(Exception, match="nests deeper"):
        readers.flatten_scalars(df, "id", "payload", 1).collect()


def test_fixed_shards(spark, tmp_path):
    writers.write_fixed_shards(spark.range(25).repartition(4), str(tmp_path / "out"), ["id"], 10)
    back = spark.read.json(str(tmp_path / "out"))
    assert values(back.groupBy("shard_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")), "shard_name", "n", "a") == [
        ("records-part-01", 10, 0), ("records-part-02", 10, 10), ("records-part-03", 5, 20)]


def test_publish_keeps_old_data_when_a_check_fails(spark, tmp_path):
    path = str(tmp_path / "table")
    doubled = [("duplicate ids", lambda df: df.groupBy("id").count().where("count > 1"))]
    with pytest.raises(FileNotFoundError):
        writers.published(spark, path)
    assert writers.publish(spark.range(5), path, doubled) == 5
    with pytest.raises(DataQualityError):
        writers.publish(spark.range(3).unionAll(spark.range(1)), path, doubled)
    assert writers.published(spark, path).count() == 5
    for n in (7, 8, 9):
        assert writers.publish(spark.range(n), path, doubled) == n and writers.published(spark, path).count() == n
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("data-")]) == 2


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_crash_between_any_two_steps_leaves_a_readable_table(spark, tmp_path, monkeypatch, at):
    """The writer dies before the commit, with a commit of no content, or after it."""
    path, real = str(tmp_path / "table"), writers._commit
    writers.publish(spark.range(5), path)

    def dying(s, root, number, folder):
        if at == 1:
            open(f"{root}/_commits/{number:020d}", "w").close()
        if at == 2:
            real(s, root, number, folder)
        raise OSError("lost")

    monkeypatch.setattr(writers, "_commit", dying)
    with pytest.raises(OSError):
        writers.publish(spark.range(6), path)
    monkeypatch.undo()
    assert writers.published(spark, path).count() == (6 if at == 2 else 5)
    assert writers.publish(spark.range(7), path) == 7 and writers.published(spark, path).count() == 7


def test_of_two_writers_one_raises(spark, tmp_path):
    path = str(tmp_path / "table")
    other = [("meanwhile", lambda df: (writers.publish(df.sparkSession.range(3), path), df.where("false"))[1])]
    with pytest.raises(Exception, match="(?i)exist"):
        writers.publish(spark.range(5), path, other)
    assert writers.published(spark, path).count() == 3


def test_dedup_or_fail(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")]
    df = spark.createDataFrame(rows, "k string, v int, file string")
    assert values(dq.dedup_or_fail(df, ["k"], ["file"]), "k", "v") == [("a", 1), ("b", 2)]
    assert values(dq.conflicts(df, ["k"]), "k", "payloads") == [("a", 2)]
    with pytest.raises(Exception, match="conflicting payloads"):
        dq.dedup_or_fail(df, ["k"]).collect()


def test_observed_metrics(spark, tmp_path):
    frame, watch = writers.observed(spark.range(10), "run", total=F.sum("id"))
    frame.write.parquet(str(tmp_path / "o"))
    assert watch.get == {"rows": 10, "total": 45}


def test_run_manifest(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    src = writers.source_manifest(spark, {"a": str(tmp_path / "a")}, {"a": df})
    row = writers.run_manifest(src, "v1", "policy", dq.integrity_counts({"a": df}, {"a": ["id"]})).first()
    assert row.sources[0].row_count == 4 and row.sources[0].column_names == ["id"] and len(row.integrity) == 2 and len(row.sources[0].content_digest) == 64
