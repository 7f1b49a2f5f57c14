import pytest
from pyspark.sql import functions as F

from curatrix.functions import components as C
from curatrix.functions import ids, rules, text
from curatrix.functions.reference import with_reference


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("Crème & Brûlée", "creme and brulee"), ("Straße", "strasse"), ("  ", ""), ("A_b-9", "a b 9")])
def test_norm_text(spark, raw, want):
    assert one(spark, text.norm_text("s"), s=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("CloneCommander_PhaseII", ["clone", "commander", "phase2"]), ("FirstOrder Cpt", ["firstorder", "captain"]), ("Geonosian Lt", ["geonosis", "lieutenant"]),
    ("cmdx lt", ["cmdx", "lieutenant"])])
def test_semantic_tokens(spark, raw, want):
    assert one(spark, text.semantic_tokens("s"), s=raw) == want


def test_alias_keys_replace_whole_words_only(spark):
    assert one(spark, text.alias_keys("s"), s="mark iii suit") == ["mark 3 suit", "mark iii suit"]
    assert one(spark, text.alias_keys("s"), s="mark 2") == ["mark 2", "mark ii"]


@pytest.mark.parametrize("raw, want", [
    ("Theme/Series 1/Cowboy", "Cowboy"), ("Theme/Johnny Thunder/Johnny Thunder Winter face", "Johnny Thunder Winter"), ("leaf head", "leaf"),
    ("Theme/Indiana/torso front", "Indiana")])
def test_subject_from_path(spark, raw, want):
    assert one(spark, text.subject_from_path("s"), s=raw) == want


def test_catalog_href_keeps_missing_parts_null(spark):
    v = one(spark, text.catalog_href("s", F.lit(" Name ")), s="https://x.test/figures/12/brand%20a")
    assert (v.catalog_id, v.brand_slug, v.serial_slug, v.anchor_text) == (12, "brand a", None, "Name")
    assert one(spark, text.catalog_href("s", F.lit("x")), s="/figures/abc") is None


def test_clean_title(spark):
    assert one(spark, text.clean_title("s", F.lit("sw0001a")), s="Luke  Skywalker : Minifigure sw0001a | BrickLink") == "Luke Skywalker"
    assert one(spark, text.clean_title("s", F.lit("sw9")), s="Luke : Minifigure sw0001a") == "Luke : Minifigure sw0001a"


REFERENCES = [
    ('X-Factor v3 #1', "comic_issue_explicit", "x factor|v3|regular|i1"), ("X-Factor (Vol. 3) #1", "comic_issue_explicit", "x factor|v3|regular|i1"),
    ("X-Factor Vol. 3 #1 (2006)", "comic_issue_explicit", "x factor|v3|regular|i1"), ("Hulk Annual #4", "comic_issue_explicit", "hulk|v?|annual|i4"),
    ("Titans (2nd series) #8–13", "comic_issue_explicit", "titans|v2|regular|i8-13"), ("Avengers #24.NOW (digital)", "comic_issue_explicit", "avengers|v?|regular|i24.now"),
    ("The Show S02E05", "episode_explicit", "episode|the show|s2|e5"), ("The Show Season 1 Episode 3", "episode_explicit", "episode|the show|s1|e3"),
    ("Episode 7", "episode_number_without_work", None), ("Some Game (2004)", "dated_work", None), ("Work (May 2001) (digital)", "dated_work", None),
    ("1999", "year_only", None), ('"The Trap"', "quoted_title_candidate", None), ("just words", "raw_only", None), ("", "empty", None)]


def test_references(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in REFERENCES], "raw string")
    got = {r.raw: (r.reference.kind, r.reference.canonical_key) for r in with_reference(df, "raw").collect()}
    assert got == {r: (k, c) for r, k, c in REFERENCES}


def test_reference_details(spark):
    row = with_reference(spark.createDataFrame([("Spider-Man #23.1: Aftermath (digital) (2013)",)], "raw string"), "raw").first().reference
    assert (row.source_work, row.issue, row.subtitle, row.qualifiers, row.year_hint) == ("Spider-Man", "23.1", "Aftermath", ["digital"], 2013)


def test_digest_includes_nulls_and_sorts_keys(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"a": "1", "b": None}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert one(spark, ids.canonical_digest({"b": F.lit(None).cast("string"), "a": F.col("s")}), s="1") == want


def test_split_matches_hash_arithmetic(spark):
    import hashlib

    keys = [f"group-{i}" for i in range(500)]
    got = {r.k: r.v for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", ids.hash_fraction_split("k").alias("v")).collect()}
    for k in keys:
        v = int(hashlib.sha256(k.encode()).hexdigest()[:16], 16) / 16**16
        assert got[k] == ("train" if v < 0.8 else "validation" if v < 0.9 else "test")
    with pytest.raises(ValueError):
        ids.hash_fraction_split("k", 0.9, 0.1)


def test_rule_order_and_word_bounds(spark):
    ladder = rules.classify_ladder("s", rules.COMPONENT_ROLES)
    assert one(spark, ladder, s="Cape Red") == "headgear"
    assert one(spark, rules.classify_ladder("s", rules.COMPONENT_ROLES, word_bounded=True), s="Cape Red") == "bodywear"


@pytest.mark.parametrize("words, want", [(["Hoth", "Hood"], "mixed_semantics"), (["12"], "opaque_source_code"), ([], "no_suffix"), (["zzz"], "other_unclassified"), (["Hoth"], "location_or_scene")])
def test_suffix_routes(spark, words, want):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(rules.primary_route(rules.suffix_routes("w")).alias("v")).first()["v"] == want


def test_zero_is_present_and_blank_is_not(spark):
    assert one(spark, rules.first_present(F.lit(" "), F.col("n"), F.lit("x")), n=0) == "0"


def test_sequence_ratio_is_ratcliff_obershelp(spark):
    assert abs(one(spark, rules.sequence_ratio("a", "b"), a="abcd", b="bcde") - 0.75) < 1e-9


def test_component_predicates(spark):
    rows = [("3626b", "Minifig Head Alien", None, None), ("x1", "Minifig Head Alien", None, None), ("x2", "Headwear Dome Helmet", None, None), ("x3", "Torso with Mask", None, "headgear"), ("x4", "Hat Dome", None, None)]
    df = spark.createDataFrame(rows, "part_num string, part_name string, print_of string, component_role string").select(F.struct("*").alias("c"))
    c = F.col("c")
    got = [tuple(r) for r in df.select(C.is_head(c), C.is_headgear(c), C.is_enclosure(c), F.size(C.modified_terms(c))).collect()]
    assert got == [(True, False, False, 0), (True, False, False, 1), (False, True, True, 0), (False, False, False, 0), (False, True, False, 0)]


TOPOLOGY = [
    (["modified_or_nonhuman_head"], [("x9", "Head Modified Alien")], [], "dedicated_nonstandard_head_no_separate_headgear", 0.99),
    ([], [("3626c", "Head with Balaclava")], [], "standard_head_print_only", 0.98),
    ([], [("3626c", "Head")], [("1", "Diver's Mask"), ("2", "Helmet")], "head_plus_helmet_plus_diving_facegear", 1.0),
    ([], [("3626c", "Head")], [("93561", "Guard")], "head_plus_sports_helmet_plus_faceguard", 1.0),
    ([], [("3626c", "Wolf Head")], [("5", "Mask Wolf")], "head_plus_separate_species_face_mask", 0.99),
    ([], [("3626c", "Head")], [("5", "Mask Plain")], "head_plus_separate_mask_untyped", 0.88),
    (["head_print_plus_headgear"], [("3626c", "Head Goggles")], [("7", "Hair Long")], "printed_face_cover_head_plus_nonmask_headgear", 0.97),
    ([], [("3626c", "Head")], [("8", "Hood")], "head_plus_separate_hood", 0.90), ([], [("3626c", "Head")], [("8", "Helmet")], "head_plus_separate_helmet", 0.82),
    ([], [("3626c", "Head")], [("8", "Crown")], "unresolved_topology", 0.0)]


def test_topology_rules(spark):
    part = "array<struct<part_num:string,print_of:string,part_name:string>>"
    rows = [(i, r, [(n, None, t) for n, t in h], [(n, None, t) for n, t in g]) for i, (r, h, g, _, _) in enumerate(TOPOLOGY)]
    df = spark.createDataFrame(rows, f"i int, routes array<string>, heads {part}, gear {part}")
    got = [(r.t.topology_class, r.t.confidence) for r in df.select("i", C.topology("routes", "heads", "gear").alias("t")).orderBy("i").collect()]
    assert got == [(c, p) for *_, c, p in TOPOLOGY]


def test_unicode_fold_takes_a_few_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "_ROWS", 3)
    values = pa.array(["Straße", None, "Crème", "ﬁ", "", "Å" * 5, "x"])
    want = ["strasse", None, "creme", "fi", "", "aaaaa", "x"]
    assert text._fold_unicode.func(values).to_pylist() == want
    assert text._fold_unicode.func(values.slice(2)).to_pylist() == want[2:] and text._fold_unicode.func(values.slice(7)).to_pylist() == []
