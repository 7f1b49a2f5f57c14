import pytest
from pyspark.sql import functions as F

from curatrix.operators import dq, queues, rank, review
from conftest import values

H = "a" * 64
ITEM = dict(feature="Cape", decision="omitted", confidence=0.9, evidence_basis="observed_in_both", notes=None)


def record(rid="r1", pair="p1", who="alice", status="submitted", role="reviewer", items=None, refs=(), sha=H, **kw):
    row = dict(
        schema=review.SCHEMA, review_id=rid, translation_pair_id=pair, reviewer=dict(reviewer_type="human", reviewer_id=who, model_id=None, model_revision=None, review_role=role),
        evidence=dict(source_image_url="https://a.test/s", lego_image_url="https://a.test/l", source_image_sha256=sha, lego_image_sha256=sha, evidence_scope="front_pair", claims_unobserved_surfaces=False),
        annotations=dict(regions={"head": [dict(ITEM)] if items is None else items}, identity_critical_features=[], mask_headgear_route=None, expression_translation=None),
        limitations=[], measurement_signal_refs=[], review_status=status, adjudicates_review_ids=list(refs), created_at="2026-01-01", provenance=[])
    for k, v in kw.items():
        top, _, sub = k.partition("__")
        if sub:
            row[top][sub] = v
        else:
            row[top] = v
    return row


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), review.REVIEW_SCHEMA)


def adjudicated(who="judge", refs=("r1", "r2"), **kw):
    return record("adj", who=who, status="adjudicated", role="adjudicator", refs=refs, **kw)


def status(spark, *rows):
    return review.adjudicate(review.flatten_reviews(frame(spark, *rows))).first()


OTHER = [dict(ITEM, decision="preserved")]
CASES = [
    ("needs_second_review", [record()]), ("agreement_candidate", [record(), record("r2", who="bob")]),
    ("needs_independent_second_review", [record(), record("r2", who=" ALICE ")]), ("needs_adjudication", [record(), record("r2", who="bob", items=OTHER)]),
    ("adjudicated", [record(), record("r2", who="bob", items=OTHER), adjudicated()]),
    ("invalid_adjudicator_independence", [record(), record("r2", who="alice"), adjudicated()]),
    ("invalid_adjudicator_references", [record(), record("r2", who="bob"), adjudicated(refs=("r1", "zz"))]),
    ("adjudicator_conflict", [record(), record("r2", who="bob"), adjudicated(), dict(adjudicated(items=OTHER), review_id="adj2")]),
    ("evidence_conflict", [record(), record("r2", who="bob", sha="b" * 64)]), ("needs_exact_evidence", [record(), record("r2", who="bob", sha=None)]),
    ("draft_only", [record(status="draft")])]


@pytest.mark.parametrize("want, rows", CASES, ids=[c[0] for c in CASES])
def test_adjudication_ladder(spark, want, rows):
    got = status(spark, *rows)
    assert got.status == want and got.training_eligible == (want == "adjudicated")
    assert got.selected_review_id == ("adj" if want == "adjudicated" else None)


def test_payload_ignores_item_order(spark):
    a, b = dict(ITEM), dict(ITEM, feature="belt")
    df = frame(spark, record(items=[a, b]), record("r2", items=[b, a])).select(review.payload_json().alias("p"))
    assert df.distinct().count() == 1


def test_promotion(spark):
    rows = review.flatten_reviews(frame(spark, record(), record("r2", who="bob"), adjudicated(), record("r9", pair="p2")))
    done, skipped = review.promote(rows, review.adjudicate(rows))
    row = done.first()
    assert (row.item_id, row.canonical_review_id, row.independent_reviewers, row.violations) == ("p1", "adj", 2, [])
    assert values(skipped, "item_id", "status") == [("p2", "needs_second_review")]
    forged = review.adjudicate(rows).withColumn("selected_review_id", F.lit("r1"))
    bad = review.promote(rows, forged)[0].first().violations
    assert "selected review is not adjudicated" in bad and "selected review has no references" in bad
    with pytest.raises(dq.DataQualityError):
        dq.fail_if_any(review.promote(rows, forged)[0].where(F.size("violations") > 0), "promotion")


BROKEN = [
    (dict(schema="x"), "schema:unknown"), (dict(translation_pair_id=" "), "translation_pair_id"), (dict(reviewer__reviewer_type="bot"), "reviewer_type"),
    (dict(reviewer__reviewer_type="model"), "model_id:needed_for_model"), (dict(evidence__lego_image_url="http://x"), "lego_image_url"),
    (dict(evidence__source_image_sha256="zz"), "source_image_sha256"), (dict(evidence__claims_unobserved_surfaces=True), "claims_unobserved_surfaces"),
    (dict(annotations__regions={"tail": [ITEM]}), "regions:unknown"), (dict(annotations__regions={}), "annotations:needed_when_final"),
    (dict(created_at=None), "created_at:needed_when_final"), (dict(review_status="done"), "review_status"), (dict(adjudicates_review_ids=["x"]), ":only_when_adjudicated"),
    (dict(annotations__regions={"head": [dict(ITEM, confidence=1.5)]}), "confidence"), (dict(annotations__regions={"head": [dict(ITEM, decision="bad")]}), "decision"),
    (dict(annotations__regions={"head": [ITEM, dict(ITEM, feature=" cape")]}), "regions:repeated_decision"), (dict(limitations=[" "]), "limitations")]


def test_validation_rules(spark):
    rows = [record(f"v{i}", **change) for i, (change, _) in enumerate(BROKEN)]
    got = {r.review_id: r.errors for r in review.validate_reviews(frame(spark, record("good"), *rows)).collect()}
    assert got["good"] == []
    for i, (_, text) in enumerate(BROKEN):
        assert any(text in e for e in got[f"v{i}"]), (text, got[f"v{i}"])
    ok, bad = dq.split_valid(review.validate_reviews(frame(spark, record("good"), rows[0])))
    assert ok.count() == 1 and bad.count() == 1


def test_normalise_fills_a_stable_id(spark):
    df = frame(spark, record(None), record("kept"))
    ids = [r.review_id for r in review.normalise_reviews(df).collect()]
    assert ids[0].startswith("semreview-") and len(ids[0]) == 34 and ids[1] == "kept"
    assert [r.review_id for r in review.normalise_reviews(df.repartition(3)).orderBy("review_id").collect()] == sorted(ids)


def test_critic_items_and_hardcase_score(spark):
    items = [dict(ITEM), dict(ITEM, feature="eyes", decision="uncertain", evidence_basis="source_only", confidence=0.5), dict(ITEM, feature="belt", decision="preserved")]
    rows = review.critic_items(frame(spark, record(items=items), record("d", status="draft")), F.lit("f1"))
    assert values(rows, "feature", "decision", "critic_category") == [("Cape", "omitted", "feature_loss"), ("eyes", "uncertain", "review_uncertainty")]
    assert rows.where("canonical_eligible or training_eligible").count() == 0
    twice = rows.unionAll(rows.withColumn("source_review_file", F.lit("f2")))
    score = review.hardcase_score(dq.dedup_or_fail(twice, ["critic_id"], ["source_review_file"]), "translation_pair_id").first()
    assert (score.critic_item_count, score.priority_item_count, score.unpaired_uncertainty_count, score.hardcase_score) == (2, 1, 1, 5)
    changed = rows.unionAll(rows.withColumn("confidence", F.lit(0.1)))
    with pytest.raises(Exception, match="conflicting payloads"):
        dq.dedup_or_fail(changed, ["critic_id"], ["source_review_file"]).collect()


def test_compile_submission(spark):
    batch = spark.createDataFrame([("p1", "https://a", "https://b", H, H)], "translation_pair_id string, source_image_url string, lego_image_url string, source_image_sha256 string, lego_image_sha256 string")
    rows = spark.createDataFrame([("p1", [["head", "eyes", "preserved", "0.9", "observed_in_both", ""], ["torso", "logo", "omitted", "0.8", "observed_in_both", "n"]])], "translation_pair_id string, items array<array<string>>")
    out = review.compile_submission(batch, rows, "r", "m", "1", "2026-01-01")
    row = review.validate_reviews(out).first()
    assert row.errors == [] and sorted(row.annotations.regions) == ["head", "torso"] and row.annotations.regions["torso"][0].confidence == 0.8
    extra = rows.unionAll(spark.createDataFrame([("p9", [["head", "x", "omitted", "1", "observed_in_both", ""]])], rows.schema))
    with pytest.raises(Exception, match="differ at p9"):
        review.compile_submission(batch, extra, "r", "m", "1", "d").collect()


def test_template_is_a_draft(spark):
    q = spark.createDataFrame([("p1", "https://a", "https://b", [("s", "head", 1.0)])], "translation_pair_id string, source_image_url string, lego_image_url string, measurement_signals array<struct<signal:string,region:string,value:double>>")
    row = q.select(review.review_template("me").alias("t")).first().t
    assert row.review_status == "draft" and sorted(row.annotations.regions) == sorted(review.REGIONS) and row.reviewer.reviewer_id == "me"


def test_work_batches(spark):
    queue = spark.createDataFrame([(f"p{i}", float(i)) for i in range(6)], "pair string, score double")
    flat = review.flatten_reviews(frame(spark, record(pair="p5"), record("r2", pair="p4", who="bob"), record("r3", pair="p4", who="cy", items=OTHER)))
    statuses = review.adjudicate(flat)
    take = lambda mode, **kw: [r.pair for r in review.work_batch(queue, mode, "score", "pair", 2, reviews=flat, statuses=statuses, **kw).collect()]
    assert take("first_review") == ["p3", "p2"] and take("first_review", offset=1, min_score=2.0) == ["p2"]
    assert take("second_review", reviewer="bob") == ["p5"] and take("second_review", reviewer="Alice ") == [] and take("adjudication") == ["p4"]
    with pytest.raises(ValueError):
        review.work_batch(queue, "other", "score", "pair")
    with pytest.raises(Exception, match="exact evidence"):
        review.blind_second_review(queue.withColumn("ev", F.lit(None).cast("string")), ["score"], "ev").collect()


D1, D2 = "a" * 64, "b" * 64
PERSON = "reviewer struct<reviewer_id:string,reviewer_type:string,model_family:string,model_id:string,model_revision:string,review_method:string>, review_confidence double, notes array<string>"
ASSET = f"n int, source_record_id string, schema string, decision string, source_file_sha256 string, sanitized_pixel_sha256 string, sanitized_png_sha256 string, checks map<string,boolean>, reviewed_at string, {PERSON}"


def asset_review(n, **kw):
    base = dict(source_record_id="a", schema=review.ASSET_SCHEMA, decision="approved", source_file_sha256=D1, sanitized_pixel_sha256=D1, sanitized_png_sha256=D1, checks=dict.fromkeys(review.ASSET_CHECKS, True), reviewed_at="2026", reviewer=("r", "human", None, None, None, "eye"), review_confidence=0.5, notes=[])
    return dict(base, n=n, **kw)


def test_asset_reviews(spark):
    candidates = spark.createDataFrame([(k, D1, D1, D1) for k in "ab"], "source_record_id string, source_file_sha256 string, sanitized_pixel_sha256 string, sanitized_png_sha256 string")
    failed = {**dict.fromkeys(review.ASSET_CHECKS, True), "identity_preserved": False}
    cases = [
        (dict(), set()), (dict(source_record_id="z"), {"source_record_id:no_candidate"}), (dict(source_record_id="z", decision="revise", notes=["old"]), set()), (dict(source_file_sha256=D2), {"source_file_sha256:differs"}),
        (dict(source_file_sha256=D2, decision="rejected", notes=["no"], checks=failed), set()), (dict(decision="rejected"), {"notes:needed_unless_approved"}), (dict(checks=failed), {"checks:fail_when_approved"}),
        (dict(checks={**failed, "mood": True}, decision="revise", notes=["x", " "]), {"checks:unknown", "notes:not_texts"}), (dict(reviewer=("r", "model", None, "m", "", "eye")), {"reviewer.model_revision:needed_for_model"}),
        (dict(reviewer=None, schema="s", reviewed_at=" ", review_confidence=float("nan")), {"reviewer:missing", "reviewer.reviewer_id:empty", "reviewer.reviewer_type:unknown", "schema:unknown", "reviewed_at:empty", "review_confidence:out_of_range"}),
        (dict(sanitized_png_sha256=D1.upper(), decision="maybe"), {"sanitized_png_sha256:not_a_digest", "decision:unknown"}),
        (dict(checks=None, decision="revise", notes=["x"]), {"checks:missing", *[f"checks.{c}:open" for c in review.ASSET_CHECKS]})]
    df = spark.createDataFrame([asset_review(i, **kw) for i, (kw, _) in enumerate(cases)], ASSET)
    out = review.asset_review_errors(df, candidates).orderBy("n").collect()
    assert [set(r.errors) for r in out] == [want for _, want in cases]
    assert out[0].model_input_allowed and not out[5].model_input_allowed and out[0].review_id.startswith("sanreview-") and out[0].review_id != out[5].review_id
    with pytest.raises(Exception, match="given twice"):
        review.asset_review_errors(df, candidates.unionAll(candidates)).collect()


SOURCE = f"source_record_id string, source_id string, source_file_sha256 string, status string, identity_match string, primary_view string, primary_figure_complete string, visible_text_leakage array<string>, visual_confounders array<string>, sanitization_action string, raw_model_input_allowed boolean, {PERSON}"


def source_review(key, **kw):
    base = dict(source_id="s", source_file_sha256=D1, status="approved_raw", identity_match="true", primary_view="side", primary_figure_complete="true", visible_text_leakage=[], visual_confounders=[], sanitization_action="none", raw_model_input_allowed=True, reviewer=("r", "hybrid", "f", None, None, "eye"), review_confidence=1.0, notes=[])
    return dict(base, source_record_id=key, **kw)


def test_source_review_findings(spark):
    queue = spark.createDataFrame([(k, "s", D1) for k in "abcdefg"], "source_record_id string, source_id string, source_file_sha256 string")
    clean = dict(status="sanitization_required", raw_model_input_allowed=False, sanitization_action="mask_regions")
    rows = [
        source_review("a"), source_review("b"), source_review("b"), source_review("x"), source_review("c", visible_text_leakage=["logo"], primary_figure_complete="uncertain"),
        source_review("d", **clean), source_review("e", **{**clean, "sanitization_action": "none", "raw_model_input_allowed": True}), source_review("f", **clean | dict(identity_match="false"), primary_view="top")]
    got = set(values(review.source_review_findings(queue, spark.createDataFrame(rows, SOURCE)), "source_record_id", "finding"))
    assert got == {
        ("b", "duplicate_review"), ("x", "source_record_id:unknown"), ("g", "unreviewed_record"), ("c", "visible_text_leakage:against_approval"), ("c", "primary_figure_complete:against_approval"),
        ("e", "raw_model_input_allowed:against_sanitization"), ("e", "sanitization_action:needed"), ("f", "sanitization_action:replace_other_identity"), ("f", "primary_view:unknown")}


def test_progress_of_batches_and_plan(spark):
    plan = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (2, "a")], "batch_index int, item_id string")
    rows = [("a", "r1", "E", "submitted"), ("a", "r2", "E", "submitted"), ("b", "r1", "E", "submitted"), ("b", "r2", "F", "submitted"), ("c", "r1", None, "submitted"), ("z", "r1", "E", "submitted"), ("c", "r9", "E", "adjudicated"), (None, "r1", "E", "submitted")]
    reviews = spark.createDataFrame([(i, w, e, s, "adjudicator" if s == "adjudicated" else "reviewer") for i, w, e, s in rows], "item_id string, principal string, evidence string, review_status string, review_role string")
    got = {r.batch_index: r for r in review.progress(plan, reviews).collect()}
    pick = lambda r: (r.selected_records, r.submitted_items, r.submitted_reviews, r.double_reviewed_items, r.evidence_blocked_items, r.adjudicated_items, r.inexact_items, r.outside_plan, r.remaining_items, r.first_review_complete, r.next_batch)
    assert pick(got[1]) == (2, 2, 4, 1, 1, 0, 0, 0, 0, True, False) and pick(got[2]) == (3, 2, 3, 1, 0, 1, 1, 0, 1, False, True) and pick(got[3])[-2:] == (False, False)
    assert pick(got[None]) == (5, 3, 5, 1, 1, 1, 1, 1, 2, False, True)


REF = "sample_id string, derived_asset_id string, component_type string, view string, medium string, authority string, sha256 string, width double, height double, identity_confidence double, view_confidence double, segmentation_confidence double, blur_score double, occlusion_score double, bad boolean"


def asset(i, sha="h", conf=0.0, bad=False, **kw):
    base = dict(sample_id="s", derived_asset_id=i, component_type="face", view="back", medium="photo", authority="structured_catalog", sha256=sha, width=100.0, height=100.0, identity_confidence=conf, view_confidence=0.0, segmentation_confidence=0.0, blur_score=0.0, occlusion_score=0.0, bad=bad)
    return dict(base, **kw)


def test_slots(spark):
    rows = [asset("a1", "same", 0.5), asset("a2", "same", 0.1), asset("b1", "other", 0.4), asset("z9", "top", 1.0, bad=True), asset("q", "q", medium="film still")]
    df = spark.createDataFrame(rows, REF).withColumn("slot", rank.evidence_slot()).withColumn("score", rank.evidence_score())
    got = {r.slot: r for r in rank.resolve_slots(df, "sample_id", "slot", "derived_asset_id", "sha256", "score", "bad").collect()}
    head = got["head_reverse"]
    assert (head.preferred_asset_id, head.alternate_asset_ids, head.occurrence_count, head.preferred_score) == ("a1", ["b1"], 3, 91.0)
    assert got["film_expression_states"].preferred_asset_id == "q"
    zero = spark.createDataFrame([asset("n", conf=0.0)], REF).select(rank.evidence_score().alias("s")).first().s
    assert zero == 81.0
    missing = rank.slot_completeness(df, "sample_id", "slot").first().missing_roles
    assert missing == list(rank.REQUIRED_SLOTS)


CAND = "struct<id:string,name:string,words:array<string>,compact:string,set_words:array<string>,parts:array<string>>"


def candidate(i, name, sets=(), parts=()):
    return (i, name, name.lower().split(), name.lower().replace(" ", ""), list(sets), list(parts))


FAMILY = [
    (["snoke"], False, [], "", 0.2, [candidate("1", "Supreme Leader Snoke")], "no_semantic_suffix", "unique_physical_release_candidate", 1),
    (["rancor"], False, [], "", 0.2, [candidate("1", "Big Rancor Battalion")], "no_semantic_suffix", "no_supported_physical_release_candidate", 0),
    (["han", "solo"], False, ["hoth"], "hoth", 0.2, [candidate("1", "Han Solo Hoth"), candidate("2", "Han Solo")], "suffix_catalog_text_match", "unique_physical_release_candidate", 2),
    (["han", "solo"], False, ["hoth"], "hoth", 0.2, [candidate("1", "Han Solo", ["hoth", "base"])], "suffix_set_context_match", "unique_physical_release_candidate", 1),
    (["han", "solo"], False, ["hoth"], "hoth", 0.2, [candidate("1", "Han Solo")], "suffix_not_resolved_in_supported_candidates", "variant_constrained_physical_release_unresolved", 1),
    (["rex"], False, ["no", "helmet"], "nohelmet", 0.2, [candidate("1", "Captain Rex", parts=["clone helmet"]), candidate("2", "Captain Rex")], "negative_feature_explicit_contradictions_filtered", "variant_constrained_physical_release_unresolved", 2),
    (["8d8"], True, [], "", 0.2, [candidate("1", "R5 D8"), candidate("2", "Droid 8D8")], "no_semantic_suffix", "unique_physical_release_candidate", 1)]


def test_family_class(spark):
    rows = [(i, w, "".join(w), code, s, t, m, c) for i, (w, code, s, t, m, c, *_) in enumerate(FAMILY)]
    df = spark.createDataFrame(rows, f"i int, label_words array<string>, compact_label string, code_like boolean, suffix_words array<string>, suffix_text string, margin double, candidates array<{CAND}>")
    got = [(r.constraint_status, r.release_status, r.support_count) for r in queues.family_class(df).orderBy("i").collect()]
    assert got == [(c, r, n) for *_, c, r, n in FAMILY]


def test_landmark_review_rank(spark):
    df = spark.createDataFrame([(["smile"], "front", 30, "Classics/x"), ([], None, 0, "zz")], "words array<string>, side_hint string, primitives int, path string")
    assert [r.priority_score for r in queues.landmark_review_rank(df, ["smile"]).collect()] == [160, 0]
