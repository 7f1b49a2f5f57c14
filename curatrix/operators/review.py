"""Review lifecycle: validation, adjudication, promotion, critic items, progress and work batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions.ids import canonical_digest, canonical_json
from curatrix.functions.rules import compact, reasons
from curatrix.operators.dq import with_errors

# Vocabulary of a review.
SCHEMA = "fortnite-semantic-review/v1"
REGIONS = ("head", "torso", "lower_body", "accessory_or_silhouette")
DECISIONS = (
    "preserved", "simplified", "omitted", "exaggerated", "moved_to_mould", "moved_to_accessory", "moved_to_cloth",
    "color_block_changed", "not_applicable", "uncertain",
)
BASES = ("observed_in_both", "source_only", "lego_only", "multi_view", "metadata_only", "uncertain")
SCOPES = ("front_pair", "wide_pair", "front_and_wide", "multi_view", "mixed", "unknown")
REVIEWER_TYPES = ("human", "model", "hybrid")
ROLES = ("reviewer", "adjudicator")
STATUSES = ("draft", "submitted", "adjudicated")
ITEM = "struct<feature:string,decision:string,confidence:double,evidence_basis:string,notes:string>"
REVIEW_SCHEMA = (
    "schema string, review_id string, translation_pair_id string, "
    "reviewer struct<reviewer_type:string,reviewer_id:string,model_id:string,model_revision:string,review_role:string>, "
    "evidence struct<source_image_url:string,lego_image_url:string,source_image_sha256:string,lego_image_sha256:string,"
    "evidence_scope:string,claims_unobserved_surfaces:boolean>, "
    f"annotations struct<regions:map<string,array<{ITEM}>>,identity_critical_features:array<string>,"
    "mask_headgear_route:string,expression_translation:string>, limitations array<string>, "
    "measurement_signal_refs array<struct<signal:string,region:string,value:double,role:string>>, review_status string, "
    "adjudicates_review_ids array<string>, created_at string, provenance array<map<string,string>>"
)


def principal(reviewer_id: Column | str = "reviewer.reviewer_id") -> Column:
    c = F.col(reviewer_id) if isinstance(reviewer_id, str) else reviewer_id
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def evidence_identity(evidence: Column | str = "evidence") -> Column:
    """``source|target|scope`` of exact evidence, or null when it is not exact."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    a, b, scope = e["source_image_sha256"], e["lego_image_sha256"], e["evidence_scope"]
    ok = a.rlike("^[0-9a-fA-F]{64}$") & b.rlike("^[0-9a-fA-F]{64}$") & (scope != "") & (~e["claims_unobserved_surfaces"])
    return F.when(ok, F.concat_ws("|", F.lower(a), F.lower(b), scope))


def shared_evidence(df: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """Whether all rows of a group carry one and the same exact evidence."""
    return df.groupBy(*keys).agg(
        ((F.count(identity) == F.count(F.lit(1))) & (F.min(identity) == F.max(identity))).alias("shared_evidence"))


def _items() -> Column:
    regions = F.map_entries("annotations.regions")
    return F.flatten(F.transform(regions, lambda r: F.transform(F.coalesce(r["value"], F.array().cast(f"array<{ITEM}>")),
                                                               lambda i: F.struct(r["key"].alias("region"), i.alias("item")))))


def annotation_count() -> Column:
    return F.coalesce(F.size(_items()), F.lit(0))


def validate_reviews(df: DataFrame) -> DataFrame:
    """Adds ``errors``: one code ``field:rule`` per broken rule, nested items included."""
    c = F.col
    filled = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    hashed = lambda x: x.isNull() | x.rlike("^[0-9a-fA-F]{64}$")
    listed = lambda name: F.coalesce(F.forall(c(name), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(True))
    final = F.coalesce(c("review_status").isin("submitted", "adjudicated"), F.lit(False))
    adjudicated = F.coalesce(c("review_status") == "adjudicated", F.lit(False))
    modelled = F.coalesce(c("reviewer.reviewer_type").isin("model", "hybrid"), F.lit(False))
    refs = F.coalesce(F.size("adjudicates_review_ids"), F.lit(0)) > 0
    regions = F.coalesce(F.map_keys("annotations.regions"), F.array().cast("array<string>"))
    person, proof, notes = c("reviewer"), c("evidence"), c("annotations")
    rules = [
        (c("schema") == SCHEMA, "schema:unknown"),
        (filled(c("translation_pair_id")), "translation_pair_id:empty"),
        *[(part.isNotNull(), f"{name}:missing") for name, part in (("reviewer", person), ("evidence", proof), ("annotations", notes))],
        (notes["regions"].isNotNull(), "annotations.regions:missing"),
        (person["reviewer_type"].isin(*REVIEWER_TYPES), "reviewer.reviewer_type:unknown"),
        (person["review_role"].isin(*ROLES), "reviewer.review_role:unknown"),
        (proof["evidence_scope"].isin(*SCOPES), "evidence.evidence_scope:unknown"),
        (c("review_status").isin(*STATUSES), "review_status:unknown"),
        (F.forall(regions, lambda r: r.isin(*REGIONS)), "annotations.regions:unknown"),
        (filled(person["reviewer_id"]), "reviewer.reviewer_id:empty"),
        *[(~modelled | filled(person[f]), f"reviewer.{f}:needed_for_model") for f in ("model_id", "model_revision")],
        *[(F.startswith(proof[f"{side}_image_url"], F.lit("https://")), f"evidence.{side}_image_url:not_https") for side in ("source", "lego")],
        *[(hashed(proof[f"{side}_image_sha256"]), f"evidence.{side}_image_sha256:not_a_digest") for side in ("source", "lego")],
        (~proof["claims_unobserved_surfaces"], "evidence.claims_unobserved_surfaces:set"),
        *[(listed(name), f"{name}:empty_item") for name in ("annotations.identity_critical_features", "limitations", "adjudicates_review_ids")],
        (~final | filled(c("created_at")), "created_at:needed_when_final"),
        (~final | (annotation_count() > 0), "annotations:needed_when_final"),
        (~adjudicated | F.coalesce(person["review_role"] == "adjudicator", F.lit(False)), "reviewer.review_role:not_adjudicator"),
        (~adjudicated | refs, "adjudicates_review_ids:needed_when_adjudicated"),
        (adjudicated | ~refs, "adjudicates_review_ids:only_when_adjudicated"),
    ]
    known = F.filter(_items(), lambda x: x["region"].isin(*REGIONS))
    checks = {
        "feature:empty": lambda i: F.trim(i["feature"]) != "", "decision:unknown": lambda i: i["decision"].isin(*DECISIONS),
        "confidence:out_of_range": lambda i: i["confidence"].between(0, 1) & ~F.isnan(i["confidence"]), "evidence_basis:unknown": lambda i: i["evidence_basis"].isin(*BASES)}

    def broken(code, ok):
        return lambda x: F.when(~F.coalesce(ok(x["item"]), F.lit(False)), F.concat(x["region"], F.lit(f".{code}")))

    nested = F.concat(*[F.transform(known, broken(code, ok)) for code, ok in checks.items()])
    keys = F.transform(known, lambda x: F.struct(x["region"], F.lower(F.trim(x["item"]["feature"])), x["item"]["decision"]))
    repeated = F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("annotations.regions:repeated_decision"))
    out = with_errors(df, rules, "_e")
    nested = F.coalesce(F.filter(nested, lambda m: m.isNotNull()), F.array().cast("array<string>"))
    return out.withColumn("errors", F.concat("_e", nested, compact(repeated))).drop("_e")


def payload_json() -> Column:
    """Canonical text of what two reviewers must agree on: sorted regions and items, features, routes."""
    order = lambda i: F.struct(
        F.lower(F.coalesce(i["feature"], F.lit(""))).alias("a"), F.coalesce(i["decision"], F.lit("")).alias("b"),
        F.coalesce(i["evidence_basis"], F.lit("")).alias("c"), F.coalesce(i["confidence"], F.lit(0.0)).alias("d"),
        F.coalesce(i["notes"], F.lit("")).alias("e"), i.alias("item"))
    fields = ("confidence", "decision", "evidence_basis", "feature", "notes")
    entry = lambda r: F.struct(r["key"].alias("region"), F.transform(
        F.array_sort(F.transform(r["value"], order)), lambda s: F.struct(*[s["item"][f].alias(f) for f in fields])).alias("items"))
    regions = F.array_sort(F.transform(F.map_entries("annotations.regions"), entry))
    features = F.array_sort(F.coalesce("annotations.identity_critical_features", F.array().cast("array<string>")))
    return canonical_json({
        "regions": regions, "identity_critical_features": features,
        "mask_headgear_route": F.col("annotations.mask_headgear_route"),
        "expression_translation": F.col("annotations.expression_translation")})


def normalise_reviews(df: DataFrame, version: str = "semantic-review-validator/v1") -> DataFrame:
    """Fill a missing review id from the canonical content and stamp the validator version."""
    content = canonical_digest({c: F.col(c) for c in ("translation_pair_id", "reviewer", "evidence", "annotations", "created_at")})
    made = F.concat(F.lit("semreview-"), F.left(content, F.lit(24)))
    return df.withColumn("review_id", F.coalesce(F.nullif(F.col("review_id"), F.lit("")), made)).withColumn(
        "validator_version", F.lit(version))


def flatten_reviews(df: DataFrame) -> DataFrame:
    """Nested reviews to the flat rows ``adjudicate`` works on."""
    return df.select(
        F.col("translation_pair_id").alias("item_id"), "review_id", "review_status", principal().alias("principal"),
        F.sha2(payload_json(), 256).alias("payload_hash"), evidence_identity().alias("evidence"),
        F.coalesce("adjudicates_review_ids", F.array().cast("array<string>")).alias("refs"), "created_at",
        F.col("reviewer.review_role").alias("review_role"))


def adjudicate(reviews: DataFrame) -> DataFrame:
    """One status per item from flat reviews.

    Input: ``item_id, review_id, review_status, principal, payload_hash, evidence, refs``. Distinct counts come
    from two-level aggregation; the referenced ids are checked by an equi-join on ``(item, review id)``.
    """
    c = F.col
    submitted, final = c("review_status") == "submitted", c("review_status") == "adjudicated"
    bound = submitted | final
    distinct = lambda cond, value: F.count_distinct(F.when(cond, value))
    base = reviews.groupBy("item_id").agg(
        F.count_if(submitted).alias("submitted_count"), F.count_if(c("review_status") == "draft").alias("draft_count"),
        F.count_if(final).alias("adjudicated_count"), distinct(submitted, c("payload_hash")).alias("submitted_payloads"),
        distinct(submitted, c("principal")).alias("independent_reviewers"), distinct(final, c("payload_hash")).alias("adjudicated_payloads"),
        distinct(bound, c("evidence")).alias("evidence_variants"), F.count_if(bound & c("evidence").isNull()).alias("evidence_missing"),
        F.min(F.when(final, F.coalesce("review_id", F.lit("")))).alias("_selected"))
    wanted = reviews.where(final).select("item_id", c("review_id").alias("by"), F.explode_outer("refs").alias("ref"))
    given = reviews.where(submitted & c("review_id").isNotNull()).select("item_id", c("review_id").alias("ref"), "principal").distinct()
    checked = wanted.join(given.withColumn("_hit", F.lit(True)), ["item_id", "ref"], "left").groupBy("item_id", "by").agg(
        F.count_if(c("ref").isNotNull() & c("_hit").isNull()).alias("_lost"), F.count_distinct("principal").alias("_who"))
    errors = checked.groupBy("item_id").agg(
        F.count_if(c("_lost") > 0).alias("reference_errors"), F.count_if((c("_lost") == 0) & (c("_who") < 2)).alias("independence_errors"))
    out = base.join(errors, "item_id", "left")
    for name in ("reference_errors", "independence_errors"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    status = (
        F.when(c("evidence_missing") > 0, "needs_exact_evidence").when(c("evidence_variants") > 1, "evidence_conflict")
        .when(c("reference_errors") > 0, "invalid_adjudicator_references")
        .when(c("independence_errors") > 0, "invalid_adjudicator_independence")
        .when(c("adjudicated_payloads") > 1, "adjudicator_conflict").when(c("adjudicated_count") >= 1, "adjudicated")
        .when((c("submitted_count") >= 2) & (c("independent_reviewers") < 2), "needs_independent_second_review")
        .when((c("submitted_count") >= 2) & (c("submitted_payloads") == 1), "agreement_candidate")
        .when(c("submitted_count") >= 2, "needs_adjudication").when(c("submitted_count") == 1, "needs_second_review")
        .otherwise("draft_only"))
    out = out.withColumn("status", status)
    return out.withColumn("training_eligible", c("status") == "adjudicated").withColumn(
        "selected_review_id", F.when(c("status") == "adjudicated", c("_selected"))).drop("_selected")


def promote(reviews: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjudicated queue rows with their supervision facts, and skipped rows with a reason.

    A promoted row whose selected review breaks a rule carries the broken rules in ``violations``; callers fail
    on any (``dq.fail_if_any``).
    """
    c = F.col
    eligible = (c("status") == "adjudicated") & c("training_eligible") & c("selected_review_id").isNotNull()
    skipped = queue.where(~F.coalesce(eligible, F.lit(False))).select("item_id", "status", F.lit("not_explicitly_adjudicated").alias("reason"))
    chosen = queue.where(eligible).select("item_id", c("selected_review_id").alias("review_id"))
    picked = chosen.join(reviews.select(
        "review_id", c("item_id").alias("r_item"), c("review_status").alias("r_status"), c("review_role").alias("r_role"),
        c("evidence").alias("r_evidence"), "refs"), "review_id", "left")
    refs = picked.select("item_id", "review_id", F.explode_outer("refs").alias("ref"), "r_evidence").join(
        reviews.select(c("review_id").alias("ref"), c("item_id").alias("f_item"), c("review_status").alias("f_status"), "principal",
                       c("evidence").alias("f_evidence")), "ref", "left")
    seen = refs.groupBy("item_id", "review_id").agg(
        F.count_distinct("principal").alias("independent_reviewers"), F.count("ref").alias("ref_count"),
        F.count_if(c("ref").isNotNull() & c("f_item").isNull()).alias("_lost"),
        F.count_if(c("f_item") != c("item_id")).alias("_foreign"), F.count_if(c("f_status") != "submitted").alias("_state"),
        F.count_if(~F.coalesce(c("f_evidence") == c("r_evidence"), F.lit(False))).alias("_evidence"))
    rows = picked.drop("refs").join(seen, ["item_id", "review_id"])
    bad = reasons(
        (c("r_item").isNull(), "selected review is missing"), (c("r_item") != c("item_id"), "selected review belongs to another item"),
        (c("r_status") != "adjudicated", "selected review is not adjudicated"), (c("r_role") != "adjudicator", "selected review is not from an adjudicator"),
        (c("ref_count") == 0, "selected review has no references"), (c("_lost") > 0, "referenced review is missing"),
        (c("_foreign") > 0, "referenced review belongs to another item"), (c("_state") > 0, "referenced review is not submitted"),
        (c("independent_reviewers") < 2, "fewer than two independent reviewers"), (c("_evidence") > 0, "reviews refer to different evidence"))
    return rows.select("item_id", c("review_id").alias("canonical_review_id"), "independent_reviewers", bad.alias("violations")), skipped


def review_conflicts(df: DataFrame, key: str, fields: Sequence[str], skip: Column | None = None) -> DataFrame:
    """Keys with more than one distinct value in a field; rows marked ``skip`` (cross-references) do not vote."""
    rows = df.where(~F.coalesce(skip, F.lit(False))) if skip is not None else df
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"), *[F.count_distinct(f).alias(f"{f}_values") for f in fields])
    flags = reasons(*[(F.col(f"{f}_values") > 1, f) for f in fields])
    return counts.withColumn("conflicting_fields", flags).where(F.size("conflicting_fields") > 0)


# Critic category of a decision.
CRITIC_CATEGORY: dict[str, str] = {
    "simplified": "detail_compression", "omitted": "feature_loss", "exaggerated": "feature_exaggeration",
    "moved_to_mould": "representation_transfer", "moved_to_accessory": "representation_transfer",
    "moved_to_cloth": "representation_transfer", "color_block_changed": "palette_or_block_change",
    "uncertain": "review_uncertainty",
}


def critic_items(df: DataFrame, source_file: Column | str, categories: Mapping[str, str] = CRITIC_CATEGORY) -> DataFrame:
    """Annotations of submitted reviews with a critical decision, as rows with a stable id; never eligible for training."""
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    file = F.col(source_file) if isinstance(source_file, str) else source_file
    base = df.where((F.col("review_status") == "submitted") & (F.col("reviewer.review_role") == "reviewer"))
    rows = base.select("translation_pair_id", F.col("review_id").alias("source_review_id"), file.alias("source_review_file"),
                       "evidence", F.explode("annotations.regions").alias("region", "items"))
    rows = rows.select("*", F.posexplode("items").alias("at", "item")).withColumn(
        "critic_category", F.try_element_at(table, F.col("item.decision"))).where("critic_category is not null")
    feature, decision = F.col("item.feature"), F.col("item.decision")
    ident = canonical_digest({
        "translation_pair_id": "translation_pair_id", "source_review_id": "source_review_id", "region": "region",
        "feature": feature, "decision": decision})
    return rows.select(
        F.concat(F.lit("semcritic-"), F.left(ident, F.lit(24))).alias("critic_id"), "translation_pair_id", "source_review_id",
        "source_review_file", "region", "at", feature.alias("feature"), decision.alias("decision"), "critic_category",
        F.col("item.confidence").alias("confidence"), F.col("item.evidence_basis").alias("evidence_basis"),
        F.lit(False).alias("canonical_eligible"), F.lit(False).alias("training_eligible"))


# Weight of a decision in the hard-case score.
DECISION_WEIGHT: dict[str, int] = {
    "uncertain": 6, "omitted": 5, "color_block_changed": 4, "exaggerated": 4, "moved_to_accessory": 3, "moved_to_cloth": 3,
    "moved_to_mould": 2, "simplified": 1,
}


def hardcase_score(items: DataFrame, key: str, weights: Mapping[str, int] = DECISION_WEIGHT) -> DataFrame:
    """Evaluation priority per item from deduplicated critic rows (``dq.dedup_or_fail`` first).

    Uncertain features without evidence in both images are counted, but do not add to the score.
    """
    c = F.col
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    unpaired = (c("decision") == "uncertain") & ~F.coalesce(c("evidence_basis") == "observed_in_both", F.lit(False))
    low = F.coalesce(c("confidence") < 0.9, F.lit(False))
    source_only = F.coalesce(c("evidence_basis") == "source_only", F.lit(False))
    rows = items.withColumn("_p", ~unpaired).withColumn("_w", F.coalesce(F.try_element_at(table, c("decision")), F.lit(0)))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("critic_item_count"), F.count_if("_p").alias("priority_item_count"),
        F.count_if(~c("_p")).alias("unpaired_uncertainty_count"), F.sum(F.when(c("_p"), c("_w")).otherwise(0)).alias("_base"),
        F.count_distinct(F.when(c("_p"), c("critic_category"))).alias("_cats"), F.count_distinct(F.when(c("_p"), c("region"))).alias("_regions"),
        F.count_if(c("_p") & source_only).alias("_source"), F.count_if(c("_p") & (c("decision") == "uncertain")).alias("_uncertain"),
        F.count_if(c("_p") & low).alias("_low"), F.count_if(source_only & (c("decision") == "omitted")).alias("source_only_omitted_count"))
    score = (
        c("_base") + F.greatest(c("_cats") - 1, F.lit(0)) * 2 + F.greatest(c("_regions") - 1, F.lit(0)) + c("_source") * 2
        + c("_uncertain") * 3 + c("_low"))
    return out.withColumn("hardcase_score", score).drop("_base", "_cats", "_regions", "_source", "_uncertain", "_low")


def progress(plan: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per batch and one for the whole plan (``batch_index`` null): selected, submitted, double-reviewed, evidence-blocked and adjudicated items.

    ``plan(batch_index, item_id)`` lists the members of every batch; reviews are flat rows. An item counts once in the overall row, even if two batches hold it; ``outside_plan`` counts reviewed items that no batch holds,
    and ``next_batch`` marks the first batch that is not complete.
    """
    c = F.col
    per_item = reviews.where(c("item_id").isNotNull()).groupBy("item_id").agg(
        F.count_if((c("review_status") == "submitted") & (c("review_role") == "reviewer")).alias("_sub"),
        F.count_distinct(F.when((c("review_status") == "submitted") & (c("review_role") == "reviewer"), c("principal"))).alias("_who"),
        F.count_if((c("review_status") == "adjudicated") & (c("review_role") == "adjudicator")).alias("_adj"),
        F.count_if((c("review_status") == "submitted") & c("evidence").isNull()).alias("_inexact"),
        F.count_if((c("review_status") == "submitted") & (c("review_role") == "reviewer") & c("evidence").isNotNull()).alias("_exact"),
        F.count_distinct(F.when(c("review_status") == "submitted", c("evidence"))).alias("_variants"))
    # One shuffle on the item serves both grains: rows of a batch, and each item once under no batch.
    members = plan.select("batch_index", "item_id").distinct().withColumn("_in", F.lit(True))
    rows = members.join(per_item, "item_id", "full").na.fill(0, ["_sub", "_who", "_adj", "_inexact", "_exact", "_variants"])
    first = F.row_number().over(W.partitionBy("item_id").orderBy("batch_index")) == 1
    grains = rows.withColumn("_first", first).withColumn("_grain", F.explode(F.array(F.lit(0), F.lit(1)))).where((c("_in") & (c("_grain") == 0)) | (c("_first") & (c("_grain") == 1)))
    inside = F.coalesce("_in", F.lit(False))
    double, exact = c("_who") >= 2, (c("_inexact") == 0) & (c("_variants") == 1)
    count = lambda condition: F.count_if(inside & condition)
    out = grains.groupBy("_grain", F.when(c("_grain") == 0, c("batch_index")).alias("batch_index")).agg(
        count(F.lit(True)).alias("selected_records"), count(c("_who") > 0).alias("submitted_items"),
        F.sum(F.when(inside, c("_sub")).otherwise(0)).alias("submitted_reviews"), count(double & exact).alias("double_reviewed_items"),
        count(double & ~exact).alias("evidence_blocked_items"), count(c("_adj") > 0).alias("adjudicated_items"),
        count((c("_who") > 0) & (c("_exact") == 0)).alias("inexact_items"), F.count_if(~inside & (c("_who") > 0)).alias("outside_plan"))
    out = out.withColumn("remaining_items", c("selected_records") - c("submitted_items")).withColumn("first_review_complete", c("selected_records") == c("submitted_items"))
    waiting = next_incomplete(out.where("_grain = 0")).scalar()
    return out.select(
        "batch_index", "selected_records", "submitted_items", "submitted_reviews", "double_reviewed_items", "evidence_blocked_items", "adjudicated_items", "inexact_items", "outside_plan", "remaining_items", "first_review_complete",
        F.when(c("_grain") == 0, F.coalesce(c("batch_index") == waiting, F.lit(False))).otherwise(waiting.isNotNull()).alias("next_batch"))


def next_incomplete(batches: DataFrame) -> DataFrame:
    """One row: the first batch with items that nobody has reviewed, or null."""
    return batches.where("not first_review_complete").agg(F.min("batch_index").alias("next_batch_index"))


def work_batch(
    queue: DataFrame, mode: str, score: str, ident: str, limit: int = 25, offset: int = 0, min_score: float = 0.0,
    reviews: DataFrame | None = None, statuses: DataFrame | None = None, reviewer: str | None = None,
) -> DataFrame:
    """Rows a reviewer may take next; a limited, ordered slice.

    ``first_review`` skips reviewed items, ``second_review`` takes items that need one and that this reviewer has
    not reviewed, ``adjudication`` takes disputed items.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    rows = queue.where(F.coalesce(F.col(score), F.lit(0.0)) >= min_score)
    if mode == "first_review":
        if reviews is not None:
            done = reviews.where(F.col("review_status").isin("submitted", "adjudicated")).select(F.col("item_id").alias(ident)).distinct()
            rows = rows.join(done, ident, "left_anti")
    elif mode in ("second_review", "adjudication"):
        wanted = ("needs_second_review", "needs_independent_second_review") if mode == "second_review" else (
            "needs_adjudication", "adjudicator_conflict", "invalid_adjudicator_references")
        rows = rows.join(statuses.where(F.col("status").isin(*wanted)).select(F.col("item_id").alias(ident)), ident, "left_semi")
        who = (reviewer or "").strip().casefold()
        if mode == "second_review" and who and who != "unassigned":
            own = reviews.where((F.col("review_status") == "submitted") & (F.col("principal") == who))
            rows = rows.join(own.select(F.col("item_id").alias(ident)).distinct(), ident, "left_anti")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.orderBy(F.col(score).desc(), ident).offset(offset).limit(limit)


def blind_second_review(batch: DataFrame, hidden: Sequence[str], evidence: str) -> DataFrame:
    """Second-review batch without prior labels; an item without exact evidence raises."""
    stop = F.raise_error(F.lit("second review needs exact evidence")).cast(batch.schema[evidence].dataType)
    return batch.drop(*hidden).withColumn(evidence, F.coalesce(evidence, stop))


def review_template(reviewer_id: str, reviewer_type: str = "human", role: str = "reviewer") -> Column:
    """Draft record for a queue row with source and target image columns."""
    empty = F.array().cast(f"array<{ITEM}>")
    return F.struct(
        F.lit(SCHEMA).alias("schema"), F.col("translation_pair_id"),
        F.struct(F.lit(reviewer_type).alias("reviewer_type"), F.lit(reviewer_id).alias("reviewer_id"), F.lit(None).cast("string").alias("model_id"),
                 F.lit(None).cast("string").alias("model_revision"), F.lit(role).alias("review_role")).alias("reviewer"),
        F.struct(F.col("source_image_url"), F.col("lego_image_url"), F.lit(None).cast("string").alias("source_image_sha256"),
                 F.lit(None).cast("string").alias("lego_image_sha256"), F.lit("front_pair").alias("evidence_scope"),
                 F.lit(False).alias("claims_unobserved_surfaces")).alias("evidence"),
        F.struct(F.create_map(*[x for r in REGIONS for x in (F.lit(r), empty)]).alias("regions"), F.array().cast("array<string>").alias("identity_critical_features"),
                 F.lit(None).cast("string").alias("mask_headgear_route"), F.lit(None).cast("string").alias("expression_translation")).alias("annotations"),
        F.col("measurement_signals").alias("measurement_signal_refs"), F.lit("draft").alias("review_status"))


def compile_submission(batch: DataFrame, compact_rows: DataFrame, reviewer_id: str, model_id: str, revision: str, created_at: str) -> DataFrame:
    """Compact six-field decisions to nested reviews.

    ``batch(translation_pair_id, source_image_url, lego_image_url, source_image_sha256, lego_image_sha256)``;
    ``compact_rows(translation_pair_id, items array<array<string>>)`` with region, feature, decision, confidence,
    basis, notes. Pair sets must be equal; any difference raises when evaluated.
    """
    j = batch.join(compact_rows.withColumnRenamed("translation_pair_id", "_p"), F.col("translation_pair_id") == F.col("_p"), "full")
    bad = F.col("translation_pair_id").isNull() | F.col("_p").isNull() | ~F.forall("items", lambda i: F.size(i) == 6)
    stop = F.raise_error(F.concat(F.lit("submission and batch differ at "), F.coalesce("translation_pair_id", "_p"))).cast("string")
    j = j.withColumn("translation_pair_id", F.when(bad, stop).otherwise(F.col("translation_pair_id")))
    at = lambda i, k: F.get(i, F.lit(k))
    entry = lambda region: F.transform(
        F.filter("items", lambda i: at(i, 0) == region),
        lambda i: F.struct(at(i, 1).alias("feature"), at(i, 2).alias("decision"), at(i, 3).cast("double").alias("confidence"),
                           at(i, 4).alias("evidence_basis"), at(i, 5).alias("notes")))
    regions = F.create_map(*[x for r in REGIONS for x in (F.lit(r), entry(r))])
    out = j.select(
        F.lit(SCHEMA).alias("schema"), F.lit(None).cast("string").alias("review_id"), "translation_pair_id",
        F.struct(F.lit("model").alias("reviewer_type"), F.lit(reviewer_id).alias("reviewer_id"), F.lit(model_id).alias("model_id"),
                 F.lit(revision).alias("model_revision"), F.lit("reviewer").alias("review_role")).alias("reviewer"),
        F.struct("source_image_url", "lego_image_url", "source_image_sha256", "lego_image_sha256", F.lit("front_pair").alias("evidence_scope"),
                 F.lit(False).alias("claims_unobserved_surfaces")).alias("evidence"),
        F.struct(F.map_filter(regions, lambda k, v: F.size(v) > 0).alias("regions"), F.array().cast("array<string>").alias("identity_critical_features"),
                 F.lit(None).cast("string").alias("mask_headgear_route"), F.lit(None).cast("string").alias("expression_translation")).alias("annotations"),
        F.array().cast("array<string>").alias("limitations"),
        F.expr("cast(array() as array<struct<signal:string,region:string,value:double,role:string>>)").alias("measurement_signal_refs"),
        F.lit("submitted").alias("review_status"), F.array().cast("array<string>").alias("adjudicates_review_ids"), F.lit(created_at).alias("created_at"),
        F.expr("cast(array() as array<map<string,string>>)").alias("provenance"))
    return normalise_reviews(out)


# Fixed values of asset and source reviews.
ASSET_SCHEMA = "body-architecture-sanitized-asset-review/v1"
ASSET_DECISIONS = ("approved", "rejected", "revise")
ASSET_DIGESTS = ("source_file_sha256", "sanitized_pixel_sha256", "sanitized_png_sha256")
ASSET_CHECKS = (
    "identity_preserved", "primary_figure_complete", "forbidden_text_absent", "task_confounders_absent", "architecture_evidence_preserved", "no_material_transform_artifacts")
SOURCE_STATUSES = ("approved_raw", "sanitization_required")
PRIMARY_VIEWS = ("front", "front_3q", "side", "rear", "multi_view_composite", "uncertain")
ACTIONS = ("none", "tight_figure_crop", "mask_regions", "segment_primary_figure", "replace_source", "manual_composite_cleanup")
TRISTATE = ("true", "false", "uncertain")

Rule = tuple[Column, str]


def _filled(c: Column | str) -> Column:
    return F.trim(c) != ""


def _texts(c: Column | str) -> Column:
    """An array of texts that are not blank; it may be empty, but not null."""
    return F.forall(c, lambda x: F.coalesce(_filled(x), F.lit(False)))


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _person_rules(kind: Sequence[tuple[Column, str]]) -> list[Rule]:
    """Rules of ``reviewer``; ``kind`` adds what a model has to state."""
    modelled = _holds(F.col("reviewer.reviewer_type").isin("model", "hybrid"))
    return [
        (F.col("reviewer").isNotNull(), "reviewer:missing"), (_filled("reviewer.reviewer_id"), "reviewer.reviewer_id:empty"), (F.col("reviewer.reviewer_type").isin(*REVIEWER_TYPES), "reviewer.reviewer_type:unknown"),
        *[(~modelled | _holds(given), code) for given, code in kind]]


def _shared_rules(digests: Sequence[str]) -> list[Rule]:
    value = F.col("review_confidence")
    return [
        *[(F.col(d).rlike("^[0-9a-f]{64}$"), f"{d}:not_a_digest") for d in digests],
        (value.between(0, 1) & ~F.isnan(value), "review_confidence:out_of_range"), (_texts("notes"), "notes:not_texts")]


def _bound(reviews: DataFrame, given: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Reviews with what the row of their key holds, ``g_*``; ``_known`` tells whether there is one. A key that is given twice raises."""
    twice = F.raise_error(F.concat(F.lit(f"{key} given twice: "), F.col(key).cast("string"))).cast("boolean")
    one = given.groupBy(key).agg(*[F.first(v).alias(f"g_{v}") for v in values], F.count(F.lit(1)).alias("_n")).withColumn("_known", F.when(F.col("_n") == 1, True).otherwise(twice)).drop("_n")
    return reviews.join(one, key, "left").withColumn("_known", _holds(F.col("_known")))


def asset_review_errors(reviews: DataFrame, candidates: DataFrame, key: str = "source_record_id") -> DataFrame:
    """Adds ``errors`` and the normal form: a content id where there is none, and ``model_input_allowed``, which only an approval gives.

    Only an approval is bound to the candidate of today, by all three digests, and needs every check to hold; rejections and revisions stay valid as history, but have to say why.
    """
    decision, checks = F.col("decision"), F.col("checks")
    approved = _holds(decision == "approved")
    j = _bound(reviews, candidates, key, ASSET_DIGESTS)
    rules = [
        (F.col("schema") == ASSET_SCHEMA, "schema:unknown"), (decision.isin(*ASSET_DECISIONS), "decision:unknown"), (_filled(F.col(key).cast("string")), f"{key}:empty"), (~approved | F.col("_known"), f"{key}:no_candidate"),
        *[(~approved | ~F.col("_known") | _holds(F.col(d) == F.col(f"g_{d}")), f"{d}:differs") for d in ASSET_DIGESTS],
        (checks.isNotNull(), "checks:missing"), (checks.isNull() | F.forall(F.map_keys(checks), lambda k: k.isin(*ASSET_CHECKS)), "checks:unknown"),
        *[(F.try_element_at(checks, F.lit(c)).isNotNull(), f"checks.{c}:open") for c in ASSET_CHECKS],
        (~approved | F.forall(F.array(*[F.lit(c) for c in ASSET_CHECKS]), lambda c: _holds(F.try_element_at(checks, c))), "checks:fail_when_approved"),
        *_person_rules([(_filled(f"reviewer.{f}"), f"reviewer.{f}:needed_for_model") for f in ("model_id", "model_revision")]), *_shared_rules(ASSET_DIGESTS),
        (~_holds(decision.isin("rejected", "revise")) | (F.coalesce(F.size("notes"), F.lit(0)) > 0), "notes:needed_unless_approved"), (_filled("reviewed_at"), "reviewed_at:empty")]
    content = canonical_digest({c: F.col(c) for c in (key, *ASSET_DIGESTS, "decision", "checks", "reviewer", "reviewed_at")})
    given = F.nullif(F.col("review_id"), F.lit("")) if "review_id" in reviews.columns else F.lit(None).cast("string")
    out = with_errors(j, rules).withColumns({"review_id": F.coalesce(given, F.concat(F.lit("sanreview-"), F.left(content, F.lit(24)))), "model_input_allowed": approved})
    return out.drop("_known", *[f"g_{d}" for d in ASSET_DIGESTS])


def source_review_errors(reviews: DataFrame, queue: DataFrame, key: str = "source_record_id") -> DataFrame:
    """Adds ``errors``: identity with the queue, views, completeness, leakage, action, reviewer and what each status demands.

    ``queue`` holds ``key``, ``source_id`` and ``source_file_sha256``; ``identity_match`` and ``primary_figure_complete`` are tri-state texts.
    """
    status, action, allowed = F.col("status"), F.col("sanitization_action"), F.col("raw_model_input_allowed")
    raw, cleaning = _holds(status == "approved_raw"), _holds(status == "sanitization_required")
    j = _bound(reviews, queue, key, ("source_id", "source_file_sha256"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    approval = {
        "identity_match": F.col("identity_match") == "true", "primary_figure_complete": F.col("primary_figure_complete") == "true",
        # A list that is no list of texts is reported as such and counts as empty here.
        "visible_text_leakage": empty("visible_text_leakage") | ~_holds(_texts("visible_text_leakage")), "visual_confounders": empty("visual_confounders") | ~_holds(_texts("visual_confounders")),
        "sanitization_action": action == "none", "raw_model_input_allowed": allowed}
    rules = [
        (_filled(F.col(key).cast("string")), f"{key}:empty"), (F.col("_known"), f"{key}:unknown"), (_filled("source_id"), "source_id:empty"),
        *[(~F.col("_known") | F.col(c).eqNullSafe(F.col(f"g_{c}")), f"{c}:differs") for c in ("source_id", "source_file_sha256")],
        (status.isin(*SOURCE_STATUSES), "status:unknown"), *[(F.col(c).isin(*TRISTATE), f"{c}:unknown") for c in ("identity_match", "primary_figure_complete")],
        (F.col("primary_view").isin(*PRIMARY_VIEWS), "primary_view:unknown"), *[(_texts(c), f"{c}:not_texts") for c in ("visible_text_leakage", "visual_confounders")],
        (action.isin(*ACTIONS), "sanitization_action:unknown"), (allowed.isNotNull(), "raw_model_input_allowed:missing"),
        *_person_rules([(F.coalesce(_filled("reviewer.model_family"), F.lit(False)) | _filled("reviewer.model_id"), "reviewer.model:needed_for_model")]), (_filled("reviewer.review_method"), "reviewer.review_method:empty"),
        *_shared_rules(["source_file_sha256"]), *[(~raw | _holds(ok), f"{c}:against_approval") for c, ok in approval.items()],
        (~cleaning | _holds(~allowed), "raw_model_input_allowed:against_sanitization"), (~cleaning | ~_holds(action == "none"), "sanitization_action:needed"),
        (~cleaning | ~_holds(F.col("identity_match") == "false") | _holds(action == "replace_source"), "sanitization_action:replace_other_identity")]
    return with_errors(j, rules).drop("_known", "g_source_id", "g_source_file_sha256")


def source_review_findings(queue: DataFrame, reviews: DataFrame, key: str = "source_record_id") -> DataFrame:
    """``(key, finding)`` of a set of source reviews: every broken rule, duplicate reviews, and queue rows that nobody reviewed."""
    checked = source_review_errors(reviews, queue, key)
    broken = checked.select(key, F.explode("errors").alias("finding")).distinct()
    doubled = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("duplicate_review").alias("finding"))
    open_ = queue.select(key).distinct().join(reviews.select(key).distinct(), key, "left_anti").select(key, F.lit("unreviewed_record").alias("finding"))
    return broken.unionByName(doubled).unionByName(open_)


def review_coverage(queue: DataFrame, reviews: DataFrame, key: str, status: str) -> DataFrame:
    """Reviewed and unreviewed queue rows per status, duplicate reviews and ids outside the queue."""
    counts = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = queue.select(key, status).join(counts, key, "left")
    inside = j.groupBy(status).agg(
        F.count_if(F.col("_n").isNotNull()).alias("reviewed"), F.count_if(F.col("_n").isNull()).alias("unreviewed"),
        F.count_if(F.col("_n") > 1).alias("duplicate_reviews"))
    outside = counts.join(queue.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("reviewed")).select(
        F.lit("outside_queue").alias(status), "reviewed", F.lit(0).cast("long").alias("unreviewed"), F.lit(0).cast("long").alias("duplicate_reviews"))
    return inside.unionByName(outside)
