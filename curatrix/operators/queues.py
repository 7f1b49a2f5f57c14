"""Ranked review queues, audits and status classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions.rules import (
    classify_ladder, compact, name_drift, reasons, signal_score, temporal_relation, weighted_sum,
)
from curatrix.functions.text import norm_text, tokens, year_like
from curatrix.operators.pages import url_host
from curatrix.operators.rank import top_margin
from curatrix.operators.scale import null_safe_join, position, small_side


def priority_queue(features: DataFrame, signals: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Measurement signals to a priority score."""
    joined = F.concat(*signals)
    return features.select(*keep, joined.alias("measurement_signals")).withColumn("review_priority_score", signal_score("measurement_signals"))


# Franchise family by keyword, first match wins.
FAMILIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Star Wars", ("star wars",)), ("Dragon Ball", ("dragon ball",)), ("One Piece", ("one piece",)), ("Invincible", ("invincible",)),
    ("X-Men", ("x-men", "x men")), ("Marvel", ("marvel", "avengers", "spider")),
    ("DC", ("dc", "batman", "superman", "justice league", "titans", "doom patrol", "aquaman")), ("Anime", ("anime",)),
    ("Gaming", ("gaming", "games")),
)
# Fixed values.
STATE_SCORE: dict[str, tuple[int, str]] = {
    "wishlist_gap_candidate": (100, "explicit_wishlist"), "explicit_missing_design_target": (80, "explicit_missing"),
    "maybe_gap_candidate": (30, "maybe_state"),
}
# Fixed values.
DETAILS: tuple[tuple[str, int, str], ...] = (
    ("identity", 8, "identity_specific"), ("variant", 10, "variant_specific"), ("first_appearance", 10, "source_appearance_present"),
    ("year", 4, "year_present"), ("preferred", 6, "preferred_reference_present"), ("universe", 4, "universe_present"),
)


def backlog_rank(records: DataFrame, key: str, state: str, source: str, family_text: str, families=FAMILIES) -> DataFrame:
    """Gap groups to priorities with reasons, family by vote, gap mode and route.

    ``records`` has one row per gap record with ``state`` and the optional detail columns ``name``, ``identity``,
    ``variant``, ``first_appearance``, ``year``, ``preferred``, ``universe``, ``official`` and ``bootleg``.
    """
    have = set(records.columns)
    facets = [f for f in ("name", "identity", "variant", "first_appearance", "year", "preferred", "universe", "official", "bootleg") if f in have]
    value = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    stats = records.groupBy(key).agg(
        F.min(state).alias("candidate_state"), F.count(F.lit(1)).alias("record_count"), F.count_distinct(source).alias("_sources"),
        *[F.count_distinct(value(f)).alias(f"_{f}") for f in facets])
    votes = records.groupBy(key, classify_ladder(family_text, families, "Unclassified").alias("_family")).agg(F.count(F.lit(1)).alias("_v"))
    family = votes.groupBy(key).agg(F.min(F.struct((-F.col("_v")).alias("o"), F.col("_family").alias("f"))).alias("_f"))
    n = lambda f: F.col(f"_{f}") if f in facets else F.lit(0)
    base, label = F.lit(10), F.lit("unknown_state")
    for s, (points, text) in STATE_SCORE.items():
        base = F.when(F.col("candidate_state") == s, points).otherwise(base)
        label = F.when(F.col("candidate_state") == s, text).otherwise(label)
    ambiguous = (n("identity") > 1) | (n("universe") > 1)
    score = (
        base + F.when(F.col("_sources") > 1, F.least(F.lit(30), (F.col("_sources") - 1) * 8)).otherwise(0)
        + weighted_sum(*[(n(f) > 0, w) for f, w, _ in DETAILS], (n("name") == 1, 3), (ambiguous, -12), (n("variant") > 3, -5)))
    why = F.concat(F.array(label), reasons(
        (F.col("_sources") > 1, "cross_source_recurrence"), *[(n(f) > 0, text) for f, _, text in DETAILS],
        (ambiguous, "identity_or_universe_ambiguity"), (n("variant") > 3, "variant_ambiguity")))
    existing = (n("official") > 0) | (n("bootleg") > 0)
    mode = (
        F.when(F.col("candidate_state") == "wishlist_gap_candidate", "acquisition_wishlist")
        .when((F.col("candidate_state") == "explicit_missing_design_target") & existing, "existing_representation_compare_or_acquire")
        .when(F.col("candidate_state") == "explicit_missing_design_target", "custom_design_candidate").otherwise("review_only_unknown_state"))
    actionable = F.col("candidate_state").isin("wishlist_gap_candidate", "explicit_missing_design_target")
    return stats.join(family, key).select(
        key, "candidate_state", "record_count", mode.alias("gap_mode"), F.greatest(F.lit(0), score).alias("priority_score"),
        why.alias("priority_reasons"), F.col("_f.f").alias("franchise_family"), F.when(actionable, "actionable").otherwise("review").alias("route"))


def promotion_rank(
    candidates: DataFrame, key: str, figure: str, score: str, overlap: str, decorated: str, year_match: str | None = None,
) -> DataFrame:
    """Weighted promotion score per subject from its figure candidates.

    ``candidates`` holds one row per ``(key, figure)`` with the shared word count and the number of decorated
    components of that figure.
    """
    cols = [F.col(figure).alias("figure"), F.col(overlap).alias("overlap"), F.col(decorated).alias("decorated")]
    cols.append((F.col(year_match) if year_match else F.lit(None).cast("boolean")).alias("year_match"))
    margins = top_margin(candidates, [key], score, figure)
    top = candidates.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct((-F.col(score)).alias("s"), F.col(figure).alias("f"))).alias("t"))
    j = margins.join(top, key)
    t = lambda c: F.col(f"t.{c}")
    s, m, ties = F.col("top_score"), F.col("margin"), F.col("tie_count")
    value = s * 60 + F.greatest(F.lit(0.0), m) * 30 + weighted_sum(
        (ties >= 4, -30), ((ties >= 2) & (ties < 4), -15), ((t("overlap") <= 1) & (s < 0.90), -10),
        (F.coalesce(t("year_match"), F.lit(False)), 20), (F.coalesce(~t("year_match"), F.lit(False)), -15), (t("decorated") > 0, 20),
        (t("decorated") == 1, 10), (t("decorated") > 1, 5), (m >= 0.10, 10), (s >= 0.90, 10))
    value = F.round(F.greatest(F.lit(0.0), value), 3)
    return j.withColumn("promotion_score", value).select(
        key, t("figure").alias("top_figure"), "top_score", "margin", "tie_count", "promotion_score",
        F.when(F.col("promotion_score") >= 100, "verify_first").when(F.col("promotion_score") >= 75, "strong_review")
        .when(F.col("promotion_score") >= 50, "medium_review").otherwise("low_review").alias("review_band"))


def appearance_rank(groups: DataFrame, status: str, raw: str, work: str, years: str, count: str) -> DataFrame:
    """Reference groups to review priorities by the kind of reference."""
    s, text = F.col(status), F.coalesce(F.col(raw), F.lit(""))
    episode = text.rlike(r"(?i)\b(?:s\d{1,2}e\d{1,2}|season\s+\d+.*episode\s+\d+|episode\s+\d+)\b")
    dated = text.rlike(r"\b(?:19|20)\d{2}\b")
    ladder = (
        (s == "comic_issue_explicit", "comic_issue_explicit", 80), (s == "episode_explicit", "episode_explicit", 75),
        (episode, "episode_like_raw", 60), (F.contains(text, F.lit("#")), "issue_like_unparsed", 55), (s == "dated_work", "dated_work", 45),
        (s == "year_only", "year_only", 15), (s == "quoted_title_candidate", "quoted_title_candidate", 35),
        (s == "episode_number_without_work", "episode_number_without_work", 30), (dated, "dated_raw", 35))
    kind = points = None
    for condition, label, value in ladder:
        kind = F.when(condition, label) if kind is None else kind.when(condition, label)
        points = F.when(condition, value) if points is None else points.when(condition, value)
    score = (
        points.otherwise(15) + F.when(F.col(work).isNotNull(), 10).otherwise(0) + F.when(F.col(years) == 1, 5).otherwise(0)
        + F.least(F.lit(15), F.greatest(F.lit(0), F.col(count) - 1) * 3))
    return groups.withColumn("appearance_kind", kind.otherwise("freeform_or_title_only")).withColumn("review_priority_score", score)


def entity_review_rank(groups: DataFrame) -> DataFrame:
    """Entity groups with a reason for review; needs ``ambiguity_flags``, ``cross_source`` and ``record_count``."""
    has = lambda f: F.array_contains("ambiguity_flags", f)
    terms = ((F.col("cross_source"), "cross_source", 10), (has("multiple_identities"), "multiple_identities", 25),
             (has("multiple_universes"), "multiple_universes", 25), (has("many_variants"), "many_variants", 15))
    score = weighted_sum(*[(c, w) for c, _, w in terms]) + F.least(F.lit(20), F.floor(F.col("record_count") / 5))
    out = groups.withColumn("review_reasons", reasons(*[(c, t) for c, t, _ in terms])).withColumn("review_priority_score", score)
    return out.where(F.size("review_reasons") > 0)


# Points of a suspicious identity field.
FIELD_SIGNALS: dict[str, int] = {
    "identity_year_like": 40, "identity_color_or_material_descriptor": 35, "identity_duplicates_universe": 30,
    "identity_media_or_style_descriptor": 25, "identity_role_or_era_descriptor": 20, "identity_duplicates_variant": 15,
    "identity_trailing_unmatched_punctuation": 10, "identity_numeric_only": 0,
}


def field_shape_audit(
    df: DataFrame, identity: str, universe: str, variant: str, colors: Sequence[str], media: Sequence[str] = (), roles: Sequence[str] = (),
    reviewed: DataFrame | None = None, key: Sequence[str] = (),
) -> DataFrame:
    """Rows whose identity field looks like something else; rows reviewed as ``no change`` are left out."""
    ident = F.trim(F.coalesce(F.col(identity), F.lit("")))
    n, nu, nv = norm_text(ident), norm_text(universe), norm_text(variant)
    words = F.filter(F.split(n, " "), lambda w: w != "")
    opened, closed = (F.length(ident) - F.length(F.regexp_replace(ident, c, "")) for c in (r"\(", r"\)"))
    conditions = {
        "identity_year_like": year_like(ident), "identity_duplicates_universe": (nu != "") & (n == nu),
        "identity_duplicates_variant": (nv != "") & (n == nv),
        "identity_color_or_material_descriptor": (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*colors, "and")),
        "identity_media_or_style_descriptor": n.isin(*media) if media else F.lit(False),
        "identity_role_or_era_descriptor": n.isin(*roles) if roles else F.lit(False),
        "identity_trailing_unmatched_punctuation": F.endswith(ident, F.lit("\\")) | (closed > opened),
        "identity_numeric_only": ident.rlike("[0-9]") & ~ident.rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")}
    rows = df.where(ident != "")
    if reviewed is not None:
        rows = rows.join(small_side(reviewed.select(*key).distinct()), list(key), "left_anti")
    out = rows.withColumn("review_signals", reasons(*[(conditions[s], s) for s in sorted(conditions)]))
    return out.withColumn("review_priority_score", weighted_sum(*[(conditions[s], w) for s, w in FIELD_SIGNALS.items()])).where(
        F.size("review_signals") > 0)


def presentation_alias_audit(df: DataFrame, group: str, field: str) -> DataFrame:
    """Raw labels of one group that share a normalised key, one row per label, shortest first; none is left out."""
    labels = df.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(group, field).agg(F.count(F.lit(1)).alias("n"))
    keyed = labels.withColumn("normalized_key", norm_text(field)).where("normalized_key <> ''")
    counts = keyed.groupBy(group, "normalized_key").agg(F.count(F.lit(1)).alias("raw_label_count"), F.sum("n").alias("record_count")).where(
        "raw_label_count > 1")
    listed = null_safe_join(keyed.select(group, "normalized_key", F.col(field).alias("raw_label")), counts, [group, "normalized_key"])
    return position(listed, [F.length("raw_label"), F.col("raw_label")], [group, "normalized_key"], name="label_no")


def sanitisation_queue(
    cases: DataFrame, key: str, locators: str, reviews: DataFrame, high_hosts: Sequence[str], medium_hosts: Sequence[str],
) -> DataFrame:
    """First verified locator per case, host risk and review status; a review of other bytes is stale.

    ``locators`` is ``array<struct<source_id,url,sha256>>``; ``reviews(key, sha256, status)``.
    """
    verified = F.filter(locators, lambda l: l["sha256"].isNotNull() & l["url"].isNotNull())
    best = F.array_min(F.transform(verified, lambda l: F.struct(l["source_id"].alias("source_id"), l["sha256"].alias("sha256"), l["url"].alias("url"))))
    host = url_host("_l.url")
    risk = F.when(host.isin(*high_hosts), "high").when(host.isin(*medium_hosts), "medium_review_required").otherwise("unknown_review_required")
    j = cases.select(key, best.alias("_l")).join(reviews.select(key, F.col("sha256").alias("r_sha"), F.col("status").alias("r_status")), key, "left")
    stale = F.col("r_sha").isNotNull() & (F.col("r_sha") != F.col("_l.sha256"))
    status = (
        F.when(F.col("_l").isNull(), "no_verified_locator").when(F.col("r_status").isNull(), "pending_visual_review")
        .when(stale, "stale_review_requires_repeat").when(F.col("r_status") == "approved_raw", "approved_raw_model_input")
        .when(F.col("r_status") == "sanitization_required", "sanitization_required").otherwise("rejected_or_unresolved"))
    return j.select(key, F.col("_l.source_id").alias("source_id"), F.col("_l.sha256").alias("source_sha256"),
                    F.when(F.col("_l").isNotNull(), risk).alias("source_risk"), stale.alias("review_stale"), status.alias("status"))


def locator_status(locator: Column, catalog_host: str = "bricklink.com") -> Column:
    """``struct(status, strategy)`` of one locator."""
    pair = lambda s, t: F.struct(F.lit(s).alias("status"), F.lit(t).alias("strategy"))
    return (
        F.when(locator["sha256"].isNotNull(), pair("byte_verified", "verified_source_media_metadata"))
        .when(locator["image_url"].isNotNull(), pair("resolved_exact_image_url", "already_resolved_source_media"))
        .when(locator["quality"] == "indirect_identity_graph",
              pair("blocked_on_direct_release_locator", "resolve_direct_release_page_before_image_acquisition"))
        .when((locator["authority"] == "structured_catalog") & F.contains(locator["url"], F.lit(catalog_host)),
              pair("ready_for_catalog_image_resolution", "bricklink_catalog_adapter_or_reviewed_image_endpoint"))
        .otherwise(pair("ready_for_reviewed_page_media_resolution", "reviewed_page_to_exact_image_url")))


def acquisition_status(cases: DataFrame, key: str, locators: str, catalog_host: str = "bricklink.com") -> DataFrame:
    """Per locator status, per case any/all reduction and the first exact image address."""
    actions = F.transform(locators, lambda l: locator_status(l, catalog_host))
    any_ = lambda s: F.exists("_a", lambda a: a["status"] == s)
    status = (
        F.when(F.coalesce(F.size("_a"), F.lit(0)) <= 0, "blocked_missing_reference_locator")
        .when(any_("byte_verified"), "byte_verified_materialization_pending").when(any_("resolved_exact_image_url"), "ready_for_materialization")
        .when(F.forall("_a", lambda a: a["status"] == "blocked_on_direct_release_locator"), "blocked_on_direct_release_locator")
        .otherwise("ready_for_image_url_resolution"))
    image = F.get(F.filter(F.transform(locators, lambda l: l["image_url"]), lambda u: u.isNotNull()), F.lit(0))
    return cases.withColumn("_a", actions).select(
        key, status.alias("case_status"), F.transform("_a", lambda a: a["status"]).alias("locator_statuses"), image.alias("exact_image_url"))


def counterpart_class(df: DataFrame, base_words: str, name_words: str, suffix: str, years: str, launch: int) -> DataFrame:
    """Character-level and version-level status of a top candidate; needs ``top_score`` and ``margin``."""
    same = (F.size(base_words) > 0) & F.coalesce(F.forall(base_words, lambda t: F.array_contains(name_words, t)), F.lit(False))
    suffixed = F.size(suffix) > 0
    s, m = F.col("top_score"), F.col("margin")
    counterpart = (
        F.when(same & (s >= 0.86) & (m >= 0.10), "strong_character_counterpart")
        .when(same & (s >= 0.76) & (m >= 0.05), "review_character_counterpart").otherwise("unresolved_character_counterpart"))
    out = df.withColumn("counterpart_status", counterpart).withColumn("temporal_relation", temporal_relation(years, launch))
    c = F.col("counterpart_status")
    matched = c != "unresolved_character_counterpart"
    exact = (
        F.when((c == "strong_character_counterpart") & ~suffixed, "character_match_only_version_unresolved")
        .when(matched & suffixed, "variant_suffix_requires_version_resolution").otherwise("unresolved"))
    source = (
        F.when(matched & (F.col("temporal_relation") == "postdates"), "same_character_later_physical_release_not_source_equivalent")
        .when(matched, "physical_counterpart_candidate_version_visual_pending").otherwise("unresolved"))
    return out.withColumn("exact_version_status", exact).withColumn("source_equivalence_status", source)


# Suffix markers that deny a feature, and the component words of a feature.
NEGATIVE_SUFFIXES: dict[str, str] = {"nohelmet": "helmet", "nocape": "cape", "nohat": "hat", "noshell": "shell"}
FEATURE_TERMS: dict[str, tuple[str, ...]] = {"helmet": ("helmet",), "hat": ("hat", "cap"), "cape": ("cape",), "shell": ("shell",)}


def family_class(df: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """Support of a digital identity among its physical candidates and the release and version states.

    Input: ``label_words array<string>``, ``compact_label string``, ``code_like boolean``, ``suffix_words array<string>``,
    ``suffix_text string``, ``margin double`` and ``candidates array<struct<id,name,words,compact,set_words,parts>>`` with
    ordered name words, compact name, words of the sets it is in and lower-case accessory names.
    """
    words = F.col("label_words")
    ends = lambda c: F.array_contains(F.array(F.get(c["words"], F.lit(0)), F.try_element_at(c["words"], F.lit(-1))), F.get(words, F.lit(0)))
    supports = lambda c: (
        F.when(F.col("code_like"), (F.col("compact_label") != "") & F.contains(c["compact"], F.col("compact_label")))
        .when(F.size(words) == 1, F.coalesce(ends(c), F.lit(False))).otherwise(F.forall(words, lambda t: F.array_contains(c["words"], t))))
    out = df.withColumn("supported", F.when(F.size(words) > 0, F.filter("candidates", supports)).otherwise(F.slice("candidates", 1, 0)))
    negative = compact(*[F.when(F.contains(F.lower("suffix_text"), F.lit(m)), F.lit(f)) for m, f in NEGATIVE_SUFFIXES.items()])
    out = out.withColumn("negative_features", negative)
    present = lambda c: F.lit(False)
    hit = lambda c, f, terms: F.array_contains("negative_features", f) & (
        F.lower(c["name"]).rlike("|".join(terms)) | F.exists(c["parts"], lambda p: p.rlike("|".join(terms))))

    def contradicts(c: Column) -> Column:
        value = F.lit(False)
        for f, terms in FEATURE_TERMS.items():
            value = value | hit(c, f, terms)
        return value

    out = out.withColumn("allowed", F.filter("supported", lambda c: ~contradicts(c)))
    remaining = F.filter("suffix_words", lambda t: (t != "no") & ~F.array_contains("negative_features", t))
    all_in = lambda tokens, field: lambda c: F.forall(tokens, lambda t: F.array_contains(c[field], t))
    out = out.withColumn("_neg", F.filter("allowed", all_in(remaining, "words"))).withColumn(
        "_name", F.filter("supported", all_in(F.col("suffix_words"), "words"))).withColumn(
        "_set", F.filter("supported", lambda c: (F.size(c["set_words"]) > 0) & all_in(F.col("suffix_words"), "set_words")(c)))
    denied, has_suffix = F.size("negative_features") > 0, F.size("suffix_words") > 0
    narrowed = (F.size(remaining) > 0) & (F.size("_neg") > 0)
    constraint = (
        F.when(~has_suffix & ~denied, "no_semantic_suffix")
        .when(denied & narrowed, "negative_feature_filtered_plus_catalog_text_match")
        .when(denied & (F.size("allowed") < F.size("supported")), "negative_feature_explicit_contradictions_filtered")
        .when(denied, "negative_feature_unresolved_no_explicit_contradiction").when(F.size("_name") > 0, "suffix_catalog_text_match")
        .when(F.size("_set") > 0, "suffix_set_context_match").otherwise("suffix_not_resolved_in_supported_candidates"))
    out = out.withColumn("constraint_status", constraint)
    s = F.col("constraint_status")
    pool = (
        F.when(s == "negative_feature_filtered_plus_catalog_text_match", F.col("_neg"))
        .when(s == "negative_feature_explicit_contradictions_filtered", F.col("allowed")).when(s == "suffix_catalog_text_match", F.col("_name"))
        .when(s == "suffix_set_context_match", F.col("_set")).otherwise(F.col("supported")))
    is_generic = F.exists(words, lambda w: w.isin(*generic)) if generic else F.lit(False)
    negative_state = F.startswith(s, F.lit("negative_feature_"))
    some = F.size("supported") > 0
    release = (
        F.when(has_suffix & ((s == "suffix_not_resolved_in_supported_candidates") | negative_state), "variant_constrained_physical_release_unresolved")
        .when((F.size("release_pool") == 1) & (F.coalesce("margin", F.lit(0.0)) >= 0.10), "unique_physical_release_candidate")
        .when(F.size("release_pool") >= 1, "physical_release_ambiguous_within_character_family").otherwise("no_supported_physical_release_candidate"))
    version = (
        F.when(s == "negative_feature_filtered_plus_catalog_text_match", "digital_negative_feature_plus_catalog_text_requires_visual_confirmation")
        .when(negative_state, "digital_negative_feature_requires_visual_mapping")
        .when(s == "suffix_catalog_text_match", "digital_variant_suffix_matches_catalog_text_requires_visual_confirmation")
        .when(s == "suffix_set_context_match", "digital_variant_suffix_matches_set_context_requires_visual_confirmation")
        .when(F.coalesce("suffix_text", F.lit("")) != "", "digital_variant_label_present_requires_version_mapping")
        .when(F.col("release_status") == "unique_physical_release_candidate", "unsuffixed_identity_unique_release_candidate_version_still_unverified")
        .when(some, "unsuffixed_identity_multiple_physical_versions").otherwise("digital_version_unresolved"))
    out = out.withColumn("release_pool", pool).withColumn("release_status", release).withColumn("version_status", version)
    return out.withColumn(
        "character_status", F.when(some & ~is_generic, "physical_character_family_supported").when(some, "generic_role_family_supported")
        .otherwise("digital_identity_only_no_physical_name_support")).withColumn("support_count", F.size("supported")).drop("_neg", "_name", "_set")


def reference_links(df: DataFrame, catalog_id: str, name: str, status: str, resolved_status: str, namespace: str) -> DataFrame:
    """Provenance links to catalogue records, resolved or not."""
    ident = F.nullif(F.lower(F.trim(F.col(catalog_id).cast("string"))), F.lit(""))
    ok = ident.isNotNull() & F.col(name).isNotNull() & F.coalesce(F.col(status) == resolved_status, F.lit(False))
    return df.select("*", F.concat(F.lit(f"{namespace}:"), ident).alias("physical_reference_id"),
                     F.when(ok, "physical_reference_link_ready").otherwise("physical_reference_link_unresolved").alias("link_status"))


# Supervision role of an asset class.
SUPERVISION_ROLES: dict[str, str] = {
    "minifigure_surface_map": "component_surface_supervision", "motif_primitive": "motif_and_symbol_supervision",
    "non_minifigure_component_art": "non_minifigure_decoration_supervision",
    "unscoped_design_or_pattern": "generic_design_pattern_supervision", "legacy_unclassified": "review_required",
}


def supervision_roles(df: DataFrame, asset_class: str, roles: Mapping[str, str] = SUPERVISION_ROLES, exact: str = "minifigure_surface_map") -> DataFrame:
    cls = F.coalesce(F.col(asset_class), F.lit("legacy_unclassified"))
    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return df.withColumn("supervision_role", F.coalesce(F.try_element_at(table, cls), F.lit("review_required"))).withColumn(
        "exact_promotion_allowed", cls == exact)


def registry_gap(census: DataFrame, registry: DataFrame, brand: str) -> DataFrame:
    """Census brands against known aliases: known or unmodelled, with a weighted priority.

    ``registry(alias, canonical)`` with slugged aliases; ``census`` has ``figure_count`` and ``stable_prefix_candidate``.
    """
    known = registry.groupBy(F.col("alias").alias(brand)).agg(F.count(F.lit(1)).alias("_k"), F.min("canonical").alias("canonical"))
    j = census.join(known, brand, "left")
    hit = F.col("_k").isNotNull()
    score = F.round(F.col("figure_count") * F.when(F.col("stable_prefix_candidate"), 1.5).otherwise(1.0) * F.when(hit, 0.25).otherwise(1.0), 2)
    return j.select(*census.columns, "canonical", F.when(hit, "known_registry_match").otherwise("unmodeled_brand_slug").alias("registry_status"),
                    score.alias("review_priority_score"))


def caption_reconcile(snapshot: DataFrame, census: DataFrame, key: str, caption: str, name: str) -> DataFrame:
    """Old captions against current names: match flags, drift class and queue priority."""
    j = snapshot.join(census.select(key, F.col(name).alias("_current"), F.lit(True).alias("_found")), key, "left")
    j = j.withColumn("_old", norm_text(caption)).withColumn("_new", norm_text("_current"))
    words = lambda c: tokens(F.col(c), min_length=1)
    relation = name_drift("_old", "_new", words("_old"), words("_new"))
    return j.select(
        *snapshot.columns, F.col("_current").alias("current_name"), F.coalesce("_found", F.lit(False)).alias("current_match"), relation.alias("relation"),
    ).withColumn("review_priority", F.when(F.col("current_match") & (F.col("relation") == "same"), "none")
                 .when(F.col("relation").isin("missing_current_catalog_record", "substantial_name_drift"), "high").otherwise("medium"))


# Landmark review points.
def landmark_review_rank(df: DataFrame, emotion_words: Sequence[str]) -> DataFrame:
    """Face assets by how much a landmark review would teach: needs ``words``, ``side_hint``, ``primitives``, ``path``."""
    path = F.lower(F.coalesce("path", F.lit("")))
    n = F.coalesce("primitives", F.lit(0))
    calibration = path.rlike("classics/|city/|lego minifigures/")
    licensed = path.rlike("star wars/|super heroes/|ninjago/")
    explicit = F.exists("words", lambda w: w.isin(*emotion_words))
    score = weighted_sum((explicit, 100), (F.coalesce(F.col("side_hint").isin("front", "reverse"), F.lit(False)), 30), (calibration, 10), (licensed, 8))
    return df.withColumn("priority_score", score + F.least(n, F.lit(20))).withColumn("priority_reasons", reasons(
        (explicit, "explicit_filename_emotion"), (F.col("side_hint").isin("front", "reverse"), "explicit_side_hint"),
        (n > 0, "machine_readable_geometry"), (n <= 0, "no_simple_primitive_candidates"), (calibration, "calibration_or_cmf_value"),
        (licensed, "licensed_or_longitudinal_theme_value")))
