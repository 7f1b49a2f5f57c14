"""Grouping operators: census, profiles, distributions, entity groups, coverage and reference sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions.ids import set_digest
from curatrix.functions.rules import compact, count_map, reasons, weighted_sum
from curatrix.functions.text import slug
from curatrix.operators.scale import first_values, nest, null_safe_join, position, small_side, top_k

UNRESOLVED = "__{}_unresolved__"


def year_bounds(df: DataFrame, key: str, year: str, member: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(member).alias("member_count"))


def nested_census(
    entities: DataFrame, key: str, facets: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]],
    chunk: int = 10000,
) -> DataFrame:
    """One row per entity with one ordered array per facet ``name -> (rows, order, items)``.

    Every facet is nested on its own before the joins, so facets never multiply each other. An entity with a
    facet above ``chunk`` items continues on rows with ``chunk_no`` 1, 2, ...
    """
    nested = {n: nest(df, [key], order, items, n, chunk) for n, (df, order, items) in facets.items()}
    out = entities.withColumn("chunk_no", F.lit(0))
    for name, part in nested.items():
        out = out.join(part.where("chunk_no = 0").drop("chunk_no"), key, "left")
    extra = None
    for name, part in nested.items():
        tail = part.where("chunk_no > 0")
        extra = tail if extra is None else extra.join(tail, [key, "chunk_no"], "full")
    if extra is not None:
        out = out.unionByName(extra.join(entities, key), allowMissingColumns=True)
    for name, part in nested.items():
        empty = F.array().cast(part.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    return out


def group_profile(
    entities: DataFrame, memberships: DataFrame, components: DataFrame, entity: str, top: int = 20,
    presence: Sequence[str] = ("headgear", "bodywear", "weapon_or_tool"),
) -> DataFrame:
    """Distribution profile per ``(kind, name)``.

    ``entities(entity, year, num_parts)``, ``memberships(entity, kind, name)``,
    ``components(entity, role, color, printed)``. Components fold to one row per entity, role and colour before
    they meet the memberships. The median keeps one counter per distinct part count.
    """
    members = memberships.select(entity, "kind", "name").distinct()
    folded = components.groupBy(entity, "role", "color").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("printed").alias("printed_n"))
    per_entity = folded.groupBy(entity).agg(
        F.sum("printed_n").alias("printed_n"),
        *[F.max(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"has_{r}") for r in presence])
    base = members.join(entities, entity).join(per_entity, entity, "left")
    stats = base.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("entity_count"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.round(F.avg("num_parts"), 3).alias("mean_parts"), F.median("num_parts").alias("median_parts"),
        F.round(F.avg(F.coalesce("printed_n", F.lit(0))), 3).alias("mean_printed"),
        *[F.round(F.avg(F.coalesce(f"has_{r}", F.lit(0))), 4).alias(f"{r}_fraction") for r in presence])
    long = members.join(folded, entity)
    roles = (
        long.groupBy("kind", "name", F.col("role").alias("value")).agg(F.sum("n").alias("n"))
        .groupBy("kind", "name").agg(count_map(F.collect_list(F.struct("value", "n"))).alias("role_counts")))
    colors = long.where("color is not null").groupBy("kind", "name", F.col("color").alias("value")).agg(F.sum("n").alias("n"))
    best = top_k(colors, ["kind", "name"], [F.col("n").desc(), "value"], top, "_r")
    tops = best.groupBy("kind", "name").agg(count_map(F.collect_list(F.struct("value", "n"))).alias("top_colors"))
    return stats.join(roles, ["kind", "name"], "left").join(tops, ["kind", "name"], "left")


def membership_distribution(records: DataFrame, memberships: str, tags: str) -> DataFrame:
    """Every record counts in each of its ``(kind, name)`` memberships; counts and fractions per tag."""
    rows = records.select(F.explode(memberships).alias("m"), F.col(tags).alias("_tags"))
    rows = rows.select(F.col("m.kind").alias("kind"), F.col("m.name").alias("name"), "_tags")
    total = rows.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("_tags") > 0).alias("tagged_records"))
    counted = rows.select("kind", "name", F.explode("_tags").alias("tag")).groupBy("kind", "name", "tag").agg(
        F.count(F.lit(1)).alias("tag_count"))
    return total.join(counted, ["kind", "name"], "left").withColumn(
        "tag_fraction", F.round(F.col("tag_count") / F.col("records"), 4))


def entity_groups(
    df: DataFrame, key: str, source: str, facets: Sequence[str], ambiguity: Mapping[str, tuple[str, int]],
    sample: int = 20, record: str | None = None,
) -> DataFrame:
    """Groups by a normalised name: counts, exact distinct counts per facet and ambiguity flags.

    ``ambiguity`` maps a flag to ``(facet, limit)``: the flag is set above the limit. Values themselves come
    from ``group_values``; ``sample`` record ids are kept per group.
    """
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct(source).alias("source_count"),
        *[F.count_distinct(f).alias(f"{f}_count") for f in facets])
    flags = compact(*[F.when(F.col(f"{f}_count") > n, F.lit(flag)) for flag, (f, n) in ambiguity.items()])
    out = stats.withColumn("cross_source", F.col("source_count") > 1).withColumn("ambiguity_flags", flags).withColumn(
        "resolution_status",
        F.when(F.col("cross_source"), "cross_source_character_candidate").otherwise("single_source_name_group"))
    if record:
        picked = top_k(df.select(key, record), [key], [record], sample, "_n").groupBy(key).agg(
            F.array_sort(F.collect_list(record)).alias("sample_records"))
        out = null_safe_join(out, picked, [key])
    return out


def group_values(df: DataFrame, key: str, facets: Sequence[str], chunk: int = 10000) -> DataFrame:
    """All distinct values of every facet per group, sorted, as ``(key, facet, chunk_no, values)``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.trim(F.col(f).cast("string")).alias("value")) for f in facets]))
    flat = df.select(key, pairs.alias("p")).select(key, "p.facet", "p.value").where("value is not null and value <> ''").distinct()
    packed = nest(flat, [key, "facet"], ["value"], ["value"], "values", chunk)
    return packed.withColumn("values", F.transform("values", lambda v: v["value"]))


def strict_duplicates(df: DataFrame, keys: Sequence[str], source: str, record: str, sample: int = 50) -> DataFrame:
    """Composite-key groups of two or more rows with a bounded sample of record ids."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct(source).alias("source_count")).where("record_count >= 2")
    picked = top_k(df.select(*keys, record), keys, [record], sample, "_n").groupBy(*keys).agg(
        F.array_sort(F.collect_list(record)).alias("sample_records"))
    return null_safe_join(stats, picked, list(keys)).withColumn("cross_source_duplicate", F.col("source_count") > 1)


def alias_collapse(df: DataFrame, name: str, identity: str, aliases: DataFrame) -> DataFrame:
    """Identity keys merged inside a name: ``aliases(name, alias, canonical)``; reports every merge."""
    lookup = aliases.select(F.col("name").alias(name), F.col("alias").alias(identity), "canonical")
    keyed = df.select(name, identity).where(F.col(identity) != "").groupBy(name, identity).agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed.join(small_side(lookup), [name, identity], "left").withColumn(
        "semantic_key", F.coalesce("canonical", F.col(identity)))
    folded = keyed.groupBy(name, "semantic_key").agg(
        F.count(F.lit(1)).alias("raw_key_count"), F.sum("n").alias("record_count"),
        F.max((F.col("semantic_key") != F.col(identity)).cast("int")).alias("_moved"))
    return folded.where((F.col("raw_key_count") > 1) | (F.col("_moved") == 1)).drop("_moved")


def brand_candidates(
    codes: DataFrame, explicit: str, prefix: str, alias_map: DataFrame, prefix_map: DataFrame,
) -> DataFrame:
    """Brands from the explicit name, else the observed prefix, else the prefix read as a brand word.

    ``alias_map(alias, brand)`` and ``prefix_map(prefix, brand)`` fold to sorted arrays first.
    """
    by_alias = alias_map.groupBy("alias").agg(F.array_sort(F.collect_set("brand")).alias("brands"))
    by_prefix = prefix_map.groupBy("prefix").agg(F.array_sort(F.collect_set("brand")).alias("brands"))
    a = by_alias.select(F.col("alias").alias(explicit), F.col("brands").alias("_b1"))
    p = by_prefix.select(F.col("prefix").alias(prefix), F.col("brands").alias("_b2"))
    t = by_alias.select(F.col("alias").alias("_token"), F.col("brands").alias("_b3"))
    out = (
        codes.withColumn("_token", F.lower(prefix)).join(small_side(a), explicit, "left")
        .join(small_side(p), prefix, "left").join(small_side(t), "_token", "left"))
    brands = F.coalesce("_b1", "_b2", "_b3", F.array().cast("array<string>"))
    return out.select(
        *codes.columns, brands.alias("brand_candidates"),
        F.when(F.col("_b1").isNotNull(), "explicit_brand_name_or_alias")
        .when(F.col("_b2").isNotNull(), "observed_product_prefix")
        .when(F.col("_b3").isNotNull(), "exact_brand_or_alias_token").alias("candidate_method"),
        F.when(F.size(brands) == 1, "brand_candidate_single").when(F.size(brands) > 1, "brand_candidate_ambiguous")
        .otherwise("unresolved_prefix").alias("resolution_status"))


def release_groups(df: DataFrame, code: str, name: str, variant: str, brand: str) -> DataFrame:
    stats = df.where(F.coalesce(F.col(code), F.lit("")) != "").groupBy(code).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct(name).alias("name_count"),
        F.count_distinct(variant).alias("variant_count"), F.count_distinct(brand).alias("brand_count"))
    return stats.withColumn("conflict_flags", reasons(
        (F.col("name_count") > 1, "multiple_names_for_same_code"),
        (F.col("variant_count") > 1, "multiple_variants_for_same_code"),
        (F.col("brand_count") > 1, "multiple_brand_candidates"),
    )).withColumn("release_status", F.when(F.col("brand_count") == 1, "candidate_ready_for_identity_resolution")
                  .otherwise("brand_or_identity_review_required"))


def reference_groups(df: DataFrame, raw: str, parsed: str) -> DataFrame:
    """Group parsed references by canonical key, else by the normalised raw text (column ``raw_key``).

    A parsed field survives only when all rows agree, nulls included.
    """
    p = lambda f: F.col(f"{parsed}.{f}")
    key = F.coalesce(p("canonical_key"), F.concat(F.lit("raw|"), F.col("raw_key")))
    same = lambda f: F.when(
        (F.min(p(f)) == F.max(p(f))) & (F.count(p(f)) == F.count(F.lit(1))), F.min(p(f))).alias(f)
    kinds = F.when(F.min(p("kind")) == F.max(p("kind")), F.min(p("kind"))).otherwise("mixed_or_raw")
    return df.withColumn("reference_key", key).groupBy("reference_key").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct(raw).alias("raw_values"), kinds.alias("parse_status"),
        same("source_work"), same("volume"), same("issue"), same("season"), same("episode"),
        F.count_distinct(p("year_hint")).alias("year_hints"))


def entity_hierarchy(df: DataFrame, name: str, identity: str, universe: str, variant: str, source: str) -> dict[str, DataFrame]:
    """Character, incarnation and outfit layers; missing levels carry an explicit marker."""
    part = lambda c, label: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNRESOLVED.format(label)))
    piece = lambda c, label, size: slug(
        F.when(F.col(c) == UNRESOLVED.format(label), F.lit(f"{label}-unresolved")).otherwise(F.col(c)), size)
    flat = df.select(
        F.col(name).alias("character_key"), part(identity, "identity").alias("identity_key"),
        part(universe, "universe").alias("universe_key"), part(variant, "variant").alias("variant_key"),
        F.col(source).alias("source"))
    # One fold by the full path and source; every layer is a roll-up of it.
    keys = ["character_key", "identity_key", "universe_key", "variant_key"]
    paths = flat.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    cid = F.concat(F.lit("character-user-"), slug("character_key", 120))
    iid = F.concat_ws("--", cid, piece("identity_key", "identity", 100))
    uid = F.concat_ws("--", iid, piece("universe_key", "universe", 100))
    oid = F.concat_ws("--", uid, piece("variant_key", "variant", 120))
    resolved = lambda c, label: F.when(F.col(c) != UNRESOLVED.format(label), F.col(c))
    missing = lambda c, label: F.max((F.col(c) == UNRESOLVED.format(label)).cast("int")) == 1
    characters = paths.groupBy("character_key").agg(
        F.sum("n").alias("record_count"), F.count_distinct("source").alias("source_count"),
        F.count_distinct("identity_key").alias("identity_count"),
        F.count_distinct(resolved("identity_key", "identity")).alias("resolved_identity_count"),
        missing("identity_key", "identity").alias("has_unresolved_identity")).withColumn("character_id", cid)
    incarnations = paths.groupBy(*keys[:3]).agg(
        F.sum("n").alias("record_count"), F.count_distinct("source").alias("source_count"),
        F.count_distinct("variant_key").alias("variant_count"),
        missing("variant_key", "variant").alias("has_unresolved_variant")).withColumn("character_id", cid).withColumn(
        "incarnation_id", uid)
    outfits = paths.groupBy(*keys).agg(
        F.sum("n").alias("record_count"), F.count_distinct("source").alias("source_count")).withColumn(
        "incarnation_id", uid).withColumn("outfit_id", oid)
    return {"character": characters, "incarnation": incarnations, "outfit": outfits}


# Status words of an owner's list.
OWNED = ("YES", "TRUE", "LEGO", "CLONE", "CUSTOM", "PREPPED", "ORDERED", "SHIPPED", "OWNED", "HAVE")
MISSING = ("NO", "FALSE", "MISSING")
MAYBE = ("MAYBE",)


def gap_state(
    df: DataFrame, keys: Sequence[str], status: str, record_class: str, have: str | None = None,
    owned: Sequence[str] = OWNED, missing: Sequence[str] = MISSING, maybe: Sequence[str] = MAYBE,
    target_classes: Sequence[str] = ("design_target", "wishlist"), wishlist: str = "wishlist",
) -> DataFrame:
    """State of every target group by priority: covered, wishlist, explicitly missing, maybe, unknown."""
    word = F.upper(F.trim(F.coalesce(F.col(status), F.lit(""))))
    held = F.coalesce(F.col(have), F.lit(False)) if have else F.lit(False)
    refused = F.coalesce(~F.col(have), F.lit(False)) if have else F.lit(False)
    flags = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.bool_or(F.coalesce(F.col(record_class).isin(*target_classes), F.lit(False))).alias("_target"),
        F.bool_or(held | word.isin(*owned)).alias("_owned"), F.bool_or(refused | word.isin(*missing)).alias("_missing"),
        F.bool_or(word.isin(*maybe)).alias("_maybe"),
        F.bool_or(F.coalesce(F.col(record_class) == wishlist, F.lit(False))).alias("_wish"))
    state = (
        F.when(F.col("_owned"), "target_covered_or_in_pipeline").when(F.col("_wish"), "wishlist_gap_candidate")
        .when(F.col("_missing"), "explicit_missing_design_target").when(F.col("_maybe"), "maybe_gap_candidate")
        .otherwise("unknown_target_state"))
    return flags.where("_target").select(*keys, "record_count", state.alias("candidate_state"))


def brand_census(df: DataFrame, brand: str, prefix: str, min_count: int = 10, min_share: float = 0.80) -> DataFrame:
    """Figures per brand, dominant code prefix and whether it is stable."""
    pairs = df.groupBy(F.coalesce(F.col(brand), F.lit("unknown")).alias(brand), prefix).agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy(brand).agg(
        F.sum("n").alias("figure_count"), F.count(prefix).alias("prefix_count"),
        F.min(F.when(F.col(prefix).isNotNull(), F.struct((-F.col("n")).alias("o"), F.col(prefix).alias("p")))).alias("_top"))
    top = F.coalesce(-F.col("_top.o"), F.lit(0))
    share = F.round(top / F.col("figure_count"), 4)
    return best.select(
        brand, "figure_count", "prefix_count", F.col("_top.p").alias("dominant_prefix"), top.alias("dominant_count"),
        share.alias("dominant_fraction"),
        ((top >= min_count) & (share >= min_share)).alias("stable_prefix_candidate"))


def serial_names(segments: DataFrame, serial: str, name: str, source: str, at: str) -> DataFrame:
    """Every distinct name of a serial as a row ``(serial, name_no, name, source, at)``, in first-seen order."""
    firsts = segments.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(serial, name).agg(F.min(F.struct(F.col(source), F.col(at))).alias("_first"))
    placed = position(firsts, [F.col("_first"), F.col(name)], [serial], name="name_no")
    return placed.select(serial, "name_no", name, F.col(f"_first.{source}").alias(source), F.col(f"_first.{at}").alias(at))


def serial_observations(segments: DataFrame, serial: str, name: str, source: str, at: str) -> DataFrame:
    """Per serial: occurrences, number of distinct names, the first one, and the state; all names are rows of ``serial_names``."""
    seen = segments.groupBy(serial).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct(F.nullif(F.col(name), F.lit(""))).alias("name_count"),
        F.min(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.struct(F.col(source), F.col(at), F.col(name))))[name].alias("first_name"))
    n = F.col("name_count")
    return seen.withColumn("name_status", F.when(n == 0, "blank_catalog_slot").when(n == 1, "named").otherwise("conflicting_names"))


def catalog_digest(segments: DataFrame, serial: str, name: str, source: str, at: str) -> DataFrame:
    """Number of serials and one digest over all of them: a line per serial and a line per name, however many."""
    seen = serial_observations(segments, serial, name, source, at)
    heads = seen.select(F.concat_ws("|", F.lit("serial"), F.col(serial), "name_status", F.col("occurrence_count").cast("string")).alias("line"), F.lit(1).alias("one"))
    names = serial_names(segments, serial, name, source, at)
    tails = names.select(F.concat_ws("|", F.lit("name"), F.col(serial), F.col("name_no").cast("string"), name).alias("line"), F.lit(0).alias("one"))
    return heads.unionByName(tails).agg(F.sum("one").alias("serials"), set_digest("line").alias("catalog_digest"))


def coverage(registry: DataFrame, sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Which registry rows are covered, and by which sources (a fixed list)."""
    tagged = None
    for name, df in sources.items():
        part = df.select(key).distinct().withColumn("_source", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    folded = tagged.groupBy(key).agg(F.array_sort(F.collect_set("_source")).alias("covered_by"))
    return registry.join(folded, key, "left").withColumn(
        "covered_by", F.coalesce("covered_by", F.array().cast("array<string>"))).withColumn(
        "covered", F.size("covered_by") > 0)


def coverage_gaps(covered: DataFrame, by: Sequence[str]) -> DataFrame:
    return covered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("registered"), F.count_if("covered").alias("covered_count"),
        F.count_if(~F.col("covered")).alias("gap_count"),
        F.round(F.avg(F.col("covered").cast("int")), 4).alias("coverage_fraction"))


# Parts of a registry status that place a gap, looked for in this order.
NON_CLASS_STATUSES = ("umbrella", "source_label", "construction_style_not_single", "construction_method_umbrella", "unresolved")
HIGH_VALUE_STATUSES = (
    "canonical_existing", "architecture_family", "catalog_identified", "adjacent_official_architecture", "official_architecture_family", "official_architecture_variant",
    "official_character_specific_architecture", "historical_reference_architecture", "strong_catalog_evidence")


def gap_class(status: str) -> Column:
    """``struct<gap_class, priority>`` of a registry row that nothing covers."""
    text = F.lower(F.coalesce(F.col(status), F.lit("")))
    holds = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))
    kind = lambda name, priority: F.struct(F.lit(name).alias("gap_class"), F.lit(priority).alias("priority"))
    return (
        F.when(holds(NON_CLASS_STATUSES), kind("ontology_resolution", "P2")).when(holds(HIGH_VALUE_STATUSES), kind("official_evaluation_gap", "P0"))
        .when(F.startswith(text, F.lit("commercial_architecture")), kind("custom_evaluation_gap", "P1"))
        .when(F.contains(text, F.lit("strong")) & F.contains(text, F.lit("candidate")), kind("evidence_resolution_then_evaluation", "P1")).otherwise(kind("research_gap", "P2")))


def gated(cases: DataFrame, gate: DataFrame, record: str, allowed: str) -> DataFrame:
    """Cases whose record the gate allows as model input; a record that is missing there, or null, is not allowed."""
    return cases.join(gate.where(F.col(allowed)).select(record).distinct(), record, "left_semi")


def coverage_gap_rows(covered: DataFrame, status: str) -> DataFrame:
    """The rows of ``coverage`` that no source covers, with their class and priority."""
    return covered.where(~F.col("covered")).drop("covered", "covered_by").withColumn("_gap", gap_class(status)).select("*", "_gap.gap_class", "_gap.priority").drop("_gap")


def exact_reference_sets(
    evidence: DataFrame, keys: Sequence[str], subject: str, role: str, component: str, roles: Sequence[str],
) -> DataFrame:
    """Evidence rows to release sets: roles present, unanimous subject and cross-surface links."""
    sets = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evidence_records"), F.array_sort(F.collect_set(role)).alias("canonical_roles"),
        F.when(F.min(subject) == F.max(subject), F.min(subject)).alias("subject"))
    linked = (
        evidence.groupBy(*keys, component).agg(F.count_distinct(role).alias("n")).where("n >= 2")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("cross_surface_links")))
    out = sets.join(linked, list(keys), "left").withColumn("cross_surface_links", F.coalesce("cross_surface_links", F.lit(0)))
    out = out.withColumn("multi_surface", F.size("canonical_roles") > 1)
    for r in roles:
        out = out.withColumn(f"has_{r}", F.array_contains("canonical_roles", r))
    return out


# Fixed values: (target, weight, needs role, unless role).
ACQUISITION_TARGETS = (
    ("torso_rear_evidence", 4, "torso_front", "torso_rear"),
    ("head_rear_evidence", 3, "head_front", "head_reverse"),
    ("lower_body_rear_or_side_evidence", 2, "lower_body", None),
    ("physical_left_side_view", 1, None, None),
    ("physical_right_side_view", 1, None, None),
)


def acquisition_gaps(
    sets: DataFrame, keys: Sequence[str], satisfied: DataFrame | None = None, targets=ACQUISITION_TARGETS,
) -> DataFrame:
    """Missing evidence per reference set with priority; ``satisfied(keys, target)`` removes targets."""
    out = sets
    if satisfied is not None:
        done = satisfied.groupBy(*keys).agg(F.array_sort(F.collect_set("target")).alias("satisfied_targets"))
        out = out.join(done, list(keys), "left")
    else:
        out = out.withColumn("satisfied_targets", F.lit(None).cast("array<string>"))
    out = out.withColumn("satisfied_targets", F.coalesce("satisfied_targets", F.array().cast("array<string>")))
    has = lambda r: F.lit(True) if r is None else F.array_contains("canonical_roles", r)
    lacks = lambda r: F.lit(True) if r is None else ~F.array_contains("canonical_roles", r)
    open_ = [(has(need) & lacks(unless) & ~F.array_contains("satisfied_targets", t), t, w) for t, w, need, unless in targets]
    out = out.withColumn("targets", reasons(*[(c, t) for c, t, _ in open_]))
    score = weighted_sum(*[(c, w) for c, _, w in open_]) + F.when(F.col("multi_surface"), 2).otherwise(0) + F.least(
        F.col("cross_surface_links"), F.lit(2))
    return out.withColumn("priority_score", score).where(F.size("targets") > 0)


def decorated_corpus(
    components: DataFrame, part: str, name: str, user: str, context: DataFrame, users: int = 100, sources: int = 200,
) -> DataFrame:
    """Per part: commonest name, first users, years and sources reached through its users.

    ``context(user, theme, year, source)``; components fold to ``(part, user)`` before the join.
    """
    names = components.groupBy(part, name).agg(F.count(F.lit(1)).alias("n")).groupBy(part).agg(
        F.min(F.struct((-F.col("n")).alias("o"), F.col(name).alias("v"))).alias("_t"), F.sum("n").alias("record_count"))
    pairs = components.select(part, user).distinct()
    first = first_values(pairs, [part], user, users, "users")
    reached = pairs.join(context, user).select(part, "theme", "year", "source").distinct()
    scalars = reached.groupBy(part).agg(
        F.count_distinct("theme").alias("theme_count"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    ids = first_values(reached, [part], "source", sources, "sources")
    return (
        names.select(part, F.col("_t.v").alias("part_name"), "record_count").join(first, part, "left")
        .join(scalars, part, "left").join(ids, part, "left"))


def component_summary(components: DataFrame, entity: str, role: str, listed: Sequence[str]) -> DataFrame:
    """Per entity: component count, role counts and the number of listed components."""
    roles = components.groupBy(entity, F.col(role).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return roles.groupBy(entity).agg(
        F.sum("n").alias("component_count"), count_map(F.collect_list(F.struct("value", "n"))).alias("role_counts"),
        F.coalesce(F.sum(F.when(F.col("value").isin(*listed), F.col("n"))), F.lit(0)).alias("accessory_count"))


def component_accessories(components: DataFrame, entity: str, role: str, item: str, listed: Sequence[str]) -> DataFrame:
    """Every listed component as a row ``(entity, accessory_no, role, item)`` in order; complete for any number of them."""
    return position(components.where(F.col(role).isin(*listed)).select(entity, role, item), [F.col(role), F.col(item)], [entity], name="accessory_no")


def candidate_corpus(components: DataFrame, entity: str, component: str) -> DataFrame:
    """Route candidates per entity from head and headgear components.

    ``component`` is a struct column (see ``functions.components``). Only booleans and counts are folded.
    """
    from curatrix.functions import components as C

    c = F.col(component)
    flat = components.select(
        entity, C.is_head(c).alias("head"), C.is_headgear(c).alias("gear"), C.matched(c, C.MASK_WORDS).alias("mask"),
        C.matched(c, C.HEADGEAR_WORDS).alias("special"), C.modified_terms(c).alias("modified"), C.is_enclosure(c).alias("dome"),
        F.lower(F.coalesce(c["part_name"], F.lit(""))).alias("text"))
    head_mask = F.col("head") & (F.size("mask") > 0)
    special = F.col("gear") & (F.size("special") > 0)
    modified = F.col("head") & (F.size("modified") > 0)
    any_ = lambda cond: F.bool_or(F.coalesce(cond, F.lit(False)))
    named = lambda *w: any_(special & F.col("text").rlike("|".join(w)))
    folded = flat.groupBy(entity).agg(
        any_(F.col("gear")).alias("gear"), any_(head_mask).alias("head_mask"), any_(special).alias("special"),
        any_(modified).alias("modified"), any_(special & F.col("dome")).alias("dome"), named(*C.COSTUME_WORDS).alias("costume"),
        named("cowl").alias("cowl"), named("hood").alias("hood"), named("helmet").alias("helmet"), named("mask").alias("mask"),
        (F.count_if(head_mask) + F.count_if(special) + F.count_if(modified)).alias("evidence_count"),
        F.count_if(special & F.array_contains("special", "mask")).alias("explicit_mask_count"),
        F.count_if(modified).alias("modified_count"))
    f = F.col
    routes = reasons(
        (f("head_mask") & ~f("gear"), "head_print_or_decorated_head_only"), (f("head_mask") & f("gear"), "head_print_plus_headgear"),
        (f("dome"), "transparent_dome_or_bubble_headgear"), (f("costume"), "costume_head_cover"), (f("cowl"), "cowl_plus_head"),
        (f("hood"), "hood_plus_head"), (f("helmet"), "helmet_plus_head"), (f("mask"), "separate_mask_headgear"),
        (f("modified"), "modified_or_nonhuman_head"))
    return folded.where(f("head_mask") | f("special") | f("modified")).select(
        entity, routes.alias("candidate_routes"), "evidence_count", "explicit_mask_count", "modified_count", f("gear").alias("has_gear"))


# Route families for the evidence rank.
STRONG_ROUTES = (
    "transparent_dome_or_bubble_headgear", "costume_head_cover", "separate_mask_headgear", "modified_or_nonhuman_head",
)
MEDIUM_ROUTES = (
    "cowl_plus_head", "hood_plus_head", "head_print_or_decorated_head_only", "head_print_plus_headgear",
)


def evidence_rank(
    df: DataFrame, routes: str, evidence: Column, explicit_mask: Column, modified: Column, has_gear: Column,
) -> DataFrame:
    """Confidence band and bounded score of route candidates."""
    r = F.col(routes)
    any_of = lambda names: F.exists(r, lambda x: x.isin(*names))
    high = any_of(STRONG_ROUTES[:2]) | (explicit_mask > 0) | ((modified > 0) & ~has_gear)
    band = (
        F.when(high, "high_component_route_candidate").when(any_of(MEDIUM_ROUTES), "medium_component_route_candidate")
        .otherwise("low_or_generic_headgear_candidate"))
    generic = F.array_contains(r, "helmet_plus_head") & ~any_of(STRONG_ROUTES + MEDIUM_ROUTES)
    score = (
        F.when(high, 100).when(any_of(MEDIUM_ROUTES), 60).otherwise(25) + F.least(F.lit(20), evidence * 2)
        - F.greatest(F.lit(0), F.size(r) - 2) * 5 - F.when(generic, 20).otherwise(0))
    return df.withColumn("confidence_band", band).withColumn("route_score", F.greatest(F.lit(0), score))


def queue_rollup(df: DataFrame, base: str, band: str, ident: str, score: str, top: int = 10, bonus: int = 5) -> DataFrame:
    """Per base key: rows per band, the best candidates and the top score, plus a bonus when several."""
    bands = df.groupBy(base, F.col(band).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = bands.groupBy(base).agg(
        F.sum("n").alias("record_count"), count_map(F.collect_list(F.struct("value", "n"))).alias("band_counts"))
    best = top_k(df.select(base, ident, score), [base], [F.col(score).desc(), ident], top, "_n").groupBy(base).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(ident).alias("i")))), lambda x: x["i"]).alias("top_candidates"),
        F.max(score).alias("_max"))
    return null_safe_join(counts, best, [base]).withColumn(
        "group_score", F.col("_max") + F.when(F.col("record_count") > 1, bonus).otherwise(0)).drop("_max")


def size_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(
        F.count(F.lit(1)).alias("groups"))


def collision_class(observed: DataFrame, entries: DataFrame, key: Sequence[str], evidence: DataFrame | None = None) -> DataFrame:
    """Structure of a code shared by several catalogue entries.

    ``observed(key, words, joined)`` holds the words of the user's labels and whether a label joins two names;
    ``entries(key, entry_words)`` has one row per catalogue entry. Entries are tested row by row and only counted per
    code; ``evidence(key, resolution)`` overrides the structural class.
    """
    distinct = entries.select(*key, "entry_words").distinct().join(observed.select(*key, "words"), list(key))
    counts = distinct.groupBy(*key).agg(
        F.count(F.lit(1)).alias("catalog_entries"), F.count_if(F.arrays_overlap("entry_words", "words")).alias("supportive_entries"),
        F.bool_or(F.exists("entry_words", lambda w: F.contains(w, F.lit("microfigure")))).alias("_micro"))
    out = observed.join(counts, list(key), "left").na.fill(0, ["catalog_entries", "supportive_entries"])
    n = F.col("supportive_entries")
    structural = (
        F.when(F.coalesce("_micro", F.lit(False)) & (n >= 1), "shared_code_scale_or_component_variant")
        .when(F.col("joined") & (n >= 2), "shared_package_code_multiple_figures")
        .when(n == 1, "one_catalog_entry_matches_user_identity_other_collision_needs_review")
        .when(n >= 2, "multiple_catalog_entries_support_user_label").otherwise("true_or_unresolved_catalog_collision"))
    out = out.withColumn("structural_class", structural)
    out = out.join(evidence, list(key), "left") if evidence is not None else out.withColumn("resolution", F.lit(None).cast("string"))
    return out.select(*key, "catalog_entries", "supportive_entries", "structural_class", F.coalesce("resolution", "structural_class").alias("collision_class"))


def crosswalk_triage(status: Column, consistency: Column, matches: Column, brands: Column, supportive: Column) -> Column:
    """``struct(outcome, review_type, review_priority)`` of a code crosswalk row."""
    promote = (status == "exact_unique_serial_match") & (consistency == "name_supportive") & (matches == 1)
    kind = (
        F.when(status == "exact_unique_serial_match", "unique_serial_name_review")
        .when((status == "exact_serial_collision") & (brands <= 1) & (matches > 1) & (supportive == 1),
              "same_brand_multi_record_one_name_supportive_possible_bundle")
        .when((status == "exact_serial_collision") & (brands <= 1) & (matches > 1), "same_brand_multi_record_bundle_or_reuse")
        .when(status == "exact_serial_collision", "cross_brand_serial_collision")
        .when(status == "no_exact_serial_match", "no_current_herobloks_exact_match").otherwise("other"))
    priority = (
        F.when(kind.isin("same_brand_multi_record_one_name_supportive_possible_bundle", "cross_brand_serial_collision"), "high")
        .when(kind.isin("unique_serial_name_review", "same_brand_multi_record_bundle_or_reuse"), "medium").otherwise("low"))
    return F.struct(
        F.when(promote, "promoted").otherwise("review").alias("outcome"), F.when(~promote, kind).alias("review_type"),
        F.when(~promote, priority).alias("review_priority"))
