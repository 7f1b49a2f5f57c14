"""Joins: star joins, crosswalks by exact keys, overlays, gates and drift comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curatrix.functions.rules import jaccard
from curatrix.functions.text import norm_text, tokens
from curatrix.operators.scale import first_values, null_safe_join, position, small_side
from curatrix.session import materialize, stored


#: Rows that one task makes distinct.
TASK_ROWS = 1_000_000


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Column]], columns: Sequence[Column | str]) -> DataFrame:
    """Inner joins along a star or chain, then distinct projected rows, dealt by all columns to tasks of about ``TASK_ROWS`` rows of the fact table, however few shuffle partitions the session has."""
    out = fact
    for dim, condition in dims:
        out = out.join(small_side(dim), condition)
    out = out.select(*columns)
    return out.repartition(1 + fact.count() // TASK_ROWS, *out.columns).distinct()


def enrich(df: DataFrame, dim: DataFrame, condition: Column | str | list) -> DataFrame:
    """Left outer lookup; a dimension of checked small size is broadcast."""
    return df.join(small_side(dim), condition, "left")


def orphans(child: DataFrame, parent: DataFrame, condition: Column | str | list) -> DataFrame:
    return child.join(parent, condition, "left_anti")


def covered(df: DataFrame, members: DataFrame, condition: Column | str | list) -> DataFrame:
    return df.join(members, condition, "left_semi")


def match_status(n: Column, prefix: str = "exact", none: str = "no_exact_serial_match") -> Column:
    return (
        F.when(n == 1, f"{prefix}_unique_serial_match").when(n > 1, f"{prefix}_serial_collision").otherwise(none)
    )


def exact_key_crosswalk(
    elements: DataFrame, registry: DataFrame, usage: DataFrame, element: str, key: str, user: str, role: str,
    keep: int = 30,
) -> DataFrame:
    """Element to registry key to usage: totals, role counts and the first distinct users.

    ``elements(element, key?)`` is left-joined to ``registry(element, key, ...)`` and to usage folded per
    key; usage is aggregated before any join.
    """
    totals = usage.groupBy(key).agg(F.count(F.lit(1)).alias("usage_count"))
    roles = (
        usage.groupBy(key, role).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(role).alias("value"), "n"))).alias("role_counts"))
    )
    users = first_values(usage, [key], user, keep, "users")
    folded = totals.join(roles, key, "left").join(users, key, "left")
    found = elements.join(registry, element, "left")
    return found.join(folded, key, "left").withColumn(
        "match_status", F.when(F.col(key).isNull(), "element_not_found").otherwise("exact_element_match")
    )


def code_crosswalk(
    releases: DataFrame, catalog: DataFrame, release_id: str, code: str, name: str, catalog_name: str,
    supportive: float = 0.35, crowded: int = 1_000_000,
) -> DataFrame:
    """Equal codes: unique, collision or none, best name overlap and consistency.

    Expects both frames with a normalised ``code`` column. Equal names fold on both sides before they are
    compared. A code whose distinct labels times distinct names exceed ``crowded`` is compared through the word
    index instead, where only names that share a word meet.
    """
    from curatrix.operators.matching import top_matches

    words = lambda c: tokens(norm_text(c), min_length=1)
    entries = catalog.groupBy(code, F.col(catalog_name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows"))
    names = releases.select(code, F.col(name).alias("_label")).distinct()
    counts = entries.groupBy(code).agg(F.sum("_rows").alias("match_count"), F.count(F.lit(1)).alias("_e"))
    labels = names.groupBy(code).agg(F.count(F.lit(1)).alias("_l"))
    hot = materialize(counts.join(labels, code).where(F.col("_e") * F.col("_l") > crowded).select(code))
    plain = lambda df: df if no_hot else df.join(small_side(hot), code, "left_anti")
    no_hot = hot.isEmpty()
    # Words are taken once per distinct name, not once per pair.
    lw = plain(names).withColumn("_lw", words("_label"))
    best = lw.join(plain(entries).withColumn("_rw", words("_name")), code).groupBy(code, "_label").agg(
        F.max(jaccard("_lw", "_rw")).alias("max_name_overlap"))
    if not no_hot:
        crowd = lambda df: df.join(small_side(hot), code, "left_semi")
        left = crowd(names).select(F.struct(code, "_label").alias("lid"), words("_label").alias("words"), F.col(code).alias("block"))
        right = crowd(entries).select(F.col("_name").alias("rid"), words("_name").alias("words"), F.col(code).alias("block"))
        score = lambda pairs: pairs.withColumn("score", jaccard("lwords", "rwords"))
        found = top_matches(left, right, "lid", "rid", "words", score, 1, ["block"], ["block"], scope=F.col("block").cast("string"),
                            scopes=F.array(F.col("block").cast("string")))
        hit = left.select("lid").join(found, "lid", "left").select("lid.*", F.coalesce("score", F.lit(0.0)).alias("max_name_overlap"))
        best = best.unionByName(hit)
    joined = releases.withColumn("_label", F.col(name)).join(counts.select(code, "match_count"), code, "left").join(best, [code, "_label"], "left")
    n = F.coalesce(F.col("match_count"), F.lit(0))
    return joined.select(
        release_id, code, name, n.alias("match_count"), F.col("max_name_overlap"),
        match_status(n).alias("match_status"),
        F.when(n == 0, "no_catalog_match").when(F.col("max_name_overlap") >= supportive, "name_supportive")
        .otherwise("serial_match_name_needs_review").alias("identity_consistency"),
    )


def cascading_catalogs(
    releases: DataFrame, catalogs: Sequence[tuple[str, DataFrame]], code: str,
    manual: DataFrame | None = None,
) -> DataFrame:
    """Primary catalogue first, fallbacks only for rows without a primary match, then manual records.

    All catalogues are folded to counts per ``(code, level)`` and joined once.
    """
    levels = [(name, df, 0 if i == 0 else 1) for i, (name, df) in enumerate(catalogs)]
    if manual is not None:
        levels.append(("manual", manual, 2))
    parts = None
    for name, df, level in levels:
        part = df.groupBy(code).agg(F.count(F.lit(1)).alias("n")).select(
            code, F.lit(name).alias("catalog"), F.lit(level).alias("level"), "n")
        parts = part if parts is None else parts.unionByName(part)
    folded = parts.groupBy(code).agg(
        F.sum(F.when(F.col("level") == 0, F.col("n"))).alias("primary_n"),
        F.max(F.when(F.col("level") == 1, F.col("n"))).alias("fallback_max"),
        F.sum(F.when(F.col("level") == 2, F.col("n"))).alias("manual_n"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 1, F.struct("catalog", "n")))).alias("fallback_hits"),
    )
    out = releases.join(folded, code, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    primary = match_status(zero("primary_n"))
    open_ = zero("primary_n") == 0
    fallback = (
        F.when(open_ & (zero("fallback_max") > 1), "historical_exact_serial_collision")
        .when(open_ & (zero("fallback_max") == 1), "historical_exact_unique_serial_match")
        .otherwise("no_historical_exact_serial_match")
    )
    manual_open = open_ & (zero("fallback_max") == 0)
    manual_status = (
        F.when(manual_open & (zero("manual_n") == 1), "manual_exact_verified")
        .when(manual_open & (zero("manual_n") > 1), "manual_exact_collision").otherwise("no_manual_exact_verification")
    )
    effective = (
        F.when(~open_, primary).when(zero("fallback_max") > 0, fallback)
        .when(zero("manual_n") > 0, manual_status).otherwise("no_exact_serial_match_any_catalog")
    )
    return out.select(
        *releases.columns, primary.alias("primary_status"), fallback.alias("fallback_status"),
        manual_status.alias("manual_status"), effective.alias("effective_status"),
        F.when(open_, F.coalesce("fallback_hits", F.array().cast("array<struct<catalog:string,n:bigint>>")))
        .otherwise(F.array().cast("array<struct<catalog:string,n:bigint>>")).alias("fallback_hits"),
    )


def overlay_corrections(
    source: DataFrame, fixes: DataFrame, key: Sequence[str], fields: Sequence[str], guard: str | None = None,
) -> DataFrame:
    """Apply corrections by key, only where the guarded field still holds the expected text.

    ``fixes`` has the key, ``expected``, ``fix_<field>`` values and ``clear_fields``; original values stay in
    ``original``.
    """
    joined = source.join(small_side(fixes.withColumn("_fix", F.lit(True))), list(key), "left")
    hit = F.coalesce(F.col("_fix"), F.lit(False))
    if guard:
        expected, seen = F.coalesce(F.col("expected"), F.lit("")), F.coalesce(F.col(guard), F.lit(""))
        hit = hit & ((F.trim(expected) == "") | (F.trim(seen) == "") | (norm_text(expected) == norm_text(seen)))
    clear = F.coalesce(F.col("clear_fields"), F.array().cast("array<string>"))
    out = joined.withColumn("corrected", hit).withColumn("_clear", clear)
    touched = {f: F.col("corrected") & (F.col(f"fix_{f}").isNotNull() | F.array_contains("_clear", f)) for f in fields}
    original = F.struct(*[F.when(touched[f], F.col(f)).alias(f) for f in fields])
    out = out.withColumn("original", F.when(F.col("corrected"), original))
    for f in fields:
        fixed = F.when(F.array_contains("_clear", f), F.lit(None)).otherwise(F.coalesce(F.col(f"fix_{f}"), F.col(f)))
        out = out.withColumn(f, F.when(F.col("corrected"), fixed).otherwise(F.col(f)))
    return out.select(*source.columns, "corrected", "original")


def priority_resolution(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str,
    embedded: DataFrame | None = None,
) -> DataFrame:
    """Exact id (1.0), else one embedded id (0.98), else a name unique on the right (0.85), else unmatched.

    ``embedded(left_id, value)`` lists scalar values found inside the left records.
    """
    rid = right.select(F.col(right_id).alias("match_id")).where("match_id is not null").distinct()
    exact = left.join(rid, F.col(left_id) == F.col("match_id")).select(left_id, "match_id", F.lit(1).alias("prio"))
    found = exact
    if embedded is not None:
        single = (
            embedded.join(rid, F.col("value") == F.col("match_id"))
            .groupBy(left_id).agg(F.min("match_id").alias("match_id"), F.max("match_id").alias("_max"))
            .where("match_id = _max").select(left_id, "match_id", F.lit(2).alias("prio"))
        )
        found = found.unionByName(single)
    unique = (
        right.where(F.coalesce(F.col(right_name), F.lit("")) != "").groupBy(F.col(right_name).alias("_name"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias("match_id")).where("_n = 1")
    )
    named = left.join(unique, F.col(left_name) == F.col("_name")).select(left_id, "match_id", F.lit(3).alias("prio"))
    best = found.unionByName(named).groupBy(left_id).agg(F.min(F.struct("prio", "match_id")).alias("_best"))
    prio = F.col("_best.prio")
    return left.join(best, left_id, "left").select(
        *left.columns, F.col("_best.match_id").alias("match_id"),
        F.when(prio == 1, "exact_primary_id").when(prio == 2, "embedded_id").when(prio == 3, "unique_exact_name")
        .otherwise("unmatched").alias("match_method"),
        F.when(prio == 1, 1.0).when(prio == 2, 0.98).when(prio == 3, 0.85).otherwise(0.0).alias("confidence"),
    )


def expand_to_parts(
    candidates: DataFrame, components: DataFrame, geometry: DataFrame, subject: str, entity: str, part: str,
    role: str, component_role: str, score: str, roles: DataFrame, listed: int = 30, strict_score: float = 0.9,
) -> DataFrame:
    """Candidate entities to their role-compatible components to exact geometry ids.

    ``roles(role, component_role)`` is the compatibility table. Gives the best entity per
    ``(subject, component)`` with its link class and its place among the links of the subject. All links stay; ``listed`` marks the
    first ones, which make up the short part list.
    """
    flat = part_links(candidates, components, geometry, subject, entity, part, role, component_role, score, roles, strict_score)
    order = [F.col(score).desc(), part, "component_id", F.col("print_of").asc_nulls_first()]
    placed = position(flat, order, [subject], name="link_rank")
    return placed.withColumn("in_part_list", F.col("link_rank") <= listed).drop("print_of")


def part_links(
    candidates: DataFrame, components: DataFrame, geometry: DataFrame, subject: str, entity: str, part: str,
    role: str, component_role: str, score: str, roles: DataFrame, strict_score: float = 0.9,
) -> DataFrame:
    """The links of ``expand_to_parts`` with ``print_of`` and without their places, for uses that need no order."""
    hop = candidates.join(small_side(roles), role).join(components, [entity, component_role])
    best = hop.groupBy(subject, "component_id", part, "print_of").agg(
        F.max_by(F.struct(F.col(score).alias("score"), F.col(entity).alias("entity")),
                 F.struct(F.col(score), F.col(entity))).alias("_b")
    )
    linked = best.join(geometry.select(F.col(part), F.lit(True).alias("_geo")).distinct(), part, "left")
    printed = F.col("print_of").isNotNull()
    kind = (
        F.when(F.col("_geo").isNull(), "no_geometry")
        .when(~printed, "base_substrate_link")
        .when(F.col("_b.score") >= strict_score, "strict_print_link").otherwise("unverified_print_link")
    )
    return linked.select(subject, "component_id", part, "print_of", F.col("_b.score").alias(score),
                         F.col("_b.entity").alias(entity), kind.alias("link_class"))


#: Links of a component that meet with arrays of assets, and about how many assets an array holds.
FEW_LINKS, ASSETS = 16, 1000


def geometry_links(links: DataFrame, geometry: DataFrame, subject: str, part: str, asset: str) -> DataFrame:
    """The three link lists of ``expand_to_parts`` as rows: ``(subject, list, component_id, part, asset, score, entity)``.

    ``geometry(part, asset, ...)`` holds every asset of a part; codes meet without regard to case. A plain part gives a ``base`` row, which says nothing about a print; a printed one gives a ``raw`` row, and a ``strict`` row too where its link
    class is strict. A component and an asset count once in a list, with their best score.

    A component with one link has nothing to be best of. The links of one with up to ``FEW_LINKS`` meet with the assets of their parts as arrays (at most about ``ASSETS`` in each, dealt by hash beyond that), and a link gives the assets
    that no better one has; only components of more links meet asset by asset.
    """
    code = lambda c: F.lower(F.col(c).cast("string"))
    assets = geometry.where(F.col(asset).isNotNull()).select(code(part).alias("_code"), F.col(asset)).distinct()
    kinds = F.when(F.col("link_class") == "base_substrate_link", F.array(F.lit("base"))).when(F.col("link_class") == "strict_print_link", F.array(F.lit("raw"), F.lit("strict"))).when(F.col("link_class") == "unverified_print_link", F.array(F.lit("raw")))
    links = links.select(subject, "component_id", "score", "entity", F.col(part).alias("_part"), code(part).alias("_code"), kinds.alias("_lists")).where("_lists is not null and _code is not null")
    links = links.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(subject, "component_id")))
    assets = stored(assets)
    most = assets.groupBy("_code").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    held = assets.groupBy("_code", F.pmod(F.xxhash64(asset), F.lit(1 + most // ASSETS)).alias("_deal")).agg(F.collect_list(asset).alias("_assets"))
    alone = links.where("_n = 1").join(held, "_code").withColumn("list", F.explode("_lists")).withColumn(asset, F.explode("_assets"))

    few = links.where(F.col("_n").between(2, FEW_LINKS)).join(held, "_code").repartition(subject, "component_id", "_deal").withColumn("list", F.explode("_lists"))
    better = W.partitionBy(subject, "component_id", "_deal", "list").orderBy(*[F.col(c).desc() for c in ("score", "entity", "_part")]).rowsBetween(W.unboundedPreceding, -1)
    few = few.withColumn("_taken", F.flatten(F.collect_list("_assets").over(better))).withColumn(asset, F.explode(F.array_except("_assets", "_taken")))

    many = links.where(F.col("_n") > FEW_LINKS).join(assets, "_code").withColumn("list", F.explode("_lists"))
    many = many.groupBy(subject, "list", "component_id", asset).agg(F.max(F.struct("score", "entity", "_part")).alias("_b")).select("*", "_b.*")
    rows = [df.select(subject, "list", "component_id", F.col("_part").alias(part), asset, "score", "entity") for df in (alone, few, many)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


# Order of representation states, strongest first.
REPRESENTATION = ("likely_existing_representation", "existing_name_level_representation", "name_match_variant_unresolved")


def alias_retrieval(
    targets: DataFrame, releases: DataFrame, target_id: str, release_id: str, status: Column,
) -> DataFrame:
    """Targets to releases sharing a name or identity key, with the strongest state per target.

    ``targets`` has ``name_keys`` and ``identity_keys`` arrays, ``releases`` has ``name_keys``. ``status`` may use the
    other columns of both sides plus ``name_relation``. Names repeat, so both sides fold to distinct rows with a
    count before they meet: a name held by many releases costs one row per distinct variant, not one per release.
    """
    t_cols = [c for c in targets.columns if c != target_id]
    r_cols = [c for c in releases.columns if c != release_id]
    tsig = F.sha2(F.to_json(F.struct(*t_cols), {"ignoreNullFields": "false"}), 256)
    rsig = F.sha2(F.to_json(F.struct(*r_cols), {"ignoreNullFields": "false"}), 256)
    t = targets.withColumn("_t", tsig)
    tset = t.groupBy("_t").agg(F.first(F.struct(*t_cols)).alias("_b")).select("_t", "_b.*")
    rset = releases.withColumn("_r", rsig).groupBy("_r").agg(F.first(F.struct(*r_cols)).alias("_b"), F.count(F.lit(1)).alias("_n")).select(
        "_r", "_n", "_b.*").withColumnRenamed("name_keys", "release_keys")
    keys = tset.select("_t", F.explode(F.array_distinct(F.concat("name_keys", "identity_keys"))).alias("_key"))
    pairs = keys.join(rset.select("_r", F.explode("release_keys").alias("_key")), "_key").select("_t", "_r").distinct()
    both = pairs.join(tset, "_t").join(rset, "_r")
    relation = (
        F.when(F.arrays_overlap("name_keys", "release_keys"), "exact_or_alias_name")
        .when(F.arrays_overlap("identity_keys", "release_keys"), "explicit_identity_name").otherwise("retrieval_only")
    )
    rated = both.withColumn("name_relation", relation).withColumn("_status", status)
    rank = F.lit(len(REPRESENTATION))
    for i, label in reversed(list(enumerate(REPRESENTATION))):
        rank = F.when(F.col("_status") == label, i).otherwise(rank)
    folded = rated.groupBy("_t").agg(F.sum("_n").alias("release_candidate_count"), F.min_by("_status", rank).alias("_status"))
    return t.select(target_id, "_t").join(folded, "_t", "left").select(
        target_id, F.coalesce("release_candidate_count", F.lit(0)).alias("release_candidate_count"),
        F.coalesce("_status", F.lit("no_exact_name_release_candidate")).alias("representation_status"),
    )


def id_lookup_with_name_check(
    df: DataFrame, catalog: DataFrame, key: str, name_words: str, catalog_words: str,
    supportive: float = 0.35, conflict: float = 0.15,
) -> DataFrame:
    """Exact id lookup; the word overlap of both names says whether the hit is believable."""
    score = jaccard(name_words, catalog_words)
    return enrich(df, catalog, key).withColumn("name_overlap", F.when(F.col(catalog_words).isNotNull(), score)).withColumn(
        "resolution",
        F.when(F.col(catalog_words).isNull(), "id_not_found")
        .when(F.col("name_overlap") >= supportive, "id_match_name_supportive")
        .when(F.col("name_overlap") < conflict, "id_match_name_conflict").otherwise("id_match_name_review"),
    )


def refine_by_evidence(backlog: DataFrame, evidence: DataFrame, key: str, routes: Mapping[str, str], default: str) -> DataFrame:
    """Left join the evidence status and route each row by it."""
    route = None
    for status, target in routes.items():
        hit = F.col("evidence_status") == status
        route = F.when(hit, target) if route is None else route.when(hit, target)
    route = F.lit(default) if route is None else route.otherwise(default)
    return backlog.join(evidence, key, "left").withColumn("route", route)


def alias_fallback(df: DataFrame, key: str, name: str, value: str, preferred: Column) -> DataFrame:
    """Rows without a value borrow it from a row of the same name, preferred ids first.

    Donors fold to one row per name before the join.
    """
    donors = df.where(F.col(value).isNotNull() & F.col(name).isNotNull()).groupBy(name).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col(key).alias("id")),
                 F.struct(F.when(preferred, 0).otherwise(1), F.col(key))).alias("_donor")
    )
    use = F.col(value).isNull() & F.col("_donor").isNotNull()
    return df.join(donors, name, "left").select(
        *[c for c in df.columns if c != value], F.coalesce(F.col(value), F.col("_donor.v")).alias(value),
        F.when(use, F.col("_donor.id")).alias("borrowed_from"),
        F.when(F.col(value).isNotNull(), "direct_pair").when(use, "alias_fallback").otherwise("missing")
        .alias("resolution"),
    )


def hash_gate(
    queue: DataFrame, candidates: DataFrame, reviews: DataFrame, key: str, digests: Sequence[str],
) -> DataFrame:
    """Admit only rows whose digests agree everywhere, whose checks are all true and whose approval is unanimous.

    ``queue`` and ``candidates`` carry ``digests``; ``reviews`` carries them plus ``decision`` and ``checks``
    (string to boolean map). Everything else is blocked with a reason.
    """
    cand = candidates.select(key, *[F.col(d).alias(f"c_{d}") for d in digests])
    rev = reviews.withColumn("_ok", F.coalesce(F.forall(F.map_values("checks"), lambda x: x), F.lit(False)) & (F.size("checks") > 0))
    folded = rev.groupBy(key).agg(
        F.count(F.lit(1)).alias("review_count"), F.min("decision").alias("_d0"), F.max("decision").alias("_d1"),
        F.every("_ok").alias("_checks"),
        *[F.min(d).alias(f"r0_{d}") for d in digests], *[F.max(d).alias(f"r1_{d}") for d in digests],
        *[F.every(F.col(d).isNotNull()).alias(f"rn_{d}") for d in digests],
    )
    j = queue.join(cand, key, "left").join(folded, key, "left")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    cand_ok, rev_ok = F.lit(True), F.lit(True)
    for d in digests:
        if d in queue.columns:
            cand_ok = cand_ok & same(F.col(d), F.col(f"c_{d}"))
        rev_ok = rev_ok & same(F.col(f"r0_{d}"), F.col(f"c_{d}")) & same(F.col(f"r1_{d}"), F.col(f"c_{d}")) & F.col(f"rn_{d}")
    reason = (
        F.when(F.coalesce(*[F.col(f"c_{d}") for d in digests]).isNull(), "candidate_missing")
        .when(~cand_ok, "candidate_digest_mismatch").when(F.col("review_count").isNull(), "review_missing")
        .when(~F.coalesce(rev_ok, F.lit(False)), "review_digest_mismatch").when(F.col("_d0") != F.col("_d1"), "review_decisions_conflict")
        .when(F.coalesce(F.col("_d0"), F.lit("")) != "approved", "review_not_approved").when(~F.col("_checks"), "review_checks_incomplete")
    )
    return j.select(*queue.columns, F.coalesce("review_count", F.lit(0)).alias("review_count"),
                    reason.alias("blocked_reason"), reason.isNull().alias("admitted"))


def overlay_documents(base: DataFrame, supplements: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Supplements replace base rows; two supplements with different digests for one key raise."""
    picked = supplements.groupBy(*key).agg(
        F.min(digest).alias("_d0"), F.max(digest).alias("_d1"),
        F.min_by(F.struct(*[F.col(c) for c in supplements.columns if c not in key]), digest).alias("_row"),
    )
    stop = F.raise_error(F.concat(F.lit("differing digests for "), F.to_json(F.struct(*key)))).cast(
        picked.schema["_row"].dataType)
    picked = picked.withColumn("_row", F.when(F.col("_d0") != F.col("_d1"), stop).otherwise(F.col("_row")))
    added = picked.select(*key, "_row.*").select(*base.columns, F.lit("supplement").alias("origin"))
    kept = base.join(supplements.select(*key).distinct(), list(key), "left_anti").withColumn("origin", F.lit("base"))
    return kept.unionByName(added)


def drift(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer comparison by key: missing, extra, changed fields or equal."""
    l = left.select(*key, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("_l"))
    r = right.select(*key, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("_r"))
    changed = F.filter(
        F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = (
        F.when(F.col("_r").isNull(), "missing_right").when(F.col("_l").isNull(), "extra_right")
        .when(F.size("_c") > 0, "changed").otherwise("equal")
    )
    return l.join(r, list(key), "full").withColumn("_c", changed).select(
        *key, status.alias("drift_status"),
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("_c"))
        .otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )


def propagate_by_signature(df: DataFrame, signature: str, label: str, key: str) -> DataFrame:
    """A label all reviewed members of a signature agree on flows to the unreviewed members."""
    votes = df.groupBy(signature).agg(
        F.min(label).alias("_low"), F.max(label).alias("_high"), F.count(label).alias("reviewed_members"),
        F.count(F.lit(1)).alias("signature_members"),
    )
    state = (
        F.when(F.col(label).isNotNull(), "reviewed").when(F.col("reviewed_members") == 0, "signature_unreviewed")
        .when(F.col("_low") == F.col("_high"), "propagated_candidate").otherwise("conflicting_reviews")
    )
    return null_safe_join(df, votes, [signature]).select(
        key, signature, "signature_members", "reviewed_members", state.alias("propagation_status"),
        F.when(state == "propagated_candidate", F.col("_low")).when(state == "reviewed", F.col(label)).alias("propagated_label"),
    )


def resolve_references(records: DataFrame, registry: DataFrame, key: str, refs: str, ref_key: str, locator: str) -> DataFrame:
    """Explode reference ids, look them up and nest the locators back; an unknown reference raises."""
    rows = records.select(key, F.posexplode_outer(refs).alias("_pos", "_ref"))
    found = rows.join(small_side(registry.select(F.col(ref_key).alias("_ref"), F.col(locator).alias("_loc"))), "_ref", "left")
    missing = F.col("_ref").isNotNull() & F.col("_loc").isNull()
    loc = F.when(missing, F.raise_error(F.concat(F.lit("unknown reference "), F.col("_ref").cast("string"))).cast("string")).otherwise(
        F.col("_loc"))
    packed = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_ref").isNotNull(), F.struct("_pos", loc.alias("loc"))))).alias("_p"))
    return records.join(packed, key, "left").select(
        *[c for c in records.columns], F.transform("_p", lambda x: x["loc"]).alias("locators"))


def expected_vs_auto(
    df: DataFrame, manual: str, auto: str, confidence: str, expected: Mapping[str, str], high: float = 0.95,
) -> DataFrame:
    """Compare an automatic class with the class a manual label implies."""
    wanted = None
    for label, cls in expected.items():
        hit = F.col(manual) == label
        wanted = F.when(hit, cls) if wanted is None else wanted.when(hit, cls)
    out = df.withColumn("expected_class", wanted)
    status = (
        F.when(F.col("expected_class").isNull(), "manual_label_not_mapped").when(F.col(auto).isNull(), "missing_auto_class")
        .when(F.col("expected_class") == F.col(auto), "agreement")
        .when(F.col(confidence) >= high, "high_confidence_conflict").otherwise("difference")
    )
    return out.withColumn("audit_status", status)
