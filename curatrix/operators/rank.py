"""Ranking: queues, margins, slots, ring pairs, batches and label slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions.ids import set_digest
from curatrix.operators.scale import null_safe_join, position, small_side, top_k
from curatrix.session import materialize


def rank_queue(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Exact 1..n rank in a total order, computed over range partitions."""
    return position(df, order, name=name)


def top_margin(df: DataFrame, keys: Sequence[str], score: str, ident: str) -> DataFrame:
    """Top and second score, margin, ties at the top and the ambiguity level per key.

    Equal scores fold first, so a hot key costs one row per distinct score and task.
    """
    folded = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias("_id"))
    best = top_k(folded, keys, [F.col(score).desc()], 2, "_r").groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.struct(F.col(score).alias("s"), "_n", "_id"))).alias("_t"),
        F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_s"))
    second = F.when(F.col("_t._n") > 1, F.col("_t.s")).otherwise(F.coalesce("_s", F.lit(0.0)))
    ties = F.col("_t._n")
    return best.select(
        *keys, F.col("_t._id").alias("top_id"), F.col("_t.s").alias("top_score"), second.alias("second_score"),
        F.round(F.col("_t.s") - second, 4).alias("margin"), ties.alias("tie_count"),
        F.when(ties >= 4, "high").when(ties >= 2, "medium").otherwise("low").alias("ambiguity"))


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, ident: str) -> DataFrame:
    """The row with the highest score, smallest id on ties, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(ident).alias("i"))).alias("_b"))
    return picked.select(*keys, "_b.*")


# Weight of a source's authority.
AUTHORITY: dict[str, int] = {
    "lego_primary": 100, "rights_holder_primary": 95, "developer_primary": 95, "official_film_local_copy": 90,
    "licensed_game_primary": 90, "structured_catalog": 80, "structured_catalog_secondary": 72,
    "official_ecosystem_reference": 70, "community_structured": 62, "secondary_structured_vector": 62,
    "secondary_research": 45, "secondary_discovery": 25,
}
VIEW_ALIASES: dict[str, str] = {
    "back": "rear", "front_right_3q": "front_3q_right", "front_left_3q": "front_3q_left",
    "rear_right_3q": "rear_3q_right", "rear_left_3q": "rear_3q_left",
}
REQUIRED_SLOTS = (
    "full_front", "full_rear", "full_left", "full_right", "head_front", "torso_front", "hips_legs_front",
)
PART_SLOTS = ("part_front", "part_rear", "part_left", "part_right")


def _lookup(table: Mapping, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def evidence_score(authority: Mapping[str, int] = AUTHORITY) -> Column:
    """Authority, confidences, capped resolution, minus blur and occlusion; a zero stays a zero.

    A negative or non-finite figure, or a confidence above 1, raises: it would outrank sound evidence.
    """

    def n(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        most = float("inf") if name in ("width", "height") else 1.0
        sound = (value >= 0) & ~F.isnan(value) & (value < float("inf")) & (value <= most)
        return F.when(sound, value).otherwise(F.raise_error(F.concat(F.lit(f"{name} out of range: "), value.cast("string"))).cast("double"))

    resolution = F.when((n("width") > 0) & (n("height") > 0),
                        F.least(F.lit(15.0), F.sqrt(n("width")) * F.sqrt(n("height")) / 100)).otherwise(0.0)
    return (
        _lookup(authority, F.coalesce("authority", F.lit("")), F.lit(0)) + 20 * n("identity_confidence")
        + 10 * n("view_confidence") + 8 * n("segmentation_confidence") + resolution - 10 * n("blur_score")
        - 15 * n("occlusion_score"))


def evidence_slot(target_kind: str = "minifigure") -> Column:
    """Slot a piece of evidence fills, from medium, component and view."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    component, medium = low("component_type"), low("medium")
    raw = F.lower(F.coalesce(F.nullif(F.col("view"), F.lit("")), F.lit("unknown")))
    view = _lookup(VIEW_ALIASES, raw, raw)
    ladder = None
    for word, slot in (("game_texture", "game_texture"), ("game_model", "game_model_render"), ("film", "film_expression_states"),
                       ("pattern", "structured_component_pattern"), ("geometry", "structured_geometry")):
        hit = F.contains(medium, F.lit(word))
        ladder = F.when(hit, slot) if ladder is None else ladder.when(hit, slot)
    if target_kind == "part":
        return ladder.otherwise(F.concat(F.lit("part_"), view))
    return (
        ladder.when(component.isin("head", "face"), F.concat(F.lit("head_"), F.when(view == "rear", "reverse").otherwise(view)))
        .when(component == "torso", F.concat(F.lit("torso_"), view))
        .when(component.isin("hips", "leg", "legs", "hips_legs"), F.concat(F.lit("hips_legs_"), view))
        .when(component.isin("arm_left", "left_arm"), "arm_left").when(component.isin("arm_right", "right_arm"), "arm_right")
        .when(component.isin("helmet", "mask", "headgear", "helmet_or_mask"),
              F.concat(F.lit("mask_or_headgear_"), F.when(view.isin("left", "right"), "side").otherwise(view)))
        .when(F.startswith(component, F.lit("accessory")), "accessory_primary")
        .when(view.isin("front_3q_left", "front_3q_right"), "full_front_3q")
        .when(view.isin("front", "rear", "left", "right"), F.concat(F.lit("full_"), view)).otherwise("other"))


def resolve_slots(
    df: DataFrame, sample: str, slot: str, asset: str, digest: str, score: str, conflicted: str, alternates: int = 5,
) -> DataFrame:
    """Per ``(sample, slot)``: preferred asset, next distinct alternates and the number of occurrences.

    Copies of one digest fold to their best asset before ranking; conflicted rows never win. All
    occurrences stay in the input, keyed by the same ``(sample, slot)``.
    """
    usable = df.where(~F.coalesce(F.col(conflicted), F.lit(False)))
    content = F.coalesce(F.nullif(F.col(digest), F.lit("")), F.col(asset))
    unique = usable.groupBy(sample, slot, content.alias("_content")).agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(asset).alias("a"))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    totals = unique.groupBy(sample, slot).agg(F.sum("_n").alias("occurrence_count"), F.count(F.lit(1)).alias("distinct_contents"))
    head = top_k(unique, [sample, slot], ["_b"], alternates + 1, "_r").groupBy(sample, slot).agg(
        F.array_sort(F.collect_list(F.struct("_r", "_b"))).alias("_l"))
    first = F.get("_l", F.lit(0))["_b"]
    return null_safe_join(head, totals, [sample, slot]).select(
        sample, slot, first["a"].alias("preferred_asset_id"), F.round(-first["s"], 3).alias("preferred_score"),
        F.transform(F.slice("_l", 2, alternates), lambda x: x["_b"]["a"]).alias("alternate_asset_ids"),
        "occurrence_count", "distinct_contents")


def slot_completeness(slots: DataFrame, sample: str, slot: str, required: Sequence[str] = REQUIRED_SLOTS) -> DataFrame:
    present = slots.where(F.col(slot).isin(*required)).groupBy(sample).agg(F.collect_set(slot).alias("_have"))
    base = slots.select(sample).distinct().join(present, sample, "left")
    wanted = F.array(*[F.lit(r) for r in required])
    return base.select(sample, F.array_except(wanted, F.coalesce("_have", F.array().cast("array<string>"))).alias("missing_roles"))


def ring_pairs(df: DataFrame, ident: str, partner: str, group: str | None = None, hops: int = 2) -> DataFrame:
    """Each row paired with the next row of a ring ordered by ``ident``: overall, or inside ``group``.

    If the next row has the same partner, the one after is used (``hops=2``) or the row stays unpaired
    (``hops=1``). A row never pairs with itself. Neighbours are found by an equi-join on the ring position, so
    one huge ring is spread like any other join key.
    """
    keys = [group] if group else []
    placed = materialize(position(df.select(ident, partner, *keys), [ident], keys, "_at"))
    size = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ring = placed.join(size, keys) if keys else placed.crossJoin(F.broadcast(size))
    ring = ring.where("_n > 1")
    step = lambda k: (F.col("_at") - 1 + k) % F.col("_n") + 1
    nxt = placed.select(F.col(ident).alias("negative_id"), F.col(partner).alias("negative_partner"), F.col("_at").alias("n_at"),
                        *[F.col(k).alias(f"n_{k}") for k in keys])

    def hop(rows: DataFrame, k: int) -> DataFrame:
        condition = F.col("_to") == F.col("n_at")
        for c in keys:
            condition = condition & (F.col(c) == F.col(f"n_{c}"))
        return rows.withColumn("_to", step(k)).join(nxt, condition)

    cols = [ident, partner, *keys, "negative_id", "negative_partner"]
    one = hop(ring, 1)
    other = F.col("negative_partner") != F.col(partner)
    out = one.where(other).select(*cols)
    if hops > 1:
        out = out.unionByName(hop(one.where(~other).select(ident, partner, *keys, "_at", "_n"), 2).select(*cols))
    return out.where(F.col("negative_id") != F.col(ident))


def batch_plan(df: DataFrame, score: str, ident: str, size: int = 25, min_score: float = 6.0) -> DataFrame:
    """Eligible rows in score order cut into batches, one plan row per batch."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    ranked = position(df.where(F.coalesce(F.col(score), F.lit(0.0)) >= min_score).select(score, ident),
                      [F.col(score).desc(), ident], name="rank")
    batch = F.floor((F.col("rank") - 1) / size).cast("int") + 1
    line = F.concat_ws("|", F.col("rank").cast("string"), F.col(ident).cast("string"))
    return ranked.withColumn("batch_index", batch).groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("selected_records"), F.max(score).alias("top_score"), F.min(score).alias("bottom_score"),
        F.min_by(ident, "rank").alias("first_id"), F.max_by(ident, "rank").alias("last_id"),
        set_digest(line).alias("batch_digest")).withColumn("offset", (F.col("batch_index") - 1) * size)


def batch_members(df: DataFrame, score: str, ident: str, size: int = 25, min_score: float = 6.0) -> DataFrame:
    ranked = position(df.where(F.coalesce(F.col(score), F.lit(0.0)) >= min_score), [F.col(score).desc(), ident], name="rank")
    return ranked.withColumn("batch_index", F.floor((F.col("rank") - 1) / size).cast("int") + 1)


def label_slices(df: DataFrame, ident: str, labels: str, score: str, n: int) -> DataFrame:
    """Top ``n`` rows per label; a row picked by several labels stays with the most frequent one."""
    flat = df.select(ident, score, F.explode(labels).alias("label"))
    size = flat.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    head = top_k(flat, ["label"], [F.col(score).desc(), ident], n, "label_rank").join(small_side(size), "label")
    best = F.min_by(F.struct("label", score, "label_rank"), F.struct((-F.col("_size")).alias("s"), "label"))
    return head.groupBy(ident).agg(best.alias("_b")).select(ident, "_b.*")


def running_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Occurrence order inside each key; a hot key is numbered across range partitions."""
    return position(df, order, keys, name)


def status_order(status: Column | str, order: Sequence[str]) -> Column:
    """Rank of a status in a custom order; unknown ones sort last."""
    status = F.col(status) if isinstance(status, str) else status
    ladder = None
    for i, s in enumerate(order):
        ladder = F.when(status == s, i) if ladder is None else ladder.when(status == s, i)
    return ladder.otherwise(len(order))


def natural_serial(serial: Column | str) -> tuple[Column, Column, Column]:
    """Sort keys of a serial: letters, then number, then the serial itself."""
    s = F.col(serial) if isinstance(serial, str) else serial
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.regexp_replace(s, "[0-9]", ""), F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("9" * 30)), F.lit(0)), s
