"""Fuzzy matching over part names; the SQL side compares all pairs by brute force."""

from pyspark.sql import functions as F

from curatrix.operators import group, matching, queues, rank
from curatrix.plans.registry import query

# Distinct word sets with their smallest ids; equal names share one signature.
PAIRS_SQL = """
l as (select p_partkey, list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) as w, p_brand as b from part),
r as (select p_partkey as rid, list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) as w, p_brand as b from part),
ls as (select distinct w, b from l), rs as (select w, b, list_sort(list(rid))[1:5] as ids from r group by 1, 2),
pr as (select ls.w as lw, ls.b as lb, rs.w as rw, rs.b as rb, rs.ids, len(list_intersect(ls.w, rs.w)) as n, len(list_distinct(list_concat(ls.w, rs.w))) as u,
  list_intersect(ls.w, rs.w)[1] as one from ls, rs where {where}),
sc as (select *, {score} as score from pr where n > 0),
ex as (select lw, lb, score, unnest(ids) as rid from sc where score >= {min}),
tk as (select *, row_number() over (partition by lw, lb order by score desc, rid) as rank from ex)
"""
TOKEN_SCORE = "round(least(n / u + case when n >= 2 then 0.15 when n = 1 and length(one) >= 6 then 0.05 else 0.0 end, 1.0), 4)"
BLOCK_SCORE = "round(least(least(n / u + case when n >= 2 then 0.15 when n = 1 and length(one) >= 6 then 0.05 else 0.0 end, 1.0) + 0.12, 1.0), 4)"


def names(t, ident="p_partkey"):
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))
    return t.part.select(F.col("p_partkey").alias(ident), words.alias("words"), F.col("p_brand").alias("brand"))


@query("fuzzy_topk_blocked", "with " + PAIRS_SQL.format(where="ls.b = rs.b", score=BLOCK_SCORE, min=0.18) +
       "select l.p_partkey, tk.rid, tk.score, tk.rank::int as rank from l join tk on l.w = tk.lw and l.b = tk.lb where rank <= 5")
def fuzzy_topk_blocked(t):
    return matching.fuzzy_topk(names(t), names(t, "rid"), "p_partkey", "rid", block="brand")


SUBJECT_SQL = """
with l as (select p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) as w, list_value(1970 + p_size) as y from part),
 r as (select p_partkey as rid, list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) as w, 1970 + p_size % 20 as y from part),
 ls as (select distinct w, y from l), rs as (select w, y, list_sort(list(rid))[1:8] as ids from r group by 1, 2),
 pr as (select ls.w as lw, ls.y as ly, rs.ids, len(list_intersect(ls.w, rs.w)) as n, len(ls.w) as s, length(list_intersect(ls.w, rs.w)[1]) as ol,
   len(list_filter(rs.w, lambda x: not list_contains(ls.w, x) and x not in ('economy', 'small'))) as extra, list_contains(ls.y, rs.y) as ym from ls, rs),
 v as (select *, case when n = 0 then 0.0 when n = s and s = 1 then case when extra = 0 then 0.79 when ol >= 7 then 0.42 else 0.0 end when n = s then least(1.0, 0.72 + 0.07 * s)
   when n >= 2 then least(0.88, 0.30 + 0.45 * (n / s) + 0.05 * n) when ol >= 7 then 0.42 else 0.0 end as v from pr),
 sc as (select lw, ly, ids, round(greatest(0.0, least(1.0, v + case when ym then 0.10 else -0.10 end)), 4) as score from v where v > 0),
 ex as (select lw, ly, score, unnest(ids) as rid from sc where score > 0), tk as (select *, row_number() over (partition by lw, ly order by score desc, rid) as rank from ex)
select l.p_partkey, tk.rid, tk.score::double as score, tk.rank::int as rank from l join tk on l.w = tk.lw and l.y = tk.ly where rank <= 8"""


@query("fuzzy_subject_match", SUBJECT_SQL)
def fuzzy_subject_match(t):
    left = t.part.select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("words"), F.array(F.col("p_size") + 1970).alias("years"))
    right = t.part.select(F.col("p_partkey").alias("rid"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("words"), F.array(F.col("p_size") % 20 + 1970).alias("years"))
    generic = ("economy", "small")
    right = right.withColumn("specific", F.size(F.filter("words", lambda w: ~w.isin(*generic))))
    return matching.top_matches(left, right, "p_partkey", "rid", "words", matching.subject_score(generic), 8, ["specific"], ["years"], right_columns=["years"], bonus="years")


def composite(t):
    left = t.part.select("p_partkey", F.split("p_name", " ").alias("ordered"), F.col("p_name").alias("text"))
    left = left.select("p_partkey", F.array_distinct("ordered").alias("words"), "text", F.slice("ordered", 1, 2).alias("core"))
    name = F.concat_ws(" ", "p_name", F.lower("p_type"))
    right = t.part.select(F.col("p_partkey").alias("rid"), F.array_distinct(F.split(name, " ")).alias("words"), name.alias("text"), F.col("p_size").alias("year"))
    year = F.col("r_year")
    score = matching.composite_score(adjust=lambda s: matching.adjust_composite(s, s >= 0.7, year < 10, year > 40))
    return matching.top_matches(left, right, "p_partkey", "rid", "words", score, 5, [], ["text", "core"], bound=matching.adjusted_bound, right_columns=["text", "year"])


COMPOSITE_SQL = """
with l as (select p_name as a, list_distinct(string_split(p_name, ' ')) as lw, string_split(p_name, ' ')[1:2] as core from part group by 1, 2, 3),
 r as (select p_name || ' ' || lower(p_type) as b, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) as rw, p_size as y, list_sort(list(p_partkey))[1:5] as ids from part group by 1, 2, 3),
 p as (select *, len(list_intersect(lw, rw)) as n from l, r where list_has_any(lw, rw)),
 s as (select a, ids, y, round(0.35 * n / len(lw) + 0.25 * n / (len(lw) + len(rw) - n) + 0.20 * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1)) + 0.20 * len(list_filter(core, lambda x: list_contains(rw, x))) / greatest(len(core), 1), 4) as s from p),
 j as (select a, ids, round(greatest(0.0, least(1.0, s + case when y < 10 and s >= 0.7 then 0.12 else 0.0 end - case when y > 40 then 0.08 else 0.0 end)), 4) as score from s),
 e as (select a, score, unnest(ids) as rid from j where score > 0), t as (select *, row_number() over (partition by a order by score desc, rid) as rank from e qualify rank <= 5),
 m as (select p_partkey, rank, rid, score from part join t on t.a = p_name)
"""


@query("composite_scored_match", COMPOSITE_SQL + "select p_partkey, rank::int as rank, rid, score from m")
def composite_scored_match(t):
    """Top-5 by the composite name score, ranked after the context bonus and the late-release penalty."""
    return composite(t)


@query("top_margin_bands", COMPOSITE_SQL + """, f as (select p_partkey, score, count(*) as n, min(rid) as id from m group by 1, 2), g as (select *, row_number() over (partition by p_partkey order by score desc) as rn from f),
 h as (select p_partkey, max(case when rn = 1 then id end) as top_id, max(case when rn = 1 then score end) as top_score, max(case when rn = 1 then n end) as tie_count, max(case when rn = 2 then score end) as s2 from g group by 1),
 i as (select *, case when tie_count > 1 then top_score else coalesce(s2, 0.0) end as second_score from h), k as (select *, round(top_score - second_score, 4) as margin from i)
select p_partkey, top_id, top_score, second_score, margin, tie_count, case when tie_count >= 4 then 'high' when tie_count >= 2 then 'medium' else 'low' end as ambiguity, case when top_score >= 0.86 and margin >= 0.10 then 'strong_candidate' when top_score >= 0.76 and margin >= 0.05 then 'review_candidate' else 'unresolved' end as band from k""")
def top_margin_bands(t):
    """Margin between first and second composite candidate and its band."""
    m = rank.top_margin(composite(t), ["p_partkey"], "score", "rid")
    return m.withColumn("band", matching.composite_band("top_score", "margin"))


MARGIN_SQL = """
with s as (select l_orderkey, l_discount * 10 as score, l_orderkey * 10 + l_linenumber as id from lineitem), f as (select l_orderkey, score, count(*) as n, min(id) as id from s group by 1, 2),
 r as (select *, row_number() over (partition by l_orderkey order by score desc) as rn from f),
 g as (select l_orderkey, max(case when rn = 1 then id end) as top_id, max(case when rn = 1 then score end) as top_score, max(case when rn = 1 then n end) as tie_count, max(case when rn = 2 then score end) as s2 from r group by 1),
 h as (select *, case when tie_count > 1 then top_score else coalesce(s2, 0.0) end as second_score from g)
select l_orderkey, top_id, round(top_score, 4) as top_score, round(second_score, 4) as second_score, round(top_score - second_score, 4) as margin, tie_count, case when tie_count >= 4 then 'high' when tie_count >= 2 then 'medium' else 'low' end as ambiguity from h"""


@query("top_margin", MARGIN_SQL)
def top_margin(t):
    s = t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rank.top_margin(s, ["l_orderkey"], "score", "id").withColumn("top_score", F.round("top_score", 4)).withColumn("second_score", F.round("second_score", 4))


PROMO_SQL = """
with c as (select l_orderkey, l_partkey as fig, max(round(l_quantity / 50, 2)) as score, min(l_linenumber) as ov, count_if(l_returnflag = 'R') as deco, case min(l_linestatus) when 'O' then true else case when min(l_linenumber) % 2 = 0 then false end end as ym from lineitem group by 1, 2),
 r as (select *, row_number() over (partition by l_orderkey order by score desc, fig) as rn, count(*) over (partition by l_orderkey, score) as ties from c),
 g as (select l_orderkey, max(case when rn = 1 then fig end) as fig, max(case when rn = 1 then score end) as s, max(case when rn = 1 then ties end) as ties, max(case when rn = 2 then score end) as s2, max(case when rn = 1 then ov end) as ov, max(case when rn = 1 then deco end) as deco, bool_and(case when rn = 1 then ym end) as ym from r group by 1),
 m as (select *, round(s - case when ties > 1 then s else coalesce(s2, 0.0) end, 4) as m from g),
 v as (select *, round(greatest(0.0, s * 60 + greatest(0.0, m) * 30 + case when ties >= 4 then -30 when ties >= 2 then -15 else 0 end + case when ov <= 1 and s < 0.90 then -10 else 0 end + case when ym then 20 when ym = false then -15 else 0 end
   + case when deco > 0 then 20 else 0 end + case when deco = 1 then 10 when deco > 1 then 5 else 0 end + case when m >= 0.10 then 10 else 0 end + case when s >= 0.90 then 10 else 0 end), 3) as ps from m)
select l_orderkey, fig as top_figure, s as top_score, m as margin, ties as tie_count, ps as promotion_score, case when ps >= 100 then 'verify_first' when ps >= 75 then 'strong_review' when ps >= 50 then 'medium_review' else 'low_review' end as review_band from v"""


@query("promotion_rank", PROMO_SQL)
def promotion_rank(t):
    ym = F.when(F.min("l_linestatus") == "O", F.lit(True)).when(F.min("l_linenumber") % 2 == 0, F.lit(False))
    c = t.lineitem.groupBy("l_orderkey", F.col("l_partkey").alias("fig")).agg(
        F.max(F.round(F.col("l_quantity") / 50, 2)).alias("score"), F.min("l_linenumber").alias("ov"), F.count_if(F.col("l_returnflag") == "R").alias("deco"), ym.alias("ym"))
    return queues.promotion_rank(c, "l_orderkey", "fig", "score", "ov", "deco", "ym")


@query("collision_class", """
with e as (select distinct p_brand, p_size, p_name from part), o as (select p_brand, p_size, string_split(min(p_name), ' ') as w, bool_or(contains(p_name, 'small')) as joined from part group by 1, 2),
 s as (select p_brand, p_size, joined, count(*) as catalog_entries, count_if(list_has_any(string_split(p_name, ' '), w)) as sup from o join e using (p_brand, p_size) group by 1, 2, 3)
select p_brand, p_size, catalog_entries, sup as supportive_entries, case when joined and sup >= 2 then 'shared_package_code_multiple_figures' when sup = 1 then 'one_catalog_entry_matches_user_identity_other_collision_needs_review' when sup >= 2 then 'multiple_catalog_entries_support_user_label' else 'true_or_unresolved_catalog_collision' end as structural_class from s""")
def collision_class(t):
    observed = t.part.groupBy("p_brand", "p_size").agg(F.split(F.min("p_name"), " ").alias("words"), F.bool_or(F.contains("p_name", F.lit("small"))).alias("joined"))
    entries = t.part.select("p_brand", "p_size", F.split("p_name", " ").alias("entry_words"))
    return group.collision_class(observed, entries, ["p_brand", "p_size"]).drop("collision_class")


@query("counterpart_class", """
with c as (select p_partkey, string_split(p_name, ' ') as base, case when p_size % 4 = 0 then string_split(p_name, ' ') || [lower(p_type)] else [split_part(p_name, ' ', 2), lower(p_type)] end as nm, case when p_size % 3 = 0 then [] else [p_brand] end as suf,
  round(p_size / 50, 4) as s, round(p_partkey % 20 / 100, 4) as m, 2000 + p_size as y from part), d as (select *, len(list_intersect(list_distinct(base), nm)) = len(list_distinct(base)) as same from c),
 e as (select *, case when same and s >= 0.86 and m >= 0.10 then 'strong_character_counterpart' when same and s >= 0.76 and m >= 0.05 then 'review_character_counterpart' else 'unresolved_character_counterpart' end as cs, case when y < 2022 then 'predates' when y > 2022 then 'postdates' else 'same_year' end as tr from d)
select p_partkey, cs as counterpart_status, tr as temporal_relation, case when cs like 'strong%' and len(suf) = 0 then 'character_match_only_version_unresolved' when cs not like 'unres%' and len(suf) > 0 then 'variant_suffix_requires_version_resolution' else 'unresolved' end as exact_version_status,
 case when cs like 'unres%' then 'unresolved' when tr = 'postdates' then 'same_character_later_physical_release_not_source_equivalent' else 'physical_counterpart_candidate_version_visual_pending' end as source_equivalence_status from e""")
def counterpart_class(t):
    base, kind = F.split("p_name", " "), F.lower("p_type")
    nm = F.when(F.col("p_size") % 4 == 0, F.array_append(base, kind)).otherwise(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), kind))
    rows = t.part.select("p_partkey", base.alias("base"), nm.alias("nm"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("suf"),
                         F.round(F.col("p_size") / 50, 4).alias("top_score"), F.round(F.col("p_partkey") % 20 / 100, 4).alias("margin"), F.array(F.col("p_size") + 2000).alias("years"))
    return queues.counterpart_class(rows, "base", "nm", "suf", "years", 2022).select("p_partkey", "counterpart_status", "temporal_relation", "exact_version_status", "source_equivalence_status")


@query("caption_reconcile", """
with s as (select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_name || ' ' || lower(p_type) else lower(p_type) || ' ' || split_part(p_name, ' ', 2) || ' x' end as caption from part),
 c as (select case when p_size > 5 then p_partkey else -p_partkey - 1 end as p_partkey, p_name from part), j as (select s.p_partkey, caption, p_name as cur, string_split(caption, ' ') as a, string_split(coalesce(p_name, ''), ' ') as b from s left join c using (p_partkey)),
 k as (select *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as o from j),
 r as (select *, case when cur is null then 'missing_current_catalog_record' when caption = cur then 'same' when contains(caption, cur) or contains(cur, caption) then 'extends_or_shortens_name' when o >= 0.75 then 'minor_name_normalization' when o >= 0.45 then 'moderate_name_drift' else 'substantial_name_drift' end as relation from k)
select p_partkey, caption, cur as current_name, cur is not null as current_match, relation, case when relation = 'same' then 'none' when relation in ('missing_current_catalog_record', 'substantial_name_drift') then 'high' else 'medium' end as review_priority from r""")
def caption_reconcile(t):
    k, kind = F.col("p_partkey") % 3, F.lower("p_type")
    caption = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_name", kind)).otherwise(F.concat_ws(" ", kind, F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("x")))
    return queues.caption_reconcile(t.part.select("p_partkey", caption.alias("caption")), t.part.select(F.when(F.col("p_size") > 5, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1).alias("p_partkey"), "p_name"), "p_partkey", "caption", "p_name")
