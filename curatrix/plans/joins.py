"""Joins, overlays, gates and set comparison over the driver tables."""

from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import dedup, dq, group, joins
from curatrix.plans.registry import query


@query("star_join", """select distinct c_custkey, o_orderkey, year(o_orderdate)::int as order_year, l_partkey, p_brand
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey""")
def star_join(t):
    tasks = 1 + t.lineitem.count() // joins.TASK_ROWS
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_orderkey")
    fact = t.lineitem.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.star_join(fact, [(t.customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")), (t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))],
                           ["c_custkey", "o_orderkey", F.year("o_orderdate").alias("order_year"), "l_partkey", "p_brand"])


@query("left_enrich", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_type from lineitem left join part on p_partkey = case when l_returnflag = 'R' then -l_partkey else l_partkey end""")
def left_enrich(t):
    """Lines with their part; returned lines carry a key that no part has and stay without one."""
    key = F.when(F.col("l_returnflag") == "R", -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return joins.enrich(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("_k")), t.part.select("p_partkey", "p_name", "p_type"), F.col("_k") == F.col("p_partkey")).drop("p_partkey", "_k")


@query("orphans", "select o_orderkey, o_custkey from orders where o_custkey not in (select case when c_acctbal < 0 then -c_custkey else c_custkey end from customer)")
def orphans(t):
    """Orders of customers that are not registered under their key; those in debt are under another."""
    registry = t.customer.select(F.when(F.col("c_acctbal") < 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"))
    return joins.orphans(t.orders.select("o_orderkey", "o_custkey"), registry, F.col("o_custkey") == F.col("c_custkey"))


@query("covered", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def covered(t):
    return joins.covered(t.documents.select("doc_id", "lang"), t.labels.where("quality = 1"), "doc_id")


@query("exact_key_crosswalk", """
with e as (select s_suppkey, s_suppkey * 7 % 2500 as element_id from supplier),
 g as (select p_partkey as element_id, p_partkey as l_partkey, p_brand from part),
 u as (select l_partkey, count(*) as usage_count from lineitem group by 1),
 ru as (select l_partkey, string_agg(l_returnflag || ':' || n, ',' order by l_returnflag) as roles from (select l_partkey, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1),
 su as (select l_partkey, count(*) as users_count, array_to_string(list_sort(list(l_suppkey))[1:5], ',') as users from (select distinct l_partkey, l_suppkey from lineitem) group by 1)
select e.s_suppkey, e.element_id, g.p_brand, u.usage_count, ru.roles, su.users_count, su.users, case when g.l_partkey is null then 'element_not_found' else 'exact_element_match' end as match_status
from e left join g using (element_id) left join u on g.l_partkey = u.l_partkey left join ru on g.l_partkey = ru.l_partkey left join su on g.l_partkey = su.l_partkey""")
def exact_key_crosswalk(t):
    elements = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 7 % 2500).alias("element_id"))
    registry = t.part.select(F.col("p_partkey").alias("element_id"), F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = joins.exact_key_crosswalk(elements, registry, t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag"), "element_id", "l_partkey", "l_suppkey", "l_returnflag", 5)
    roles = F.array_join(F.transform("role_counts", lambda r: F.concat(r["value"], F.lit(":"), r["n"].cast("string"))), ",")
    return out.select("s_suppkey", "element_id", "p_brand", "usage_count", F.when(F.col("role_counts").isNotNull(), roles).alias("roles"), "users_count",
                      F.when(F.col("users").isNotNull(), F.array_join(F.col("users").cast("array<string>"), ",")).alias("users"), "match_status")


CODE_SQL = """
with rel as (select p_partkey, regexp_replace(upper(p_brand || '-' || p_type || '-' || (p_size + 1)), '[^A-Z0-9]+', '', 'g') as code, p_name from part),
 cat as (select regexp_replace(upper(p_brand || '-' || p_type || '-' || p_size), '[^A-Z0-9]+', '', 'g') as code, p_name || ' ' || lower(p_type) as cname from part),
 ent as (select code, cname, count(*) as n from cat group by 1, 2),
 prs as (select r.code, r.p_name, sum(n)::bigint as match_count, max(round(len(list_intersect(string_split(r.p_name, ' '), string_split(cname, ' '))) /
   len(list_distinct(list_concat(string_split(r.p_name, ' '), string_split(cname, ' ')))), 4)) as ov from (select distinct code, p_name from rel) r join ent using (code) group by 1, 2)
select rel.p_partkey, rel.code, rel.p_name, coalesce(match_count, 0) as match_count, ov as max_name_overlap,
 case when match_count = 1 then 'exact_unique_serial_match' when match_count > 1 then 'exact_serial_collision' else 'no_exact_serial_match' end as match_status,
 case when match_count is null then 'no_catalog_match' when ov >= 0.35 then 'name_supportive' else 'serial_match_name_needs_review' end as identity_consistency
from rel left join prs on rel.code = prs.code and rel.p_name = prs.p_name"""


def code_frame(t):
    code = lambda size: text.norm_code(F.concat_ws("-", "p_brand", "p_type", size.cast("string")))
    rel = t.part.select("p_partkey", code(F.col("p_size") + 1).alias("code"), "p_name")
    cat = t.part.select(code(F.col("p_size")).alias("code"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("cname"))
    return joins.code_crosswalk(rel, cat, "p_partkey", "code", "p_name", "cname")


@query("code_crosswalk", CODE_SQL)
def code_crosswalk(t):
    return code_frame(t)


@query("crosswalk_triage", f"""
with x as ({CODE_SQL}), b as (select regexp_replace(upper(p_brand || '-' || p_type || '-' || p_size), '[^A-Z0-9]+', '', 'g') as code, count(distinct p_retailprice > 1000) as brands from part group by 1),
 y as (select x.*, coalesce(b.brands, 0) as brands, match_status = 'exact_unique_serial_match' and identity_consistency = 'name_supportive' as prom from x left join b using (code)),
 k as (select *, case when match_status = 'exact_unique_serial_match' then 'unique_serial_name_review' when match_status = 'exact_serial_collision' and brands <= 1 and max_name_overlap >= 0.35 then 'same_brand_multi_record_one_name_supportive_possible_bundle'
   when match_status = 'exact_serial_collision' and brands <= 1 then 'same_brand_multi_record_bundle_or_reuse' when match_status = 'exact_serial_collision' then 'cross_brand_serial_collision' else 'no_current_herobloks_exact_match' end as rt from y)
select p_partkey, case when prom then 'promoted' else 'review' end as outcome, case when not prom then rt end as review_type,
 case when prom then null when rt in ('same_brand_multi_record_one_name_supportive_possible_bundle', 'cross_brand_serial_collision') then 'high'
  when rt in ('unique_serial_name_review', 'same_brand_multi_record_bundle_or_reuse') then 'medium' else 'low' end as review_priority from k""")
def crosswalk_triage(t):
    code = text.norm_code(F.concat_ws("-", "p_brand", "p_type", F.col("p_size").cast("string")))
    brands = t.part.groupBy(code.alias("code")).agg(F.count_distinct(F.col("p_retailprice") > 1000).alias("brands"))
    j = code_frame(t).join(brands, "code", "left")
    supportive = F.when(F.coalesce("max_name_overlap", F.lit(0.0)) >= 0.35, 1).otherwise(0)
    r = group.crosswalk_triage(F.col("match_status"), F.col("identity_consistency"), F.col("match_count"), F.coalesce("brands", F.lit(0)), supportive)
    return j.select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("cascading_catalogs", """
with r as (select p_partkey, p_partkey % 400 as code from part), a as (select s_suppkey * 2 - s_suppkey % 7 // 6 * 2 as code, count(*) as n from supplier group by 1),
 b as (select s_suppkey + s_suppkey % 3 as code, count(*) as n from supplier group by 1), c as (select c_custkey - c_custkey % 5 % 2 as code, count(*) as n from customer group by 1),
 j as (select r.*, coalesce(a.n, 0) as an, coalesce(b.n, 0) as bn, coalesce(c.n, 0) as cn from r left join a using (code) left join b using (code) left join c using (code)),
 s as (select *, case when an = 1 then 'exact_unique_serial_match' when an > 1 then 'exact_serial_collision' else 'no_exact_serial_match' end as primary_status,
  case when an = 0 and bn > 1 then 'historical_exact_serial_collision' when an = 0 and bn = 1 then 'historical_exact_unique_serial_match' else 'no_historical_exact_serial_match' end as fallback_status,
  case when an = 0 and bn = 0 and cn = 1 then 'manual_exact_verified' when an = 0 and bn = 0 and cn > 1 then 'manual_exact_collision' else 'no_manual_exact_verification' end as manual_status from j)
select p_partkey, primary_status, fallback_status, manual_status, case when an > 0 then primary_status when bn > 0 then fallback_status when cn > 0 then manual_status else 'no_exact_serial_match_any_catalog' end as effective_status,
 case when an = 0 and bn > 0 then 'second:' || bn else '' end as fallback_hits from s""")
def cascading_catalogs(t):
    rel = t.part.select("p_partkey", (F.col("p_partkey") % 400).alias("code"))
    cats = [("first", t.supplier.select(F.expr("s_suppkey * 2 - (s_suppkey % 7) div 6 * 2").alias("code"))), ("second", t.supplier.select((F.col("s_suppkey") + F.col("s_suppkey") % 3).alias("code")))]
    out = joins.cascading_catalogs(rel, cats, "code", t.customer.select(F.expr("c_custkey - c_custkey % 5 % 2").alias("code")))
    hits = F.array_join(F.transform("fallback_hits", lambda h: F.concat(h["catalog"], F.lit(":"), h["n"].cast("string"))), ",")
    return out.select("p_partkey", "primary_status", "fallback_status", "manual_status", "effective_status", hits.alias("fallback_hits"))


@query("overlay_corrections", """
with f as (select user_id, min(event_type) as expected, case when user_id % 2 = 0 then 'corrected' end as fix from events group by 1)
select event_id, case when ok and fix is null then null when ok then fix else event_type end as event_type, value, ok as corrected, case when ok then event_type end as original_type
from (select e.*, f.fix, f.user_id is not null and f.expected = e.event_type as ok from events e left join f using (user_id))""")
def overlay_corrections(t):
    fixes = t.events.groupBy("user_id").agg(F.min("event_type").alias("expected")).select(
        "user_id", "expected", F.when(F.col("user_id") % 2 == 0, "corrected").alias("fix_event_type"),
        F.when(F.col("user_id") % 2 == 1, F.array(F.lit("event_type"))).alias("clear_fields"))
    out = joins.overlay_corrections(t.events.select("event_id", "user_id", "event_type", "value"), fixes, ["user_id"], ["event_type"], "event_type")
    return out.select("event_id", "event_type", "value", "corrected", F.col("original.event_type").alias("original_type"))


@query("priority_resolution", """
with l as (select c_custkey, case when c_custkey % 3 = 0 then 'S' || c_custkey else 'C' || c_custkey end as lid, c_mktsegment || '-' || c_nationkey as lname from customer),
 r as (select s_suppkey, 'S' || s_suppkey as rid, case when s_suppkey % 2 = 0 then 'FURNITURE-' || s_nationkey else 'BUILDING-' || s_suppkey end as rname from supplier),
 e as (select 'C' || c_custkey as lid, 'S' || (c_custkey % 130) as v from customer union all select 'C' || c_custkey, 'S' || (c_custkey % 650) from customer),
 x as (select lid, min(v) as mv, max(v) as xv from e join r on e.v = r.rid group by 1), n as (select rname, min(rid) as rid from r group by 1 having count(*) = 1)
select l.c_custkey, coalesce(r.rid, case when x.mv = x.xv then x.mv end, n.rid) as match_id,
 case when r.rid is not null then 'exact_primary_id' when x.mv = x.xv then 'embedded_id' when n.rid is not null then 'unique_exact_name' else 'unmatched' end as match_method,
 case when r.rid is not null then 1.0 when x.mv = x.xv then 0.98 when n.rid is not null then 0.85 else 0.0 end::double as confidence
from l left join r on l.lid = r.rid left join x on l.lid = x.lid left join n on l.lname = n.rname""")
def priority_resolution(t):
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = t.customer.select("c_custkey", F.when(c % 3 == 0, key("S", c)).otherwise(key("C", c)).alias("lid"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("lname"))
    right = t.supplier.select(key("S", s).alias("rid"), F.when(s % 2 == 0, key("FURNITURE-", F.col("s_nationkey"))).otherwise(key("BUILDING-", s)).alias("rname"))
    embedded = t.customer.select(key("C", c).alias("lid"), F.explode(F.array(key("S", c % 130), key("S", c % 650))).alias("value"))
    return joins.priority_resolution(left, right, "lid", "rid", "lname", "rname", embedded).select("c_custkey", "match_id", "match_method", "confidence")


EXPAND_SQL = """
with cand as (select o_custkey, o_orderkey as fig, case when o_orderstatus = 'F' then 'head' else 'torso' end as role, round(o_totalprice / 500000, 4) as score from orders),
 comp as (select l_orderkey as fig, l_orderkey * 100 + l_linenumber as component_id, l_partkey, case when l_returnflag = 'R' then 'head' else 'torso' end as component_role, case when l_quantity > 25 then 'base' end as print_of from lineitem),
 roles as (select 'head' as role, 'head' as component_role union all select 'torso', 'torso' union all select 'torso', 'head'),
 geo as (select p_partkey as l_partkey from part where p_size <= 25),
 hop as (select o_custkey, component_id, l_partkey, print_of, max(score) as score, max_by(cand.fig, score * 1e9 + cand.fig) as fig from cand join roles using (role) join comp on comp.fig = cand.fig and comp.component_role = roles.component_role group by 1, 2, 3, 4),
 lk as (select hop.*, case when geo.l_partkey is null then 'no_geometry' when print_of is null then 'base_substrate_link' when score >= 0.9 then 'strict_print_link' else 'unverified_print_link' end as link_class,
   row_number() over (partition by o_custkey order by score desc, hop.l_partkey, component_id, print_of nulls first) as link_rank from hop left join geo on geo.l_partkey = hop.l_partkey)
"""


@query("expand_to_parts", EXPAND_SQL + """select o_custkey, component_id, l_partkey, score, fig, link_class, link_rank, link_rank <= 30 as in_part_list from lk""")
def expand_to_parts(t):
    return _expanded(t)


def _expanded(t, operator=joins.expand_to_parts):
    # SQL rounds the binary product (0.01945 gives 0.0194), ``round`` to four digits the decimal text
    cand = t.orders.select("o_custkey", F.col("o_orderkey").alias("fig"), F.when(F.col("o_orderstatus") == "F", "head").otherwise("torso").alias("role"), (F.round(F.col("o_totalprice") / 500000 * 10000) / 10000).alias("score"))
    comp = t.lineitem.select(F.col("l_orderkey").alias("fig"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("component_id"), "l_partkey",
                             F.when(F.col("l_returnflag") == "R", "head").otherwise("torso").alias("component_role"), F.when(F.col("l_quantity") > 25, "base").alias("print_of")).distinct()
    roles = t.spark.createDataFrame([("head", "head"), ("torso", "torso"), ("torso", "head")], "role string, component_role string")
    return operator(cand, comp, t.part.select(F.when(F.col("p_size") <= 25, F.col("p_partkey")).otherwise(-F.col("p_partkey")).alias("l_partkey")), "o_custkey", "fig", "l_partkey", "role", "component_role", "score", roles)


@query("geometry_links", EXPAND_SQL.rstrip() + """, ge as (select distinct case when p_size <= 25 then l_partkey end as l_partkey, 'asset-' || l_suppkey % 40 as asset_id from lineitem join part on p_partkey = l_partkey),
 x as (select o_custkey, component_id, l_partkey, score, fig, asset_id, unnest(case link_class when 'base_substrate_link' then ['base'] when 'strict_print_link' then ['raw', 'strict'] when 'unverified_print_link' then ['raw'] else [] end) as list from lk join ge using (l_partkey))
select o_custkey, list, component_id, l_partkey, asset_id, score, fig as entity from x qualify row_number() over (partition by o_custkey, list, component_id, asset_id order by score desc, fig desc, l_partkey desc) = 1""")
def geometry_links(t):
    """Base, raw and strict links of every customer's parts with all assets of the part."""
    assets = t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.when(F.col("p_size") <= 25, F.col("l_partkey")).alias("l_partkey"), F.concat(F.lit("asset-"), F.col("l_suppkey") % 40).alias("asset_id"))
    return joins.geometry_links(_expanded(t, joins.part_links).withColumnRenamed("fig", "entity"), assets, "o_custkey", "l_partkey", "asset_id")


@query("alias_retrieval", """
with tg as (select p_partkey, p_name as n1, p_type, lower(p_type) || ' ' || split_part(p_name, ' ', 2) as ident from part),
 rl as (select case when p_size <= 5 then p_name else lower(p_type) || ' ' || split_part(p_name, ' ', 2) || case when p_size > 10 then ' ' || p_size else '' end end as rn, p_brand as rt, count(*) as n from part group by 1, 2),
 pr as (select tg.p_partkey, n, 'Brand#' || length(tg.p_type) = rl.rt as same from tg join rl on rl.rn = tg.n1 or rl.rn = tg.ident),
 st as (select p_partkey, sum(n)::bigint as n, max(case when same then 2 else 1 end) as best from pr group by 1)
select tg.p_partkey, coalesce(n, 0) as release_candidate_count, case best when 2 then 'likely_existing_representation' when 1 then 'name_match_variant_unresolved' else 'no_exact_name_release_candidate' end as representation_status
from tg left join st using (p_partkey)""")
def alias_retrieval(t):
    noun, kind = F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type")
    targets = t.part.select("p_partkey", F.concat(F.lit("Brand#"), F.length("p_type").cast("string")).alias("variant"), text.alias_keys(text.norm_ascii("p_name"), ()).alias("name_keys"), text.alias_keys(text.norm_ascii(F.concat_ws(" ", kind, noun)), ()).alias("identity_keys"))
    name = F.when(F.col("p_size") <= 5, F.col("p_name")).otherwise(F.concat_ws(" ", kind, noun, F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))))
    releases = t.part.select(F.col("p_partkey").alias("rid"), F.col("p_brand").alias("release_variant"), text.alias_keys(text.norm_ascii(name), ()).alias("name_keys"))
    status = F.when((F.col("variant") == F.col("release_variant")) & (F.col("name_relation") != "retrieval_only"), "likely_existing_representation").otherwise("name_match_variant_unresolved")
    return joins.alias_retrieval(targets, releases, "p_partkey", "rid", status)


@query("id_lookup_with_name_check", """
with o as (select o_orderkey, o_custkey * 2 as k, string_split(lower(o_orderpriority), '-') as a from orders), c as (select c_custkey as k, string_split(lower(c_mktsegment) || '-' || (c_nationkey % 5 + 1) || case when c_custkey % 4 = 0 then '-high-2' else '' end, '-') as b from customer),
 j as (select o_orderkey, a, b, round(len(list_intersect(a, list_distinct(b))) / len(list_distinct(list_concat(a, b))), 4) as s from o left join c using (k))
select o_orderkey, case when b is not null then s end as name_overlap, case when b is null then 'id_not_found' when s >= 0.35 then 'id_match_name_supportive' when s < 0.15 then 'id_match_name_conflict' else 'id_match_name_review' end as resolution from j""")
def id_lookup(t):
    left = t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("k"), F.split(F.lower("o_orderpriority"), "-").alias("a"))
    label = F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_nationkey") % 5 + 1).cast("string"), F.when(F.col("c_custkey") % 4 == 0, "-high-2").otherwise(""))
    right = t.customer.select(F.col("c_custkey").alias("k"), F.array_distinct(F.split(label, "-")).alias("b"))
    return joins.id_lookup_with_name_check(left, right, "k", "a", "b").select("o_orderkey", "name_overlap", "resolution")


@query("refine_by_evidence", """select o_orderkey, evidence_status, case evidence_status when 'verified' then 'actionable' when 'conflict' then 'review' else 'backlog' end as route
from orders left join (select l_orderkey as o_orderkey, case when count(distinct l_returnflag) = 1 then 'verified' when count(distinct l_returnflag) = 3 then 'conflict' else 'partial' end as evidence_status from lineitem group by 1) using (o_orderkey)""")
def refine_by_evidence(t):
    n = F.count_distinct("l_returnflag")
    ev = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(n == 1, "verified").when(n == 3, "conflict").otherwise("partial").alias("evidence_status"))
    return joins.refine_by_evidence(t.orders.select("o_orderkey"), ev, "o_orderkey", {"verified": "actionable", "conflict": "review"}, "backlog")


@query("alias_fallback", """
with c as (select c_custkey, c_mktsegment || c_nationkey as name, case when c_custkey % 5 < 2 then null else c_acctbal end as v from customer),
 d as (select name, arg_min(v, case when c_custkey % 2 = 0 then c_custkey else c_custkey + 10000000 end) as dv, arg_min(c_custkey, case when c_custkey % 2 = 0 then c_custkey else c_custkey + 10000000 end) as did from c where v is not null group by 1)
select c_custkey, coalesce(v, dv) as v, case when v is null and dv is not null then did end as borrowed_from, case when v is not null then 'direct_pair' when dv is not null then 'alias_fallback' else 'missing' end as resolution from c left join d using (name)""")
def alias_fallback(t):
    c = t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 5 >= 2, F.col("c_acctbal")).alias("v"))
    return joins.alias_fallback(c, "c_custkey", "name", "v", F.col("c_custkey") % 2 == 0).select("c_custkey", "v", "borrowed_from", "resolution")


@query("hash_gate", """
with q as (select doc_id, sha256(text) as h from documents), c as (select case when n_chars >= 300 then doc_id else -doc_id - 1 end as doc_id, case when doc_id % 13 = 0 then 'other' else sha256(text) end as h from documents),
 r as (select doc_id, case when doc_id % 17 = 0 then 'stale' else sha256(text) end as h, case when quality = 1 then 'approved' else 'rejected' end as decision, toxic = 0 as ok from labels join documents using (doc_id)),
 g as (select doc_id, count(*) as n, min(decision) as d0, max(decision) as d1, bool_and(ok) as ok, min(h) as h0, max(h) as h1 from r group by 1),
 j as (select q.doc_id, coalesce(n, 0) as review_count, case when c.h is null then 'candidate_missing' when c.h <> q.h then 'candidate_digest_mismatch' when n is null then 'review_missing'
   when h0 <> c.h or h1 <> c.h then 'review_digest_mismatch' when d0 <> d1 then 'review_decisions_conflict' when d0 <> 'approved' then 'review_not_approved' when not ok then 'review_checks_incomplete' end as blocked_reason from q left join c using (doc_id) left join g using (doc_id))
select doc_id, review_count, blocked_reason, blocked_reason is null as admitted from j""")
def hash_gate(t):
    h = F.sha2("text", 256)
    q = t.documents.select("doc_id", h.alias("digest"))
    c = t.documents.select(F.when(F.col("n_chars") >= 300, F.col("doc_id")).otherwise(-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise(h).alias("digest"))
    r = t.labels.join(t.documents.select("doc_id", h.alias("_h")), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 17 == 0, "stale").otherwise(F.col("_h")).alias("digest"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"),
        F.create_map(F.lit("clean"), F.col("toxic") == 0).alias("checks"))
    return joins.hash_gate(q, c, r, "doc_id", ["digest"]).drop("digest")


@query("overlay_documents", """select p_partkey, case when p_size > 40 then sha256('v2|' || p_name) else sha256(p_name) end as digest, case when p_size > 40 then 'supplement' else 'base' end as origin from part union all select -p_partkey - 1, sha256('v2|' || p_name), 'supplement' from part where p_size <= 40""")
def overlay_documents(t):
    base = t.part.select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    new = t.part.select(F.when(F.col("p_size") > 40, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1).alias("p_partkey"), F.sha2(F.concat(F.lit("v2|"), "p_name"), 256).alias("digest"))
    return joins.overlay_documents(base, new.unionAll(new), ["p_partkey"], "digest")


@query("set_drift", """
with a as (select case when p_brand = 'Brand#3' then -p_partkey else p_partkey end as p_partkey, p_name, p_size from part), b as (select case when p_brand = 'Brand#4' then -p_partkey else p_partkey end as p_partkey, case when p_partkey % 4 = 1 then p_name || '!' else p_name end as p_name, case when p_partkey % 6 = 1 then null else p_size end as p_size from part)
select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when b.p_partkey is null then 'missing_right' when a.p_partkey is null then 'extra_right' when a.p_name <> b.p_name or b.p_size is null then 'changed' else 'equal' end as drift_status,
 case when a.p_partkey is null or b.p_partkey is null then '' else concat_ws(',', case when a.p_name <> b.p_name then 'p_name' end, case when b.p_size is null then 'p_size' end) end as changed_fields
from a full join b on a.p_partkey = b.p_partkey""")
def set_drift(t):
    key = lambda brand: F.when(F.col("p_brand") == brand, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("p_partkey")
    a = t.part.select(key("Brand#3"), "p_name", "p_size")
    b = t.part.select(key("Brand#4"), F.when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"),
                                                   F.when(F.col("p_partkey") % 6 != 1, F.col("p_size")).alias("p_size"))
    return joins.drift(a, b, ["p_partkey"], ["p_name", "p_size"]).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query("propagate_by_signature", """
with s as (select l_orderkey, string_agg(flag, '|' order by flag) as signature from (select distinct l_orderkey, l_returnflag || l_linestatus || (l_quantity > 25) as flag from lineitem) group by 1),
 r as (select s.*, case when o_orderkey % 20 = 0 then o_orderstatus end as label from s join orders on l_orderkey = o_orderkey),
 v as (select signature, min(label) as lo, max(label) as hi, count(label) as n, count(*) as m from r group by 1)
select l_orderkey, signature, m as signature_members, n as reviewed_members, case when label is not null then 'reviewed' when n = 0 then 'signature_unreviewed' when lo = hi then 'propagated_candidate' else 'conflicting_reviews' end as propagation_status,
 case when label is not null then label when n > 0 and lo = hi then lo end as propagated_label from r join v using (signature)""")
def propagate_by_signature(t):
    flag = F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).cast("string"))
    sig = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(flag)), "|").alias("signature"))
    labelled = sig.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderstatus")).alias("label")), "l_orderkey")
    return joins.propagate_by_signature(labelled, "signature", "label", "l_orderkey")


@query("resolve_references", """
with r as (select l_orderkey, list(l_partkey order by l_partkey) as refs from (select distinct l_orderkey, l_partkey from lineitem) group by 1)
select l_orderkey, array_to_string(list_transform(refs, lambda k: k || '@' || (900 + k * 0 )::varchar), ',') as locators from r""")
def resolve_references(t):
    refs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    registry = t.part.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("@900")).alias("loc"))
    return joins.resolve_references(refs, registry, "l_orderkey", "refs", "p_partkey", "loc").select("l_orderkey", F.array_join("locators", ",").alias("locators"))


@query("expected_vs_auto", """select doc_id, case when quality is null then null when quality = 1 and toxic = 0 then 'good' when toxic = 1 then 'toxic' end as expected_class,
 case when quality is null or not (quality = 1 and toxic = 0 or toxic = 1) then 'manual_label_not_mapped' when n_chars < 200 then 'missing_auto_class' when (case when toxic = 1 then 'toxic' else 'good' end) = (case when n_chars % 3 = 0 then 'toxic' else 'good' end) then 'agreement'
  when n_chars % 2 = 0 then 'high_confidence_conflict' else 'difference' end as audit_status from documents left join labels using (doc_id)""")
def expected_vs_auto(t):
    manual = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "fine").when(F.col("quality") == 0, "weak")
    auto = F.when(F.col("n_chars") >= 200, F.when(F.col("n_chars") % 3 == 0, "toxic").otherwise("good"))
    j = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select("doc_id", manual.alias("manual"), auto.alias("auto"), F.when(F.col("n_chars") % 2 == 0, 0.99).otherwise(0.9).alias("conf"))
    return joins.expected_vs_auto(j, "manual", "auto", "conf", {"fine": "good", "bad": "toxic"}).select("doc_id", "expected_class", "audit_status")


@query("union_sources", """select c_name as name, c_nationkey as nation, c_mktsegment as segment, 'customers' as source_file from customer union all select s_name, s_nationkey, null, 'suppliers' from supplier""")
def union_sources(t):
    return dedup.union_sources({
        "customers": t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
        "suppliers": t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), "generated": t.supplier.select(F.col("s_name").alias("name"))}, ("generated",))


@query("key_comparison", """select coalesce(a.k, b.k) as k, case when b.k is null then 'missing' when a.k is null then 'extra' else 'overlap' end as side from (select distinct p_partkey as k from part) a full join (select distinct l_suppkey * 30 as k from lineitem) b on a.k = b.k""")
def key_comparison(t):
    return dedup.key_comparison(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.select((F.col("l_suppkey") * 30).alias("k")), "k")


@query("exact_dedup", """select event_type, user_id, event_id, value from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as rn from events) where rn = 1""")
def exact_dedup(t):
    return dedup.exact_dedup(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [-F.col("value"), "event_id"])


@query("dedup_or_fail", "select distinct sha256(text) as digest, length(text) as size from documents")
def dedup_or_fail(t):
    return dq.dedup_or_fail(t.documents.select(F.sha2("text", 256).alias("digest"), F.length("text").alias("size")), ["digest"])


@query("content_address", """select sha256(text) as digest, min(doc_id) as first_id, count(*) as occurrences, max(octet_length(encode(text)))::int as bytes from documents group by 1""")
def content_address(t):
    return dedup.content_address(t.documents.select("doc_id", "text"), "doc_id", "text")[0]


@query("upsert", """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1""")
def upsert(t):
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return dedup.upsert(rows.where("value < 10"), rows.where("value >= 10"), ["user_id"], "event_id")


@query("integrity_counts", """
select 'orders' as table_name, 'rows' as check_name, count(*) as value from orders union all select 'customer', 'rows', count(*) from customer union all select 'lineitem', 'rows', count(*) from lineitem
union all select 'orders', 'duplicate_keys', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'customer', 'duplicate_keys', count(*) from (select c_custkey from customer group by 1 having count(*) > 1)
union all select 'lineitem', 'duplicate_keys', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)
union all select 'lineitem', 'orphan_l_orderkey', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'orders', 'orphan_o_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer)""")
def integrity_counts(t):
    return dq.integrity_counts({"orders": t.orders, "customer": t.customer, "lineitem": t.lineitem}, {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]},
                               [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")], ["orders", "lineitem"])


@query("summary", "select count(*) as records, count_if(o_orderstatus = 'F') as finished, count_if(o_totalprice > 300000) as large, count(distinct o_custkey) as distinct_o_custkey from orders")
def summary(t):
    return dq.summary(t.orders, {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 300000}, ["o_custkey"])
