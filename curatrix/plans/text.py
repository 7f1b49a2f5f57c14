"""Scalar functions over the driver tables."""

from pyspark.sql import functions as F

from curatrix.functions import ids, rules, text
from curatrix.functions.reference import with_reference
from curatrix.operators import pages as P
from curatrix.plans.registry import query

STOP = ("the", "and", "red", "blue")

@query("norm_text", "select doc_id, trim(regexp_replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '&', ' and '),"
       " '[^a-z0-9]+', ' ', 'g')) as normalized from documents")
def norm_text(t):
    return t.documents.select("doc_id", text.norm_text("text").alias("normalized"))


@query("norm_code", "select p_partkey, regexp_replace(upper(p_brand || '-' || p_type), '[^A-Z0-9]+', '', 'g') as code from part")
def norm_code(t):
    return t.part.select("p_partkey", text.norm_code(F.concat("p_brand", F.lit("-"), "p_type")).alias("code"))


@query("slug", "select p_partkey, trim(left(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 14), '-') as slug from part")
def slug(t):
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" "), "p_brand"), 14).alias("slug"))


@query("tokens", "select p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')),"
       " lambda w: length(w) >= 2 and not list_contains(['the','and','red','blue'], w))), ' ') as words from part")
def tokens(t):
    words = text.tokens(F.concat("p_name", F.lit(" "), "p_type"), STOP)
    return t.part.select("p_partkey", F.array_join(F.array_sort(words), " ").alias("words"))


@query("split_camel", "select c_custkey, regexp_replace(regexp_replace(regexp_replace(replace(c_name, '#', '') || c_mktsegment, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),"
       " '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') as label from customer")
def split_camel(t):
    return t.customer.select("c_custkey", text.split_camel(F.concat(F.replace("c_name", F.lit("#"), F.lit("")), "c_mktsegment")).alias("label"))


@query("semantic_tokens", """
with w as (select p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '([A-Za-z])([0-9])', '\\1 \\2', 'g'),
  '([0-9])([A-Za-z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) as s from part)
select p_partkey, s as words from w""")
def semantic_tokens(t):
    words = text.semantic_tokens(F.concat("p_name", F.lit(" "), "p_brand"))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("words"))


ALIAS_SQL = """
with n as (select p_partkey, trim(regexp_replace(lower(p_name || ' ' || case p_size % 3 when 0 then 'ii' when 1 then '3' else p_brand end),
  '[^a-z0-9]+', ' ', 'g')) as name from part),
w as (select p_partkey, name, string_split(name, ' ') as ws from n),
k as (select p_partkey, list_distinct([name,
  array_to_string(list_transform(ws, lambda x, i: case when i > 1 and x = 'ii' then '2' when i > 1 and x = 'iii' then '3' when i > 1 and x = 'iv' then '4' else x end), ' '),
  array_to_string(list_transform(ws, lambda x, i: case when i > 1 and x = '2' then 'ii' when i > 1 and x = '3' then 'iii' when i > 1 and x = '4' then 'iv' else x end), ' ')]) as ks from w)
select p_partkey, array_to_string(list_sort(ks), '|') as keys from k"""


@query("alias_keys", ALIAS_SQL)
def alias_keys(t):
    suffix = F.when(F.col("p_size") % 3 == 0, "ii").when(F.col("p_size") % 3 == 1, "3").otherwise(F.col("p_brand"))
    name = text.norm_ascii(F.concat("p_name", F.lit(" "), suffix))
    return t.part.select("p_partkey", F.array_join(text.alias_keys(name), "|").alias("keys"))


@query("code_prefix", """select c_custkey, nullif(upper(regexp_extract(trim(c), '^([A-Za-z]+)', 1)), '') as prefix,
  regexp_matches(trim(c), '^[A-Za-z]{1,10}[-_]?[0-9]+[A-Za-z0-9_-]*$') as maker_code
from (select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment || '-' || c_custkey else c_name end as c from customer)""")
def code_prefix(t):
    code = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", text.code_prefix(code).alias("prefix"), text.is_maker_code(code).alias("maker_code"))


@query("external_id", """select page_id, lower(coalesce(case when page_id % 4 = 0 then 'ID-' || page_id end,
  nullif(trim(regexp_extract(url, '(?i)[?&]ref=([^&#]+)', 1)), ''))) as external_id from pages""")
def external_id(t):
    direct = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ID-"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", text.external_id(direct, "url", "ref").alias("external_id"))


@query("years_in", """select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\b((?:19|20)[0-9]{2})\\b', 1),
  lambda y: y::int), lambda y: y between 1970 and 2035))), ',') as years,
  regexp_matches(trim(source), '^(?:18|19|20)[0-9]{2}$') as source_year_like,
  regexp_matches(n_chars::varchar, '^[0-9]{2,6}$') as size_numeric_like from documents""")
def years_in(t):
    return t.documents.select(
        "doc_id", F.array_join(text.years_in("text"), ",").alias("years"), text.year_like("source").alias("source_year_like"),
        text.numeric_like("n_chars").alias("size_numeric_like"))


@query("release_years", """select o_orderkey, year(o_orderdate)::int as first_year, case when o_orderkey % 2 = 0 then 2005 else year(o_orderdate)::int end as last_year from orders""")
def release_years(t):
    y = F.year("o_orderdate").cast("string")
    label = F.concat(F.lit("Years  Released: "), y, F.when(F.col("o_orderkey") % 2 == 0, " - 2005").otherwise(""))
    r = text.release_years(label)
    return t.orders.select("o_orderkey", r["start"].alias("first_year"), r["end"].alias("last_year"))


@query("stable_id", """select o_orderkey, 'order-' || left(sha256(to_json(['order', o_orderkey::varchar, o_orderpriority, o_orderstatus])), 24) as stable_id from orders""")
def stable_id(t):
    return t.orders.select("o_orderkey", ids.stable_id("order", "o_orderkey", "o_orderpriority", "o_orderstatus").alias("stable_id"))


@query("canonical_digest", """select event_id, sha256('{"event_type":"' || event_type || '","missing":null,"user":' || user_id || ',"value":"' ||
  printf('%.2f', value) || '"}') as digest from events""")
def canonical_digest(t):
    fields = {"user": F.col("user_id"), "event_type": F.col("event_type"), "missing": F.lit(None).cast("string"), "value": F.format_string("%.2f", "value")}
    return t.events.select("event_id", ids.canonical_digest(fields).alias("digest"))


@query("parse_structured_reference", """
with r as (select o_orderkey, lower(replace(o_orderpriority, '-', ' ')) as p, o_orderkey % 7 as k, year(o_orderdate)::int as y, (o_custkey % 90 + 1)::varchar as n from orders),
 w as (select *, trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) as work from r)
select o_orderkey,
  case k when 0 then 'comic_issue_explicit' when 1 then 'comic_issue_explicit' when 2 then 'episode_explicit' when 3 then 'dated_work'
    when 4 then 'episode_number_without_work' when 5 then 'year_only' else 'raw_only' end as kind,
  case when k in (5, 3) then y end as year_hint,
  case k when 0 then work || '|v3|regular|i' || n when 1 then work || '|v?|annual|i' || n when 2 then 'episode|' || work || '|s2|e' || n end as canonical_key
from w""")
def structured_reference(t):
    name, n, k = F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))), (F.col("o_custkey") % 90 + 1).cast("string"), F.col("o_orderkey") % 7
    y = F.year("o_orderdate").cast("string")
    raw = (
        F.when(k == 0, F.concat(name, F.lit(" Vol. 3 #"), n)).when(k == 1, F.concat(name, F.lit("  Annual #"), n))
        .when(k == 2, F.concat(name, F.lit(" Season 2 Episode "), n)).when(k == 3, F.concat(name, F.lit(" ("), y, F.lit(")")))
        .when(k == 4, F.concat(F.lit("Episode "), n)).when(k == 5, y).otherwise(name))
    r = with_reference(t.orders.select("o_orderkey", raw.alias("raw")), "raw", "r")
    return r.select("o_orderkey", F.col("r.kind").alias("kind"), F.col("r.year_hint").alias("year_hint"), F.col("r.canonical_key").alias("canonical_key"))


@query("parse_identity_key", """
with k as (select p_partkey, p_type || '_' || replace(p_name, ' ', '_') as raw from part)
select p_partkey, case when raw = 'SMALL_red_bolt' then 'SMALL_red' else split_part(raw, '_', 1) end as base,
  case when raw = 'SMALL_red_bolt' then 'Small red bolt' end as label,
  case when raw = 'SMALL_red_bolt' then '' else array_to_string(string_split(raw, '_')[2:], ',') end as suffix,
  case when raw = 'SMALL_red_bolt' then 'audited_full_identity_override' else 'underscore_variant_default' end as mode from k""")
def identity_key(t):
    raw = F.concat("p_type", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    r = t.part.select("p_partkey", text.parse_identity_key(raw, {"SMALL_red_bolt": {"base": "SMALL_red", "label": "Small red bolt"}}).alias("r"))
    return r.select("p_partkey", "r.base", "r.label", F.array_join("r.suffix", ",").alias("suffix"), "r.mode")


@query("subject_from_path", """
with p as (select page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages)
select page_id, case when len(parts) < 3 then coalesce(parts[-1], '') else parts[-2] end as subject from p""")
def subject_from_path(t):
    return t.pages.select("page_id", text.subject_from_path(P.url_path("url")).alias("subject"))


@query("catalog_href", """
with p as (select page_id, list_filter(string_split('/figures' || regexp_extract(replace(url, '/fr/', '/'), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages)
select page_id, case when regexp_matches(coalesce(parts[2], ''), '^[0-9]+$') then parts[2]::bigint end as catalog_id,
  case when regexp_matches(coalesce(parts[2], ''), '^[0-9]+$') then parts[3] end as brand_slug from p""")
def catalog_href(t):
    href = F.concat(F.lit("/figures"), P.url_path(F.replace("url", F.lit("/fr/"), F.lit("/"))))
    r = t.pages.select("page_id", text.catalog_href(href, F.lit("x")).alias("r"))
    return r.select("page_id", "r.catalog_id", "r.brand_slug")


@query("clean_title", """select page_id, nullif(trim(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\\s+', ' ', 'g'), ' :-'), '') as name from pages""")
def clean_title(t):
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    ident = F.concat(F.lit("sw"), F.col("page_id").cast("string"))
    titled = F.concat(raw, F.lit(" : Minifigure SW"), F.col("page_id").cast("string"), F.lit(" | BrickLink"))
    return t.pages.select("page_id", text.clean_title(titled, ident).alias("name"))


ROLE_RULES = (("headgear", ("ring", "bolt")), ("torso", ("widget",)), ("arm", ("gear", "screw")), ("leg", ("red",)))


@query("classify_ladder", """select p_partkey, case when contains(lower(p_name), 'ring') or contains(lower(p_name), 'bolt') then 'headgear'
  when contains(lower(p_name), 'widget') then 'torso' when contains(lower(p_name), 'gear') or contains(lower(p_name), 'screw') then 'arm'
  when contains(lower(p_name), 'red') then 'leg' else 'other' end as role from part""")
def classify_ladder(t):
    return t.part.select("p_partkey", rules.classify_ladder("p_name", ROLE_RULES).alias("role"))


@query("era_bucket", """select o_orderkey, case when y is null or y = 0 then 'unknown' when y <= 1988 then '1978-1988' when y <= 1998 then '1989-1998'
  when y <= 2009 then '1999-2009' when y <= 2019 then '2010-2019' else '2020-present' end as era from (select o_orderkey,
  case when o_orderkey % 10 = 0 then null when o_orderkey % 10 = 1 then year(o_orderdate) - 12 when o_orderkey % 10 = 2 then year(o_orderdate) + 15
  when o_orderkey % 10 = 3 then year(o_orderdate) + 25 else year(o_orderdate) end as y from orders)""")
def era_bucket(t):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 10
    shifted = F.when(k == 0, F.lit(None)).when(k == 1, y - 12).when(k == 2, y + 15).when(k == 3, y + 25).otherwise(y)
    return t.orders.select("o_orderkey", rules.era_bucket(shifted).alias("era"))


DOC_TAGS = {"smile": ("the ", "smil"), "grin": ("tion", "grin"), "angry": ("und ", "angry"), "scared": ("http",), "open_mouth": ("license", "copyright")}
TAG_SQL = ("list_filter([case when contains(lower(text), 'the ') or contains(lower(text), 'smil') then 'smile' end,"
           " case when contains(lower(text), 'tion') or contains(lower(text), 'grin') then 'grin' end,"
           " case when contains(lower(text), 'und ') or contains(lower(text), 'angry') then 'angry' end,"
           " case when contains(lower(text), 'http') then 'scared' end,"
           " case when contains(lower(text), 'license') or contains(lower(text), 'copyright') then 'open_mouth' end], lambda x: x is not null)")


@query("keyword_tags", f"select doc_id, array_to_string({TAG_SQL}, ',') as tags from documents")
def keyword_tags(t):
    return t.documents.select("doc_id", F.array_join(rules.keyword_tags("text", DOC_TAGS), ",").alias("tags"))


@query("suffix_routes", """
with s as (select p_partkey, string_split(lower(replace(p_name, ' ', '_')), '_') as ws, replace(p_name, ' ', '_') as j from part),
 h as (select *, list_filter([case when regexp_matches(j, 'old|young|boy') then 'episode_or_timeline' end, case when regexp_matches(j, 'hat|red|white|black|grey|silver|orange') then 'outfit_or_accessory' end,
   case when regexp_matches(j, 'bin|training') then 'story_or_prop_state' end], lambda x: x is not null) as hits from s)
select p_partkey, case when len(hits) > 0 then array_to_string(hits, ',') else 'other_unclassified' end as routes,
  case when len(hits) > 1 then 'mixed_semantics' when len(hits) = 1 then hits[1] else 'other_unclassified' end as primary_route from h""")
def suffix_routes(t):
    routes = rules.suffix_routes(F.split("p_name", " "), {
        "episode_or_timeline": "old|young|boy", "outfit_or_accessory": "hat|red|white|black|grey|silver|orange", "story_or_prop_state": "bin|training"})
    return t.part.select("p_partkey", routes.alias("r")).select("p_partkey", F.array_join("r", ",").alias("routes"), rules.primary_route("r").alias("primary_route"))


@query("coalesce_first", """select event_id, coalesce(case when event_type = 'click' then null else nullif(trim(event_type), '') end, nullif(trim(user_id::varchar), '')) as first_value from events""")
def coalesce_first(t):
    return t.events.select("event_id", rules.first_present(F.when(F.col("event_type") == "click", "  ").otherwise(F.col("event_type")), F.lit(""), "user_id").alias("first_value"))


@query("flatten_scalars", """select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events""")
def flatten_scalars(t):
    from curatrix.sources.readers import flatten_scalars as flatten

    return flatten(t.events, "event_id", "props", 1)


@query("preferred_ref", """select page_id, case when page_id % 3 = 0 then url || '/featured' when page_id % 3 = 1 then url || '/large' else url || '/icon' end as preferred from pages""")
def preferred_ref(t):
    k = F.col("page_id") % 3
    ref = lambda key, tail: F.struct(key.alias("key"), F.concat("url", F.lit(tail)).alias("url"))
    refs = F.array(ref(F.lit("images.other"), "/other"), ref(F.when(k == 0, "images.featured").otherwise("images.zz"), "/featured"),
                   ref(F.when(k == 1, "largeIcon").otherwise("images.yy"), "/large"), ref(F.lit("images.icon"), "/icon"), ref(F.lit("smallIcon"), "/small"))
    return t.pages.select("page_id", rules.preferred_ref(refs).alias("preferred"))


@query("project_metadata", """select event_id, case when event_type = 'view' then '' else 'event_type=' || event_type || ';' end || 'k=' || json_extract_string(props, '$.k') as kept from events""")
def project_metadata(t):
    values = F.create_map(F.lit("event_type"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.lit("drop_me"), F.lit("x"),
                          F.lit("k"), F.get_json_object("props", "$.k"), F.lit("nothing"), F.lit(None).cast("string"))
    kept = rules.project_metadata(values, ("event_type", "k", "nothing"))
    flat = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.events.select("event_id", flat.alias("kept"))


@query("set_similarity", """
with w as (select p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') as a, ['red', 'bolt', 'small', 'economy'] as b from part),
 x as (select p_partkey, list_distinct(a) as a, b, len(list_intersect(list_distinct(a), b)) as n from w)
select p_partkey, round(n / (len(a) + len(b) - n), 4) as jaccard, round(n / len(a), 4) as containment, n::int as overlap from x""")
def set_similarity(t):
    a, b = F.array_distinct(F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")), F.array(*[F.lit(x) for x in ("red", "bolt", "small", "economy")])
    return t.part.select("p_partkey", rules.jaccard(a, b).alias("jaccard"), rules.containment(a, b).alias("containment"), rules.overlap(a, b).alias("overlap"))


@query("sequence_ratio")
def sequence_ratio(t):
    names = t.part.select(F.col("p_name").alias("a"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("b")).distinct()
    return names.select("a", "b", F.round(rules.sequence_ratio("a", "b"), 4).alias("ratio"))


@query("temporal_relation", """select o_orderkey, case when o_orderkey % 11 = 0 then 'unknown' when year(o_orderdate) < 1998 then 'predates'
  when year(o_orderdate) > 1998 then 'postdates' else 'same_year' end as relation from orders""")
def temporal_relation(t):
    years = F.when(F.col("o_orderkey") % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(F.year("o_orderdate") + 3, F.year("o_orderdate")))
    return t.orders.select("o_orderkey", rules.temporal_relation(years, 1998).alias("relation"))


DRIFT_SQL = """
with n as (select p_partkey, p_name as old, case p_partkey % 5 when 0 then p_name when 1 then p_name || ' ' || lower(p_type) when 2 then null
   when 3 then split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) else lower(p_type) || ' ' || split_part(p_name, ' ', 1) end as new from part),
 w as (select *, list_distinct(string_split(old, ' ')) as a, list_distinct(string_split(coalesce(new, ''), ' ')) as b from n),
 s as (select *, len(list_intersect(a, b)) as n from w)
select p_partkey, case when new is null then 'missing_current_catalog_record' when old = new then 'same' when contains(new, old) or contains(old, new) then 'extends_or_shortens_name'
  when n / (len(a) + len(b) - n) >= 0.75 then 'minor_name_normalization' when n / (len(a) + len(b) - n) >= 0.45 then 'moderate_name_drift' else 'substantial_name_drift' end as drift from s"""


@query("name_drift", DRIFT_SQL)
def name_drift(t):
    k, first, second, kind = F.col("p_partkey") % 5, F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type")
    new = (F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_name", kind)).when(k == 2, F.lit(None)).when(k == 3, F.concat_ws(" ", second, first))
           .otherwise(F.concat_ws(" ", kind, first)))
    words = lambda c: F.array_distinct(F.split(c, " "))
    return t.part.select("p_partkey", rules.name_drift("p_name", new, words(F.col("p_name")), words(F.coalesce(new, F.lit("")))).alias("drift"))


@query("variant_support", """select p_partkey, case when p_size % 4 = 0 then 'target_has_no_variant' when lower(p_type) in ('small', 'large') then 'exact_variant'
  when contains(lower(p_type) || ' x', 'econ') or lower(p_type) = 'standard' then 'variant_contains' when contains(p_name || ' ' || lower(p_type), lower(p_type)) then 'catalog_name_contains_variant' else 'variant_unresolved' end as support from part""")
def variant_support(t):
    kind = F.lower("p_type")
    targets = F.when(F.col("p_size") % 4 == 0, F.array(F.lit(""))).otherwise(F.array(kind))
    releases = F.array(F.lit("small"), F.lit("large"), F.lit("econ"), F.lit("standard edition"))
    return t.part.select("p_partkey", rules.variant_support(targets, releases, F.array(F.concat_ws(" ", "p_name", kind))).alias("support"))


SIGNAL_SQL = """
with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 25.0 as er, l_linenumber - 4 as pd, l_discount * 2 - 0.1 as oc from lineitem),
 s as (select *, case when er < 0.70 then 'substantial_edge_reduction' when er < 0.85 then 'moderate_edge_reduction' when er > 1.25 then 'edge_increase' end as e,
  case when pd <= -2 then 'palette_reduction' when pd >= 2 then 'palette_increase' end as p, case when abs(oc) >= 0.12 then 'silhouette_or_occupancy_change' end as o from f)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', e, p, o) as signals,
 round(case e when 'substantial_edge_reduction' then 3.0 when 'moderate_edge_reduction' then 1.0 when 'edge_increase' then 1.0 else 0.0 end
  + case p when 'palette_reduction' then 2.0 when 'palette_increase' then 1.0 else 0.0 end + case when o is not null then 2.0 else 0.0 end
  + case when e is not null or p is not null or o is not null then 0.5 else 0.0 end, 2) as score from s"""


@query("signals_from_measures", SIGNAL_SQL)
def signals_from_measures(t):
    s = rules.measurement_signals("head", F.col("l_quantity") / 25.0, F.col("l_linenumber") - 4, F.col("l_discount") * 2 - 0.1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform("s", lambda x: x["signal"]), ",").alias("signals"), rules.signal_score("s").alias("score"))


@query("normalised_box", """select p_partkey, floor(x0 * 640)::int as x0, floor(y0 * 480)::int as y0, least(640, ceil(x1 * 640)::int) as x1, least(480, ceil(y1 * 480)::int) as y1
 from (select p_partkey, p_size / 100.0 as x0, 0.125 as y0, p_size / 100.0 + 0.25 as x1, case when p_partkey % 6 = 0 then 1.5 else 0.875 end as y1 from part) where y1 <= 1
 union all select p_partkey, null, null, null, null from part where p_partkey % 6 = 0""")
def normalised_box(t):
    x0 = F.col("p_size") / 100.0
    bounds = F.array(x0, F.lit(0.125), x0 + 0.25, F.when(F.col("p_partkey") % 6 == 0, 1.5).otherwise(0.875))
    return t.part.select("p_partkey", rules.pixel_box(bounds, F.lit(640), F.lit(480)).alias("b")).select("p_partkey", "b.x0", "b.y0", "b.x1", "b.y1")


@query("provenance_conflict", """
with w as (select page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[a-z0-9]+')) as a,
  list_distinct(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '[a-z0-9]+')) as b from pages)
select page_id, len(list_filter(a, lambda x: length(x) >= 2)) > 0 and len(list_filter(b, lambda x: length(x) >= 2)) > 0
  and not list_has_any(list_filter(a, lambda x: length(x) >= 2), list_filter(b, lambda x: length(x) >= 2)) as conflict from w""")
def provenance_conflict(t):
    title = text.tokens(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return t.pages.select("page_id", rules.provenance_conflict(title, text.tokens(P.url_host("url"))).alias("conflict"))


@query("row_filters", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_returnflag = 'R' and l_quantity >= 30 and l_discount > 0.05 and l_linestatus in ('O', 'F')""")
def row_filters(t):
    return t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30) & (F.col("l_discount") > 0.05) & F.col("l_linestatus").isin("O", "F")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("grouped_split", """select c_custkey, case when v < 0.8 then 'train' when v < 0.9 then 'validation' else 'test' end as split from (
  select c_custkey, ('0x' || left(sha256(c_mktsegment || '-' || c_nationkey || '-' || c_custkey), 16))::ubigint::double / 18446744073709551616.0 as v from customer)""")
def grouped_split(t):
    return t.customer.select("c_custkey", ids.hash_fraction_split(F.concat_ws("-", "c_mktsegment", "c_nationkey", "c_custkey")).alias("split"))


@query("mod_split", """select doc_id, case when b < 80 then 'train' when b < 90 then 'validation' else 'test' end as split from (
  select doc_id, ('0x' || left(sha256(coalesce(nullif(case when doc_id % 3 = 0 then '' else source end, ''), sha256(text), doc_id::varchar)), 8))::ubigint % 100 as b from documents)""")
def mod_split(t):
    part = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    key = rules.first_present(part, F.sha2("text", 256), "doc_id")
    return t.documents.select("doc_id", ids.hash_mod_split(key).alias("split"))
