"""Page extraction over the crawled pages."""

from pyspark.sql import functions as F

from curatrix.operators import group, pages, queues
from curatrix.plans.registry import query

HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
ORIGIN = "regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
LINKS = "regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')"
# Links of the pages are absolute or start at the root.
RESOLVED = "case when {0} like '/%' and {0} not like '//%' then " + ORIGIN.format("url") + " || {0} when regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {0} end"


@query("anchor_rows", f"""
with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"''][^\"'']*[\"''][^>]*>.*?</a\\s*>')) as m, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"''][^\"'']*[\"''][^>]*>.*?</a\\s*>'), 1) - 1 as pos from pages)
select page_id, pos::int as pos, {UNESCAPE.format("regexp_extract(m, '(?is)<a.*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)")} as href, trim(regexp_replace({UNESCAPE.format("regexp_replace(regexp_extract(m, '(?is)^<a[^>]*>(.*?)</a', 1), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) as text from a""")
def anchor_rows(t):
    return t.pages.select("page_id", F.inline(pages.anchors("html")))


@query("page_assets", f"""
with r as (select page_id, url, unnest({LINKS}) as ref, 'anchor_asset' as role from pages union all select page_id, url, unnest(regexp_extract_all(html, '(?is)<img\\b[^>]*?\\ssrc\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)), 'img_src' from pages),
 a as (select distinct page_id, url, role, {RESOLVED.format(UNESCAPE.format("ref"))} as asset_url from r)
select page_id, url, role, asset_url, 'pageasset-' || left(sha256(to_json(['pageasset', url, asset_url, role])), 24) as asset_id from a
where regexp_matches(lower(regexp_extract(asset_url, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1)), '\\.(png|jpg|jpeg|webp|gif|svg|mp4|webm|zip|pdf)$') or {HOST.format('asset_url')} like '%example.org%'""")
def page_assets(t):
    return pages.page_assets(t.pages, hosts=("example.org",))


@query("image_candidates")
def image_candidates(t):
    """Image-like addresses anywhere in a page, with occurrences and contexts."""
    return pages.image_candidates(t.pages, needles=("example", ".png", ".jpg"))


IMAGE_SQL = f"""
with m as (select page_id, url, list_concat(regexp_extract_all(html, '(?i)<meta[^>]+property=["'']og:image["''][^>]+content=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '(?i)<img[^>]+(?:data-zoom-image|data-image|data-src|src)=["'']([^"'']+)["'']', 1),
   regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+\\.(?:png|jpe?g|webp)(?:\\?[^"'']*)?)["'']', 1)) as refs from pages),
 r as (select page_id, list_transform(refs, lambda x: case when x like '//%' then regexp_extract(url, '^([A-Za-z]+:)', 1) || x when x like '/%' then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || x else x end) as u from m)
select page_id, len(list_distinct(u))::int as image_count, u[1] as first_image from r"""


@query("preferred_page_image", IMAGE_SQL)
def preferred_page_image(t):
    p = t.pages.select("page_id", pages.page_images("html", "url").alias("images"))
    return p.select("page_id", F.size("images").alias("image_count"), pages.preferred_page_image("images", 0).alias("first_image"))


@query("pdf_links", """
with m as (select page_id, url, unnest(regexp_extract_all(html, '(?i)["'']([^"''<>\\s]+\\.pdf(?:\\?[^"''<>\\s]*)?)["'']', 1)) as ref from pages)
select distinct page_id, case when ref like '//%' then regexp_extract(url, '^([A-Za-z]+:)', 1) || ref when ref like '/%' then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || ref else ref end as pdf_url from m""")
def pdf_links(t):
    return pages.pdf_links(t.pages)


@query("page_meta", f"""
with m as (select page_id, nullif(trim(regexp_replace({UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') as title, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') as heading from pages)
select *, coalesce(title, heading) as best_title from m""")
def page_meta(t):
    m = pages.page_meta("html")
    return t.pages.select("page_id", m["title"].alias("title"), m["heading"].alias("heading"), F.coalesce(m["og_title"], m["title"], m["heading"]).alias("best_title"))


@query("visible_text", f"""
select page_id, trim(regexp_replace({UNESCAPE.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) as visible from pages""")
def visible_text(t):
    return t.pages.select("page_id", pages.strip_tags("html").alias("visible"))


@query("url_policy", f"""select page_id, case when url not like 'https:%' then 'non_https_url' when {HOST.format('url')} not in ('thther.example.org', 'm.ththth.example.net') then 'host_not_allowed' end as reason from pages""")
def url_policy(t):
    return t.pages.select("page_id", pages.url_policy("url", ("thther.example.org", "m.ththth.example.net")).alias("reason"))


LINES_SQL = f"""
y as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>', '<x>', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') as h from pages),
 z as (select page_id, list_filter(list_transform(string_split_regex(h, '<[^>]*>'), lambda x: trim(regexp_replace({UNESCAPE.format("x")}, '\\s+', ' ', 'g'))), lambda x: x <> '') as ls from y)"""


@query("visible_lines", f"with {LINES_SQL} select page_id, len(ls)::int as lines, sha256(array_to_string(ls, chr(10))) as digest, nullif(trim(regexp_extract(array_to_string(ls, chr(10)), '(?i)Updated\\s+(?:as\\s+of\\s+)?([^\\n.]+)', 1)), '') as updated from z")
def visible_lines(t):
    """Text nodes of the pages as lines, and the label of the last update where a page has one."""
    text = pages.visible_lines("html")
    return t.pages.select("page_id", F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"), F.sha2(text, 256).alias("digest"), pages.updated_label(text).alias("updated"))


SEGMENTS_SQL = LINES_SQL + """,
 n as (select page_id, ls, unnest(range(len(ls))) as i from z),
 s as (select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, case when i % 4 = 1 then 'K' else 'KF' end || i as serial, nullif(left(trim(regexp_replace(ls[i + 1], '^[\\s:–—-]+', '')), 250), '') as name from n where i % 4 in (1, 2))"""


@query("segment_between_matches", f"with {SEGMENTS_SQL} select page_id, pos, serial, name from s")
def segments(t):
    """Serials of the pages' lines, each with the rest of its line."""
    return _segments(t)


def _segments(t):
    """The lines of the whole page, two of every four marked with a serial by their number."""
    lines = F.split(pages.visible_lines("html"), "\n")
    code = lambda i: F.when(i % 4 == 1, F.concat(F.lit("K"), i, F.lit(" "))).when(i % 4 == 2, F.concat(F.lit("kf-"), i, F.lit(": "))).otherwise("")
    return t.pages.select("page_id", F.inline(pages.segments_between(F.array_join(F.transform(lines, lambda x, i: F.concat(code(i), x)), "\n"), "KF|K")))


SERIAL_SQL = f"""
with {SEGMENTS_SQL},
 f as (select serial, name, min(page_id * 1000000 + pos) as fp from s group by 1, 2), o as (select serial, count(*) as occurrence_count from s group by 1),
 g as (select serial, count(*) as name_count, string_agg(name, chr(10) order by fp, name) as names from f group by 1), r as (select o.*, name_count, names, case when name_count = 1 then 'named' else 'conflicting_names' end as name_status from o join g using (serial))
"""


@query("serial_observations", SERIAL_SQL + "select serial, occurrence_count, name_count, split_part(names, chr(10), 1) as first_name, name_status from r")
def serial_observations(t):
    return group.serial_observations(_segments(t), "serial", "name", "page_id", "pos")


@query("serial_names", SERIAL_SQL + "select serial, row_number() over (partition by serial order by fp, name)::bigint as name_no, name, (fp // 1000000)::bigint as page_id, (fp % 1000000)::int as pos from f")
def serial_names(t):
    return group.serial_names(_segments(t), "serial", "name", "page_id", "pos")


@query("catalog_digest", SERIAL_SQL + """, l as (select sha256('serial|' || serial || '|' || name_status || '|' || occurrence_count) as h, 1 as one from r
 union all select sha256('name|' || serial || '|' || row_number() over (partition by serial order by fp, name) || '|' || name), 0 from f)
select sum(one)::bigint as serials, sha256(count(*) || '|' || sum(('0x' || left(h, 15))::bigint::hugeint) || '|' || sum(('0x' || substr(h, 16, 15))::bigint::hugeint)) as catalog_digest from l""")
def catalog_digest(t):
    return group.catalog_digest(_segments(t), "serial", "name", "page_id", "pos")


@query("web_profile", f"""
with l as (select page_id, octet_length(encode(html))::int as bytes, sha256(html) as digest, len(regexp_extract_all(html, '(?i)<(img)\\b', 1))::int as images, {LINKS} as links, {HOST.format('url')} as own, url from pages),
 u as (select page_id, own, unnest(links) as ref, url from l), h as (select page_id, own, {HOST.format('(' + RESOLVED.format(UNESCAPE.format('ref')) + ')')} as host from u), c as (select page_id, host, count(*) as n from h where host <> '' and host <> own group by 1, 2),
 o as (select page_id, string_agg(host || '=' || n, ',' order by host) as outbound from c group by 1)
select l.page_id, bytes, digest, images, len(links)::int as links, coalesce(outbound, '') as outbound from l left join o using (page_id)""")
def web_profile(t):
    out = pages.web_profile(t.pages)
    return out.withColumn("outbound", F.array_join(F.transform("outbound", lambda h: F.concat(h["host"], F.lit("="), h["n"].cast("string"))), ","))


@query("sanitisation_queue", f"""
with l as (select page_id, {HOST.format('url')} as host, url, case when page_id % 7 = 0 then null else sha256(html) end as sha from pages), r as (select page_id, case when page_id % 4 = 0 then 'old' else sha256(html) end as rsha, case when length(html) % 3 = 0 then 'approved_raw' when length(html) % 3 = 1 then 'sanitization_required' else 'rejected' end as rst from pages where length(html) % 5 > 0)
select l.page_id, case when sha is not null then host end as source_id, sha as source_sha256, case when sha is null then null when host like '%.com' then 'high' when host like '%.org' then 'medium_review_required' else 'unknown_review_required' end as source_risk, coalesce(rsha <> sha, false) and rsha is not null as review_stale,
 case when sha is null then 'no_verified_locator' when rst is null then 'pending_visual_review' when rsha <> sha then 'stale_review_requires_repeat' when rst = 'approved_raw' then 'approved_raw_model_input' when rst = 'sanitization_required' then 'sanitization_required' else 'rejected_or_unresolved' end as status
from l left join r using (page_id)""")
def sanitisation_queue(t):
    k, host = F.col("page_id"), pages.url_host("url")
    loc = F.array(F.struct(host.alias("source_id"), F.col("url").alias("url"), F.when(k % 7 != 0, F.sha2("html", 256)).alias("sha256")), F.struct(F.lit("a").alias("source_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("sha256")))
    size = F.length("html")
    rev = t.pages.where(size % 5 > 0).select("page_id", F.when(k % 4 == 0, "old").otherwise(F.sha2("html", 256)).alias("sha256"), F.when(size % 3 == 0, "approved_raw").when(size % 3 == 1, "sanitization_required").otherwise("rejected").alias("status"))
    cases = t.pages.select("page_id", loc.alias("locators"), F.when(F.endswith(host, F.lit(".com")), "com.test").when(F.endswith(host, F.lit(".org")), "org.test").otherwise("x.test").alias("family"), "url")
    # Hosts fold to their registry suffix, so the risk list stays fixed.
    cases = cases.withColumn("locators", F.transform("locators", lambda l: F.struct(l["source_id"].alias("source_id"), F.when(l["url"].isNotNull(), F.concat(F.lit("https://"), F.col("family"), F.lit("/"))).alias("url"), l["sha256"].alias("sha256"))))
    out = queues.sanitisation_queue(cases, "page_id", "locators", rev, ("com.test",), ("org.test",))
    return out.withColumn("review_stale", F.coalesce("review_stale", F.lit(False)))


@query("acquisition_status", """
with l as (select page_id, case when page_id % 6 = 0 then 0 else 1 + page_id % 2 end as n, case when page_id % 3 = 0 then 'byte_verified' when page_id % 3 = 1 then 'blocked_on_direct_release_locator' when url like '%.com%' then 'ready_for_catalog_image_resolution' else 'ready_for_reviewed_page_media_resolution' end as s1, case when length(html) % 2 = 0 then 'resolved_exact_image_url' else 'blocked_on_direct_release_locator' end as s2, url from pages),
 a as (select page_id, case when n = 0 then [] when n = 1 then [s1] else [s1, s2] end as st, url from l)
select page_id, array_to_string(st, ',') as locator_statuses, case when len(st) = 0 then 'blocked_missing_reference_locator' when list_contains(st, 'byte_verified') then 'byte_verified_materialization_pending' when list_contains(st, 'resolved_exact_image_url') then 'ready_for_materialization'
 when len(list_filter(st, lambda x: x <> 'blocked_on_direct_release_locator')) = 0 then 'blocked_on_direct_release_locator' else 'ready_for_image_url_resolution' end as case_status, case when list_contains(st, 'resolved_exact_image_url') then url || '#img' end as exact_image_url from a""")
def acquisition_status(t):
    k, none = F.col("page_id"), F.lit(None).cast("string")
    def loc(quality, sha, image):
        return F.struct(F.col("url"), quality.alias("quality"), F.lit("structured_catalog").alias("authority"), sha.alias("sha256"), image.alias("image_url"))
    first = loc(F.when(k % 3 == 1, "indirect_identity_graph"), F.when(k % 3 == 0, F.sha2("html", 256)), none)
    second = loc(F.lit("indirect_identity_graph"), none, F.when(F.length("html") % 2 == 0, F.concat("url", F.lit("#img"))))
    lst = F.when(k % 6 == 0, F.slice(F.array(first, second), 1, 0)).when(k % 2 == 0, F.array(first)).otherwise(F.array(first, second))
    out = queues.acquisition_status(t.pages.select("page_id", lst.alias("locators")), "page_id", "locators", ".com")
    return out.withColumn("locator_statuses", F.array_join("locator_statuses", ","))


@query("first_usable_source", """
with f as (select url, case when min(page_id) % 5 = 0 then 404 else 200 end as status, min(sha256(html)) as sha from pages group by 1), p as (select page_id, url, sha256(html) as h from pages)
select p.page_id, case when status = 200 and h = sha then p.url end as chosen_url, case when status = 200 and h = sha then 1 end as chosen_index,
 'not_fetched,' || case when status <> 200 then 'http_error' when h <> sha then 'digest_mismatch' else 'usable' end as attempts from p join f on p.url = f.url""")
def first_usable_source(t):
    fetched = t.pages.groupBy("url").agg(F.when(F.min("page_id") % 5 == 0, 404).otherwise(200).alias("status"), F.min(F.sha2("html", 256)).alias("sha256"), F.max(F.length("html")).alias("bytes"))
    opt = lambda u, s: F.struct(u.alias("url"), s.alias("sha256"))
    options = t.pages.select("page_id", F.array(opt(F.concat("url", F.lit("/gone")), F.lit(None).cast("string")), opt(F.col("url"), F.sha2("html", 256))).alias("options"))
    out = pages.first_usable_source(options, fetched, "page_id")
    return out.withColumn("attempts", F.array_join(F.transform("attempts", lambda a: a["outcome"]), ","))
