"""Review lifecycle over labels, documents and events."""

import uuid

from pyspark.sql import functions as F

from curatrix.operators import dq, queues, review
from curatrix.plans.registry import query
from curatrix.session import checkpoint_root
from curatrix.sources import readers, writers
from curatrix.streaming import jobs

# Flat reviews from the labels: three rounds per labelled document.
FLAT_SQL = """
d as (select doc_id, quality, toxic, n_chars, sha256(text) as h from labels join documents using (doc_id)),
r as (select doc_id as item_id, 'a' || doc_id as review_id, case when n_chars % 13 = 0 then 'draft' else 'submitted' end as st, 'p' || n_chars % 3 as who, 'q' || quality as ph, case when n_chars % 17 = 0 then null else h end as ev, []::varchar[] as refs from d
 union all select doc_id, 'b' || doc_id, 'submitted', 'p' || (n_chars + toxic + n_chars % 2) % 3, 'q' || (case when n_chars % 5 = 0 then 1 - quality else quality end), case when n_chars % 19 = 0 then 'other' else h end, [] from d where n_chars % 4 > 0
 union all select doc_id, 'c' || doc_id, 'adjudicated', 'p9', 'q1', h, ['a' || doc_id, case when n_chars % 11 = 0 then 'zz' else 'b' || doc_id end] from d where n_chars % 3 = 0)
"""
ADJ_SQL = FLAT_SQL + """,
s as (select item_id, count_if(st = 'submitted') as submitted_count, count_if(st = 'draft') as draft_count, count_if(st = 'adjudicated') as adjudicated_count, count(distinct case when st = 'submitted' then ph end) as submitted_payloads, count(distinct case when st = 'submitted' then who end) as independent_reviewers,
  count(distinct case when st = 'adjudicated' then ph end) as adjudicated_payloads, count(distinct case when st <> 'draft' then ev end) as evidence_variants, count_if(st <> 'draft' and ev is null) as evidence_missing, min(case when st = 'adjudicated' then review_id end) as sel from r group by 1),
w as (select item_id, review_id as bid, unnest(refs) as ref from r where st = 'adjudicated'), k as (select w.item_id, bid, count_if(g.review_id is null) as lost, count(distinct g.who) as who from w left join (select item_id, review_id, who from r where st = 'submitted') g on g.item_id = w.item_id and g.review_id = w.ref group by 1, 2),
e as (select item_id, count_if(lost > 0) as reference_errors, count_if(lost = 0 and who < 2) as independence_errors from k group by 1),
j as (select s.*, coalesce(reference_errors, 0) as reference_errors, coalesce(independence_errors, 0) as independence_errors from s left join e using (item_id)),
t as (select *, case when evidence_missing > 0 then 'needs_exact_evidence' when evidence_variants > 1 then 'evidence_conflict' when reference_errors > 0 then 'invalid_adjudicator_references' when independence_errors > 0 then 'invalid_adjudicator_independence' when adjudicated_payloads > 1 then 'adjudicator_conflict'
  when adjudicated_count >= 1 then 'adjudicated' when submitted_count >= 2 and independent_reviewers < 2 then 'needs_independent_second_review' when submitted_count >= 2 and submitted_payloads = 1 then 'agreement_candidate' when submitted_count >= 2 then 'needs_adjudication' when submitted_count = 1 then 'needs_second_review' else 'draft_only' end as status from j)
"""


def flat_reviews(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("h")), "doc_id")
    k, n, text = F.col("doc_id"), F.col("n_chars"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.array().cast("array<string>")

    def row(prefix, status, who, payload, evidence, refs, keep):
        return F.when(keep, F.struct(
            text(prefix, k).alias("review_id"), status.alias("review_status"), who.alias("principal"), payload.alias("payload_hash"), evidence.alias("evidence"), refs.alias("refs"),
            F.when(F.lit(prefix == "c"), "adjudicator").otherwise("reviewer").alias("review_role")))

    rows = F.array(
        row("a", F.when(n % 13 == 0, "draft").otherwise("submitted"), text("p", n % 3), text("q", F.col("quality")), F.when(n % 17 != 0, F.col("h")), none, F.lit(True)),
        row("b", F.lit("submitted"), text("p", (n + F.col("toxic") + n % 2) % 3), text("q", F.when(n % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))), F.when(n % 19 == 0, "other").otherwise(F.col("h")), none, n % 4 > 0),
        row("c", F.lit("adjudicated"), F.lit("p9"), F.lit("q1"), F.col("h"), F.array(text("a", k), F.when(n % 11 == 0, "zz").otherwise(text("b", k))), n % 3 == 0))
    return d.select(k.alias("item_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("item_id", "r.*")


@query("adjudicate", "with " + ADJ_SQL + "select item_id, status, status = 'adjudicated' as training_eligible, case when status = 'adjudicated' then sel end as selected_review_id, submitted_count, draft_count, adjudicated_count, submitted_payloads, independent_reviewers, adjudicated_payloads, evidence_variants, evidence_missing, reference_errors, independence_errors from t")
def adjudicate(t):
    return review.adjudicate(flat_reviews(t))


@query("promote_supervision", "with " + ADJ_SQL + "select item_id, sel as canonical_review_id, independent_reviewers, '' as violations from t where status = 'adjudicated'")
def promote(t):
    rows = flat_reviews(t)
    return review.promote(rows, review.adjudicate(rows))[0].withColumn("violations", F.array_join("violations", ","))


@query("promotion_skipped", "with " + ADJ_SQL + "select item_id, status, 'not_explicitly_adjudicated' as reason from t where status <> 'adjudicated'")
def skipped(t):
    rows = flat_reviews(t)
    return review.promote(rows, review.adjudicate(rows))[1]


@query("blind_second_review", "with " + ADJ_SQL + ", own as (select distinct item_id from r where st = 'submitted' and who = 'p1') select item_id, d.h as evidence, d.n_chars from t join d on d.doc_id = t.item_id where status in ('needs_second_review', 'needs_independent_second_review') and item_id not in (select item_id from own) order by d.n_chars desc, item_id limit 25")
def blind_second_review(t):
    rows = flat_reviews(t)
    queue = t.labels.join(t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("evidence")), "doc_id").withColumnRenamed("doc_id", "item_id")
    batch = review.work_batch(queue, "second_review", "n_chars", "item_id", 25, reviews=rows, statuses=review.adjudicate(rows), reviewer="P1 ")
    return review.blind_second_review(batch, ["quality", "toxic"], "evidence")


@query("adjudication_batch", "with " + ADJ_SQL + "select item_id, d.n_chars from t join d on d.doc_id = t.item_id where status in ('needs_adjudication', 'adjudicator_conflict', 'invalid_adjudicator_references') order by d.n_chars desc, item_id limit 10 offset 2")
def adjudication_batch(t):
    queue = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("item_id"), "n_chars")
    return review.work_batch(queue, "adjudication", "n_chars", "item_id", 10, 2, statuses=review.adjudicate(flat_reviews(t)))


@query("shared_evidence", "with " + FLAT_SQL + "select item_id, count(ev) = count(*) and min(ev) = max(ev) as shared_evidence from r group by 1")
def shared_evidence(t):
    out = review.shared_evidence(flat_reviews(t), ["item_id"], "evidence")
    return out.withColumn("shared_evidence", F.col("shared_evidence"))


@query("review_conflicts", """
with r as (select source || lang as grp, quality, toxic, n_chars % 9 = 0 as xref from labels join documents using (doc_id)), g as (select grp, count(*) as reviews, count(distinct quality) as quality_values, count(distinct toxic) as toxic_values from r where not xref group by 1)
select *, concat_ws(',', case when quality_values > 1 then 'quality' end, case when toxic_values > 1 then 'toxic' end) as conflicting_fields from g where quality_values > 1 or toxic_values > 1""")
def review_conflicts(t):
    rows = t.labels.join(t.documents.select("doc_id", F.concat("source", "lang").alias("grp"), "n_chars"), "doc_id")
    return review.review_conflicts(rows, "grp", ["quality", "toxic"], F.col("n_chars") % 9 == 0).withColumn("conflicting_fields", F.array_join("conflicting_fields", ","))


@query("review_coverage", """
with q as (select case when n_chars > 300 then doc_id else -doc_id - 1 end as doc_id, lang from documents), c as (select doc_id, count(*) as n from (select doc_id from labels union all select doc_id from labels where toxic = 1) group by 1)
select lang, count_if(n is not null) as reviewed, count_if(n is null) as unreviewed, count_if(n > 1) as duplicate_reviews from q left join c using (doc_id) group by 1
union all select 'outside_queue', count(*), 0, 0 from c where doc_id not in (select doc_id from q)""")
def review_coverage(t):
    return review.review_coverage(t.documents.select(F.when(F.col("n_chars") > 300, F.col("doc_id")).otherwise(-F.col("doc_id") - 1).alias("doc_id"), "lang"), t.labels.select("doc_id").unionAll(t.labels.where("toxic = 1").select("doc_id")), "doc_id", "lang")


def event_reviews(t):
    """Nested reviews from the event log: one review per event, some broken on purpose by their values."""
    k, e = F.col("event_id"), F.col("event_type")
    digest = F.sha2(F.col("user_id").cast("string"), 256)
    item = F.struct(F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("feature "), (k % 5).cast("string"))).alias("feature"),
                    F.when(e == "click", "omitted").when(e == "view", "simplified").when(e == "error", "uncertain").otherwise("bogus").alias("decision"),
                    (F.col("value") / 40).alias("confidence"), F.lit("observed_in_both").alias("evidence_basis"), F.lit(None).cast("string").alias("notes"))
    region = F.when(k % 31 == 0, "tail").when(k % 2 == 0, "head").otherwise("torso")
    return t.events.select(
        F.when(k % 37 != 0, F.lit(review.SCHEMA)).otherwise("old").alias("schema"), F.lit(None).cast("string").alias("review_id"), F.concat(F.lit("pair-"), F.col("user_id")).alias("translation_pair_id"),
        F.struct(F.when(k % 3 == 0, "model").otherwise("human").alias("reviewer_type"), F.concat(F.lit("r"), k % 4).alias("reviewer_id"), F.when(k % 6 == 0, "m1").alias("model_id"), F.when(k % 6 == 0, "v1").alias("model_revision"), F.lit("reviewer").alias("review_role")).alias("reviewer"),
        F.struct(F.lit("https://a.test/1").alias("source_image_url"), F.when(k % 41 == 0, "http://b.test/1").otherwise("https://b.test/1").alias("lego_image_url"), digest.alias("source_image_sha256"), digest.alias("lego_image_sha256"), F.lit("front_pair").alias("evidence_scope"), F.lit(False).alias("claims_unobserved_surfaces")).alias("evidence"),
        F.struct(F.create_map(region, F.array(item)).alias("regions"), F.array().cast("array<string>").alias("identity_critical_features"), F.lit(None).cast("string").alias("mask_headgear_route"), F.lit(None).cast("string").alias("expression_translation")).alias("annotations"),
        F.array().cast("array<string>").alias("limitations"), F.lit("submitted").alias("review_status"), F.array().cast("array<string>").alias("adjudicates_review_ids"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), k.alias("event_id"))


@query("validate_reviews", """
select event_id, (event_id % 37 = 0)::int + (event_id % 3 = 0 and event_id % 6 <> 0)::int * 2 + (event_id % 41 = 0)::int + (event_id % 31 = 0)::int + case when event_id % 31 = 0 then 0 else (event_id % 29 = 0)::int + (event_type not in ('click', 'view', 'error'))::int + (value / 40 > 1)::int end as error_count from events""")
def validate_reviews(t):
    return review.validate_reviews(event_reviews(t)).select("event_id", F.size("errors").alias("error_count"))


@query("normalise_reviews")
def normalise_reviews(t):
    valid, _ = dq.split_valid(review.validate_reviews(event_reviews(t)))
    return review.normalise_reviews(valid).select("event_id", "review_id", "validator_version")


@query("critic_items", """
with v as (select *, case event_type when 'click' then 'omitted' when 'view' then 'simplified' when 'error' then 'uncertain' end as decision from events where event_id % 37 <> 0 and not (event_id % 3 = 0 and event_id % 6 <> 0) and event_id % 41 <> 0 and event_id % 31 <> 0 and event_id % 29 <> 0 and event_type in ('click', 'view', 'error') and value / 40 <= 1)
select event_type, count(*) as items, case event_type when 'click' then 'feature_loss' when 'view' then 'detail_compression' else 'review_uncertainty' end as critic_category, case when event_id % 2 = 0 then 'head' else 'torso' end as region from v group by 1, 3, 4""")
def critic_items(t):
    valid, _ = dq.split_valid(review.validate_reviews(event_reviews(t)))
    items = review.critic_items(review.normalise_reviews(valid), F.lit("events"))
    kind = F.when(F.col("decision") == "omitted", "click").when(F.col("decision") == "simplified", "view").otherwise("error")
    return items.groupBy(kind.alias("event_type"), "critic_category", "region").agg(F.count(F.lit(1)).alias("items"))


@query("field_shape_audit", """
with c as (select c_custkey, case c_custkey % 6 when 0 then '199' || c_custkey % 10 when 1 then 'Red and Blue' when 2 then c_mktsegment when 3 then 'N' || c_nationkey when 4 then c_mktsegment || ')' else c_name end as ident, c_mktsegment as uni, 'N' || c_nationkey as var, c_custkey % 6 as k from customer)
select c_custkey, case k when 0 then 'identity_numeric_only,identity_year_like' when 1 then 'identity_color_or_material_descriptor' when 2 then 'identity_duplicates_universe' when 3 then 'identity_duplicates_variant' else 'identity_duplicates_universe,identity_trailing_unmatched_punctuation' end as review_signals,
 (case k when 0 then 40 when 1 then 35 when 2 then 30 when 3 then 15 else 40 end)::int as review_priority_score from c where k <> 5""")
def field_shape_audit(t):
    k, seg, nat = F.col("c_custkey") % 6, F.col("c_mktsegment"), F.concat(F.lit("N"), "c_nationkey")
    ident = (F.when(k == 0, F.concat(F.lit("199"), F.col("c_custkey") % 10)).when(k == 1, "Red and Blue").when(k == 2, seg).when(k == 3, nat).when(k == 4, F.concat(seg, F.lit(")"))).otherwise(F.col("c_name")))
    out = queues.field_shape_audit(t.customer.select("c_custkey", ident.alias("ident"), seg.alias("uni"), nat.alias("var")), "ident", "uni", "var", ("red", "blue", "black"))
    return out.select("c_custkey", F.array_join("review_signals", ",").alias("review_signals"), "review_priority_score")


@query("presentation_alias_audit", """
with p as (select p_brand, case p_size % 3 when 0 then p_name when 1 then upper(p_name) else replace(p_name, ' ', ' - ') end as label from part), k as (select p_brand, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) as nk, label, count(*) as n from p group by 1, 2, 3)
select p_brand, nk as normalized_key, count(*) over w as raw_label_count, (sum(n) over w)::bigint as record_count, label as raw_label, row_number() over (w order by length(label), label) as label_no from k window w as (partition by p_brand, nk) qualify count(*) over w > 1""")
def presentation_alias_audit(t):
    k = F.col("p_size") % 3
    label = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(" - ")))
    return queues.presentation_alias_audit(t.part.select("p_brand", label.alias("label")), "p_brand", "label")


@query("reference_links", """select o_orderkey, 'catalog:' || o_custkey as physical_reference_id, case when o_orderstatus = 'F' and o_totalprice > 50000 then 'physical_reference_link_ready' else 'physical_reference_link_unresolved' end as link_status from orders""")
def reference_links(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 50000, F.col("o_orderpriority")).alias("name"), "o_orderstatus")
    return queues.reference_links(rows, "o_custkey", "name", "o_orderstatus", "F", "catalog").select("o_orderkey", "physical_reference_id", "link_status")


@query("supervision_roles", """select p_partkey, case when p_type = 'SMALL' then 'component_surface_supervision' when p_type = 'LARGE' then 'motif_and_symbol_supervision' when p_type = 'ECONOMY' then 'generic_design_pattern_supervision' else 'review_required' end as supervision_role, p_type = 'SMALL' as exact_promotion_allowed from part""")
def supervision_roles(t):
    cls = F.when(F.col("p_type") == "SMALL", "minifigure_surface_map").when(F.col("p_type") == "LARGE", "motif_primitive").when(F.col("p_type") == "ECONOMY", "unscoped_design_or_pattern")
    return queues.supervision_roles(t.part.select("p_partkey", cls.alias("cls")), "cls").drop("cls")


@query("compile_submission")
def compile_submission(t):
    """Compact decisions from the labels compiled into nested reviews, one per labelled document."""
    d = t.labels.join(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    pair = F.concat(F.lit("pair-"), F.col("doc_id").cast("string"))
    url = F.concat(F.lit("https://a.test/"), F.col("doc_id").cast("string"))
    batch = d.select(pair.alias("translation_pair_id"), url.alias("source_image_url"), url.alias("lego_image_url"), F.col("h").alias("source_image_sha256"), F.col("h").alias("lego_image_sha256"))
    item = lambda region, feature, decision: F.array(F.lit(region), F.lit(feature), decision, F.lit("0.9"), F.lit("observed_in_both"), F.lit(""))
    rows = t.labels.select(pair.alias("translation_pair_id"), F.array(item("head", "quality", F.when(F.col("quality") == 1, "preserved").otherwise("omitted")), item("torso", "tone", F.when(F.col("toxic") == 1, "exaggerated").otherwise("simplified"))).alias("items"))
    out = review.compile_submission(batch, rows, "r1", "m1", "v1", "2026-01-01T00:00:00Z")
    return out.select("translation_pair_id", "review_id", review.annotation_count().alias("annotations_n"))


def _folder(t, name):
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("incremental_ingest", "select event_id, ts, user_id, event_type, value, props from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1")
def incremental_ingest(t):
    """Event files read as a stream; one row per user and type survives, restarts do not double rows."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    return jobs.incremental_ingest(source, _folder(t, "ingest"), _folder(t, "ingest-log"), ["user_id", "event_type"], ["event_id"])


STREAM_SQL = """
with r as (select user_id as item_id, case event_type when 'purchase' then 'adjudicated' when 'view' then 'draft' else 'submitted' end as st, event_id % 3 as who, event_type as ph, 'e' || event_id as rid from events),
 s as (select item_id, count_if(st = 'submitted') as submitted_count, count_if(st = 'draft') as draft_count, count_if(st = 'adjudicated') as adjudicated_count, count(distinct case when st = 'submitted' then ph end) as submitted_payloads, count(distinct case when st = 'submitted' then who end) as independent_reviewers,
  count(distinct case when st = 'adjudicated' then ph end) as adjudicated_payloads, (count_if(st <> 'draft') > 0)::int as evidence_variants, 0 as evidence_missing, 0 as reference_errors, count_if(st = 'adjudicated') as independence_errors from r group by 1)
select *, case when independence_errors > 0 then 'invalid_adjudicator_independence' when submitted_count >= 2 and independent_reviewers < 2 then 'needs_independent_second_review' when submitted_count >= 2 and submitted_payloads = 1 then 'agreement_candidate' when submitted_count >= 2 then 'needs_adjudication' when submitted_count = 1 then 'needs_second_review' else 'draft_only' end as status,
 false as training_eligible, null::varchar as selected_review_id from s"""


@query("review_log_stream", STREAM_SQL)
def review_log_stream(t):
    """Event log read as a stream of reviews; statuses of touched items are recomputed."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")

    def flatten(batch):
        status = F.when(F.col("event_type") == "purchase", "adjudicated").when(F.col("event_type") == "view", "draft").otherwise("submitted")
        return batch.select(F.col("user_id").alias("item_id"), F.concat(F.lit("e"), "event_id").alias("review_id"), status.alias("review_status"), (F.col("event_id") % 3).cast("string").alias("principal"), F.col("event_type").alias("payload_hash"),
                            F.lit("one").alias("evidence"), F.array().cast("array<string>").alias("refs"))

    status = _folder(t, "status")
    jobs.review_log_stream(source, _folder(t, "log"), status, _folder(t, "status-log"), flatten)
    return jobs.latest_status(t.spark, status)


@query("file_tree")
def file_tree(t):
    """Inventory of the parquet folder itself: bytes, ending, class and digest."""
    return readers.scan_file_tree(t.spark, t.folder, {"columnar": ("parquet",)})


@query("write_layer", "select o_orderkey, o_orderpriority, o_totalprice, row_number() over (order by o_orderpriority, o_orderkey) as row_no from orders")
def write_layer(t):
    """Ordered layer of orders written and read back with its row numbers."""
    return writers.write_layer(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), _folder(t, "layer"), ["o_orderpriority", "o_orderkey"])


@query("publish_atomically", "select o_orderstatus, count(*) as rows from orders group by 1")
def publish_atomically(t):
    """Orders published after a duplicate-key check on the staged files."""
    path = _folder(t, "published")
    doubled = lambda df: df.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    writers.publish(t.orders, path, [("duplicate order keys", doubled)])
    return writers.published(t.spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query("run_manifest")
def run_manifest(t):
    """Sources, digests, row counts and integrity of one run."""
    names = ("orders", "customer", "nation")
    sources = writers.source_manifest(t.spark, {n: f"{t.folder}/{n}.parquet" for n in names}, {n: getattr(t, n) for n in names})
    checks = dq.integrity_counts({n: getattr(t, n) for n in names}, {"orders": ["o_orderkey"]})
    return writers.run_manifest(sources, "curatrix/1", "candidates are never promoted silently", checks)
