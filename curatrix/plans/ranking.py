"""Windows, ranks, batches and sorts over the driver tables."""

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from curatrix.functions import rules
from curatrix.operators import dedup, queues, rank, review
from curatrix.operators.scale import position, top_k
from curatrix.plans.registry import query
from curatrix.session import checkpoint_root
from curatrix.sources import writers


@query("rank_queue", "select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as rank from orders")
def rank_queue(t):
    return rank.rank_queue(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "rank")


@query("topk_per_group", "select l_suppkey, l_orderkey, l_linenumber, l_partkey, rank::int as rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rank from lineitem) where rank <= 5")
def topk_per_group(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_k(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 5).drop("l_extendedprice")


@query("best_per_key", "select l_orderkey, id, price from (select l_orderkey, l_partkey * 10000 + l_suppkey as id, l_extendedprice as price, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey * 10000 + l_suppkey) as rn from lineitem) where rn = 1")
def best_per_key(t):
    rows = t.lineitem.select("l_orderkey", (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("id"), F.col("l_extendedprice").alias("price"))
    return rank.best_per_key(rows, ["l_orderkey"], "price", "id")


SLOT_SQL = """
with d as (select source as sample, case when doc_id % 4 = 0 then 'head_front' when doc_id % 4 = 1 then 'torso_front' when doc_id % 4 = 2 then 'full_rear' else 'other' end as slot, lpad(doc_id::varchar, 9, '0') as asset, sha256(text) as h,
   round(72 + 20 * (doc_id % 10) / 10.0 + least(15.0, sqrt(n_chars::double) * sqrt(100.0) / 100) - 10 * (doc_id % 3) / 3.0, 6) as score, quality = 0 as bad from documents left join labels using (doc_id)),
 u as (select sample, slot, h, min(-score) as s, count(*) as n from d where not coalesce(bad, false) group by 1, 2, 3),
 v as (select u.*, (select min(asset) from d where d.sample = u.sample and d.slot = u.slot and d.h = u.h and -d.score = u.s and not coalesce(bad, false)) as a from u),
 r as (select *, row_number() over (partition by sample, slot order by s, a) as rn from v)
select sample, slot, max(case when rn = 1 then a end) as preferred_asset_id, round(max(case when rn = 1 then -s end), 3) as preferred_score, coalesce(string_agg(case when rn between 2 and 6 then a end, ',' order by rn), '') as alternate_asset_ids, sum(n)::bigint as occurrence_count, count(*) as distinct_contents from r group by 1, 2"""


def _slots(t):
    k = F.col("doc_id")
    slot = F.when(k % 4 == 0, "head_front").when(k % 4 == 1, "torso_front").when(k % 4 == 2, "full_rear").otherwise("other")
    d = t.documents.join(t.labels.select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id", "left").select(
        F.col("source").alias("sample"), slot.alias("slot"), F.lpad(k.cast("string"), 9, "0").alias("asset"), F.sha2("text", 256).alias("h"), F.lit("structured_catalog_secondary").alias("authority"),
        (k % 10 / 10.0).alias("identity_confidence"), F.col("n_chars").cast("double").alias("width"), F.lit(100.0).alias("height"), (k % 3 / 3.0).alias("blur_score"),
        *[F.lit(0.0).alias(c) for c in ("view_confidence", "segmentation_confidence", "occlusion_score")], "bad")
    return rank.resolve_slots(d.withColumn("score", F.round(rank.evidence_score(), 6)), "sample", "slot", "asset", "h", "score", "bad")


@query("slot_resolution", SLOT_SQL)
def slot_resolution(t):
    return _slots(t).withColumn("alternate_asset_ids", F.array_join("alternate_asset_ids", ","))


@query("slot_completeness", f"with s as ({SLOT_SQL}) select sample, array_to_string(list_filter(['full_front','full_rear','full_left','full_right','head_front','torso_front','hips_legs_front'], lambda x: not list_contains(list(slot), x)), ',') as missing_roles from s group by 1")
def slot_completeness(t):
    return rank.slot_completeness(_slots(t), "sample", "slot").withColumn("missing_roles", F.array_join("missing_roles", ","))


@query("ring_negatives_global", """
with c as (select c_custkey, c_nationkey, row_number() over (order by c_custkey) - 1 as p, count(*) over () as n from customer),
 j as (select c.*, a.c_custkey as k1, a.c_nationkey as n1, b.c_custkey as k2, b.c_nationkey as n2 from c join c a on a.p = (c.p + 1) % c.n join c b on b.p = (c.p + 2) % c.n)
select c_custkey, c_nationkey, case when n1 <> c_nationkey then k1 else k2 end as negative_id, case when n1 <> c_nationkey then n1 else n2 end as negative_partner from j""")
def ring_global(t):
    return rank.ring_pairs(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")


@query("ring_negatives_hard", """
with c as (select c_custkey, c_nationkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as p, count(*) over (partition by c_mktsegment) as n from customer)
select c.c_custkey, c.c_nationkey, c.c_mktsegment, a.c_custkey as negative_id, a.c_nationkey as negative_partner from c join c a on a.c_mktsegment = c.c_mktsegment and a.p = (c.p + 1) % c.n where a.c_nationkey <> c.c_nationkey""")
def ring_hard(t):
    return rank.ring_pairs(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "c_nationkey", "c_mktsegment", 1)


BATCH_SQL = """
with r as (select o_orderkey, o_totalprice / 50000 as score, row_number() over (order by o_totalprice / 50000 desc, o_orderkey) as rn from orders where o_totalprice / 50000 >= 6), b as (select *, ((rn - 1) // 25 + 1)::int as batch_index from r)
"""


@query("batch_plan", BATCH_SQL + "select batch_index, count(*) as selected_records, round(max(score), 6) as top_score, round(min(score), 6) as bottom_score, arg_min(o_orderkey, rn) as first_id, arg_max(o_orderkey, rn) as last_id, ((batch_index - 1) * 25)::int as \"offset\", sha256(count(*) || '|' || sum(('0x' || left(sha256(rn || '|' || o_orderkey), 15))::bigint::hugeint) || '|' || sum(('0x' || substr(sha256(rn || '|' || o_orderkey), 16, 15))::bigint::hugeint)) as batch_digest from b group by 1")
def batch_plan(t):
    out = rank.batch_plan(t.orders.select("o_orderkey", (F.col("o_totalprice") / 50000).alias("score")), "score", "o_orderkey")
    return out.withColumn("top_score", F.round("top_score", 6)).withColumn("bottom_score", F.round("bottom_score", 6))


@query("review_progress", BATCH_SQL + """, l as (select case when l_orderkey % 50 = 0 then -l_orderkey else l_orderkey end as o_orderkey, l_suppkey % 3 as who, case when l_returnflag = 'R' then 'adjudicated' when l_returnflag = 'A' then 'draft' else 'submitted' end as st, case when l_linenumber % 5 = 0 then null else l_linestatus end as ev from lineitem),
 p as (select o_orderkey, count_if(st = 'submitted') as sub, count(distinct case when st = 'submitted' then who end) as who, count_if(st = 'adjudicated') as adj, count_if(st = 'submitted' and ev is null) as inexact, count_if(st = 'submitted' and ev is not null) as ex, count(distinct case when st = 'submitted' then ev end) as vars from l group by 1),
 j as (select batch_index, coalesce(sub, 0) as sub, coalesce(who, 0) as who, coalesce(adj, 0) as adj, coalesce(ex, 0) as ex, coalesce(inexact, 0) = 0 and coalesce(vars, 0) = 1 as exact from b left join p using (o_orderkey)),
 a as (select batch_index, count(*) as selected_records, count_if(who > 0) as submitted_items, sum(sub)::bigint as submitted_reviews, count_if(who >= 2 and exact) as double_reviewed_items, count_if(who >= 2 and not exact) as evidence_blocked_items, count_if(adj > 0) as adjudicated_items, count_if(who > 0 and ex = 0) as inexact_items, count(*) - count_if(who > 0) as remaining_items, count_if(who > 0) = count(*) as first_review_complete from j group by grouping sets ((batch_index), ())),
 n as (select min(batch_index) as nxt from a where not first_review_complete and batch_index is not null), o as (select count(*) as outside from p where who > 0 and o_orderkey not in (select o_orderkey from b))
select a.*, case when batch_index is null then outside else 0 end as outside_plan, case when batch_index is null then nxt is not null else coalesce(batch_index = nxt, false) end as next_batch from a, n, o""")
def review_progress(t):
    plan = rank.batch_members(t.orders.select("o_orderkey", (F.col("o_totalprice") / 50000).alias("score")), "score", "o_orderkey").select("batch_index", F.col("o_orderkey").alias("item_id"))
    status = F.when(F.col("l_returnflag") == "R", "adjudicated").when(F.col("l_returnflag") == "A", "draft").otherwise("submitted")
    item = F.when(F.col("l_orderkey") % 50 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    rows = t.lineitem.select(item.alias("item_id"), status.alias("review_status"), F.when(F.col("l_returnflag") == "R", "adjudicator").otherwise("reviewer").alias("review_role"),
                             (F.col("l_suppkey") % 3).cast("string").alias("principal"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linestatus")).alias("evidence"))
    return review.progress(plan, rows)


@query("work_batch", """select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_totalprice >= 100000 order by o_totalprice desc, o_orderkey limit 25 offset 10""")
def work_batch(t):
    reviews = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", "submitted").otherwise("draft").alias("review_status"))
    return review.work_batch(t.orders.select("o_orderkey", "o_totalprice"), "first_review", "o_totalprice", "o_orderkey", 25, 10, 100000, reviews)


@query("label_slices", """
with f as (select event_id, value, event_type as label from events union all select event_id, value, 'k' || json_extract_string(props, '$.k')::int % 4 from events), z as (select label, count(*) as n from f group by 1),
 r as (select *, row_number() over (partition by label order by value desc, event_id) as label_rank from f), h as (select r.*, n from r join z using (label) where label_rank <= 20)
select event_id, label, value, label_rank::int as label_rank from (select *, row_number() over (partition by event_id order by n desc, label) as rn from h) where rn = 1""")
def label_slices(t):
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 4)
    return rank.label_slices(t.events.select("event_id", "value", F.array("event_type", k).alias("labels")), "event_id", "labels", "value", 20)


@query("running_position", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as position from events")
def running_position(t):
    return rank.running_position(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("turn_position", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as position, role from conversations")
def turn_position(t):
    return rank.running_position(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query("order_status_then_score", "select o_orderkey, row_number() over (order by case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end, o_totalprice desc, o_orderkey) as rank from orders")
def order_status_then_score(t):
    return position(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [rank.status_order("o_orderstatus", ("P", "F")), F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "rank")


@query("top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("natural_serial_sort", "select c_custkey, row_number() over (order by regexp_replace(s, '[0-9]', '', 'g'), regexp_replace(s, '[^0-9]', '', 'g')::bigint, s) as position from (select c_custkey, c_mktsegment || c_custkey as s from customer)")
def natural_serial_sort(t):
    s = t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_custkey").cast("string")).alias("s"))
    return position(s, list(rank.natural_serial("s")), name="position").drop("s")


@query("fixed_shards", "select 'records-part-' || case when shard < 100 then lpad(shard::varchar, 2, '0') else shard::varchar end as shard_name, count(*) as rows, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) = max(row_no) - min(row_no) + 1 as in_row from (select *, (row_no - 1) // 1000 + 1 as shard from (select o_orderkey, row_number() over (order by o_orderkey) as row_no from orders)) group by shard")
def fixed_shards(t):
    """All orders written as shards of 1,000 rows and read back."""
    path = f"{checkpoint_root(t.spark)}/shards-{uuid.uuid4().hex}"
    writers.write_fixed_shards(t.orders.select("o_orderkey"), path, ["o_orderkey"], 1000)
    back = t.spark.read.schema("o_orderkey long, row_no long, shard_name string").json(path)
    n = F.count(F.lit(1))
    return back.groupBy("shard_name").agg(n.alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), (n == F.max("row_no") - F.min("row_no") + 1).alias("in_row"))


@query("priority_queue", """
with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 25.0 as er, l_tax * 10 - 0.3 as er2, l_discount * 2 - 0.1 as oc from lineitem),
 s as (select *, case when er < 0.70 then 3.0 when er < 0.85 or er > 1.25 then 1.0 else 0.0 end as a, case when er2 < 0.70 then 3.0 when er2 < 0.85 or er2 > 1.25 then 1.0 else 0.0 end as b, case when abs(oc) >= 0.12 then 2.0 else 0.0 end as o from f)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + b + o + case when a + o > 0 then 0.5 else 0.0 end + case when b > 0 then 0.5 else 0.0 end, 2)::double as review_priority_score from s""")
def priority_queue(t):
    none = F.lit(None).cast("double")
    head = rules.measurement_signals("head", F.col("l_quantity") / 25.0, none, F.col("l_discount") * 2 - 0.1)
    torso = rules.measurement_signals("torso", F.col("l_tax") * 10 - 0.3, none, none)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return queues.priority_queue(t.lineitem, [head, torso], keys).select(*keys, "review_priority_score")


BUCKETS = 65


def _word_counts(batches):
    """How many words of each text fall into each bucket."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            lists = piece.column(1)
            at = np.repeat(np.arange(len(lists)) * BUCKETS, lists.value_lengths().to_numpy(zero_copy_only=False))
            found = np.bincount(at + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * BUCKETS)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * BUCKETS, pa.int32()), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0), counts], names=["doc_id", "counts"])


def document_codes(t):
    """Difference hash of the word histogram: whole texts, counted inside their row; rows of one id are added up."""
    bucket = lambda word: F.conv(F.left(F.md5(word), F.lit(4)), 16, 10).cast("int") % BUCKETS
    words = t.documents.where("text is not null").select("doc_id", F.transform(F.split(F.lower("text"), r"\s+"), bucket).alias("buckets"))
    schema = T.StructType([words.schema["doc_id"], T.StructField("counts", T.ArrayType(T.LongType()))])
    hist = words.mapInArrow(_word_counts, schema).groupBy("doc_id").agg(*[F.sum(F.col("counts")[b]).alias(f"n{b}") for b in range(BUCKETS)])
    # Bit b is set when bucket b holds more words than bucket b + 1.
    bits = [F.when(F.col(f"n{b}") > F.col(f"n{b + 1}"), F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("long")) for b in range(BUCKETS - 1)]
    return hist.select("doc_id", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("code"))


NEAR_SQL = """
with w as (select doc_id, ('0x' || left(md5(unnest(string_split_regex(lower(text), '\\s+'))), 4))::int % 65 as b from documents), h as (select doc_id, b, count(*) as n from w group by 1, 2),
 d as (select doc_id, bit, sum(v) as v from (select doc_id, b as bit, n as v from h union all select doc_id, b - 1, -n from h) where bit between 0 and 63 group by 1, 2),
 c as (select distinct list_sort(list(bit)) as bits from (select doc_id, bit from d where v > 0) group by doc_id)
select count(*) as pairs, sum(dist)::bigint as total_distance from (select len(a.bits) + len(b.bits) - 2 * len(list_intersect(a.bits, b.bits)) as dist from c a join c b on a.bits < b.bits) where dist <= 3"""


@query("near_duplicate_pairs", NEAR_SQL)
def near_duplicate_pairs(t):
    pairs = dedup.near_duplicate_pairs(document_codes(t), "doc_id", "code", 3)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("hamming").alias("total_distance"))


GROUPS_SQL = """
with recursive w as (select doc_id, ('0x' || left(md5(unnest(string_split_regex(lower(text), '\\s+'))), 4))::int % 65 as b from documents), h as (select doc_id, b, count(*) as n from w group by 1, 2),
 d as (select doc_id, bit, sum(v) as v from (select doc_id, b as bit, n as v from h union all select doc_id, b - 1, -n from h) where bit between 0 and 63 group by 1, 2),
 c as materialized (select doc_id, coalesce(list_sort(list(bit) filter (v > 0)), []) as bits, coalesce(sum(case when bit = 63 then -9223372036854775808::hugeint else (1::hugeint << bit::int) end) filter (v > 0), 0)::bigint as code from d group by 1),
 k as materialized (select distinct code, bits from c),
 e as materialized (select a.code as a, b.code as b from k a join k b on a.code <> b.code where len(a.bits) + len(b.bits) - 2 * len(list_intersect(a.bits, b.bits)) <= 3),
 r as (select code as node, code as to_ from k union select r.node, e.b from r join e on r.to_ = e.a), g as (select node, min(to_) as group_code from r group by 1)
select documents.doc_id, code, group_code from documents left join c using (doc_id) left join g on g.node = c.code"""


@query("near_duplicate_groups", GROUPS_SQL)
def near_duplicate_groups(t):
    """Review groups of documents with close 64-bit codes over all their words; a text without words has no code and stays."""
    codes = t.documents.select("doc_id").join(document_codes(t), "doc_id", "left")
    return dedup.near_duplicate_groups(codes, "doc_id", "code", 3)
