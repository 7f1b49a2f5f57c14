"""Balanced building blocks: totals, order and skew."""

import random
import re

from pyspark.sql import functions as F

from curatrix.functions.ids import set_digest
from curatrix.operators import scale


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", rng.randint(0, 50), i) for i in range(n)]
    rows += [(None, 1, n), (None, 0, n + 1)]
    return rows, spark.createDataFrame(rows, "k string, v int, id int")


def test_position_is_a_total_order(spark):
    rows, df = skewed(spark)
    got = {r.id: r["rank"] for r in scale.position(df.repartition(7), [F.col("v").desc(), "id"]).collect()}
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert got == want


def test_position_inside_a_hot_key(spark):
    rows, df = skewed(spark)
    got = {r.id: r["at"] for r in scale.position(df, ["v", "id"], ["k"], "at").collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_nest_chunks_large_keys_and_keeps_every_row(spark):
    rows, df = skewed(spark)
    whole = {r.k: [x.id for x in r["items"]] for r in scale.nest(df, ["k"], ["v", "id"], ["id"]).collect()}
    parts = {}
    for r in scale.nest(df.where("k is not null"), ["k"], ["v", "id"], ["id"], chunk=100).collect():
        assert len(r["items"]) <= 100
        parts[(r.k, r.chunk_no)] = [x.id for x in r["items"]]
    joined = {}
    for (k, _), items in sorted(parts.items()):
        joined.setdefault(k, []).extend(items)
    assert joined == {k: v for k, v in whole.items() if k is not None}
    assert max(c for _, c in parts) > 10


def test_first_values(spark):
    _, df = skewed(spark)
    row = scale.first_values(df, ["k"], "v", 5, "vs").where("k = 'hot'").first()
    assert row.vs == [0, 1, 2, 3, 4] and row.vs_count == 51


def test_top_k_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = scale.top_k(df, ["k"], ["v", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_small_side_only_below_the_limit(spark):
    wide = spark.range(1_000_000).toDF("id")
    plan = wide.join(scale.small_side(wide, 1000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_set_digest_ignores_order_and_partitions(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    a = df.agg(set_digest("s").alias("d")).first().d
    b = df.orderBy(F.rand(3)).repartition(5).agg(set_digest("s").alias("d")).first().d
    c = df.where("id < 999").agg(set_digest("s").alias("d")).first().d
    assert a == b != c


def test_census_continues_large_entities_on_chunk_rows(spark):
    from curatrix.operators import group

    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "k string, name string")
    sets = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "k string, n int")
    parts = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p3"), ("b", "p4")], "k string, p string")
    out = group.nested_census(entities, "k", {"sets": (sets, ["n"], ["n"]), "parts": (parts, ["p"], ["p"])}, chunk=3)
    got = {(r.k, r.chunk_no): ([s.n for s in r.sets], [p.p for p in r.parts], r.name) for r in out.collect()}
    assert got == {("a", 0): ([0, 1, 2], ["p1"], "A"), ("a", 1): ([3, 4, 5], [], "A"), ("a", 2): ([6], [], "A"), ("b", 0): ([1], ["p2", "p3", "p4"], "B"), ("c", 0): ([], [], "C")}


def test_document_codes_count_words_inside_their_row(spark):
    """Rows of one id are added up, null texts give no code, and no row for each word leaves its text."""
    from hashlib import md5
    from types import SimpleNamespace

    from curatrix.plans import ranking

    rows = [(1, "A b  c c"), (1, "d e a"), (2, None), (3, ""), (4, " x y x\tz " * 300), (None, "p q"), (None, "q r r"), (5, None), (5, "w w v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hist = {}
    for i, text in rows:
        if text is not None:
            own = hist.setdefault(i, [0] * 65)
            for word in re.split(r"\s+", text.lower()):
                own[int(md5(word.encode()).hexdigest()[:4], 16) % 65] += 1
    want = {i: sum(1 << b for b in range(64) if h[b] > h[b + 1]) for i, h in hist.items()}
    made = ranking.document_codes(SimpleNamespace(documents=docs))
    assert {r.doc_id: r.code % (1 << 64) for r in made.collect()} == want
    assert "Generate" not in made._jdf.queryExecution().toString()
