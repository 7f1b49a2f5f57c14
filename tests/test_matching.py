"""Blocked matching equals brute force, also when words are frequent."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions import rules
from curatrix.operators import matching

WORDS = ["red", "blue", "wizard", "knight", "captain", "robot", "old", "ice", "lizard", "queen", "spaceman", "pirate"]


def names(seed, n):
    rng = random.Random(seed)
    return [(i, sorted(rng.sample(WORDS, rng.randint(1, 4))), rng.choice(["head", "torso", "other", "arm"])) for i in range(n)]


def token_score(a, b, same):
    shared = set(a) & set(b)
    if not shared:
        return 0.0
    s = len(shared) / len(set(a) | set(b))
    if len(shared) >= 2:
        s += 0.15
    elif len(next(iter(shared))) >= 6:
        s += 0.05
    s = min(s, 1.0)
    return round(min(1.0, s + 0.12) if same else s, 4)


@pytest.mark.parametrize("limit", [1000, 5])
def test_fuzzy_topk_equals_brute_force(spark, limit):
    left, right = names(1, 60), [r for r in names(2, 150) if r[2] != "arm"]
    schema = "id int, words array<string>, block string"
    ldf = spark.createDataFrame(left, schema).withColumnRenamed("id", "lid")
    rdf = spark.createDataFrame(right, schema).withColumnRenamed("id", "rid")
    got = {}
    for r in matching.fuzzy_topk(ldf, rdf, "lid", "rid", block="block", frequency_limit=limit).collect():
        got.setdefault(r.lid, []).append((r["rank"], r.rid, round(r.score, 4)))
    pools = {b for _, _, b in right}
    want = {}
    for lid, words, block in left:
        pool = [x for x in right if x[2] == block] if block in pools else [x for x in right if x[2] != "other"]
        scored = [(-token_score(words, w, b == block), rid) for rid, w, b in pool]
        best = [(s, rid) for s, rid in sorted(scored) if -s >= 0.18][:5]
        if best:
            want[lid] = [(i, rid, round(-s, 4)) for i, (s, rid) in enumerate(best, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("limit", [1000, 4])
def test_composite_equals_brute_force(spark, limit):
    rng = random.Random(5)
    make = lambda: " ".join(rng.sample(WORDS, rng.randint(1, 4)))
    left, right = [(i, make()) for i in range(40)], [(i, make()) for i in range(200)]
    ldf = spark.createDataFrame(left, "lid int, text string").withColumn("words", F.split("text", " ")).withColumn("core", F.slice("words", 1, 2))
    rdf = spark.createDataFrame(right, "rid int, text string").withColumn("words", F.split("text", " "))
    out = matching.top_matches(ldf, rdf, "lid", "rid", "words", matching.composite_score(rules.sequence_ratio), 5, [], ["text", "core"], frequency_limit=limit,
                               bound=matching.composite_bound, right_columns=["text"])
    got = {}
    for r in out.collect():
        got.setdefault(r.lid, []).append((r["rank"], r.rid, round(r.score, 4)))

    def score(a, b):
        x, y = set(a.split()), set(b.split())
        core = a.split()[:2]
        n = len(x & y)
        return round(0.35 * n / len(x) + 0.25 * n / len(x | y) + 0.20 * difflib.SequenceMatcher(None, a, b).ratio() + 0.20 * sum(t in y for t in core) / len(core), 4)

    for lid, a in left:
        scored = sorted((-score(a, b), rid) for rid, b in right if set(a.split()) & set(b.split()))[:5]
        have = sorted(got.get(lid, []))
        assert [rid for _, rid, _ in have] == [rid for _, rid in scored]
        assert all(abs(h[2] + s[0]) < 2e-4 for h, s in zip(have, scored))


def test_subject_ladder(spark):
    cases = [(["mia"], ["mia"], [], [], 0.79), (["magician"], ["mia", "magician"], [], [], 0.42), (["tim"], ["tim", "murphy"], [], [], 0.0),
             (["a1", "b2"], ["a1", "b2", "c3"], [], [], 0.86), (["a1", "b2", "c3"], ["a1", "b2"], [], [], 0.70), (["a1", "b2"], ["a1", "b2"], [1999], [1999], 0.96), (["a1", "b2"], ["a1", "b2"], [1999], [2001], 0.76)]
    df = spark.createDataFrame([(a, b, y, z) for a, b, y, z, _ in cases], "lwords array<string>, rwords array<string>, years array<int>, r_years array<int>")
    got = [r.score for r in matching.subject_score(("cmf",))(df).collect()]
    assert got == [c[-1] for c in cases]


def test_equal_names_do_not_multiply_pairs(spark):
    same = spark.range(400).select(F.col("id").alias("lid"), F.array(F.lit("clone"), F.lit("trooper")).alias("words"))
    out = matching.fuzzy_topk(same, same.withColumnRenamed("lid", "rid"), "lid", "rid")
    assert out.count() == 2000 and out.select("rid").distinct().count() == 5


def test_subsets(spark):
    got = spark.range(1).select(matching._subsets(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("s")).first().s
    assert sorted(got) == sorted(" ".join(c) for n in (1, 2, 3) for c in itertools.combinations("abc", n))


def test_bands(spark):
    df = spark.createDataFrame([(0.9, 0.2), (0.9, 0.01), (0.8, 0.06), (0.5, 0.5)], "t double, m double")
    assert [r.b for r in df.select(matching.composite_band("t", "m").alias("b")).collect()] == ["strong_candidate", "unresolved", "review_candidate", "unresolved"]


@pytest.mark.parametrize("crowded", [1_000_000, 10])
def test_code_crosswalk_with_a_crowded_code(spark, crowded):
    from curatrix.operators import joins

    rng = random.Random(9)
    label = lambda: " ".join(rng.sample(WORDS, rng.randint(1, 3)))
    rel = [(i, "HOT" if i % 3 else f"C{i % 7}", label()) for i in range(60)]
    cat = [("HOT" if i % 2 else f"C{i % 5}", label()) for i in range(80)]
    out = joins.code_crosswalk(spark.createDataFrame(rel, "id int, code string, name string"), spark.createDataFrame(cat, "code string, cname string"), "id", "code", "name", "cname", crowded=crowded)
    got = {r.id: (r.match_count, r.max_name_overlap, r.identity_consistency) for r in out.collect()}
    for i, code, name in rel:
        found = [c for k, c in cat if k == code]
        best = max([round(len(set(name.split()) & set(c.split())) / len(set(name.split()) | set(c.split())), 4) for c in found], default=None)
        want = "no_catalog_match" if not found else "name_supportive" if best >= 0.35 else "serial_match_name_needs_review"
        assert got[i] == (len(found), best, want)


@pytest.mark.parametrize("limit", [1000, 3])
def test_subject_match_with_years_equals_brute_force(spark, limit):
    rng = random.Random(11)
    pick = lambda lo, hi: sorted(rng.sample(WORDS[:7], rng.randint(lo, hi)))
    left = [(i, pick(1, 3), [1990 + rng.randint(0, 3)] if i % 4 else []) for i in range(50)]
    right = [(i, pick(1, 4), [1990 + rng.randint(0, 5)]) for i in range(160)]
    generic = ("old", "ice")
    ldf = spark.createDataFrame(left, "lid int, words array<string>, years array<int>")
    rdf = spark.createDataFrame(right, "rid int, words array<string>, years array<int>").withColumn("specific", F.size(F.filter("words", lambda w: ~w.isin(*generic))))
    out = matching.top_matches(ldf, rdf, "lid", "rid", "words", matching.subject_score(generic), 6, ["specific"], ["years"], right_columns=["years"], bonus="years", frequency_limit=limit)
    got = {}
    for r in out.collect():
        got.setdefault(r.lid, []).append((r["rank"], r.rid, round(r.score, 4)))

    def score(a, b, ya, yb):
        s, t = set(a), set(b)
        shared = s & t
        if not shared:
            return 0.0
        long_word = 0.42 if len(min(shared)) >= 7 else 0.0
        if s <= t:
            v = (0.79 if t - s <= set(generic) else long_word) if len(s) == 1 else min(1.0, 0.72 + 0.07 * len(s))
        elif len(shared) >= 2:
            v = min(0.88, 0.30 + 0.45 * len(shared) / len(s) + 0.05 * len(shared))
        else:
            v = long_word
        if v and ya:
            v = max(0.0, min(1.0, v + (0.10 if set(ya) & set(yb) else -0.10)))
        return round(v, 4)

    for lid, a, ya in left:
        scored = sorted((-score(a, b, ya, yb), rid) for rid, b, yb in right)
        want = [(i, rid, -s) for i, (s, rid) in enumerate([x for x in scored if x[0] < 0][:6], 1)]
        assert sorted(got.get(lid, [])) == want


def test_combinations(spark):
    words = F.array(*[F.lit(w) for w in "abcd"])
    row = spark.range(1).select(matching._combinations(words, 2).alias("p"), matching._combinations(words, 3).alias("t")).first()
    assert sorted(row.p) == sorted(" ".join(c) for c in itertools.combinations("abcd", 2))
    assert sorted(row.t) == sorted(" ".join(c) for c in itertools.combinations("abcd", 3))


def test_names_with_many_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(matching, "MAX_FREQUENT", 2)
    test_fuzzy_topk_equals_brute_force(spark, 5)
    test_composite_equals_brute_force(spark, 4)
