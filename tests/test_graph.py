import hashlib
import json
import random

import pytest

from curatrix.operators import graph
from conftest import values


def union_find(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in list(parent)}


@pytest.mark.parametrize("seed, n, m", [(1, 200, 120), (2, 300, 250), (3, 60, 0)])
def test_components_equal_union_find(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(0, i) for i in range(1, n // 3)] if m else []
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node int")
    got = dict(values(graph.connected_components(nodes, spark.createDataFrame(edges, "src int, dst int")), "node", "component"))
    want = union_find(edges)
    assert got == {i: want.get(i, i) for i in range(n)}


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    nodes = spark.createDataFrame([(i,) for i in range(201)], "node int")
    assert {c for _, c in values(graph.connected_components(nodes, spark.createDataFrame(edges, "src int, dst int")), "node", "component")} == {0}


def test_components_of_many_tasks(spark, monkeypatch):
    """With few links to a task the stars take over; a hub, a chain and random links."""
    monkeypatch.setattr(graph, "TASK_LINKS", 40)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(60)] + [(200 + rng.randrange(150), 200 + rng.randrange(150)) for _ in range(110)]
    nodes = spark.createDataFrame([(i,) for i in range(360)], "node int")
    got = dict(values(graph.connected_components(nodes, spark.createDataFrame(edges, "src int, dst int")), "node", "component"))
    want = union_find(edges)
    assert got == {i: want.get(i, i) for i in range(360)}


def test_deep_hierarchies_take_few_rounds(spark, monkeypatch):
    rounds, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rounds.append(1) or real(df))
    df = spark.createDataFrame([(str(i), str(i - 1) if i else "", f"n{i}") for i in range(1000)] + [("a", "c", "a"), ("b", "a", "b"), ("c", "b", "c"), ("d", "a", "d")], "id string, parent_id string, name string")
    got = {r.id: [x.id for x in r.lineage] for r in graph.ancestry(df, "id", "parent_id", "name").collect()}
    assert all(got[str(i)] == [str(j) for j in range(i, -1, -1)] for i in range(0, 1000, 37)) and len(rounds) <= 12
    assert (got["a"], got["b"], got["d"]) == (["a", "c", "b"], ["b", "a", "c"], ["d", "a", "c", "b"])
    rounds.clear()
    refs = [("root" if i == 0 else f"p{i - 1}", f"p{i}", 1, move(1.0)) for i in range(300)] + [("u", "v", 1, move(0.0)), ("v", "u", 1, move(0.0))]
    out, missing = hierarchy(spark, refs, ["root", "u", "v", *[f"p{i}" for i in range(300)]])
    assert {r.part: (r.depth, r.m[3]) for r in out.select("part", "depth", "m").collect()} == {"root": (0, 0.0)} | {f"p{i}": (i + 1, i + 1.0) for i in range(300)}
    assert len(rounds) <= 24 and missing.count() == 0


FIELDS = ["sha256", "source_reference_asset_id", "duplicate_cluster_id"]
SCHEMA = "derived_asset_id string, outfit_design_id string, sha256 string, source_reference_asset_id string, duplicate_cluster_id string"
ROWS = [("1", "A", "h1", "s1", None), ("2", "B", "h1", "s2", "c9"), ("3", "C", "h3", "s3", "c9"), ("4", "D", "h4", "s4", None)]


def groups(spark, rows, **kw):
    return graph.grouped_split(graph.connected_groups(spark.createDataFrame(rows, SCHEMA), "derived_asset_id", "outfit_design_id", FIELDS, **kw))


def test_groups_are_transitive_and_ordered(spark):
    got = {r.derived_asset_id: (r.component_id, r.split) for r in groups(spark, ROWS).collect()}
    assert got["1"] == got["2"] == got["3"] != got["4"]
    members = [hashlib.sha256(json.dumps(["group", g], separators=(",", ":")).encode()).hexdigest() for g in "ABC"]
    low, high = (sum(int(m[a:b], 16) for m in members) for a, b in ((0, 15), (15, 30)))
    assert got["1"][0] == hashlib.sha256(f"3|{low}|{high}".encode()).hexdigest()
    again = {r.derived_asset_id: (r.component_id, r.split) for r in groups(spark, ROWS[::-1]).collect()}
    assert again == got
    more = {r.derived_asset_id: (r.component_id, r.split) for r in groups(spark, [*ROWS, ("5", "A", "h1", "s1", None)]).collect()}
    assert more["5"] == got["1"]


def test_missing_group_raises_unless_fallback(spark):
    rows = [*ROWS, ("6", None, "h6", "s6", None)]
    with pytest.raises(Exception, match="missing outfit_design_id for 6"):
        groups(spark, rows).collect()
    got = {r.derived_asset_id: r for r in groups(spark, rows, fallback="source_reference_asset_id").collect()}
    assert got["6"].used_fallback and got["6"].group_id == "s6" and not got["1"].used_fallback


def test_component_digests_have_one_formula(spark):
    labels = spark.createDataFrame([(f"n{i}", "c") for i in range(500)] + [("m", "d")], "node string, component string")
    a = dict(values(graph.component_digests(labels), "component", "component_id"))
    b = dict(values(graph.component_digests(labels.repartition(9)), "component", "component_id"))
    h = hashlib.sha256(b"m").hexdigest()
    assert a == b and a["c"] != a["d"] == hashlib.sha256(f"1|{int(h[:15], 16)}|{int(h[15:30], 16)}".encode()).hexdigest()


def test_ancestry_survives_cycles_and_missing_parents(spark):
    rows = [("1", "", "root"), ("2", "1", "mid"), ("3", "2", "leaf"), ("8", "9", "a"), ("9", "8", "b"), ("5", "77", "lost"), ("6", "6", "self")]
    df = spark.createDataFrame(rows, "id string, parent_id string, name string")
    got = {r.id: [x.id for x in r.lineage] for r in graph.ancestry(df, "id", "parent_id", "name").collect()}
    assert got == {"1": ["1"], "2": ["2", "1"], "3": ["3", "2", "1"], "8": ["8", "9"], "9": ["9", "8"], "5": ["5"], "6": ["6"]}


def move(x, y=0.0, z=0.0, flip=False):
    return [-1.0 if flip else 1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, y, 0.0, 0.0, 1.0, z]


def hierarchy(spark, refs, parts, **kw):
    r = spark.createDataFrame(refs, "parent string, child string, line_no int, m array<double>")
    return graph.flatten_hierarchy(spark.createDataFrame([("root",)], "part string"), r, spark.createDataFrame([(p,) for p in parts], "part string"), **kw)


def test_transforms_compose_and_mirrors_flip(spark):
    out, missing = hierarchy(spark, [("root", "arm", 1, move(1.0)), ("arm", "hand", 1, move(2.0, flip=True)), ("root", "hand", 2, move(5.0))], ["root", "arm", "hand"])
    got = sorted((r.part, r.depth, r.m[3], r.flip) for r in out.collect())
    assert got == [("arm", 1, 1.0, False), ("hand", 1, 5.0, False), ("hand", 2, 3.0, True), ("root", 0, 0.0, False)]
    assert missing.count() == 0


def test_cycles_and_missing_parts_raise(spark):
    with pytest.raises(ValueError, match="cyclic"):
        hierarchy(spark, [("root", "a", 1, move(0.0)), ("a", "root", 1, move(0.0))], ["root", "a"])
    with pytest.raises(FileNotFoundError):
        hierarchy(spark, [("root", "gone", 1, move(0.0))], ["root"])
    _, missing = hierarchy(spark, [("root", "gone", 1, move(0.0))], ["root"], strict_missing=False)
    assert values(missing, "parent", "child") == [("root", "gone")]


def test_corpus_and_cohort_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "corpus string, k int")
    with pytest.raises(Exception, match="corpus without a split"):
        graph.corpus_split(df, "corpus", {"a": "train"}).collect()
    bad = graph.cohort_violations(spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "k string"), spark.createDataFrame([("y",)], "k string"), "k")
    assert values(bad, "k", "occurrences", "in_baseline") == [("x", 2, False), ("y", 1, True)]
