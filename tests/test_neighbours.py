import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import neighbours


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, unit array<double>").repartition(5)


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(seed, groups, each, dim, noise):
    rng = np.random.default_rng(seed)
    return unit(np.repeat(rng.normal(size=(groups, dim)), each, axis=0) + rng.normal(scale=noise, size=(groups * each, dim)))


def plain(x, q, k, same):
    sims = np.round(q @ x.T, 6)
    return {i: [j for j in sorted(range(len(x)), key=lambda j: (-sims[i, j], j)) if not (same and i == j)][:k] for i in range(len(q))}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("leaf, fanout", [(4096, 16), (40, 4)])
def test_equal_brute_force_with_copies(spark, leaf, fanout):
    v = np.concatenate([clustered(1, 5, 30, 8, 0.2), np.repeat(clustered(2, 1, 1, 8, 0), 80, axis=0), clustered(3, 60, 1, 8, 0)])
    df = frame(spark, v)
    assert got(neighbours.nearest_neighbours(df, df, "id", "unit", 4, leaf, fanout)) == plain(v, v, 4, True)


def test_other_queries_and_more_neighbours_than_rows(spark):
    x, q = clustered(4, 8, 20, 6, 0.1), clustered(5, 3, 9, 6, 0.4)
    ids = plain(x, q, 5, False)
    out = got(neighbours.nearest_neighbours(frame(spark, x), frame(spark, q).withColumn("id", F.col("id") + 1000), "id", "unit", 5, 20, 4))
    assert out == {i + 1000: v for i, v in ids.items()}
    few = frame(spark, x[:3])
    assert got(neighbours.nearest_neighbours(few, few, "id", "unit", 5)) == plain(x[:3], x[:3], 5, True)
    none = few.where("id < 0")
    assert neighbours.nearest_neighbours(none, none, "id", "unit").collect() == []


def leaf_pairs(spark, monkeypatch, v, leaf):
    seen, follow = [], neighbours._followed
    monkeypatch.setattr(neighbours, "_followed", lambda *a: seen.append(follow(*a)) or seen[0])
    df = frame(spark, v)
    assert got(neighbours.nearest_neighbours(df, df, "id", "unit", 3, leaf, 8)) == plain(v, v, 3, True)
    monkeypatch.undo()
    return seen[0].count(), seen[0].select("a").distinct().count()


def test_whole_subtrees_are_dropped(spark, monkeypatch):
    """Where vectors have groups, the pairs of leaves that are compared are a small part of all."""
    pairs, leaves = leaf_pairs(spark, monkeypatch, clustered(7, 24, 30, 16, 0.03), 12)
    assert leaves > 100 and pairs < 0.35 * leaves * leaves


def test_vectors_without_groups_meet_in_few_blocks(spark, monkeypatch):
    """No bound drops a pair of these: leaves of at most 40 rows make way for 8 blocks on each side."""
    seen, keep = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    v = clustered(9, 300, 1, 32, 0)
    df = frame(spark, v)
    assert got(neighbours.nearest_neighbours(df, df, "id", "unit", 3, 40, 4)) == plain(v, v, 3, True)
    assert [d.count() for d in seen if d.columns == ["a", "qk", "b", "xk"]] == [64]
