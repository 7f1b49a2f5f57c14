import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import hnsw, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(seed, dim, single, groups):
    """Random directions, and groups of rows around one of them at cosines on both sides of the limit."""
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((single, dim)))
    for size, noise in groups:
        centre = rng.standard_normal(dim)
        rows += [centre + noise * rng.standard_normal(dim) for _ in range(size)]
    return [(i, [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(rng.permutation(len(rows)))]


def plain(rows, threshold=0.95):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    units = [None if not ok(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, n[i], least.get(find(i)), k == least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def result(frame, **options):
    return sorted((tuple(r) for r in vectors.near_duplicates(frame, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, v, 1) for k, v in rows], schema).repartition(4)


def test_against_brute_force(spark):
    rows = clusters(1, 16, 700, [(2, 0.1)] * 20 + [(40, 0.12), (90, 0.2), (150, 0.03)])
    rows += [(2000 + i, rows[3][1]) for i in range(300)] + [(2400, [2 * x for x in rows[3][1]]), (2401, [-x for x in rows[3][1]])]
    want = plain(rows)
    assert result(frame_of(spark, rows), shard_rows=300, least_shards=1) == want
    assert result(frame_of(spark, rows), least_shards=2) == want
    assert sum(r[1] for r in want) > 90_000


def test_odd_vectors_ids_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [-0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0]), (9, [2.0, -0.0]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 3e38]), (13, [1e38, 1e38])]
    frame = frame_of(spark, rows).withColumns({"node": F.lit(1), "Key": F.lit(2), "shard": F.lit("x"), "n_links": F.lit(9), "dim": F.lit(0)})
    assert result(frame) == plain(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(frame_of(spark, [(1, None), (2, None)])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_double_vectors_and_other_threshold(spark):
    rows = clusters(5, 8, 100, [(30, 0.3)])
    assert result(frame_of(spark, rows, "vec_id long, embedding array<double>, label int"), threshold=0.8, shard_rows=50) == plain(rows, 0.8)


def test_audits_measure_recall(spark):
    rows = clusters(7, 32, 3000, [(2, 0.05)] * 100)
    indexed = vectors.index(frame_of(spark, rows), least_shards=3)
    seen = vectors.audits(indexed).collect()
    assert len(seen) == 3 and sum(r.nodes for r in seen) == len(rows) and all(r.recall >= 0.99 and r.beam >= 8 for r in seen)


@pytest.mark.parametrize("n", [1, 2, 13, 700])
def test_graph_finds_itself(n):
    x = vectors.units(np.random.default_rng(n).standard_normal((n, 12))).astype(np.float32)
    graph = hnsw.build(x)
    q, node = np.concatenate([np.stack(hnsw.neighbours(graph, x[i: i + 256], 32, 0.999)) + [[i], [0]] for i in range(0, n, 256)], axis=1)
    assert (q == node).sum() >= 0.99 * n
    again = hnsw.Graph.load(x, graph.dump())
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers, strict=True))


def test_shard_that_fails_its_audit_is_scanned(spark, monkeypatch):
    x = vectors.units(np.random.default_rng(3).standard_normal((400, 6))).astype(np.float32)
    graph = hnsw.build(x)
    graph.layers[0][:] = -1
    assert vectors._audited(graph, 0.95, 0.02, 64, 0.99, 1) == (0, 1.0)
