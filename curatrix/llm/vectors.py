"""Near duplicates of embeddings: HNSW graphs per shard, every shard queried, links verified in double precision, components united.

Rows are dealt to shards by a hash of id and row, whatever their values, so that no group of copies makes a shard large. A shard folds equal vectors to one node, builds its graph and writes it to the shared
folder. It audits itself: ``audit`` of its nodes, and the same number of vectors turned from nodes to just inside the threshold, are searched and compared with brute force over the shard; the beam doubles until the recall
reaches ``recall``. A shard that does not reach it with a beam of an eighth of its nodes is scanned exactly instead. For every pair of shards (a shard with itself included) each side's nodes
query the other's graph; nodes at or above ``threshold - slack`` are opened beyond the beam, so a beam caps no result. A link needs a cosine of ``threshold`` by the double-precision unit vectors; a pair
counts once, whichever side found it. Links of a pair of shards stay in its task as bits; their counts and a forest of them leave it.

Vectors that are null or empty, hold null or non-finite components or are zero link with nothing; vectors of different length neither. Equal vectors link with one another (cosine 1) and stand for each other
in all links; a row's own id never counts, but another row of equal id does. Components take the smallest non-null id; rows without one keep null. ``kept`` is true where the id equals the component's, or both are null. Rows of
equal id are all returned. Very long vectors only need ``shard_rows`` lowered: a task holds two shards. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curatrix.llm import files, hnsw
from curatrix.llm.components import components
from curatrix.session import materialize


def usable(vector: str) -> Column:
    """Not null nor empty, all components present and finite, and one of them not zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _audited(graph: hnsw.Graph, threshold: float, slack: float, audit: int, wanted: float, seed: int) -> tuple[int, float]:
    """``(beam, recall)``; beam 0 stands for an exact scan."""
    x, rng = graph.units, np.random.default_rng(seed)
    picked = x[rng.permutation(len(x))[:audit]]
    aside = rng.standard_normal(picked.shape).astype(np.float32)
    aside -= np.einsum("ij,ij->i", aside, picked)[:, None] * picked
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    inside = threshold + (1 - threshold) / 8
    turned = inside * picked + np.sqrt(1 - inside * inside) * aside / np.where(length > 0, length, 1)
    queries = np.concatenate([picked, turned.astype(np.float32)])
    truth = queries @ x.T >= threshold
    width, recall = 8, 0.0
    while width * 8 <= max(len(x), 64):
        found = np.zeros_like(truth)
        for i in range(0, len(queries), hnsw.QUERIES):
            q, node = hnsw.neighbours(graph, queries[i: i + hnsw.QUERIES], width, threshold - slack)
            found[i + q, node] = True
        recall = float((found & truth).sum() / max(1, truth.sum()))
        if recall >= wanted:
            return width, recall
        width *= 2
    return 0, 1.0


def index(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, slack: float = 0.02, shard_rows: int = 1 << 14, least_shards: int = 8, audit: int = 64, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """``(key, node, code, copies, dim, shard, name, kind, nodes, beam, recall)`` of all usable rows, materialised; graphs lie in the file ``name`` of the shared folder."""
    spark = vectors.sparkSession
    folder = files.shared_folder(spark, "graphs")
    shards = max(least_shards, -(-vectors.count() // shard_rows))
    dealt = F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    rows = vectors.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), dealt.alias("shard"))

    def run(group: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in group)
        raw = _rows(table.column("vector"), dim) + 0
        distinct, node, copies = np.unique(raw, axis=0, return_inverse=True, return_counts=True)
        node = node.reshape(-1)
        # nodes enter the graph in an order that does not follow their values
        order = np.random.default_rng([seed, dim, shard]).permutation(len(distinct))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        distinct, copies = distinct[order], copies[order]
        graph = hnsw.build(units(distinct).astype(np.float32), seed)
        width, reached = _audited(graph, threshold, slack, audit, recall, seed)
        name = files.unique_name(f"{dim}-{shard}")
        files.write_file(folder, name, graph.dump())
        files.write_file(folder, f"{name}.vectors", distinct.tobytes())
        files.write_file(folder, f"{name}.copies", copies.astype(np.int64).tobytes())
        code = np.int64(dim * shards + shard) << 32
        same = lambda value, kind: pa.array(np.full(table.num_rows, value), kind)
        return pa.table({
            "key": table.column("key"), "node": pa.array(code + place[node]), "code": same(code, pa.int64()), "copies": pa.array(copies[place[node]].astype(np.int64)), "dim": same(dim, pa.int32()),
            "shard": same(shard, pa.int32()), "name": pa.array([f"{folder}/{name}"] * table.num_rows), "kind": pa.array([str(distinct.dtype)] * table.num_rows), "nodes": same(len(distinct), pa.int32()),
            "beam": same(width, pa.int32()), "recall": same(reached, pa.float64())})

    kind = dict(rows.dtypes)["key"]
    return materialize(rows.groupBy("dim", "shard").applyInArrow(run, f"key {kind}, node long, code long, copies long, dim int, shard int, name string, kind string, nodes int, beam int, recall double"))


def audits(indexed: DataFrame) -> DataFrame:
    """One row for each shard: its nodes, its beam and the recall that the audit measured."""
    return indexed.groupBy("dim", "shard").agg(*[F.first(c).alias(c) for c in ("code", "name", "kind", "nodes", "beam", "recall")])


class _Shard:
    def __init__(self, dim: int, name: str, kind: str, beam: int):
        self.exact = units(np.frombuffer(files.read_file(f"{name}.vectors"), dtype=kind).reshape(-1, dim))
        self.copies = np.frombuffer(files.read_file(f"{name}.copies"), dtype=np.int64)
        self.beam, self.rough = beam, self.exact.astype(np.float32)
        self.graph = hnsw.Graph.load(self.rough, files.read_file(name)) if beam else None

    def found(self, queries: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        if self.graph is None:
            return np.nonzero(queries @ self.rough.T >= floor)
        return hnsw.neighbours(self.graph, queries, self.beam, floor)


def _links(a: _Shard, b: _Shard, same: bool, threshold: float, slack: float) -> np.ndarray:
    """Bits (rows: nodes of ``a``) of the verified links."""
    width = -(-len(b.exact) // 8)
    bits = np.zeros(len(a.exact) * width, np.uint8)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), hnsw.PAIRS):
            x, y = i[k: k + hnsw.PAIRS], j[k: k + hnsw.PAIRS]
            good = np.einsum("ij,ij->i", a.exact[x], b.exact[y]) >= threshold
            x, y = x[good], y[good]
            np.bitwise_or.at(bits, x * width + (y >> 3), (128 >> (y & 7)).astype(np.uint8))

    for start in range(0, len(a.exact), hnsw.QUERIES):
        q, node = b.found(a.rough[start: start + hnsw.QUERIES], threshold - slack)
        mark(q + start, node)
        if same:
            mark(node, q + start)
    if not same:
        for start in range(0, len(b.exact), hnsw.QUERIES):
            q, node = a.found(b.rough[start: start + hnsw.QUERIES], threshold - slack)
            mark(node, q + start)
    return bits.reshape(len(a.exact), width)


def _counted(bits: np.ndarray, a: _Shard, b: _Shard, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked rows of each node of ``a`` and of ``b``, and labels that are equal for nodes (``a``, then ``b``) connected here."""
    na, nb = len(a.exact), len(b.exact)
    left, right, label = np.zeros(na, np.int64), np.zeros(nb, np.int64), np.arange(na if same else na + nb)
    shift = 0 if same else na
    for i in np.flatnonzero(bits.any(axis=1)):
        js = np.flatnonzero(np.unpackbits(bits[i], count=nb))
        js = js[js != i] if same else js
        left[i] = b.copies[js].sum()
        right[js] += a.copies[i]
        met = np.unique(np.append(label[js + shift], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return left, right, label


def links(indexed: DataFrame, *, threshold: float = 0.95, slack: float = 0.02) -> DataFrame:
    """``(node, n, root)``: for each pair of shards the rows linked to a node, without its own copies, and a node it is connected with."""
    shards = materialize(audits(indexed))
    numbers = shards.count()
    most = shards.agg(F.max("shard")).first()[0] or 0
    side = lambda x: shards.select(*[F.col(c).alias(f"{c}_{x}") for c in ("dim", "shard", "code", "name", "kind", "beam")])
    pairs = side("a").withColumns({"dim_b": F.col("dim_a"), "shard_b": F.explode(F.sequence("shard_a", F.lit(most)))}).join(side("b"), ["dim_b", "shard_b"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["code_a"] == r["code_b"]
                a = _Shard(r["dim_a"], r["name_a"], r["kind_a"], r["beam_a"])
                b = a if same else _Shard(r["dim_b"], r["name_b"], r["kind_b"], r["beam_b"])
                left, right, label = _counted(_links(a, b, same, threshold, slack), a, b, same)
                node = np.concatenate([r["code_a"] + np.arange(len(left)), [] if same else r["code_b"] + np.arange(len(right))]).astype(np.int64)
                n = left if same else np.concatenate([left, right])
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(n[hit]), pa.array(node[label[hit]])], names=["node", "n", "root"])

    return materialize(pairs.repartition(max(1, numbers * (numbers + 1) // 2)).mapInArrow(run, "node long, n long, root long"))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, slack: float = 0.02, **options) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    indexed = index(vectors, key=key, vector=vector, threshold=threshold, slack=slack, **options)
    met = links(indexed, threshold=threshold, slack=slack)
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    rows = indexed.select("key", "node", "copies").join(counts, "node", "left").join(components(met, "node", "root"), "node", "left")
    rows = rows.select("key", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    least = rows.where("n_links > 0").groupBy("root").agg(F.min("key").alias("least"))
    rest = vectors.where(~usable(vector)).select(F.col(key).alias("key"), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    linked = rows.join(least, "root", "left").select("key", "n_links", F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))
    return linked.unionByName(rest).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def report(vectors: DataFrame, **options) -> DataFrame:
    return near_duplicates(vectors, **options)
