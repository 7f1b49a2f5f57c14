"""Exact nearest neighbours of unit vectors over a metric tree.

The tree splits rows by their nearest pivot until a node holds ``leaf`` rows or one point; every level is one shuffle of the rows that are still to be split, and a node with most of the rows
is split by many tasks. Nodes keep a centre and the largest angle to it. Pairs of nodes (queries, index) are followed from the root to the leaves, and the triangle inequality on angles
drops a pair, with all pairs below it, once no member can beat the neighbours that its queries have already. What is left are block products of bounded size. Without any structure in the vectors
no bound can drop a pair; where the bounds leave more than half of all products the rows are dealt anew, by id into few large blocks, and every pair of blocks is compared. The result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curatrix.operators.scale import small_side, top_k
from curatrix.session import stored

#: Scores that are held at once.
_STRIPE = 4 << 20
#: Blocks on each side, and rows of a block, where all pairs are compared: a row is sent once to each block of the other side, so their number decides what is shuffled.
_SIDE, _BLOCK = 16, 65_536
#: Rounding leaves up to 3e-8 between equal vectors; a node of this radius is not split.
_POINT = 1e-6


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for joins of tables that stem from one another."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _assigned(rows: DataFrame, pivots: DataFrame, sizes: DataFrame, leaf: int) -> DataFrame:
    """``rows(id, unit, node)`` moved to the child of their nearest pivot, with the angle to it; a node is dealt to one task for each ``leaf`` of its rows."""
    parts = F.ceil(F.col("n") / leaf).cast("int")
    dealt = rows.join(small_side(sizes.select("node", parts.alias("parts"))), "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    spread = pivots.join(sizes.select("node", parts.alias("parts")), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["id", "unit", "node"]).append_column("angle", pa.array([], pa.float64()))
        right = right.sort_by("child")
        cosine = _matrix(left.column("unit")) @ _matrix(right.column("centre")).T
        best = cosine.argmax(axis=1)
        return pa.table({"id": left.column("id"), "unit": left.column("unit"), "node": right.column("child").combine_chunks().take(pa.array(best)), "angle": _angle(cosine[np.arange(len(best)), best])})

    kind = dict(rows.dtypes)["id"]
    return _renamed(dealt).groupBy("node", "part").cogroup(_renamed(spread).groupBy("node", "part")).applyInArrow(nearest, f"id {kind}, unit array<double>, node string, angle double")


def _pivots(rows: DataFrame, sizes: DataFrame, fanout: int) -> DataFrame:
    """``(node, child, centre)``: ``fanout`` different points of each node, first in the order of a hash; equal points count once, so that every split makes progress."""
    points = rows.join(small_side(sizes.select("node")), "node", "left_semi").groupBy("node", F.xxhash64("unit").alias("h")).agg(F.min("id").alias("id"))
    picked = top_k(points, ["node"], ["h"], fanout, "at")
    return rows.join(small_side(picked.select("node", "id", "at")), ["node", "id"]).groupBy("node", "at").agg(F.first("unit").alias("centre")).select("node", F.concat_ws(".", "node", F.format_string("%04d", "at")).alias("child"), "centre")


def _grown(index: DataFrame, leaf: int, fanout: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows in their leaves ``(id, unit, node)``, the nodes ``(node, parent, centre, radius)``, and the pivots of each level."""
    rows, kept, nodes, levels = stored(index.withColumn("node", F.lit("r"))), None, None, []
    sizes = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.lit(np.pi).alias("radius")))
    while True:
        split = sizes.where((F.col("n") > leaf) & (F.col("radius") > _POINT))
        if split.isEmpty():
            kept = rows if kept is None else kept.unionByName(rows)
            return kept, nodes, levels
        rest = rows.join(small_side(split.select("node")), "node", "left_anti")
        kept = rest if kept is None else kept.unionByName(rest)
        pivots = stored(_pivots(rows, split, fanout))
        levels.append(pivots)
        moved = stored(_assigned(rows, pivots, split, leaf))
        sizes = stored(moved.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")))
        level = sizes.join(pivots.select(F.col("child").alias("node"), F.col("node").alias("parent"), "centre"), "node").select("node", "parent", "centre", "radius", "n")
        nodes = level if nodes is None else nodes.unionByName(level)
        rows = moved.drop("angle")


def _routed(queries: DataFrame, levels: list[DataFrame], leaf: int) -> tuple[DataFrame, DataFrame | None]:
    """Queries in the leaves of the index and, for every node on their way, the largest angle to its centre."""
    rows, kept, radii = stored(queries.withColumn("node", F.lit("r"))), None, None
    for pivots in levels:
        split = rows.join(small_side(pivots.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        rest = rows.join(small_side(pivots.select("node").distinct()), "node", "left_anti")
        kept = rest if kept is None else kept.unionByName(rest)
        moved = stored(_assigned(rows, pivots, split, leaf))
        level = moved.groupBy("node").agg(F.max("angle").alias("q_radius"))
        radii = level if radii is None else radii.unionByName(level)
        rows = moved.drop("angle")
    return (rows if kept is None else kept.unionByName(rows)), radii


def _best_in_block(k: int):
    """Top-k of one query block against one index block: matrix products of bounded size; ties go to the smaller id."""

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "neighbour_id": [], "cosine": []}
        if len(q) and len(x):
            x = x.sort_values("xid", kind="stable")
            ids, own = x["xid"].to_numpy(), q["id"].to_numpy()
            points, asked = np.stack(x["xunit"].to_numpy()), np.stack(q["unit"].to_numpy())
            stripe = max(1, _STRIPE // len(ids))
            for start in range(0, len(q), stripe):
                scores = np.round(asked[start: start + stripe] @ points.T, 6)
                least = np.partition(scores, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(scores), -2.0)
                row, at = np.nonzero(scores >= least[:, None])
                order = np.lexsort((at, -scores[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                out["query_id"].append(own[start + row])
                out["neighbour_id"].append(ids[at])
                out["cosine"].append(scores[row, at])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    return search


def _slack(cosine):
    """The angle of a cosine, less what rounding to six digits may hide."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine - 1e-6)))


def _above(node: str):
    """The nodes on the way from the root to a node, whose name is that path."""
    steps = F.split(node, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "."))


def _followed(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of leaves that may hold a better neighbour. ``nodes`` has ``node, parent, centre, radius, q_radius``; ``limits``: the worst angle that queries below a node have."""
    known = stored(nodes.join(limits, "node", "left"))
    inner = known.select(F.col("parent").alias("node")).distinct()
    leaves = known.join(inner, "node", "left_anti").withColumn("parent", F.col("node"))
    # A leaf stands below itself, so that pairs of leaves of different depth wait for each other.
    below = stored(known.withColumn("inner", F.lit(True)).unionByName(leaves.withColumn("inner", F.lit(False))))
    inner = stored(inner)
    pairs = below.sparkSession.createDataFrame([("r", "r")], "a string, b string")
    queries = below.where("limit is not null").select(F.col("parent").alias("a"), F.col("node").alias("qa"), F.col("centre").alias("ca"), F.col("q_radius").alias("ra"), "limit")
    index = below.select(F.col("parent").alias("b"), F.col("node").alias("xb"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))

    def near(batches):
        for batch in batches:
            a, b = _matrix(batch.column("ca")), _matrix(batch.column("cb"))
            gap = _angle(np.einsum("ij,ij->i", a, b)) - batch.column("ra").to_numpy() - batch.column("rb").to_numpy()
            keep = pa.array(np.flatnonzero(gap <= batch.column("limit").to_numpy() + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("qa").take(keep), batch.column("xb").take(keep)], names=["a", "b"])

    while True:
        pairs = stored(pairs.join(queries, "a").join(index, "b").mapInArrow(near, "a string, b string"))
        open_ = pairs.join(inner.select(F.col("node").alias("a")), "a", "left_semi").unionByName(pairs.join(inner.select(F.col("node").alias("b")), "b", "left_semi"))
        if open_.isEmpty():
            return pairs


def _nearest_points(index: DataFrame, queries: DataFrame, kind: str, k: int, leaf: int, fanout: int) -> DataFrame:
    """``(query_id, neighbour_id, cosine, rank)`` of points ``(id, unit)``, a query among its own neighbours."""
    x, nodes, levels = _grown(index, leaf, fanout)
    q, radii = (x, None) if queries is index else _routed(queries, levels, leaf)

    def blocked(df: DataFrame, sizes: DataFrame) -> DataFrame:
        return df.join(small_side(sizes.drop("n")), "node").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    count = lambda df, leaf=leaf: stored(df.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
    xs = count(x)
    qs = xs if q is x else count(q)
    schema = f"query_id {kind}, neighbour_id {kind}, cosine double"
    indexed = lambda df, sizes: blocked(df, sizes).select(F.col("node").alias("b"), F.col("blk").alias("xk"), F.col("id").alias("xid"), F.col("unit").alias("xunit"))
    xb = indexed(x, xs)
    # First look: one block of the query's own leaf.
    first = _renamed(blocked(q, xs)).groupBy("node", "blk").cogroup(_renamed(xb).groupBy("b", "xk")).applyInPandas(_best_in_block(k), schema)
    if nodes is None:
        if xs.where("blocks > 1").isEmpty():
            return top_k(first, ["query_id"], [F.col("cosine").desc(), "neighbour_id"], k, "rank")
        pairs = xs.select(F.col("node").alias("a"), F.col("node").alias("b"))
    else:
        bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("cosine").alias("kth"))
        angle = F.when(F.coalesce("c", F.lit(0)) < k, F.lit(np.pi)).otherwise(_slack(F.col("kth")))
        worst = stored(q.join(bound, F.col("id") == F.col("query_id"), "left").groupBy("node").agg(F.max(angle).alias("limit")))
        # The names of nodes are paths. Any node above a query with k rows bounds it too: all of them lie within its own angle to the centre and the radius.
        figures = stored(nodes.withColumn("q_radius", F.col("radius")) if radii is None else nodes.join(radii, "node", "left"))
        paths = worst.select(F.col("node").alias("leaf"), "limit", F.explode(_above("node")).alias("node")).join(figures.select("node", F.when((F.col("n") >= k) & (F.col("q_radius") + F.col("radius") < np.pi), _slack(F.cos(F.col("q_radius") + F.col("radius")))).alias("reach")), "node", "left")
        tight = paths.groupBy("leaf").agg(F.least(F.first("limit"), F.min("reach")).alias("limit"))
        limits = tight.select(F.explode(_above("leaf")).alias("node"), "limit").groupBy("node").agg(F.max("limit").alias("limit"))
        pairs = _followed(figures, limits)
        total = lambda sizes: sizes.agg(F.sum("n")).first()[0] or 0
        n_q, n_x = total(qs), total(xs)
        left = pairs.join(qs.select(F.col("node").alias("a"), F.col("n").alias("qn")), "a").join(xs.select(F.col("node").alias("b"), F.col("n").alias("xn")), "b")
        if 2 * (left.agg(F.sum(F.col("qn") * F.col("xn"))).first()[0] or 0) > n_q * n_x:
            whole = lambda df, n: (df.withColumn("node", F.lit("r")), min(max(leaf, -(-n // _SIDE)), _BLOCK))
            (x, x_leaf), (q, q_leaf) = whole(x, n_x), whole(q, n_q)
            xs, qs = count(x, x_leaf), count(q, q_leaf)
            xb = indexed(x, xs)
            pairs = xs.select(F.col("node").alias("a"), F.col("node").alias("b"))
    tasks = pairs.join(qs.select(F.col("node").alias("a"), F.col("blocks").alias("qn")), "a").join(xs.select(F.col("node").alias("b"), F.col("blocks").alias("xn")), "b")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = stored(tasks.withColumn("qk", numbers("qn")).withColumn("xk", numbers("xn")).select("a", "qk", "b", "xk"))
    on = ["a", "qk", "b", "xk"]
    left = blocked(q, qs).select(F.col("node").alias("a"), F.col("blk").alias("qk"), "id", "unit").join(tasks, ["a", "qk"])
    right = xb.join(tasks, ["b", "xk"])
    found = _renamed(left).groupBy(*on).cogroup(_renamed(right).groupBy(*on)).applyInPandas(_best_in_block(k), schema)
    return top_k(found, ["query_id"], [F.col("cosine").desc(), "neighbour_id"], k, "rank")


def _points(df: DataFrame, n: int) -> DataFrame:
    """``(unit, id, ids)``: equal vectors are one point with its ``n`` smallest ids; each task keeps as many before the shuffle."""
    return top_k(df, ["unit"], ["id"], n, "at").groupBy("unit").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))


def nearest_neighbours(index: DataFrame, queries: DataFrame, ident: str, unit: str, k: int = 5, leaf: int = 4096, fanout: int = 16) -> DataFrame:
    """``(query_id, neighbour_id, cosine, rank)``: exact top-k by cosine, rounded to six digits; ties go to the smaller id; a query is not its own neighbour.

    Equal vectors are searched once. ``leaf`` bounds the rows of a block, ``fanout`` the children of a node; both change the work, never the result.
    """
    kind = dict(index.dtypes)[ident]
    named = lambda df: df.select(F.col(ident).alias("id"), F.col(unit).alias("unit"))
    asked = named(queries)
    # One more than k: the query itself is taken out at the end.
    points = stored(_points(named(index), k + 1))
    x = points.select("id", "unit")
    q = x if queries is index else stored(_points(asked, 1)).select("id", "unit")
    found = _nearest_points(x, q, kind, k + 1, leaf, fanout)
    ids = points.select(F.col("id").alias("neighbour_id"), "ids")
    best = top_k(found.drop("rank").join(ids, "neighbour_id").select("query_id", "cosine", F.explode("ids").alias("neighbour_id")), ["query_id"], [F.col("cosine").desc(), "neighbour_id"], k + 1, "at")
    packed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "neighbour_id", "cosine"))).alias("best"))
    own = asked.join(q.select(F.col("id").alias("query_id"), "unit"), "unit").join(packed, "query_id")
    kept = F.slice(F.filter("best", lambda b: b["neighbour_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "b")).select("query_id", "b.neighbour_id", "b.cosine", (F.col("at") + 1).cast("int").alias("rank"))
