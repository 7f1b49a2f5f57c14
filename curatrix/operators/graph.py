"""Hierarchies, connected components and grouped splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curatrix.functions.ids import hash_fraction_split, set_digest
from curatrix.session import stored


def ancestry(df: DataFrame, ident: str, parent: str, label: str) -> DataFrame:
    """Leaf-to-root lineage ``array<struct<id,name>>`` per node; stops at a cycle or a missing parent.

    Pointer doubling: a round appends to each lineage the one of the node it stops at, so that a chain of n nodes takes about log2(n) equi-joins. Finished lineages leave the
    working set, and one that runs into itself is cut where it does; there is no limit of depth.
    """
    nodes = df.select(F.col(ident).alias("leaf"), F.col(ident).cast("string").alias("id"), F.nullif(F.col(parent).cast("string"), F.lit("")).alias("up"), F.col(label).alias("name")).dropDuplicates(["leaf"])
    paths = stored(nodes.select("leaf", "id", F.array(F.struct("id", "name")).alias("lineage"), "up"))
    done = []
    while True:
        further = paths.select(F.col("id").alias("up"), F.col("lineage").alias("rest"), F.col("up").alias("further"))
        joined = paths.where("up is not null").join(further, "up", "left")
        ids = lambda c: F.transform(c, lambda s: s["id"])
        again = F.array_min(F.transform(F.array_intersect(ids("lineage"), ids("rest")), lambda x: F.array_position(ids("rest"), x)))
        grown = F.when(F.col("rest").isNull(), F.col("lineage")).otherwise(F.concat("lineage", F.when(again.isNull(), F.col("rest")).otherwise(F.slice("rest", F.lit(1), F.coalesce(again, F.lit(1)) - 1))))
        # A lineage goes on unless it met itself, or the node it stops at is missing or finished.
        moved = joined.select("leaf", "id", grown.alias("lineage"), F.when(F.col("rest").isNotNull() & again.isNull(), F.col("further")).alias("up"))
        paths = stored(moved.unionByName(paths.where("up is null")))
        if paths.where("up is not null").isEmpty():
            return paths.select(F.col("leaf").alias(ident), "lineage")


#: Links that one task contracts; 16 bytes each.
TASK_LINKS = 2_000_000


def folded(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted nodes of links and, for each, the place of the least node it is connected with."""
    nodes, ends = np.unique(np.stack([u, v]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, root
        root = new


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Every node of ``links(u, v)`` of a task with the least node it is connected with there: at most one link for each node and task leaves it."""

    def run(batches):
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if parts:
            nodes, root = folded(*np.concatenate(parts, axis=1))
            inner = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], names=["u", "v"])

    return links.select("u", "v").repartition(tasks, "v").mapInArrow(run, "u long, v long")


def _roots(links: DataFrame) -> DataFrame:
    """``(u, v)``: every linked node with the least node of its component, itself included, over 64-bit ids.

    Links are dealt by their lower end and contracted in their task; where one task holds them all that is the result. Otherwise alternating stars follow: a star is a min-aggregate and one join, what leaves
    it is contracted again, and a round that changes nothing ends the loop.
    """
    links, digest = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        tasks = -(-links.count() // TASK_LINKS)
        links = stored(_contracted(links, max(1, tasks)))
        row = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if tasks <= 1 or row == digest:
            least = links.groupBy("u").agg(F.min("v").alias("v"))
            return least.unionByName(least.select(F.col("v").alias("u"), "v").distinct())
        digest = row
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        star = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        links = stored(star.where("u <> v").distinct())


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)``: the number of the component of every node; nodes are numbered once, and rounds move numbers only."""
    numbered = stored(nodes.distinct().withColumn("u", F.monotonically_increasing_id()))
    end = lambda c: numbered.select(F.col("node").alias(c), F.col("u").alias(f"{c}_n"))
    pairs = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_n").alias("u"), F.col("dst_n").alias("v"))
    return stored(numbered.join(_roots(pairs), "u", "left").select("node", F.coalesce("v", "u").alias("root")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component as its label."""
    labels = _labelled(nodes.select("node"), edges)
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def connected_groups(
    records: DataFrame, record: str, group: str, fields: Sequence[str], fallback: str | None = None,
) -> DataFrame:
    """Transitive closure over a group id and duplicate fields: ``(record, group_id, used_fallback, component_id)``.

    ``component_id`` digests the set of group members; independent of row order, of repeated
    occurrences and of the number of members. A missing group raises unless a ``fallback`` column is named.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    given = blank(group)
    if fallback is None:
        stop = F.raise_error(F.concat(F.lit(f"missing {group} for "), F.col(record).cast("string"))).cast("string")
        gid, kind = F.coalesce(given, stop), F.lit("group")
    else:
        gid = F.coalesce(given, blank(fallback), F.col(record).cast("string"))
        kind = F.when(given.isNull(), "fallback").otherwise("group")
    node = lambda k, v: F.to_json(F.array(k, v))
    base = records.select(F.col(record), gid.alias("group_id"), kind.alias("_kind"), *[blank(f).alias(f) for f in fields])
    base = base.withColumn("node", node(F.col("_kind"), F.col("group_id")))
    members = base.select("node").distinct()
    # Duplicate keys fold before they become edges: one edge per (group, value).
    values = F.explode(F.array(*[F.when(F.col(f).isNotNull(), node(F.lit(f), F.col(f))) for f in fields]))
    edges = base.select(F.col("node").alias("src"), values.alias("dst")).where("dst is not null").distinct()
    nodes = members.unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = _labelled(nodes, edges).withColumnRenamed("root", "component").join(members, "node", "left_semi")
    ids = component_digests(labels)
    return (
        base.join(labels.join(ids, "component").select("node", "component_id"), "node")
        .select(record, "group_id", (F.col("_kind") == "fallback").alias("used_fallback"), "component_id"))


def component_digests(labels: DataFrame) -> DataFrame:
    """One digest of the member set per component; the same formula, and constant state, for every size."""
    return labels.groupBy("component").agg(set_digest("node").alias("component_id"))


def grouped_split(groups: DataFrame, component: str = "component_id", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    return groups.withColumn("split", hash_fraction_split(component, train, validation))


def leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that appear in more than one split."""
    return df.groupBy(group).agg(
        F.count_distinct(split).alias("split_count"), F.count(F.lit(1)).alias("records")).where("split_count > 1")


def corpus_split(df: DataFrame, corpus: str, assignment: dict[str, str]) -> DataFrame:
    """Fixed split per corpus; an unknown corpus raises."""
    table = F.create_map(*[F.lit(x) for kv in assignment.items() for x in kv])
    stop = F.raise_error(F.concat(F.lit("corpus without a split: "), F.coalesce(F.col(corpus), F.lit("null")))).cast("string")
    return df.withColumn("split", F.coalesce(F.try_element_at(table, F.col(corpus)), stop))


def cohort_violations(challenge: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Challenge keys that repeat or also occur in the baseline."""
    counts = challenge.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = counts.join(baseline.select(key).distinct().withColumn("_b", F.lit(True)), key, "left")
    overlap = F.coalesce("_b", F.lit(False))
    return hit.where((F.col("n") > 1) | overlap).select(
        key, F.col("n").alias("occurrences"), overlap.alias("in_baseline"))


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def compose(parent: str, child: str):
    """Product of two 3x4 affine matrices held as 12-element arrays."""
    p, c = F.col(parent), F.col(child)
    at = lambda m, r, k: F.get(m, F.lit(r * 4 + k))
    cells = []
    for r in range(3):
        for k in range(4):
            value = at(p, r, 0) * at(c, 0, k) + at(p, r, 1) * at(c, 1, k) + at(p, r, 2) * at(c, 2, k)
            cells.append(value + at(p, r, 3) if k == 3 else value)
    return F.array(*cells)


def determinant(matrix: str):
    m = lambda r, k: F.get(F.col(matrix), F.lit(r * 4 + k))
    return (
        m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0))
        + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def flatten_hierarchy(roots: DataFrame, refs: DataFrame, known: DataFrame, strict_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Expand ``refs(parent, child, line_no, m, invert)`` below ``roots(part)``.

    Gives ``(root, part, path, m, flip, depth)`` per occurrence with composed transforms and winding flips, and
    the missing references. A cycle below a root raises; so does a missing part when ``strict_missing``.

    Pointer doubling: round r holds the chains of exactly 2^r references and appends them to all occurrences less than 2^r deep, so that a nesting of depth d takes about log2(d) rounds. A chain that meets itself is kept
    as a loop and not prolonged: it raises if an occurrence reaches it. Below the first reference every parent is some reference's child, so only such references are doubled.
    """
    if "invert" not in refs.columns:
        refs = refs.withColumn("invert", F.lit(False))
    parts = known.select(F.col("part").alias("child")).distinct()
    # Boolean exclusive or, written as inequality.
    turned = F.coalesce("invert", F.lit(False)) != (determinant("m") < 0)
    steps = refs.select(F.col("parent").alias("top"), "child", F.array("child").alias("tail"), "m", turned.alias("turn"), (F.col("parent") == F.col("child")).alias("loop"))
    # Children that are not known are looked for once, by name; where there are none, no reference has to meet the parts.
    children = stored(refs.select("child").distinct())
    unknown = stored(children.join(parts, "child", "left_anti"))
    complete = unknown.isEmpty()
    if not complete:
        steps = steps.where("child is not null").join(unknown, "child", "left_anti")
    at_root = roots.select(F.col("part").alias("root"), "part", F.array("part").alias("path"), F.array(*[F.lit(x) for x in IDENTITY]).alias("m"), F.lit(False).alias("flip"), F.lit(0).alias("depth"))

    def placed(found: DataFrame, chains: DataFrame) -> DataFrame:
        grown = found.withColumnRenamed("m", "pm").join(chains.withColumnsRenamed({"m": "cm", "top": "part"}), "part")
        looped = F.col("loop") | F.arrays_overlap("path", "tail")
        grown = stored(grown.select("root", F.col("child").alias("part"), F.concat("path", "tail").alias("path"), compose("pm", "cm").alias("m"), (F.col("flip") != F.col("turn")).alias("flip"), (F.col("depth") + F.size("tail")).alias("depth"), looped.alias("loop")))
        bad = grown.where("loop").take(1)
        if bad:
            path = bad[0]["path"]
            end = next(i for i, p in enumerate(path) if p in path[:i])
            raise ValueError(f"cyclic reference: {' -> '.join(path[: end + 1])}")
        return grown.drop("loop")

    below = placed(at_root, steps)
    chains = stored(steps.join(children.select(F.col("child").alias("top")), "top", "left_semi"))
    while not chains.isEmpty():
        grown = placed(below, chains)
        if grown.isEmpty():
            break
        below = below.unionByName(grown)
        a, b = chains.where("not loop").withColumnsRenamed({"m": "pm", "child": "mid", "tail": "head", "turn": "before"}), chains.withColumnsRenamed({"top": "mid", "m": "cm", "loop": "ends"})
        met = F.col("ends") | F.arrays_overlap("head", "tail") | F.array_contains("tail", F.col("top"))
        chains = stored(a.join(b, "mid").select("top", "child", F.concat("head", "tail").alias("tail"), compose("pm", "cm").alias("m"), (F.col("before") != F.col("turn")).alias("turn"), met.alias("loop")))
    found = at_root.unionByName(below)
    if complete:
        return found, refs.select("parent", "child").where("false")
    lost = refs.join(parts, "child", "left_anti").select("parent", "child").distinct()
    lost = lost.join(found.select(F.col("part").alias("parent")).distinct(), "parent", "left_semi")
    if strict_missing:
        gone = lost.take(1)
        if gone:
            raise FileNotFoundError(f"unresolved reference {gone[0]['child']!r} in {gone[0]['parent']!r}")
    return found, lost
