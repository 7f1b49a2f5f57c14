"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and for every row a proof up to the root.

Leaves of a group ascend by a key; every ``FANOUT`` consecutive nodes (the last run may hold fewer, even one) become their hash until one node is left. The roots of the groups,
in bytewise order with the null group first, are the leaves of one more tree of the same form.

Butterfly exchange: leaves are cut into aligned blocks of ``FANOUT ** levels``. Blocks are the partitions of the exchange; each hashes its own leaves. In round ``r`` the blocks whose
numbers agree in all digits (base ``FANOUT``) but digit ``r`` swap the roots of the subtrees they stand for, and each of them hashes the parent, so that after
``log(blocks)`` rounds every block holds the whole upper proof and the root; nothing travels down again. A subtree that is cut short has fewer blocks than its neighbours
have; there each block serves several partners. A round is one shuffle of at most ``FANOUT`` short messages for each block. Leaves move twice, as digests; texts never move.

Results: ``leaf``, ``subroot``, ``root`` and ``proof``, an array with one ``(before, after)`` of concatenated digests for each level, leaf to root. ``fold`` recomputes the root from a leaf and
a proof. Nulls in any field hash as ``-`` and differ from empty texts; a null group is a group; rows of equal key are ordered by their leaf, and rows that are equal altogether are all kept (their
proofs may differ by place). Very long texts are hashed whole in the JVM. An empty table gives no rows. Further columns are ignored and their names may clash with the added ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from curatrix.session import materialize

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = StructType([StructField("before", StringType()), StructField("after", StringType())])


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in lower-case hex of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda have, step: F.sha2(F.concat(step["before"], have, step["after"]), 256))


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], levels: int, whole: bool) -> list[list[str]]:
    """The levels above ``nodes``: ``levels`` of them, or until one node is left if the nodes are the whole tree."""
    tree = [nodes]
    while len(tree[-1]) > 1 if whole else len(tree) <= levels:
        below = tree[-1]
        tree.append([_hash(below[i: i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return tree


def _steps(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    steps = []
    for level in tree[:-1]:
        first = place - place % FANOUT
        steps.append(("".join(level[first: place]), "".join(level[place + 1: first + FANOUT])))
        place //= FANOUT
    return steps


def _numbered(leaves: DataFrame) -> DataFrame:
    """``(grp, place, n, ...)`` of ``leaves(grp, ord, leaf, ...)``: the place inside the group and the size of the group.

    Ranges of ``(grp, ord, leaf)`` are sorted in place; one row for each range and group tells what comes before, so that a group with most of the rows is no single task.
    """
    order = [F.col("grp").asc(), F.col("ord").asc_nulls_first(), F.col("leaf").asc()]
    ranged = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("grp", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy("grp").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("grp", "_part", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(W.partitionBy("grp")).alias("n"))
    placed = ranged.join(before, ["grp", "_part"])
    return placed.withColumn("place", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def _block_roots(numbered: DataFrame, levels: int) -> DataFrame:
    size = FANOUT ** levels

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("place")
        n = rows.column("n")[0].as_py()
        top = _levels([x.hex() for x in rows.column("leaf").to_pylist()], levels, n <= size)[-1][0]
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "blocks": pa.array([-(-n // size)], pa.int64()), "node": [top]})

    return numbered.groupBy("grp", "block").applyInArrow(run, "grp string, block long, blocks long, node string")


def _exchange(blocks: DataFrame, rounds: int) -> DataFrame:
    """``(grp, block, node, proof)``: after the last round ``node`` is the root of the group and ``proof`` the steps above the block."""
    state = blocks.withColumn("proof", F.array().cast(ArrayType(_STEP)))
    width = lambda node, step: F.least(F.lit(step), F.col("blocks") - node * step)
    for r in range(rounds):
        step = FANOUT ** r
        own = F.floor(F.col("block") / step)
        nodes = F.ceil(F.col("blocks") / step)
        first = own - own % FANOUT
        # A block speaks to the blocks of each subtree of its group that have its own place there, and beyond them to those of the same rest by the number of its peers.
        state = state.withColumns({"own": own, "low": F.col("block") % step, "peers": width(own, step)})
        partners = F.when(nodes > 1, F.sequence(first, F.least(first + FANOUT, nodes) - 1)).otherwise(F.array("own"))
        sent = state.withColumn("to_node", F.explode(partners)).withColumn("_width", width(F.col("to_node"), step)).where("low < _width")
        sent = sent.withColumn("to_low", F.explode(F.when(nodes > 1, F.sequence("low", F.col("_width") - 1, "peers")).otherwise(F.array("low"))))
        target = F.col("to_node") * step + F.col("to_low")
        message = sent.select("grp", target.alias("block"), "blocks", "own", "node", F.when(target == F.col("block"), F.struct("own", "proof")).alias("mine"))
        got = message.groupBy("grp", "block").agg(
            F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("own", "node"))).alias("run"), F.max(F.col("mine.own")).alias("at"), F.first("mine.proof", ignorenulls=True).alias("proof"))
        digests = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
        swapped = F.ceil(F.col("blocks") / step) > 1
        state = got.select(
            "grp", "block", "blocks", F.when(swapped, F.sha2(digests(lambda x: F.lit(True)), 256)).otherwise(F.get("run", F.lit(0))["node"]).alias("node"),
            F.when(swapped, F.array_append("proof", F.struct(digests(lambda x: x["own"] < F.col("at")).alias("before"), digests(lambda x: x["own"] > F.col("at")).alias("after")))).otherwise(F.col("proof")).alias("proof"))
    return state.select("grp", "block", "node", "proof")


def _tree(leaves: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves, and the state of every block after the exchange; the leaves are ``(grp, ord, leaf binary, ...)``."""
    numbered = _numbered(leaves).withColumn("block", F.floor(F.col("place") / FANOUT ** levels))
    blocks = materialize(_block_roots(numbered, levels))
    most, rounds = blocks.agg(F.max("blocks")).first()[0] or 0, 0
    while FANOUT ** rounds < most:
        rounds += 1
    return numbered, _exchange(blocks, rounds)


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, *, key: str = "doc_id", group: str = "lang", keep: dict[str, Column] | None = None, levels: int = 4) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof`` and the columns ``keep`` (expressions over ``rows``) for every row.

    ``levels`` sets the block size, ``FANOUT ** levels`` leaves; it changes the work, never a digest.
    """
    keep = keep or {}
    # A group's name after a mark sorts like the name itself, and null comes first.
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = rows.select(grp.alias("grp"), F.col(key).alias("ord"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("leaf"), F.struct(F.col(key).alias(key), *[v.alias(k) for k, v in keep.items()]).alias("kept"))
    # Texts are read and hashed once: sampling the ranges reads digests.
    numbered, below = _tree(materialize(leaves), levels)
    below = materialize(below)
    tops, above = _tree(below.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.unhex("node").alias("leaf")), levels)
    above = _proved(tops.withColumn("kept", F.struct("ord")), above, levels).select(F.col("kept.ord").alias("grp"), F.col("subroot").alias("root"), F.col("proof").alias("upper"))
    state = below.join(above, "grp").select("grp", "block", "node", "root", F.concat("proof", "upper").alias("proof"))
    return _proved(numbered, state, levels).select("kept.*", "leaf", "subroot", "root", "proof")


def _proved(numbered: DataFrame, state: DataFrame, levels: int) -> DataFrame:
    """Every leaf with its whole proof: the steps inside its block, then those that the block got in the exchange."""
    if "root" not in state.columns:
        state = state.withColumn("root", F.col("node"))
    kept = numbered.schema["kept"]
    out = StructType([kept, StructField("leaf", StringType()), StructField("subroot", StringType()), StructField("root", StringType()), StructField("proof", ArrayType(_STEP))])
    steps_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("place")
        leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
        tree = _levels(leaves, levels, rows.column("n")[0].as_py() <= FANOUT ** levels)
        upper = [(s["before"], s["after"]) for s in right.column("proof")[0].as_py()]
        proofs = [[{"before": b, "after": a} for b, a in _steps(tree, i) + upper] for i in range(len(leaves))]
        fill = lambda name: pa.array([right.column(name)[0].as_py()] * len(leaves), pa.string())
        return pa.table({"kept": rows.column("kept"), "leaf": pa.array(leaves, pa.string()), "subroot": fill("node"), "root": fill("root"), "proof": pa.array(proofs, steps_type)})

    return numbered.groupBy("grp", "block").cogroup(state.groupBy("grp", "block")).applyInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proof digests of all documents; in those where 3 divides the CRC-32 of the id, tampering lower-cases A-Z, and the root is recomputed from the tampered leaf."""
    low = F.translate("text", UPPER, LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (low != F.col("text"))
    changed = leaf_digest(*[low if f == "text" else F.col(f) for f in FIELDS])
    made = manifest(docs, keep={"tampered": F.when(tampered, F.unhex(changed))})
    start = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    folded = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(start, F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
