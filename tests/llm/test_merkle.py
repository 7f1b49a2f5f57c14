import random

import pytest
from brute import crc, sha
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401
from pyspark.sql import functions as F

from curatrix.llm import merkle


def leaf(row, text=False):
    values = [row.doc_id, row.source, row.lang, row.n_chars, row.text if text is False else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_proofs(leaves):
    """The root and the (before, after) steps of every leaf."""
    steps, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for s, i in zip(steps, at, strict=True):
            run = level[i // 8 * 8: i // 8 * 8 + 8]
            s.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1:])))
        level = [sha("".join(level[i: i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], steps


def plain_report(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = plain_proofs([leaf(r) for r in groups[g]])
    root, upper = plain_proofs([trees[g][0] for g in order]) if order else (None, [])
    for g, up in zip(order, upper, strict=True):
        for r, steps in zip(groups[g], trees[g][1], strict=True):
            proof, folded = steps + up, leaf(r)
            if r.doc_id is not None and crc(r.doc_id) % 3 == 0 and r.text is not None:
                folded = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for before, after in proof:
                folded = sha(before + folded + after)
            yield r.doc_id, leaf(r), trees[g][0], root, sha("".join(b + a for b, a in proof)), folded, folded == root


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def compare(frame):
    got = sorted((tuple(r) for r in merkle.report(frame).select(*COLUMNS).collect()), key=str)
    assert got == sorted(plain_report(frame.collect()), key=str)
    return got


def langs(frame):
    """Groups of very different size, an empty and a null one among them, of names whose bytes and code units sort differently."""
    names = F.array(*[F.lit(x) for x in ("en", "", "￿", "\U0001f642", "de")], F.lit(None))
    return frame.withColumn("lang", F.when(F.col("doc_id") < 90, "en").otherwise(F.get(names, (F.coalesce("doc_id", F.lit(5)) % 6).cast("int"))))


def test_report_against_plain_trees(spark, corpus):  # noqa: F811
    rows = corpus + [(None, "Null ID"), (None, None), (3, "Other text"), (3, corpus[3][1]), (3, corpus[3][1]), (-7, "Ab")]
    got = compare(langs(documents(spark, rows)))
    assert len(got) == len(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65, 700])
def test_every_block_size_gives_the_same_tree(spark, n):
    """With blocks of one or eight leaves the exchange does nearly all the work, over subtrees cut short at every size."""
    frame = documents(spark, [(i * 7 % 1009, f"T{i}") for i in range(n)])
    root, steps = plain_proofs([leaf(r) for r in sorted(frame.collect(), key=lambda r: r.doc_id)])
    for levels in (0, 1):
        made = {r.doc_id: r for r in merkle.manifest(frame, levels=levels).collect()}
        assert {r.root for r in made.values()} == {root} == {r.subroot for r in made.values()}
        assert [[tuple(s) for s in made[k].proof] for k in sorted(made)] == steps


def test_partitions_do_not_matter_and_names_may_clash(spark):
    random.seed(4)
    frame = langs(documents(spark, [(random.randrange(50), f"T{i % 40}") for i in range(300)]))
    wide = frame.withColumns({"grp": F.lit(1), "leaf": F.lit("x"), "place": F.lit(2), "Proof": F.lit(3), "block": F.lit(4), "tampered": F.lit(5)})
    assert compare(frame.repartition(7)) == sorted((tuple(r) for r in merkle.report(wide.coalesce(1)).select(*COLUMNS).collect()), key=str)


def test_changes_show_and_empty_table(spark):
    frame = documents(spark, [(i, f"t{i}") for i in range(100)])
    root = lambda f: merkle.manifest(f).first().root
    assert root(frame) != root(frame.withColumn("text", F.when(F.col("doc_id") == 41, "t").otherwise(F.col("text"))))
    assert root(frame.withColumn("text", F.lit(None).cast("string"))) != root(frame.withColumn("text", F.lit("")))
    assert merkle.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_groups_and_a_hot_one(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    compare(frame)
