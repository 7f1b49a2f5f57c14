import random

import brute
import numpy as np
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401

from curatrix.llm import components, jaccard


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_all_pairs(spark, corpus):
    assert _rows(jaccard.report(documents(spark, corpus))) == sorted(brute.components(corpus))


def test_deep_recursion_equals_all_pairs(spark):
    random.seed(4)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(3):
        base = random.choices(pool, k=90)
        chain = list(base)
        for i in range(70):
            words = list(base if i % 2 else chain)
            for _ in range(random.randint(0, 4)):
                words[random.randrange(90)] = random.choice(pool)
            if i % 3 == 0:
                chain = list(words)
            rows.append((g * 100 + i, " ".join(words[: random.randint(80, 90)])))
    for sizes in (6, 12, 30):
        rows += [(1000 + sizes * 10 + i, " ".join(random.choices(pool[:12], k=sizes))) for i in range(9)]
    random.shuffle(rows)
    want = sorted(brute.components(rows))
    assert len({w[2] for w in want}) < len(rows) - 40
    assert _rows(jaccard.report(documents(spark, rows), depth=3, small=4, few=0)) == want


def _n_links(rows, size=4, percent=85):
    sets = [(d, brute.shingle_set(t, size)) for d, t in rows]
    met = lambda s, t: s and t and 100 * len(s & t) >= percent * len(s | t)
    return {d: sum(e != d and bool(met(s, t)) for e, t in sets) for d, s in sets}


def test_link_form_loses_no_link(spark, corpus):
    """A dense group of different edits of one template: connected sets are compared too, also in the recursion and the last step."""
    pick = random.Random(5)
    pool = [f"w{i}" for i in range(500)]
    base = pick.choices(pool, k=120)
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(120)] = pick.choice(pool)
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), *[r for r in corpus if r[1] is None or len(r[1]) < 30_000]]
    want = _n_links(rows)
    groups = {d: (n, c) for d, n, c in brute.components(rows)}
    for options in ({}, {"depth": 3, "small": 4, "few": 0}):
        made = jaccard.link_report(documents(spark, rows), **options).collect()
        assert len(made) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in made} == {d: (*groups[d], want[d]) for d in want}
    assert sum(want.values()) > 2000


def test_link_form_of_odd_rows(spark):
    assert jaccard.link_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "A b c d"), (3, ""), (4, None)]
    assert {tuple(r) for r in jaccard.link_report(documents(spark, rows)).collect()} == {(None, 1, None, None), (1, 1, 1, 1), (2, 1, 1, 1), (3, 0, 3, 0), (4, 0, 4, 0)}


def test_blocks_lose_no_link():
    """Whatever the sizes and the place of the differences, two linked sets share as many blocks as they need."""
    random = np.random.default_rng(2)
    for n in [*range(1, 80), 127, 128, 129, 300, 1000]:
        for _ in range(6):
            a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
            keep = a[np.sort(random.permutation(len(a))[: max(1, int(np.ceil(len(a) * (0.85 + 0.15 * random.random()))))])]
            extra = int(100 * len(keep) // 85) - len(a)
            b = np.unique(np.concatenate([keep, random.integers(0, 1 << 63, max(0, random.integers(0, extra + 1)) if extra > 0 else 0).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                label = max(len(a), len(b)).bit_length() - 1
                assert label in jaccard.labels(len(a), 85) and label in jaccard.labels(len(b), 85)
                (x, least), (y, more) = (jaccard.signatures(s, 85, label) for s in (a, b))
                assert np.intersect1d(x, y).size >= max(least, more) >= 1


def test_lower_limits_have_classes_enough():
    random = np.random.default_rng(3)
    for percent in (60, 70, 75, 80, 85, 90):
        for n in [*range(1, 300), 511, 1023, 4095]:
            s = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
            for label in jaccard.labels(len(s), percent):
                assert jaccard.signatures(s, percent, label)[1] >= 1
    assert all(jaccard.classes(label, 85) == (2 << label) // 4 for label in range(6, 24))


def test_sketches_never_part_more_than_sets():
    """The bound is no larger than the number of differing shingles, and the metric made of it keeps the triangle inequality."""
    pick = np.random.default_rng(6)
    for n in (1, 3, 20, 300, 5000):
        base = np.unique(pick.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        sets = [np.unique(np.concatenate([base[pick.random(len(base)) < keep], pick.integers(0, 1 << 63, n // 9).astype(np.uint64) << np.uint64(1)])) for keep in (1, 0.95, 0.9, 0.5, 0)]
        cells = [np.frombuffer(jaccard.sketch(s), np.uint64) for s in sets]
        d = {(i, j): int(jaccard.least_apart(cells[i], cells[j], len(sets[i]), len(sets[j]))) for i in range(5) for j in range(5)}
        assert all(d[i, j] <= len(np.setxor1d(sets[i], sets[j])) for i, j in d)
        far = {(i, j): 2 * x / max(1, len(sets[i]) + len(sets[j]) + x) for (i, j), x in d.items()}
        assert all(far[i, j] <= far[i, k] + far[k, j] + 1e-9 for i, j in d for k in range(5))


def test_texts_of_unlinked_families_are_not_compared(spark):
    """Sets in common blocks that stay just below the limit cost sketches, not texts by pairs, in the recursion and without it."""
    pick = random.Random(8)
    pool = [f"w{i}" for i in range(5000)]
    base = pick.choices(pool, k=400)
    rows = []
    for i in range(120):
        words = list(base)
        for at in pick.sample(range(400), 14):
            words[at] = pick.choice(pool)
        rows.append((i, " ".join(words)))
    want = sorted(brute.components(rows))
    for options in ({"depth": 2, "small": 8, "few": 0}, {"depth": 0}):
        join, roots = jaccard._joined(documents(spark, rows), "doc_id", "text", 4, 85, **options)
        assert join.compared.count() < 4 * len(rows)
        assert roots.count() == sum(w[0] != w[2] for w in want) + len({w[2] for w in want if w[0] != w[2]})


def test_nulls_ties_and_empty_table(spark):
    assert _rows(jaccard.report(spark.createDataFrame([], SCHEMA))) == []
    rows = [(5, "a b c d e"), (3, "A b  c d\te"), (3, "a b c d e"), (7, None), (8, ""), (9, "x"), (2, "x"), (4, "a b c d e f")]
    got = _rows(jaccard.report(documents(spark, rows)))
    assert got == [(2, 1, 2), (3, 2, 3), (3, 2, 3), (4, 3, 4), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 2)]
    made = jaccard.report(documents(spark, [(None, "a b c d"), (1, "a b c d"), (2, "a b c d")])).collect()
    assert {(r.doc_id, r.component_id) for r in made} == {(None, None), (1, 1), (2, 1)}


def test_representatives(spark):
    frame = documents(spark, [(1, "a b c d"), (2, "a b c d"), (3, ""), (4, ""), (1, "a b c d"), (None, "a b c d")]).withColumnRenamed("lang", "component").withColumnRenamed("source", "sid")
    made = jaccard.representatives(frame)
    assert made.columns == frame.columns and sorted(str(r.doc_id) for r in made.collect()) == ["1", "3", "4", "None"]


def test_representatives_of_one_id_with_several_texts(spark):
    """One row for each component whatever the ids: no unlinked text goes, and none stays beside its copy."""
    pick = random.Random(9)
    pool = [f"w{i}" for i in range(3000)]
    alone = [" ".join(pick.choices(pool, k=60)) for _ in range(40)]
    copied = pick.choices(pool, k=100)
    near = " ".join([*copied[:-1], "other"])
    rows = [(1, t) for t in alone] + [(1, near), (2, " ".join(copied)), (3, alone[0]), (0, near.upper()), (5, " "), (5, ""), (5, ""), (None, near), (None, near)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        made = sorted(((r.doc_id, r.text) for r in jaccard.representatives(documents(spark, rows)).collect()), key=str)
        assert made == sorted([*((1, t) for t in alone), (0, near.upper()), (5, " "), (5, ""), (5, ""), (None, near), (None, near)], key=str)


def test_components(spark):
    random.seed(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    random.shuffle(pairs)
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components.components(frame, "a", "b").collect()}
    assert got == {r.node: r.root for r in components.components(frame, "a", "b", together=0).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[103] == 100 and got[320] == 300 and 200 not in got
    assert components.components(frame.limit(0), "a", "b").count() == 0
