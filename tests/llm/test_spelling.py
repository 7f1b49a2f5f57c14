import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import fold
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401
from pyspark.sql import functions as F

from curatrix.llm import spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_counts(rows):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = fold(run)
            h = zlib.crc32(f"{d}:{w}".encode()) if d is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def same(got, counts):
    want = {r[0]: r for r in plain_variants(counts)}
    assert {r.word: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)
    return want


def typos(seed, words, edits):
    """Words over few letters with chains of edits, so that near pairs are many."""
    r = random.Random(seed)
    pool = ["".join(r.choices("abcé", k=r.randint(4, 9))) for _ in range(words)]
    for w in pool[:]:
        for _ in range(edits):
            i, c = r.randrange(len(w)), r.choice("abcéÿ×")
            w = r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            pool.append(w)
    return [w for w in pool if len(w) >= 5]


def test_report_of_texts(spark, corpus):  # noqa: F811
    words, r = typos(1, 60, 3), random.Random(2)
    rows = [(i, " ".join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=200))) for i in range(60)]
    rows += corpus + [(None, rows[0][1]), (5, rows[5][1]), (700, "Zwölf_zwölf-ZWÖLF1zwölfĀzwölf " * 3 + "x" * 70_000 + " " + "ab" * 30_000), (701, "straße" * 2), (702, "ÀÉÎ÷×ø àéî÷×ø")]
    want = same(spelling.report(documents(spark, rows)).collect(), plain_counts(rows))
    assert any(w != x[2] != x[1] and x[1] for w, x in want.items()) and "zwölf" in want


def test_all_near_pairs_of_dense_words(spark):
    counts = {w: 3 + zlib.crc32(w.encode()) % 40 for w in set(typos(3, 250, 4)) | {"a" * n for n in range(5, 40)} | {"ab" * n for n in range(3, 20)} | {"ba" * n + "b" for n in range(3, 20)}}
    counts |= {w: 5 for w in ("\U0001f642bcdef", "\U0001f642bcdf", "\U0001f643bcdef", "漢字漢字漢", "漢字漢字", "字漢字漢字漢")}
    counts = {w: n for w, n in counts.items() if len(w) >= 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    same(spelling.variants(frame.repartition(5)).collect(), counts)
    assert spelling.variants(frame.coalesce(1)).exceptAll(spelling.variants(frame)).isEmpty()


def test_ties_ratio_and_chains(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "baaab": 12, "zzzzz": 3, "zzzzy": 5}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert (got["aaaaa"].form, got["aaaaa"].root, got["aaaaa"].n_near) == ("aaaab", "baaab", 2)
    assert (got["zzzzz"].form, got["zzzzz"].root, got["zzzzz"].form_n, got["zzzzz"].n_near) == (None, "zzzzz", None, 1)


def test_long_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(60)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w60"}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(5)
    place = np.sort(np.stack([rng.permutation(9)[:4] for _ in range(500)]), axis=1)
    weight = rng.integers(1, 50, place.shape)
    for p, w, got in zip(place, weight, spelling.pivots(place, weight), strict=True):
        want = min(w[i] + w[j] for i in range(4) for j in range(i) if p[i] - p[j] >= 2)
        assert w[got].sum() == want and p[got[1]] - p[got[0]] >= 2


def test_clashing_names_empty_table_and_short_words(spark):
    frame = documents(spark, [(i, "Colour colours color") for i in range(9)]).withColumns({"word": F.lit("x"), "n": F.lit(1), "ID": F.lit(2), "run": F.lit("y")})
    assert {r.word: r.n_near for r in spelling.report(frame).collect()}["colour"] >= 2
    assert spelling.report(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="code points"):
        spelling.near_pairs(spark.createDataFrame([("abc", 3)], "word string, n long")).collect()
