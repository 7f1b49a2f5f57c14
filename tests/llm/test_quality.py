import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import SCHEMA, documents

from curatrix.llm import quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled():
    random.seed(5)
    pool = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(500):
        words = random.choices(pool, k=random.randint(30, 120))
        good = i % 4 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + random.choice(["!!", "$$$", " |"]) for w in words)))
        labels.append((i, int(good), 0))
    return rows + [(600, ""), (601, None), (602, "!"), (None, "some words here")], labels


def test_held_out_accuracy(spark, labelled):
    rows, labels = labelled
    made = {r.doc_id: r for r in quality.report(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(made) == len(rows)
    truth = {d: q for d, q, _ in labels}
    for d, r in made.items():
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for d, r in made.items() if d in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert made[600].score == made[601].score


def test_held_out_labels_change_nothing(spark, labelled):
    rows, labels = labelled
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    score = lambda x: sorted((str(r.doc_id), round(r.score, 9)) for r in quality.report(documents(spark, rows), spark.createDataFrame(x, LABELS)).collect())
    assert score(labels) == score(flipped + [(1, None, 0)])


def test_empty_tables_and_single_class(spark):
    assert quality.report(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []
    docs = documents(spark, [(1, "a b"), (2, None)])
    assert {r.score for r in quality.report(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality.report(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)).count() == 2
    clash = docs.withColumnRenamed("lang", "key").withColumnRenamed("source", "score")
    assert quality.kept(clash, spark.createDataFrame([], LABELS)).columns == clash.columns


def test_statistics_see_the_whole_text_and_isotonic_fit():
    long = "word " * 200_000
    x = quality.statistics(pa.array([long, long + "!!! " * 50_000, "", None]))
    assert x.shape == (4, len(quality.STATISTICS)) and np.isfinite(x).all()
    mark = quality.STATISTICS.index("mark")
    assert x[0, mark] == 0 and x[1, mark] > 0.1 and (x[2] == x[3]).all()
    fit = quality.pool_adjacent_violators(np.array([0.1, 0.5, 0.2, 0.9, 0.8]), np.array([1.0, 1, 3, 1, 1]))
    assert np.allclose(fit, [0.1, 0.275, 0.275, 0.85, 0.85])
