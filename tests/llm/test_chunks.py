import random
import re

import brute
from fixtures_llm import SCHEMA, documents

from curatrix.llm import chunks


def _docs():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghé", k=random.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(70)
    rows = [(i, prose(100) + " " + ("\n".join(re.sub("[a-z]", lambda m: m[0].upper(), shared).split()) if i % 2 else shared) + " " + prose(80)) for i in range(6)]
    rows += [(10 + i, prose(150)) for i in range(20)] + [(40, prose(30) + " " + "et " * 300), (41, "la " * 300), (50, ""), (51, None), (52, "a"), (53, " \n")]
    return rows, shared


def test_repeated_passages_and_only_these(spark):
    rows, shared = _docs()
    made = {r.doc_id: r for r in chunks.report(documents(spark, rows)).collect()}
    assert set(made) == set(range(6))
    texts = dict(rows)
    for d, r in made.items():
        a, b = map(int, r.spans.split(":"))
        part = brute.fold(texts[d][a:b]).split()
        assert len(part) == r.repeated_words >= 40 and " ".join(part) in brute.fold(shared)
        assert r.dropped_words == (0 if d == 0 else r.repeated_words)


def test_insertions_do_not_move_cuts(spark):
    rows, _ = _docs()
    text = rows[10][1]
    made = {r.doc_id: r for r in chunks.report(documents(spark, [(1, text), (2, "inserted words " + text), (3, text[:300] + " x " + text[300:])])).collect()}
    assert made[2].repeated_words > 120 and made[3].repeated_words > 100


def test_first_copy_stays(spark):
    rows, shared = _docs()
    frame = documents(spark, rows).withColumnRenamed("lang", "_doc").withColumnRenamed("source", "digest")
    out = chunks.deduplicated(frame)
    assert out.columns == frame.columns
    texts, after = dict(rows), {r.doc_id: r.text for r in out.collect()}
    assert all(after[d] == texts[d] for d in texts if d == 0 or d > 5)
    for d in range(1, 6):
        assert 80 + 100 <= len(after[d].split()) < 180 + 30
    assert not chunks.report(documents(spark, list(after.items()))).collect()


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows, _ = _docs()
    text = rows[10][1]
    assert chunks.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert chunks.report(documents(spark, [(1, text), (1, text)])).collect() == []
    made = chunks.report(documents(spark, [(None, text), (1, text), (1, text)])).collect()
    assert [(r.doc_id, r.dropped_words > 0) for r in sorted(made, key=str)] == [(1, True), (None, False)]


def test_passages_of_51_words_by_the_thousand(spark):
    """Random and repetitive passages (periods of 1 to 12 words) in two documents each, with other words around."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choices("abcdefghijklmnopé", k=pick.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    rows, kinds = [], {}
    for n in range(4000):
        period = (51, 1, 2, 3, 5, 8, 12, 51)[n % 8]
        passage = (prose(period) * 51)[:51]
        kinds[n] = period
        rows += [(2 * n + i, " ".join([*prose(pick.randint(1, 70)), *passage, *prose(pick.randint(1, 70))])) for i in range(2)]
    found = {r.doc_id for r in chunks.report(documents(spark, rows)).collect()}
    missed = [kinds[n] for n in kinds if not {2 * n, 2 * n + 1} <= found]
    assert not missed, {p: missed.count(p) for p in set(missed)}
