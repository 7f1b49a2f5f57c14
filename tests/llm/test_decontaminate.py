import brute
import pytest
from fixtures_llm import corpus, documents  # noqa: F401

from curatrix.llm import decontaminate as dc

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def case(corpus):
    texts = dict(corpus)
    items = [(1, " ".join(texts[0].split()[5:25])), (2, texts[300].split("\n")[1].split("\t")[0].upper()), (3, "Two words"), (4, "never seen " * 12), (5, None), (6, ""), (7, "one"), (8, "!!"), (2, "one"), (10, texts[405])]
    docs = corpus + [(500, "before " + items[0][1] + ", after"), (501, "x-one,ONE.two--words"), (502, "One One one"), (502, "One One one"), (None, "one"), (503, "Ünïcode one é one")]
    return docs, items


def _rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_equals_plain_search(spark, case):
    docs, items = case
    want = sorted(brute.contamination(docs, items), key=str)
    benchmark = spark.createDataFrame(items, ITEMS)
    assert sum(w[5] for w in want) > 10
    assert _rows(dc.report(documents(spark, docs), benchmark)) == want
    assert _rows(dc.report(documents(spark, docs), benchmark, part_chars=300)) == want


def test_spans_are_code_points_of_the_original(spark, case):
    docs, items = case
    texts = {d: t for d, t in docs if d}
    for r in dc.contamination(documents(spark, docs), spark.createDataFrame(items, ITEMS)).where("size(contamination.hit) > 0").collect():
        for span in r.contamination.hit:
            part = r.text[span.start: span.end]
            assert part and part[0].strip() and part[-1].strip() and texts.get(r.doc_id, r.text) == r.text
    r = dc.contamination(documents(spark, [(1, "é漢 🙂, One")]), spark.createDataFrame([(1, "one")], ITEMS)).first()
    assert [tuple(s) for s in r.contamination.hit] == [(2, 3, 6, 9)]


def test_empty_tables_and_clean_documents(spark, case):
    docs, items = case
    none = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated for r in dc.report(documents(spark, docs), none).collect())
    assert dc.report(documents(spark, [], ), none).collect() == []
    frame = documents(spark, docs).withColumnRenamed("lang", "found").withColumnRenamed("source", "_found")
    kept = dc.clean(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    want = sorted(str(w[0]) for w in brute.contamination(docs, items) if not w[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
