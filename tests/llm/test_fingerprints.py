import brute
import numpy as np
import pyarrow as pa
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401

from curatrix.llm import fingerprints as fp


def test_report_equals_plain_texts_and_exact_likeness(spark, corpus):
    rows = {r.doc_id: r for r in fp.report(documents(spark, corpus)).collect()}
    texts = dict(corpus)
    assert set(rows) == set(texts)
    for doc, n, edited, after in brute.edited(corpus):
        r, own = rows[doc], brute.shingle_set(texts[doc], 5)
        assert (r.n_chars, r.edited_sha256) == (n, brute.sha(edited))
        assert abs(r.near_edited - brute.jaccard(own, brute.shingle_set(edited, 5))) < 0.13
        assert abs(r.near_next - brute.jaccard(own, brute.shingle_set(after, 5))) < 0.13
        if len(own) < fp.K:
            assert r.n_shingles == len(own)
        else:
            assert abs(r.n_shingles / len(own) - 1) < 0.25
    assert len({rows[d].fingerprint for d in (3, 100, 101, 102, 103, 104)}) == 1
    assert rows[400].fingerprint == rows[401].fingerprint == rows[402].fingerprint == ""
    assert rows[405].fingerprint == rows[406].fingerprint != ""


def test_ties_nulls_one_row_and_no_row(spark):
    assert fp.report(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.report(documents(spark, [(7, "a b c d e f")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == brute.sha("a b c a b c"[:6] + "a b c ")[:64] or one.n_chars == 11
    rows = fp.report(documents(spark, [(1, "x y"), (1, "x y"), (None, "q"), (None, None), (2, "zz")])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 2), (False, 3), (False, 3), (True, 0), (True, 1)]


def test_merge_is_the_sketch_of_the_union(spark, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 30][:6]
    parts = [(i // 2, t) for i, t in enumerate(texts)] + [(9, None), (None, texts[0])]
    frame = spark.createDataFrame(parts, "k long, text string")
    made = fp.fingerprint(frame, keep=["k"], k=64).select("k", "sketch.fingerprint")
    merged = {r.k: r.fingerprint for r in fp.merge(made, "k", k=64).collect()}
    for k in {p[0] for p in parts}:
        own = [x for s in fp.sketches(pa.array([t for j, t in parts if j == k]), 64) for x in s]
        assert fp.decode(merged[k]).tolist() == sorted({int(x) for x in own})[:64]


def test_estimates():
    whole = np.sort(np.random.default_rng(1).choice(1 << 40, 5000, replace=False)).astype(np.uint64)
    a, b = whole[:4000], whole[np.arange(5000) % 2 == 0]
    sketch = lambda s: s[: fp.K]
    assert abs(fp.distinct(sketch(whole)) / 5000 - 1) < 0.3
    assert fp.resemblance(a[:0], b[:0]) == 1 and fp.resemblance(sketch(a), b[:0]) == 0 and fp.containment(a[:0], sketch(b)) == 1
    assert abs(fp.containment(sketch(b), sketch(whole)) - 1) < 0.3
    small = whole[:100]
    assert fp.resemblance(small, small[:50]) == 0.5 and fp.containment(small[:50], small) == 1.0


def test_columns_of_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, fingerprint int, _text string")
    made = fp.fingerprint(frame, out="sketch").first()
    assert (made.fingerprint, made["_text"]) == (5, "x") and made.sketch.n_shingles == 1
