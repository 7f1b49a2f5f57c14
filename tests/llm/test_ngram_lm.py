import math
from collections import Counter

import brute
import numpy as np
import pytest
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401

from curatrix.llm import ngram_lm as lm, queries


def plain(rows, order=3, least=2, discount=0.75):
    """(id, held_out, n_tokens, n_known, N, base, score) with exact probabilities."""
    tokens = [(d, [*brute.spaced(t), None]) for d, t in rows]
    held = lambda d: d is not None and brute.crc(d) % 7 == 2
    counts = [Counter() for _ in range(order)]
    for d, w in tokens:
        if not held(d):
            for k in range(order):
                counts[k].update(tuple(w[i: i + k + 1]) for i in range(len(w) - k))
    total, kinds = sum(counts[0].values()), len(counts[0])
    kept = [counts[0]] + [{g: n for g, n in c.items() if n >= least} for c in counts[1:]]
    gone = [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, n in kept[k].items():
            gone[k][g[:-1]] += (n - discount) / counts[k - 1][g[:-1]]
    for d, w in tokens:
        base = score = 0.0
        for i, x in enumerate(w):
            p = (counts[0][x,] + 1) / (total + kinds + 1)
            base += math.log10(p)
            for k in range(1, order):
                context = tuple(w[i - k: i])
                if i >= k and (context in kept[k - 1]):
                    n = kept[k].get((*context, x), 0)
                    p = max(n - discount, 0) / counts[k - 1][context] + (1 - gone[k][context]) * p
            score += math.log10(p)
        yield d, held(d), len(w), sum(counts[0][x,] > 0 for x in w), total, base, score


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_plain_model(spark, corpus, order):
    rows = [(d, t) for d, t in corpus if t is None or len(t) < 30_000] + [(None, "a b c"), (3, "a b c"), (3, "a b c")]
    want = {(d, n): (h, k, total, base, score) for d, h, n, k, total, base, score in plain(rows, order)}
    made = lm.report(documents(spark, rows), order=order).collect()
    assert len(made) == len(rows)
    for r in made:
        h, k, total, base, score = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, k, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 0.03 * r.n_tokens


def test_query_keeps_ngrams_seen_once(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    made = {r.doc_id: r for r in queries.QUERIES["op9_lm_scoring"](spark, folder).collect()}
    assert len(made) == len(rows)
    want = {d: (n, score) for d, _, n, _, _, _, score in plain(rows, least=1)}
    cut = {d: score for d, _, _, _, _, _, score in plain(rows)}
    assert any(abs(want[d][1] - cut[d]) > 0.1 * want[d][0] for d in want)
    for d, r in made.items():
        assert r.n_tokens == want[d][0] and abs(r.score - want[d][1]) <= 0.03 * r.n_tokens


def test_no_training_rows(spark):
    assert lm.report(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if brute.crc(i) % 7 == 2)
    r = lm.report(documents(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_extra_columns(spark):
    frame = documents(spark, [(1, "a b a b a b"), (2, None)]).withColumnRenamed("lang", "lm").withColumnRenamed("source", "score")
    model = lm.train(frame)
    made = lm.scored(frame, model, out="result")
    assert made.columns == [*frame.columns, "result"] and made.count() == 2


@pytest.mark.parametrize("top,n", [(1 << 61, 500), (5000, 3000), (3, 2), (1, 1), (1 << 40, 70_000), (0, 0)])
def test_sequences(top, n):
    values = np.unique(np.random.default_rng(n).integers(0, max(top, 1), n))
    s = lm.Sequence({f"x.{k}": v for k, v in lm.encode_sequence(values).items()}, "x")
    at = np.arange(len(values))
    assert (s[at] == values).all() and (s.find(values) == at).all()
    other = np.setdiff1d(np.concatenate([values + 1, values - 1, np.array([0, top, 2 * top])]), values)
    assert (s.find(other) == -1).all()


def test_repeated_values_in_pointers():
    values = np.array([0, 0, 0, 4, 4, 9, 9, 9, 12])
    s = lm.Sequence({f"x.{k}": v for k, v in lm.encode_sequence(values).items()}, "x")
    assert s[np.arange(9)].tolist() == values.tolist()


def test_counts_in_bytes_and_shuffle_files_that_go(spark):
    """A count above a byte stands apart, the last level has no counts, and no shuffle file outlives the step that made it."""
    docs = documents(spark, [(i, "a b " * 200 + "c d e") for i in range(4)])
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    model = lm.train(docs, min_count=1)
    trie = lm.Trie(model.folder, model.levels, model.widths)
    nodes = np.arange(sum(len(m["count"]) for m in trie.levels[1][2]))
    assert sorted(trie.counts_of(1, nodes).tolist()) == [4, 4, 4, 4, 796, 800]
    assert all(m["count"].dtype == np.uint8 for m in trie.levels[1][2]) and not any("count" in m for m in trie.levels[2][2])
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_lookups_go_through_all_shards_at_once(spark, monkeypatch):
    """A slice is looked up in as many passes with many shards as with one, and its n-grams are sent as runs, not as a row each."""
    docs = documents(spark, [(i, " ".join(f"w{i * 7 + k * k % 31}" for k in range(200))) for i in range(40)])
    count, sent, calls, nth = lm._build, [], [], lm._nth
    monkeypatch.setattr(lm, "_build", lambda counted, *rest: sent.append(counted.count()) or count(counted, *rest))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        model = lm.train(docs, min_count=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    trie = lm.Trie(model.folder, model.levels, model.widths)
    assert min(len(level[2]) for level in trie.levels[1:]) > 40 and sent[2] < model.tokens / 10
    ids = np.arange(model.vocabulary)
    monkeypatch.setattr(lm, "_nth", lambda *args: calls.append(1) or nth(*args))
    node = np.concatenate([trie.children(1, ids, np.full(len(ids), k))[0] for k in range(20)])
    assert (node >= 0).any() and len(calls) <= 3 * 20


def test_an_unknown_word_is_no_successor(spark):
    """The pair of a word and an unknown one is not the pair of the word before and the last one."""
    model = lm.train(documents(spark, [(i, " ".join(f"w{i} w{j}" for j in range(50))) for i in range(50)]), min_count=1)
    trie = lm.Trie(model.folder, model.levels, model.widths)
    ids = np.arange(model.vocabulary)
    assert (trie.children(1, ids[:-1], np.full(len(ids) - 1, len(ids) - 1))[0] >= 0).any()
    node, _, p, _ = trie.children(1, ids, np.full(len(ids), -1))
    assert (node == -1).all() and (p == 0).all()
