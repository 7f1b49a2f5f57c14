import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401

from curatrix.llm import bpe
from curatrix.llm.queries import WORD_BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(WORD_BPE)
    made.no_truncation()
    made.no_padding()
    return made


def hostile():
    random.seed(6)
    texts = ["Hello WORLD's it's 12345 naïve ÀÉ ΟΔΟΣ ΑΣ <|endoftext|> foo<|startoftext|>Bar ſ İ \x1c\x85 x", "a\x00b é ﬁ ½ ² Ⅷ 漢字ab 🙂!!'s", "x" * 5000, "ab" * 200 + "?!" * 90, "<|endoftext|", "'re 'RE 'll'D don't", "_a_1_²"]
    alphabet = "aábcçdeé ñ漢字🙂'’!?.,-_0123½Ⅷ́ \n\tΣσſİı"
    return texts + ["".join(random.choices(alphabet, k=random.randint(1, 200))) for _ in range(300)]


def test_equals_the_library(spark, corpus, library):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(hostile())] + [(3, "again"), (None, "null id")]
    made = bpe.encoded(documents(spark, rows), WORD_BPE, fields=("n_tokens", "ids", "ids_text", "decoded"), lexicon=500).collect()
    assert len(made) == len(rows)
    for r in made:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.bpe.ids) == ids and r.bpe.n_tokens == len(ids) and r.bpe.ids_text == " ".join(map(str, ids))
        assert r.bpe.decoded == library.decode(ids, skip_special_tokens=False)


def test_report_and_empty_table(spark):
    assert bpe.report(spark.createDataFrame([], SCHEMA), WORD_BPE).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in bpe.report(documents(spark, [(1, None), (2, " ")]), WORD_BPE).orderBy("doc_id").collect()] == [(1, 0, empty, empty), (2, 0, empty, empty)]
    clash = documents(spark, [(1, "hello")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "_text")
    assert bpe.encoded(clash, WORD_BPE).columns == [*clash.columns, "bpe"]


def test_lexicon_is_minimal_and_numbers_words(tmp_path):
    words = [b"car", b"cars", b"bar", b"bars", b"ba", "é".encode(), b"zebras", b"zebra"]
    bpe.build_lexicon(words, {w: (i, i + 1) for i, w in enumerate(words)}, str(tmp_path))
    made = bpe.Lexicon(str(tmp_path))
    found = made.find([*words, b"", b"c", b"carsx", b"zebr", b"\xc3"])
    assert sorted(found[:8]) == list(range(8)) and (found[8:] == -1).all()
    assert [made.ids(n) for n in found[:8]] == [(i, i + 1) for i in range(8)]
    assert len(made._target) < 16  # "ar(s)" of car and bar are shared


def test_both_ways_of_merging_agree():
    rules = bpe.Rules(WORD_BPE)
    random.seed(2)
    words = ["".join(random.choices("abcdeinorst", k=random.randint(1, 36))).encode() for _ in range(2000)]
    assert rules.merge_many(words) == [rules.merge_one(w) for w in words]
    assert bpe.Codec(rules, None).split("<|endoftext|>") == [" <|endoftext|>"]
    assert list(bpe.Codec(rules, None).encode_all(pa.array([], pa.string()))) == []


def test_all_code_points_split_as_in_the_library(spark, library):
    """Every code point inside a word, beside marks and digits, and in random company; the pieces of the whole file, bytes mapped back."""
    splitter = bpe.Rules(WORD_BPE).splitter.learn(spark)
    back = {c: b for b, c in enumerate(bpe._byte_chars())}

    def pieces(t):
        return [bytes(back[c] for c in w).decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(t))]

    def wrong(batches):
        for batch in batches:
            chars = [chr(p) for p in batch.column(0).to_pylist()]
            rng = random.Random(len(chars))
            texts = [f"x{c}y ?{c}' 2{c}{c}" for c in chars] + ["".join(rng.choices(chars, k=20) + ["Σ", "'S", "\u0301"]) for _ in range(50)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t in texts if splitter.words(t) != pieces(t)], pa.string())], names=["text"])

    points = spark.range(0, 0x110000, 1, 32).where("id < 55296 or id >= 57344")
    assert points.mapInArrow(wrong, "text string").collect() == []


def test_frequent_words_are_counted_over_all_rows(spark):
    rules = bpe.Rules(WORD_BPE)
    rules.splitter.learn(spark)
    rows = documents(spark, [(i, "often " * (i % 3) + f"twice{chr(97 + i // 2 % 26)}{chr(97 + i // 52 % 26)}{chr(97 + i // 1352)}") for i in range(6000)])
    assert len(set(bpe.frequent_words(rows, "text", rules, 10_000))) == 3001
    assert bpe.frequent_words(rows, "text", rules, 10) == [b"often"]
    assert bpe.frequent_words(rows.limit(0), "text", rules, 10) == []


def test_words_of_the_lexicon_are_read_together(tmp_path):
    words = [b"car", b"cars", b"bar", b"ba", b"zebra"]
    bpe.build_lexicon(words, {w: tuple(range(i)) for i, w in enumerate(words)}, str(tmp_path))
    made = bpe.Lexicon(str(tmp_path))
    assert type(made._ids) is type(made._key) is np.ndarray and not made._ids.flags.owndata
    assert list(made.all_ids(made.find([*words, b"car"]))) == [*(tuple(range(i)) for i in range(5)), ()]
    assert list(made.all_ids(np.zeros(0, np.int64))) == []
