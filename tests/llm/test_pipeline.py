import random

import brute
import pytest
from fixtures_llm import documents
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, fn in corpus_pipeline.STAGES:
        made = fn(spark, docs, FOLDER)
        path = str(tmp_path_factory.mktemp("stages") / name)
        made.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def _texts(df):
    return dict(df.select("doc_id", "text").collect())


def test_columns(stages):
    columns = stages["quality"][0].columns
    assert [after.columns for name, (_, after) in stages.items() if name != "encoding"] == [columns] * 4


def test_quality_keeps_what_is_labelled_good(spark, stages):
    before, after = map(_texts, stages["quality"])
    labels = dict(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect())
    good = {d for d in before if labels.get(d) == 1}
    assert len(good & set(after)) >= 0.95 * len(good) and len(after) < len(before)


def test_one_of_each_group(stages):
    before, after = map(_texts, stages["near_duplicates"])
    assert set(after) == {c for _, _, c in brute.components(list(before.items()))}


def test_contaminated_documents_go(spark, stages):
    before, after = map(_texts, stages["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {r[0] for r in brute.contamination(list(before.items()), items) if not r[5]}


def test_secrets_are_gone(stages):
    before, after = map(_texts, stages["secrets"])
    assert set(before) == set(after)
    for d, text in before.items():
        assert brute.secrets(after[d])[0] == [0, 0, 0]
        assert (after[d] == text) == (brute.secrets(text)[0] == [0, 0, 0])


def test_ids(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    library.no_truncation()
    for r in stages["encoding"][1].collect():
        assert list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (1, "", None, None, 0), (None, "x y", "en", None, 3)], docs.schema))
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), FOLDER).count() == 0, name
        assert fn(spark, odd, FOLDER).count() <= 3, name


def test_run(spark):
    made = corpus_pipeline.run(spark, FOLDER)
    assert made.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert decontaminate.clean(made, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == made.count() > 0


def test_near_duplicates_by_five_words_and_80_percent(spark):
    """Copies between the limits of op8 and those of the stage, and the groups of all pairs."""
    pool = [f"w{i}" for i in range(5000)]
    pick = random.Random(6)
    rows = []
    for g in range(12):
        base = pick.choices(pool, k=(100, 200, 259)[g % 3])
        rows.append((g * 10, " ".join(base)))
        rows.append((g * 10 + 1, " ".join(base + pick.choices(pool, k=len(base) // 5))))
        few = list(base)
        for i in range(len(base) // 50):
            few[25 + i * 50] = "other"
        rows.append((g * 10 + 2, " ".join(few)))
    want = {c for _, _, c in brute.components(rows, 5, 80)}
    assert want != {c for _, _, c in brute.components(rows)}
    made = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), FOLDER)
    assert {r.doc_id for r in made.collect()} == want
