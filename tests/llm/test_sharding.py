import zlib
from collections import Counter, defaultdict

from fixtures_llm import SCHEMA, corpus, documents  # noqa: F401

from curatrix.llm import files, sharding


def test_law_rows(spark, corpus):
    rows = corpus + [(3, corpus[3][1]), (None, "x"), (None, None)]
    made = sharding.report(documents(spark, rows), bucket_bytes=20_000).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in made) == want
    by = defaultdict(list)
    for r in made:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_order_of_input_does_not_matter_and_seed_does(spark, corpus):
    place = lambda parts, seed: {(r.doc_id): (r.shard, r.slot) for r in sharding.shuffled(documents(spark, corpus).repartition(parts), bucket_bytes=20_000, seed=seed).collect()}
    assert place(2, 1) == place(7, 1) != place(2, 2)


def test_written_texts_columns_and_few_rows(spark):
    frame = documents(spark, [(i, f"t{i}") for i in range(5)]).withColumnRenamed("lang", "_bucket").withColumnRenamed("source", "_start")
    folder = files.shared_folder(spark, "shards") + "/x"
    sharding.write(frame, folder)
    back = spark.read.parquet(folder)
    assert sorted((r.doc_id, r.text, r["_bucket"]) for r in back.collect()) == [(i, f"t{i}", "en") for i in range(5)]
    assert sharding.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_permutations_are_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, [1, i])) for i in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1150 and min(seen.values()) > 850
