import pytest
from curatrix.operators import review
from curatrix.streaming import jobs
from conftest import values
from test_review import OTHER, record


def feed(spark, folder, rows, schema="k string, n int"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def ingest(spark, root, **options):
    stream = spark.readStream.schema("k string, n int").option("maxFilesPerTrigger", 1).parquet(f"{root}/src")
    return jobs.incremental_ingest(stream, f"{root}/out", f"{root}/log", ["k"], ["n"], **options)


def test_ingest_resumes_without_doubling(spark, tmp_path):
    feed(spark, f"{tmp_path}/src", [("a", 2), ("a", 1), ("b", 5), (None, 3)])
    assert values(ingest(spark, tmp_path), "k", "n") == [("a", 1), ("b", 5), (None, 3)]
    feed(spark, f"{tmp_path}/src", [("a", 0), ("c", 7), (None, 1)])
    want = [("a", 1), ("b", 5), ("c", 7), (None, 3)]
    assert values(ingest(spark, tmp_path), "k", "n") == want
    assert values(ingest(spark, tmp_path), "k", "n") == want


def test_replayed_batches_and_written_parts_do_not_double(spark, tmp_path, monkeypatch):
    """The job dies between the rows and the filter of a batch that also rewrites filters; its replay gives the same table."""
    for i in range(4):
        feed(spark, f"{tmp_path}/src", [("hot", i), (f"k{i}", i)])
        ingest(spark, tmp_path, buckets=2, runs=2)
    feed(spark, f"{tmp_path}/src", [("hot", 9), ("k1", 9), ("new", 9)])
    real, calls = jobs.stored, []
    monkeypatch.setattr(jobs, "_files", lambda *a, f=jobs._files: f(*a) if "stop" not in calls else (_ for _ in ()).throw(OSError("lost")))
    monkeypatch.setattr(jobs, "stored", lambda df: (calls.append("stop") if len(calls) == 2 else calls.append("go")) or real(df))
    try:
        ingest(spark, tmp_path, buckets=2, runs=2)
    except Exception:
        pass
    monkeypatch.undo()
    assert values(ingest(spark, tmp_path, buckets=2, runs=2), "k", "n") == [("hot", 0), ("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3), ("new", 9)]


def test_files_read_per_batch_do_not_grow(spark, tmp_path, monkeypatch):
    opened, read = [], jobs._read
    monkeypatch.setattr(jobs, "_read", lambda s, schema, paths: opened.append(len(paths)) or read(s, schema, paths))
    most = []
    for i in range(9):
        feed(spark, f"{tmp_path}/src", [(f"k{i}-{j}", j) for j in range(6)] + [("k0-0", 50)])
        opened.clear()
        out = ingest(spark, tmp_path, buckets=2, runs=2)
        most.append(sum(opened))
    assert out.count() == 54 and max(most[4:]) <= max(most[:4]) + 1 and max(most) <= 2 * 3 + 1


def test_review_log_keeps_items_as_state(spark, tmp_path, monkeypatch):
    src, log, status, check = (str(tmp_path / x) for x in ("src", "log", "status", "check"))
    monkeypatch.setattr(jobs, "CHUNK", 1)

    def run():
        stream = spark.readStream.schema(review.REVIEW_SCHEMA).json(src)
        jobs.review_log_stream(stream, log, status, check)
        return dict(values(jobs.latest_status(spark, status), "item_id", "status"))

    def add(*rows):
        spark.createDataFrame(list(rows), review.REVIEW_SCHEMA).coalesce(1).write.mode("append").json(src)
        return run()

    assert add(record(), record("x1", pair="p2"), record("bad", pair="p3", schema="old")) == {"p1": "needs_second_review", "p2": "needs_second_review"}
    # A row that comes again changes nothing; a second review meets the first one from the state.
    assert add(record(), record("r2", who="bob", items=OTHER)) == {"p1": "needs_adjudication", "p2": "needs_second_review"}
    assert spark.read.parquet(f"{status}/batch_id=1").count() == 1 and spark.read.parquet(log).count() == 3
    assert run() == {"p1": "needs_adjudication", "p2": "needs_second_review"}


def test_review_log_replays_a_lost_batch(spark, tmp_path, monkeypatch):
    src, log, status, check = (str(tmp_path / x) for x in ("src", "log", "status", "check"))

    def run():
        jobs.review_log_stream(spark.readStream.schema(review.REVIEW_SCHEMA).json(src), log, status, check)

    def add(*rows):
        spark.createDataFrame(list(rows), review.REVIEW_SCHEMA).coalesce(1).write.mode("append").json(src)

    add(record())
    run()
    add(record("r2", who="bob", items=OTHER))
    monkeypatch.setattr(jobs, "adjudicate", lambda df: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception):
        run()
    monkeypatch.undo()
    run()
    assert dict(values(jobs.latest_status(spark, status), "item_id", "status")) == {"p1": "needs_adjudication"}
    assert spark.read.parquet(log).count() == 2


def test_review_log_moves_chunks_not_rows(monkeypatch):
    """Rows of an item reach the state a chunk at a time; rows that came before or twice are not kept again."""
    from types import SimpleNamespace

    import pandas as pd
    from pyspark.sql import types as T

    calls, kept = [], {}

    class State:
        def iterator(self):
            calls.append("read")
            return iter(sorted(kept.items(), reverse=True))

        def containsKey(self, key):  # noqa: N802
            calls.append("ask")
            return key in kept

        def updateValue(self, key, value):  # noqa: N802
            calls.append("write")
            kept[key] = value

    monkeypatch.setattr(jobs, "CHUNK", 100)
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("refs", T.ArrayType(T.StringType()))])
    item = jobs._Reviews(schema)
    item.init(SimpleNamespace(getMapState=lambda *_: State()))

    def come(numbers):
        calls.clear()
        made = [p for p in item.handleInputRows((1,), iter([pd.DataFrame({"item_id": numbers, "refs": [[str(i)] for i in numbers], "_digest": [f"d{i}" for i in numbers]})]), None)]
        rows = [r for p in made for r in p.itertuples(index=False, name=None)]
        return sorted(r[0] for r in rows if r[2]), sorted(r[0] for r in rows if not r[2])

    assert come([*range(250), *range(50)]) == ([*range(250)], []) and len(calls) <= 4
    assert come([*range(240, 420)]) == ([*range(250, 420)], [*range(250)]) and len(calls) <= 4
    assert come([7]) == ([], [*range(420)])
