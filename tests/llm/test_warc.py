import base64
import gzip
import hashlib
import io
import os
import random

import pytest

from curatrix.llm import files, warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", p))
    return sorted(((p, len((h or "").encode()), digest(h), "response" if best.get(h or "", p) == p else "revisit", None if best.get(h or "", p) == p else best[h or ""]) for p, _, h in rows), key=str)


def test_round_trip_with_hot_payload(spark):
    random.seed(3)
    rows = [(i, f"http://a/{i}", "same é" if i % 3 == 0 else "".join(random.choices("abc<>é\r\n", k=random.randint(0, 3000)))) for i in range(200)]
    rows += [(300, None, None), (301, "x\r\ny", ""), (302, "u", "WARC/1.1\r\n\r\n"), (None, "u", "only null"), (None, "u", "same é"), (5, "dup", "same é")]
    made = warc.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert all(r.intact for r in made)
    assert sorted((tuple(r)[:5] for r in made), key=str) == expected(rows)


def test_threshold_and_empty(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], SCHEMA)
    made = {r.page_id: r.record_type for r in warc.report(frame, least=3).collect()}
    assert made == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("step", [7, 100, 1 << 20])
def test_any_ranges_give_all_records(spark, step):
    rows = [(i, f"u{i}", f"page {i} " * (i % 40)) for i in range(60)]
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), file_bytes=4000)
    assert manifest.count() > 2
    back = warc.read(manifest, range_bytes=step).collect()
    assert sorted((r.key, bytes(r.payload or b"").decode()) for r in back if r.record_type == "response") == sorted((p, h) for p, _, h in rows if p not in {r.key for r in back if r.record_type == "revisit"})
    assert len(back) == 60 and {r.target for r in back} == {u for _, u, _ in rows}


def _file(data):
    class Source:
        def read_at(self, n, at):
            return data[at: at + n]

    return warc._File(Source(), len(data), step=64)


def test_nested_archives_and_magic_inside_records():
    inner = b"".join(warc.record(i, "x", b"inner", 5, None, "D") for i in range(3))
    stored = io.BytesIO()
    with gzip.GzipFile(fileobj=stored, mode="wb", compresslevel=0) as out:
        block = b"HTTP/1.1 200 OK\r\n\r\n" + inner + warc.MAGIC * 20
        out.write(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    data = warc.record(1, "u", b"first", 5, None, "D") + stored.getvalue() + warc.record(2, "u", b"last", 4, None, "D")
    start, end = len(warc.record(1, "u", b"first", 5, None, "D")), len(data) - len(warc.record(2, "u", b"last", 4, None, "D"))
    for cut in (1, start, start + 1, start + 70, end - 70, end - 1, end, end + 1):  # ranges that reach out of the member that holds an archive
        keys = [warc.parse(c)["key"] for s, e in ((0, cut), (cut, len(data))) for c in warc.members(_file(data), s, e)]
        assert keys == [1, 9, 2], cut


def test_damage_is_an_error():
    data = b"".join(warc.record(i, "u", os.urandom(200), 200, None, "D") for i in range(5))
    bad = data[: len(data) // 2] + b"\0" * 40 + data[len(data) // 2 + 40:]
    with pytest.raises(ValueError, match="damaged"):
        list(warc.members(_file(bad), 0, len(bad)))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.members(_file(data[:-5]), 0, len(data) - 5))


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, "u", "h", "x", 3)], "page_id long, url string, html string, sha string, salt int")
    assert warc.report(frame).first().record_type == "response"
    assert files.resolve("file:///tmp/x")[1] == "/tmp/x"
