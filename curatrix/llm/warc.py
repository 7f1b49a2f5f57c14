"""WARC: archives of one gzip member per record, and a splittable reader.

Writing. Of pages with equal payloads the one with the largest key is a ``response``, the others are ``revisit`` records without a payload that name it; payloads
below ``least`` bytes are always responses. The largest key comes from a map-side aggregate; its few rows are repeated ``salts`` times and joined on the digest and a salt
of the page, so a payload that a third of all pages share is spread over many tasks. Each task streams its records into files of its own; only the files that
successful tasks report belong to the archive, so a retry leaves no doubles.

Reading. Files are cut into byte ranges whatever their records. A task looks for the gzip magic in its range, decodes what stands there and takes it for a member only if a WARC header
comes out; then it follows members one after another, and owns those that start inside its range. What looks like a member inside another one (an archive stored as a payload) does not lead
to the end of the range or of the file: then the search goes on behind it. Ranges must therefore be longer than a record that stores archives uncompressed (``range_bytes``); any other record may be of any length.
Damage elsewhere raises an error instead of losing records.

Null payloads are empty. A null key is written as ``none`` and read as null; it never is the response that others name, and where all keys of a payload are null each page is a response. Repeated rows
are written as often as they stand. Empty tables give an archive without files, and reading it gives no rows. Line breaks in addresses become spaces.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from curatrix.llm import files
from curatrix.session import materialize

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = StructType([StructField("folder", StringType()), StructField("file", StringType()), StructField("bytes", LongType()), StructField("records", LongType())])
_RECORD = StructType([
    StructField("key", LongType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("target", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("intact", BooleanType()), StructField("payload", BinaryType())])


# ------------------------------------------------------------------ writing
def _name(key: int | None) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def record(key: int | None, target: str | None, payload: bytes, size: int, refers: int | None, digest: str) -> bytes:
    """One gzip member; ``payload`` is left out of a revisit, whose HTTP head still tells the full size."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if refers is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if target is not None:
        head.append(f"WARC-Target-URI: {' '.join(target.split())}")
    if refers is not None:
        head += [f"WARC-Refers-To: {_name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_responses(pages: DataFrame, key: str, payload: str, target: str | None, least: int, salts: int) -> DataFrame:
    """``key, target, payload, refers_to``: the key that a page revisits, else null."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"), (F.col(target) if target else F.lit(None)).cast("string").alias("target"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    shared = rows.groupBy("sha").agg(F.max("key").alias("newest"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("newest").isNotNull())
    shared = shared.select("sha", "newest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = rows.join(shared, ["sha", "salt"], "left")
    older = F.coalesce(F.col("key") < F.col("newest"), F.col("newest").isNotNull()) & (F.octet_length("payload") >= least)
    return joined.select("key", "target", "payload", F.when(older, F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, *, key: str = "page_id", payload: str = "html", target: str | None = "url", least: int = 0, file_bytes: int = 1 << 28, folder: str | None = None, salts: int = 16) -> DataFrame:
    """Writes the archive and returns its manifest ``(folder, file, bytes, records)``."""
    folder = folder or files.shared_folder(pages.sparkSession, "warc")
    target = target if target in pages.columns else None

    def run(batches):
        out, name, size, count = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"folder": folder, "file": name, "bytes": size, "records": count}])

        for batch in batches:
            for k, uri, body, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, path = files.resolve(f"{folder}/{name}")
                    out = system.open_output_stream(path, compression=None)
                data = body.as_py()
                digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                size += out.write(record(k.as_py(), uri.as_py(), data, len(data), refers.as_py(), digest))
                count += 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialize(with_responses(pages, key, payload, target, least, salts).mapInArrow(run, _MANIFEST))


# ------------------------------------------------------------------ reading
class _Broken(Exception):
    pass


class _File:
    """Reads members at byte positions."""

    def __init__(self, source, size: int, step: int = 1 << 18):
        self.source, self.size, self.step = source, size, step

    def at(self, position: int, most: int) -> bytes:
        return self.source.read_at(max(0, min(most, self.size - position)), position)

    def member(self, position: int, head_only: bool = False) -> tuple[bytes, int]:
        """``(content, end)`` of the member at a position; with ``head_only`` what the first blocks give."""
        unpack, parts, place = zlib.decompressobj(31), [], position
        step = 1 << 14 if head_only else self.step
        try:
            while not unpack.eof:
                raw = self.at(place, step)
                if not raw:
                    raise _Broken
                parts.append(unpack.decompress(raw))
                place += len(raw)
                if head_only and (b"\r\n\r\n" in parts[-1] or sum(map(len, parts)) > 1 << 20):
                    return b"".join(parts), place
        except zlib.error as e:
            raise _Broken from e
        return b"".join(parts), place - len(unpack.unused_data)

    def is_member(self, position: int) -> bool:
        if self.at(position, 3) != MAGIC:
            return False
        try:
            head = self.member(position, head_only=True)[0]
        except _Broken:
            return False
        return head.startswith(b"WARC/1.") and b"\r\nWARC-Type:" in head.partition(b"\r\n\r\n")[0]


def members(file: _File, start: int, end: int) -> Iterator[bytes]:
    """The contents of the members that start in ``[start, end)``."""
    place = start
    while place < end:
        place = _next_magic(file, place, end)
        if place is None:
            return
        if not file.is_member(place):
            place += 1
            continue
        chain, at = [], place
        try:
            while at < end and at < file.size:
                if not file.is_member(at):
                    raise _Broken
                content, at = file.member(at)
                chain.append(content)
            if at < file.size and not file.is_member(at):
                raise _Broken
        except _Broken:
            if start == 0 or place != start and chain == []:
                raise ValueError(f"damaged member at byte {at}") from None
            place += 1
            continue
        yield from chain
        return


def _next_magic(file: _File, place: int, end: int) -> int | None:
    while place < end:
        data = file.at(place, min(file.step, end - place) + len(MAGIC) - 1)
        at = data.find(MAGIC)
        if at >= 0:
            return place + at
        place += file.step
    return None


def parse(content: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = {}
    for name in ("warc-record-id", "warc-refers-to"):
        text = fields.get(name, "").strip("<>").rpartition(":")[2]
        number[name] = int(text) if text.lstrip("-").isdigit() else None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else digest
    return {
        "key": number["warc-record-id"], "record_type": kind, "refers_to": number["warc-refers-to"], "target": fields.get("warc-target-uri"), "payload_bytes": len(payload) if kind == "response" else sum(sizes[:1]),
        "payload_digest": own, "intact": own == digest, "payload": payload if kind == "response" else None}


def read(manifest: DataFrame, *, range_bytes: int = 1 << 22, payload: bool = True) -> DataFrame:
    """The records of all files of a manifest, read by byte ranges."""
    ranges = manifest.where(F.col("bytes") > 0).select("folder", "file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start")
    schema = StructType([f for f in _RECORD.fields if payload or f.name != "payload"])
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = files.resolve(f"{r['folder']}/{r['file']}")
                with system.open_input_file(path) as source:
                    rows = []
                    for content in members(_File(source, r["bytes"]), r["start"], min(r["start"] + range_bytes, r["bytes"])):
                        rows.append({k: v for k, v in parse(content).items() if payload or k != "payload"})
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ranges.mapInArrow(run, schema)


def report(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages, reads them back, and returns one row per page."""
    return read(write(pages, **options), payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
