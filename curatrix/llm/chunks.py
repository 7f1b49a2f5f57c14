"""Substring dedup by content-defined chunks.

A gear hash rolls over the folded bytes (A-Z lower-cased, white space one kind); a piece ends at a word whose hash, at its last byte, is not above those of the ``reach`` words on each side, so cuts depend on
these words and the 16 bytes before them only: an insertion moves no cut behind it, and where words or short lines repeat, the same place of each period ends a piece, since equal hashes all do. A piece has about
``2 * reach + 1`` words; one of more than ``longest`` (none in eight million random words) is divided from its start. A chunk is two neighbouring pieces, so that short common pieces alone never count, and chunks overlap by one. Chunks are known by a 64-bit digest of their words. A chunk is repeated if documents of different ids hold it; consecutive repeated chunks of ``least`` words or more
together are a repeated passage. The document of the smallest id keeps a chunk, the others lose it.

Digests are counted by sums that fold in each task, and only repeated ones are joined back; a digest that a third of all documents hold is split by the skew handling of that join. Only chunks
of one document ever meet in one row.

Null and empty texts have no chunks. Null ids count as one id, smaller than all others. Rows equal in id and text are reported once and treated alike. Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from curatrix.llm.text import SPACED, U, fresh, mix, per_text, slices, word_hashes, words

REACH, LONGEST, LEAST = 2, 32, 24
_NO_ID = -(2**63)
_GEAR = (mix(np.arange(257, 513, dtype=U)) >> U(48)).astype(np.uint16)
_PARTS = (U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93))


def gear(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``h = (h << 1) + gear[byte]`` modulo 2**16 at every byte of each text: the sum of 16 shifted bytes, doubled up in four steps."""
    h = _GEAR[low]
    place = np.arange(len(low), dtype=np.int32) - np.repeat(at[:-1], np.diff(at)).astype(np.int32)
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + np.where(place[step:] >= step, h[:-step] << np.uint16(step), np.uint16(0))
    return h


def _lowest(h: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """Which words have a hash that no word of their text within ``reach`` words has a smaller one than."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = np.ones(len(h), bool)
    for step in range(1, reach + 1):
        other = text[step:] != text[:-step]
        low[step:] &= other | (h[step:] <= h[:-step])
        low[:-step] &= other | (h[:-step] <= h[step:])
    return low


def cut(column: pa.Array, reach: int = REACH, longest: int = LONGEST):  # longest: at most 127
    """For each slice of texts: ``(first row, pieces' rows, digests, words, start bytes, end bytes, bytes, offsets)``."""
    for row, end, data, at in slices(column):
        low, starts, ends, first = words(data, at, SPACED)
        if not len(starts):
            continue
        h = gear(np.where(low == 0, 32, low), at)
        last = _lowest(h[ends - 1], first, reach)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        # no piece is longer than ``longest`` words: a run without a cut is divided from its start
        stop = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], stop[:-1]])
        pieces = -(-(stop - begin) // longest)
        if pieces.max() > 1:
            begin = np.repeat(begin, pieces) + longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            stop = np.concatenate([begin[1:], stop[-1:]])
        hashes = word_hashes(low, starts, ends)
        place = np.arange(len(hashes)) - np.repeat(begin, stop - begin)
        terms = mix(hashes + U(1)) * (_PARTS[0] * (U(2) * place.astype(U) + U(1)) ^ _PARTS[1])
        digest = mix(np.add.reduceat(terms, begin) + (stop - begin).astype(U))
        yield row, np.searchsorted(first, begin, side="right") - 1 + row, digest.view(np.int64), stop - begin, starts[begin], ends[stop - 1], data, at


_SEEN = StructType([StructField("digest", LongType()), StructField("doc", LongType())])
#: ``at`` packs the chunk's place and its two numbers of words, ``span`` the lengths up to the second piece and from there on; most chunks are shuffled only to be dropped.
_PLACED = StructType([StructField(n, LongType()) for n in ("digest", "doc", "text", "at", "start", "span")])


def _rows(docs: DataFrame, key: str, text: str, fn, schema: StructType) -> DataFrame:
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)), F.col(text).cast("string"))

    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for part in cut(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in fn(doc, *part)], names=schema.names)

    return source.mapInArrow(run, schema)


def _pairs(rows: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first piece, second piece, digest)`` of the chunks; a text of one piece has one chunk of it alone."""
    starts = np.concatenate([[True], rows[1:] != rows[:-1]])
    ends = np.concatenate([rows[1:] != rows[:-1], [True]])
    first = np.flatnonzero(~ends | starts)
    second = np.where(ends[first], first, first + 1)
    return first, second, mix(digest.view(U)[first] * _PARTS[0] + np.where(second > first, digest.view(U)[second], U(0))).view(np.int64)


def _seen(doc, row, rows, digest, *rest):
    """Each chunk once per document of a slice."""
    first, _, chunk = _pairs(rows, digest)
    rows = rows[first]
    order = np.lexsort((chunk, rows))
    rows, chunk = rows[order], chunk[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (chunk[1:] != chunk[:-1])])
    return chunk[new], doc[rows[new]]


def _texts(rows: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per piece its number in the text and a digest of the whole text."""
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    many = np.diff(np.concatenate([begin, [len(rows)]]))
    place = np.arange(len(rows)) - np.repeat(begin, many)
    whole = np.add.reduceat(mix(digest.view(U) + place.astype(U)), begin)
    return place, np.repeat(whole, many).view(np.int64)


def _placed(doc, row, rows, digest, many, start, end, data, at):
    first, second, chunk = _pairs(rows, digest)
    place, text = _texts(rows, digest)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[at[rows - row]]
    start, end = points[start] - base, points[end] - base
    more = np.where(second > first, many[second], 0)
    at, span = (place[first] << 14) | (many[first] << 7) | more, ((start[second] - start[first]) << 32) | (end[second] - start[second])
    return chunk, doc[rows[first]], text[first], at, start[first], span


def repeated_chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest, doc, text, place, words, more, start, middle, end, first_doc``: every chunk that documents of different ids hold."""
    seen = _rows(docs, key, text, _seen, _SEEN)
    shared = seen.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("_last")).where("first_doc < _last").drop("_last")
    middle = F.col("start") + F.shiftright("span", 32)
    return _rows(docs, key, text, _placed, _PLACED).join(shared, "digest").select(
        "digest", "doc", "text", "first_doc", F.shiftright("at", 14).cast("int").alias("place"), (F.shiftright("at", 7) % 128).cast("int").alias("words"), (F.col("at") % 128).cast("int").alias("more"),
        F.col("start").cast("int").alias("start"), middle.cast("int").alias("middle"), (middle + F.col("span") % (1 << 32)).cast("int").alias("end"))


_CUT = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_RUN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("words", IntegerType()), StructField("dropped", IntegerType()), StructField("cuts", ArrayType(_CUT))])


def passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc, text`` (a digest of the whole text) and ``passages``: ``(start, end, words, dropped, cuts)``, where ``cuts`` are the spans of the chunks
    that a document of a smaller id keeps and ``dropped`` counts their words. Positions are code points."""
    chunks = repeated_chunks(docs, key=key, text=text)
    row = F.struct("place", "words", "more", "start", "middle", "end", (F.col("first_doc") < F.col("doc")).alias("drop"))
    lists = chunks.groupBy("doc", "text").agg(F.array_sort(F.collect_set(row)).alias("chunks"))
    none, no_cut = F.array().cast(ArrayType(_RUN)), F.array().cast(ArrayType(_CUT))
    fields = ("start", "end", "words", "dropped", "cuts")

    def closed(got: Column) -> Column:
        return F.when(got["words"] >= least, F.concat(got["done"], F.array(F.struct(*[got[n].alias(n) for n in fields])))).otherwise(got["done"])

    def step(got: Column, x: Column) -> Column:
        on = x["place"] == got["place"] + 1
        kept = on & ~got["drop"]  # the first piece stays, as the end of a chunk that stays
        cuts, last = F.when(on, got["cuts"]).otherwise(no_cut), F.element_at(got["cuts"], -1)
        one = F.array(F.struct(F.when(kept, x["middle"]).otherwise(x["start"]).alias("start"), x["end"].alias("end")))
        longer = F.concat(F.slice(cuts, 1, F.size(cuts) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        new = F.when(on, F.lit(0)).otherwise(x["words"]) + x["more"]
        gone = F.when(~x["drop"], 0).when(on, x["more"]).otherwise(x["words"] + x["more"])
        return F.struct(
            F.when(on, got["done"]).otherwise(closed(got)).alias("done"), F.when(on, got["start"]).otherwise(x["start"]).alias("start"), x["end"].alias("end"),
            (F.when(on, got["words"]).otherwise(0) + new).alias("words"), (F.when(on, got["dropped"]).otherwise(0) + gone).alias("dropped"),
            F.when(~x["drop"] | (kept & (x["more"] == 0)), cuts).when(on & got["drop"], longer).otherwise(F.concat(cuts, one)).alias("cuts"),
            x["drop"].alias("drop"), x["place"].alias("place"))

    zero = F.struct(none.alias("done"), *[F.lit(0).alias(n) for n in ("start", "end", "words", "dropped")], no_cut.alias("cuts"), F.lit(False).alias("drop"), F.lit(-2).alias("place"))
    return lists.select("doc", "text", F.aggregate("chunks", zero, step, closed).alias("passages")).where(F.size("passages") > 0)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with a repeated passage, and its spans."""
    found = passages(docs.select("doc_id", "text"), **options)

    def total(field: str) -> Column:
        return F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x[field])

    return found.select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), F.size("passages").cast("long").alias("n_passages"), total("words").alias("repeated_words"), total("dropped").alias("dropped_words"),
        F.array_join(F.transform("passages", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All documents, each text without the repeated passages that an earlier document keeps."""
    digest, doc, spans = fresh(docs, "_digest"), fresh(docs, "_doc"), fresh(docs, "_spans")
    kind = StructType([StructField("text", LongType())])

    def whole(column: pa.Array) -> list[pa.Array]:
        out = np.zeros(len(column), np.int64)
        for _, rows, digest, *_ in cut(column):
            out[rows] = _texts(rows, digest)[1]
        return [pa.array(out)]

    marked = per_text(docs, text, whole, kind, digest).withColumns({digest: F.col(digest)["text"], doc: F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))})
    found = passages(docs, key=key, text=text, least=least).select(F.col("doc").alias(doc), F.col("text").alias(digest), F.flatten(F.transform("passages", lambda x: x["cuts"])).alias(spans)).where(F.size(spans) > 0)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(F.col(spans), start, lambda got, x: F.struct(x["end"].alias("at"), F.concat(got["out"], F.substring(F.col(text), got["at"] + 1, x["start"] - got["at"])).alias("out")),
                       lambda got: F.concat(got["out"], F.substring(F.col(text), got["at"] + 1, F.length(F.col(text)))))
    joined = marked.join(found, [doc, digest], "left")
    return joined.select(*[F.when(F.col(spans).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text else F.col(c) for c in docs.columns])
