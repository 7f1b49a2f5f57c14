"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion; exact.

A document is the set of its distinct word shingles; Jaccard distance on sets is a metric, and two documents link when it is at most ``1 - percent / 100`` (``eps``).

Level 0. Unrelated documents are all at distance 1 from any pivot, so a Voronoi diagram of the whole space would copy every document into every region. The space is therefore first cut into *blocks*
that lose no link: a set of ``s`` shingles and a partner of it differ in at most ``D(s)`` shingles, so if shingles are dealt into classes by hash, both fill all but ``D`` of the set's ``m`` classes equally.
A block is all sets with one equal class (single shingles take the place of classes for sets below 64), and a set of which fewer than ``m - D`` classes have met another set links with nothing and leaves all blocks; that
frees documents which only share a passage, however common. Blocks hold sets that have much in common, where distances tell something. Equal sets are one point from the start.

Distances. A set's sketch holds the parities of its shingles in ``BITS`` cells. Two sketches differ in no more cells than the sets in shingles, and so do their sizes; the larger of both numbers is a metric and ``2 d / (n + m + d)`` of it again
(Steinhaus), never above the Jaccard distance. Recursion and comparison go by this bound, 256 bytes a set; texts move only for pairs that it leaves within ``eps`` and that are not connected yet, and these are compared exactly.
For sets of much more than three times ``BITS`` shingles the bound says little, and only sizes spare texts.

Recursion. In each block of more than ``small`` sets those with most blocks (one for each of four slots) are pivots; every set of the block is compared with them. A set goes to the region of its nearest pivot (Voronoi), and also to that of
any pivot at most ``2 eps`` farther, and inside a region to the ring of its distance and the next one: by the triangle inequality both ends of every link meet in a ring. Blocks whose sets are already connected need no
more comparisons and end; the rings of the others are the next blocks, without their pivots. Once ``few`` pairs are left in blocks, after ``depth`` levels, or when a level leaves more than half of the pairs (it is undone then), the sketches of what is left are compared by tiles of
``TILE`` by ``TILE`` sets: first each set's text with one partner that its tile offers, then those of all pairs that are still not connected.

Texts stream: a pivot's texts are dealt over as many tasks as its partners need, the pivot's text first. No group is collected, nothing but counts reaches the driver.

Null and empty texts and texts of white space alone have no shingles and link with nothing; a text of fewer words than a shingle has one of all its words. Rows with a null id link with nothing and get a null
component. Rows of equal id are one document. Empty tables give empty results. Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from curatrix.llm import files
from curatrix.llm.components import components
from curatrix.llm.text import U, buffers, fresh, mix, shingle_sets, slices
from curatrix.session import materialize, tidy

SIZE, PERCENT = 4, 85
BITS, TILE = 2048, 1024
_FLAT = 6  # labels below use single shingles
_LONGS = lambda *names: StructType([StructField(n, LongType()) for n in names])


def most(size: int, percent: int) -> int:
    """The largest union of a set of ``size`` with a set that it links with."""
    return 100 * size // percent


def differing(size: int, percent: int) -> int:
    """How many shingles a set of ``size`` and one that it links with can differ in."""
    return most(size, percent) * (100 - percent) // 100


def identity(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two numbers: the first is its id."""
    if not len(hashes):
        return 0, 0
    a = int(mix(hashes ^ U(0xA0761D6478BD642F)).sum(dtype=U)) + 0x9E3779B97F4A7C15 * len(hashes)
    b = int(mix(hashes + U(0xE7037ED1A0B428DB)).sum(dtype=U))
    return _signed(a), _signed(b)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def labels(n: int, percent: int) -> tuple[int, ...]:
    """The size classes in which a set meets its partners: its own, and the next one if a partner can be that large."""
    own = n.bit_length() - 1
    return (own, own + 1) if most(n, percent) >= 2 << own else (own,)


def classes(label: int, percent: int) -> int:
    """Into how many classes a size class is dealt: a quarter of its sizes, more for lower limits, so that its largest sets fill more than differ by eight deviations of the number filled."""
    size = 2 << label
    for many in (size // 4 << i for i in range(5)):
        mean = size / many
        free = math.exp(-mean)
        if many * (1 - free) - differing(size - 1, percent) > 8 * math.sqrt(many * free * (1 - (1 + mean) * free)):
            break
    return many


def signatures(hashes: np.ndarray, percent: int, label: int) -> tuple[np.ndarray, int]:
    """The blocks of a set in a size class, and how many of them any partner shares there."""
    seed = U((label + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
    if label < _FLAT:
        return mix(hashes ^ seed), len(hashes) - differing(len(hashes), percent)
    dealt = mix(hashes ^ seed)
    own = (dealt % U(classes(label, percent))).astype(np.int64)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    need = len(first) - differing(len(hashes), percent)
    if need < 1:
        raise ValueError("a set fills too few classes to be joined exactly; percent must be above 50")
    total = np.add.reduceat(mix(dealt[order] + U(1)), first)
    return mix(total ^ mix(own[first].astype(U) + seed)), need


# ------------------------------------------------------------------ passes over the texts
def described(docs: DataFrame, key: str, text: str, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, n, sid, check, digest)``: size and identity of each row's set, a digest of its text; and the columns ``extra``."""
    source = docs.select(F.col(key).cast("long"), F.col(text).cast("string"), F.xxhash64(F.col(text).cast("string")), *extra)
    names = ["doc", "n", "sid", "check", "digest", *extra]

    def run(batches):
        for batch in batches:
            rows = [(len(s), *identity(s)) for s in shingle_sets(batch.column(1), size)]
            n, sid, check = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid), pa.array(check), *[batch.column(2 + i) for i in range(1 + len(extra))]], names=names)

    return source.mapInArrow(run, _LONGS(*names))


def blocked(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``(block, sid, need)`` of every set, ``need`` with the size class in its lowest bit; sets that a task has seen before are left out there."""
    source = docs.where(F.col(key).isNotNull()).select(F.col(text).cast("string"))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for row, end, _, _ in slices(batch.column(0), 1 << 21):
                blocks, ids, needs = [], [], []
                for s in shingle_sets(batch.column(0).slice(row, end - row), size):
                    sid = identity(s)[0]
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    for up, label in enumerate(labels(len(s), percent)):
                        made, need = signatures(s, percent, label)
                        blocks.append(made)
                        ids.append(np.full(len(made), sid, np.int64))
                        needs.append(np.full(len(made), need << 1 | up, np.int64))
                if blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (blocks, ids, needs)], names=["block", "sid", "need"])

    return source.mapInArrow(run, _LONGS("block", "sid", "need"))


def shared(rows: DataFrame) -> DataFrame:
    """The distinct rows of blocks that hold more than one set."""
    block = Window.partitionBy("block")
    met = rows.withColumns({"a": F.min("sid").over(block), "b": F.max("sid").over(block)}).where("a != b")
    return met.select("block", "sid", "need").distinct()


def able(rows: DataFrame) -> DataFrame:
    """The rows of sets that share as many blocks as a partner of theirs would."""
    met = rows.groupBy("sid", "need").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= F.shiftright("need", 1)).select("sid", "need")
    return rows.join(met, ["sid", "need"])


def _compared(pairs: DataFrame, texts: DataFrame, size: int, together: int = 2048) -> DataFrame:
    """``(sid, pivot, both, n, m)`` for pairs of sets: the size of the intersection and of each set. Partners of one pivot are dealt over tasks of ``together`` sets."""
    spark = pairs.sparkSession
    many = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("many")).withColumn("cells", F.ceil(F.col("many") / together).cast("int"))
    members = pairs.join(many, "pivot").select("pivot", F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("role"), "sid")
    heads = many.select("pivot", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("role"), F.col("pivot").alias("sid"))
    rows = heads.unionByName(members).join(texts, "sid").select("pivot", "cell", "role", "sid", "text")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "cell").sortWithinPartitions("pivot", "cell", "role", "sid")
    schema = _LONGS("sid", "pivot", "both", "n", "m")

    def run(batches):
        now, own = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                out = []
                for pivot, cell, role, sid, s in zip(*(piece.column(i).to_pylist() for i in range(4)), shingle_sets(piece.column(4), size), strict=True):
                    if identity(s)[0] != sid:
                        continue  # another text of a document of several rows
                    if role == 0:
                        now, own = (pivot, cell), s
                    elif now == (pivot, cell):
                        out.append((sid, pivot, len(np.intersect1d(own, s, assume_unique=True)), len(s), len(own)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ sketches
def sketch(hashes: np.ndarray) -> bytes:
    """The parities of a set's shingles in ``BITS`` cells."""
    cells = np.bincount((hashes >> U(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def _cells(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    data, at = buffers(column)
    return data[at[0]: at[-1]].reshape(len(column), BITS // 8).view(U)


def least_apart(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many shingles sets of sizes ``n`` and ``m`` differ at least, by their sketches."""
    return np.maximum(np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64), np.abs(n - m))


def _within(n, m, apart, percent: int):
    """Whether sets may link that differ in no less than ``apart`` shingles."""
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """``(sid, n, sketch)`` of every set."""
    schema = StructType([StructField("sid", LongType()), StructField("n", LongType()), StructField("sketch", BinaryType())])

    def run(batches):
        for batch in batches:
            rows = [(sid, len(s), sketch(s)) for sid, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True) if identity(s)[0] == sid]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=schema.names)

    return texts.select("sid", "text").mapInArrow(run, schema).dropDuplicates(["sid"])


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(sid, pivot, n, m, apart)`` for pairs of sets."""
    other = sketches.select(F.col("sid").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    rows = pairs.join(sketches, "sid").join(other, "pivot").select("sid", "pivot", "n", "m", "sketch", "other")
    names = ["sid", "pivot", "n", "m", "apart"]

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(least_apart(_cells(batch.column(4)), _cells(batch.column(5)), n, m))], names=names)

    return rows.mapInArrow(run, _LONGS(*names))


def _near(sid: np.ndarray, root: np.ndarray, n: np.ndarray, own: np.ndarray, cells: np.ndarray, cross: bool, percent: int, every: bool, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(sid, pivot)`` of the pairs of a tile that may link; with ``one`` only the pair of each set with its least partner."""
    order = np.argsort(sid)
    sid, root, n, own, cells = (x[order] for x in (sid, root, n, own, cells))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 4096 // len(sid))
    for start in range(1, len(sid), step):
        x, y = slice(start, start + step), slice(0, start + step)
        met = _within(n[x, None], n[None, y], np.abs(n[x, None] - n[None, y]), percent) & (sid[x, None] > sid[None, y])
        if not every:
            met &= root[x, None] != root[None, y]
        if cross:
            met &= own[x, None] != own[None, y]
        i, j = np.nonzero(met)
        fine = _within(n[x][i], n[j], least_apart(cells[x][i], cells[j], n[x][i], n[j]), percent)
        i, j = i[fine], j[fine]
        if one and len(i):
            first = np.concatenate([[True], i[1:] != i[:-1]])
            i, j = i[first], j[first]
        out.append((sid[x][i], sid[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (sid[:0], sid[:0])


def _tiled(blocks: DataFrame, sketches: DataFrame, percent: int, every: bool, one: bool) -> DataFrame:
    """The distinct ``(sid, pivot)`` inside blocks that may link and, but with ``every``, are not connected. Blocks are dealt by tiles: parts of about ``TILE`` sets, each with each."""
    spark = blocks.sparkSession
    many = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    rows = blocks.join(many, "block").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).join(sketches, "sid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *[F.col(c).cast("long") for c in ("sid", "root", "n", "own")], "sketch")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "a", "b").sortWithinPartitions("block", "a", "b")

    def run(batches):
        held: list = []
        now = None

        def flush():
            made = _near(*(np.concatenate(x) for x in zip(*held, strict=True)), now[1] != now[2], percent, every, one)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["sid", "pivot"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            rest = [*[batch.column(i).to_numpy() for i in range(3, 7)], _cells(batch.column(7))]
            cut = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and tuple(key[:, a]) != now:
                    yield flush()
                    held = []
                now = tuple(key[:, a])
                held.append([x[a:b] for x in rest])
        if held:
            yield flush()

    return rows.mapInArrow(run, _LONGS("sid", "pivot")).distinct()


# ------------------------------------------------------------------ the join
class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int, every: bool = False):
        self.every = every  # compare connected sets too
        self.spark, self.docs, self.key, self.text, self.size, self.percent = docs.sparkSession, docs, key, text, size, percent
        self.folder = files.shared_folder(self.spark, "jaccard")
        self.eps = 1 - percent / 100
        self.compared: DataFrame | None = None
        self.root: DataFrame | None = None

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Compares the texts of pairs that were not compared before, and finds the components anew."""
        if self.compared is not None:
            ends = F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")
            pairs = pairs.select("sid", "pivot", *ends).join(self.compared.select(*ends), ["a", "b"], "left_anti").select("sid", "pivot")
        made = self.stored(_compared(materialize(pairs), self.texts, self.size), name)
        self.compared = made if self.compared is None else self.compared.unionByName(made)
        self.root = components(self.links(), "sid", "pivot")

    def links(self) -> DataFrame:
        return self.compared.where(100 * F.col("both") >= self.percent * (F.col("n") + F.col("m") - F.col("both"))).select("sid", "pivot")

    def rooted(self, rows: DataFrame, of: str, root: str) -> DataFrame:
        """``rows`` and the root of the set ``of``, itself if it has no link."""
        if self.root is None:
            return rows.withColumn(root, F.col(of))
        return rows.join(self.root.select(F.col("node").alias(of), F.col("root").alias(root)), of, "left").withColumn(root, F.coalesce(root, of))

    def open_blocks(self, blocks: DataFrame) -> DataFrame:
        """The blocks whose sets are not all in one component, with the ``root`` of each set."""
        joined = materialize(self.rooted(blocks, "sid", "root"))
        if self.every:
            return joined
        apart = joined.groupBy("block").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("block")
        return joined.join(apart, "block")

    def run(self, depth: int, small: int, few: int) -> DataFrame:
        """``(sid, root)`` of the sets that link with another one."""
        rows = materialize(shared(blocked(self.docs, self.key, self.text, self.size, self.percent)))
        rows = materialize(able(rows))
        blocks = self.stored(shared(rows).select("block", "sid"), "blocks")
        self.texts = self._texts(blocks)
        self.sketches = self.stored(_sketches(self.texts, self.size), "sketches")
        self.weight = materialize(blocks.groupBy("sid").agg(F.count(F.lit(1)).alias("weight")))
        blocks, before, ended = self._once(blocks), math.inf, []
        for level in range(depth):
            many = materialize(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("many")))
            pairs = many.where(F.col("many") > small).agg(F.sum(F.col("many") * (F.col("many") - 1) / 2)).first()[0] or 0
            if pairs > before / 2:
                blocks = large
            if pairs <= few or pairs > before / 2:
                break
            held = many.where(F.col("many") > small).select("block")
            ended.append(blocks.join(held, "block", "left_anti").select("block", "sid"))
            large, before = materialize(blocks.join(held, "block").select("block", "sid")), pairs
            blocks = self._level(large, level)
        blocks = blocks.select("block", "sid")
        for part in ended:
            blocks = blocks.unionByName(part)
        if not self.every:
            self.compare(_tiled(self.open_blocks(blocks), self.sketches, self.percent, False, True), "one")
        self.compare(_tiled(self.open_blocks(blocks), self.sketches, self.percent, self.every, False), "last")
        return self.root

    def _texts(self, blocks: DataFrame) -> DataFrame:
        """``(sid, text)`` of every set in a block: the row of its smallest id, found by id and text, since many texts may have one id."""
        wanted = self.spark.read.schema(blocks.schema).parquet(f"{self.folder}/blocks").select("sid").distinct()
        firsts = self.sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc", "digest")).alias("least"))
        firsts = materialize(firsts.select("sid", "least.doc", "least.digest").join(wanted, "sid"))
        # 24 bytes a row; a list beyond this bound is joined by a shuffle instead
        few = F.broadcast(firsts) if firsts.count() <= 500_000 else firsts
        docs = self.docs.select(F.col(self.key).cast("long").alias("doc"), F.col(self.text).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
        return self.stored(docs.join(few, ["doc", "digest"]).select("sid", "text"), "texts")

    @staticmethod
    def _once(blocks: DataFrame) -> DataFrame:
        """One of the blocks that hold the same sets."""
        held = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("many"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("total"))
        return materialize(blocks.join(held.groupBy("many", "total").agg(F.min("block").alias("block")).select("block"), "block"))

    def _level(self, blocks: DataFrame, level: int) -> DataFrame:
        eps = self.eps
        ranked = blocks.join(self.weight, "sid").withColumn("slot", F.pmod(F.xxhash64("sid", F.lit(level)), F.lit(4)).cast("int"))
        pivots = materialize(ranked.groupBy("block", "slot").agg(F.max(F.struct("weight", "sid"))["sid"].alias("pivot")).select("block", "pivot"))
        asked = blocks.join(pivots, "block").where("sid != pivot").select("sid", "pivot").distinct()
        known = self.stored(_sketched(asked, self.sketches), f"distances-{level}")
        close = known.where(_within(F.col("n"), F.col("m"), F.col("apart"), self.percent)).select("sid", "pivot")
        if not self.every:
            close = self.rooted(self.rooted(close, "sid", "x"), "pivot", "y").where("x != y").select("sid", "pivot")
        self.compare(close, f"compared-{level}")
        left = self.open_blocks(blocks)
        known = known.select("sid", "pivot", (2 * F.col("apart") / (F.col("n") + F.col("m") + F.col("apart"))).alias("d"))
        rest = left.join(pivots.select("block", F.col("pivot").alias("sid")), ["block", "sid"], "left_anti")
        near = rest.join(pivots, "block").join(known, ["sid", "pivot"])
        home = near.groupBy("block", "sid").agg(F.min("d").alias("home"))
        near = near.join(home, ["block", "sid"]).where(F.col("d") <= F.col("home") + 2 * eps + 1e-9)
        ring = F.floor(F.col("d") / (eps + 1e-9)).cast("int")
        # the blocks that chose one pivot make one region: both ends of a link share a block, so they share its regions
        rings = near.select("pivot", "sid", "root", F.explode(F.array(ring, ring + 1)).alias("ring")).distinct()
        cells = materialize(rings.select(F.xxhash64("pivot", "ring", F.lit(level)).alias("block"), "sid", "root"))
        apart = cells.groupBy("block").agg(F.min("sid" if self.every else "root").alias("a"), F.max("sid" if self.every else "root").alias("b")).where("a < b").select("block")
        return self._once(cells.join(apart, "block").select("block", "sid"))


def _joined(docs: DataFrame, key: str, text: str, size: int, percent: int, depth: int = 5, small: int = 64, few: int = 16_000_000, every: bool = False, extra: tuple[str, ...] = ()) -> tuple[_Join, DataFrame]:
    """The join with its rows' sets, columns of longs ``extra`` beside them, and ``(sid, root)`` of the sets that link with another one."""
    join = _Join(docs, key, text, size, percent, every)
    with tidy(join.spark):
        join.sets = join.stored(described(docs, key, text, size, extra), "sets")
        bad = join.sets.where("n > 0").groupBy("sid").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b")
        if bad.head(1):
            raise ValueError("two sets share a 64-bit identity; change the seeds")
        return join, join.run(depth, small, few)


def linked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, depth: int = 5, small: int = 64, few: int = 16_000_000, salts: int = 16) -> DataFrame:
    """``doc, n_shingles, component``: one row per document; ``component`` is the smallest id that its links reach."""
    join, roots = _joined(docs, key, text, size, percent, depth, small, few)
    sets = join.sets.where("n > 0 and doc is not null")
    groups = sets.groupBy("sid").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    groups = groups.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").where("first < last or root is not null").withColumn("root", F.coalesce("root", "sid"))
    groups = materialize(groups)
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    named = groups.join(least, "root").select("sid", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = join.sets.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    found = rows.join(named, ["sid", "salt"], "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")))
    return found.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).alias("component"))


def report(docs: DataFrame, **options) -> DataFrame:
    return linked(docs, **options).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, depth: int = 5, small: int = 64, few: int = 16_000_000) -> DataFrame:
    """``doc, n_shingles, component, n_links``: the link form. Any two different sets that meet in a ring are compared, connected or not, so no link is missing.

    ``n_links`` counts the other documents whose sets are equal to that of the row or link with it (one with several linked texts once for each); null for a null id. The number of comparisons grows with the square
    of a group of different near copies, as the number of links does."""
    join, roots = _joined(docs, key, text, size, percent, depth, small, few, every=True)
    rows = join.sets.where("n > 0 and doc is not null")
    holders = materialize(rows.select("sid", "doc").distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first")))
    named = holders.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select("sid", "docs", "least")
    found = join.links().where("sid != pivot").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(holders.select(F.col("sid").alias("b"), "docs"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("docs").alias("others"))
    named = named.join(met, "sid", "left").select("sid", "least", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    made = join.sets.join(named, "sid", "left")
    linkable, known = F.col("n") > 0, F.col("doc").isNotNull()
    return made.select("doc", F.col("n").alias("n_shingles"), F.when(known, F.coalesce(F.when(linkable, F.col("least")), "doc")).alias("component"), F.when(known, F.coalesce(F.when(linkable, F.col("n_links")), F.lit(0))).alias("n_links"))


def link_report(docs: DataFrame, **options) -> DataFrame:
    return links(docs, **options).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "n_links")


def _once_a_task(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows that a task has seen before by the columns of longs ``names`` go, so that many equal rows do not meet in one task of a shuffle."""
    at = [rows.columns.index(n) for n in names]

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            new = []
            for mark in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                new.append(mark not in seen)
                seen.add(mark)
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, **options) -> DataFrame:
    """One row of each component of linked texts, all columns as they came: the one of the smallest id, then of the smallest digest of its text, then of the whole row. Different texts under one id are rows
    of their own: those that link with nothing stay. So do rows without shingles and rows of a null id."""
    doc, digest, whole = marks = [fresh(docs, n) for n in ("_doc", "_digest", "_whole")]
    fields = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    # no words: the white space of ``text.SPACED``
    plain = F.col(text).cast("string")
    bare = F.col(key).cast("long").isNull() | ~F.coalesce(plain.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    marked = docs.where(~bare).withColumns({doc: F.col(key).cast("long"), digest: F.xxhash64(plain), whole: F.xxhash64(*fields)})
    join, roots = _joined(marked, key, text, size, percent, **options, extra=(whole,))
    # one row for each set before the links are joined: a set that many rows hold is no group of a join
    least = F.min(F.struct("doc", "digest", whole)).alias("least")
    sets = join.sets.groupBy("sid").agg(least).join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
    kept = sets.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.doc").alias(doc), F.col("least.digest").alias(digest), F.col(f"least.{whole}").alias(whole))
    stay = _once_a_task(marked, marks).join(kept, marks, "left_semi").dropDuplicates(marks).select(docs.columns)
    return stay.unionByName(docs.where(bare))
