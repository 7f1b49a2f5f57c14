"""Scans. Files are listed and read by Spark's own sources; schemas are given, never inferred."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Required columns of the ten catalogue datasets.
CATALOG: dict[str, tuple[str, ...]] = {
    "minifigs": ("fig_num", "name", "num_parts", "img_url"),
    "inventories": ("id", "version", "set_num"),
    "inventory_minifigs": ("inventory_id", "fig_num", "quantity"),
    "inventory_parts": ("inventory_id", "part_num", "color_id", "quantity", "is_spare", "img_url"),
    "parts": ("part_num", "name", "part_cat_id", "part_material"),
    "part_relationships": ("rel_type", "child_part_num", "parent_part_num"),
    "elements": ("element_id", "part_num", "color_id", "design_id"),
    "colors": ("id", "name", "rgb", "is_trans"),
    "sets": ("set_num", "name", "year", "theme_id", "num_parts", "img_url"),
    "themes": ("id", "name", "parent_id"),
}


def normalise_header(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_]", "_", name.lstrip("﻿").strip()).lower()
    return f"c_{clean}" if clean[:1].isdigit() else clean


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_csv_catalog(spark: SparkSession, folder: str, datasets: Mapping[str, Sequence[str]] = CATALOG) -> dict[str, DataFrame]:
    """All-text frames per dataset: ``.csv.gz`` before ``.csv``, headers normalised, values trimmed, blanks null.

    Duplicate headers, missing required columns and rows with extra fields raise.
    """
    out = {}
    for name, required in datasets.items():
        path = next((f"{folder}/{name}.csv{s}" for s in (".gz", "") if _exists(spark, f"{folder}/{name}.csv{s}")), None)
        if path is None:
            raise FileNotFoundError(f"{folder}/{name}.csv[.gz]")
        first = spark.read.text(path).limit(1).collect()
        if not first:
            raise ValueError(f"{name}: empty file")
        header = spark.createDataFrame([(first[0][0],)], "line string").select(
            F.from_csv("line", ", ".join(f"h{i} string" for i in range(first[0][0].count(",") + 1))).alias("h")).first()["h"]
        columns = [normalise_header(h) for h in header if h is not None]
        doubled = {c for c in columns if columns.count(c) > 1}
        missing = [c for c in required if c not in columns]
        if doubled or missing:
            raise ValueError(f"{name}: duplicate headers {sorted(doubled)}, missing columns {missing}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True,
                             ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, quote='"', escape='"')
        out[name] = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])
    return out


def scan_jsonl(spark: SparkSession, paths: str | list[str], schema: str, line_numbers: bool = False) -> DataFrame:
    """One object per non-blank line, plain or gzip, with its file; a malformed line raises.

    Line numbers need a per-file order, so they are computed only on request.
    """
    if not line_numbers:
        return spark.read.schema(schema).json(paths, mode="FAILFAST").withColumn("source_path", F.col("_metadata.file_path"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"))
    from curatrix.operators.scale import position

    numbered = position(lines.withColumn("_at", F.monotonically_increasing_id()), ["_block", "_at"], ["source_path"], "line_no")
    return numbered.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "source_path", "line_no").select(
        "r.*", "source_path", "line_no")


# Fixed values, as given: keys under which a document may hold its list.
RECORD_KEYS = ("data", "items", "cosmetics", "results", "records")


def scan_records_document(spark: SparkSession, path: str, item_schema: str, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """Rows of a JSON document: the root list, else the first list under one of the keys."""
    text = spark.read.text(path, wholetext=True)
    array = F.from_json("value", f"array<{item_schema}>")
    lists = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{item_schema}>") for k in keys]
    rooted = F.ltrim("value").startswith("[")
    return text.select(F.explode(F.when(rooted, array).otherwise(F.coalesce(*lists))).alias("r")).select("r.*")


def scan_decision_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Every JSON document of a pattern with its file name; a broken file stays as a row with ``parse_error``."""
    text = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    parsed = F.from_json("value", f"struct<{schema}, _corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"})
    out = text.select("source_file", parsed.alias("r"))
    failed = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    fields = [f.name for f in T.StructType.fromDDL(schema.replace(":", " ")).fields] if ":" not in schema else [s.split(":")[0].strip() for s in _split_fields(schema)]
    return out.select("source_file", *[F.col(f"r.{f}").alias(f) for f in fields], failed.alias("parse_error"))


def _split_fields(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return parts + [schema[start:]]


# Asset class of a file ending.
FILE_CLASSES: dict[str, tuple[str, ...]] = {
    "raster_image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"), "vector_art": ("svg", "ai", "eps"),
    "structured_or_text": ("json", "csv", "xml", "txt", "md", "yaml", "yml"), "3d_or_cad": ("fbx", "obj", "dae", "gltf", "glb", "blend", "ldr", "dat"),
    "video": ("mp4", "mov", "avi", "webm", "mkv"),
}


def file_class(extension: Column, classes: Mapping[str, Sequence[str]] = FILE_CLASSES) -> Column:
    ladder = None
    for label, endings in classes.items():
        hit = extension.isin(*endings)
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    return ladder.otherwise("other")


def scan_file_tree(spark: SparkSession, root: str, classes: Mapping[str, Sequence[str]] = FILE_CLASSES, hash_under: int = 50_000_000) -> DataFrame:
    """One row per file: path, bytes, ending, class, top folder and SHA-256 when small enough.

    Contents are read only for files under the limit; large files are listed from metadata.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    meta = listing.select("path", F.col("length").alias("bytes"))
    hashed = listing.where(F.col("length") <= hash_under).select("path", F.sha2("content", 256).alias("sha256"))
    base = root.rstrip("/")
    tail = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return meta.join(hashed, "path", "left").select(
        tail.alias("relative_path"), "bytes", ext.alias("extension"), file_class(ext, classes).alias("asset_class"),
        F.when(F.contains(tail, F.lit("/")), F.get(F.split(tail, "/"), F.lit(0))).otherwise("").alias("top_folder"), "sha256")


def score_tree(tree: DataFrame, strong: Sequence[str], weak: Sequence[str], min_score: int = 1) -> DataFrame:
    """Path-token score ``min(100, 25 * strong + 8 * weak + 15 for textures and models)`` with a stable id."""
    from curatrix.functions.ids import stable_id

    words = F.array_distinct(F.regexp_extract_all(F.lower("relative_path"), F.lit("([a-z0-9]+)"), F.lit(1)))
    hits = lambda terms: F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms])))
    asset = F.col("asset_class").isin("raster_image", "3d_or_cad")
    score = F.least(F.lit(100), hits(strong) * 25 + hits(weak) * 8 + F.when(asset, 15).otherwise(0))
    return tree.withColumn("score", score).where(F.col("score") >= min_score).withColumn("asset_id", stable_id("asset", "relative_path"))


def form_groups(tree: DataFrame) -> DataFrame:
    """Files that share a stem as one asset with a map ending to path and digest (few endings per stem)."""
    stem = F.regexp_replace("relative_path", r"\.[^./]+$", "")
    return tree.groupBy(stem.alias("relative_stem")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", F.struct("relative_path", "sha256").alias("file"))))).alias("files"))


def scan_zip_entries(spark: SparkSession, paths: str | list[str], hash_under: int = 50_000_000) -> DataFrame:
    """One row per archive entry: path, class, sizes, checksum and SHA-256 unless too large.

    Archives are independent tasks; entries stream one at a time.
    """
    schema = "bundle string, entry string, bytes long, compressed long, crc32 string, sha256 string"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        digest = None
                        if info.file_size <= hash_under:
                            h = hashlib.sha256()
                            with z.open(info) as f:
                                for piece in iter(lambda: f.read(1 << 20), b""):
                                    h.update(piece)
                            digest = h.hexdigest()
                        rows.append((path, info.filename, info.file_size, info.compress_size, f"{info.CRC:08x}", digest))
                names = ("bundle", "entry", "bytes", "compressed", "crc32", "sha256")
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    ext = F.lower(F.regexp_extract("entry", r"\.([^./]+)$", 1))
    out = raw.mapInArrow(entries, schema)
    return out.withColumn("extension", ext).withColumn("asset_class", file_class(ext)).withColumn(
        "hash_status", F.when(F.col("sha256").isNotNull(), "complete").otherwise("skipped_large_entry"))


def scan_headered_text(spark: SparkSession, root: str) -> DataFrame:
    """Whole-file text with its leading header lines as columns."""
    text = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    line = lambda p: F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^0\s+{p}\s*(.*)$", 1)), F.lit(""))
    words = F.flatten(F.transform(F.regexp_extract_all("value", F.lit(r"(?im)^0\s+!KEYWORDS\s+(.*)$"), F.lit(1)), lambda k: F.split(k, r"\s*,\s*")))
    return text.select(
        "source_path", F.trim(F.regexp_extract("value", r"^﻿?0\s+(.*?)\r?(?:\n|$)", 1)).alias("description"), line("Name:").alias("name"),
        line("Author:").alias("author"), line("!LDRAW_ORG").alias("org"), line("!LICENSE").alias("license"),
        F.array_sort(F.array_distinct(F.filter(F.transform(words, F.trim), lambda w: w != ""))).alias("keywords"), F.sha2("value", 256).alias("sha256"))


def select_catalog(texts: DataFrame, catalog: str) -> DataFrame:
    """Three catalogue selections: ``patterned``, ``minifig`` or ``all``."""
    d = F.lower(F.coalesce("description", F.lit("")))
    minifig = F.contains(d, F.lit("minifig"))
    pattern = F.contains(d, F.lit("pattern"))
    condition = {"patterned": minifig & pattern, "minifig": minifig, "all": F.lit(True)}[catalog]
    return texts.where(condition)


def svg_element_profile(spark: SparkSession, root: str) -> DataFrame:
    """Counts of element tags, fills and strokes per SVG, a side hint and file name words."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.svg").text(root, wholetext=True)
    # File names in the metadata are percent-encoded.
    name = F.try_url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    text = text.select("value", F.col("_metadata.file_path").alias("source_path"), F.lower(F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)).alias("stem"))
    body = F.regexp_replace("value", r"(?s)<!--.*?-->", "")

    def counts(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.lower(x))
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(found)), lambda v: F.struct(v, F.size(F.filter(found, lambda f: f == v)))))

    side = F.when(F.col("stem").rlike(r"\b(?:back|rear|reverse)\b"), "reverse").when(F.col("stem").rlike(r"\bfront\b"), "front").otherwise("unknown")
    words = F.array_distinct(F.regexp_extract_all("stem", F.lit("([a-z0-9]+)"), F.lit(1)))
    return text.select(
        "source_path", counts(r"<([A-Za-z][\w:-]*)").alias("elements"), counts(r"fill\s*[=:]\s*[\"']?\s*([^\"';}>\s]+)").alias("fills"),
        counts(r"stroke\s*[=:]\s*[\"']?\s*([^\"';}>\s]+)").alias("strokes"), side.alias("side_hint"), words.alias("filename_words"))


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        marker = content[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7:at + 9], "big"), int.from_bytes(content[at + 5:at + 7], "big")
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        at += 2 + int.from_bytes(content[at + 2:at + 4], "big")
    return None


@F.udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]), useArrow=True)
def jpeg_size(content):
    """Size from the frame header of a JPEG: a marker walk that column functions cannot express."""
    found = _jpeg_size(bytes(content)) if content is not None else None
    return {"w": found[0], "h": found[1]} if found else None


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Format by magic bytes, width and height from the header, size and digest; unsupported rows get an error."""
    c = F.col(content)
    hexed = lambda at, n: F.hex(F.substring(c, at, n))
    number = lambda h: F.conv(h, 16, 10).cast("int")
    swap = lambda at: F.concat(hexed(at + 1, 1), hexed(at, 1))
    head = hexed(1, 12)
    fmt = (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(head.rlike("^47494638(37|39)61"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp"))
    kind = hexed(13, 4)
    le24 = lambda at: number(F.concat(hexed(at + 2, 1), hexed(at + 1, 1), hexed(at, 1))) + 1
    raw = F.conv(F.concat(hexed(25, 1), hexed(24, 1), hexed(23, 1), hexed(22, 1)), 16, 10).cast("long")
    jpeg = jpeg_size(F.when(fmt == "jpeg", c))
    size = (
        F.when(fmt == "png", F.struct(number(hexed(17, 4)).alias("w"), number(hexed(21, 4)).alias("h")))
        .when(fmt == "gif", F.struct(number(swap(7)).alias("w"), number(swap(9)).alias("h")))
        .when((fmt == "webp") & (kind == "56503858"), F.struct(le24(25).alias("w"), le24(28).alias("h")))
        .when((fmt == "webp") & (kind == "5650384C"), F.struct(
            (raw.bitwiseAND(F.lit(16383)) + 1).cast("int").alias("w"), (F.shiftrightunsigned(raw, 14).bitwiseAND(F.lit(16383)) + 1).cast("int").alias("h")))
        .when((fmt == "webp") & (kind == "56503820"), F.struct(
            (number(swap(27)).bitwiseAND(F.lit(16383))).alias("w"), (number(swap(29)).bitwiseAND(F.lit(16383))).alias("h")))
        .when(fmt == "jpeg", jpeg))
    out = files.withColumn("_size", size)
    return out.select(
        *[x for x in files.columns if x != content], fmt.alias("image_format"), F.col("_size.w").alias("width"), F.col("_size.h").alias("height"),
        F.octet_length(content).alias("size_bytes"), F.sha2(content, 256).alias("sha256"),
        F.when(fmt.isNull(), "unsupported_image_format").when(F.col("_size.w").isNull(), "unreadable_image_size").alias("error"))


def scan_image_headers(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return image_headers(raw.select("path", "content"))


def map_columns_by_tab(rows: DataFrame, mapping: DataFrame, tab: str, cells: str, key: Sequence[str]) -> DataFrame:
    """Sheet cells to named fields: ``mapping(tab, field, letter)``; header rows are dropped.

    ``cells`` is ``map<string,string>`` by column letter. A row that repeats its tab's labels is a header.
    """
    from curatrix.operators.scale import small_side

    spec = mapping.groupBy(F.col("tab").alias(tab)).agg(F.map_from_entries(F.collect_list(F.struct("field", "letter"))).alias("_spec"))
    j = rows.join(small_side(spec), tab)
    values = F.map_filter(F.transform_values("_spec", lambda k, letter: F.nullif(F.trim(F.try_element_at(F.col(cells), letter)), F.lit(""))), lambda k, v: v.isNotNull())
    out = j.withColumn("fields", values)
    header = F.exists(F.map_entries("fields"), lambda e: F.lower(e["key"]) == F.lower(F.replace(e["value"], F.lit(" "), F.lit("_"))))
    return out.where((F.size("fields") > 0) & ~header).select(*key, "fields")


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Field overlays with a reason on ``rows(key, fields map<string,string>)``; the source rows stay as they are.

    ``corrections(key, expected_name, corrected map<string,string>, cleared array<string>, confidence, rationale)``: the correction of a row holds unless it expects another name than the field ``name`` has, both
    compared in normal form; blank names expect nothing. Cleared fields become null, also where they are corrected. ``correction`` keeps the original values of all touched fields, the overlay, confidence and rationale, and is
    null where nothing was applied. A key with two corrections raises.
    """
    from curatrix.functions.text import norm_text
    from curatrix.operators.scale import null_safe_join

    parts = ("expected_name", "corrected", "cleared", "confidence", "rationale")
    twice = F.raise_error(F.lit("two corrections of one row")).cast("boolean")
    packed = corrections.groupBy(*key).agg(F.first(F.struct(*parts)).alias("_fix"), F.count(F.lit(1)).alias("_n"))
    j = null_safe_join(rows, packed.select(*key, F.when(F.col("_n") == 1, F.col("_fix")).otherwise(F.when(twice, F.col("_fix"))).alias("_fix")), list(key), "left").withColumnRenamed("fields", "_before")
    expected, observed = (norm_text(F.coalesce(c, F.lit(""))) for c in (F.col("_fix.expected_name"), F.try_element_at("_before", F.lit(name))))
    empty = F.create_map().cast("map<string,string>")
    new, gone = F.coalesce("_fix.corrected", empty), F.coalesce("_fix.cleared", F.array().cast("array<string>"))
    touched = F.array_sort(F.array_union(F.map_keys(new), gone))
    kept = F.map_filter("_before", lambda k, v: ~F.array_contains(touched, k))
    overlay = F.map_concat(kept, F.map_filter(new, lambda k, v: ~F.array_contains(gone, k)), F.map_from_arrays(gone, F.transform(gone, lambda g: F.lit(None).cast("string"))))
    holds = F.col("_fix").isNotNull() & ((expected == "") | (observed == "") | (expected == observed))
    original = F.map_from_arrays(touched, F.transform(touched, lambda f: F.try_element_at(F.col("_before"), f)))
    log = F.struct(original.alias("original"), new.alias("corrected"), gone.alias("cleared"), F.col("_fix.confidence").alias("confidence"), F.col("_fix.rationale").alias("rationale"))
    return j.withColumns({"_holds": holds}).select(*[c for c in rows.columns if c != "fields"], F.when(F.col("_holds"), overlay).otherwise(F.col("_before")).alias("fields"), F.when(F.col("_holds"), log).alias("correction"))


def flatten_scalars(df: DataFrame, ident: str, payload: str, depth: int = 3) -> DataFrame:
    """All scalar leaves of a JSON column as ``(ident, path, value)`` down to ``depth`` levels; deeper nesting raises."""
    level = df.select(F.col(ident), F.lit("").alias("path"), F.parse_json(payload).alias("v"))
    leaves = None
    for d in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        leaf = level.where(~nested).select(ident, "path", F.try_variant_get("v", "$", "string").alias("value"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        open_ = level.where(nested)
        if d == depth:
            stop = F.raise_error(F.concat(F.lit("payload nests deeper at "), "path"))
            return leaves.unionByName(open_.select(ident, "path", stop.cast("string").alias("value")))
        open_.createOrReplaceTempView("_curatrix_open")
        level = df.sparkSession.sql(
            f"select `{ident}`, case when e.key is null then concat(path, '[', e.pos, ']') when path = '' then e.key "
            f"else concat(path, '.', e.key) end as path, e.value as v from _curatrix_open, lateral variant_explode(v) e")
    return leaves
