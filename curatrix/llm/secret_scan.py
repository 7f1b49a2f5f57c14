"""Secret scans over a ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, per blob, the rule versions that have read it and what they found.
A scan reads one copy of each blob for the rules that have not seen it, appends to the ledger, and joins the findings back to all paths. Blobs meet in a map-side
aggregate, and findings are repeated ``salts`` times for the join, so a blob under a third of all paths is spread over many tasks.

Spans are code points, end exclusive; per rule leftmost and disjoint. A rule's version is a digest of its pattern and limit, so a changed rule scans all blobs again and an unchanged one none.
Null content is empty and has no findings. Null or repeated paths are rows like others. Empty tables give empty results. Other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from curatrix.llm import files
from curatrix.llm.text import fresh


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters; ``needs`` is a string without which there is no match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


# The base patterns, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
)
RULES = BASE + MORE
SPAN = StructType([StructField("start", IntegerType(), False), StructField("rank", IntegerType(), False), StructField("kind", StringType(), False), StructField("end", IntegerType(), False)])


def _long_enough(rule: Rule) -> str:
    """A pattern that only texts with a finding match: for a bare run of one class the limit can stand in it."""
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.least > 1:
        lead = rule.pattern.partition("[")[0]
        return f"{rule.pattern[:-1]}{{{rule.least - len(lead)},}}"
    return rule.pattern


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule: the text between matches and the matches themselves give the positions."""
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    none = F.array().cast(ArrayType(SPAN))

    def step(got: Column, x: Column) -> Column:
        start = got["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(got["spans"], F.array(span))).otherwise(got["spans"]).alias("spans"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda got: got["spans"])
    may = text.rlike(_long_enough(rule))
    return F.when((text.contains(rule.needs) & may) if rule.needs else may, found).otherwise(none)


def scan(versions: DataFrame, *, text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, out: str = "secrets", keep: list[str] | None = None, salts: int = 16) -> DataFrame:
    """The columns ``keep`` and a struct ``out``: ``blob`` and ``found`` (spans of all rules in order). ``ledger`` is a folder that later scans take up again."""
    spark = versions.sparkSession
    keep = versions.columns if keep is None else keep
    fresh_ledger = ledger is None
    ledger = ledger or files.shared_folder(spark, "ledger")
    wanted = {rule.version: (rank, rule) for rank, rule in enumerate(rules)}
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = versions.select(content.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256))).groupBy("blob").agg(F.first("text").alias("text"))
    schema = StructType([StructField("blob", BinaryType()), StructField("rules", ArrayType(StringType())), StructField("found", ArrayType(SPAN))])

    def have() -> DataFrame:
        return spark.read.schema(schema).parquet(ledger)

    names = F.array(*[F.lit(v) for v in wanted])
    if fresh_ledger:
        todo = blobs.withColumn("rules", names)
    else:
        seen = have().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    none = F.array().cast(ArrayType(SPAN))
    found = [F.when(F.array_contains("rules", v), spans(F.col("text"), rule, rank)).otherwise(none) for v, (rank, rule) in wanted.items()]
    todo.select("blob", "rules", F.array_sort(F.concat(*found)).alias("found")).write.mode("append").parquet(ledger)

    # an older version of a rule may have left findings of its own
    live = {rule.kind: v for v, (_, rule) in wanted.items()}
    valid = F.create_map(*[F.lit(x) for pair in live.items() for x in pair])
    current = have().where(F.size("found") > 0).select("blob", F.filter("found", lambda x: F.array_contains(F.col("rules"), valid[x["kind"]])).alias("found"))
    by_blob = current.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    salt = fresh(versions, "_salt")
    by_blob = by_blob.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mark, hit = fresh(versions, "_blob"), fresh(versions, "_found")
    rows = versions.select(*keep, F.unhex(F.sha2(content, 256)).alias(mark)).withColumn(salt, F.floor(F.rand(7) * salts).cast("int"))
    joined = rows.join(by_blob.withColumnsRenamed({"blob": mark, "found": hit}), [mark, salt], "left")
    return joined.select(*keep, F.struct(F.col(mark).alias("blob"), F.coalesce(F.col(hit), none).alias("found")).alias(out))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts and spans per document."""
    found = F.col("secrets")["found"]
    base = F.filter(found, lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs.select("doc_id", "text"), keep=["doc_id"], **options).select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each finding, overlapping ones together, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(got: Column, x: Column) -> Column:
        apart = x["start"] >= got["at"]
        return F.struct(F.greatest(got["at"], x["end"]).alias("at"), F.when(apart, F.concat(got["out"], F.substring(text, got["at"] + 1, x["start"] - got["at"]), F.lit(mark))).otherwise(got["out"]).alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda got: F.concat(got["out"], F.substring(text, got["at"] + 1, F.length(text)))))
