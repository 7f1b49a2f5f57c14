"""Parser for free-text source references (issues, episodes, dated works)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions.text import norm_text, squash

# Shapes of an issue number, a volume and a year.
ISSUE = r"-?\d+(?:\.\d+)?(?:\.[A-Za-z]+)?(?:[A-Za-z])?(?:\s*[–—-]\s*-?\d+(?:\.\d+)?)?"
VOLUME = r"(?:Vol(?:\.|ume)?|v)\s*(\d+)"
YEAR = r"(?:19|20)\d{2}"
TAIL = rf"({ISSUE})(?:\s*:\s*(.+))?$"
# (pattern, group numbers of title, volume, annual, issue, subtitle)
ISSUE_SHAPES = (
    (rf"(?i)^(.+?)\s*\({VOLUME}\)\s*(Annual\s+)?#\s*{TAIL}", (1, 2, 3, 4, 5)),
    (rf"(?i)^(.+?)\s+{VOLUME}\s*(Annual\s+)?#?\s*{TAIL}", (1, 2, 3, 4, 5)),
    (rf"(?i)^(.+?)\s*\((\d+)(?:st|nd|rd|th)\s+series\)\s*(Annual\s+)?#\s*{TAIL}", (1, 2, 3, 4, 5)),
    (rf"(?i)^(.+?)\s*(Annual\s+)?#\s*{TAIL}", (1, 0, 2, 3, 4)),
)
EPISODE = r"(?i)^(.+?)\s+(?:S(\d{1,2})E(\d{1,3})|Season\s+(\d+)\s+Episode\s+(\d+)|Episode\s+(\d+))$"
QUALIFIERS = ("digital", "web", "online", "one-shot", "one shot")
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
TRAILING = r"\(([^()]*)\)\s*$"


def _part(value: Column, pattern: str, group: int) -> Column:
    if not group:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def _peeled(core: Column) -> Column:
    """Reads trailing parentheses from right to left: ``struct(core, hint, notes)``."""
    start = F.struct(core.alias("core"), F.lit(None).cast("int").alias("hint"), F.array().cast("array<string>").alias("notes"))

    def step(acc: Column, _) -> Column:
        token = F.trim(F.regexp_extract(acc["core"], TRAILING, 1))
        present = acc["core"].rlike(TRAILING)
        plain = token.rlike(f"^{YEAR}$")
        dated = token.rlike(rf"\b{YEAR}\b") & F.lower(token).rlike(MONTHS)
        noted = F.lower(token).isin(*QUALIFIERS)
        year = F.regexp_extract(token, rf"\b({YEAR})\b", 1).cast("int")
        return F.struct(
            F.when(present & (plain | dated | noted), F.trim(F.regexp_replace(acc["core"], TRAILING, ""))).otherwise(acc["core"]).alias("core"),
            F.when(present & (plain | dated), year).otherwise(acc["hint"]).alias("hint"),
            F.when(present & ~plain & (dated | noted), F.array_append(acc["notes"], token)).otherwise(acc["notes"]).alias("notes"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(core) - F.length(F.replace(core, F.lit("("), F.lit("")))), start, step)


def _reading(raw: Column, unquoted: Column, state: Column) -> Column:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    core, hint, notes = F.regexp_replace(state["core"], r"[ .;,\]]+$", ""), state["hint"], state["notes"]

    def reading(kind, work=text, volume=number, issue=text, annual=None, subtitle=text, season=number, episode=number,
                qualifiers=notes, year=hint, tail=text):
        return F.struct(
            F.lit(kind).alias("kind"), work.alias("source_work"), volume.alias("volume"), issue.alias("issue"),
            (F.lit(None).cast("boolean") if annual is None else annual).alias("annual"), subtitle.alias("subtitle"),
            season.alias("season"), episode.alias("episode"), qualifiers.alias("qualifiers"),
            year.cast("int").alias("year_hint"), tail.alias("key_tail"),
        )

    titled = lambda value: F.regexp_replace(value, "^[ -]+|[ -]+$", "")
    none = F.array().cast("array<string>")
    ladder = F.when(raw == "", reading("empty", qualifiers=none))
    for pattern, (t, v, a, i, s) in ISSUE_SHAPES:
        volume = _part(core, pattern, v).cast("int")
        issue = F.regexp_replace(F.regexp_extract(core, pattern, i), r"\s+", "")
        annual = _part(core, pattern, a).isNotNull()
        tail = F.concat_ws(
            "|", F.concat(F.lit("v"), F.coalesce(volume.cast("string"), F.lit("?"))), F.when(annual, "annual").otherwise("regular"),
            F.concat(F.lit("i"), F.regexp_replace(F.lower(issue), "[–—]", "-")))
        ladder = ladder.when(
            core.rlike(pattern),
            reading("comic_issue_explicit", titled(F.regexp_extract(core, pattern, t)), volume, issue, annual,
                    F.trim(_part(core, pattern, s)), tail=tail))
    season = F.coalesce(_part(core, EPISODE, 2), _part(core, EPISODE, 4)).cast("int")
    episode = F.coalesce(_part(core, EPISODE, 3), _part(core, EPISODE, 5), _part(core, EPISODE, 6)).cast("int")
    tail = F.concat_ws("|", F.concat(F.lit("s"), F.coalesce(season.cast("string"), F.lit("?"))), F.concat(F.lit("e"), episode.cast("string")))
    bare, dated_work = r"(?i)^Episode\s+(\d+)$", rf"^(.+?)\s*\(({YEAR})\)$"
    is_year = core.rlike(f"^{YEAR}$")
    quoted = raw.rlike("^\"(?s:.+)\"$|^'(?s:.+)'$")
    inner = F.trim(F.substring(raw, F.lit(2), F.length(raw) - 2))
    return (
        ladder.when(core.rlike(EPISODE), reading("episode_explicit", titled(F.regexp_extract(core, EPISODE, 1)), season=season, episode=episode, tail=tail))
        .when(core.rlike(bare), reading("episode_number_without_work", episode=_part(core, bare, 1).cast("int")))
        .when(unquoted.rlike(dated_work), reading(
            "dated_work", F.trim(F.regexp_extract(unquoted, dated_work, 1)), qualifiers=none, year=F.regexp_extract(unquoted, dated_work, 2)))
        .when(hint.isNotNull() & (core != "") & ~is_year, reading("dated_work", core))
        .when(is_year, reading("year_only", qualifiers=none, year=core))
        .when(quoted & (inner != ""), reading("quoted_title_candidate", inner, qualifiers=none))
        .otherwise(reading("raw_only"))
    )


def with_reference(df: DataFrame, column: str, name: str = "reference") -> DataFrame:
    """Adds ``struct(kind, source_work, volume, issue, annual, subtitle, season, episode, qualifiers, year_hint,
    canonical_key)`` read from a free-text column.

    All trailing parentheses (years, dates, qualifiers) are read: a value bounds their number itself. Every stage is bound to a
    variable, so the rules are evaluated once per row.
    """
    raw = squash(F.coalesce(F.col(column), F.lit("")))
    unquoted = F.regexp_replace(F.regexp_replace(raw, '^"+|"+$', ""), "^'+|'+$", "")
    core = F.trim(F.regexp_replace(F.trim(unquoted), r"(?:\[[^\]]+\])+\s*$", ""))
    bound = F.array(F.struct(raw.alias("raw"), unquoted.alias("unquoted"), _peeled(core).alias("state")))
    out = df.withColumn("_r", F.get(F.transform(bound, lambda b: _reading(b["raw"], b["unquoted"], b["state"])), F.lit(0)))
    work = F.when(F.col("_r.key_tail").isNotNull(), norm_text("_r.source_work"))
    key = F.concat_ws("|", F.when(F.col("_r.kind") == "episode_explicit", F.lit("episode")), work, "_r.key_tail")
    fields = ("kind", "source_work", "volume", "issue", "annual", "subtitle", "season", "episode", "qualifiers", "year_hint")
    return out.withColumn(name, F.struct(
        *[F.col(f"_r.{f}").alias(f) for f in fields], F.when(F.col("_r.key_tail").isNotNull(), key).alias("canonical_key"))).drop("_r")
