"""Text normalisation and parsing as Column expressions.

Everything stays inside whole-stage codegen except the Unicode fold, which runs as an
Arrow-batched UDF and only sees values that hold a non-ASCII character.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

_COMBINING: dict[int, None] = {}
_ROWS = 64


def _fold_value(value: str | None) -> str | None:
    if value is None:
        return None
    if not _COMBINING:
        _COMBINING.update({c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))})
    return unicodedata.normalize("NFKD", value).translate(_COMBINING).casefold()


@F.arrow_udf(T.StringType())
def _fold_unicode(values: pa.Array) -> pa.Array:
    """A few rows at a time become Python strings; the rest of a batch stays in its buffers."""
    parts = [pa.array([_fold_value(v) for v in values.slice(at, _ROWS).to_pylist()], pa.string()) for at in range(0, len(values), _ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Empty or blank text counts as missing."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def squash(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks, casefolded."""
    c = col(c)
    return F.coalesce(_fold_unicode(F.when(c.rlike(r"[^\x00-\x7F]"), c)), F.lower(c))


def norm_ascii(c: Column | str) -> Column:
    """``norm_text`` for values known to be ASCII: no Python worker involved."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "&", " and ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def norm_text(c: Column | str) -> Column:
    """Accent-free lower-case words joined by single blanks; ``&`` reads ``and``."""
    return norm_ascii(fold(F.coalesce(col(c), F.lit(""))))


def norm_code(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]+", "")


def slug(c: Column | str, max_length: int = 120) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, max_length), "^-+|-+$", "")


def tokens(c: Column | str, stop: Iterable[str] = (), min_length: int = 2) -> Column:
    """Distinct alphanumeric words in first-seen order, stop words and short words removed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(F.array_distinct(words), lambda w: F.length(w) >= min_length)
    stop = sorted(set(stop))
    return F.array_except(kept, F.array(*[F.lit(w) for w in stop])) if stop else kept


def split_camel(c: Column | str) -> Column:
    s = F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")


# Word rewrites applied in this order (phrase, replacement).
SEMANTIC_REWRITES: tuple[tuple[str, str], ...] = (
    ("phase (?:i|1)", "phase1"),
    ("phase (?:ii|2)", "phase2"),
    ("first order", "firstorder"),
    ("cmd", "commander"),
    ("cpt", "captain"),
    ("sgt", "sergeant"),
    ("lt", "lieutenant"),
    ("fso", "firstorder"),
    ("geonosian", "geonosis"),
)


def semantic_tokens(
    c: Column | str, stop: Iterable[str] = (), rewrites: Iterable[tuple[str, str]] = SEMANTIC_REWRITES
) -> Column:
    """Ordered words of a (camel-case) label after phrase and word rewrites."""
    s = F.regexp_replace(split_camel(F.coalesce(col(c), F.lit(""))), "['’]", "")
    s = F.trim(F.regexp_replace(fold(s), r"[^\p{L}\p{N}]+", " "))
    stop = sorted(set(stop))
    words = F.filter(F.split(s, " "), lambda w: w != "")
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    s = F.array_join(words, " ")
    for phrase, replacement in rewrites:
        s = F.regexp_replace(s, rf"(?<![^ ])(?:{phrase})(?![^ ])", replacement)
    return F.filter(F.split(s, " "), lambda w: w != "")


# Numerals treated as spellings of one another.
NUMERALS: tuple[tuple[str, str], ...] = (("ii", "2"), ("iii", "3"), ("iv", "4"))


def alias_keys(normalized: Column | str, numerals: Iterable[tuple[str, str]] = NUMERALS) -> Column:
    """Normalised name plus its roman and arabic spellings; whole words after the first only."""
    name = col(normalized)
    arabic = roman = name
    for r, a in numerals:
        arabic = F.regexp_replace(arabic, rf"(?<= ){r}(?![^ ])", a)
        roman = F.regexp_replace(roman, rf"(?<= ){a}(?![^ ])", r)
    keys = F.array_distinct(F.array(name, arabic, roman))
    return F.array_sort(F.filter(keys, lambda k: k != ""))


def code_prefix(c: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.trim(col(c)), "^([A-Za-z]+)", 1)), F.lit(""))


def is_maker_code(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike("^[A-Za-z]{1,10}[-_]?[0-9]+[A-Za-z0-9_-]*$"), F.lit(False))


def external_id(direct: Column | str, url: Column | str, parameter: str = "M") -> Column:
    """The direct identifier, else the query parameter of the link, lower-cased."""
    found = F.regexp_extract(col(url), rf"(?i)[?&]{parameter}=([^&#]+)", 1)
    return F.lower(F.coalesce(blank_to_null(direct), blank_to_null(found)))


def years_in(c: Column | str, low: int = 1970, high: int = 2035) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    years = F.transform(found, lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(low, high))))


def year_like(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike("^(?:18|19|20)[0-9]{2}$"), F.lit(False))


def numeric_like(c: Column | str) -> Column:
    """A bare number of two to six digits."""
    return F.coalesce(F.trim(col(c).cast("string")).rlike("^[0-9]{2,6}$"), F.lit(False))


def release_years(c: Column | str) -> Column:
    pattern = r"(?i)Years\s+Released\s*:\s*([0-9]{4})(?:\s*-\s*([0-9]{4}))?"
    first = F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(col(c), pattern, 2), F.lit("")).cast("int")
    return F.struct(first.alias("start"), F.coalesce(last, first).alias("end"))


def parse_identity_key(c: Column | str, overrides: Mapping[str, Mapping] | None = None) -> Column:
    """Underscore key to base, label and suffix words; audited full-key overrides win."""
    c = F.coalesce(col(c), F.lit(""))
    parts = F.split(c, "_")
    suffix_type = "array<string>"
    base, label, mode = F.get(parts, F.lit(0)), F.lit(None).cast("string"), F.lit("underscore_variant_default")
    suffix = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    for key, item in sorted((overrides or {}).items(), reverse=True):
        hit = c == key
        base = F.when(hit, F.lit(item["base"])).otherwise(base)
        label = F.when(hit, F.lit(item.get("label"))).otherwise(label)
        suffix = F.when(hit, F.array(*[F.lit(s) for s in item.get("suffix", ())]).cast(suffix_type)).otherwise(suffix)
        mode = F.when(hit, F.lit("audited_full_identity_override")).otherwise(mode)
    return F.struct(base.alias("base"), label.alias("label"), suffix.alias("suffix"), mode.alias("mode"))


# Words that describe a surface, not a subject.
SURFACE_WORDS = "face|head|torso|hips?|legs?|arms?|helmet|hair|cowl|front|back"


def subject_from_path(c: Column | str) -> Column:
    """Identity label of an asset path: leaf alone, or folder plus leaf qualifier."""

    def clean(label: Column) -> Column:
        label = F.regexp_replace(label, rf"(?i)\b(?:{SURFACE_WORDS})\b", " ")
        label = F.regexp_replace(label, r"(?i)\([^)]*(?:front|back)[^)]*\)", " ")
        return F.regexp_replace(squash(label), r"^[ _-]+|[ _-]+$", "")

    parts = F.filter(F.split(col(c), "/"), lambda p: p != "")
    leaf = clean(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    parent = F.trim(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    base = clean(parent)
    rest = F.regexp_replace(F.substring(leaf, F.length(base) + 1, F.lit(1 << 30)), r"^[ ()_-]+|[ ()_-]+$", "")
    qualified = (base != "") & F.startswith(F.lower(leaf), F.lower(base)) & (rest != "")
    alone = (F.size(parts) < 3) | parent.rlike(r"(?i)^series\s*[0-9]+[a-z]?$")
    return (
        F.when(alone, leaf)
        .when(qualified, F.concat_ws(" ", base, rest))
        .otherwise(F.coalesce(F.nullif(base, F.lit("")), leaf))
    )


def catalog_href(href: Column | str, text: Column | str, root: str = "figures") -> Column:
    """Path segments of a catalogue link: id, brand, serial, name; missing ones stay null."""
    path = F.regexp_extract(col(href), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ident = F.get(parts, F.lit(1))
    ok = (F.get(parts, F.lit(0)) == root) & ident.rlike("^[0-9]+$")
    return F.when(
        ok,
        F.struct(
            ident.cast("long").alias("catalog_id"),
            F.try_url_decode(F.get(parts, F.lit(2))).alias("brand_slug"),
            F.try_url_decode(F.get(parts, F.lit(3))).alias("serial_slug"),
            F.try_url_decode(F.get(parts, F.lit(4))).alias("name_slug"),
            blank_to_null(text).alias("anchor_text"),
        ),
    )


def clean_title(title: Column | str, item_id: Column | str, kind: str = "Minifigure", site: str = "BrickLink") -> Column:
    """Page title without the trailing item number and site name."""
    s = squash(title)
    low, ident = F.lower(s), F.lower(col(item_id))
    site_tail = F.regexp_replace(s, rf"(?i)\s*\|\s*{site}\s*$", "")
    marker = F.concat(F.lit(f"{kind.lower()} "), ident)
    ends = F.endswith(F.lower(F.rtrim(site_tail)), marker) & low.isNotNull()
    cut = F.substring(site_tail, F.lit(1), F.length(F.rtrim(site_tail)) - F.length(marker))
    without = F.when(ends & cut.rlike(r":\s*$"), F.regexp_replace(cut, r"\s*:\s*$", "")).otherwise(site_tail)
    return F.nullif(F.regexp_replace(without, r"^[ :-]+|[ :-]+$", ""), F.lit(""))
