"""Stable identifiers, canonical digests and hash splits."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, functions as F

from curatrix.functions.text import col

_KEEP_NULLS = {"ignoreNullFields": "false"}


def stable_id(kind: str, *parts: Column | str) -> Column:
    """``kind-`` and 24 hex digits of the SHA-256 over the compact JSON list ``[kind, *parts]``."""
    payload = F.to_json(F.array(F.lit(kind), *[col(p).cast("string") for p in parts]), _KEEP_NULLS)
    return F.concat(F.lit(f"{kind}-"), F.left(F.sha2(payload, 256), F.lit(24)))


def canonical_json(fields: dict[str, Column | str]) -> Column:
    """Compact JSON of the fields in key order, nulls included."""
    return F.to_json(F.struct(*[col(fields[k]).alias(k) for k in sorted(fields)]), _KEEP_NULLS)


def canonical_digest(fields: dict[str, Column | str]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def row_digest(columns: Iterable[str]) -> Column:
    return canonical_digest({c: c for c in columns})


def hex_to_number(digits: Column | str) -> Column:
    """Unsigned value of up to 16 hex digits, as ``decimal(20,0)``."""
    return F.conv(col(digits), 16, 10).cast("decimal(20,0)")


def hash_fraction_split(key: Column | str, train: float = 0.8, validation: float = 0.1) -> Column:
    """Split by the first 16 hex digits of SHA-256 as a fraction of 16^16."""
    if not (0 < train < 1 and 0 <= validation < 1 and train + validation < 1):
        raise ValueError("split fractions must be positive and leave room for a test part")
    value = hex_to_number(F.left(F.sha2(col(key).cast("string"), 256), F.lit(16)))

    def limit(share: float) -> Column:
        exact = Fraction(share) * 16**16
        return F.lit(str(-(-exact.numerator // exact.denominator))).cast("decimal(20,0)")

    return (
        F.when(value < limit(train), "train").when(value < limit(train + validation), "validation").otherwise("test")
    )


def hash_mod_split(key: Column | str, train: int = 80, validation: int = 10) -> Column:
    """Split by the first 8 hex digits of SHA-256 modulo 100."""
    bucket = hex_to_number(F.left(F.sha2(col(key).cast("string"), 256), F.lit(8))) % 100
    return (
        F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")
    )


def set_digest(line: Column | str) -> Column:
    """Order-free aggregate digest of many lines with constant state per group.

    Sums and counts two 60-bit slices of each line's SHA-256; equal multisets give equal digests, and
    every partition is folded before the shuffle, so one huge group costs one row per task.
    """
    digest = F.sha2(col(line), 256)
    low = F.sum(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("decimal(20,0)"))
    high = F.sum(F.conv(F.substring(digest, 16, 15), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws("|", F.count(col(line)).cast("string"), low.cast("string"), high.cast("string")), 256)
