"""Identifiers, content hashes, back-off times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(text: Column, length: int = 12) -> Column:
    return F.substring(F.md5(text), 1, length)


def content_hash(columns: list[str]) -> Column:
    """A digest of the named fields in sorted order, for change detection."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: str = "none", seed: int = 0) -> Column:
    """Exponential back-off; jitter: none, full (0 to 1 times) or equal (half to 1 times), from a seeded generator."""
    plain = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return {"none": plain, "full": plain * F.rand(seed), "equal": plain / 2 + plain / 2 * F.rand(seed)}[jitter]


def decorrelated_backoff(previous: Column, base: float = 1.0, most: float = 60.0, seed: int = 0) -> Column:
    """The next delay: between the base and three times the delay before, up to the most, from a seeded generator."""
    return F.least(F.lit(most), F.lit(base) + F.rand(seed) * (F.coalesce(previous, F.lit(base)) * 3 - F.lit(base)))
