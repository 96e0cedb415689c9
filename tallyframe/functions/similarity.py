"""Similarities of token sets, texts and vectors."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column, least_common: int = 1) -> Column:
    """Intersection over union of two token sets; 0 where fewer than least_common meet."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common >= max(least_common, 1), common / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the larger set."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def recall(a: Column, b: Column) -> Column:
    """Intersection over the first set."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; null where one is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity; not symmetric, so argument order matters. Null is empty. A task takes the ratio of two texts
    that it meets again from those that it has, of which it keeps up to 50,000."""
    known = {}
    for a, b in batches:
        found = []
        for pair in zip(a, b, strict=True):
            score = known.get(pair)
            if score is None:
                if len(known) >= 50_000:
                    known.clear()
                score = known[pair] = difflib.SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
            found.append(score)
        yield pd.Series(found, dtype="float64")


def blend(first: Column, second: Column, share: float = 0.6) -> Column:
    """A share of one similarity and the rest of another: of word Jaccard and sequence ratio, of overlap and sequence ratio, or
    of sequence ratio and word Jaccard."""
    return share * first + (1 - share) * second


def brand_class(a: Column, b: Column, least: int = 4) -> Column:
    """match, reject, one_unknown or both_unknown; a brand of `least` letters may stand inside the other."""
    inside = ((F.length(a) >= least) & F.contains(b, a)) | ((F.length(b) >= least) & F.contains(a, b))
    return (
        F.when(a.isNull() & b.isNull(), "both_unknown").when(a.isNull() | b.isNull(), "one_unknown").when((a == b) | inside, "match").otherwise("reject")
    )
