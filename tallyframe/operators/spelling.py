"""Pairs of texts by sequence ratio, of which Python compares only those that exact bounds leave.

Texts of a ratio share a segment (from SEGMENTS_FROM on) or have lengths near
each other, and the letters that both hold must suffice. None of these tests
loses a pair; `spelt_candidates` gives what they leave, `spelt_pairs` compares it.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyframe.functions import similarity

#: Letters fall into BUCKETS by code point; a signature has a bit for each of the first LEVELS of a bucket.
BUCKETS, LEVELS = 48, 4
#: Ratio from which texts meet by segments of two letters and more.
SEGMENTS_FROM = 0.8


@F.pandas_udf(StructType([*(StructField(n, LongType()) for n in ("one", "two", "three")), StructField("more", IntegerType())]))
def letter_signature(texts: pd.Series) -> pd.DataFrame:
    """How often a text holds the letters of each bucket, a bit for each of the first LEVELS; more: how many there are beyond.
    Made once for each distinct text."""
    rows = []
    for t in texts:
        bits = more = 0
        for bucket, n in Counter(ord(c) % BUCKETS for c in t or "").items():
            bits |= ((1 << min(n, LEVELS)) - 1) << bucket * LEVELS
            more += max(n - LEVELS, 0)
        parts = [bits >> 64 * i & (1 << 64) - 1 for i in range(3)]
        rows.append((*(p - (1 << 64) if p >> 63 else p for p in parts), more))
    return pd.DataFrame(rows, columns=["one", "two", "three", "more"]).astype({"one": "int64", "two": "int64", "three": "int64", "more": "int32"})


def ratio_bound(a: Column, b: Column, sign_a: Column, sign_b: Column) -> Column:
    """An upper bound of the sequence ratio of two texts from their letter signatures: no more letters match than both hold."""
    shared = sum((F.bit_count(sign_a[p].bitwiseAND(sign_b[p])) for p in ("one", "two", "three")), F.least(sign_a["more"], sign_b["more"]))
    return F.when(F.length(a) + F.length(b) > 0, 2 * shared / (F.length(a) + F.length(b))).otherwise(F.lit(1.0))


def signed(df: DataFrame, column: str, within: list[str]) -> DataFrame:
    """The distinct texts of a column that are not empty, by the columns `within`, with `<column>_sign`."""
    return df.select(*within, column).filter(F.length(column) > 0).distinct().withColumn(f"{column}_sign", letter_signature(column))


def spelt_candidates(left: DataFrame, right: DataFrame, a: str, b: str, least: float, within: list[str] | None = None) -> DataFrame:
    """Distinct (within..., a, b), alike in the columns `within`, that may have a sequence ratio of `least`, none of which is lost, before any ratio is taken.

    Texts of that ratio differ in (1 - least) of all their letters at most, put in or left out. Of b's segments, one more than
    there can be such letters, one stands whole in a, shifted by no more than that. So from SEGMENTS_FROM on texts meet
    by segments, and below, where segments are single letters, by length; then lengths and letter signatures decide."""
    within = within or []
    mine, theirs = signed(left, a, within), signed(right, b, within)
    n, m = F.length(a), F.length(b)
    spans = F.sequence(F.floor(n * least / (2 - least)).cast("int"), F.ceil(n * (2 - least) / least).cast("int"))
    by_segment = least >= SEGMENTS_FROM
    if by_segment:
        # letters put in or left out between b and the longest text of that ratio, and letters of each segment at least
        apart = lambda length: F.floor((1 - least) * 2 * length / least + 1e-9)
        letters = lambda length: F.floor(length / (apart(length) + 1)).cast("int")
        at = lambda i: F.floor(i * m / (apart(m) + 1)).cast("int")
        segments = F.transform(F.sequence(F.lit(0).cast("long"), apart(m)), lambda i: F.struct(F.substring(b, at(i) + 1, letters(m)).alias("g"), at(i).alias("p"), apart(m).alias("d")))
        theirs = theirs.withColumn("_s", F.explode(segments)).withColumn("_g", F.col("_s.g"))
        mine = mine.withColumn("_k", F.explode(F.array_distinct(F.transform(spans, letters)))).filter((F.col("_k") > 0) & (F.col("_k") <= n))
        mine = mine.withColumn("_p", F.explode(F.sequence(F.lit(0), n - F.col("_k")))).withColumn("_g", F.substring(a, F.col("_p") + 1, F.col("_k")))
        pairs = mine.join(theirs, [*within, "_g"]).filter(F.abs(F.col("_p") - F.col("_s.p")) <= F.col("_s.d"))
    else:
        pairs = mine.withColumn("_n", F.explode(spans)).join(theirs.withColumn("_n", m), [*within, "_n"])
    close = 2 * F.least(n, m) >= least * (n + m) - 1e-9
    found = pairs.filter(close & (ratio_bound(F.col(a), F.col(b), F.col(f"{a}_sign"), F.col(f"{b}_sign")) >= least - 1e-9)).select(*within, a, b)
    return found.distinct() if by_segment else found


def spelt_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float, within: list[str] | None = None) -> DataFrame:
    """Distinct (within..., a, b, ratio), both texts not empty, whose sequence ratio is `least` or more."""
    found = spelt_candidates(left, right, a, b, least, within)
    return found.withColumn("ratio", similarity.sequence_ratio(F.col(a), F.col(b))).filter(F.col("ratio") >= least)
