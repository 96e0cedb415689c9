"""What five document filters remove, alone and after one another, in every order.

1. Texts are sorted by ranges of (fingerprint, doc_id), and inside each range by
   fingerprint, full text and doc_id. A text equal to its predecessor is a copy
   of it; each task measures the other filters on the way and writes one small
   row per document, without its text, with the mask of the filters it fails.
2. Copies of one text may span several ranges. Every task also writes the texts
   (by SHA-256) with which its last fingerprint ends; rows of the first
   fingerprint of a later range that look like first ones are checked against
   those. Nothing is gathered by text, so a text may have any number of copies.
3. Masks are merged with labels and counted by part and mask: at most 32
   counters a part, which add up. All orders, steps and Shapley values follow
   from the counters alone.

Defined results: a null text is empty; an empty text has no words and fails A
(and E where there is an empty text of smaller doc_id). A copy needs a strictly
smaller doc_id: rows that repeat one doc_id are no copies of each other, though
each counts as a document. Rows with a null doc_id are neither copies nor
originals, and have no labels. A document's labels are the largest of its label
rows; without label it is neither good nor toxic. Null and empty part values
are one part. Very long texts are held one at a time. Extra columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.arrow import modest_batches, small_batches, text_bytes
from tallyframe.session import materialize

#: Bit of each filter in a mask.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
CAPITALS = bytes(range(65, 91))
#: UTF-8 bytes that continue a code point.
CONTINUED = bytes(range(128, 192))


@dataclass(frozen=True)
class AuditRules:
    """Limits of the filters. least_words: A. distinct_percent: B. capital_percent: C. symbols: D."""

    least_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: bytes = b"#$%&*|"


def text_mask(data: bytes, rules: AuditRules) -> int:
    """The filters A to D that a text fails."""
    words = data.split()
    points = len(data) if data.isascii() else len(data.translate(None, CONTINUED))
    mask = BITS["A"] * (len(words) < rules.least_words)
    mask |= BITS["B"] * (100 * len(set(words)) < rules.distinct_percent * len(words))
    mask |= BITS["C"] * (100 * (len(data) - len(data.translate(None, CAPITALS))) > rules.capital_percent * points)
    return mask | BITS["D"] * bool(re.search(b"[" + re.escape(rules.symbols) + b"]", data))


class Runs:
    """Texts of one task in the order of fingerprint, text and key: which are copies, and what lies at the edges."""

    def __init__(self):
        self.fp = self.text = self.first = None
        self.in_first, self.ended = True, []

    def add(self, fp: int, data: bytes, key: int) -> tuple[bool, bytes | None]:
        """Whether the text is a copy of an earlier one here; its digest, if an earlier task may hold its original."""
        if fp != self.fp:
            self.in_first = self.fp is None
            self.fp, self.ended, self.text = fp, [], None
        if data != self.text:
            if self.text is not None:
                self._end()
            self.text, self.first = data, key
        copy = key > self.first
        return copy, hashlib.sha256(data).digest() if self.in_first and not copy else None

    def _end(self) -> None:
        self.ended.append((self.fp, hashlib.sha256(self.text).digest(), self.first))

    def close(self) -> list[tuple[int, bytes, int]]:
        """(fingerprint, digest, smallest key) of the texts with the last fingerprint."""
        if self.text is not None:
            self._end()
        return self.ended


def failure_masks(docs: DataFrame, rules: AuditRules, key: str, text: str, part: str) -> DataFrame:
    """(id, part, mask), one row per document, written to the shared folder."""
    rows = modest_batches(docs).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))

    def run(batches):
        runs, number = Runs(), TaskContext.get().partitionId()
        for batch in small_batches(batches, "text"):
            masks, heads = [], []
            for data, fp, key in zip(text_bytes(batch.column("text")), batch.column("fp").to_pylist(), batch.column("id").to_pylist(), strict=True):
                copy, head = runs.add(fp, data, key) if key is not None else (False, None)
                masks.append(text_mask(data, rules) | BITS["E"] * copy)
                heads.append(head)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), batch.column("fp"), pa.array(heads, pa.binary()), pa.array([number] * n, pa.int32()), pa.array([False] * n)], ["id", "part", "mask", "fp", "head", "task", "ends"])
        ends = runs.close()
        if ends:
            fps, heads, firsts = zip(*ends, strict=True)
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array([None] * n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(fps, pa.int64()), pa.array(heads, pa.binary()), pa.array([number] * n, pa.int32()), pa.array([True] * n)], ["id", "part", "mask", "fp", "head", "task", "ends"])

    dealt = rows.repartitionByRange("fp", "id").sortWithinPartitions("fp", "text", "id")
    found = materialize(dealt.mapInArrow(run, "id long, part string, mask int, fp long, head binary, task int, ends boolean"), "audit-masks")
    # one row per task and text at its end: as many as there are tasks, but for equal fingerprints of different texts
    ends = found.filter("ends").groupBy("fp", "head").agg(F.min("id").alias("original"))
    heads = found.filter("not ends and head is not null").join(ends, ["fp", "head"], "left")
    copy = F.coalesce(F.col("original") < F.col("id"), F.lit(False))
    heads = heads.select("id", "part", F.when(copy, F.col("mask").bitwiseOR(BITS["E"])).otherwise(F.col("mask")).alias("mask"))
    return found.filter("not ends and head is null").select("id", "part", "mask").unionByName(heads)


def mask_counters(masks: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail just these filters."""
    known = labels.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) of all orders."""
    found = []
    for order in permutations(BITS):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append(("".join(order), step, BITS[letter], before))
            before |= BITS[letter]
    return found


def order_report(counters: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters; the list of steps is fixed, and parts have 32 counters at most."""
    steps = F.from_json(F.lit("[" + ",".join('{"o":"%s","s":%d,"b":%d,"p":%d}' % s for s in order_steps()) + "]"), "array<struct<o:string,s:int,b:int,p:int>>")
    each = counters.withColumn("step", F.explode(steps)).select("*", "step.*").drop("step")
    own, earlier = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    # of all orders, the filter removes a document in one of as many as the document fails filters
    shared = F.col("n") * (F.lit(len(list(permutations(BITS)))) / F.nullif(F.bit_count("mask"), F.lit(0))).cast("long")
    return each.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total(~own & ~earlier).alias("kept"),
        total(own & ~earlier).alias("removed"),
        total(own & earlier).alias("redundant"),
        total(F.col("mask") == F.col("b")).alias("unique_fails"),
        total(own & ~earlier, "good").alias("good_lost"),
        total(own & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(own, shared).otherwise(0)).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, rules: AuditRules | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = failure_masks(docs, rules or AuditRules(), key, text, part)
    return order_report(materialize(mask_counters(masks, labels, key), "audit-counters"))


AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part,
   CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(CASE WHEN good THEN 1 END) AS g, count(CASE WHEN toxic THEN 1 END) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM o JOIN f ON NOT contains(filter_order, letter)),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substring(filter_order, i, 1) AS own, substring(filter_order, 1, i - 1) AS before FROM o, unnest(range(1, 6)) AS t(i) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, step, own, n, g, x, fails, contains(fails, own) AS failed, before <> '' AND regexp_matches(fails, CASE WHEN before = '' THEN 'x' ELSE '[' || before || ']' END) AS gone FROM c, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
   sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
   sum(CASE WHEN failed AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone THEN x ELSE 0 END) AS toxic_lost FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
   CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
