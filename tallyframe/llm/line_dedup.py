"""Removal of lines that many documents share, with two Bloom filters.

1. Every task adds the line keys of its documents to two Bloom filters: a key
   that isn't in the first goes there (once seen), any other goes to the second
   (twice seen). Of two tasks, what is twice seen in either or once seen in both
   is twice seen in the two together; bitwise this never loses a key.
   Filters merge by segments of `segment` bits, each in its own group.
2. The second filter goes to all tasks, at most `most_bits` of them. Keys that are in it are
   suspected of repeating. Only they are shuffled, as 128-bit digests with
   their documents, and counted exactly: false suspicions end here.
3. Of a key in enough documents, all but the largest doc_id lose its lines. The
   documents that lose lines make another Bloom filter; others never leave
   their task, and those in it are joined with the digests they lose.

The filters get 16 bits a line, up to most_bits. Beyond that they fill up and suspect
more, in the end every line: the work is then a shuffle of all digests, and the
result the same.

Defined results: a null or empty text is one empty line. Keys are the lines
without ASCII white space at their ends, A-Z lower-cased; those shorter than
`least` code points are never dropped. Rows that repeat a doc_id are one
document, and each loses its lines. A null doc_id counts for no line and keeps all
its lines. Very long texts are split one at a time. Extra columns may have any names. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.arrow import SPACES, free_names, modest_batches, small_batches, text_bytes
from tallyframe.llm.near_dup import with_group
from tallyframe.session import materialize

_U = np.uint64
DROPPED = "_dropped_lines"


@dataclass(frozen=True)
class LineRules:
    """least: code points of a key. documents: in which a key must be found. hashes: bits per key. segment: bits merged at once.
    most_bits: size of a filter, at most. hot_parts: keys with more than this part of the rows are joined by broadcast."""

    least: int = 20
    documents: int = 3
    hashes: int = 4
    segment: int = 1 << 18
    most_bits: int = 1 << 29
    hot_parts: int = 1000


def line_keys(data: bytes, least: int) -> list[bytes | None]:
    """The key of each line; None for lines that are too short."""
    found = []
    for line in data.split(b"\n"):
        key = line.strip(SPACES)
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            found.append(key.lower())
        else:
            found.append(None)
    return found


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def document_digests(texts: list[bytes], least: int) -> tuple[np.ndarray, list[bytes]]:
    """For each distinct key of each document the document's number and the key's digest."""
    numbers, digests = [], []
    for i, data in enumerate(texts):
        own = {digest(k) for k in set(line_keys(data, least)) if k is not None}
        numbers += [i] * len(own)
        digests += own
    return np.array(numbers, np.int64), digests


def halves(digests: list[bytes]) -> np.ndarray:
    """(n, 2) of int64."""
    return np.frombuffer(bytearray().join(digests), "<i8").reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)


def heads(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of digests."""
    return halves(digests)[:, 0].copy().view(_U)


def places(hashed: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(n, hashes) bits of each 64-bit hash; bits: a power of two, 2**32 at most."""
    step = (hashed >> _U(32)) | _U(1)
    return (hashed[:, None] + np.arange(hashes, dtype=_U)[None, :] * step[:, None]) & _U(bits - 1)


def _set(field: np.ndarray, at: np.ndarray) -> None:
    """Sets bits of a byte array."""
    at = np.unique(at)
    byte, bit = (at >> _U(3)).astype(np.int64), np.left_shift(1, (at & _U(7)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(first):
        field[byte[first]] |= np.add.reduceat(bit, first).astype(np.uint8)


def contains(field: np.ndarray, hashed: np.ndarray, hashes: int) -> np.ndarray:
    """Which hashes may have been added to a byte array; none that was added is missed."""
    at = places(hashed, 8 * len(field), hashes)
    return ((field[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).all(axis=1)


class SeenTwice:
    """The two filters of one task."""

    def __init__(self, bits: int, hashes: int):
        self.hashes = hashes
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashed: np.ndarray) -> None:
        """One hash for each document that has the key."""
        new, counts = np.unique(hashed, return_counts=True)
        again = (counts > 1) | contains(self.once, new, self.hashes)
        bits = 8 * len(self.once)
        _set(self.twice, places(new[again], bits, self.hashes).ravel())
        _set(self.once, places(new[~again], bits, self.hashes).ravel())
        _set(self.once, places(new[again & (counts > 1)], bits, self.hashes).ravel())

    def segments(self, size: int) -> list[tuple[int, bytes, bytes]]:
        """(number, once, twice) of segments that are not empty, compressed."""
        pack = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
        once, twice = self.once.reshape(-1, size // 8), self.twice.reshape(-1, size // 8)
        return [(int(i), pack(once[i]), pack(twice[i])) for i in np.flatnonzero(once.any(axis=1) | twice.any(axis=1))]


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size // 8, codec="zstd", asbytes=True), np.uint8)


def seen_twice(parts: DataFrame, bits: int, segment: int) -> np.ndarray:
    """The merged second filter of (segment, once, twice) rows, as bytes: bits // 8 of them come to the driver."""

    def run(batches):
        state = last = None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([pa.compress(state[1].tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["segment", "twice"])
        for batch in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = _unpacked(once, segment), _unpacked(twice, segment)
                if number != last:
                    if last is not None:
                        yield pack()
                    last, state = number, (once, twice)
                else:
                    state = state[0] | once, state[1] | twice | (state[0] & once)
        if last is not None:
            yield pack()

    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, twice binary")
    field = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        field[row.segment * (segment // 8) : (row.segment + 1) * (segment // 8)] = _unpacked(row.twice, segment)
    return field


def filter_bits(lines: int, rules: LineRules) -> int:
    """16 bits a line, as a power of two between one segment and most_bits."""
    return min(max(rules.segment, 1 << (16 * max(lines, 1) - 1).bit_length()), max(rules.most_bits, rules.segment))


def suspects(docs: DataFrame, rules: LineRules, key: str, text: str) -> DataFrame:
    """(k1, k2, id): halves of the distinct digests of keys that may be in several documents, with those documents."""
    spark = docs.sparkSession
    least, hashes, segment = rules.least, rules.hashes, rules.segment
    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    long_enough = F.floor(F.sum(F.octet_length("text")) / (2 * least))
    bits = filter_bits(known.agg(F.coalesce(long_enough, F.lit(0)).cast("long")).first()[0], rules)

    def build(batches):
        both = SeenTwice(bits, hashes)
        for batch in small_batches(batches, "text"):
            both.add(heads(document_digests(text_bytes(batch.column("text")), least)[1]))
        rows = both.segments(segment)
        for i in range(0, len(rows), 64):
            columns = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

    twice = spark.sparkContext.broadcast(seen_twice(known.mapInArrow(build, "segment int, once binary, twice binary"), bits, segment))

    def suspect(batches):
        for batch in small_batches(batches, "text"):
            numbers, digests = document_digests(text_bytes(batch.column("text")), least)
            found = contains(twice.value, heads(digests), hashes)
            half = halves(digests)[found]
            yield pa.RecordBatch.from_arrays([pa.array(half[:, 0]), pa.array(half[:, 1]), batch.column("id").take(pa.array(numbers[found]))], ["k1", "k2", "id"])

    found = materialize(known.mapInArrow(suspect, "k1 long, k2 long, id long").distinct(), "line-suspects")
    twice.destroy()
    return found


def lost_lines(docs: DataFrame, rules: LineRules, key: str, text: str) -> DataFrame:
    """(id, keys): the digests of the keys whose lines a document loses."""
    found = suspects(docs, rules, key, text)
    # a key in many documents is counted by partial sums
    repeated = found.groupBy("k1", "k2").agg(F.count("*").alias("held"), F.max("id").alias("last")).filter(F.col("held") >= rules.documents)
    losing = with_group(found, repeated, ["k1", "k2"], "id", found.count(), rules).filter(F.col("id") < F.col("last"))
    return materialize(losing.groupBy("id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys")), "line-losses")


def _id_filter(lost: DataFrame, rules: LineRules) -> np.ndarray:
    """A Bloom filter of the ids of `lost`."""
    bits, hashes, segment = filter_bits(lost.count(), rules), rules.hashes, rules.segment

    def build(batches):
        both = SeenTwice(bits, hashes)
        for batch in batches:
            hashed = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            _set(both.twice, places(hashed, bits, hashes).ravel())
        for number, _, twice in both.segments(segment):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([twice], pa.binary()), pa.array([twice], pa.binary())], ["segment", "once", "twice"])

    return seen_twice(lost.select(F.xxhash64("id").alias("h")).mapInArrow(build, "segment int, once binary, twice binary"), bits, segment)


def mark_lines(docs: DataFrame, rules: LineRules | None = None, key: str = "doc_id", text: str = "text", dropped: str = DROPPED) -> DataFrame:
    """docs with one more column, `dropped`: digests of the keys whose lines go; null if there are none."""
    rules, docs = rules or LineRules(), modest_batches(docs)
    lost = lost_lines(docs, rules, key, text)
    field, hashes = _id_filter(lost, rules), rules.hashes
    losers = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(T.BooleanType())
    def may_lose(hashed):
        return pd.Series(contains(losers.value, hashed.to_numpy().view(_U), hashes))

    lost_id, flag = free_names(docs, "_lost_id", "_may_lose")
    flagged = docs.withColumn(flag, may_lose(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(0)))))
    calm = flagged.filter(~F.col(flag)).drop(flag).withColumn(dropped, F.lit(None).cast("array<struct<k1:bigint,k2:bigint>>"))
    joined = flagged.filter(flag).drop(flag).join(lost.select(F.col("id").alias(lost_id), F.col("keys").alias(dropped)), F.col(key).cast("long") == F.col(lost_id), "left").drop(lost_id)
    return calm.unionByName(joined)


def kept_lines(data: bytes, gone: list[dict] | None, least: int) -> tuple[int, list[bytes]]:
    """Number of lines, and those that stay."""
    lines = data.split(b"\n")
    if not gone:
        return len(lines), lines
    gone = {struct.pack("<qq", g["k1"], g["k2"]) for g in gone}
    return len(lines), [line for line, k in zip(lines, line_keys(data, least), strict=True) if k is None or digest(k) not in gone]


def line_report(docs: DataFrame, rules: LineRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_lines, n_dropped, kept_sha256."""
    rules = rules or LineRules()
    kind, least = docs.schema[key].dataType.simpleString(), rules.least

    def run(batches):
        for batch in small_batches(batches, text):
            rows = []
            for data, gone in zip(text_bytes(batch.column(text)), batch.column(DROPPED).to_pylist(), strict=True):
                n, left = kept_lines(data, gone, least)
                rows.append((n, n - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], [key, "n_lines", "n_dropped", "kept_sha256"])

    return mark_lines(docs.select(key, text), rules, key, text).mapInArrow(run, f"`{key}` {kind}, n_lines long, n_dropped long, kept_sha256 string")


def remove_lines(docs: DataFrame, rules: LineRules | None = None, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the lines gone and all their columns; `length`, if a column, is set anew where the text changes."""
    rules, fields = rules or LineRules(), docs.schema
    dropped, least = free_names(docs, DROPPED)[0], rules.least
    length = length if length in docs.columns else None

    def run(batches):
        for batch in small_batches(batches, text):
            column, gone = batch.column(text), batch.column(dropped).to_pylist()
            out = batch.drop_columns([dropped])
            if any(gone):
                new = column.to_pylist()
                counts = out.column(length).to_pylist() if length else None
                for i, (data, keys) in enumerate(zip(text_bytes(column), gone, strict=True)):
                    if keys:
                        n, left = kept_lines(data, keys, least)
                        if len(left) < n:
                            new[i] = b"\n".join(left).decode("utf-8")
                            if length:
                                counts[i] = len(new[i])
                out = out.set_column(out.schema.get_field_index(text), out.schema.field(text), pa.array(new, column.type))
                if length:
                    out = out.set_column(out.schema.get_field_index(length), out.schema.field(length), pa.array(counts, out.schema.field(length).type))
            yield out

    return mark_lines(docs, rules, key, text, dropped).mapInArrow(run, fields)


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, r.last IS NOT NULL AND l.doc_id <> r.last AS gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
