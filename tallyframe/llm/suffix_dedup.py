"""Removal of repeated passages by distributed difference-cover suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier
(in a document of smaller key, or further forward in the same one).

Suffixes that agree on `length` bytes must meet in one task. Each string of
that length has an anchor: its smallest hashed gram (of 37 bytes for strings of
100, so that an anchor covers at most 64 starts). Neighbouring start
positions with the same anchor form a range; a range with the bytes that its
strings span is a context. Anchors that occur once in the corpus cannot lie in
a repeated string and are left out. Equal contexts of an anchor are found by
digest (64 bits, beside the anchor's 64; so for texts alike by chance with a probability of
about 2**-64 for each pair of an anchor's contexts) before their bytes are sent. Where an
anchor has different contexts, these meet, and the suffixes of a batch of them
are sorted with a difference cover (see suffix_sort); neighbours in that order
are compared over `length` bytes, and in each group of equal strings all but
the first are marked.

Anchors in more than `hot` places do not meet in one task: their ranges are
split into single strings, dealt out by the string itself.

Texts of any length are anchored about a megabyte at a time, so that a worker
holds a few copies of its longest text and not hundreds of bytes for each byte
of a text that repeats itself.

Texts are shuffled once by key; marks come back to them by key. Spans never
cross documents.

Defined results: null is an empty text; texts shorter than `length` stay
whole; rows that share key and text are one document, each row keeping what the
first occurrence keeps (a key stands for one text: rows of one key with
different texts are not told apart); rows with a null key stay whole; extra
columns may have any names; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.arrow import free_names, modest_batches, small_batches, text_bytes
from tallyframe.llm.suffix_sort import MOST, suffix_order
from tallyframe.llm.suffix_stages import staged_marks
from tallyframe.session import materialize

_U = np.uint64
#: Starts in a piece of a range, at most: one bit of a mask each.
PIECE = 64
#: Bytes that are anchored at once, about; longer texts are cut into parts that overlap by a string less one byte.
PART = 1 << 20
#: Rows, or pieces with their bits, that are held at once.
SLICE = 1 << 14
CUT = "_cut_spans"


@dataclass(frozen=True)
class RepeatRules:
    """length: bytes of a repeated string, 16 to 2,000. hot: places of an anchor beyond which its ranges are
    split (fewer, for long strings: see split_beyond). batch: bytes sorted at once, beside those of one anchor.
    remembered: contexts a task remembers to drop copies early. stages: sort the suffixes of the contexts that
    differ in Spark stages (suffix_stages) and not in batches inside tasks; the result is the same."""

    length: int = 100
    hot: int = 6000
    batch: int = 300_000
    remembered: int = 60_000
    stages: bool = False

    def __post_init__(self):
        if not 16 <= self.length <= 2000 or not 1 <= self.batch <= MOST // 2:
            raise ValueError(f"length must be 16 to 2000 and batch 1 to {MOST // 2}")

    @property
    def split_beyond(self) -> int:
        """Places of an anchor whose contexts, after a batch, still fit the suffix sort at once."""
        return min(self.hot, (MOST - self.batch - 16) // (self.length + PIECE + 1))


def parts_of(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, begin, bytes) of parts of the texts that are long enough, about PART bytes at a time.
    Every string of a text is in just one part."""
    held, size = [], 0
    for i, data in enumerate(texts):
        for begin in range(0, max(len(data) - length + 1, 0), PART):
            part = data[begin : begin + PART + length - 1]
            if held and size + len(part) > PART:
                yield held
                held, size = [], 0
            held.append((i, begin, part))
            size += len(part)
    if held:
        yield held


class Ranges:
    """The anchor ranges of parts of texts. docs: number of each part's text; starts, ends: of the part in the joined
    data; shift: what turns a place in the data into one in the text."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int):
        self.length = length
        self.docs = np.array([i for i, _, _ in parts], np.int64)
        self.data = b"".join([p for _, _, p in parts])
        sizes = np.array([len(p) for _, _, p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.begins = np.array([begin for _, begin, _ in parts], np.int64)
        self.shift = self.begins - self.starts
        n = len(self.data)
        if not n:
            self.fp, self.at, self.n, self.doc = (np.zeros(0, np.int64) for _ in range(4))
            return
        gram = max(8, length - PIECE + 1)
        self.grams = length - gram + 1
        hashed = self._hashes(gram)
        least = _sliding(hashed, self.grams, np.minimum)
        new = np.zeros(len(least) + 1, bool)
        new[1:-1] = least[1:] != least[:-1]
        new[self.starts] = True
        new[self.ends - (length - 1)] = True
        edge = np.flatnonzero(new)
        begin, size = edge[:-1], np.diff(edge)
        # ranges that begin in the last bytes of a text are none
        doc = np.searchsorted(self.ends, begin, side="right")
        real = begin < self.ends[np.minimum(doc, len(self.ends) - 1)] - (length - 1)
        self.at, self.n, self.doc = begin[real], size[real], doc[real]
        self.fp = least[self.at].view(np.int64)
        self.hashed, self.least = hashed, least

    def _hashes(self, gram: int) -> np.ndarray:
        """A hash of the gram at each position."""
        words, n = _words(self.data), len(self.data) - gram + 1
        hashed = np.zeros(n, _U)
        for offset in dict.fromkeys([*range(0, gram - 8, 8), gram - 8]):
            hashed += words[offset : offset + n]
            hashed *= _U(0x9E3779B97F4A7C15)
            hashed ^= hashed >> _U(32)
        hashed *= _U(0xD6E8FEB86659FD93)
        hashed ^= hashed >> _U(32)
        return hashed

    def places(self) -> np.ndarray:
        """How many places each range counts for: two or more if a gram that anchors it may occur in it twice."""
        if not len(self.at):
            return self.n
        # neighbouring anchor positions with equal grams: text that may repeat inside one range
        padded = np.concatenate([np.zeros(self.grams - 1, _U), self.least, np.zeros(self.grams - 1, _U)])
        anchors = np.flatnonzero(_sliding(padded, self.grams, np.maximum) == self.hashed)
        twin = np.flatnonzero(self.hashed[anchors[1:]] == self.hashed[anchors[:-1]])
        left, right = anchors[twin], anchors[twin + 1]
        nth = np.searchsorted(left, self.at)
        inside = np.append(right, np.iinfo(np.int64).max)[nth] < self.at + self.n + self.grams - 1
        return np.maximum(np.where(inside, 2, 1), np.where(self.n > self.grams, -(-self.n // PIECE), 1))

    def pieces(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen ranges cut to at most PIECE starts: (range, begin, size)."""
        count = -(-self.n[chosen] // PIECE)
        which = np.repeat(chosen, count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        begin = self.at[which] + nth * PIECE
        return which, begin, np.minimum(PIECE, self.at[which] + self.n[which] - begin)


def _sliding(values: np.ndarray, window: int, pick) -> np.ndarray:
    """pick over every window of so many neighbours."""
    step = 1
    while step * 2 <= window:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = window - step
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def repeated_starts(contexts: list[tuple[bytes, tuple]], length: int) -> np.ndarray:
    """contexts: distinct (bytes, place of their first byte), sorted by place. A bit mask for
    each: bit i is set if the string at i is equal to one that starts earlier."""
    data = b"\x00".join(c for c, _ in contexts) + b"\x00" * 8
    text = np.frombuffer(data, np.uint8)
    sizes = np.array([len(c) - length + 1 for c, _ in contexts], np.int64)
    begins = np.cumsum([0] + [len(c) + 1 for c, _ in contexts[:-1]])
    which = np.repeat(np.arange(len(contexts)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = begins[which] + nth
    place = np.full(len(text), -1, np.int64)
    place[starts] = np.arange(len(starts))
    order = place[suffix_order(text[:-7], length)]
    order = order[order >= 0]
    at = starts[order]
    same, words = np.ones(len(at) - 1, bool), _words(data)
    for shift in [*range(0, length - 7, 8), length - 8]:
        there = words[at + shift]
        same &= there[1:] == there[:-1]
    group = np.concatenate([[0], np.flatnonzero(~same) + 1])
    first = np.minimum.reduceat(order, group)
    later = order != np.repeat(first, np.diff(np.concatenate([group, [len(order)]])))
    bits = np.zeros(len(starts), _U)
    bits[order[later]] = 1
    bits <<= nth.astype(_U)
    return np.add.reduceat(bits, np.cumsum(sizes) - sizes).view(np.int64)


def _repeats_inside(context: bytes, length: int) -> bool:
    """Whether a string of the context may start in it twice. All its strings share the bytes
    from the last start to the end of the first string; those must then occur again."""
    last = len(context) - length
    return context.find(context[last:length], last + 1) >= 0


def _words(data: bytes) -> np.ndarray:
    """The eight bytes at each position of data, as integers."""
    words = np.empty(len(data) - 7, _U)
    for o in range(8):
        part = np.frombuffer(data, "<u8", count=(len(data) - o) // 8, offset=o)
        words[o::8] = part[: len(words[o::8])]
    return words


def _anchor_counts(docs: DataFrame, rules: RepeatRules, key: str, text: str) -> DataFrame:
    """(fp, id, places) of every anchor."""

    def run(batches):
        for batch in small_batches(batches, text):
            ids = batch.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for parts in parts_of(text_bytes(batch.column(text)), rules.length):
                found = Ranges(parts, rules.length)
                yield pa.RecordBatch.from_arrays([pa.array(found.fp), pa.array(ids[found.docs][found.doc], pa.int64()), pa.array(found.places().astype(np.int32))], ["fp", "id", "places"])

    return docs.filter(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "fp long, id long, places int")


#: Columns joined to the documents, under names that are free there: repeated anchors, hot ones, marks, places asked for.
FOUND = "_fps", "_hot_fps", "_marks", "_asked"


def _with_anchors(batch: pa.RecordBatch, text: str, fps: str) -> list[bytes]:
    """The texts that have repeated anchors; empty ones for the others."""
    some = batch.column(fps).is_valid().to_pylist()
    return [t if s else b"" for t, s in zip(text_bytes(batch.column(text)), some, strict=True)]


def _anchors(column: pa.Array) -> np.ndarray:
    """All anchors of a list column."""
    return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _chosen(found: Ranges, known: np.ndarray, burning: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ranges with repeated anchors that are not hot, and of those that are."""
    is_hot = np.isin(found.fp, burning)
    return np.flatnonzero(np.isin(found.fp, known) & ~is_hot), np.flatnonzero(is_hot)


def _places(anchored: DataFrame, rules: RepeatRules, key: str, text: str, fps_name: str, hot_name: str) -> DataFrame:
    """(fp, id, place, digest) of contexts of repeated anchors, without their bytes; place holds the start, the number of
    starts less one, and whether a string may start in the context twice. Copies a task has seen are dropped."""
    length = rules.length

    def digest(data: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)

    def packed(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fp", "id", "place", "digest"])

    def cold_rows(found: Ranges, cold: np.ndarray, ids: np.ndarray, seen: dict) -> Iterator[tuple[int, int, int, int]]:
        which, begin, size = found.pieces(cold)
        doc = found.doc[which]
        for fp, doc_id, start, at, n in zip(found.fp[which].tolist(), ids[doc].tolist(), (begin + found.shift[doc]).tolist(), begin.tolist(), size.tolist(), strict=True):
            context = found.data[at : at + n + length - 1]
            name = digest(context)
            before = seen.get((fp, name))
            if before is not None and before < (doc_id, start):
                continue
            if len(seen) >= rules.remembered:
                seen.clear()
            seen[fp, name] = (doc_id, start)
            yield fp, doc_id, start << 8 | (n - 1) << 1 | _repeats_inside(context, length), name

    def single_rows(found: Ranges, hot: np.ndarray, ids: np.ndarray, seen: dict) -> Iterator[tuple[int, int, int, int]]:
        """Each string of a hot range, dealt by itself; one seen earlier in the same task costs no digest."""
        data = found.data
        for r in hot.tolist():
            doc_id, shift = int(ids[found.doc[r]]), int(found.shift[found.doc[r]])
            for at in range(int(found.at[r]), int(found.at[r] + found.n[r])):
                string = data[at : at + length]
                before = seen.get(string)
                if before is not None and before < (doc_id, at + shift):
                    continue
                if len(seen) >= rules.remembered:
                    seen.clear()
                seen[string] = (doc_id, at + shift)
                yield digest(b"single" + string), doc_id, (at + shift) << 8, digest(string)

    def run(batches):
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        singles: dict[bytes, tuple[int, int]] = {}
        for batch in small_batches(batches, text):
            known, burning = _anchors(batch.column(fps_name)), _anchors(batch.column(hot_name))
            numbers = batch.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for parts in parts_of(_with_anchors(batch, text, fps_name), length):
                found = Ranges(parts, length)
                cold, hot = _chosen(found, known, burning)
                ids = numbers[found.docs]
                rows = chain(cold_rows(found, cold, ids, seen), single_rows(found, hot, ids, singles))
                while some := list(islice(rows, SLICE)):
                    yield packed(some)

    return anchored.mapInArrow(run, "fp long, id long, place long, digest long")


def _first_places(places: DataFrame) -> DataFrame:
    """(fp, id, start, size, needed) of the first occurrence of every distinct context of an anchor. Its bytes are needed
    where the anchor has other contexts, or a string may start in it twice. An anchor has at most split_beyond places."""
    firsts = places.repartition("fp").groupBy("fp", "digest").agg(F.min(F.struct("id", "place")).alias("first"))
    several = F.count("*").over(Window.partitionBy("fp")) > 1
    place = F.col("first.place")
    return firsts.select("fp", F.col("first.id").alias("id"), F.shiftright(place, 8).cast("int").alias("start"), (F.shiftright(place, 1).bitwiseAND(F.lit(127)) + 1).cast("int").alias("size"), (several | (place.bitwiseAND(F.lit(1)) == 1)).alias("needed"))


def _contexts(asked: DataFrame, rules: RepeatRules, key: str, text: str, asked_name: str) -> DataFrame:
    """(fp, id, start, context) that documents are asked for: array<struct<fp,start,size>>."""
    length = rules.length

    def run(batches):
        for batch in small_batches(batches, text):
            some = batch.filter(batch.column(asked_name).is_valid())
            rows = []
            for doc_id, data, places in zip(some.column(key).cast(pa.int64()).to_pylist(), text_bytes(some.column(text)), some.column(asked_name).to_pylist(), strict=True):
                rows += [(p["fp"], doc_id, p["start"], data[p["start"] : p["start"] + p["size"] + length - 1]) for p in places]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["fp", "id", "start", "context"])

    return asked.mapInArrow(run, "fp long, id long, start int, context binary")


def _marks(contexts: DataFrame, rules: RepeatRules) -> DataFrame:
    """(id, start, mask) of the first occurrence of every distinct context."""

    def rows(places: list[tuple[int, int]], masks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int32()), pa.array(masks, pa.int64())], ["id", "start", "mask"])

    def flush(groups: dict[bytes, tuple[int, int]], alone: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if groups:
            ordered = sorted(groups.items(), key=lambda c: c[1])
            yield rows([p for _, p in ordered], repeated_starts(ordered, rules.length))
        if alone:
            yield rows(alone, np.zeros(len(alone), np.int64))

    def run(batches):
        groups: dict[bytes, tuple[int, int]] = {}
        alone: list[tuple[int, int]] = []
        own: dict[bytes, tuple[int, int]] = {}
        held, last = 0, None

        def settle() -> int:
            """The anchor's contexts go to be sorted, or aside if one is all and holds no string twice."""
            if len(own) == 1 and not _repeats_inside(*own, rules.length):
                alone.extend(own.values())
                return 0
            groups.update(own)
            return sum(map(len, own)) + len(own)

        for batch in batches:
            for fp, doc_id, start, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fp != last:
                    held += settle()
                    own = {}
                    if held >= rules.batch or len(alone) >= 50_000:
                        yield from flush(groups, alone)
                        groups, alone, held = {}, [], 0
                last, place = fp, (doc_id, start)
                before = own.get(context)
                if before is None or place < before:
                    own[context] = place
        settle()
        yield from flush(groups, alone)

    return contexts.repartition("fp").sortWithinPartitions("fp").mapInArrow(run, "id long, start int, mask long")


def mark_repeats(docs: DataFrame, rules: RepeatRules | None = None, key: str = "doc_id", text: str = "text", cut: str = CUT) -> DataFrame:
    """docs with one more column, `cut`: the byte spans to remove, as begin, end, begin, end ..."""
    rules, docs = rules or RepeatRules(), modest_batches(docs)
    fps_name, hot_name, marks_name, asked_name, anchor_id, mark_id, asked_id = free_names(docs, *FOUND, "_anchor_id", "_mark_id", "_asked_id")
    # read twice, for the counts and for the join: cheaper to find again than to keep
    occurring = _anchor_counts(docs, rules, key, text)
    repeated = occurring.groupBy("fp").agg(F.sum("places").alias("all")).filter("all > 1").select("fp", (F.col("all") > rules.split_beyond).alias("is_hot"))
    of_doc = occurring.select("fp", "id").join(repeated, "fp").groupBy("id").agg(F.collect_set("fp").alias(fps_name), F.collect_set(F.when(F.col("is_hot"), F.col("fp"))).alias(hot_name))
    of_doc = materialize(of_doc.withColumnRenamed("id", anchor_id), "repeat-documents")
    # one shuffle of the texts serves all three joins; left joins leave its plan the same
    on = F.col(key).cast("long") == F.col(anchor_id)
    anchored = docs.join(of_doc.hint("merge"), on, "left").drop(anchor_id)
    firsts = _first_places(_places(anchored, rules, key, text, fps_name, hot_name))
    asked = firsts.filter("needed").groupBy(F.col("id").alias(asked_id)).agg(F.collect_list(F.struct("fp", "start", "size")).alias(asked_name))
    asked = docs.join(asked.hint("merge"), F.col(key).cast("long") == F.col(asked_id), "left").drop(asked_id)
    contexts = _contexts(asked, rules, key, text, asked_name)
    marks = staged_marks(contexts, rules.length) if rules.stages else _marks(contexts, rules)
    marks = marks.unionByName(firsts.filter("not needed").select("id", "start", F.lit(0).cast("long").alias("mask")))
    marks = marks.groupBy(F.col("id").alias(mark_id)).agg(F.collect_list(F.struct("start", "mask")).alias(marks_name))
    both = docs.join(of_doc.hint("merge"), on, "left").drop(anchor_id).join(marks.hint("merge"), F.col(key).cast("long") == F.col(mark_id), "left").drop(mark_id)
    length, fields = rules.length, docs.schema.names

    def run(batches):
        for batch in small_batches(batches, text):
            texts = _with_anchors(batch, text, fps_name)
            known, burning, marks = _anchors(batch.column(fps_name)), _anchors(batch.column(hot_name)), _marks_by_text(batch.column(marks_name))
            gone: dict[int, np.ndarray] = {}
            for parts in parts_of(texts, length):
                found = Ranges(parts, length)
                flagged = _flagged(found, *_chosen(found, known, burning), marks)
                if not flagged.any():
                    continue
                # a byte goes if one of the `length` starts up to it is flagged
                until = np.concatenate([np.zeros(length, np.int32), np.cumsum(flagged, dtype=np.int32)])
                covered = until[length:] > until[:-length]
                for i, begin, a, b in zip(found.docs.tolist(), found.begins.tolist(), found.starts.tolist(), found.ends.tolist(), strict=True):
                    if covered[a:b].any():
                        gone.setdefault(i, np.zeros(len(texts[i]), bool))[begin : begin + b - a] |= covered[a:b]
            spans = [np.flatnonzero(np.diff(np.concatenate([[False], gone[i], [False]]).astype(np.int8))).tolist() if i in gone else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(spans, pa.list_(pa.int64()))], [*fields, cut])

    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(cut, T.ArrayType(T.LongType()))]))


def _marks_by_text(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts, in order, and masks of each row's marks."""
    found = []
    for marks in column.to_pylist():
        starts, masks = (np.array([m[k] for m in marks or ()], np.int64) for k in ("start", "mask"))
        order = np.argsort(starts)
        found.append((starts[order], masks[order].view(_U)))
    return found


def _flagged(found: Ranges, cold: np.ndarray, hot: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each place in the data, whether a string starts there that also starts earlier."""
    # what is not the first occurrence of its context is repeated as a whole
    mask = np.full(len(found.data), np.iinfo(_U).max, _U)
    for i, begin, a, b in zip(found.docs.tolist(), found.begins.tolist(), found.starts.tolist(), found.ends.tolist(), strict=True):
        starts, masks = marks[i]
        own = slice(*np.searchsorted(starts, [begin, begin + b - a - found.length + 1]))
        mask[starts[own] + (a - begin)] = masks[own]
    flagged = np.zeros(len(found.data), bool)
    for at, n in zip(found.at[hot].tolist(), found.n[hot].tolist(), strict=True):
        flagged[at : at + n] = mask[at : at + n] & _U(1)
    _, begin, size = found.pieces(cold)
    bit = np.arange(PIECE)
    for i in range(0, len(begin), SLICE):
        first = begin[i : i + SLICE]
        on = ((mask[first][:, None] >> bit.astype(_U)) & _U(1)).astype(bool) & (bit < size[i : i + SLICE, None])
        row, shift = np.nonzero(on)
        flagged[first[row] + shift] = True
    return flagged


def repeat_report(docs: DataFrame, rules: RepeatRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in small_batches(batches, text):
            rows = []
            for data, flat in zip(text_bytes(batch.column(text)), batch.column(CUT).to_pylist(), strict=True):
                kept, done = hashlib.sha256(), 0
                for a, b in zip(flat[::2], flat[1::2], strict=True):
                    kept.update(data[done:a])
                    done = b
                kept.update(data[done:])
                rows.append((len(data), sum(flat[1::2]) - sum(flat[::2]), len(flat) // 2, kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return mark_repeats(docs.select(key, text), rules, key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, rules: RepeatRules | None = None, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs without repeated passages; spans shrink to whole characters. Documents of which only
    white space is left go. `length`, if a column, is set anew where the text changes."""
    fields, length = docs.schema, length if length in docs.columns else None
    cut = free_names(docs, CUT)[0]

    def run(batches):
        for batch in small_batches(batches, text):
            column, spans = batch.column(text), batch.column(cut).to_pylist()
            out = batch.drop_columns([cut])
            if any(spans):
                new = column.to_pylist()
                counts = out.column(length).to_pylist() if length else None
                keep = [True] * len(new)
                for i, (data, flat) in enumerate(zip(text_bytes(column), spans, strict=True)):
                    if not flat:
                        continue
                    parts, done = [], 0
                    for a, b in zip(flat[::2], flat[1::2], strict=True):
                        while a < len(data) and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        if a < b:
                            parts.append(data[done:a])
                            done = b
                    new[i] = b"".join([*parts, data[done:]]).decode("utf-8")
                    keep[i] = bool(new[i].strip())
                    if length:
                        counts[i] = len(new[i])
                out = out.set_column(out.schema.get_field_index(text), out.schema.field(text), pa.array(new, column.type))
                if length:
                    out = out.set_column(out.schema.get_field_index(length), out.schema.field(length), pa.array(counts, out.schema.field(length).type))
                out = out.filter(pa.array(keep, pa.bool_()))
            yield out

    return mark_repeats(docs, rules, key, text, cut).mapInArrow(run, fields)
