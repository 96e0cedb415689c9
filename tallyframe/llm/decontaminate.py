"""Benchmark decontamination with a generalised suffix automaton.

The normalised word sequences of all test items form one generalised suffix
automaton. The words of each training document stream through it; the
longest match that ends at each word is tracked. A match of `window` words
or more marks its words; an item shorter than that counts as one window.

The automaton is built on the driver, in blocks of items of at most
`block_words` words, and broadcast as flat arrays, `blocks_at_once` blocks
together: what is held anywhere is bounded by these parameters, not by the
benchmark. A larger benchmark takes several passes; each pass but the last
is written, its broadcast destroyed, and the marks of all passes are joined.

Words that no item holds, and runs of known word pairs too short for any
window, are skipped before the automaton is asked; this drops no match.

Defined results: null texts have no words; items without words are ignored;
an empty benchmark leaves all documents clean; repeated rows are judged
alike; repeated items are one item; very long and repetitive texts take time
in proportion to their words; other columns are passed on as they are,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.arrow import free_names, modest_batches, small_batches, text_bytes
from tallyframe.session import materialize

#: Fixed by contract: ASCII letters and digits, and all bytes of other characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class LeakRules:
    """window: words that must match in a row. block_words: words of items per automaton (building one takes
    about a kilobyte a word, once, on the driver). blocks_at_once: automata in a pass over the documents
    (some hundred bytes a word in every Python worker).

    max_span: spans of more hit words than this are cut out of a document, and
    so are spans shorter than a window, which are whole short items;
    max_coverage: documents with a larger share of hit words go altogether.
    """

    window: int = 10
    block_words: int = 200_000
    blocks_at_once: int = 5
    max_span: int = 9
    max_coverage: float = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends_at: list[int] = []

    def add(self, sequence: list[int]) -> list[int]:
        """Extends by one sequence; returns the state of each of its prefixes."""
        last, states = 0, []
        for symbol in sequence:
            last = self._extend(last, symbol)
            states.append(last)
        return states

    def _clone(self, source: int, length: int) -> int:
        self.next.append(dict(self.next[source]))
        self.link.append(self.link[source])
        self.length.append(length)
        return len(self.length) - 1

    def _redirect(self, state: int, symbol: int, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]

    def _split(self, state: int, symbol: int) -> int:
        """The state for the longest string of `state` followed by symbol, split off if shared with longer ones."""
        target = self.next[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._clone(target, self.length[state] + 1)
        self._redirect(state, symbol, target, copy)
        self.link[target] = copy
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, state = len(self.length) - 1, last
        while state != -1 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._split(state, symbol)
        return new


class LeakIndex:
    """Automaton of some items in flat arrays, with what a match in each state says about the items.

    A state's transitions are a sorted run of (symbol, target); some fifty bytes a word of items in all."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        built = SuffixAutomaton()
        coded = []
        for key, text in items:
            words = WORD.findall(text.lower())
            if words:
                coded.append((key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        paths = [(key, c, built.add(c)) for key, c in coded]
        self.link, self.length = array("i", built.link), array("i", built.length)
        self.first = array("i", [0])
        self.symbols, self.targets = array("i"), array("i")
        for moves in built.next:
            for symbol in sorted(moves):
                self.symbols.append(symbol)
                self.targets.append(moves[symbol])
            self.first.append(len(self.symbols))
        #: State -> its suffix-link ancestor that stands for the last `window` words.
        self.anchor = array("i", bytes(4 * len(self.length)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.link[state]
            self.anchor[state] = self.anchor[above] if self.length[above] >= window else state
        #: State -> items of which a window of full length ends there; whole short items by state and length.
        self.full: dict[int, set] = {}
        self.whole: dict[int, list[tuple[int, object]]] = {}
        for key, c, states in paths:
            if len(c) < window:
                state = states[-1]
                while self.length[self.link[state]] >= len(c):
                    state = self.link[state]
                self.whole.setdefault(state, []).append((len(c), key))
                continue
            for i in range(window - 1, len(c)):
                self.full.setdefault(self.anchor[states[i]], set()).add(key)
        #: State -> the nearest state, itself or by suffix links, at which a whole short item ends; -1 if there is none.
        self.report = array("i", [-1]) * len(self.length)
        if self.whole:
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                self.report[state] = state if state in self.whole else self.report[self.link[state]]
        size = len(self.vocabulary)
        pairs = [a * size + b for _, c, _ in paths for a, b in zip(c, c[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))

    def _go(self, state: int, symbol: int) -> int:
        """The state after symbol, or -1."""
        end = self.first[state + 1]
        at = bisect_left(self.symbols, symbol, self.first[state], end)
        return self.targets[at] if at < end and self.symbols[at] == symbol else -1

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words in which all neighbouring pairs are known, long enough for a window."""
        if not self.shortest or not len(codes):
            return []
        known = np.zeros(len(codes) + 1, bool)
        if len(self.pairs) and len(codes) > 1:
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            pair[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            known[1:-1] = self.pairs[at] == pair
        # known[i]: words i-1 and i follow each other in an item
        edge = np.flatnonzero(~known)
        starts, ends = edge[:-1], edge[1:]
        fit = (ends - starts >= self.shortest) & (codes[starts] >= 0)
        return list(zip(starts[fit].tolist(), ends[fit].tolist(), strict=True))

    def search(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges of words (they may overlap) and the keys of items hit."""
        spans, keys = [], set()
        go, link, length, window = self._go, self.link, self.length, self.window
        for start, end in self.candidates(codes):
            state, matched = 0, 0
            for i, symbol in enumerate(codes[start:end].tolist(), start):
                after = go(state, symbol)
                while state and after < 0:
                    state = link[state]
                    matched = length[state]
                    after = go(state, symbol)
                if after >= 0:
                    state, matched = after, matched + 1
                if matched >= window:
                    spans.append((i + 1 - matched, i + 1))
                    keys |= self.full[self.anchor[state]]
                back = self.report[state]
                while back > 0:  # at most one length a step, and all are shorter than the window
                    for n, key in self.whole[back]:
                        if n <= matched:
                            spans.append((i + 1 - n, i + 1))
                            keys.add(key)
                    back = self.report[link[back]]
        return spans, keys

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)


def item_blocks(items: DataFrame, rules: LeakRules, key: str, text: str):
    """Items from the driver's side, in blocks of bounded size; one block is held at a time."""
    block, held = [], 0
    for row in items.select(key, text).toLocalIterator():
        words = bytes(row[1] or "", "utf-8")
        n = max(1, len(words) // 4)
        if block and held + n > rules.block_words:
            yield block
            block, held = [], 0
        block.append((row[0], words))
        held += n
    if block:
        yield block


def item_passes(items: DataFrame, rules: LeakRules, key: str, text: str):
    """Indexes of blocks, in groups of at most `blocks_at_once`."""
    group: list[LeakIndex] = []
    for block in item_blocks(items, rules, key, text):
        if len(group) == rules.blocks_at_once:
            yield group
            group = []
        group.append(LeakIndex(block, rules.window))
    yield group


HITS = "_leak_spans", "_leak_items", "_leak_words"


def _mark(docs: DataFrame, group, text: str, names: tuple[str, ...]) -> DataFrame:
    """docs with spans (begin, end, begin, end ...), item keys, and the number of words; hits found before are joined in."""
    first = names[0] not in docs.columns

    def run(batches):
        indexes = group.value
        for batch in small_batches(batches, text):
            spans_out, keys_out, counts = [], [], []
            before = None if first else [batch.column(n).to_pylist() for n in names[:2]]
            for i, text_ in enumerate(text_bytes(batch.column(text))):
                words = WORD.findall(text_.lower())
                spans = list(zip(before[0][i][::2], before[0][i][1::2], strict=True)) if before else []
                keys = set(before[1][i]) if before else set()
                for index in indexes:
                    more, found = index.search(index.encode(words))
                    spans += more
                    keys.update(map(str, found))
                spans_out.append([x for s in merge_spans(spans) for x in s])
                keys_out.append(sorted(keys))
                counts.append(len(words))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in names]
            own = [n for n in batch.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans_out, pa.list_(pa.int64())), pa.array(keys_out, pa.list_(pa.string())), pa.array(counts, pa.int64())], [*own, *names])

    kinds = docs.schema
    if first:
        kinds = T.StructType([*kinds.fields, *(T.StructField(n, t) for n, t in zip(names, (T.ArrayType(T.LongType()), T.ArrayType(T.StringType()), T.LongType()), strict=True))])
    return docs.mapInArrow(run, kinds)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def mark_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text", names: tuple[str, ...] = HITS) -> DataFrame:
    """docs with three more columns: merged hit ranges in words, the sorted keys of items hit, and the number of words."""
    rules = rules or LeakRules()
    context = docs.sparkSession.sparkContext
    marked, sent = modest_batches(docs), None
    for group in item_passes(items, rules, item_key, item_text):
        if sent is not None:  # the pass before is written, so that no worker holds its index beside this one's
            marked = materialize(marked, "leak-marks")
            sent.destroy()
        sent = context.broadcast(group)
        marked = _mark(marked, sent, text, names)
    return marked


def leak_report(docs: DataFrame, items: DataFrame, rules: LeakRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in batch.column(HITS[0]).to_pylist()]
            keys = batch.column(HITS[1]).to_pylist()
            digests = [hashlib.sha256(",".join(k).encode()).hexdigest() for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(HITS[2]), pa.array(n_hit, pa.int64()), pa.array([len(k) for k in keys], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    marked = mark_leaks(docs.select(key, text), items, rules, text).select(key, *HITS)
    return marked.mapInArrow(run, f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs without leaked spans; documents over the coverage limit go. `length`, if a column, is set anew where the text changes."""
    rules = rules or LeakRules()
    fields, length = docs.schema, length if length in docs.columns else None
    names = tuple(free_names(docs, *HITS))

    def run(batches):
        for batch in small_batches(batches, text):
            texts, keep, new, changed = text_bytes(batch.column(text)), [], [], []
            for text_, flat in zip(texts, batch.column(names[0]).to_pylist(), strict=True):
                spans = [(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True)]
                if not spans:
                    keep.append(True), new.append(None), changed.append(False)
                    continue
                at = [m.span() for m in WORD.finditer(text_.lower())]
                keep.append(sum(b - a for a, b in spans) <= rules.max_coverage * len(at))
                parts, done = [], 0
                for a, b in spans:
                    if b - a > rules.max_span or b - a < rules.window:
                        parts.append(text_[done : at[a][0]])
                        done = at[b - 1][1]
                changed.append(done > 0)
                new.append(b"".join([*parts, text_[done:]]).decode("utf-8") if done else None)
            out = batch.drop_columns(list(names))
            if any(changed):
                mask, old = np.array(changed), out.column(text)
                replaced = pa.array([n if c else o for n, c, o in zip(new, changed, old.to_pylist(), strict=True)], old.type)
                out = out.set_column(out.schema.get_field_index(text), out.schema.field(text), replaced)
                if length:
                    counts = [len(n) if c else o for n, c, o in zip(new, mask, out.column(length).to_pylist(), strict=True)]
                    out = out.set_column(out.schema.get_field_index(length), out.schema.field(length), pa.array(counts, out.schema.field(length).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return mark_leaks(docs, items, rules, text, names=names).mapInArrow(run, fields)
