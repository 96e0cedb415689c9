"""Quality rules: counts over words and lines, and tokeniser fertility.

A public vocabulary with byte fallback measures every document: characters
per token, the share of tokens that are fallback bytes, and the entropy of
its tokens. Bands per language, or else per script, reject documents outside
them.

Each distinct word is encoded by itself, once per task while the bounded
word cache holds it; a document's figures are sums over its words, so the
whole text counts whatever its length. A very long text is a batch of its own,
split into words at once by one worker.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; an empty table gives an empty table; columns
other than the key, text and language play no part, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.arrow import SPACES, keep_rows, modest_batches, small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits outside which a document is rejected; None sets no limit."""

    min_chars_per_token: float | None = None
    max_chars_per_token: float | None = None
    max_fallback_share: float | None = None
    min_entropy: float | None = None


@dataclass(frozen=True)
class FertilityRules:
    """vocabulary: a SentencePiece file with byte fallback.

    bands: by language code, else by script (see script_of). Entropy is in
    bits, over the log of the token count, so that short texts compare.
    """

    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    min_words: int = 50
    max_repeat_percent: int = 50
    cached_words: int = 150_000
    bands: dict[str, Band] = field(default_factory=lambda: dict(DEFAULT_BANDS))


#: Lower limits of the four languages: about what 0.75 % of the documents with quality label 1 that pass the base rule
#: fall below (12,000 labelled documents). Scripts have no labels here; their limits leave room around plain prose.
DEFAULT_BANDS = {
    "en": Band(2.05, 6.0, 0.05, 0.40),
    "de": Band(2.07, 6.0, 0.05, 0.40),
    "es": Band(1.825, 6.0, 0.05, 0.40),
    "fr": Band(1.855, 6.0, 0.05, 0.40),
    "latin": Band(1.5, 8.0, 0.10, 0.40),
    "cyrillic": Band(1.2, 6.0, 0.10, 0.30),
    "greek": Band(0.6, 4.0, 0.10, 0.20),
    "arabic": Band(0.7, 4.0, 0.10, 0.20),
    "hebrew": Band(0.6, 4.0, 0.10, 0.20),
    "devanagari": Band(0.45, 4.0, 0.40, 0.20),
    "thai": Band(0.6, 4.0, 0.30, 0.20),
    "han": Band(0.4, 3.0, 0.70, 0.30),
    "kana": Band(0.45, 3.0, 0.50, 0.30),
    "hangul": Band(0.35, 3.0, 0.70, 0.30),
    "other": Band(0.25, 8.0, 0.95, 0.20),
}
#: First and last lead byte of the UTF-8 forms of a script's letters.
SCRIPTS = {"greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD3), "hebrew": (0xD6, 0xD7), "arabic": (0xD8, 0xDB), "kana": (0xE3, 0xE3), "han": (0xE4, 0xE9), "hangul": (0xEA, 0xED)}
#: Scripts that share the lead byte E0: first and last second byte.
SOUTHERN = {"devanagari": (0xA4, 0xA5), "thai": (0xB8, 0xB9)}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("chars_per_token", "fallback_share", "token_entropy")
MEASURES_DDL = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS] + ["base_failed boolean", "kept boolean"])

class WordFertility:
    """Token counts and ids of words, encoded once each and kept in a bounded cache."""

    def __init__(self, rules: FertilityRules):
        import sentencepiece

        self.limit = rules.cached_words
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
        n = self.pieces.get_piece_size()
        self.is_fallback = np.fromiter((self.pieces.is_byte(i) for i in range(n)), bool, n)
        self.reset()

    def reset(self):
        self.index: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.fallback = np.zeros(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        """Makes sure that all of words are in the cache; called once for many texts."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.limit and self.index:
            self.reset()
            new = list(words)
        if not new:
            return
        texts = [w.decode("utf-8", "replace") for w in new]
        coded = self.pieces.encode(texts, out_type=int, num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.int32, int(lengths.sum()))
        ends = np.cumsum(lengths)
        fell = np.concatenate([[0], np.cumsum(self.is_fallback[ids])])
        self.fallback = np.concatenate([self.fallback, fell[ends] - fell[ends - lengths]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    def measure(self, codes: np.ndarray, counts: np.ndarray, chars: int) -> tuple[float, float, float]:
        """codes: the distinct words of a text, counts: how often each occurs."""
        lengths = self.starts[codes + 1] - self.starts[codes]
        tokens = int((lengths * counts).sum())
        if not tokens:
            return 0.0, 0.0, 0.0
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends + lengths, lengths)
        weight = np.bincount(self.ids[at], np.repeat(counts, lengths))
        share = weight[weight > 0] / tokens
        entropy = float(-(share * np.log2(share)).sum()) / math.log2(tokens) if tokens > 1 else 0.0
        return chars / tokens, float((self.fallback[codes] * counts).sum()) / tokens, entropy


def repeat_words(codes: np.ndarray, n_distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(codes) < 4:
        return 0
    base = np.int64(n_distinct)
    if n_distinct < 2_000_000:
        windows = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * base + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * np.int64(len(codes)) + pairs[1:]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= hit
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes], codes: np.ndarray, n_distinct: int) -> tuple[int, int, int, int, int]:
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(text.decode("utf-8", "replace")) - len(text) + len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(codes, n_distinct)


def script_of(text: bytes) -> str:
    """latin, if at most a third of the code points are outside ASCII; else the script with most letters, if it has over a
    third of those outside ASCII (Japanese counts as kana if a tenth is), else other."""
    codes = np.frombuffer(text, np.uint8)
    counts = np.bincount(codes, minlength=256)
    high, low = int(counts[0xC0:].sum()), int(counts[:0x80].sum())
    if 3 * high <= high + low:
        return "latin"
    found = {name: int(counts[a : b + 1].sum()) for name, (a, b) in SCRIPTS.items()}
    second = np.bincount(codes[1:][codes[:-1] == 0xE0], minlength=256)
    found |= {name: int(second[a : b + 1].sum()) for name, (a, b) in SOUTHERN.items()}
    if 10 * found["kana"] >= high:
        found["kana"] += found["han"]
    best = max(found, key=found.__getitem__)
    return best if 3 * found[best] > high else "other"


def within(band: Band, chars_per_token: float, fallback: float, entropy: float) -> bool:
    return (
        (band.min_chars_per_token is None or chars_per_token >= band.min_chars_per_token)
        and (band.max_chars_per_token is None or chars_per_token <= band.max_chars_per_token)
        and (band.max_fallback_share is None or fallback <= band.max_fallback_share)
        and (band.min_entropy is None or entropy >= band.min_entropy)
    )


class Judge:
    """Measures batches of texts; holds the vocabularies of one task."""

    def __init__(self, rules: FertilityRules):
        self.rules, self.words = rules, WordFertility(rules)

    def rows(self, texts: list[bytes], langs: list[str | None]) -> list[tuple]:
        rules, found = self.rules, []
        split = [text.split() for text in texts]
        self.words.learn({w for words in split for w in words})
        of = self.words.index.__getitem__
        for text, lang, words in zip(texts, langs, split, strict=True):
            coded = np.fromiter(map(of, words), np.int64, len(words))
            distinct, codes, counts = np.unique(coded, return_inverse=True, return_counts=True)
            base = base_counts(text, words, codes, max(len(distinct), 1))
            failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_percent * base[0]
            ratios = self.words.measure(distinct, counts, base[1]) if words else (0.0, 0.0, 0.0)
            band = rules.bands.get(lang or "") or rules.bands.get(script_of(text)) or Band()
            found.append((*base, *ratios, failed, not failed and within(band, *ratios)))
        return found


def quality_measures(docs: DataFrame, rules: FertilityRules | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, the counts, the ratios, base_failed and kept."""
    rules = rules or FertilityRules()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        judge = Judge(rules)
        for batch in small_batches(batches, text, 1 << 20):
            rows = judge.rows(text_bytes(batch.column(text)), batch.column(lang).to_pylist())
            columns = list(zip(*rows, strict=True)) or [()] * 10
            types = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = [key, *COUNTS, *RATIOS, "base_failed", "kept"]
    return modest_batches(docs).select(key, text, lang).mapInArrow(run, f"`{key}` {kind}, {MEASURES_DDL}")


def keep_quality(docs: DataFrame, rules: FertilityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = rules or FertilityRules()
    judges: list[Judge] = []

    def verdict(batch):
        if not judges:
            judges.append(Judge(rules))
        return pa.array([row[-1] for row in judges[0].rows(text_bytes(batch.column(text)), batch.column(lang).to_pylist())], pa.bool_())

    return keep_rows(docs, text, verdict)
