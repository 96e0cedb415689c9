"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad. Its potentials come from its own
features and those of the lines before and after it; transition potentials tie
neighbours. Forward-backward marginals of "good", weighted by line length,
average to a document's raw quality, which a fitted logistic curve maps to a
score.

Training takes a bounded sample of labelled documents (`sample`, those of the
smallest digests of their keys, both labels alike, of at most `longest` bytes
each). A document's labels count once; null labels, other values than 0 and 1,
and labels that contradict each other are left out. Lines start with their
document's label; lines of bad documents that the first model holds for good
are relabelled once. Keys, languages and sources are no features.

Defined results: a text without words gets the curve's value at its mean
(`empty`); null is an empty text; repeated rows score alike; without any labels
every score is 0.5; a very long text is scored whole, as a batch of its own, by one worker; columns
other than the key, the text and the labels are not read, whatever their names;
empty tables stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.arrow import modest_batches, small_batches, text_bytes
from tallyframe.llm.setsketch import word_hashes

OWN = ("upper", "symbol", "bang", "digit", "bar", "punct", "repeat", "long_word", "short_word", "few_words", "many_words", "no_end", "mixed_case")
#: Bytes by class: upper, lower, symbol, "!", digit, "|", punctuation.
_CLASSES = np.zeros((256, 7), np.float32)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>@^~{}[]=+\\/_", b"!", b"0123456789", b"|", b".,;:?\"'()-")):
    _CLASSES[np.frombuffer(_set, np.uint8), _i] = 1


@dataclass(frozen=True)
class CrfRules:
    """sample: labelled documents to train on, at most; longest: bytes of one, at most, so that what comes to the
    driver is bounded. steps, rate, decay: of training."""

    sample: int = 2000
    longest: int = 20_000
    steps: int = 120
    rate: float = 0.5
    decay: float = 1e-3
    threshold: float = 0.3


@dataclass
class Lines:
    """Lines with words of some texts: features, weights (bytes), and the text of each."""

    x: np.ndarray
    size: np.ndarray
    text: np.ndarray
    n_texts: int


def read_lines(texts: list[bytes]) -> Lines:
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes, begin, end = word_hashes(data)
    first = np.searchsorted(begin, starts)
    n_words = np.diff(np.append(first, len(begin)))
    real = n_words > 0
    text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.searchsorted(text_start, starts, side="right") - 1
    counts = np.empty((len(starts), 7), np.float32)
    for c in range(7):
        counts[:, c] = np.add.reduceat(_CLASSES[:, c][a], starts)
    size = (ends - starts).astype(np.float32)
    n = np.maximum(n_words, 1).astype(np.float32)
    line_of_word = np.repeat(np.arange(len(starts)), n_words)
    twin = np.zeros(len(begin), np.float32)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1]) if len(begin) else 0
    repeat = np.bincount(line_of_word, twin, len(starts)).astype(np.float32)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    width = size / n
    last = a[np.maximum(end[np.maximum(np.cumsum(n_words) - 1, 0)] - 1, 0)] if len(begin) else np.zeros(len(starts), np.uint8)
    x = np.stack(
        [
            counts[:, 0] / letters, np.minimum(counts[:, 2] / n, 3), np.minimum(counts[:, 3] / n, 2), counts[:, 4] / np.maximum(size, 1), np.minimum(counts[:, 5] / n, 1), np.minimum(counts[:, 6] / n, 2),
            repeat / n, (width > 9), (width < 4), (n_words < 4), (n_words > 60), ~np.isin(last, np.frombuffer(b".!?:", np.uint8)), (counts[:, 0] > 0.3 * letters) & (counts[:, 1] > 0),
        ],
        axis=1,
    ).astype(np.float32)
    return Lines(x[real], size[real], text[real], len(texts))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Features of each line, of the one before and of the one after, and a constant."""
    x, same = lines.x, (lines.text[1:] == lines.text[:-1])[:, None]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    return np.concatenate([np.ones((len(x), 1), np.float32), x, before, after], axis=1)


def chains(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text that has any, longest text first."""
    begin = np.flatnonzero(np.concatenate([[True], lines.text[1:] != lines.text[:-1]])) if len(lines.text) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(lines.text)))
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def forward_backward(score: np.ndarray, move: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good per line, and of (label, next label) for each line that has a next one
    (summed). score: log potential of good over bad; move: transition potentials."""
    n = len(score)
    node = np.ones((n, 2))
    node[:, 1] = np.exp(np.clip(score, -30, 30))
    step = np.exp(move)
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    for t, k in enumerate(live):
        at = begin[:k] + t
        value = node[at] if t == 0 else (ahead[at - 1] @ step) * node[at]
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        below = node[at + 1] * back[at + 1]
        value = below @ step.T
        back[at] = value / value.sum(axis=1, keepdims=True)
        joint = ahead[at][:, :, None] * step * below[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class QualityModel:
    weights: np.ndarray
    move: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]
    empty: float

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; nan without lines."""
        lines = read_lines(texts)
        good, _ = forward_backward(with_neighbours(lines) / self.scale @ self.weights, self.move, *chains(lines))
        held = np.bincount(lines.text, lines.size, lines.n_texts)
        with np.errstate(invalid="ignore"):
            return np.bincount(lines.text, good * lines.size, lines.n_texts) / np.where(held > 0, held, np.nan)

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.raw(texts)
        value = 1 / (1 + np.exp(-(self.curve[0] * raw + self.curve[1])))
        return np.where(np.isnan(raw), self.empty, value)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, begin, length, rules: CrfRules) -> tuple[np.ndarray, np.ndarray]:
    weights, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    speed_w, speed_m = np.full(x.shape[1], 1e-6), np.full((2, 2), 1e-6)
    inner = np.ones(len(y), bool)
    inner[begin + length - 1] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1.0)
    n = len(y)
    for _ in range(rules.steps):
        good, pairs = forward_backward(x @ weights, move, begin, length)
        grad_w = x.T @ ((y - good) * weight) / n - rules.decay * weights
        grad_m = (seen - pairs) / n - rules.decay * move
        speed_w += grad_w**2
        speed_m += grad_m**2
        weights += rules.rate * grad_w / np.sqrt(speed_w)
        move += 0.2 * rules.rate * grad_m / np.sqrt(speed_m)
    return weights, move


def _curve(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the raw quality, by Newton's method."""
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
    return float(max(w[0], 1e-6)), float(w[1])


def fit(texts: list[bytes], labels: np.ndarray, rules: CrfRules) -> QualityModel:
    lines = read_lines(texts)
    if not len(lines.text) or len(np.unique(labels)) < 2:
        return QualityModel(np.zeros(1 + 3 * len(OWN)), np.zeros((2, 2)), np.ones(1 + 3 * len(OWN)), (0.0, 0.0), 0.5)
    x = with_neighbours(lines).astype(np.float64)
    scale = np.maximum(x.std(axis=0), 0.05)
    scale[0] = 1.0
    x /= scale
    of_text = labels[lines.text].astype(np.float64)
    y = of_text.copy()
    begin, length = chains(lines)
    model = None
    for turn in range(2):
        share = np.array([max((y == 0).mean(), 1e-3), max((y == 1).mean(), 1e-3)])
        weight = 0.5 / share[y.astype(int)]
        weights, move = _fit(x, y, np.minimum(weight, 5.0), begin, length, rules)
        model = QualityModel(weights, move, scale, (1.0, 0.0), 0.5)
        if turn == 0:
            good, _ = forward_backward(x @ weights, move, begin, length)
            y = np.where((of_text == 0) & (good > 0.5), 1.0, of_text)
    raw = model.raw(texts)
    fine = ~np.isnan(raw)
    model.curve = _curve(raw[fine], labels[fine].astype(np.float64))
    model.empty = float(1 / (1 + np.exp(-(model.curve[0] * raw[fine].mean() + model.curve[1]))))
    return model


def held_out(key) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, rules: CrfRules, key: str, text: str, label: str) -> tuple[list[bytes], np.ndarray]:
    """At most rules.sample labelled texts, half of each label as far as there are any."""
    open_rows = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    open_rows = open_rows.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"), F.max(label).alias("_other")).filter("_label = _other").drop("_other")
    order = F.md5(F.col("_key").cast("string")), F.col("_key")
    half = [open_rows.filter(F.col("_label") == v).orderBy(*order).limit(rules.sample // 2) for v in (0, 1)]
    chosen = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(half[0].union(half[1])), F.col("_id") == F.col("_key")).filter(F.octet_length("_text") <= rules.longest)
    rows = sorted(chosen.select("_key", "_label", "_text").toLocalIterator(), key=lambda r: (r._key, r._text))
    return [r._text.encode() for r in rows], np.array([r._label for r in rows], np.int64)


def quality_scores(docs: DataFrame, labels: DataFrame, rules: CrfRules | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, held_out, score, predicted."""
    rules = rules or CrfRules()
    model = fit(*training_sample(docs, labels, rules, key, text, label), rules)
    kind, threshold = docs.schema[key].dataType.simpleString(), rules.threshold

    def run(batches):
        for batch in small_batches(batches, text):
            scores = model.score(text_bytes(batch.column(text))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [key, "score", "predicted"])

    scored = modest_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
    return scored.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", "predicted")
