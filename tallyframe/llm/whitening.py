"""Whitening of embeddings by hierarchical merging of singular value decompositions.

1. Every task cuts its vectors into blocks of `rows` and decomposes each block,
   centred at its own mean. A state is the number of vectors, their exact sums,
   and all singular values and right singular vectors, none cut off.
2. Two states merge by stacking their scaled singular vectors under each other
   with one more row, the difference of their means times sqrt(n m / (n + m)),
   and by decomposing the stack again. That is the decomposition of all their
   vectors centred at the common mean, up to rounding.
3. States of tasks merge in rounds of `fan_in`, each written to the shared
   folder; the driver gets the last one, of the size of one covariance matrix.
4. A second pass whitens all vectors and gathers the moments of what comes out
   through the same rounds, to tell how far its covariance is from the identity.

Entries c count as floor(scale * c) + offset, so that sums and deviations are
exact integers.

Defined results: rows whose vector is null or holds null, NaN or an infinite
entry are left out, and so are entries of 2**40 and more after scaling, which
can't be handled exactly. Vectors of another length than most of the others (the
longer one among equals) are left out too. Rows that repeat count as often as
they occur; rows with a null key are fitted and whitened as others are. Extra
columns are not read. Components without variance (fewer vectors than
dimensions, constant entries) have explained 0 and a null `whitened`, and stay
out of identity_error, which is null if no component has variance. A deviation
that no long can hold is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyframe.llm.arrow import modest_batches
from tallyframe.session import materialize

#: Entries beyond this size, after scaling, are no numbers that sums could hold exactly.
LARGEST = 2.0**40
_STATE = "part long, n long, sums string, values binary, vectors binary"


@dataclass(frozen=True)
class WhitenRules:
    """scale, offset: of the integers that entries become. components: returned at most. rows: vectors that are
    decomposed at once (2,048 at most, for exactness). fan_in: states that one task merges in a round."""

    scale: float = 64.0
    offset: int = 1_000_000
    components: int = 32
    rows: int = 1024
    fan_in: int = 16


@dataclass(frozen=True)
class Spread:
    """n vectors: their sums (Python integers), singular values and right singular vectors around their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of_block(block: np.ndarray) -> Spread:
        """block: (n, d) of int64. The differences from the mean are rounded once."""
        n, sums = len(block), block.sum(axis=0)
        values, vectors = np.linalg.svd((n * block - sums) / n, full_matrices=False)[1:]
        return Spread(n, sums.tolist(), values, vectors)

    def merged(self, other: Spread) -> Spread:
        both = self.n + other.n
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        correction = gap * np.sqrt(self.n * other.n / both)
        stack = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction])
        values, vectors = np.linalg.svd(stack, full_matrices=False)[1:]
        return Spread(both, [a + b for a, b in zip(self.sums, other.sums, strict=True)], values, vectors)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": ",".join(map(str, self.sums)), "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @staticmethod
    def of_row(row) -> Spread:
        sums = [int(x) for x in row["sums"].split(",")]
        return Spread(row["n"], sums, np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(-1, len(sums)))


@dataclass(frozen=True)
class Moments:
    """n vectors: their mean and the sum of products of their differences from it."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of_block(block: np.ndarray) -> Moments:
        mean = block.mean(axis=0)
        return Moments(len(block), mean, (block - mean).T @ (block - mean))

    def merged(self, other: Moments) -> Moments:
        both, gap = self.n + other.n, other.mean - self.mean
        return Moments(both, self.mean + gap * (other.n / both), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / both))

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": "", "values": self.mean.tobytes(), "vectors": self.products.tobytes()}

    @staticmethod
    def of_row(row) -> Moments:
        mean = np.frombuffer(row["values"])
        return Moments(row["n"], mean, np.frombuffer(row["vectors"]).reshape(len(mean), len(mean)))


def _table(rows: list[dict]) -> pa.Table:
    kinds = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("values", pa.binary()), ("vectors", pa.binary())])
    return pa.Table.from_pylist(rows, schema=kinds)


def states_of_tasks(vectors: DataFrame, kind: type, blocks: Callable, rules: WhitenRules) -> DataFrame:
    """One state (Spread or Moments) of each task that has vectors. blocks(batches) yields arrays of vectors."""
    most = rules.rows

    def run(batches):
        state, held, size = None, [], 0

        def settled(state):
            whole = np.concatenate(held)
            for i in range(0, len(whole), most):
                new = kind.of_block(whole[i : i + most])
                state = new if state is None else state.merged(new)
            return state

        for block in blocks(batches):
            held.append(block)
            size += len(block)
            if size >= most:
                state, held, size = settled(state), [], 0
        if size:
            state = settled(state)
        if state is not None:
            yield from _table([state.row(TaskContext.get().partitionId())]).to_batches()

    return vectors.mapInArrow(run, _STATE)


def merged_state(states: DataFrame, kind: type, rules: WhitenRules, name: str):
    """What all states add up to, in rounds of fan_in by number of task; None if there are none. Only the last one,
    whose size is that of one matrix of the dimensions, comes to the driver."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["nth"])
        state = kind.of_row(rows[0])
        for row in rows[1:]:
            state = state.merged(kind.of_row(row))
        return _table([state.row(rows[0]["part"])])

    states = materialize(states, name)
    while states.count() > 1:
        dealt = states.withColumn("nth", F.col("part")).withColumn("part", F.floor(F.col("part") / rules.fan_in))
        states = materialize(dealt.groupBy("part").applyInArrow(merge, _STATE), name)
    last = states.first()
    return kind.of_row(last) if last else None


def usable(rows: DataFrame, rules: WhitenRules, key: str, vector: str) -> DataFrame:
    """(key, vector of doubles) of the rows that are fitted and whitened."""
    bound = LARGEST / rules.scale
    found = rows.select(F.col(key), F.col(vector).cast("array<double>").alias(vector))
    found = found.filter(F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < bound)))
    most: Row | None = found.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.filter(F.size(vector) == (most["d"] if most else 0)).filter(F.size(vector) > 0)


def _integers(column: pa.Array, scale: float) -> np.ndarray:
    """(n, d) of int64, without the offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


@dataclass(frozen=True)
class Whitening:
    """n, sums (without the offset): of the fitted vectors. variances: of all components, by falling size.
    vectors: those with variance, as rows."""

    n: int
    sums: list[int]
    variances: np.ndarray
    vectors: np.ndarray

    def explained(self, components: int) -> list[float]:
        """Share of the total variance of the first components; zeros beyond those with variance."""
        whole = self.variances.sum()
        shares = [float(v / whole) if whole > 0 else 0.0 for v in self.variances[:components]]
        return shares + [0.0] * (min(components, len(self.sums)) - len(shares))

    def differences(self, block: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as int64 if that holds it, else as Python integers."""
        top = max(map(abs, self.sums)) + self.n * int(np.abs(block).max(initial=0))
        if top < 2**62:
            return self.n * block - np.array(self.sums, np.int64)
        return self.n * block.astype(object) - np.array(self.sums, object)

    def whitened(self, block: np.ndarray, components: int) -> np.ndarray:
        """(rows, components with variance, `components` at most)."""
        centred = (self.differences(block) / self.n).astype(np.float64)
        kept = self.vectors[:components]
        return centred @ (kept / np.sqrt(self.variances[: len(kept)])[:, None]).T

    def deviations(self, block: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2; None beyond a long."""
        apart = self.differences(block)
        if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 2**62:
            return (apart * apart).sum(axis=1).tolist()
        exact = (sum(int(x) ** 2 for x in row) for row in apart)
        return [x if x < 2**63 else None for x in exact]


def fit_whitening(rows: DataFrame, rules: WhitenRules, vector: str) -> Whitening | None:
    """rows: usable ones. None if there are none."""
    scale = rules.scale
    state = merged_state(states_of_tasks(rows.select(vector), Spread, lambda batches: (_integers(b.column(0), scale) for b in batches if b.num_rows), rules), Spread, rules, "whiten-states")
    if state is None:
        return None
    kept = state.values > state.values[0] * max(state.n, len(state.sums)) * np.finfo(float).eps
    # either sign is a component; the largest entry is made positive so that reruns agree
    vectors = state.vectors[kept]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.zeros(0)
    return Whitening(state.n, state.sums, np.where(kept, state.values**2 / state.n, 0.0), vectors * signs[:, None])


def whiten(rows: DataFrame, model: Whitening, rules: WhitenRules, key: str, vector: str) -> DataFrame:
    """(key, deviation, whitened: array of doubles, null beyond the components with variance). rows: usable ones."""
    kind, scale = rows.schema[key].dataType.simpleString(), rules.scale
    width = min(rules.components, len(model.sums))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _integers(batch.column(vector), scale)
            found = model.whitened(block, width).tolist()
            found = [row + [None] * (width - len(row)) for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.deviations(block), pa.int64()), pa.array(found, pa.list_(pa.float64()))], [key, "deviation", "whitened"])

    return rows.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening, rules: WhitenRules, vector: str) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    scale, components = rules.scale, rules.components
    if not len(model.vectors):
        return None
    blocks = lambda batches: (model.whitened(_integers(b.column(0), scale), components) for b in batches if b.num_rows)
    found = merged_state(states_of_tasks(rows.select(vector), Moments, blocks, rules), Moments, rules, "whiten-moments")
    return float(np.abs(found.products / found.n - np.eye(len(found.mean))).max())


def whitening_report(rows: DataFrame, rules: WhitenRules | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    rules = rules or WhitenRules()
    kind = rows.schema[key].dataType.simpleString()
    found = usable(modest_batches(rows), rules, key, vector)
    model = fit_whitening(found, rules, vector)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(x) for x in model.explained(rules.components)])
    each = whiten(found, model, rules, key, vector).select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    error = F.lit(identity_error(found, model, rules, vector)).cast("double")
    return each.select(key, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("place") + 1).alias("explained"), error.alias("identity_error"))
