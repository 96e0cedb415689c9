"""Price versions as a table in buckets of keys: a batch reads and writes the current versions of the buckets that it
touches, and appends the versions that it closes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KNOWN, NEW = 0, 1


@dataclass(frozen=True)
class VersionTable:
    """A table of versions below `path`, in parts that are never changed once they are committed:

    * current/version=N/bucket=B: the current versions of a bucket that merge N touched, with the key's last observation;
    * closed/version=N: versions that merge N closed; outcomes/version=N: what became of each of its observations;
    * heads/version=N: for each bucket the merge that wrote it last, and which batches have been merged. It is written last and
      commits the merge: what a failed merge left behind is not read, and is overwritten by the next one.

    An observation begins a version if its value differs by `least` or more from the key's observation before, in the order
    of (at, tie), whatever batch that came in. Observations at or before the key's last one of an earlier batch are late: they are told
    in the outcomes and change nothing. Rows without a value or time are no observations and are left out; null keys are keys. Rows that repeat
    (at, tie) of another of their batch are observations too, in an order that is not defined. Columns other than keys, at, tie
    and value are not kept. One merge runs at a time.
    """

    path: str
    keys: tuple[str, ...]
    value: str
    at: str
    tie: str
    least: Any = 0.01
    spike: float = 1.0
    buckets: int = 256

    def __post_init__(self):
        clash = {*self.keys, self.value, self.at, self.tie} & {"version", "bucket", "kind", "known", "outcome", "spike", "version_row", "valid_from", "valid_to", "last_seen", "last_value"}
        if clash:
            raise ValueError(f"names that the table needs itself: {sorted(clash)}")

    def _fs(self, spark: SparkSession, part: str = ""):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, spark: SparkSession) -> int:
        """The last committed version, -1 before the first."""
        folder, fs = self._fs(spark, "heads")
        if not fs.exists(folder):
            return -1
        found = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
        committed = [n for n in found if fs.exists(self._fs(spark, f"heads/version={n}/_SUCCESS")[0])]
        return max(committed, default=-1)

    def _heads(self, spark: SparkSession, version: int) -> tuple[dict[int, int], dict[str, int]]:
        """Version of each bucket (at most `buckets`), and the last batch of each writer."""
        if version < 0:
            return {}, {}
        rows = spark.read.parquet(f"{self.path}/heads/version={version}").collect()
        return {r.bucket: r.number for r in rows if r.writer is None}, {r.writer: r.number for r in rows if r.writer is not None}

    def _current(self, spark: SparkSession, heads: dict[int, int], like: DataFrame) -> DataFrame:
        """Current versions of the buckets of heads; with none, an empty table of the shape of observations `like`."""
        if heads:
            return spark.read.option("basePath", f"{self.path}/current").parquet(*[f"{self.path}/current/version={v}/bucket={b}" for b, v in heads.items()]).drop("version", "bucket")
        return like.select(*self.keys, self.value, F.col(self.at).alias("valid_from"), F.struct(self.at, self.tie).alias("last_seen"), F.col(self.value).alias("last_value")).limit(0)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int, writer: str = "batches") -> int:
        """Merges a batch and returns the version that holds it. A batch whose number its writer has already merged is a repeat
        and changes nothing, so that a stream that starts again after a failure merges each batch once. A stream with a new
        checkpoint counts from 0 and takes another name as writer."""
        spark = batch.sparkSession
        last = self.version(spark)
        heads, merged = self._heads(spark, last)
        if number <= merged.get(writer, -1):
            return last
        now = last + 1
        seen = batch.select(*self.keys, self.at, self.tie, self.value).filter(F.col(self.value).isNotNull() & F.col(self.at).isNotNull())
        touched = [r.bucket for r in seen.select(self._bucket().alias("bucket")).distinct().collect()]  # at most `buckets`
        judged = self._judged(seen, self._current(spark, {b: heads[b] for b in touched if b in heads}, seen))

        place = f"{self.path}/judged/version={now}"
        judged.write.mode("overwrite").parquet(place)  # read for three outputs
        judged = spark.read.schema(judged.schema).parquet(place)
        versions = judged.filter("version_row")
        current = versions.filter("valid_to IS NULL").select(*self.keys, self.value, "valid_from", "last_seen", "last_value").withColumn("bucket", self._bucket())
        current.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/current/version={now}")
        versions.filter("valid_to IS NOT NULL").select(*self.keys, self.value, "valid_from", "valid_to").write.mode("overwrite").parquet(f"{self.path}/closed/version={now}")
        judged.filter(F.col("kind") == NEW).select(*self.keys, self.at, self.tie, self.value, "known", "outcome", "spike").write.mode("overwrite").parquet(f"{self.path}/outcomes/version={now}")

        heads |= {b: now for b in touched}
        merged |= {writer: number}
        rows = [(b, v, None) for b, v in heads.items()] + [(None, n, w) for w, n in merged.items()]
        spark.createDataFrame(rows, "bucket int, number long, writer string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/version={now}")
        folder, fs = self._fs(spark, f"judged/version={now}")
        fs.delete(folder, True)
        return now

    def _judged(self, seen: DataFrame, current: DataFrame) -> DataFrame:
        """Observations and the versions known before them, in one window per key."""
        known = current.select(*self.keys, F.col(f"last_seen.{self.at}").alias(self.at), F.col(f"last_seen.{self.tie}").alias(self.tie), F.col("last_value").alias(self.value), F.lit(KNOWN).alias("kind"), F.col(self.value).alias("_value"), F.col("valid_from").alias("_from"))
        rows = known.unionByName(seen.withColumn("kind", F.lit(NEW)), allowMissingColumns=True)
        key = Window.partitionBy(*self.keys)
        order = key.orderBy("_late", self.at, self.tie, "kind")
        place = F.struct(self.at, self.tie)
        end = F.max(F.when(F.col("kind") == KNOWN, place)).over(key)
        rows = rows.withColumn("_end", end).withColumn("_late", F.coalesce((F.col("kind") == NEW) & (place <= F.col("_end")), F.lit(False)))
        before = F.lag(self.value).over(order)
        rows = rows.withColumn("known", F.when(~F.col("_late"), before))
        change = F.col(self.value) - F.col("known")
        begins = (F.col("kind") == NEW) & ~F.col("_late") & (F.col("known").isNull() | (F.abs(change) >= self.least))
        outcome = F.when(F.col("_late"), "late").when(F.col("known").isNull(), "new").when(F.abs(change) < self.least, "unchanged").when(change > 0, "increase").otherwise("decrease")
        rows = rows.withColumn("version_row", (F.col("kind") == KNOWN) | begins).withColumn("outcome", outcome)
        rows = rows.withColumn("spike", F.coalesce(F.abs(change) > self.spike * F.col("known"), F.lit(False)))
        later = key.orderBy(*[F.col(c).desc() for c in ("_late", self.at, self.tie, "kind")]).rowsBetween(Window.unboundedPreceding, -1)
        upon = F.when(~F.col("_late"), place)
        rows = rows.withColumns({
            "valid_to": F.last(F.when(F.col("version_row") & ~F.col("_late"), F.col(self.at)), ignorenulls=True).over(later),
            "last_seen": F.max(upon).over(key),
            "last_value": F.max_by(F.col(self.value), upon).over(key),
            "valid_from": F.when(F.col("kind") == KNOWN, F.col("_from")).otherwise(F.col(self.at)),
        })
        held = F.when(F.col("kind") == KNOWN, F.col("_value")).otherwise(F.col(self.value))
        return rows.withColumn(self.value, held).drop("_value", "_from", "_end", "_late")

    def versions(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All versions as of a committed merge, by default the last: keys, value, valid_from, valid_to (null: current)."""
        last = self.version(spark) if version is None else version
        if last < 0:
            raise ValueError(f"nothing has been merged into {self.path}")
        columns = [*self.keys, self.value, "valid_from", "valid_to"]
        closed = spark.read.parquet(f"{self.path}/closed").filter(F.col("version") <= last).select(*columns)
        return closed.unionByName(self.current(spark, last).withColumn("valid_to", F.lit(None).cast(closed.schema["valid_to"].dataType)).select(*columns))

    def current(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Current versions as of a merge, with each key's last observation."""
        last = self.version(spark) if version is None else version
        heads, _ = self._heads(spark, last)
        closed = spark.read.parquet(f"{self.path}/closed/version={last}")
        like = closed.withColumns({self.at: F.col("valid_from"), self.tie: F.lit(None)}) if not heads else closed
        return self._current(spark, heads, like)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """What became of each observation, with the version it came in."""
        return spark.read.parquet(f"{self.path}/outcomes").filter(F.col("version") <= self.version(spark))

    def step(self, writer: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch step."""
        return lambda batch, number: (self.merge(batch, number, writer), None)[1]

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Removes current parts that none of the last `keep` versions reads, with the heads of older ones, which can then no longer be
        read; closed versions and outcomes stay. Returns the number of parts removed."""
        last = self.version(spark)
        kept = range(max(0, last - keep + 1), last + 1)
        used = {(v, b) for n in kept for b, v in self._heads(spark, n)[0].items()}
        folder, fs = self._fs(spark, "current")
        removed = 0
        for held in fs.listStatus(folder) if fs.exists(folder) else []:
            number = int(held.getPath().getName().partition("=")[2])
            for part in fs.listStatus(held.getPath()) if number <= last else []:
                name = part.getPath().getName()
                if name.startswith("bucket=") and (number, int(name.partition("=")[2])) not in used:
                    fs.delete(part.getPath(), True)
                    removed += 1
        for n in range(kept.start):
            fs.delete(self._fs(spark, f"heads/version={n}")[0], True)
        return removed
