"""Small helpers for functions that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Word separators of the contracts: space, tab, LF, VT, FF, CR. bytes.split() uses exactly these.
SPACES = b" \t\n\r\x0b\x0c"


#: Rows that Spark hands to Python at once, at most: texts of a few kilobytes make a few megabytes.
ROWS_AT_ONCE = 1000


def modest_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are held to ROWS_AT_ONCE, for the memory of executors and workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_AT_ONCE:
        conf.set(name, str(ROWS_AT_ONCE))
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each holds about `limit` bytes, or one row."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows or column.nbytes <= limit:
            yield batch
            continue
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(column.cast(pa.binary())).fill_null(0).to_pylist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def keep_rows(df: DataFrame, text: str, verdict: Callable[[pa.RecordBatch], pa.Array], limit: int = 1 << 20) -> DataFrame:
    """The rows of df, all columns untouched, for which verdict(batch) holds."""

    def run(batches):
        for batch in small_batches(batches, text, limit):
            yield batch.filter(verdict(batch))

    return modest_batches(df).mapInArrow(run, df.schema)
