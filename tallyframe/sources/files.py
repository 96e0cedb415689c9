"""File sources and sinks: listings as JSON, CSV, XML and JSON lines, documents for serving, indexes, archives."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyframe.operators.relational import keep_first, last_values

#: All spellings of a listing's fields, so that one schema reads every feed.
LISTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "fullTitle", "title", "product_id", "internal_code", "product_url", "store_product_url", "image_url", "image", "quantity", "brand", "store", "sku")]
    + [T.StructField(n, T.DoubleType()) for n in ("price_eur", "price", "price_bgn", "priceSecond", "old_price_eur", "oldPrice", "old_price_bgn", "oldPriceSecond", "discount_pct", "discount")]
)


def read_listings(spark: SparkSession, path: str | list[str], schema: T.StructType = LISTING) -> DataFrame:
    """JSON arrays of listings with the file each row came from and its place there (a file is read in one piece, so that
    the numbers of its rows grow in their order)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_row", F.monotonically_increasing_id())


def _first(*names: str) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def unify_listings(raw: DataFrame, bgn_per_eur: float = 1.95583) -> DataFrame:
    """One name per field; prices in euro, converted from leva where only those are given."""
    number = lambda *n: F.coalesce(*[F.nullif(F.col(x), F.lit(0.0)) for x in n])
    euro = F.coalesce(number("price_eur", "price"), F.round(number("price_bgn", "priceSecond") / bgn_per_eur, 2))
    old = F.coalesce(number("old_price_eur", "oldPrice"), F.round(number("old_price_bgn", "oldPriceSecond") / bgn_per_eur, 2))
    name = _first("name", "fullTitle", "title")
    return raw.select(
        F.coalesce(_first("sku", "product_id", "internal_code"), F.hex(F.xxhash64(name))).alias("sku"), name.alias("name"), "store", _first("brand").alias("brand"), euro.alias("price"), old.alias("old_price"),
        F.coalesce("discount_pct", "discount").alias("discount"), _first("quantity").alias("quantity"), _first("product_url", "store_product_url").alias("url"), _first("image_url", "image").alias("image"),
        *[c for c in ("source_file", "source_row") if c in raw.columns],
    )


def accepted(listings: DataFrame, most: float = 10_000.0, least: float = 0.0) -> DataFrame:
    """Rows with a name and a plausible price: over 0, from `least` to `most`."""
    return listings.filter(F.col("name").isNotNull() & (F.col("price") > 0) & (F.col("price") >= least) & (F.col("price") <= most))


def newest_only(rows: DataFrame, pattern: str = r"(.+)_(\d{8})\.json", file: str = "source_file") -> DataFrame:
    """Rows of the newest dated file of each store."""
    dated = rows.withColumn("_store", F.regexp_extract(file, pattern, 1)).withColumn("_date", F.regexp_extract(file, pattern, 2))
    latest = dated.groupBy("_store").agg(F.max("_date").alias("_latest"))
    return dated.join(latest, "_store").filter("_date = _latest").drop("_store", "_date", "_latest")


def first_by_file(rows: DataFrame, key: str, file: str = "source_file", place: str = "source_row") -> DataFrame:
    """The first row of each key in file order, then by its place in the file."""
    return keep_first(rows, [key], [file, place])


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists, by the file system that Spark would read it with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def read_sitemap(spark: SparkSession, path: str, part: str = "/p/") -> DataFrame:
    """URLs of a sitemap (gzip or plain XML) that contain a part."""
    schema = "loc string, lastmod string"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).filter(F.contains("loc", F.lit(part)))


class PagedSource(DataSource):
    """Rows of a paged service: options `pages` (count) and `fetch` (module:function of a page number, giving tuples), or
    `total`, `fetchsize` and a function of offset and size; every page is a partition. Registered by register_paged()."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("ddl", "id string, body string")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.size, self.total = options["fetch"], int(options.get("fetchsize", 0)), int(options.get("total", 0))
        self.pages = -(-self.total // self.size) if self.size else int(options.get("pages", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = partition.value
        arguments = (at * self.size, min(self.size, self.total - at * self.size)) if self.size else (at,)
        yield from _named(self.fetch)(*arguments)


class _PagedStream(DataSourceStreamReader):
    """Pages as a stream whose offset is the number of pages read. Batches take `pages_per_batch` pages (0: all there are), so that a
    scan that stops goes on after its last batch. `pages_now` (module:function) asks the service anew how many pages it has;
    without it the batch options hold. The page counted last is taken for full: it is not read again when it grows."""

    def __init__(self, options: dict):
        self.pages, self.step, self.now, self.done = _PagedReader(options), int(options.get("pages_per_batch", 0)), options.get("pages_now"), 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there = _named(self.now)() if self.now else self.pages.pages
        return {"page": max(self.done, min(there, self.done + self.step) if self.step else there)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Also called with the offset to go on from, when a query starts again."""
        self.done = max(self.done, end["page"])
        return [InputPartition(i) for i in range(start["page"], end["page"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.pages.read(partition)


def _named(name: str) -> Callable:
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def register_paged(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def scan_pages(spark: SparkSession, path: str, order: list[str], key: str, **options: str) -> DataFrame:
    """Scans a paged service to its end and returns the last row of each key, by batch and then by `order`. Batches are kept below
    path/rows and progress in path/state: a scan that was stopped, or one that is repeated after the service has grown, reads only
    pages that no finished batch holds, and a batch that is run again replaces its rows."""
    register_paged(spark)
    stream = spark.readStream.format("paged").options(**options).load()
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state")
    query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return latest_pages(spark.read.parquet(f"{path}/rows"), key, ["batch", *order]).drop("batch")


def write_document(products: DataFrame, groups: DataFrame, path: str, meta: dict[str, str]) -> None:
    """The served document in its three parts, meta, products and groups, as JSON lines in folders of these names: a
    document of any size is written by many tasks, and readers take the parts they need."""
    about = products.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
    for name, part in (("meta", about), ("products", products), ("groups", groups)):
        part.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def read_with_results(spark: SparkSession, folder: str, results: DataFrame, pattern: str = "*", name: str = "file_name") -> DataFrame:
    """Files of a folder (path, modificationTime, length, not their content) with what was read out of each elsewhere
    (results: file_name and more columns); files without results have nulls there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")
    return files.withColumn(name, F.element_at(F.split("path", "/"), -1)).join(results, name, "left")


def latest_pages(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows that several pages repeat, the last one."""
    return last_values(rows, [key], order, [c for c in rows.columns if c != key])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def archive_json_lines(old: DataFrame, path: str) -> None:
    """Appends rows that leave a table to an archive of JSON lines."""
    old.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """All rows or none: Spark commits the files of a job together."""
    df.write.mode("append").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """An inverted index in its exploded form, files by token range."""
    postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON object of settings, read by Spark from wherever it is."""
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def override(rows: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of another table win where they are neither null nor empty (extractions computed elsewhere)."""
    new = better.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(f"_new_{c}").cast("string"), F.lit("")).cast(rows.schema[c].dataType), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def enrich_from_cache(rows: DataFrame, cache: DataFrame, key: str, as_of: Column, retry_seconds: int = 3600) -> DataFrame:
    """rows with `state`: hit, failed (within the retry time) or miss. cache: key, ok, fetched_at, payload."""
    joined = rows.join(cache, key, "left")
    age = as_of.cast("long") - F.col("fetched_at").cast("long")
    state = F.when(F.col("ok"), "hit").when(F.col("ok").isNotNull() & (age < retry_seconds), "failed").otherwise("miss")
    return joined.withColumn("state", state)


def admitted(rows: DataFrame, least: dict[str, int], store: str = "store") -> DataFrame:
    """Per store: rows, share with a price, whether enough came, whether under half is priced."""
    table = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    counted = rows.groupBy(store).agg(F.count("*").alias("n_rows"), (F.count_if(F.col("price") > 0) / F.count("*")).alias("priced"))
    return counted.withColumn("admitted", F.col("n_rows") >= F.coalesce(F.try_element_at(table, F.col(store)), F.lit(1))).withColumn("warned", F.col("priced") < 0.5)


def positions_before(values: DataFrame, key: str, is_id: Column, back: int = 99) -> DataFrame:
    """Each value of a flat array with the nearest preceding id within `back` positions."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-back, -1)
    return values.withColumn("id", F.last(F.when(is_id & (F.col("pos") > 0), F.col("value")), ignorenulls=True).over(w))


Fetch = Callable[[int], Iterator[tuple]]
