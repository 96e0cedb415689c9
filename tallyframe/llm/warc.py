"""WARC archives: write, index, and read back by coalesced byte ranges.

Writers put gzip members, one per record, into files in the shared folder and
return an index row per record: file, offset, length, URL and digest. The
index is a written table before anything is read, so it names only files of
attempts that Spark accepted; what a lost attempt wrote is never named.

Readers take index rows sorted by file and offset, join neighbouring ranges
into one read each, cut the records out and parse them.

Payloads of at least `least_bytes` that are equal are stored once, under the
smallest page_id; the others become revisit records, which carry the HTTP head
(with the length) and the payload digest, as the format provides.

The folder may be any that pyarrow's file systems open by URI (file, s3, gs,
abfs, hdfs).

Defined results: null html is an empty payload, a null URL an empty target;
rows that share the smallest page_id of a group are all responses; a null
page_id is never the one referred to; a page of any length is one record, made and
read back by itself; extra columns are not read; empty tables give empty archives.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.arrow import modest_batches, small_batches
from tallyframe.session import materialize, scratch_path

PREFIX = "urn:x-page:"
INDEX_DDL = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class WarcRules:
    """least_bytes: of payloads stored once. file_bytes: an archive file is closed beyond.
    gap: bytes between ranges that are read along; read_bytes: most in one read; task_bytes: of archive
    that a reading task takes, about. hot_parts: payloads with more than this part of the rows, of which there are
    fewer than that, are looked up by broadcast."""

    least_bytes: int = 100
    file_bytes: int = 256 << 20
    gap: int = 64 << 10
    read_bytes: int = 8 << 20
    task_bytes: int = 32 << 20
    level: int = 6
    hot_parts: int = 1000
    date: str = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record, its payload, and the payload's declared length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    number = lambda name: None if fields.get(name, f"<{PREFIX}null>") == f"<{PREFIX}null>" else int(fields[name][len(PREFIX) + 1 : -1])
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload,
        "declared": declared,
    }


def with_decisions(pages: DataFrame, rules: WarcRules, key: str, url: str, html: str) -> DataFrame:
    """page_id, url, html, size, digest, refers_to. Only digests held by two rows or more are joined to the pages; those of
    hot payloads by broadcast, and their pages are dealt by page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    large = F.col("size") >= rules.least_bytes
    firsts = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("held")).filter("held > 1").select(F.col("digest").alias("of"), "first", "held")
    is_hot = F.col("held") * rules.hot_parts > rows.count()
    hot = firsts.filter(is_hot).select(F.col("of").alias("hot_of"), F.col("first").alias("hot_first"))
    looked = rows.join(F.broadcast(hot), (F.col("digest") == F.col("hot_of")) & large, "left")
    dealt = F.when(F.col("hot_of").isNull(), F.col("digest")).otherwise(F.concat_ws(":", F.col("page_id"), F.col("digest")))
    joined = looked.join(firsts.filter(~is_hot).select("of", "first"), (dealt == F.col("of")) & large, "left")
    first = F.coalesce("hot_first", "first")
    return joined.withColumn("refers_to", F.when(~first.eqNullSafe(F.col("page_id")), first)).drop("hot_of", "hot_first", "of", "first")


def write_archive(pages: DataFrame, rules: WarcRules | None = None, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the archive and returns its index, a written table."""
    rules = rules or WarcRules()
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in small_batches(batches, "html"):
            rows = []
            for page_id, link, text, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at > rules.file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = text.encode("utf-8") if refers_to is None else b""
                coder = zlib.compressobj(rules.level, zlib.DEFLATED, 31)
                data = coder.compress(record(page_id, link, payload, size, digest, refers_to, rules.date)) + coder.flush()
                out.write(data)
                rows.append((page_id, name, at, len(data), link, digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in INDEX_DDL.split(", ")])
        if out is not None:
            out.close()

    rows = with_decisions(modest_batches(pages), rules, key, url, html).select("page_id", "url", "html", "size", "digest", "refers_to")
    return materialize(rows.mapInArrow(write, INDEX_DDL).withColumn("folder", F.lit(folder)), "warc-index")


def coalesce_ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> list[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) rows as reads: (file, begin, end, row numbers)."""
    reads: list[list] = []
    for i, (file, offset, length) in enumerate(rows):
        end = offset + length
        if reads and reads[-1][0] == file and offset - reads[-1][2] <= gap and end - reads[-1][1] <= most:
            reads[-1][2] = max(reads[-1][2], end)
            reads[-1][3].append(i)
        else:
            reads.append([file, offset, end, [i]])
    return [tuple(r) for r in reads]


def read_archive(selected: DataFrame, rules: WarcRules | None = None, payloads: bool = True) -> DataFrame:
    """The records of selected index rows: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, and the payload (null for revisits). Ranges are
    dealt to tasks by archive bytes, in order, so neighbouring records are read together."""
    rules = rules or WarcRules()
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = [f.split()[0] for f in ddl.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def read(batches):
        import hashlib

        from pyarrow import fs

        folder, file, handle = None, None, None
        for batch in batches:
            listed = list(zip(*(batch.column(n).to_pylist() for n in ("folder", "file", "offset", "length")), strict=True))
            start = 0
            while start < len(listed):
                stop = start
                while stop < len(listed) and listed[stop][0] == listed[start][0]:
                    stop += 1
                for name, begin, end, which in coalesce_ranges([r[1:] for r in listed[start:stop]], rules.gap, rules.read_bytes):
                    if (listed[start][0], name) != (folder, file):
                        if handle is not None:
                            handle.close()
                        folder, file = listed[start][0], name
                        store, root = fs.FileSystem.from_uri(folder)
                        handle = store.open_input_file(f"{root}/{name}")
                    data, rows = handle.read_at(end - begin, begin), []
                    for i in which:
                        _, _, offset, length = listed[start + i]
                        found = parse_record(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                        kept = found["record_type"] == "response"
                        digest = hashlib.sha256(found["payload"]).hexdigest() if kept else found["digest"]
                        if kept and (digest != found["digest"] or len(found["payload"]) != found["declared"]):
                            raise ValueError(f"record of page {found['page_id']} does not hold what it declares")
                        row = (found["page_id"], found["url"], found["record_type"], found["refers_to"], found["declared"], digest)
                        rows.append(row + ((found["payload"] if kept else None),) * payloads)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                start = stop
        if handle is not None:
            handle.close()

    # adaptive execution would merge tasks by the size of index rows, but leaves a stated number alone
    tasks = selected.agg(F.ceil(F.sum("length") / rules.task_bytes)).first()[0] or 1
    dealt = selected.repartitionByRange(int(tasks), "folder", "file", "offset").sortWithinPartitions("folder", "file", "offset")
    return dealt.select("folder", "file", "offset", "length").mapInArrow(read, ddl)


def archive_round_trip(pages: DataFrame, rules: WarcRules | None = None) -> DataFrame:
    """Writes all pages to archives and reads all records back."""
    return read_archive(write_archive(pages, rules), rules, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, url
FROM f
"""
