"""Scans of a paged service that stop, go on and meet new pages."""

import os

import pytest

from tallyframe.session import scratch_path
from tallyframe.sources.files import scan_pages

LOG = "/tmp/tallyframe-test-pages"


def fetch(page):
    """Three rows a page, the last of them again in the next; page numbers are logged. Fails while a file says so."""
    if os.path.exists(f"{LOG}-broken-{page}"):
        raise OSError("service is away")
    with open(f"{LOG}-read", "a") as f:
        f.write(f"{page}\n")
    return [(str(page * 2 + i), f"page {page}", page) for i in range(3)]


def pages_now():
    return int(open(f"{LOG}-count").read())


def read():
    return sorted(int(x) for x in open(f"{LOG}-read").read().split())


@pytest.fixture(autouse=True)
def service():
    for name in ("read", "count"):
        with open(f"{LOG}-{name}", "w") as f:
            f.write("5" if name == "count" else "")
    yield
    for name in ("read", "count", "broken-4"):
        if os.path.exists(f"{LOG}-{name}"):
            os.remove(f"{LOG}-{name}")


OPTIONS = {"fetch": "tests.test_paged_stream:fetch", "pages_now": "tests.test_paged_stream:pages_now", "ddl": "id string, body string, page int", "pages_per_batch": "2"}


def told(df):
    return {r.id: r.body for r in df.collect()}


def want(pages):
    return {str(i): f"page {min(i // 2, pages - 1)}" for i in range(pages * 2 + 1)}


def test_scan_that_fails_goes_on_from_its_last_batch(spark):
    path = scratch_path(spark, "paged")
    with open(f"{LOG}-broken-4", "w"):
        pass
    with pytest.raises(Exception, match="service is away"):
        scan_pages(spark, path, ["page"], "id", **OPTIONS)
    assert read() == [0, 1, 2, 3]
    os.remove(f"{LOG}-broken-4")
    found = scan_pages(spark, path, ["page"], "id", **OPTIONS)
    assert told(found) == want(5) and set(found.columns) == {"id", "body", "page"}
    assert read() == [0, 1, 2, 3, 4]


def test_repeated_scan_reads_new_pages_only(spark):
    path = scratch_path(spark, "paged")
    assert told(scan_pages(spark, path, ["page"], "id", **OPTIONS)) == want(5)
    assert told(scan_pages(spark, path, ["page"], "id", **OPTIONS)) == want(5)
    with open(f"{LOG}-count", "w") as f:
        f.write("8")
    assert told(scan_pages(spark, path, ["page"], "id", **OPTIONS)) == want(8)
    assert read() == list(range(8))


def test_fixed_number_of_pages_in_one_batch(spark):
    options = {k: v for k, v in OPTIONS.items() if k not in ("pages_now", "pages_per_batch")}
    path = scratch_path(spark, "paged")
    assert told(scan_pages(spark, path, ["page"], "id", **options, pages="3")) == want(3)
    assert [r.batch for r in spark.read.parquet(f"{path}/rows").select("batch").distinct().collect()] == [0]
