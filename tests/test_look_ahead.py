"""Look-ahead extraction against plain Python on generated pages."""

import random
import re

from tallyframe.sources import web


def plain(html, reach):
    found = {}
    for m in re.finditer(r'"k":"([0-9]+)"', html or ""):
        near = html[m.start() : m.start() + reach]
        t = re.search(r'"t":"([^"]+)"', near)
        found.setdefault(m.group(1), t.group(1) if t else None)
    return found


def test_look_ahead_equals_plain_python(spark):
    rng = random.Random(1)
    parts = ['"k":"1"', '"k":"22"', '"k":""', '"k":"3', '"t":"x"', '"t":""', '"t":"new\nline"', "\n", "я𝒳", "filler " * 3]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    got = {}
    for r in web.look_ahead(df, "page", '"k":"([0-9]+)"', {"t": '"t":"([^"]+)"'}, 50).collect():
        got.setdefault(r.page, {})[r.id] = r.t
    assert got == {i: plain(p, 50) for i, p in enumerate(pages) if plain(p, 50)}
