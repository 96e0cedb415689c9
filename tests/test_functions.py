import difflib

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import quantity as Q
from tallyframe.functions import rules as R
from tallyframe.functions import similarity as S
from tallyframe.functions import text as T

QUANTITIES = [
    ("Coca-Cola 2 x 500 мл", 1000.0, "ml"),
    ("Прясно мляко 1.5 л", 1500.0, "ml"),
    ("Сирене 400 г", 400.0, "g"),
    ("Масло 250г", 250.0, "g"),
    ("Бира 6х330ml", 1980.0, "ml"),
    ("Яйца 10 бр", 10.0, "pcs"),
    ("Олио 1л", 1000.0, "ml"),
    ("Захар 2 кг", 2000.0, "g"),
    ("Вода 0,5 л", 500.0, "ml"),
    ("Продукт без количество", None, None),
]
#: The last row converts units before the ratio.
COMPATIBLE = [(500.0, "ml", 500.0, "ml", True), (500.0, "ml", 400.0, "ml", True), (500.0, "ml", 250.0, "ml", False), (500.0, "ml", 500.0, "g", False), (1000.0, "ml", 1.0, "l", True)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parse_quantity(spark):
    df = spark.createDataFrame([(q[0],) for q in QUANTITIES], "t string").select("t", Q.parse_quantity(F.col("t")).alias("q"))
    got = {r.t: (r.q.value, r.q.unit) if r.q else (None, None) for r in df.collect()}
    assert got == {t: (v, u) for t, v, u in QUANTITIES}


def test_quantities_agree(spark):
    df = spark.createDataFrame(COMPATIBLE, "a double, u string, b double, v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", Q.quantities_agree(F.col("a"), F.col("u"), F.col("b"), F.col("v")).alias("got")).collect())


@pytest.mark.parametrize(
    "text,want",
    [("Мляко 500г", "Мляко 500g"), ("Олио 1л", "Олио 1l"), ("Кафе 200 гр", "Кафе 200g"), ("Мляко 1,5 Л", "Мляко 1.5l"), ("Сирене 2 КГ", "Сирене 2kg"), ("Вода 500 мл", "Вода 500ml"), ("Хляб", "Хляб"), ("500грама захар 2 gr 3KG", "500грама захар 2g 3kg"), ("5 лимона, 1,5 литра", "5 лимона, 1.5 литра")],
)
def test_normalise_size(spark, text, want):
    assert one(spark, T.normalise_size(F.lit(text))) == want


@pytest.mark.parametrize("latin,want", [("tsh", "цх"), ("shtastie", "щастие"), ("yug", "юг"), ("zhaba", "жаба")])
def test_to_cyrillic_takes_longest_from_the_left(spark, latin, want):
    assert one(spark, T.to_cyrillic(F.lit(latin))) == want


def test_to_latin(spark):
    assert one(spark, T.to_latin(F.lit("Щастие юнак ъгъл"))) == "shtastie yunak agal"


def test_ngrams_of_short_texts(spark):
    assert one(spark, T.ngrams(F.lit("ab"))) == []
    assert one(spark, T.ngrams(F.lit("aaaa"))) == ["aaa"]


def test_names(spark):
    assert one(spark, T.normal_name(F.lit("  Кафе, «Нова»  100% "))) == "кафе нова 100"
    assert one(spark, T.without_prefix(F.lit("Nova Kafe"), F.lit("nova"))) == "Kafe"
    assert one(spark, T.scrub_with_fallback(F.lit("Promo ab"), ["promo"])) == "Promo ab"
    assert one(spark, T.slug_title(F.lit("pryasno-mlyako%21"))) == "Pryasno Mlyako!"


def test_largest_quantity_and_packs(spark):
    assert one(spark, Q.largest_quantity(F.lit("100 г или 1 кг")))["value"] == 1000.0
    assert one(spark, Q.added_packs(F.lit("Памперс 32+8 бр."))) == 40.0
    assert one(spark, Q.range_start(F.lit("Риба 250-300 г")))["value"] == 250.0


def test_discounts_round_differently(spark):
    old, new = F.lit(8.0), F.lit(5.0)
    assert [one(spark, Q.discount_percent(old, new, m)) for m in ("trunc", "round", "even", "round1")] == [37.0, 38.0, 38.0, 37.5]
    assert one(spark, Q.discount_percent(F.lit(5.0), F.lit(5.0))) is None


def test_prices(spark):
    assert one(spark, Q.parse_price(F.lit("12,38 ЛВ."))) == 12.38
    assert one(spark, Q.parse_discount(F.lit("-42%"))) == 42
    assert one(spark, Q.quantity_class(F.lit(10.0), F.lit("g"), F.lit(1.0), F.lit("kg"))) == "incompatible"
    assert one(spark, R.checked_price(F.lit(5.0), F.lit(30.0), F.lit(80.0))).asDict() == {"price": 5.0, "old_price": 0.0, "discount": 0.0, "ok": True}
    assert one(spark, R.checked_price(F.lit(150.0), F.lit(None).cast("double"), F.lit(1.0)))["ok"] is False


def test_rules(spark):
    assert one(spark, R.longest_brand(F.lit("Nescafe Gold kafe"), ["Gold", "Nescafe Gold"])) == "Nescafe Gold"
    assert one(spark, R.known_brand(F.lit(" Generic "))) is None
    assert one(spark, R.first_category(F.lit("прясно мляко"), [("b", ["хляб"]), ("dairy", ["мляко"])])) == "dairy"
    assert one(spark, R.scored_category(F.lit("aab"), [("p", ["a"]), ("q", ["ab"])]))["category"] == "q"
    assert one(spark, R.resolve_brand(F.lit("Acme x"), {}, {}, []))["method"] == "prefix"


@pytest.mark.parametrize("a,b", [("abcd", "bcde"), ("", ""), ("мляко", "млеко"), ("aaaa", "aa")])
def test_sequence_ratio(spark, a, b):
    assert one(spark, S.sequence_ratio(F.lit(a), F.lit(b))) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_brand_class(spark):
    got = [one(spark, S.brand_class(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("extra", "extra zytnia"), ("a", "ab"), (None, "x"), (None, None))]
    assert got == ["match", "reject", "one_unknown", "both_unknown"]
