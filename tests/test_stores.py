"""Names of the stores against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import stores

CASES = [
    ("Billa", "King оферта - Супер цена - Мляко 1 л", "Мляко 1 л"),
    ("Billa", "king  оферта-само с BILLA card -Сирене Billa", "Сирене"),
    ("Billa", "King оферта - Домати за 1 кг", "Домати"),
    ("Billa", "Супер цена – Кашкавал За 100г", "Кашкавал"),
    ("Billa", "Ново в Billa - Супер цена - Хляб", "Супер цена - Хляб"),  # each phrase once, in the order of the table
    ("Billa", "-30% - Кафе", "Кафе"),
    ("Billa", "30%- Кафе", "30%- Кафе"),
    ("Billa", "30% - Кафе", "Кафе"),
    ("Billa", "Промо - Бира до 6 бр. на клиент и още", "Бира"),
    ("Billa", "Ябълки Произход - България", "Ябълки"),
    ("Billa", "Баница от Billa пекарна, топла", "Баница"),
    ("Billa", "Шунка от  деликатесната витрина", "Шунка"),
    ("Billa", "Краставици за 1 бр.", "Краставици"),
    ("Billa", "Сок | LIDL", "Сок | LIDL"),
    ("Lidl", "Сок  портокал |LIDL ", "Сок портокал"),
    ("Lidl", "Супер цена - Сок", "Супер цена - Сок"),
    ("Kaufland", "Кифла от нашата пекарна", "Кифла"),
    ("Kaufland", "Салам от деликатеснат", "Салам"),
    ("Kaufland", "Салам от свежата витр", "Салам"),
    ("Kaufland", "King оферта - Нещо друго - Ориз", "Ориз"),
    ("Kaufland", "Продукт, маркиран с синя звезда - 5 Ориз", "Ориз"),
    ("Kaufland", "Чай **валидно до петък** 01.02.2025 избрани видове", "Чай"),
    ("Kaufland", "Чай различни вкусове", "Чай"),
    ("Kaufland", "Картофи до 5кг на покупка", "Картофи"),
    ("Kaufland", "Грозде Произход Гърция, клас 1", "Грозде Произход Гърция, клас 1"),
    ("Kaufland", "Грозде Произход Гърция", "Грозде"),
    (None, "Сок | Lidl", "Сок"),
    ("Billa", "", ""),
    ("Billa", None, None),
]
BULK = [("Домати ЗА 1 кг ", (1000, "g")), ("Ябълка за 1 бр", (1, "бр")), ("Ябълка за 1 бр.", (1, "бр")), ("Сирене за 100г", (100, "g")), ("Сирене за 1кг", None), ("за 1 кг домати", None), (None, None)]


def test_names_of_stores(spark):
    df = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(CASES)], "i int, store string, name string")
    got = [r[0] for r in df.orderBy("i").select(stores.store_name(F.col("name"), F.col("store"))).collect()]
    assert got == [w for _, _, w in CASES]


def test_bulk_sizes(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(BULK)], "i int, name string")
    got = [tuple(r[0]) if r[0] else None for r in df.orderBy("i").select(stores.bulk_size(F.col("name"))).collect()]
    assert got == [w for _, w in BULK]


@pytest.mark.parametrize("words,text", [("супер цена", "супер \t цена"), ("a - b c", "a-b  c")])
def test_phrases(spark, words, text):
    import re

    assert re.fullmatch(stores.phrase(words), text)
