from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meritpool.functions import scores, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {t}" for k, t in zip(values, [_type(v) for v in values.values()], strict=True)
    ))
    return df.select(column.alias("x")).first().x


def _type(value):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", Decimal: "decimal(20,6)"}
    return kinds.get(type(value), "string")


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("  Anna   Maria ", "anna maria"),
        ("ANNA\t \nMaria", "anna maria"),
        ("\tanna", " anna"),
        ("Ёлка  ИВАНОВА", "ёлка иванова"),
        ("a b", "a b"),
        ("", ""),
    ],
)
def test_name_key(spark, raw, key):
    assert one(spark, text.name_key(F.col("a")), a=raw) == key


def test_name_key_is_stable(spark):
    @given(st.lists(st.text(alphabet="aB \t\nЯ", max_size=12), min_size=1, max_size=20))
    @settings(max_examples=8, deadline=None)
    def check(names):
        df = spark.createDataFrame([(n,) for n in names], "a string")
        once = df.select(F.col("a"), text.name_key(F.col("a")).alias("k"))
        for r in once.collect():
            assert "  " not in r.k and "\t" not in r.k and r.k == r.k.lower()
            squeezed = " ".join(r.a.split()).lower()
            assert r.k.strip() == squeezed

    check()


@pytest.mark.parametrize(
    ("value", "shown"),
    [
        (None, "—"), (0.0, "0"), (1234567.5, "1 234 567,5"), (0.00005, "0,0001"),
        (2.00005, "2,0001"), (12.30, "12,3"), (Decimal("1000.123450"), "1 000,1235"),
        (999, "999"), (-1234.5, "-1 234,5"),
    ],
)
def test_number_text(spark, value, shown):
    got = spark.range(1).select(text.number_text(F.lit(value).cast(
        "double" if value is None else _type(value))).alias("x")).first().x
    assert got == shown.replace(" ", " ")


def test_labels(spark):
    df = spark.createDataFrame(
        [(11, "course"), (11, "practicum"), (11, "regular"), (9, "regular")], "g smallint, t string"
    )
    got = [r.x for r in df.select(text.grade_label(F.col("g"), F.col("t")).alias("x")).collect()]
    assert got == ["11 (уроки)", "11 (практикумы)", "11", "9"]
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r.x for r in df.select(text.yes_no(F.col("b")).alias("x")).collect()] == ["Да", "Нет", "Нет"]


def test_max_track_goes_by_declaration(spark):
    df = spark.createDataFrame(
        [(1, "regular"), (1, "practicum"), (2, "regular"), (2, "course"), (3, None)],
        "k int, t string",
    )
    got = df.groupBy("k").agg(scores.max_track(F.col("t")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {1: "practicum", 2: "course", 3: None}


def test_numbers_from_forms(spark):
    df = spark.createDataFrame([("",), (None,), ("2.5",), (" 3 ",), ("n/a",)], "t string")
    got = [r.n for r in df.select(scores.number_from_text(F.col("t")).alias("n")).collect()]
    assert got == [None, None, Decimal("2.5"), Decimal(3), None]


def test_guards(spark):
    df = spark.createDataFrame([(4.0, 8.0, 10.0), (4.0, 0.0, 10.0), (4.0, None, 10.0), (4.0, 8.0, None)],
                               "p double, t double, f double")
    got = df.select(
        scores.share_of(F.col("p"), F.col("t")).alias("s"),
        scores.part_of_fund(F.col("f"), F.col("p"), F.col("t")).alias("a"),
        scores.reverse_weight(F.col("t")).alias("w"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (0.5, 5.0, 0.125), (0.0, None, 0.0), (0.0, None, 0.0), (0.5, None, 0.125)
    ]


def test_search_text(spark):
    df = spark.createDataFrame([("Anna Smith",), ("Bob",)], "n string")
    assert df.where(text.contains_text(F.col("n"), "  SMITH ")).count() == 1
    assert df.where(text.contains_text(F.col("n"), "  ")).count() == 2
    assert df.where(text.contains_text(F.col("n"), None)).count() == 2
