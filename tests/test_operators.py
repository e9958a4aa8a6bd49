import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators import joins, merge, quality, ranking
from meritpool.operators.ids import assign_ids, highest_id
from tests.conftest import rows


def test_spread_join_is_a_join(spark):
    left = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 4).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    for how in ("inner", "left"):
        got = joins.spread_join(left, right, ["k"], how, ["n"])
        assert rows(got) == rows(left.join(right, ["k"], how))


def test_join_apart_is_a_join(spark):
    left = spark.range(300).select(F.col("id").alias("n"), (F.col("id") % 7).alias("k"))
    least = left.groupBy("k").agg(F.min("n").alias("m"))
    assert rows(left.join(joins.apart(least), "k")) == rows(left.join(least, "k"))


def test_ids_are_dense_and_repeatable(spark):
    names = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    known = spark.createDataFrame([(41,)], "id bigint")
    numbered = assign_ids(names.repartition(7), ["name"], highest_id(known))
    got = {r.name: r.id for r in numbered.collect()}
    assert sorted(got.values()) == list(range(42, 5042))
    again = assign_ids(names.repartition(3), ["name"], highest_id(known))
    assert {r.name: r.id for r in again.collect()} == got
    empty = assign_ids(names, ["name"], highest_id(known.limit(0)))
    assert empty.agg(F.min("id"), F.max("id")).first()[:] == (1, 5000)


def test_absent_rows_compare_nulls(spark):
    target = spark.createDataFrame([(1, None), (2, "a")], "k int, l string")
    new = spark.createDataFrame([(1, None, "x"), (1, "b", "y"), (1, "b", "z"), (3, None, "w")],
                                "k int, l string, v string")
    assert rows(merge.absent_rows(target, new, ["k", "l"])) == [(1, "b", "y"), (3, None, "w")]


def test_upsert(spark):
    target = spark.createDataFrame(
        [("a", 1, 10, "old"), ("b", 2, 20, "old")], "code string, n int, keep int, updated_at string"
    )
    source = spark.createDataFrame([("b", 5), ("c", 6)], "code string, n int")
    got = merge.upsert(target, source, ["code"], ["n"], F.lit("now"))
    assert rows(got) == [("a", 1, 10, "old"), ("b", 5, 20, "now"), ("c", 6, None, "now")]


def test_upsert_like_a_dictionary(spark):
    @given(
        st.dictionaries(st.integers(0, 8), st.integers(0, 3), max_size=8),
        st.dictionaries(st.integers(0, 8), st.integers(0, 3), max_size=8),
    )
    @settings(max_examples=8, deadline=None)
    def check(a, b):
        target = spark.createDataFrame(list(a.items()), "k int, v int")
        source = spark.createDataFrame(list(b.items()), "k int, v int")
        got = {r.k: r.v for r in merge.upsert(target, source, ["k"], ["v"]).collect()}
        assert got == {**a, **b}

    check()


def test_replace_slice_with_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "p int, v string")
    assert rows(merge.replace_slice(df, "p", [1], df.limit(0))) == [(2, "b"), (None, "c")]
    assert rows(merge.replace_slice(df, "p", [2], df.where("p = 2"))) == rows(df)


def test_delete_and_set_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, parent int")
    gone = spark.createDataFrame([(5,), (7,)], "id int")
    assert rows(merge.delete_keys(df, gone, {"parent": "id"})) == [(2, 6), (3, None)]
    assert rows(merge.set_null(df, gone, "parent")) == [(1, None), (2, 6), (3, None)]


def test_latest_and_top(spark):
    df = spark.createDataFrame(
        [(1, 3, "a"), (1, 5, "b"), (1, None, "c"), (2, 1, "d")], "k int, t int, id string"
    )
    assert rows(ranking.latest_by(df, ["k"], ["t", "id"])) == [(1, 5, "b"), (2, 1, "d")]
    top = ranking.top_by(df, ["k"], [F.desc_nulls_last("t"), F.desc("id")], 2)
    assert rows(top.select("k", "id", "place")) == [(1, "a", 2), (1, "b", 1), (2, "d", 1)]


# --- validity rules ---------------------------------------------------------


def teacher(spark, **changes):
    base = {"id": 1, "full_name": "A", "short_name": "a", "is_dismissed": False, "dismissed_at": None}
    values = {**base, **changes}
    schema = "id bigint, full_name string, short_name string, is_dismissed boolean, dismissed_at string"
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.withColumn("dismissed_at", F.col("dismissed_at").cast("date"))


@pytest.mark.parametrize(
    ("changes", "broken"),
    [
        ({}, []),
        ({"is_dismissed": True}, ["dismissal_dated"]),
        ({"is_dismissed": True, "dismissed_at": "2024-09-01"}, []),
        ({"is_dismissed": True, "full_name": schemas.DEPARTED_POOL}, []),
        ({"full_name": None}, ["full_name_required"]),
        ({"short_name": "x" * 151}, ["short_name_length"]),
        ({"is_dismissed": None}, ["is_dismissed_required"]),
    ],
)
def test_teacher_rules(spark, changes, broken):
    found = quality.row_violations(teacher(spark, **changes), schemas.TEACHERS)
    assert sorted(r.rule for r in found.collect()) == broken


def test_every_table_has_working_rules(spark):
    """All rules of all tables resolve and an empty table breaks none."""
    for table in schemas.ALL.values():
        empty = spark.createDataFrame([], table.struct)
        key = table.columns[0].name
        assert quality.row_violations(empty, table, key).count() == 0
        if table.unique:
            assert quality.unique_violations(empty, table).count() == 0
    assert sum(len(t.checks) for t in schemas.ALL.values()) >= 29


def test_number_rules(spark):
    df = spark.createDataFrame([(1, "-1", "0", 101), (2, "1", None, 100)],
                               "id int, total_fund string, uvsotr_value string, x int")
    df = df.withColumns({c: F.col(c).cast("decimal(14,2)") for c in ("total_fund", "uvsotr_value")})
    found = quality.row_violations(df, schemas.SETTINGS, kinds=("checks",))
    assert rows(found.select("rule", "row_key")) == [("total_fund_not_negative", "1")]


def test_unique_ignores_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, code string")
    got = quality.unique_violations(df, schemas.CRITERIA).collect()
    assert [(r.rule, r.row_key, r.n_rows) for r in got] == [("code_unique", "a", 2)]


def test_cascade_follows_each_reference(spark):
    periods = spark.createDataFrame([(1,)], "id bigint")
    results = spark.createDataFrame([(1, 1, 5), (2, 2, 6)],
                                    "id bigint, academic_period_id bigint, student_enrollment_id bigint")
    left = quality.cascade(periods, [(schemas.RESULTS, results)], schemas.PERIODS)
    assert rows(left["student_results"]) == [(2, 2, 6)]
    gone = spark.createDataFrame([(6,)], "id bigint")
    left = quality.cascade(gone, [(schemas.RESULTS, results)], schemas.ENROLLMENTS)
    assert rows(left["student_results"]) == [(1, 1, 5), (2, 2, None)]


def test_restrict(spark):
    gone = spark.createDataFrame([(5,), (9,)], "id bigint")
    links = spark.createDataFrame([(1, 5), (2, 5)], "student_result_id bigint, teacher_id bigint")
    found = quality.restrict_violations(gone, [(schemas.LINKS, links)], schemas.TEACHERS)
    assert [(r.rule, r.row_key) for r in found.collect()] == [
        ("used_by_student_result_teacher_links", "5")
    ]


def test_defaults_and_generated(spark):
    df = spark.createDataFrame([(1, " A  b ")], "id bigint, full_name string")
    got = quality.conform(df, schemas.STUDENTS).first()
    assert (got.is_active, got.full_name_normalized) == (True, "a b")
    assert got.created_at is not None and got.birth_date is None


def test_precision_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([("1.00005",), ("-1.00005",), ("123456789.1",)], "base_score string")
    df = df.withColumn("id", F.lit(1))
    found = quality.row_violations(df, schemas.CRITERIA, kinds=("precision",))
    assert found.count() == 1
    cast = df.select(F.col("base_score").try_cast("decimal(12,4)").alias("x")).collect()
    assert [str(r.x) for r in cast] == ["1.0001", "-1.0001", "None"]
