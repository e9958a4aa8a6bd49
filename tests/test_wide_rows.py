"""What goes through the exchanges of plans that once shuffled whole rows again and again."""

import re

from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.operators.deletes import deletion
from meritpool.operators.ids import assign_ids
from meritpool.operators.joins import once_by
from meritpool.operators.quality import reference_violations
from meritpool.plans import changes as ch
from tests.conftest import rows
from tests.test_changes import CHANGES, RESULTS


def shuffled(df):
    """The columns that each exchange of the plan takes in."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_a_batch_is_dealt_out_once(spark):
    """Look-ups take out the keys they need, not the payload of the change."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    payload = ("regular", "", "v", "", "note")
    changes = [(1, "create", None, 1, 1, 9, *payload), (2, "update", 5, 2, 1, 9, *payload), (3, "update", 6, 9, 1, 9, *payload)]
    empty = spark.createDataFrame([], RESULTS)
    people = spark.range(1, 3)
    criteria = spark.range(1, 3).withColumn("base_score", F.lit(1).cast("decimal(12,4)"))
    places = people.select(F.col("id"), F.col("id").alias("student_id"), F.col("id").alias("academic_period_id"),
                           F.lit(9).cast("smallint").alias("grade"), F.lit("regular").alias("grade_track"))
    periods = people.withColumn("name", F.lit("now"))
    batch = ch.ChangeBatch(
        spark.createDataFrame(changes, CHANGES), empty, people, criteria, places, periods.where("id = 1"), "now",
        with_ids=lambda new: new.withColumn("id", F.col("change_id")),
    )
    got = batch.rejected
    inputs = shuffled(got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert inputs and not any("comment#" in x for x in inputs), inputs
    assert sorted((r.change_id, r.rules) for r in got.collect()) == [(2, ["result_known"]), (3, ["student_known", "result_known"])]


def test_groups_by_the_key_need_no_second_exchange(spark):
    df = spark.range(100).withColumn("k", F.coalesce(F.col("id") % 7, F.lit(0)))
    dealt = once_by(df, "k")
    counted = dealt.groupBy("k").agg(F.count("*").alias("n"))
    assert len(shuffled(counted)) == 1
    assert rows(dealt.select("id", "k")) == rows(df)


def test_ids_are_given_from_one_exchange(spark):
    """Sizes of buckets and rows: the second reader uses what the first has shuffled."""
    new = spark.range(1000).select(F.col("id").alias("name"), F.lit("x").alias("other"))
    numbered = assign_ids(new, ["name"], F.lit(5))
    numbered.write.format("noop").mode("overwrite").save()
    got = numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert sorted(r.id for r in got) == list(range(6, 1006)) and {r.other for r in got} == {"x"}


def test_rows_that_name_one_of_few_parents_are_dealt_out(spark):
    """A reference to a table of few rows has nothing but hot keys."""
    rows_of = spark.range(300).select(
        F.col("id"), (F.col("id") % 3).alias("academic_period_id"), F.lit(1).cast("bigint").alias("student_id")
    )
    periods = spark.range(2)
    found = reference_violations(rows_of, schemas.RESULTS, {"academic_periods": periods})
    assert "_salt" in found._jdf.queryExecution().toString()
    assert sorted(int(r.row_key) for r in found.collect()) == list(range(2, 300, 3))


def test_rows_that_name_one_of_few_deleted_ids_are_dealt_out(spark):
    results = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("academic_period_id"))
    for ids in (spark.range(1), spark.range(20_000).select((F.col("id") * 3).alias("id"))):
        left = deletion({"academic_periods": spark.range(3), "student_results": results}, {"academic_periods": ids}).after["student_results"]
        assert "_salt" in left._jdf.queryExecution().toString()
        assert sorted(r.id for r in left.collect()) == [i for i in range(300) if i % 3]
