"""Physical plans: what is read, shuffled and computed once."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from meritpool.catalog.oracle import ORACLE
from meritpool.catalog.queries import QUERIES
from meritpool.operators.joins import apart
from meritpool.operators.ranking import top_by
from meritpool.plans import reports as rp
from meritpool.plans import summary as su
from meritpool.sources import writers as wr
from meritpool.sources.tables import Tables
from tests.conftest import SMALL


def plan_of(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    """The tables as they lie at scale: Parquet, facts by period."""
    root = str(tmp_path_factory.mktemp("stored"))
    by_period = ["academic_period_id"]
    for name, parts in {"assignments": by_period, "results": by_period, "teachers": [],
                        "periods": [], "settings": [], "students": [], "criteria": []}.items():
        wr.append(getattr(star, name), f"{root}/{name}", parts)

    def read(name):
        df = getattr(star, name)
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return Tables(**{n: read(n) for n in
                     ("assignments", "results", "teachers", "periods", "settings", "students", "criteria")})


@pytest.fixture()
def no_broadcast(spark):
    """Tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_are_read_once(stored, no_broadcast):
    plan = plan_of(su.teacher_summary(stored), run=True)
    for table in ("assignments", "results"):
        assert len(re.findall(rf"FileScan.*stored\d*/{table}\b", plan)) == 1, plan
    assert "ReusedExchange" in plan


def test_period_filter_prunes_folders(stored):
    plan = plan_of(su.teacher_summary(stored, periods=[1997]))
    scans = [line for line in plan.splitlines() if "FileScan" in line and
             re.search(r"/(assignments|results)\b", line)]
    assert scans and all(re.search(r"PartitionFilters: \[.*academic_period_id.*1997", x) for x in scans)


def test_scans_are_narrow(stored):
    plan = plan_of(su.teacher_summary(stored))
    line = next(x for x in plan.splitlines() if "FileScan" in x and "/results" in x)
    schema = re.search(r"ReadSchema: struct<(.*?)>", line).group(1)
    columns = {c.split(":")[0] for c in re.split(r",(?![^(]*\))", schema)}
    assert columns == {"student_id", "grade_at_result", "grade_track", "total_score"}


def test_results_are_added_up_before_the_join(stored, no_broadcast):
    plan = plan_of(su.teacher_summary(stored))
    join = plan.index("SortMergeJoin [academic_period_id")
    assert "partial_sum(total_score" in plan[join:]


def test_newest_rows_are_cut_in_the_tasks(stored):
    assert "TakeOrderedAndProject" in plan_of(rp.newest(stored.results))


def test_top_rows_are_cut_before_the_shuffle(stored):
    df = top_by(stored.results, ["student_id"], [F.desc("id")], 3)
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_search_text_reaches_no_python(spark):
    """No query runs Python, a cross join or a nested loop over tables."""
    for name, build in QUERIES.items():
        plan = plan_of(build(spark, SMALL))
        for word in ("Python", "Cartesian", "NestedLoop"):
            assert word not in plan, (name, word)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def test_no_job_runs_while_a_query_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    for name, build in QUERIES.items():
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        build(spark, SMALL)
        assert list(tracker.getJobIdsForGroup(f"build-{name}")) == [], name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_hot_result_of_a_batch_is_split(spark, no_broadcast):
    """Edits of one result meet an aggregate that has an exchange of its own."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    edits = spark.range(200_000, numPartitions=8).select(
        F.col("id").alias("change_id"),
        F.when(F.col("id") % 4 != 0, F.lit(7)).otherwise(F.col("id")).alias("result_id"),
    )
    targets = apart(edits.groupBy("result_id").agg(F.min("change_id").alias("deleted_at")))
    plan = plan_of(edits.join(targets, "result_id", "left"), run=True)
    for key in settings:
        spark.conf.unset(key)
    assert "skew=true" in plan, plan


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == su.SUMMARY_COLUMNS
    assert df.count() == 70


def test_summary_of_stored_tables_is_the_same(stored, star):
    def rounded(df):
        return sorted(
            (r.academic_period, r.teacher_name, r.total_student_count, float(r.raw_points),
             round(r.employee_share, 9)) for r in df.collect()
        )

    assert rounded(su.teacher_summary(stored)) == rounded(su.teacher_summary(star))


def test_periods_of_the_whole_and_of_one(stored):
    whole = su.teacher_summary(stored).where("academic_period = '1997'")
    one = su.teacher_summary(stored, periods=[1997])
    pick = ["teacher_name", "student_count_with_results", F.round("employee_share", 9).alias("e")]
    assert whole.select(*pick).exceptAll(one.select(*pick)).count() == 0
    assert whole.count() == one.count()


def test_missing_teacher_still_counts_in_totals(stored):
    """The totals are taken before names are joined."""
    without = replace(stored, teachers=stored.teachers.where("id <> 3"))
    got = su.teacher_summary(without)
    assert got.count() == 63
    all_weights = su.teacher_summary(stored).select("total_reverse_weight").distinct().count()
    assert got.select("total_reverse_weight").distinct().count() == all_weights


def test_a_batch_of_changes_is_read_once(spark, no_broadcast, tmp_path):
    """However many parts of the plan read it: the exchange behind it is filled once."""
    from pyspark.sql import functions as F

    from meritpool.plans import changes as ch
    from meritpool.sources.starschema import StarSchema

    star = StarSchema(spark, SMALL)
    star.changes.write.parquet(str(tmp_path / "changes"))
    batch = ch.ChangeBatch(
        spark.read.schema(star.changes.schema).parquet(str(tmp_path / "changes")), star.results, star.students,
        star.criteria, star.enrollments, star.periods, "1998",
        with_ids=lambda rows: rows.withColumn("id", F.concat(F.lit("new-"), "change_id")),
    )
    for output, most in ((batch.results_after, 5), (batch.log, 5), (batch.rejected, 2)):
        read = scanned(spark, output)
        assert read("changes") == star.changes.count()
        assert read("lineitem.parquet") <= most * star.read("lineitem").count()


def scanned(spark, df):
    """Rows that the scans of a folder have given out in one run of ``df``."""
    df.write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    metrics = store.executionMetrics(last.executionId())
    graph = store.planGraph(last.executionId()).allNodes()

    def of(folder):
        total = 0
        for i in range(graph.size()):
            node = graph.apply(i)
            if node.name().startswith("Scan") and folder in node.desc():
                found = node.metrics()
                for k in range(found.size()):
                    metric = found.apply(k)
                    if metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                        total += int(metrics.apply(metric.accumulatorId()).replace(",", ""))
        return total

    return of


@pytest.fixture
def whole_paths(spark):
    """Descriptions of scans that name their folders in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def batch_of(spark, tmp_path):
    """The changes of the small tables, the results and assignments from folders of their own."""
    from meritpool.plans import changes as ch
    from meritpool.sources.starschema import StarSchema

    star = StarSchema(spark, SMALL)
    frames = {}
    for name in ("changes", "results", "assignments"):
        df = getattr(star, name)
        df.write.parquet(str(tmp_path / name))
        frames[name] = spark.read.schema(df.schema).parquet(str(tmp_path / name))
    batch = ch.ChangeBatch(
        frames["changes"], frames["results"], star.students, star.criteria, star.enrollments, star.periods, "1998",
        with_ids=lambda rows: rows.withColumn("id", F.concat(F.lit("new-"), "change_id")),
    )
    return batch, frames


def test_results_are_dealt_out_once_for_their_edits(spark, no_broadcast, whole_paths, tmp_path):
    """One exchange of the whole results judges the edits and takes them over."""
    batch, frames = batch_of(spark, tmp_path)
    read = scanned(spark, batch.results_after)
    assert read(str(tmp_path / "results")) == frames["results"].count()
    assert read(str(tmp_path / "changes")) == frames["changes"].count()


def test_sums_are_kept_up_from_one_exchange_of_each_table(spark, no_broadcast, whole_paths, tmp_path):
    from meritpool.plans import incremental as inc

    batch, frames = batch_of(spark, tmp_path)
    results, assignments = frames["results"], frames["assignments"]
    read = scanned(spark, inc.score_changes(batch))
    assert read(str(tmp_path / "results")) == results.count()
    read = scanned(spark, inc.sums_after(inc.student_sums(assignments, results), assignments, inc.score_changes(batch)))
    assert read(str(tmp_path / "assignments")) == assignments.count()
    assert read(str(tmp_path / "changes")) == frames["changes"].count()


def test_enrollments_are_dealt_out_once(spark, no_broadcast, tmp_path):
    """By their place at once: a batch that is not small does not filter them by student first."""
    batch, _ = batch_of(spark, tmp_path)
    text = batch.updated._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert inputs and not any(re.search(r"\bid#", x) and "student_id#" in x for x in inputs), inputs


def test_line_items_travel_once(spark, no_broadcast):
    """To their orders, for all the frames that a job takes from them."""
    from meritpool.sources.starschema import StarSchema

    lines = StarSchema(spark, SMALL).read("lineitem").count()
    for name in ("changes_updated", "changes_results", "summary_after_changes"):
        assert scanned(spark, QUERIES[name](spark, SMALL))("lineitem.parquet") == lines, name


def test_keys_of_one_hash_are_kept_apart(spark):
    """Texts that meet in one hash are joined by themselves."""
    from meritpool.plans import changes as ch

    left = spark.createDataFrame([(1, "ra", 1), (1, "rab", 2), (2, "", 3)], "_at int, _by string, n int")
    right = spark.createDataFrame([(1, "ra", 10), (1, "rb", 20)], "_at int, _by string, m int")
    got = ch._joined(left, right, "left").select("n", "m").collect()
    assert sorted((r.n, r.m or 0) for r in got) == [(1, 10), (2, 0), (3, 0)]
    assert ch._joined(left.drop("_at").where("n < 3"), right.withColumn("_at", F.hash("_by")), "inner").count() == 1
