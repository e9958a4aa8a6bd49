"""The registered queries: (spark, folder) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.catalog.plain import plain
from meritpool.functions.text import empty_to_null, iso_day, name_key
from meritpool.operators import quality
from meritpool.operators.deletes import deletion
from meritpool.operators.inserts import id_summary
from meritpool.operators.merge import upsert
from meritpool.operators.search import name_index
from meritpool.plans import changes as ch
from meritpool.plans import imports as im
from meritpool.plans import incremental as inc
from meritpool.plans import loads as ld
from meritpool.plans import reference_data as rd
from meritpool.plans import reports as rp
from meritpool.plans import snapshot as sn
from meritpool.plans import summary as su
from meritpool.sources.starschema import StarSchema
from meritpool.sources.tables import Tables
from meritpool.sources.writers import log_inserts, log_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ONE_YEAR = 1997
LOAD_YEAR = "1998"


def query(build: Callable[[StarSchema], DataFrame]) -> Query:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(StarSchema(spark, folder)))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    run.plan = build
    QUERIES[build.__name__] = run
    return run


# --- scoring and allocation -------------------------------------------------


@query
def teacher_summary(s):
    return su.teacher_summary(s)


@query
def summary_one_period(s):
    return su.teacher_summary(s, periods=[ONE_YEAR])


@query
def summary_scope(s):
    return su.active_scope(s.assignments)


@query
def scores_by_match(s):
    return su.scores_by_match(s.results).drop("scored")


def _student_points(s):
    return su.student_points(su.active_scope(s.assignments), su.scores_by_match(s.results))


@query
def points_by_student(s):
    return su.points_by_student(_student_points(s))


@query
def teacher_points(s):
    return su.teacher_points(su.scored_teachers(s))


@query
def total_students(s):
    return su.scored_teachers(s).select("academic_period_id", "teacher_id", "total_student_count")


@query
def scope_join(s):
    return su.scored_teachers(s)


@query
def avg_group(s):
    return su.average_group(su.period_totals(su.scored_teachers(s)))


def _with_totals(s):
    teachers = su.scored_teachers(s)
    return su.with_totals(teachers, su.period_totals(teachers))


@query
def normalized(s):
    return su.normalized(_with_totals(s)).drop("total_normalized_points", "total_reverse_weight")


@query
def reverse_weights(s):
    weighed = su.reverse_weights(su.normalized(_with_totals(s)))
    return weighed.select(
        "academic_period_id", "teacher_id", "normalized_points", "total_normalized_points",
        "reverse_weight", "total_reverse_weight",
    )


@query
def fund_settings(s):
    return su.fund_settings(s.settings)


@query
def allocation(s):
    return su.teacher_allocation(s).select(
        "academic_period_id", "teacher_id", "normalized_share_percent", "employee_share",
        "reverse_incentive_amount", "normalized_fund_amount",
    )


# --- summary reports --------------------------------------------------------


@query
def summary_report(s):
    return rp.summary_report(su.teacher_allocation(s))


@query
def summary_search(s):
    return rp.search_summary(su.teacher_allocation(s), " SUPPLIER#00000001 ", hide_dismissed=True)


@query
def summary_shown(s):
    return rp.shown_of(su.teacher_summary(s), rp.summary_filter("7", hide_dismissed=True))


@query
def summary_export(s):
    return rp.summary_export(su.teacher_allocation(s))


@query
def report_numbers(s):
    return rp.summary_texts(su.teacher_summary(s))


# --- result lists -----------------------------------------------------------


@query
def results_recent(s):
    return rp.recent_results(s)


@query
def results_search(s):
    return rp.search_results(s, query="1", track="course", grade=8)


def _indexed_search(s, query, **rest):
    return rp.search_by_index(
        s, name_index(s.students, "full_name"), name_index(s.criteria, "name"), query, **rest
    )


@query
def results_search_indexed(s):
    """A short text, by the index of letters."""
    return _indexed_search(s, "1", track="course", grade=8)


@query
def results_search_letters(s):
    return _indexed_search(s, " Ring ")


@query
def results_shown(s):
    """Over the whole list."""
    return rp.shown_of(rp.all_results(s), rp.result_filter("ring", "regular", "7"))


@query
def results_export(s):
    return rp.results_export(s)


@query
def result_days(s):
    return s.results.groupBy(iso_day(F.col("result_date")).alias("day")).agg(
        F.count("*").alias("n_rows")
    )


# --- snapshots and stored calculations --------------------------------------


def _snapshot(s):
    return sn.snapshot_rows(s, [ONE_YEAR], calculated_at=F.lit("2024-01-01").cast("timestamp"))


@query
def snapshot_rows(s):
    return _snapshot(s)


@query
def snapshot_rejects(s):
    """Teachers of one nation share a name if their balance is high."""
    shared = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Namesake "), F.col("s_nationkey").cast("string")))
    names = s.read("supplier").select(F.col("s_suppkey").alias("id"), shared.alias("shared"))
    teachers = s.teachers.join(names, "id").withColumn("full_name", F.coalesce("shared", "full_name")).drop("shared")
    tables = Tables(assignments=s.assignments, results=s.results, teachers=teachers, periods=s.periods, settings=s.settings)
    rows = sn.snapshot_rejects(tables, [ONE_YEAR], F.lit("2024-01-01").cast("timestamp"))
    return rows.select("academic_period_id", "teacher_id", "raw_points", "total_student_count", F.array_join("rules", ",").alias("rules"))


@query
def snapshot_replace(s):
    new = _snapshot(s).withColumn("id", F.concat_ws("-", "academic_period_id", "teacher_id"))
    return sn.calculations_after(s.calculations, [ONE_YEAR], new)


@query
def snapshot_items_left(s):
    return sn.items_after(s.items, s.calculations, [ONE_YEAR])


@query
def snapshot_log(s):
    log = sn.rebuild_log(_snapshot(s), s.periods.where(F.col("id") == ONE_YEAR))
    return log.drop("created_at")


@query
def calculations_by_period(s):
    return rp.stored_calculations(s.calculations, s.teachers, s.periods, str(ONE_YEAR))


@query
def calculations_search(s):
    listed = rp.stored_calculations(s.calculations, s.teachers, s.periods, str(ONE_YEAR))
    return rp.search_calculations(listed, "#00000002")


# --- teacher card -----------------------------------------------------------


@query
def card_summary(s):
    return rp.card_summary(s)


@query
def card_latest(s):
    return rp.card_calculation(s.calculation_history, s.teachers, s.periods)


@query
def card_items(s):
    return rp.card_items(s)


@query
def card_items_export(s):
    return rp.card_export(s, s.calculations)["Items"]


@query
def card_calculation_export(s):
    return rp.card_export(s, s.calculation_history)["Calculation"]


@query
def card_summary_export(s):
    return rp.card_export(s, s.calculation_history)["Summary"]


@query
def card_texts(s):
    latest = rp.card_calculation(s.calculation_history, s.teachers, s.periods)
    return rp.card_texts(rp.card_summary(s), latest)


# --- change log, counts, look-ups -------------------------------------------


@query
def log_recent(s):
    return rp.recent_log(s.log)


@query
def log_append(s):
    """The log with a row for each event, written by the system where the
    event is an error."""
    return s.log.drop("id", "created_at").unionByName(_log_rows(s).drop("created_at"))


def _log_rows(s):
    actor = F.when(F.col("event_type") != "error", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    details = F.when(F.col("event_type") != "view", F.to_json(F.struct("event_id", "user_id")))
    return log_rows(
        s.read("events"), F.col("event_type"), "event", F.col("user_id"), details, actor
    )


@query
def table_counts(s):
    return rp.table_counts(
        {
            "students": s.students, "teachers": s.teachers, "student_results": s.results,
            "teacher_calculations": s.calculations, "audit_log": s.log,
        }
    )


@query
def lookup_students(s):
    return rp.lookup_students(s.students)


@query
def lookup_criteria(s):
    return rp.lookup_criteria(s.criteria)


@query
def lookup_period(s):
    return rp.lookup_period(s.periods, LOAD_YEAR)


# --- reference data ---------------------------------------------------------


@query
def periods_insert_absent(s):
    """The later periods are known under another name."""
    known = F.when(F.col("name") < "1999", F.col("name")).otherwise(F.concat(F.lit("old "), "name"))
    return rd.new_periods(s.periods.withColumn("name", known), s.periods)


@query
def groups_upsert(s):
    given = s.read("part").select(
        F.lower("p_brand").alias("code"), F.col("p_brand").alias("name"),
        F.lit("brand").alias("description"), F.length("p_brand").alias("sort_order"),
    ).unionByName(
        s.groups.select(
            F.when(F.col("code") < "p", F.col("code")).otherwise(F.concat(F.lit("new "), "code"))
            .alias("code"),
            F.initcap("name").alias("name"), F.lit("type").alias("description"),
            F.lit(1).alias("sort_order"),
        )
    )
    known = s.groups.select(
        "code", "name", F.lit(None).cast("string").alias("description"), "sort_order"
    )
    return rd.merged_groups(known, given)


def _criteria_upsert(s):
    code = F.when(F.col("code") == "promo", "promo-old").otherwise(F.col("code"))
    known_groups = s.groups.withColumn("code", code)
    return rd.merged_criteria(
        s.older_criteria, s.given_criteria, known_groups, F.lit("2024-01-01").cast("timestamp")
    )


@query
def criteria_upsert(s):
    return _criteria_upsert(s).drop("updated_at")


@query
def dq_touch(s):
    return _criteria_upsert(s).select("code", "updated_at")


@query
def weights_load(s):
    return rd.merged_weights(s.older_weights, s.given_weights, s.criteria)


@query
def settings_upsert(s):
    return rd.merged_settings(s.settings, s.given_settings, s.periods)


@query
def teachers_insert_absent(s):
    return rd.new_teachers(s.teachers, s.given_teachers)


# --- staged import ----------------------------------------------------------


@query
def name_keys(s):
    return s.staged_results.select(
        "row_key", name_key(F.col("student_name")).alias("name_key"),
    )


def _known_students(s):
    """The inactive ones are known under another name."""
    former = F.concat(F.lit("former "), "full_name")
    return s.students.withColumn(
        "full_name", F.when(F.col("is_active"), F.col("full_name")).otherwise(former)
    )


@query
def missing_names(s):
    return im.unknown_names(_known_students(s), s.staged_results, s.staged_matrix)


@query
def new_student_ids(s):
    """The ids given to new students: dense, from the highest id on."""
    return id_summary(im.new_students(_known_students(s), s.staged_results, s.staged_matrix))


def _as_numbered(df):
    """The rows of the star schema have texts for ids; here they count from 1."""
    n = df.agg(F.count("*")).scalar()
    return df.select(n.alias("id")).limit(1)


@query
def teacher_ids(s):
    return id_summary(rd.teacher_inserts(s.teachers, s.given_teachers))


@query
def period_ids(s):
    known = s.periods.where("false").withColumn("name", F.col("name"))
    return id_summary(rd.period_inserts(known, s.periods.drop("id")))


def _with_ids(rows, order):
    """Known rows as a table stores them, numbered in their order."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query
def criteria_ids(s):
    """Known criteria keep their id, new ones go on from the highest."""
    known = s.older_criteria.withColumn("id", F.regexp_replace("code", "[a-z]", "").cast("bigint"))
    merged = rd.merged_criteria(known, s.given_criteria, s.groups)
    return id_summary(rd.numbered_criteria(merged, known))


@query
def group_ids(s):
    known = _with_ids(s.groups.drop("id").withColumn("description", F.lit(None).cast("string")), ["code"])
    given = s.read("part").select(
        F.lower("p_brand").alias("code"), F.col("p_brand").alias("name"),
        F.lit("brand").alias("description"), F.length("p_brand").alias("sort_order"),
    )
    return id_summary(rd.numbered_groups(rd.merged_groups(known, given), known))


@query
def weight_ids(s):
    """The older weights count from one; the numbers of new ones go on."""
    n = s.older_weights.agg(F.count("*")).scalar()
    known = s.older_weights.withColumn("id", n)
    return id_summary(rd.numbered_weights(rd.merged_weights(known, s.given_weights, s.criteria), known))


@query
def enrollment_ids(s):
    return id_summary(im.enrollment_inserts(enrollments_insert_absent.plan(s), _as_numbered(s.enrollments)))


@query
def assignment_ids(s):
    return id_summary(im.assignment_inserts(assignments_insert_absent.plan(s), _as_numbered(s.assignments)))


@query
def result_ids(s):
    loaded = _import(s)[0].drop("student_enrollment_id")
    return id_summary(im.result_inserts(loaded, _as_numbered(s.results)))


@query
def log_ids(s):
    """Appended log rows stand above all older ones."""
    return id_summary(log_inserts(_log_rows(s), s.log))


@query
def enrollments(s):
    return im.enrollment_rows(s.staged_matrix, s.students, s.periods, LOAD_YEAR)


@query
def enrollments_insert_absent(s):
    return im.new_enrollments(s.enrollments, s.staged_matrix, s.students, s.periods, LOAD_YEAR)


@query
def assignments(s):
    return im.assignment_rows(s.staged_matrix, s.students, s.teachers, s.periods, LOAD_YEAR)


@query
def assignments_insert_absent(s):
    return im.new_assignments(
        s.assignments, s.staged_matrix, s.students, s.teachers, s.periods, LOAD_YEAR
    )


@query
def grade_pick(s):
    return im.grade_picks(s.students, s.enrollments, s.periods, LOAD_YEAR)


def _import(s):
    return im.import_results(
        s.staged_results, s.students, s.enrollments, s.criteria, s.periods, LOAD_YEAR
    )


@query
def result_import(s):
    return _import(s)[0]


@query
def result_import_rejected(s):
    return _import(s)[1].select("row_key", F.array_join("rules", ",").alias("rules"))


def _deliveries(s):
    """The staging rows in monthly batches; then again; then one year corrected,
    with other bonuses and without the rows of one unit."""
    day = F.substring_index("row_key", "-", -1).cast("int")
    month = F.date_format(F.date_from_unix_date(day), "yyyy-MM")
    first = s.staged_results.select("row_key", "base_score", "dynamic_bonus", month.alias("batch_id"))
    corrected = first.where(F.col("batch_id").startswith(str(ONE_YEAR)) & (F.col("base_score") != 1))
    return first, corrected.withColumn("dynamic_bonus", F.coalesce("dynamic_bonus", F.lit(10).cast("decimal(12,4)")))


def _loaded_twice(s):
    first, corrected = _deliveries(s)
    nothing = s.spark.createDataFrame([], ld.ledger_schema(first.schema["batch_id"].dataType))
    table, ledger = ld.loaded(first.where("false"), nothing, first)
    table, ledger = ld.loaded(table, ledger, first)
    return ld.loaded(table, ledger, corrected)


@query
def load_repeated(s):
    """Batches loaded, loaded again, and some of them corrected."""
    return _loaded_twice(s)[0]


@query
def load_ledger(s):
    return _loaded_twice(s)[1].select("batch_id", "n_rows")


@query
def result_import_faulty(s):
    """The rejects of staging rows without a score, or with scores too large together."""
    large = F.lit(99999999).cast("decimal(12,4)")
    score = F.col("base_score")
    staged = s.staged_results.withColumns(
        {
            "base_score": F.when(score == 4, large).when(score != 3, score),
            "dynamic_bonus": F.when(score == 4, large).otherwise(F.col("dynamic_bonus")),
        }
    )
    rejected = im.import_results(staged, s.students, s.enrollments, s.criteria, s.periods, LOAD_YEAR)[1]
    return rejected.select("row_key", F.array_join("rules", ",").alias("rules"))


# --- changes ----------------------------------------------------------------


def _batch(s, changes=None, criteria=None):
    return ch.ChangeBatch(
        s.changes if changes is None else changes, s.results, s.students,
        s.criteria if criteria is None else criteria, s.enrollments, s.periods, LOAD_YEAR,
        with_ids=lambda rows: rows.withColumn("id", F.concat(F.lit("new-"), F.col("change_id"))),
    )


_WRITTEN = [
    "academic_period_id", "student_id", "student_enrollment_id", "criterion_id",
    "grade_at_result", "grade_track", "base_score", "dynamic_bonus", "total_score",
    "raw_result_value", "result_date", "source_type", "comment",
]


@query
def changes_created(s):
    return _batch(s).created.select("id", *_WRITTEN)


@query
def changes_updated(s):
    return _batch(s.shared).updated.select("result_id", "change_id", *_WRITTEN)


@query
def changes_deleted(s):
    return _batch(s).deleted


@query
def changes_rejected(s):
    return _batch(s).rejected.select("change_id", F.array_join("rules", ",").alias("rules"))


@query
def changes_oversized(s):
    """What is rejected where some criteria and bonuses do not fit together."""
    large = F.col("base_score") > 40
    criteria = s.criteria.withColumn(
        "base_score", F.when(large, F.lit(99999999)).otherwise(F.col("base_score")).cast("decimal(12,4)")
    )
    changes = s.changes.withColumn(
        "dynamic_bonus", F.when(F.col("dynamic_bonus").startswith("9"), "99999999").otherwise(F.col("dynamic_bonus"))
    )
    rejected = _batch(s, changes, criteria).rejected
    return rejected.select("change_id", F.array_join("rules", ",").alias("rules"))


@query
def changes_results(s):
    return _batch(s.shared).results_after.select("id", *_WRITTEN)


@query
def changes_links(s):
    return _batch(s).children_after(s.links)


@query
def changes_items(s):
    return _batch(s).children_after(s.items)


@query
def changes_log(s):
    return _batch(s).log.drop("created_at")


@query
def summary_after_changes(s):
    """The summary after the batch, from stored sums and what the batch adds to them."""
    s = s.shared
    sums = inc.sums_after(
        inc.student_sums(s.assignments, s.results), s.assignments, inc.score_changes(_batch(s))
    )
    return inc.summary_of(sums, s).select(*su.SUMMARY_COLUMNS)


# --- validity rules ---------------------------------------------------------


def _row_rules(kind):
    return lambda s: quality.row_violations(s.broken_results, schemas.RESULTS, kinds=(kind,))


def _named(name, build):
    build.__name__ = name
    query(build)


_named("dq_checks", _row_rules("checks"))
_named("dq_required", _row_rules("required"))
_named("dq_enum", _row_rules("enum"))
_named("dq_length", _row_rules("length"))


@query
def dq_all_row_rules(s):
    return quality.row_violations(
        s.broken_results, schemas.RESULTS, kinds=("checks", "required", "enum", "length")
    )


@query
def dq_precision(s):
    return quality.row_violations(s.wide_numbers, schemas.RESULTS, kinds=("precision",))


@query
def dq_rounding(s):
    """Scores cut to two decimals, halves away from zero."""
    price = F.col("o_totalprice").cast("decimal(14,3)") + F.lit("0.005").cast("decimal(14,3)")
    return s.read("orders").select(
        "o_orderkey",
        price.cast("decimal(14,2)").alias("up"),
        (-price).cast("decimal(14,2)").alias("down"),
    )


@query
def dq_unique(s):
    """Line items taken as assignments: one per line, so keys repeat."""
    rows = s.lines.select(
        "student_id", "teacher_id", "academic_period_id", "grade", "grade_track",
        F.lit("main").alias("assignment_type"),
    )
    return quality.unique_violations(rows, schemas.ASSIGNMENTS)


@query
def dq_references(s):
    parents = {"academic_periods": s.periods, "students": s.students, "criteria": s.criteria}
    return quality.reference_violations(s.broken_results, schemas.RESULTS, parents)


def _violations(df, table):
    return quality.row_violations(df, table, kinds=("checks", "required", "enum", "length"))


@query
def dq_assignment_rows(s):
    """Assignments with something wrong at certain quantities and taxes."""
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 3, F.col("student_id")).alias("student_id"),
        F.when(F.col("tax") == 0.08, F.col("grade") + 3).otherwise(F.col("grade")).alias("grade"),
        F.when(quantity == 11, "evening").otherwise(F.col("grade_track")).alias("grade_track"),
        F.when(F.col("tax") == 0.01, "helper").otherwise("main").alias("assignment_type"),
        F.when(quantity == 5, 0).when(quantity == 6, 150).otherwise(25).alias("share_percent"),
    )
    return _violations(rows, schemas.ASSIGNMENTS)


@query
def dq_link_rows(s):
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 7, F.col("teacher_id")).alias("teacher_id"),
        F.when(quantity == 5, 0).otherwise(100).alias("share_percent"),
        F.when(quantity == 6, -1).when(quantity != 8, 1).alias("score_assigned"),
    )
    return _violations(rows, schemas.LINKS)


@query
def dq_criteria_rows(s):
    size = F.col("p_size")
    rows = s.read("part").select(
        F.col("p_partkey").alias("id"),
        F.when(size != 1, F.col("p_name")).alias("name"),
        F.when(size == 2, -size).otherwise(size).alias("base_score"),
        F.when(size == 3, -1).alias("max_dynamic_bonus"),
        F.when(size == 4, F.repeat(F.lit("x"), 101)).otherwise(F.lit("c")).alias("code"),
    )
    return _violations(rows, schemas.CRITERIA)


@query
def dq_weight_rows(s):
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 9, F.col("criterion_id")).alias("criterion_id"),
        F.when(quantity == 10, 1).otherwise(F.col("grade")).alias("grade"),
        F.when(quantity == 12, "").otherwise(F.col("grade_track")).alias("grade_track"),
        F.when(quantity == 13, -1).otherwise(1).alias("weight_value"),
    )
    return _violations(rows, schemas.WEIGHTS)


@query
def dq_student_rows(s):
    balance = F.col("c_acctbal")
    rows = s.read("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(balance >= 0, F.col("c_name")).alias("full_name"),
        F.when(balance > 5000, F.repeat(F.lit("x"), 101)).alias("last_name"),
    )
    return _violations(rows, schemas.STUDENTS)


@query
def dq_teacher_rows(s):
    nation = F.col("s_nationkey")
    rows = s.read("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(nation == 4, schemas.DEPARTED_POOL).when(nation != 3, F.col("s_name")).alias("full_name"),
        F.when(nation == 5, F.repeat(F.lit("x"), 151)).otherwise("S.").alias("short_name"),
        F.when(nation != 6, F.col("s_acctbal") < 0).alias("is_dismissed"),
        F.when(nation == 7, F.lit("2024-01-01")).cast("date").alias("dismissed_at"),
    )
    return _violations(rows, schemas.TEACHERS)


@query
def dq_period_rows(s):
    """Orders taken as periods of one day."""
    priority, day = F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    rows = s.read("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(priority == "1-URGENT", F.repeat(F.lit("x"), 101)).when(F.col("o_orderstatus") != "P", "name").alias("name"),
        day.alias("date_start"),
        F.when(priority == "2-HIGH", F.date_sub(day, 1)).when(priority != "5-LOW", day).alias("date_end"),
    )
    return _violations(rows, schemas.PERIODS)


@query
def dq_group_rows(s):
    size = F.col("p_size")
    rows = s.read("part").select(
        F.col("p_partkey").alias("id"),
        F.when(size == 2, F.repeat(F.lit("x"), 51)).when(size != 1, "code").alias("code"),
        F.when(size == 4, F.repeat(F.lit("x"), 256)).when(size != 3, "name").alias("name"),
        F.when(size != 5, size).alias("sort_order"),
    )
    return _violations(rows, schemas.GROUPS)


@query
def dq_enrollment_rows(s):
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 3, F.col("student_id")).alias("student_id"),
        F.when(quantity != 6, F.col("academic_period_id")).alias("academic_period_id"),
        F.when(F.col("tax") == 0.08, F.col("grade") + 3).otherwise(F.col("grade")).alias("grade"),
        F.when(quantity == 4, F.repeat(F.lit("x"), 51)).otherwise("9").alias("grade_label"),
        F.when(quantity == 5, F.repeat(F.lit("x"), 11)).otherwise("b").alias("class_letter"),
        F.when(quantity == 11, "evening").otherwise(F.col("grade_track")).alias("grade_track"),
    )
    return _violations(rows, schemas.ENROLLMENTS)


@query
def dq_setting_rows(s):
    """Orders taken as settings."""
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    rows = s.read("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", -price).when(F.col("o_orderstatus") != "P", price).alias("total_fund"),
        F.when(priority == "1-URGENT", -1).alias("total_points_sum"),
        F.when(priority == "2-HIGH", -1).otherwise(0).alias("dismissed_fund"),
        F.when(priority == "3-MEDIUM", -price).alias("uvsotr_value"),
        F.when(priority == "5-LOW", -1).otherwise(1).alias("avg_group_size"),
    )
    return _violations(rows, schemas.SETTINGS)


@query
def dq_calculation_rows(s):
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 1, F.col("teacher_id")).alias("teacher_id"),
        F.when(quantity == 2, -1).when(quantity != 3, 1).alias("raw_points"),
        F.when(quantity == 4, -1).alias("normalized_points"),
        F.when(quantity == 5, -1).alias("reverse_weight"),
        F.when(quantity == 6, -1).alias("employee_share"),
        F.when(quantity == 7, -1).alias("uvsotr_amount"),
        F.when(quantity == 8, -1).when(quantity != 9, 1).alias("final_amount"),
        F.when(quantity == 10, -1).alias("student_count_with_results"),
        F.when(quantity == 11, -1).alias("total_student_count"),
    )
    return _violations(rows, schemas.CALCULATIONS)


@query
def dq_item_rows(s):
    quantity = F.col("quantity")
    rows = s.lines.select(
        F.col("line_key").alias("id"),
        F.when(quantity != 1, F.col("line_key")).alias("student_result_id"),
        F.when(quantity == 2, -1).when(quantity != 3, 1).alias("base_points"),
        F.when(quantity == 4, -1).alias("normalized_points"),
        F.when(quantity == 5, 0).when(quantity == 6, 101).when(quantity != 7, 50).alias("applied_share_percent"),
        F.when(quantity == 8, -1).otherwise(1).alias("final_points_to_teacher"),
    )
    return _violations(rows, schemas.ITEMS)


@query
def dq_enrollment_references(s):
    """Whole parents; enrollments of the small balances name a student that is not
    there, those of grade 7 a year that is not."""
    poor = s.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("student_id"), F.lit(True).alias("poor"))
    rows = s.enrollments.join(poor, "student_id", "left").withColumns(
        {
            "student_id": F.when(F.col("poor"), -F.col("student_id")).otherwise(F.col("student_id")),
            "academic_period_id": F.when(F.col("grade") == 7, F.lit(1900)).otherwise(F.col("academic_period_id")),
        }
    )
    parents = {"students": s.students, "academic_periods": s.periods}
    return quality.reference_violations(rows, schemas.ENROLLMENTS, parents)


@query
def dq_restrict(s):
    deleted = s.criteria.where("not is_active")
    return quality.restrict_violations(
        deleted, [(schemas.RESULTS, s.results), (schemas.WEIGHTS, s.older_weights)],
        schemas.CRITERIA,
    )


def _after_student_delete(s, child):
    gone = s.students.where("not is_active")
    left = quality.cascade(
        gone, [(schemas.ENROLLMENTS, s.enrollments), (schemas.RESULTS, s.results),
               (schemas.ASSIGNMENTS, s.assignments)],
        schemas.STUDENTS,
    )
    return left[child]


@query
def dq_cascade(s):
    return _after_student_delete(s, "student_results").select("id", "student_id")


@query
def dq_cascade_assignments(s):
    return _after_student_delete(s, "student_teacher_assignments").drop("share_percent")


@query
def dq_set_null(s):
    gone = s.enrollments.where("grade = 5")
    left = quality.cascade(gone, [(schemas.RESULTS, s.results)], schemas.ENROLLMENTS)
    return left["student_results"].select("id", "student_enrollment_id")


def _without_inactive_students(s):
    return deletion(
        {"students": s.students, "student_enrollments": s.enrollments, "student_results": s.results,
         "student_teacher_assignments": s.assignments, "student_result_teacher_links": s.links,
         "teacher_calculations": s.calculations, "teacher_calculation_items": s.items},
        {"students": s.students.where("not is_active")},
    )


@query
def dq_cascade_links(s):
    """Links of the results of a student that goes, go too."""
    left = _without_inactive_students(s).after["student_result_teacher_links"]
    return left.select("student_result_id", "teacher_id", "score_assigned")


@query
def dq_cascade_items(s):
    """Items go with the calculations and the results of a period."""
    gone = deletion(
        {"academic_periods": s.periods, "student_results": s.results,
         "teacher_calculations": s.calculations, "teacher_calculation_items": s.items},
        {"academic_periods": s.periods.where(F.col("id") == ONE_YEAR)},
    )
    return gone.after["teacher_calculation_items"].select("teacher_calculation_id", "student_result_id", "student_id", "base_points")


@query
def dq_cascade_counts(s):
    return _without_inactive_students(s).counts()


@query
def dq_restrict_below(s):
    """Dismissed teachers and a period are to go; what the period takes along
    names no teacher any more, but rows of other periods do."""
    gone = deletion(
        {"academic_periods": s.periods, "teachers": s.teachers, "student_teacher_assignments": s.assignments,
         "student_results": s.results, "student_result_teacher_links": s.links, "teacher_calculations": s.calculations},
        {"academic_periods": s.periods.where(F.col("id") == ONE_YEAR), "teachers": s.teachers.where("is_dismissed")},
    )
    return gone.refused


@query
def dq_defaults(s):
    """Results that name neither bonus nor track get the defaults."""
    rows = s.broken_results.select(
        "id", "student_id", "base_score", "dynamic_bonus",
        empty_to_null(F.when(F.col("grade_track") == "evening", "").otherwise(F.col("grade_track")))
        .alias("grade_track"),
    )
    return quality.with_null_defaults(rows, schemas.RESULTS).select(
        "id", "dynamic_bonus", "grade_track"
    )


@query
def dq_generated(s):
    rows = s.broken_results.select("id", "base_score", "dynamic_bonus")
    return quality.with_generated(rows, schemas.RESULTS)


@query
def dq_generated_names(s):
    rows = s.given_teachers.select("full_name")
    return quality.with_generated(rows, schemas.TEACHERS)


@query
def upsert_unchanged(s):
    """An upsert of a table with itself changes nothing."""
    rows = s.older_weights
    return upsert(rows, rows, ["criterion_id", "grade", "grade_track"], ["weight_value"])
