"""Report queries: lists, searches, cards, exports, counts and look-ups.

Searches run on whole reports unless the report itself is a newest-N list.
Lists that name students and criteria join them after the newest rows are cut
out; rows of a checked table always have both (``reference_violations``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.functions.text import contains_text, number_text, text_or_dash, yes_no
from meritpool.operators.ranking import latest_by, top_by
from meritpool.operators.search import holding
from meritpool.plans.summary import PERIOD, teacher_allocation
from meritpool.sources.tables import Tables, inline_rows

NEWEST = 300
CARD_ITEMS = 100

# Headings of the exports.
RESULT_HEADINGS = {
    "id": "ID", "student_name": "Ученик", "criterion_name": "Критерий",
    "grade_at_result": "Класс", "grade_track": "Трек", "base_score": "База",
    "dynamic_bonus": "Динамика", "total_score": "Итог", "result_date": "Дата",
    "source_type": "Источник",
}
SUMMARY_HEADINGS = {
    "teacher_name": "Педагог", "student_count_with_results": "С баллами",
    "total_student_count": "Всего", "raw_points": "Raw points",
    "normalized_points": "Normalized points", "reverse_incentive_amount": "Reverse incentive",
    "normalized_fund_amount": "Normalized fund", "is_dismissed": "Уволен",
}
CARD_SUMMARY_HEADINGS = {
    k: v for k, v in SUMMARY_HEADINGS.items() if k != "reverse_incentive_amount"
}
CARD_CALCULATION_HEADINGS = {
    "teacher_name": "Педагог", "raw_points": "Raw", "normalized_points": "Normalized",
    "uvsotr_amount": "UvSotr", "final_amount": "Final amount", "calculated_at": "Дата расчёта",
}
CARD_ITEM_HEADINGS = {
    "student_name": "Ученик", "criterion_name": "Критерий", "total_score": "Итоговый балл",
    "result_date": "Дата",
}
# Labels of the tracks.
TRACK_LABELS = (
    ("regular", "Обычный"),
    ("course", "11 класс (курс)"),
    ("practicum", "11 класс (практикум)"),
)

RESULT_COLUMNS = [
    "id", "student_id", "criterion_id", "student_name", "criterion_name", "grade_at_result",
    "grade_track", "base_score", "dynamic_bonus", "total_score", "raw_result_value",
    "result_date", "comment", "source_type",
]
CALCULATION_COLUMNS = [
    "id", "teacher_name", "raw_points", "normalized_points", "reverse_weight", "employee_share",
    "uvsotr_amount", "final_amount", "student_count_with_results", "total_student_count",
    "is_dismissed_snapshot", "calculated_at",
]
LOG_COLUMNS = [
    "id", "actor_name", "actor_role", "action_type", "entity_type", "entity_id", "details",
    "created_at",
]


def headed(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(h) for c, h in headings.items()])


# --- results ----------------------------------------------------------------


def with_names(results: DataFrame, students: DataFrame, criteria: DataFrame) -> DataFrame:
    return results.join(
        students.select(F.col("id").alias("student_id"), F.col("full_name").alias("student_name")),
        "student_id",
    ).join(
        criteria.select(F.col("id").alias("criterion_id"), F.col("name").alias("criterion_name")),
        "criterion_id",
    )


def newest(df: DataFrame, n: int = NEWEST) -> DataFrame:
    """The rows with the highest ids; each task keeps ``n`` and one merges them."""
    return df.orderBy(F.desc("id")).limit(n)


def recent_results(tables: Tables, n: int = NEWEST) -> DataFrame:
    rows = newest(tables.results, n)
    return with_names(rows, tables.students, tables.criteria).select(*RESULT_COLUMNS).orderBy(F.desc("id"))


def result_filter(
    query: str | None = None, track: str | None = None, grade: str | int | None = None
) -> Column:
    """Text in student or criterion name, ignoring case; track and grade equal.
    A control left empty filters nothing."""
    matches = contains_text(F.col("student_name"), query) | contains_text(
        F.col("criterion_name"), query
    )
    return matches & _placed(track, grade)


def _placed(track: str | None, grade: str | int | None) -> Column:
    matches = F.lit(True)
    if track:
        matches = matches & (F.col("grade_track") == track)
    if grade not in (None, ""):
        matches = matches & (F.col("grade_at_result").cast("string") == str(grade))
    return matches


def search_results(
    tables: Tables, query: str | None = None, track: str | None = None,
    grade: str | int | None = None, n: int | None = None,
) -> DataFrame:
    """Results that match, of all or of the newest ``n`` that a list shows."""
    listed = all_results(tables).select(*RESULT_COLUMNS) if n is None else recent_results(tables, n)
    return listed.where(result_filter(query, track, grade))


def search_by_index(
    tables: Tables, student_index: DataFrame, criterion_index: DataFrame, query: str | None,
    track: str | None = None, grade: str | int | None = None,
) -> DataFrame:
    """``search_results`` over all results by the indexes of the names.

    The names that hold the text are found first; results are read against their ids, which
    Spark broadcasts if they are few, and names are joined to the rows that are left.
    """
    if not (query or "").strip():
        return search_results(tables, query, track, grade)
    students = holding(tables.students, student_index, query, "full_name")
    criteria = holding(tables.criteria, criterion_index, query, "name")
    rows = tables.results
    for column, found in (("student_id", students), ("criterion_id", criteria)):
        ids = found.select(F.col("id").alias(column), F.lit(True).alias(f"_{column}"))
        rows = rows.join(ids, column, "left")
    rows = rows.where(F.col("_student_id").isNotNull() | F.col("_criterion_id").isNotNull())
    named = with_names(rows.where(_placed(track, grade)), tables.students, tables.criteria)
    return named.select(*RESULT_COLUMNS)


def shown_of(df: DataFrame, matches: Column) -> DataFrame:
    """How many rows a filter leaves, and of how many."""
    return df.agg(F.count_if(matches).alias("shown"), F.count("*").alias("total"))


def all_results(tables: Tables) -> DataFrame:
    return with_names(tables.results, tables.students, tables.criteria)


def results_export(tables: Tables) -> DataFrame:
    """The whole list, newest first. The sort is a range shuffle by id."""
    return headed(all_results(tables), RESULT_HEADINGS).orderBy(F.desc("ID"))


# --- summary ----------------------------------------------------------------


def summary_report(summary: DataFrame) -> DataFrame:
    return summary.drop(PERIOD, "teacher_id", "avg_group_size", "total_reverse_weight").orderBy(
        "teacher_name", "academic_period"
    )


def summary_filter(query: str | None = None, hide_dismissed: bool = False) -> Column:
    matches = contains_text(F.col("teacher_name"), query)
    return matches & ~F.col("is_dismissed") if hide_dismissed else matches


def search_summary(
    summary: DataFrame, query: str | None = None, hide_dismissed: bool = False
) -> DataFrame:
    return summary_report(summary).where(summary_filter(query, hide_dismissed))


def summary_export(summary: DataFrame) -> DataFrame:
    return headed(summary.orderBy("teacher_name", "academic_period"), SUMMARY_HEADINGS)


def _settled(ratio: Column) -> Column:
    """A double without the noise of its last digits, so that a half is shown
    as a half."""
    return F.round(ratio, 8)


def summary_texts(summary: DataFrame) -> DataFrame:
    """The summary as report texts."""
    return summary.select(
        "academic_period", "teacher_name",
        *[
            number_text(_settled(F.col(c))).alias(c)
            for c in (
                "student_count_with_results", "total_student_count", "raw_points",
                "normalized_points", "normalized_fund_amount",
            )
        ],
        yes_no(F.col("is_dismissed")).alias("is_dismissed"),
    )


# --- stored calculations ----------------------------------------------------


def stored_calculations(
    calculations: DataFrame, teachers: DataFrame, periods: DataFrame, period_name: str
) -> DataFrame:
    """Stored calculations of the named period by teacher name."""
    names = teachers.select(F.col("id").alias("teacher_id"), F.col("full_name").alias("teacher_name"))
    of = periods.where(F.col("name") == period_name).select(F.col("id").alias(PERIOD))
    return (
        calculations.join(of, PERIOD)
        .join(names, "teacher_id")
        .select(*CALCULATION_COLUMNS)
        .orderBy("teacher_name", "id")
    )


def search_calculations(listed: DataFrame, query: str | None) -> DataFrame:
    return listed.where(contains_text(F.col("teacher_name"), query))


# --- teacher card -----------------------------------------------------------


def _of_teacher(df: DataFrame, teacher_name: str | None) -> DataFrame:
    return df if teacher_name is None else df.where(F.col("teacher_name") == teacher_name)


def card_summary(
    tables: Tables, periods: Sequence[int] | None = None, teacher_name: str | None = None
) -> DataFrame:
    """The summary row of every (period, teacher); cards are kept by both."""
    return _of_teacher(teacher_allocation(tables, periods), teacher_name)


def card_calculation(
    calculations: DataFrame, teachers: DataFrame, periods: DataFrame,
    teacher_name: str | None = None,
) -> DataFrame:
    """The latest stored calculation of every (period, teacher)."""
    names = teachers.select(F.col("id").alias("teacher_id"), F.col("full_name").alias("teacher_name"))
    of = periods.select(F.col("id").alias(PERIOD), F.col("name").alias("academic_period"))
    latest = latest_by(calculations, [PERIOD, "teacher_id"], ["calculated_at", "id"])
    return _of_teacher(latest.join(names, "teacher_id").join(of, PERIOD), teacher_name)


def linked_results(links: DataFrame, results: DataFrame) -> DataFrame:
    """Linked results by teacher: ids, score and date."""
    scored = results.select(
        F.col("id").alias("student_result_id"), "student_id", "criterion_id", "total_score",
        "result_date",
    )
    return links.select("student_result_id", "teacher_id").join(scored, "student_result_id")


def card_items(
    tables: Tables, teacher_name: str | None = None, n: int | None = CARD_ITEMS
) -> DataFrame:
    """The newest ``n`` linked results of every teacher, undated ones last; all
    of them with ``n`` None. Names are joined to the rows that are left."""
    teachers = tables.teachers.select(
        F.col("id").alias("teacher_id"), F.col("full_name").alias("teacher_name")
    )
    links = tables.links
    if teacher_name is not None:
        one = _of_teacher(teachers, teacher_name).select("teacher_id")
        links = links.join(one, "teacher_id", "left_semi")
    rows = linked_results(links, tables.results)
    order = [F.desc_nulls_last("result_date"), F.desc("student_result_id")]
    if n is not None:
        rows = top_by(rows, ["teacher_id"], order, n)
    named = with_names(rows, tables.students, tables.criteria).join(teachers, "teacher_id")
    columns = ["teacher_name", "student_result_id", "student_name", "criterion_name", "total_score",
               "result_date"]
    return named.select(*columns, *(["place"] if n is not None else []))


def card_export(
    tables: Tables, calculations: DataFrame, periods: Sequence[int] | None = None,
    teacher_name: str | None = None,
) -> dict[str, DataFrame]:
    """The three sheets of the card, for all teachers or one; items uncut.

    With all teachers each sheet names the teacher and is laid out by name, a
    teacher with many rows over several files.
    """
    summary = headed(card_summary(tables, periods, teacher_name), CARD_SUMMARY_HEADINGS)
    calculation = headed(
        card_calculation(calculations, tables.teachers, tables.periods, teacher_name),
        CARD_CALCULATION_HEADINGS,
    )
    items = card_items(tables, teacher_name, n=None)
    order = ["teacher_name", F.desc_nulls_last("result_date"), F.desc("student_result_id")]
    headings = CARD_ITEM_HEADINGS
    if teacher_name is None:
        headings = {"teacher_name": "Педагог", **headings}
    return {
        "Summary": summary.orderBy("Педагог"),
        "Calculation": calculation.orderBy("Педагог"),
        "Items": headed(items.orderBy(*order), headings),
    }


def card_texts(summary: DataFrame, calculation: DataFrame) -> DataFrame:
    """Texts of the upper half of the card; a dash where nothing is stored."""
    stored = calculation.select(
        PERIOD, "teacher_id", "uvsotr_amount", "final_amount",
        F.col("raw_points").alias("stored_raw"), F.col("normalized_points").alias("stored_normalized"),
        "calculated_at",
    )
    return summary.join(stored, [PERIOD, "teacher_id"], "left").select(
        "academic_period", "teacher_name",
        number_text(F.col("raw_points")).alias("raw_points"),
        number_text(_settled(F.col("normalized_fund_amount"))).alias("normalized_fund_amount"),
        yes_no(F.col("is_dismissed")).alias("is_dismissed"),
        number_text(F.col("stored_raw")).alias("stored_raw"),
        number_text(F.col("stored_normalized")).alias("stored_normalized"),
        number_text(F.col("uvsotr_amount")).alias("uvsotr_amount"),
        number_text(F.col("final_amount")).alias("final_amount"),
        text_or_dash(F.date_format("calculated_at", "yyyy-MM-dd")).alias("calculated_on"),
    )


# --- log, counts, look-ups --------------------------------------------------


def recent_log(log: DataFrame, n: int = NEWEST) -> DataFrame:
    return newest(log.select(*LOG_COLUMNS), n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one answer."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def lookup_students(students: DataFrame) -> DataFrame:
    return students.select("id", "full_name").orderBy("full_name", "id")


def lookup_criteria(criteria: DataFrame) -> DataFrame:
    active = criteria.where("is_active")
    return active.orderBy("sort_order", "name", "id").select("id", "name", "base_score")


def lookup_period(periods: DataFrame, name: str) -> DataFrame:
    return periods.where(F.col("name") == name).select("id", "name")


def lookup_tracks(spark) -> DataFrame:
    return inline_rows(spark, ["value", "label"], ["string", "string"], TRACK_LABELS)
