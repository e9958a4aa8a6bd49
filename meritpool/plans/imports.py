"""Staged import: names to ids, enrollments, assignments and results.

Staging rows carry names only. Each name column is reduced to a key once and
the rows are joined by it. Deliberate differences to a plain script of inserts:
two spellings of a name in one batch are one student; loads may be run again;
rows that break a rule are diverted with the name of the rule, and the others
still load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.functions.scores import max_track
from meritpool.functions.text import grade_label, name_key
from meritpool.operators.ids import assign_ids, highest_id
from meritpool.operators.inserts import inserted
from meritpool.operators.merge import absent_rows
from meritpool.operators.quality import divert, row_rules

# Fixed values of imported rows.
IMPORT_SOURCE = "excel_import"
COMMENT = "Импорт из Excel"
COMMENT_MISMATCH = (
    "Импорт из Excel: base_score в строке Excel не совпадает со справочником criteria"
)

ENROLLMENT_KEY = ["student_id", "academic_period_id", "grade", "grade_track", "class_letter"]
ASSIGNMENT_KEY = [
    "student_id", "teacher_id", "academic_period_id", "grade", "grade_track", "assignment_type",
]


def keyed(df: DataFrame, column: str, key: str = "name_key") -> DataFrame:
    return df.withColumn(key, name_key(F.col(column)))


def period_id(periods: DataFrame, name: str) -> Column:
    """The id of the period of that name as a scalar, null if there is none."""
    return periods.where(F.col("name") == name).agg(F.max("id")).scalar()


def in_period(df: DataFrame, periods: DataFrame, name: str) -> DataFrame:
    """``df`` with the id of the named period; no rows if there is none."""
    return df.withColumn("academic_period_id", period_id(periods, name)).where(
        "academic_period_id is not null"
    )


# --- students ---------------------------------------------------------------


def unknown_names(students: DataFrame, *staged: DataFrame) -> DataFrame:
    """Names in any staging frame that no student bears, one spelling per key.

    Each frame is reduced to its names before they are brought together.
    """
    names = None
    for frame in staged:
        own = keyed(frame.select(F.col("student_name").alias("full_name")), "full_name")
        own = own.groupBy("name_key").agg(F.min("full_name").alias("full_name"))
        names = own if names is None else names.unionByName(own)
    once = names.groupBy("name_key").agg(F.min("full_name").alias("full_name"))
    known = students.select(name_key(F.col("full_name")).alias("name_key"))
    return once.join(known, "name_key", "left_anti")


def new_students(students: DataFrame, *staged: DataFrame) -> DataFrame:
    """Students to append, numbered on from the highest id.

    Numbering reads the names twice; both uses come from one exchange.
    """
    names = unknown_names(students, *staged)
    return assign_ids(names, ["name_key"], highest_id(students)).select(
        "id", "full_name", F.col("name_key").alias("full_name_normalized")
    )


# --- enrollments and assignments --------------------------------------------


def enrollment_rows(
    matrix: DataFrame, students: DataFrame, periods: DataFrame, period_name: str
) -> DataFrame:
    """Distinct (student, period, grade, track) of the matrix, with label."""
    places = keyed(matrix, "student_name").select("name_key", "grade", "grade_track").distinct()
    ids = students.select(
        name_key(F.col("full_name")).alias("name_key"), F.col("id").alias("student_id")
    )
    rows = places.join(ids, "name_key").select(
        "student_id", "grade", "grade_track",
        grade_label(F.col("grade"), F.col("grade_track")).alias("grade_label"),
        F.lit(None).cast("string").alias("class_letter"),
    )
    return in_period(rows, periods, period_name)


def new_enrollments(
    enrollments: DataFrame, matrix: DataFrame, students: DataFrame, periods: DataFrame,
    period_name: str,
) -> DataFrame:
    """Enrollments to append. The missing class letter compares as a value."""
    rows = enrollment_rows(matrix, students, periods, period_name)
    return absent_rows(enrollments, rows, ENROLLMENT_KEY)


def assignment_rows(
    matrix: DataFrame, students: DataFrame, teachers: DataFrame, periods: DataFrame,
    period_name: str,
) -> DataFrame:
    """The matrix in ids: students by full name, teachers by short name.

    Copies of a matrix row go first, before any join. A teacher may hold much
    of the matrix (the pool of departed staff does); both inputs of that join
    come straight from an exchange, so Spark splits the teacher's rows.
    """
    places = (
        keyed(keyed(matrix, "student_name"), "teacher_name", "teacher_key")
        .select("name_key", "teacher_key", "grade", "grade_track")
        .distinct()
    )
    student_ids = students.select(
        name_key(F.col("full_name")).alias("name_key"), F.col("id").alias("student_id")
    )
    teacher_ids = teachers.select(
        name_key(F.col("short_name")).alias("teacher_key"), F.col("id").alias("teacher_id")
    )
    by_teacher = places.join(teacher_ids, "teacher_key")
    rows = by_teacher.join(student_ids, "name_key").select(
        "student_id", "teacher_id", "grade", "grade_track",
        F.lit("main").alias("assignment_type"),
        F.lit("100.00").cast("decimal(5,2)").alias("share_percent"),
        F.lit(True).alias("is_active"),
    )
    return in_period(rows, periods, period_name)


def new_assignments(
    assignments: DataFrame, matrix: DataFrame, students: DataFrame, teachers: DataFrame,
    periods: DataFrame, period_name: str,
) -> DataFrame:
    rows = assignment_rows(matrix, students, teachers, periods, period_name)
    return absent_rows(assignments, rows, ASSIGNMENT_KEY)


# --- results ----------------------------------------------------------------


def grade_picks(
    students: DataFrame, enrollments: DataFrame, periods: DataFrame, period_name: str
) -> DataFrame:
    """Grade and track a result is booked under, by student.

    Grade 11 on the course track if enrolled there; else the highest grade,
    as ``regular``. The grade is null for a student never enrolled.
    """
    on_course = (F.col("grade") == 11) & (F.col("grade_track") == "course")
    picked = (
        enrollments.where(F.col("academic_period_id") == period_id(periods, period_name))
        .groupBy("student_id")
        .agg(
            F.coalesce(F.max(F.when(on_course, F.col("grade"))), F.max("grade"))
            .alias("picked_grade"),
            max_track(F.when(on_course, F.col("grade_track"))).alias("picked_track"),
        )
    )
    everyone = in_period(students.select(F.col("id").alias("student_id")), periods, period_name)
    return everyone.join(picked, "student_id", "left").select(
        "student_id", "academic_period_id", "picked_grade",
        F.coalesce("picked_track", F.lit("regular")).alias("picked_track"),
    )


def student_bookings(
    students: DataFrame, enrollments: DataFrame, periods: DataFrame, period_name: str
) -> DataFrame:
    """All an import needs to know of a student, by name key: id, picked grade
    and track, and the enrollment of that grade and track or null."""
    picks = grade_picks(students, enrollments, periods, period_name)
    places = enrollments.select(
        "student_id", "academic_period_id",
        F.col("grade").alias("picked_grade"), F.col("grade_track").alias("picked_track"),
        F.col("id").alias("student_enrollment_id"),
    )
    names = students.select(
        F.col("id").alias("student_id"), name_key(F.col("full_name")).alias("name_key")
    )
    booked = picks.join(
        places, ["student_id", "academic_period_id", "picked_grade", "picked_track"], "left"
    )
    return booked.join(names, "student_id")


def import_results(
    staged: DataFrame, students: DataFrame, enrollments: DataFrame, criteria: DataFrame,
    periods: DataFrame, period_name: str, batch: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results to append and rows that break a rule, the latter with ``rules``.

    Staging rows with an unknown student or criterion drop out, as in an inner
    join. The staging rows are shuffled by name once; everything known of the
    student is joined in the one step, in which Spark splits a name that holds
    much of the rows. ``batch`` marks the rows so that a batch
    can be replaced when loaded again.
    """
    bookings = student_bookings(students, enrollments, periods, period_name)
    catalogue = criteria.select(
        F.col("name").alias("criterion_name"), F.col("id").alias("criterion_id"),
        F.col("base_score").alias("listed_score"),
    )
    named = keyed(staged, "student_name").drop("student_name").join(bookings, "name_key")
    rows = named.join(catalogue, "criterion_name").select(
        "row_key", "academic_period_id", "student_id", "student_enrollment_id", "criterion_id",
        F.col("picked_grade").alias("grade_at_result"),
        F.col("picked_track").alias("grade_track"),
        "base_score",
        F.coalesce("dynamic_bonus", F.lit(0)).cast("decimal(12,4)").alias("dynamic_bonus"),
        F.col("criterion_name").alias("raw_result_value"),
        F.lit(None).cast("date").alias("result_date"),
        F.lit(IMPORT_SOURCE).alias("source_type"),
        F.when(F.col("listed_score") != F.col("base_score"), F.lit(COMMENT_MISMATCH))
        .otherwise(F.lit(COMMENT)).alias("comment"),
    )
    rows = rows.withColumn("total_score", total_score())
    if batch is not None:
        rows = rows.withColumn("batch_id", batch)
    return divert(rows, _result_rules(rows))


def total_score() -> Column:
    """Base and bonus together, null where that does not fit its column."""
    return (F.col("base_score") + F.col("dynamic_bonus")).try_cast(
        schemas.RESULTS.column("total_score").type
    )


def _result_rules(rows: DataFrame) -> dict[str, Column]:
    """The rules of the table on the columns an import fills, and that the sum fits."""
    rules = row_rules(schemas.RESULTS, rows, ("required", "checks", "enum", "length"))
    too_large = F.col("base_score").isNotNull() & F.col("total_score").isNull()
    return {**rules, "total_score_precision": too_large}


# --- rows as the tables store them ------------------------------------------


def enrollment_inserts(new: DataFrame, enrollments: DataFrame) -> DataFrame:
    return inserted(new, enrollments, schemas.ENROLLMENTS, ENROLLMENT_KEY)


def assignment_inserts(new: DataFrame, assignments: DataFrame) -> DataFrame:
    return inserted(new, assignments, schemas.ASSIGNMENTS, ASSIGNMENT_KEY)


def result_inserts(loaded: DataFrame, results: DataFrame) -> DataFrame:
    """Imported results; their ids follow the row keys of the staging rows."""
    return inserted(loaded, results, schemas.RESULTS, ["row_key"])
