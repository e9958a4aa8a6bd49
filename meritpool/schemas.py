"""Table definitions: columns, defaults, generated columns and validity rules.

Types are Spark DDL. ``length`` is the longest text a column takes, ``enum``
names the list of words it takes. Rules are SQL conditions; as in SQL a row
breaks a rule only where the condition is false, not where it is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The words of the two enums, in declaration order.
TRACKS = ("regular", "course", "practicum")
ASSIGNMENT_TYPES = ("main", "co_teacher", "curator", "other")

# Fixed value: the pool that stands for all departed staff.
DEPARTED_POOL = "Уволившиеся"

ENUMS = {"track": TRACKS, "assignment_type": ASSIGNMENT_TYPES}

# Trim blanks, squeeze white space, lower-case.
NAME_KEY_SQL = r"lower(regexp_replace(trim({}), '\\s+', ' '))"


_PLAIN_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(),
    "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def data_type(name: str) -> T.DataType:
    """The type of a column by its name; works without a session."""
    if name.startswith("decimal("):
        precision, scale = name.removeprefix("decimal(").rstrip(")").split(",")
        return T.DecimalType(int(precision), int(scale))
    return _PLAIN_TYPES[name]


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool = False
    default: str | None = None
    generated: str | None = None
    length: int | None = None
    enum: str | None = None


@dataclass(frozen=True)
class Reference:
    column: str
    table: str
    on_delete: str  # cascade, restrict or set_null


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, data_type(c.type)) for c in self.columns]
        )


def _id() -> Column:
    return Column("id", "bigint", required=True)


def _stamps() -> tuple[Column, ...]:
    return tuple(
        Column(n, "timestamp", required=True, default="current_timestamp()")
        for n in ("created_at", "updated_at")
    )


def _link(name: str, required: bool = True) -> Column:
    return Column(name, "bigint", required=required)


def _text(name: str, length: int | None = None, required: bool = False) -> Column:
    return Column(name, "string", required=required, length=length)


def _track() -> Column:
    return Column("grade_track", "string", required=True, default="'regular'", enum="track")


def _grade(name: str = "grade") -> Column:
    return Column(name, "smallint", required=True)


def _flag(name: str, default: str) -> Column:
    return Column(name, "boolean", required=True, default=default)


def _share(name: str = "share_percent") -> Column:
    return Column(name, "decimal(5,2)", required=True, default="100.00")


def _grade_rule(name: str = "grade") -> dict[str, str]:
    return {f"{name}_range": f"{name} between 2 and 11"}


def _share_rule(name: str = "share_percent") -> dict[str, str]:
    return {f"{name}_range": f"{name} > 0 and {name} <= 100"}


def _not_negative(*names: str) -> dict[str, str]:
    return {f"{n}_not_negative": f"{n} >= 0" for n in names}


PERIODS = Table(
    "academic_periods",
    (
        _id(),
        _text("name", 100, required=True),
        Column("date_start", "date", required=True),
        Column("date_end", "date", required=True),
        _flag("is_closed", "false"),
        *_stamps(),
    ),
    checks={"dates_in_order": "date_end >= date_start"},
    unique=(("name",),),
)

STUDENTS = Table(
    "students",
    (
        _id(),
        _text("full_name", 255, required=True),
        _text("last_name", 100),
        _text("first_name", 100),
        _text("middle_name", 100),
        Column(
            "full_name_normalized", "string", length=255,
            generated=NAME_KEY_SQL.format("full_name"),
        ),
        Column("birth_date", "date"),
        _flag("is_active", "true"),
        *_stamps(),
    ),
)

TEACHERS = Table(
    "teachers",
    (
        _id(),
        _text("full_name", 255, required=True),
        _text("short_name", 150),
        Column(
            "full_name_normalized", "string", length=255,
            generated=NAME_KEY_SQL.format("full_name"),
        ),
        _flag("is_dismissed", "false"),
        Column("dismissed_at", "date"),
        _text("comment"),
        *_stamps(),
    ),
    checks={
        "dismissal_dated": "not is_dismissed or dismissed_at is not null "
        f"or full_name = '{DEPARTED_POOL}'"
    },
)

ENROLLMENTS = Table(
    "student_enrollments",
    (
        _id(),
        _link("student_id"),
        _link("academic_period_id"),
        _grade(),
        _text("grade_label", 50),
        _text("class_letter", 10),
        _track(),
        *_stamps(),
    ),
    checks=_grade_rule(),
    unique=(("student_id", "academic_period_id", "grade", "grade_track", "class_letter"),),
    references=(
        Reference("student_id", "students", "cascade"),
        Reference("academic_period_id", "academic_periods", "cascade"),
    ),
)

GROUPS = Table(
    "criterion_groups",
    (
        _id(),
        _text("code", 50, required=True),
        _text("name", 255, required=True),
        _text("description"),
        Column("sort_order", "int", required=True, default="0"),
        *_stamps(),
    ),
    unique=(("code",),),
)

CRITERIA = Table(
    "criteria",
    (
        _id(),
        _link("criterion_group_id"),
        _text("code", 100),
        _text("name", 255, required=True),
        _text("raw_value_label", 100),
        Column("base_score", "decimal(12,4)", required=True),
        Column("max_dynamic_bonus", "decimal(12,4)"),
        _flag("is_active", "true"),
        Column("sort_order", "int", required=True, default="0"),
        *_stamps(),
    ),
    checks=_not_negative("base_score", "max_dynamic_bonus"),
    unique=(("code",),),
    references=(Reference("criterion_group_id", "criterion_groups", "restrict"),),
)

WEIGHTS = Table(
    "criterion_grade_weights",
    (
        _id(),
        _link("criterion_id"),
        _grade(),
        _track(),
        Column("weight_value", "decimal(12,6)", required=True),
        *_stamps(),
    ),
    checks={**_grade_rule(), **_not_negative("weight_value")},
    unique=(("criterion_id", "grade", "grade_track"),),
    references=(Reference("criterion_id", "criteria", "cascade"),),
)

ASSIGNMENTS = Table(
    "student_teacher_assignments",
    (
        _id(),
        _link("student_id"),
        _link("teacher_id"),
        _link("academic_period_id"),
        _grade(),
        _track(),
        Column(
            "assignment_type", "string", required=True, default="'main'",
            enum="assignment_type",
        ),
        _share(),
        _flag("is_active", "true"),
        *_stamps(),
    ),
    checks={**_grade_rule(), **_share_rule()},
    unique=(
        (
            "student_id", "teacher_id", "academic_period_id",
            "grade", "grade_track", "assignment_type",
        ),
    ),
    references=(
        Reference("student_id", "students", "cascade"),
        Reference("teacher_id", "teachers", "restrict"),
        Reference("academic_period_id", "academic_periods", "cascade"),
    ),
)

RESULTS = Table(
    "student_results",
    (
        _id(),
        _link("academic_period_id"),
        _link("student_id"),
        _link("student_enrollment_id", required=False),
        _link("criterion_id"),
        _grade("grade_at_result"),
        _track(),
        Column("base_score", "decimal(12,4)", required=True),
        Column("dynamic_bonus", "decimal(12,4)", required=True, default="0"),
        Column(
            "total_score", "decimal(12,4)",
            generated="cast(base_score + dynamic_bonus as decimal(12,4))",
        ),
        _text("raw_result_value", 100),
        Column("result_date", "date"),
        _text("source_type", 50),
        _text("comment"),
        _link("created_by_user_id", required=False),
        *_stamps(),
    ),
    checks={**_grade_rule("grade_at_result"), **_not_negative("base_score", "dynamic_bonus")},
    references=(
        Reference("academic_period_id", "academic_periods", "cascade"),
        Reference("student_id", "students", "cascade"),
        Reference("student_enrollment_id", "student_enrollments", "set_null"),
        Reference("criterion_id", "criteria", "restrict"),
    ),
)

LINKS = Table(
    "student_result_teacher_links",
    (
        _id(),
        _link("student_result_id"),
        _link("teacher_id"),
        _share(),
        Column("score_assigned", "decimal(12,4)", required=True),
        *_stamps(),
    ),
    checks={**_share_rule(), **_not_negative("score_assigned")},
    unique=(("student_result_id", "teacher_id"),),
    references=(
        Reference("student_result_id", "student_results", "cascade"),
        Reference("teacher_id", "teachers", "restrict"),
    ),
)

SETTINGS = Table(
    "calculation_settings",
    (
        _id(),
        _link("academic_period_id"),
        Column("total_fund", "decimal(14,2)", required=True),
        Column("total_points_sum", "decimal(14,4)"),
        Column("dismissed_fund", "decimal(14,2)", required=True, default="0"),
        Column("uvsotr_value", "decimal(14,6)"),
        Column("avg_group_size", "decimal(12,4)"),
        _flag("normalization_enabled", "true"),
        _flag("reverse_weight_enabled", "true"),
        _text("comment"),
        *_stamps(),
    ),
    checks=_not_negative(
        "total_fund", "total_points_sum", "dismissed_fund", "uvsotr_value", "avg_group_size"
    ),
    unique=(("academic_period_id",),),
    references=(Reference("academic_period_id", "academic_periods", "cascade"),),
)

CALCULATIONS = Table(
    "teacher_calculations",
    (
        _id(),
        _link("academic_period_id"),
        _link("teacher_id"),
        Column("raw_points", "decimal(14,4)", required=True, default="0"),
        Column("normalized_points", "decimal(14,4)"),
        Column("reverse_weight", "decimal(18,10)"),
        Column("employee_share", "decimal(18,10)"),
        Column("uvsotr_amount", "decimal(14,4)"),
        Column("final_amount", "decimal(14,2)", required=True, default="0"),
        Column("student_count_with_results", "int"),
        Column("total_student_count", "int"),
        Column("avg_group_ratio", "decimal(14,6)"),
        _flag("is_dismissed_snapshot", "false"),
        Column("calculated_at", "timestamp", required=True, default="current_timestamp()"),
        *_stamps(),
    ),
    checks=_not_negative(
        "raw_points", "normalized_points", "reverse_weight", "employee_share",
        "uvsotr_amount", "final_amount", "student_count_with_results", "total_student_count",
    ),
    unique=(("academic_period_id", "teacher_id"),),
    references=(
        Reference("academic_period_id", "academic_periods", "cascade"),
        Reference("teacher_id", "teachers", "restrict"),
    ),
)

ITEMS = Table(
    "teacher_calculation_items",
    (
        _id(),
        _link("teacher_calculation_id"),
        _link("student_result_id"),
        _link("student_id"),
        Column("base_points", "decimal(12,4)", required=True),
        Column("normalized_points", "decimal(12,4)"),
        _share("applied_share_percent"),
        Column("final_points_to_teacher", "decimal(12,4)", required=True),
        *_stamps(),
    ),
    checks={
        **_not_negative("base_points", "normalized_points", "final_points_to_teacher"),
        **_share_rule("applied_share_percent"),
    },
    unique=(("teacher_calculation_id", "student_result_id"),),
    references=(
        Reference("teacher_calculation_id", "teacher_calculations", "cascade"),
        Reference("student_result_id", "student_results", "cascade"),
        Reference("student_id", "students", "cascade"),
    ),
)

LOG = Table(
    "audit_log",
    (
        _id(),
        _text("actor_name", required=True),
        _text("actor_role", required=True),
        _text("action_type", required=True),
        _text("entity_type", required=True),
        _text("entity_id"),
        _text("details"),
        Column("created_at", "timestamp", required=True, default="current_timestamp()"),
    ),
)

STAGED_RESULTS = Table(
    "stg_student_results",
    (
        _text("student_name", required=True),
        _text("criterion_name", required=True),
        Column("base_score", "decimal(12,4)", required=True),
        Column("dynamic_bonus", "decimal(12,4)"),
        Column("total_score", "decimal(12,4)"),
    ),
)

STAGED_MATRIX = Table(
    "stg_student_teacher_matrix",
    (
        _text("student_name", required=True),
        _grade(),
        Column("grade_track", "string", required=True, enum="track"),
        _text("teacher_name", required=True),
    ),
)

ALL = {
    t.name: t
    for t in (
        PERIODS, STUDENTS, TEACHERS, ENROLLMENTS, GROUPS, CRITERIA, WEIGHTS, ASSIGNMENTS,
        RESULTS, LINKS, SETTINGS, CALCULATIONS, ITEMS, LOG, STAGED_RESULTS, STAGED_MATRIX,
    )
}
