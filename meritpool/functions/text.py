"""Names, labels and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that reports and loads must show as they are.
LABEL_GRADE_11_COURSE = "11 (уроки)"
LABEL_GRADE_11_PRACTICUM = "11 (практикумы)"
YES = "Да"
NO = "Нет"
DASH = "—"
NO_BREAK_SPACE = "\u00a0"


def name_key(name: Column) -> Column:
    """Trim blanks, squeeze white space to one blank, lower-case.

    ``trim`` takes off blanks only; a tab at the edge becomes a blank.
    White space is the ASCII set.
    """
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def contains_text(column: Column, query: str | None) -> Column:
    """Case-blind search; an empty query keeps every row."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return F.lit(True)
    return F.lower(column).contains(wanted)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def grade_label(grade: Column, track: Column) -> Column:
    return (
        F.when((grade == 11) & (track == "course"), F.lit(LABEL_GRADE_11_COURSE))
        .when((grade == 11) & (track == "practicum"), F.lit(LABEL_GRADE_11_PRACTICUM))
        .otherwise(grade.cast("string"))
    )


def number_text(number: Column) -> Column:
    """At most four decimals, comma as decimal sign, no-break space between
    thousands, dash for null. ``format_number`` rounds half to even, so the
    rounding is done before it, half away from zero."""
    shown = F.call_function("format_number", F.round(number, 4), F.lit("#,##0.####"))
    return F.coalesce(F.translate(shown, ",.", NO_BREAK_SPACE + ","), F.lit(DASH))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit(YES)).otherwise(F.lit(NO))


def text_or_dash(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(DASH))


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
