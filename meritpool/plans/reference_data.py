"""Loads of reference data: periods, groups, criteria, weights, settings, staff.

Every load may be run again: the second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.functions.text import name_key
from meritpool.operators.inserts import inserted, with_new_ids
from meritpool.operators.merge import absent_rows, upsert


def new_periods(periods: DataFrame, given: DataFrame) -> DataFrame:
    """Periods to append: those whose name is not there yet."""
    return absent_rows(periods, given, ["name"])


def merged_groups(groups: DataFrame, given: DataFrame, touched_at: Column | None = None) -> DataFrame:
    return upsert(groups, given, ["code"], ["name", "description", "sort_order"], touched_at)


def merged_criteria(
    criteria: DataFrame, given: DataFrame, groups: DataFrame, touched_at: Column | None = None
) -> DataFrame:
    """Criteria after a load keyed by code; the group is looked up by its code
    and rows of an unknown group are left out. The largest bonus of a known
    criterion stays as it is."""
    ids = groups.select(F.col("code").alias("group_code"), F.col("id").alias("criterion_group_id"))
    linked = given.join(ids, "group_code").drop("group_code")
    return upsert(
        criteria, linked, ["code"],
        ["criterion_group_id", "name", "raw_value_label", "base_score", "is_active", "sort_order"],
        touched_at,
    )


def linked_weights(given: DataFrame, criteria: DataFrame) -> DataFrame:
    """Weights with the id of their criterion, looked up by code."""
    ids = criteria.select("code", F.col("id").alias("criterion_id"))
    return given.join(ids, "code").select("criterion_id", "grade", "grade_track", "weight_value")


def merged_weights(
    weights: DataFrame, given: DataFrame, criteria: DataFrame, touched_at: Column | None = None
) -> DataFrame:
    return upsert(
        weights, linked_weights(given, criteria),
        ["criterion_id", "grade", "grade_track"], ["weight_value"], touched_at,
    )


def merged_settings(
    settings: DataFrame, given: DataFrame, periods: DataFrame, touched_at: Column | None = None
) -> DataFrame:
    """Settings after a load keyed by period name; unknown periods are left out."""
    ids = periods.select(F.col("name").alias("period_name"), F.col("id").alias("academic_period_id"))
    linked = given.join(ids, "period_name").drop("period_name")
    overwritten = [c for c in linked.columns if c != "academic_period_id"]
    return upsert(settings, linked, ["academic_period_id"], overwritten, touched_at)


def new_teachers(teachers: DataFrame, given: DataFrame) -> DataFrame:
    """Teachers to append: those whose full name, as a key, is not there yet.

    A plain insert would add everybody again on the second run, as names carry
    no unique rule; here the name key decides.
    """
    known = teachers.select(name_key(F.col("full_name")).alias("name_key"))
    keyed = given.withColumn("name_key", name_key(F.col("full_name")))
    return absent_rows(known, keyed, ["name_key"]).drop("name_key")


# --- rows as the tables store them ------------------------------------------


def period_inserts(periods: DataFrame, given: DataFrame) -> DataFrame:
    return inserted(new_periods(periods, given), periods, schemas.PERIODS, ["name"])


def teacher_inserts(teachers: DataFrame, given: DataFrame) -> DataFrame:
    return inserted(new_teachers(teachers, given), teachers, schemas.TEACHERS, ["full_name"])


def numbered_groups(merged: DataFrame, groups: DataFrame) -> DataFrame:
    return with_new_ids(merged, groups, schemas.GROUPS, ["code"])


def numbered_criteria(merged: DataFrame, criteria: DataFrame) -> DataFrame:
    return with_new_ids(merged, criteria, schemas.CRITERIA, ["code"])


def numbered_weights(merged: DataFrame, weights: DataFrame) -> DataFrame:
    key = ["criterion_id", "grade", "grade_track"]
    return with_new_ids(merged, weights, schemas.WEIGHTS, key)


def numbered_settings(merged: DataFrame, settings: DataFrame) -> DataFrame:
    return with_new_ids(merged, settings, schemas.SETTINGS, ["academic_period_id"])
