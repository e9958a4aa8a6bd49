"""The seed data of the model under pseudonyms, S01.. and T01.."""

from meritpool import schemas
from meritpool.sources.tables import Tables, inline_rows, typed_rows

PERIOD = "2024–2026"
TEACHERS = [f"T{i:02d}" for i in range(1, 18)]
DISMISSED = "T17"

# Criteria the staged results name (code, name, base score).
CRITERIA = [
    ("ege_90_100", "ЕГЭ 90–100", "10.0000"),
    ("ege_80_89", "ЕГЭ 80–89", "7.0000"),
    ("ege_70_79", "ЕГЭ 70–79", "5.0000"),
    ("ege_60_69", "ЕГЭ 60–69", "3.0000"),
    ("ege_50_59", "ЕГЭ 50–59", "1.0000"),
]

# Student, criterion, base score, bonus, total.
RESULTS = [
    ("S01", "ЕГЭ 80–89", "10", "1", "11"),
    ("S02", "ЕГЭ 70–79", "8", "0", "8"),
    ("S03", "ЕГЭ 90–100", "12", "4", "16"),
    ("S04", "ЕГЭ 50–59", "4", "4", "8"),
    ("S05", "ЕГЭ 60–69", "6", "4", "10"),
    ("S06", "ЕГЭ 80–89", "10", "1", "11"),
    ("S07", "ЕГЭ 90–100", "12", "2", "14"),
    ("S08", "ЕГЭ 50–59", "4", "2", "6"),
    ("S09", "ЕГЭ 60–69", "6", "2", "8"),
    ("S10", "ЕГЭ 50–59", "4", "3", "7"),
    ("S11", "ЕГЭ 80–89", "10", "2", "12"),
    ("S12", "ЕГЭ 60–69", "6", "0", "6"),
    ("S13", "ЕГЭ 50–59", "4", "0", "4"),
    ("S14", "ЕГЭ 70–79", "8", "0", "8"),
]

# Student, grade, track, teacher.
MATRIX = [
    ("S01", "10", "regular", "T08"),
    ("S01", "11", "course", "T08"),
    ("S01", "11", "practicum", "T08"),
    ("S02", "11", "course", "T04"),
    ("S02", "11", "practicum", "T04"),
    ("S03", "10", "regular", "T08"),
    ("S03", "11", "course", "T08"),
    ("S03", "11", "practicum", "T08"),
    ("S04", "2", "regular", "T17"),
    ("S04", "3", "regular", "T17"),
    ("S04", "4", "regular", "T17"),
    ("S04", "5", "regular", "T17"),
    ("S04", "6", "regular", "T17"),
    ("S04", "7", "regular", "T17"),
    ("S04", "8", "regular", "T17"),
    ("S04", "9", "regular", "T17"),
    ("S04", "10", "regular", "T17"),
    ("S04", "11", "course", "T17"),
    ("S04", "11", "practicum", "T17"),
    ("S05", "2", "regular", "T03"),
    ("S05", "3", "regular", "T03"),
    ("S05", "4", "regular", "T03"),
    ("S05", "5", "regular", "T03"),
    ("S05", "6", "regular", "T03"),
    ("S05", "7", "regular", "T13"),
    ("S05", "8", "regular", "T13"),
    ("S05", "9", "regular", "T13"),
    ("S05", "10", "regular", "T02"),
    ("S05", "11", "course", "T02"),
    ("S05", "11", "practicum", "T08"),
    ("S06", "6", "regular", "T12"),
    ("S06", "7", "regular", "T12"),
    ("S06", "8", "regular", "T12"),
    ("S06", "9", "regular", "T12"),
    ("S06", "10", "regular", "T08"),
    ("S06", "11", "course", "T08"),
    ("S06", "11", "practicum", "T08"),
    ("S07", "5", "regular", "T08"),
    ("S07", "6", "regular", "T08"),
    ("S07", "7", "regular", "T08"),
    ("S07", "8", "regular", "T08"),
    ("S07", "9", "regular", "T08"),
    ("S07", "10", "regular", "T08"),
    ("S07", "11", "course", "T08"),
    ("S07", "11", "practicum", "T08"),
    ("S08", "9", "regular", "T01"),
    ("S09", "10", "regular", "T02"),
    ("S10", "5", "regular", "T08"),
    ("S10", "6", "regular", "T08"),
    ("S10", "7", "regular", "T08"),
    ("S10", "8", "regular", "T08"),
    ("S10", "9", "regular", "T08"),
    ("S11", "9", "regular", "T04"),
    ("S11", "10", "regular", "T08"),
    ("S11", "11", "course", "T08"),
    ("S11", "11", "practicum", "T08"),
    ("S12", "2", "regular", "T06"),
    ("S12", "3", "regular", "T06"),
    ("S12", "4", "regular", "T06"),
    ("S12", "5", "regular", "T06"),
    ("S12", "6", "regular", "T06"),
    ("S12", "9", "regular", "T02"),
    ("S12", "10", "regular", "T08"),
    ("S12", "11", "course", "T08"),
    ("S12", "11", "practicum", "T04"),
    ("S13", "10", "regular", "T04"),
    ("S13", "11", "course", "T04"),
    ("S13", "11", "practicum", "T04"),
    ("S14", "7", "regular", "T07"),
    ("S14", "10", "regular", "T04"),
    ("S14", "11", "course", "T04"),
    ("S14", "11", "practicum", "T08"),
]

# The summary worked out from the rows above. Teacher, students
# with results, all students, raw points, factor, normalised points, share,
# reverse weight, employee share, reverse incentive, normalised fund.
SUMMARY = [
    ("T01", 1, 1, 6, 2.8, 16.8, 0.1475409836, 0.1666666667, 0.4062967197, 400.9905, 145.61),
    ("T02", 2, 3, 18, 1.4, 25.2, 0.2213114754, 0.0555555556, 0.1354322399, 133.6635, 218.42),
    ("T03", 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("T04", 3, 5, 20, 0.933333, 18.666667, 0.1639344262, 0.05, 0.1218890159, 120.2971, 161.79),
    ("T06", 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("T07", 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("T08", 7, 9, 77, 0.4, 30.8, 0.2704918033, 0.012987013, 0.0316594847, 31.2460, 266.96),
    ("T12", 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("T13", 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    ("T17", 1, 1, 8, 2.8, 22.4, 0.1967213115, 0.125, 0.3047225398, 300.7429, 194.15),
]


def base_tables(spark) -> Tables:
    """Periods, staff, criteria and settings; nothing imported yet."""
    return Tables(
        periods=typed_rows(
            spark, schemas.PERIODS, ["id", "name", "date_start", "date_end"],
            [(1, PERIOD, "2024-09-01", "2026-08-31")],
        ),
        students=spark.createDataFrame([], schemas.STUDENTS.struct),
        teachers=typed_rows(
            spark, schemas.TEACHERS, ["id", "full_name", "short_name", "is_dismissed", "dismissed_at"],
            [
                (i, f"{t} full", t, t == DISMISSED, "2024-09-01" if t == DISMISSED else None)
                for i, t in enumerate(TEACHERS, 1)
            ],
        ),
        criteria=typed_rows(
            spark, schemas.CRITERIA, ["id", "criterion_group_id", "code", "name", "base_score"],
            [(i, 1, *c) for i, c in enumerate(CRITERIA, 1)],
        ),
        settings=typed_rows(
            spark, schemas.SETTINGS,
            ["id", "academic_period_id", "total_fund", "dismissed_fund", "uvsotr_value"],
            [(1, 1, "1445.00", "458.06", "30.537000")],
        ),
    )


def staged(spark):
    results = inline_rows(
        spark,
        ["row_key", "student_name", "criterion_name", "base_score", "dynamic_bonus", "total_score"],
        ["string", "string", "string", "decimal(12,4)", "decimal(12,4)", "decimal(12,4)"],
        [(f"r{i}", f" {r[0].lower()} ", *r[1:]) for i, r in enumerate(RESULTS)],
    )
    matrix = inline_rows(
        spark, ["student_name", "grade", "grade_track", "teacher_name"],
        ["string", "smallint", "string", "string"], MATRIX,
    )
    return results, matrix
