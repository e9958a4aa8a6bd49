"""The registered queries as plain SQL over the star schema.

Written for DuckDB, each from the meaning of the query and not from the Spark
plan: raw joins where Spark adds up first, window totals where Spark joins
totals back. Output columns are rounded like ``meritpool.catalog.plain``.
"""

from __future__ import annotations

import re

from meritpool import schemas
from meritpool.catalog.plain import digits
from meritpool.plans import reports

ORACLE: dict[str, str] = {}

# Fixed values, written out so that the SQL does not follow the code it checks.
DASH = "—"
YES = "Да"
NO = "Нет"
LABEL_COURSE = "11 (уроки)"
LABEL_PRACTICUM = "11 (практикумы)"
IMPORT_SOURCE = "excel_import"
COMMENT_MISMATCH = (
    "Импорт из Excel: base_score в строке Excel не совпадает со справочником criteria"
)
COMMENT = "Импорт из Excel"

YEAR = 1997
LOAD = 1998


def num(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits(name)}) AS {name}"


def day(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name}"


def moment(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


def key(expression: str) -> str:
    return f"lower(regexp_replace(trim({expression}), '\\s+', ' ', 'g'))"


def shown(expression: str) -> str:
    """Number text: four decimals at most, no-break spaces, comma, dash."""
    r = f"round(CAST({expression} AS DECIMAL(30,8)), 4)"
    cents = f"CAST(abs({r} - trunc({r})) * 10000 AS BIGINT)"
    fraction = f"rtrim(lpad(CAST({cents} AS VARCHAR), 4, '0'), '0')"
    whole = f"replace(format('{{:,}}', CAST(trunc({r}) AS BIGINT)), ',', chr(160))"
    return (
        f"CASE WHEN {expression} IS NULL THEN '{DASH}' WHEN {fraction} = '' THEN {whole} "
        f"ELSE {whole} || ',' || {fraction} END"
    )


CTE = {
    "lines": """
      SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber,
               l_partkey, l_suppkey,
               date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS line_key,
             l_orderkey, CAST(year(o_orderdate) AS BIGINT) AS yr, o_custkey AS cust,
             l_suppkey AS supp, l_partkey AS part, l_linenumber + 4 AS grade,
             CASE l_returnflag WHEN 'N' THEN 'regular' WHEN 'A' THEN 'course'
               ELSE 'practicum' END AS track,
             CAST(l_quantity AS DECIMAL(12,4)) AS base,
             CAST(l_discount * 100 AS DECIMAL(12,4)) AS bonus,
             CAST(l_shipdate AS DATE) AS ship_day, l_linestatus AS st, l_returnflag AS flag,
             l_tax AS tax, l_quantity AS qty
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "taught": """
      SELECT cust, supp, yr, grade, track, bool_or(st = 'O') AS is_active,
             CAST(25 * (1 + supp % 4) AS DECIMAL(5,2)) AS share
      FROM lines GROUP BY cust, supp, yr, grade, track""",
    "placed": """
      SELECT DISTINCT cust, yr, grade, track,
             concat_ws('-', cust, yr, grade, track) AS id
      FROM lines""",
    "broke": "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0",
    "funds": """
      SELECT CAST(year(o_orderdate) AS BIGINT) AS yr,
             sum(CAST(o_totalprice AS DECIMAL(14,2))) AS total_fund,
             sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (o_orderstatus = 'F') AS dismissed_fund,
             count(*) AS uvsotr_value
      FROM orders GROUP BY 1""",
    "hits": """
      SELECT t.yr, t.supp, t.cust, sum((l.base + l.bonus) * t.share) / 100 AS pts
      FROM taught t JOIN lines l
        ON l.yr = t.yr AND l.cust = t.cust AND l.grade = t.grade AND l.track = t.track
      WHERE t.is_active GROUP BY t.yr, t.supp, t.cust""",
    "counted": """
      SELECT t.yr, t.supp, count(DISTINCT t.cust) AS all_students,
             count(DISTINCT h.cust) AS n, coalesce(any_value(p.pts), 0) AS pts
      FROM taught t
      LEFT JOIN hits h ON h.yr = t.yr AND h.supp = t.supp AND h.cust = t.cust
      LEFT JOIN (SELECT yr, supp, sum(pts) AS pts FROM hits GROUP BY yr, supp) p
        ON p.yr = t.yr AND p.supp = t.supp
      WHERE t.is_active GROUP BY t.yr, t.supp""",
    "evened": """
      SELECT *, CASE WHEN n > 0 THEN grp / n ELSE 0 END AS factor,
             CASE WHEN n > 0 THEN pts * (grp / n) ELSE 0 END AS npts,
             CASE WHEN pts > 0 THEN 1 / pts ELSE 0 END AS rw
      FROM (SELECT *, avg(n) FILTER (n > 0) OVER (PARTITION BY yr) AS grp FROM counted)""",
    "totalled": """
      SELECT *, sum(npts) OVER (PARTITION BY yr) AS all_npts,
             sum(rw) OVER (PARTITION BY yr) AS all_rw
      FROM evened""",
    "summed": """
      SELECT e.yr, e.supp, CAST(e.yr AS VARCHAR) AS academic_period, s_name AS teacher_name,
             'S. ' || right(s_name, 9) AS teacher_short_name, s_acctbal < 0 AS is_dismissed,
             n AS student_count_with_results, all_students AS total_student_count,
             grp AS avg_group_size, pts AS raw_points, factor AS normalization_factor,
             npts AS normalized_points,
             CASE WHEN all_npts > 0 THEN npts / all_npts ELSE 0 END AS normalized_share_percent,
             rw AS reverse_weight, all_rw AS total_reverse_weight,
             CASE WHEN all_rw > 0 THEN rw / all_rw ELSE 0 END AS employee_share,
             total_fund, dismissed_fund,
             coalesce(total_fund, 0) - coalesce(dismissed_fund, 0) AS left_fund,
             CASE WHEN f.yr IS NOT NULL THEN left_fund END AS distributable_fund,
             uvsotr_value,
             CASE WHEN all_rw > 0 THEN distributable_fund * (rw / all_rw) END
               AS reverse_incentive_amount,
             CASE WHEN all_npts > 0 THEN distributable_fund * (npts / all_npts) END
               AS normalized_fund_amount
      FROM totalled e JOIN supplier ON s_suppkey = e.supp LEFT JOIN funds f ON f.yr = e.yr""",
    "results": """
      SELECT line_key AS id, yr AS academic_period_id, cust AS student_id,
             concat_ws('-', cust, yr, grade, track) AS student_enrollment_id,
             part AS criterion_id, grade AS grade_at_result, track AS grade_track,
             base AS base_score, bonus AS dynamic_bonus, base + bonus AS total_score,
             flag AS raw_result_value, CASE WHEN st = 'F' THEN ship_day END AS result_date,
             'excel_import' AS source_type, CAST(NULL AS VARCHAR) AS comment
      FROM lines""",
    "people": "SELECT c_custkey AS id, replace(c_name, '#', ' ') AS full_name, c_acctbal >= 0 AS known FROM customer",
    "marks": """
      SELECT p_partkey AS id, 'c' || p_partkey AS code, concat_ws(' ', p_name, p_partkey) AS name,
             CAST(p_size AS DECIMAL(12,4)) AS base_score, p_size <= 45 AS is_active,
             p_size AS sort_order
      FROM part""",
    "listed": """
      SELECT r.*, p.full_name AS student_name, m.name AS criterion_name
      FROM results r JOIN people p ON p.id = r.student_id JOIN marks m ON m.id = r.criterion_id""",
    "stored": """
      SELECT concat_ws('-', yr, supp) AS id, yr, supp, sum(base + bonus) AS points,
             count(DISTINCT cust) AS students, max(ship_day) AS last_day
      FROM lines GROUP BY yr, supp""",
    "history": """
      SELECT concat_ws('-', yr, supp, track) AS id, yr, supp, sum(base + bonus) AS points,
             count(DISTINCT cust) AS students, max(ship_day) AS last_day
      FROM lines GROUP BY yr, supp, track""",
    "latest": """
      SELECT * FROM history
      QUALIFY row_number() OVER (PARTITION BY yr, supp ORDER BY last_day DESC, id DESC) = 1""",
    "named": """
      SELECT l.*, CASE flag WHEN 'R' THEN '  ' || upper(full_name)
                   WHEN 'A' THEN replace(full_name, ' ', '   ') || ' '
                   ELSE full_name END AS student_name
      FROM lines l JOIN people p ON p.id = l.cust""",
    "matrix": f"""
      SELECT DISTINCT {key("student_name")} AS who, grade, track,
             {key("CASE WHEN st = 'O' THEN ' s.   ' ELSE 'S. ' END || lpad(CAST(supp AS VARCHAR), 9, '0')")}
               AS teacher
      FROM named""",
    "picks": f"""
      SELECT p.id AS student_id, p.full_name,
             coalesce(max(e.grade) FILTER (e.grade = 11 AND e.track = 'course'), max(e.grade))
               AS picked_grade,
             CASE WHEN bool_or(e.grade = 11 AND e.track = 'course') THEN 'course'
               ELSE 'regular' END AS picked_track
      FROM people p LEFT JOIN placed e ON e.cust = p.id AND e.yr = {LOAD}
      GROUP BY p.id, p.full_name""",
    "booked": f"""
      SELECT l.line_key AS row_key, {LOAD} AS academic_period_id, p.student_id,
             e.id AS student_enrollment_id, m.id AS criterion_id,
             p.picked_grade AS grade_at_result, p.picked_track AS grade_track,
             l.base AS base_score, coalesce(nullif(l.bonus, 0), 0) AS dynamic_bonus,
             m.name AS raw_result_value, CAST(NULL AS VARCHAR) AS result_date,
             '{IMPORT_SOURCE}' AS source_type,
             CASE WHEN m.base_score <> l.base THEN '{COMMENT_MISMATCH}'
               ELSE '{COMMENT}' END AS comment,
             l.base + l.bonus AS total_score
      FROM named l
      JOIN picks p ON {key("p.full_name")} = {key("l.student_name")}
      JOIN marks m ON m.id = l.part
      LEFT JOIN placed e ON e.cust = p.student_id AND e.yr = {LOAD}
        AND e.grade = p.picked_grade AND e.track = p.picked_track""",
    "asked": """
      SELECT line_key AS change_id,
             CASE WHEN qty = 49 THEN 'merge' WHEN flag = 'R' THEN 'delete'
               WHEN flag = 'A' THEN 'update' ELSE 'create' END AS op,
             CASE WHEN qty = 31 THEN 'x' ELSE '' END
               || min(line_key) OVER (PARTITION BY l_orderkey) AS result_id,
             CASE WHEN tax <> 0.01 THEN cust END AS student_id,
             CASE WHEN qty = 5 THEN -1 ELSE part END AS criterion_id,
             CASE WHEN qty = 7 THEN 0 ELSE grade END AS grade,
             CASE WHEN qty = 11 THEN 'evening' ELSE track END AS track,
             CASE WHEN qty = 13 THEN 'n/a' WHEN bonus = 0 THEN '' ELSE CAST(bonus AS VARCHAR) END
               AS bonus_text,
             CASE WHEN st = 'O' THEN '' ELSE flag END AS value_text,
             CASE WHEN qty = 17 THEN 'bad' WHEN st = 'O' THEN ''
               ELSE strftime(ship_day, '%Y-%m-%d') END AS date_text,
             CASE WHEN st = 'O' THEN '' ELSE 'checked' END AS comment_text,
             CASE WHEN st <> 'O' THEN 'user-' || supp END AS actor
      FROM lines""",
    "ruled": """
      SELECT *, concat_ws(',',
        CASE WHEN op = 'merge' THEN 'op_known' END,
        CASE WHEN op = 'create' AND (student_id IS NULL OR student_id = 0 OR criterion_id = 0
               OR grade = 0) THEN 'fields_required' END,
        CASE WHEN op = 'update' AND student_id IS NULL THEN 'not_null' END,
        CASE WHEN op <> 'delete' AND grade NOT BETWEEN 2 AND 11 THEN 'grade_range' END,
        CASE WHEN op <> 'delete' AND track NOT IN ('regular', 'course', 'practicum')
          THEN 'track_word' END,
        CASE WHEN op <> 'delete' AND bonus_text <> ''
               AND try_cast(bonus_text AS DECIMAL(12,4)) IS NULL THEN 'bonus_number' END,
        CASE WHEN op <> 'delete' AND date_text <> '' AND try_cast(date_text AS DATE) IS NULL
          THEN 'date_valid' END) AS own_rules
      FROM asked""",
    "judged": """
      SELECT r.*, e.academic_period_id AS result_period, m.base_score AS listed_score,
        CASE WHEN own_rules <> '' THEN own_rules ELSE concat_ws(',',
          CASE WHEN op <> 'delete' AND m.id IS NULL THEN 'criterion_known' END,
          CASE WHEN op <> 'delete' AND p.id IS NULL THEN 'student_known' END,
          CASE WHEN op <> 'create' AND (e.id IS NULL OR change_id > (
                 SELECT min(d.change_id) FROM ruled d
                 WHERE d.op = 'delete' AND d.own_rules = '' AND d.result_id = r.result_id))
            THEN 'result_known' END) END AS rules
      FROM ruled r LEFT JOIN results e ON e.id = r.result_id
      LEFT JOIN marks m ON m.id = r.criterion_id LEFT JOIN people p ON p.id = r.student_id""",
    "written": f"""
      SELECT j.*, coalesce(result_period, {LOAD}) AS home,
             coalesce(try_cast(nullif(bonus_text, '') AS DECIMAL(12,4)), 0) AS bonus_given
      FROM judged j WHERE rules = '' AND op <> 'delete'
      QUALIFY op = 'create'
        OR row_number() OVER (PARTITION BY op, result_id ORDER BY change_id DESC) = 1""",
    "rows_written": """
      SELECT w.op, w.change_id, w.result_id, CASE op WHEN 'create' THEN %d ELSE home END
               AS academic_period_id,
             student_id, n.id AS student_enrollment_id, criterion_id, w.grade AS grade_at_result,
             w.track AS grade_track, listed_score AS base_score, bonus_given AS dynamic_bonus,
             listed_score + bonus_given AS total_score, nullif(value_text, '') AS raw_result_value,
             nullif(date_text, '') AS result_date,
             CASE op WHEN 'create' THEN 'web_form' ELSE 'web_form_edit' END AS source_type,
             nullif(comment_text, '') AS comment
      FROM written w LEFT JOIN placed n ON n.cust = w.student_id AND n.grade = w.grade
        AND n.track = w.track AND n.yr = CASE op WHEN 'create' THEN %d ELSE home END"""
    % (LOAD, LOAD),
    "gone": "SELECT DISTINCT result_id AS id FROM judged WHERE rules = '' AND op = 'delete'",
    "faulty": """
      SELECT line_key AS id, yr, CASE WHEN qty <> 3 THEN cust END AS student_id,
             CASE WHEN qty = 2 THEN -1 ELSE part END AS criterion_id,
             CASE WHEN tax = 0.08 THEN grade + 3 ELSE grade END AS grade,
             CASE WHEN qty = 11 THEN 'evening' ELSE track END AS track,
             CASE WHEN qty = 50 THEN -base ELSE base END AS base,
             CASE WHEN tax <> 0 THEN bonus END AS bonus,
             CASE WHEN qty = 1 THEN repeat('x', 101) ELSE flag END AS raw_value
      FROM lines""",
}

NEEDS = {
    "taught": ["lines"], "placed": ["lines"], "hits": ["taught"], "counted": ["hits"],
    "evened": ["counted"], "totalled": ["evened"], "summed": ["totalled", "funds"],
    "results": ["lines"], "listed": ["results", "people", "marks"], "stored": ["lines"],
    "history": ["lines"], "latest": ["history"], "named": ["lines", "people"],
    "matrix": ["named"], "picks": ["people", "placed"], "booked": ["named", "picks", "marks"],
    "asked": ["lines"], "ruled": ["asked"], "judged": ["ruled", "results", "people", "marks"],
    "written": ["judged"], "rows_written": ["written", "placed"], "gone": ["judged"],
    "faulty": ["lines"],
}


def ask(name: str, body: str, *parts: str) -> None:
    """Register SQL made of the named parts, those they need, and a body."""
    order: list[str] = []

    def visit(part: str) -> None:
        for needed in NEEDS.get(part, []):
            visit(needed)
        if part not in order:
            order.append(part)

    for part in parts:
        visit(part)
    heads = ",\n".join(f"{p} AS MATERIALIZED ({CTE[p]})" for p in order)
    ORACLE[name] = f"WITH {heads}\n{body}" if heads else body


# --- scoring and allocation -------------------------------------------------

SUMMARY = ", ".join(
    [
        "academic_period", "teacher_name", "teacher_short_name", "is_dismissed",
        "student_count_with_results", "total_student_count",
        *[
            num(c, c)
            for c in (
                "avg_group_size", "raw_points", "normalization_factor", "normalized_points",
                "normalized_share_percent", "reverse_weight", "total_reverse_weight",
                "employee_share", "total_fund", "dismissed_fund", "distributable_fund",
                "uvsotr_value", "reverse_incentive_amount", "normalized_fund_amount",
            )
        ],
    ]
)
REPORT_COLUMNS = [
    "academic_period", "teacher_name", "teacher_short_name", "is_dismissed",
    "student_count_with_results", "total_student_count",
]
REPORT_NUMBERS = [
    "raw_points", "normalization_factor", "normalized_points", "normalized_share_percent",
    "reverse_weight", "employee_share", "total_fund", "dismissed_fund", "distributable_fund",
    "uvsotr_value", "reverse_incentive_amount", "normalized_fund_amount",
]
REPORT = ", ".join(REPORT_COLUMNS + [num(c, c) for c in REPORT_NUMBERS])
IDS = "yr AS academic_period_id, supp AS teacher_id"

ask("teacher_summary", f"SELECT {SUMMARY} FROM summed", "summed")
ask("summary_one_period", f"SELECT {SUMMARY} FROM summed WHERE yr = {YEAR}", "summed")
ask(
    "summary_scope",
    f"SELECT {IDS}, cust AS student_id, grade, track AS grade_track, "
    f"{num('share', 'share_percent')} FROM taught WHERE is_active",
    "taught",
)
ask(
    "scores_by_match",
    "SELECT yr AS academic_period_id, cust AS student_id, grade, track AS grade_track, "
    f"{num('sum(base + bonus)', 'score')} FROM lines GROUP BY yr, cust, grade, track",
    "lines",
)
ask(
    "points_by_student",
    f"SELECT {IDS}, cust AS student_id, {num('pts', 'raw_points_by_student')} FROM hits",
    "hits",
)
ask(
    "teacher_points",
    f"SELECT {IDS}, count(*) AS student_count_with_results, {num('sum(pts)', 'raw_points')} "
    "FROM hits GROUP BY yr, supp",
    "hits",
)
ask(
    "total_students",
    f"SELECT {IDS}, count(DISTINCT cust) AS total_student_count FROM taught WHERE is_active "
    "GROUP BY yr, supp",
    "taught",
)
COUNTED = f"{IDS}, n AS student_count_with_results, all_students AS total_student_count"
ask("scope_join", f"SELECT {COUNTED}, {num('pts', 'raw_points')} FROM counted", "counted")
ask(
    "avg_group",
    f"SELECT yr AS academic_period_id, {num('avg(n) FILTER (n > 0)', 'avg_group_size')} "
    "FROM counted GROUP BY yr",
    "counted",
)
ask(
    "normalized",
    f"SELECT {COUNTED}, {num('pts', 'raw_points')}, {num('grp', 'avg_group_size')}, "
    f"{num('factor', 'normalization_factor')}, {num('npts', 'normalized_points')} FROM evened",
    "evened",
)
ask(
    "reverse_weights",
    f"SELECT {IDS}, {num('npts', 'normalized_points')}, "
    f"{num('all_npts', 'total_normalized_points')}, {num('rw', 'reverse_weight')}, "
    f"{num('all_rw', 'total_reverse_weight')} FROM totalled",
    "totalled",
)
ask(
    "fund_settings",
    f"SELECT yr AS academic_period_id, {num('total_fund', 'total_fund')}, "
    f"{num('dismissed_fund', 'dismissed_fund')}, "
    f"{num('coalesce(total_fund, 0) - coalesce(dismissed_fund, 0)', 'distributable_fund')}, "
    f"{num('uvsotr_value', 'uvsotr_value')} FROM funds",
    "funds",
)
ask(
    "allocation",
    f"SELECT {IDS}, "
    + ", ".join(
        num(c, c)
        for c in ("normalized_share_percent", "employee_share", "reverse_incentive_amount",
                  "normalized_fund_amount")
    )
    + " FROM summed",
    "summed",
)

# --- summary reports --------------------------------------------------------

ask("summary_report", f"SELECT {REPORT} FROM summed", "summed")
ask(
    "summary_search",
    f"SELECT {REPORT} FROM summed WHERE contains(lower(teacher_name), 'supplier#00000001') "
    "AND NOT is_dismissed",
    "summed",
)
ask(
    "summary_shown",
    "SELECT count(*) FILTER (contains(lower(teacher_name), '7') AND NOT is_dismissed) AS shown, "
    "count(*) AS total FROM summed",
    "summed",
)


def _headed(headings: dict[str, str], numbers: set[str], days: set[str] = frozenset()) -> str:
    out = []
    for column, heading in headings.items():
        if column in numbers:
            out.append(f'round(CAST({column} AS DOUBLE), {digits(heading)}) AS "{heading}"')
        elif column in days:
            out.append(f"strftime({column}, '%Y-%m-%d') AS \"{heading}\"")
        else:
            out.append(f'{column} AS "{heading}"')
    return ", ".join(out)


SUMMARY_AMOUNTS = {
    "raw_points", "normalized_points", "reverse_incentive_amount", "normalized_fund_amount",
}
ask(
    "summary_export",
    f"SELECT {_headed(reports.SUMMARY_HEADINGS, SUMMARY_AMOUNTS)} FROM summed",
    "summed",
)
ask(
    "report_numbers",
    "SELECT academic_period, teacher_name, "
    + ", ".join(
        f"{shown(c)} AS {c}"
        for c in ("student_count_with_results", "total_student_count", "raw_points",
                  "normalized_points", "normalized_fund_amount")
    )
    + f", CASE WHEN is_dismissed THEN '{YES}' ELSE '{NO}' END AS is_dismissed FROM summed",
    "summed",
)

# --- result lists -----------------------------------------------------------

LISTED = ", ".join(
    [
        "id", "student_id", "criterion_id", "student_name", "criterion_name", "grade_at_result",
        "grade_track", num("base_score", "base_score"), num("dynamic_bonus", "dynamic_bonus"),
        num("total_score", "total_score"), "raw_result_value", day("result_date", "result_date"),
        "comment", "source_type",
    ]
)
ask("results_recent", f"SELECT {LISTED} FROM listed ORDER BY id DESC LIMIT 300", "listed")
ask(
    "results_search",
    f"SELECT {LISTED} FROM listed "
    "WHERE (contains(lower(student_name), '1') OR contains(lower(criterion_name), '1')) "
    "AND grade_track = 'course' AND grade_at_result = 8",
    "listed",
)
ORACLE["results_search_indexed"] = ORACLE["results_search"]
ask(
    "results_search_letters",
    f"SELECT {LISTED} FROM listed WHERE contains(lower(student_name), 'ring') OR contains(lower(criterion_name), 'ring')",
    "listed",
)
ask(
    "results_shown",
    "SELECT count(*) FILTER ((contains(lower(student_name), 'ring') OR "
    "contains(lower(criterion_name), 'ring')) AND grade_track = 'regular' "
    "AND grade_at_result = 7) AS shown, count(*) AS total FROM listed",
    "listed",
)
ask(
    "results_export",
    "SELECT "
    + _headed(
        reports.RESULT_HEADINGS, {"base_score", "dynamic_bonus", "total_score"}, {"result_date"}
    )
    + " FROM listed",
    "listed",
)
ask(
    "result_days",
    f"SELECT {day('result_date', 'day')}, count(*) AS n_rows FROM results GROUP BY result_date",
    "results",
)

# --- snapshots and stored calculations --------------------------------------


def _zero(expression: str, name: str, scale: int) -> str:
    return (
        f"round(CAST(round(coalesce({expression}, 0), {scale}) AS DOUBLE), {digits(name)}) AS {name}"
    )


NEW_STORED = ", ".join(
    [
        _zero("raw_points", "raw_points", 4), _zero("normalized_points", "normalized_points", 4),
        _zero("reverse_weight", "reverse_weight", 10),
        _zero("employee_share", "employee_share", 10),
        _zero("reverse_incentive_amount", "uvsotr_amount", 4),
        _zero("normalized_fund_amount", "final_amount", 2),
        "student_count_with_results", "total_student_count",
        "CAST(NULL AS DOUBLE) AS avg_group_ratio", "is_dismissed AS is_dismissed_snapshot",
        "'2024-01-01 00:00:00' AS calculated_at",
    ]
)
OLD_STORED = ", ".join(
    [
        num("points", "raw_points"),
        f"round(CAST(round(points / 2, 4) AS DOUBLE), {digits('normalized_points')}) AS normalized_points",
        "0.0 AS reverse_weight", "0.0 AS employee_share", "0.0 AS uvsotr_amount",
        num("CAST(points AS DECIMAL(14,2))", "final_amount"),
        "students AS student_count_with_results", "students AS total_student_count",
        "CAST(NULL AS DOUBLE) AS avg_group_ratio", "FALSE AS is_dismissed_snapshot",
        moment("CAST(last_day AS TIMESTAMP)", "calculated_at"),
    ]
)
ask(
    "snapshot_rejects",
    "SELECT yr AS academic_period_id, first_id AS teacher_id, " + num("raw_points", "raw_points")
    + ", all_students AS total_student_count, 'academic_period_id_teacher_id_unique' AS rules FROM ("
    "SELECT c.yr, c.supp, coalesce(c.pts, 0) AS raw_points, c.all_students, n.first_id, "
    "count(*) OVER (PARTITION BY c.yr, n.name) AS bearers FROM counted c JOIN ("
    "SELECT s_suppkey, name, min(s_suppkey) OVER (PARTITION BY name) AS first_id FROM ("
    "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'Namesake ' || s_nationkey ELSE s_name END AS name FROM supplier)"
    f") n ON n.s_suppkey = c.supp WHERE c.yr = {YEAR}) WHERE bearers > 1",
    "counted",
)
ask("snapshot_rows", f"SELECT {IDS}, {NEW_STORED} FROM summed WHERE yr = {YEAR}", "summed")
ask(
    "snapshot_replace",
    f"SELECT id, {IDS}, {OLD_STORED} FROM stored WHERE yr <> {YEAR} UNION ALL "
    f"SELECT concat_ws('-', yr, supp), {IDS}, {NEW_STORED} FROM summed WHERE yr = {YEAR}",
    "summed", "stored",
)
ask(
    "snapshot_items_left",
    "SELECT concat_ws('-', yr, supp) AS teacher_calculation_id, line_key AS student_result_id, "
    f"yr AS academic_period_id, cust AS student_id, {num('base + bonus', 'base_points')} "
    f"FROM lines WHERE yr <> {YEAR}",
    "lines",
)
ask(
    "snapshot_log",
    "SELECT 'system' AS actor_name, 'system' AS actor_role, 'recalculate' AS action_type, "
    f"'teacher_calculations' AS entity_type, '{YEAR}' AS entity_id, "
    f"'{{\"inserted\":' || count(*) || ',\"period\":\"{YEAR}\"}}' AS details "
    f"FROM summed WHERE yr = {YEAR}",
    "summed",
)
STORED_LIST = (
    f"SELECT id, s_name AS teacher_name, {OLD_STORED.replace('CAST(NULL AS DOUBLE) AS avg_group_ratio, ', '')} "
    f"FROM stored JOIN supplier ON s_suppkey = supp WHERE yr = {YEAR}"
)
ask("calculations_by_period", STORED_LIST, "stored")
ask(
    "calculations_search",
    f"SELECT * FROM ({STORED_LIST}) WHERE contains(lower(teacher_name), '#00000002')",
    "stored",
)

# --- teacher card -----------------------------------------------------------

ask("card_summary", f"SELECT {IDS}, {SUMMARY} FROM summed", "summed")
ask(
    "card_latest",
    f"SELECT id, {IDS}, s_name AS teacher_name, CAST(yr AS VARCHAR) AS academic_period, {OLD_STORED} "
    "FROM latest JOIN supplier ON s_suppkey = supp",
    "latest",
)
CARD_ITEM = (
    "SELECT s_name AS teacher_name, line_key AS student_result_id, full_name AS student_name, "
    "m.name AS criterion_name, base + bonus AS total_score, "
    "CASE WHEN st = 'F' THEN ship_day END AS result_date, supp "
    "FROM lines JOIN supplier ON s_suppkey = supp JOIN people p ON p.id = cust "
    "JOIN marks m ON m.id = part"
)
ask(
    "card_items",
    "SELECT teacher_name, student_result_id, student_name, criterion_name, "
    f"{num('total_score', 'total_score')}, {day('result_date', 'result_date')}, "
    "CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY supp "
    "ORDER BY result_date DESC NULLS LAST, student_result_id DESC) AS place "
    f"FROM ({CARD_ITEM})) WHERE place <= 100",
    "lines", "people", "marks",
)
ask(
    "card_items_export",
    "SELECT teacher_name AS \"Педагог\", "
    + _headed(reports.CARD_ITEM_HEADINGS, {"total_score"}, {"result_date"})
    + f" FROM ({CARD_ITEM})",
    "lines", "people", "marks",
)
ask(
    "card_summary_export",
    f"SELECT {_headed(reports.CARD_SUMMARY_HEADINGS, SUMMARY_AMOUNTS)} FROM summed",
    "summed",
)
ask(
    "card_calculation_export",
    "SELECT "
    + _headed(
        reports.CARD_CALCULATION_HEADINGS,
        {"raw_points", "normalized_points", "uvsotr_amount", "final_amount"},
    )
    + f" FROM (SELECT s_name AS teacher_name, {OLD_STORED} FROM latest "
    "JOIN supplier ON s_suppkey = supp)",
    "latest",
)
ask(
    "card_texts",
    "SELECT academic_period, teacher_name, "
    f"{shown('raw_points')} AS raw_points, "
    f"{shown('normalized_fund_amount')} AS normalized_fund_amount, "
    f"CASE WHEN is_dismissed THEN '{YES}' ELSE '{NO}' END AS is_dismissed, "
    f"{shown('l.points')} AS stored_raw, {shown('round(l.points / 2, 4)')} AS stored_normalized, "
    "'0' AS uvsotr_amount, "
    f"{shown('CAST(l.points AS DECIMAL(14,2))')} AS final_amount, "
    "strftime(l.last_day, '%Y-%m-%d') AS calculated_on "
    "FROM summed s JOIN latest l ON l.yr = s.yr AND l.supp = s.supp",
    "summed", "latest",
)

# --- change log, counts, look-ups -------------------------------------------

LOGGED = (
    "event_id AS id, 'user-' || user_id AS actor_name, 'editor' AS actor_role, "
    "event_type AS action_type, 'student_result' AS entity_type, "
    "CAST(user_id AS VARCHAR) AS entity_id, props AS details"
)
ask(
    "log_recent",
    f"SELECT {LOGGED}, {moment('ts', 'created_at')} FROM events ORDER BY event_id DESC LIMIT 300",
)
ask(
    "log_append",
    f"SELECT * EXCLUDE (id) FROM (SELECT {LOGGED} FROM events) UNION ALL "
    "SELECT CASE WHEN event_type = 'error' THEN 'system' ELSE 'u' || user_id END, 'system', "
    "event_type, 'event', CASE WHEN user_id <> 0 THEN CAST(user_id AS VARCHAR) END, "
    "CASE WHEN event_type = 'view' THEN '{}' ELSE '{\"event_id\":' || event_id || "
    "',\"user_id\":' || user_id || '}' END FROM events",
)
ask(
    "table_counts",
    "SELECT 'students' AS table_name, count(*) AS n_rows FROM customer UNION ALL "
    "SELECT 'teachers', count(*) FROM supplier UNION ALL "
    "SELECT 'student_results', count(*) FROM lineitem UNION ALL "
    "SELECT 'teacher_calculations', count(*) FROM stored UNION ALL "
    "SELECT 'audit_log', count(*) FROM events",
    "stored",
)
ask("lookup_students", "SELECT id, full_name FROM people", "people")
ask(
    "lookup_criteria",
    f"SELECT id, name, {num('base_score', 'base_score')} FROM marks WHERE is_active",
    "marks",
)
ask(
    "lookup_period",
    "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS id, "
    f"CAST(year(o_orderdate) AS VARCHAR) AS name FROM orders WHERE year(o_orderdate) = {LOAD}",
)

# --- reference data ---------------------------------------------------------

ask(
    "periods_insert_absent",
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS id, CAST(year(o_orderdate) AS VARCHAR) AS name, "
    f"{day('min(o_orderdate)', 'date_start')}, {day('max(o_orderdate)', 'date_end')} "
    "FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY year(o_orderdate)",
)
ask(
    "groups_upsert",
    "SELECT lower(p_brand) AS code, p_brand AS name, 'brand' AS description, "
    "length(p_brand) AS sort_order FROM part GROUP BY p_brand UNION ALL "
    "SELECT lower(p_type), CASE WHEN lower(p_type) < 'p' "
    "THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) ELSE p_type END, "
    "CASE WHEN lower(p_type) < 'p' THEN 'type' END, "
    "CASE WHEN lower(p_type) < 'p' THEN 1 ELSE length(p_type) END FROM part GROUP BY p_type "
    "UNION ALL SELECT 'new ' || lower(p_type), upper(left(p_type, 1)) || lower(substr(p_type, 2)), "
    "'type', 1 FROM part WHERE lower(p_type) >= 'p' GROUP BY p_type",
)
GIVEN = "p_type <> 'PROMO'"
KNOWN = "p_retailprice < 950"
ask(
    "criteria_upsert",
    f"""SELECT 'c' || p_partkey AS code, lower(p_type) AS criterion_group_id,
      CASE WHEN {GIVEN} THEN upper(p_name) ELSE p_name END AS name,
      CASE WHEN {GIVEN} THEN p_brand ELSE 'old' END AS raw_value_label,
      CAST(CASE WHEN {GIVEN} THEN p_size + 1 ELSE p_size END AS DOUBLE) AS base_score,
      CAST(CASE WHEN {KNOWN} THEN p_size END AS DOUBLE) AS max_dynamic_bonus,
      CASE WHEN {GIVEN} THEN p_size <= 45 ELSE TRUE END AS is_active,
      CASE WHEN {GIVEN} THEN p_size ELSE 0 END AS sort_order
    FROM part WHERE {GIVEN} OR {KNOWN}
    UNION ALL SELECT 'o' || p_partkey, lower(p_type), p_name, 'old', CAST(p_size AS DOUBLE),
      CAST(p_size AS DOUBLE), TRUE, 0 FROM part WHERE NOT {KNOWN}""",
)
ask(
    "dq_touch",
    f"""SELECT 'c' || p_partkey AS code,
      CASE WHEN {GIVEN} THEN '2024-01-01 00:00:00' ELSE '2020-01-01 00:00:00' END AS updated_at
    FROM part WHERE {GIVEN} OR {KNOWN}
    UNION ALL SELECT 'o' || p_partkey, '2020-01-01 00:00:00' FROM part WHERE NOT {KNOWN}""",
)
WEIGHTED = "part AS criterion_id, grade, track AS grade_track"
ask(
    "weights_load",
    f"SELECT {WEIGHTED}, "
    + num("coalesce(max(qty) FILTER (st = 'O'), min(qty) FILTER (st = 'F')) / 100", "weight_value")
    + " FROM lines GROUP BY part, grade, track",
    "lines",
)
ask(
    "settings_upsert",
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS academic_period_id, "
    + num("sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (o_orderstatus = 'O')", "total_fund")
    + ", 0.0 AS dismissed_fund, "
    + num("count(*)", "uvsotr_value")
    + " FROM orders GROUP BY year(o_orderdate)",
)
ask(
    "teachers_insert_absent",
    f"SELECT min(c_name) AS full_name FROM customer WHERE {key('c_name')} NOT IN "
    f"(SELECT {key('s_name')} FROM supplier) GROUP BY {key('c_name')}",
)

# --- staged import ----------------------------------------------------------

ask("name_keys", f"SELECT line_key AS row_key, {key('student_name')} AS name_key FROM named", "named")
MISSING = (
    f"SELECT {key('student_name')} AS name_key, min(student_name) AS full_name FROM named "
    f"WHERE {key('student_name')} NOT IN (SELECT {key('full_name')} FROM people WHERE known) "
    "GROUP BY 1"
)
ask("missing_names", MISSING, "named")
ask(
    "new_student_ids",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, CASE WHEN count(*) > 0 THEN "
    "(SELECT max(id) + 1 FROM people) END AS first_id, "
    "CASE WHEN count(*) > 0 THEN (SELECT max(id) FROM people) + count(*) END "
    f"AS last_id FROM ({MISSING})",
    "named",
)
PLACED_ROWS = f"""
  SELECT DISTINCT {LOAD} AS academic_period_id, p.id AS student_id, grade, track AS grade_track,
    CASE WHEN grade = 11 AND track = 'course' THEN '{LABEL_COURSE}'
         WHEN grade = 11 AND track = 'practicum' THEN '{LABEL_PRACTICUM}'
         ELSE CAST(grade AS VARCHAR) END AS grade_label,
    CAST(NULL AS VARCHAR) AS class_letter
  FROM matrix JOIN people p ON {key('p.full_name')} = who"""
ask("enrollments", PLACED_ROWS, "matrix")
ask(
    "enrollments_insert_absent",
    f"SELECT * FROM ({PLACED_ROWS}) n WHERE NOT EXISTS (SELECT 1 FROM placed e WHERE e.yr = {LOAD} "
    "AND e.cust = n.student_id AND e.grade = n.grade AND e.track = n.grade_track)",
    "matrix", "placed",
)
TAUGHT_ROWS = f"""
  SELECT DISTINCT {LOAD} AS academic_period_id, p.id AS student_id, s_suppkey AS teacher_id, grade,
    track AS grade_track, 'main' AS assignment_type, 100.0 AS share_percent, TRUE AS is_active
  FROM matrix JOIN people p ON {key('p.full_name')} = who
  JOIN supplier ON {key("'S. ' || right(s_name, 9)")} = teacher"""
ask(
    "assignments",
    f"SELECT * REPLACE (CAST(share_percent AS DOUBLE) AS share_percent) FROM ({TAUGHT_ROWS})",
    "matrix",
)
ask(
    "assignments_insert_absent",
    "SELECT * REPLACE (CAST(share_percent AS DOUBLE) AS share_percent) "
    f"FROM ({TAUGHT_ROWS}) n WHERE NOT EXISTS (SELECT 1 FROM taught t WHERE t.yr = {LOAD} "
    "AND t.cust = n.student_id AND t.supp = n.teacher_id AND t.grade = n.grade "
    "AND t.track = n.grade_track)",
    "matrix", "taught",
)
ask(
    "grade_pick",
    f"SELECT student_id, {LOAD} AS academic_period_id, picked_grade, picked_track FROM picks",
    "picks",
)
ask(
    "result_import",
    "SELECT * REPLACE (CAST(base_score AS DOUBLE) AS base_score, "
    "CAST(dynamic_bonus AS DOUBLE) AS dynamic_bonus, CAST(total_score AS DOUBLE) AS total_score) "
    "FROM booked WHERE grade_at_result IS NOT NULL",
    "booked",
)
ask(
    "result_import_rejected",
    "SELECT row_key, 'grade_at_result_required' AS rules FROM booked WHERE grade_at_result IS NULL",
    "booked",
)
ask(
    "result_import_faulty",
    "SELECT * FROM (SELECT row_key, concat_ws(',', "
    "CASE WHEN grade_at_result IS NULL THEN 'grade_at_result_required' END, "
    "CASE WHEN base_score = 3 THEN 'base_score_required' END, "
    "CASE WHEN base_score = 4 THEN 'total_score_precision' END) AS rules FROM booked) WHERE rules <> ''",
    "booked",
)


def numbered(rows: str, known: str) -> str:
    """Dense ids of ``rows`` after those of the ``known`` count of rows."""
    return (
        "SELECT count(*) AS n_rows, count(*) AS n_ids, "
        f"CASE WHEN count(*) > 0 THEN ({known}) + 1 END AS first_id, "
        f"CASE WHEN count(*) > 0 THEN ({known}) + count(*) END AS last_id FROM ({rows})"
    )


ask("enrollment_ids", numbered(ORACLE["enrollments_insert_absent"], "SELECT count(*) FROM placed"), "placed")
ask("assignment_ids", numbered(ORACLE["assignments_insert_absent"], "SELECT count(*) FROM taught"), "taught")
ask("teacher_ids", numbered(ORACLE["teachers_insert_absent"], "SELECT max(s_suppkey) FROM supplier"))
ask("period_ids", numbered("SELECT DISTINCT year(o_orderdate) FROM orders", "SELECT 0"))
ask(
    "criteria_ids",
    "SELECT count(*) + count(*) FILTER (NOT known) AS n_rows, n_rows AS n_ids, min(p_partkey) AS first_id, "
    "max(p_partkey) + count(*) FILTER (NOT known) AS last_id "
    f"FROM (SELECT p_partkey, {KNOWN} AS known FROM part)",
)
ask(
    "group_ids",
    "SELECT n AS n_rows, n AS n_ids, 1 AS first_id, n AS last_id "
    "FROM (SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) AS n FROM part)",
)
ask(
    "weight_ids",
    "SELECT count(*) AS n_rows, 1 + count(*) - count(*) FILTER (old) AS n_ids, count(*) FILTER (old) AS first_id, "
    "count(*) AS last_id FROM (SELECT bool_or(st = 'F') AS old FROM lines GROUP BY part, grade, track)",
    "lines",
)
ask("result_ids", numbered(ORACLE["result_import"], "SELECT count(*) FROM lineitem"))
ask("log_ids", numbered("SELECT 1 FROM events", "SELECT max(event_id) FROM events"))

CTE["delivered"] = """
      SELECT line_key AS row_key, base AS base_score, nullif(bonus, 0) AS dynamic_bonus,
             strftime(ship_day, '%Y-%m') AS batch_id
      FROM lines"""
NEEDS["delivered"] = ["lines"]
CORRECTED = "batch_id IN (SELECT batch_id FROM delivered WHERE batch_id LIKE '1997-%' AND base_score <> 1)"
ask(
    "load_repeated",
    f"SELECT row_key, batch_id, {num('base_score', 'base_score')}, "
    f"{num(f'CASE WHEN {CORRECTED} THEN coalesce(dynamic_bonus, 10) ELSE dynamic_bonus END', 'dynamic_bonus')} "
    f"FROM delivered WHERE base_score <> 1 OR NOT {CORRECTED}",
    "delivered",
)
ask(
    "load_ledger",
    f"SELECT batch_id, count(*) AS n_rows FROM delivered WHERE base_score <> 1 OR NOT {CORRECTED} GROUP BY batch_id",
    "delivered",
)

# --- changes ----------------------------------------------------------------

WRITTEN = ", ".join(
    [
        "academic_period_id", "student_id", "student_enrollment_id", "criterion_id",
        "grade_at_result", "grade_track", num("base_score", "base_score"),
        num("dynamic_bonus", "dynamic_bonus"), num("total_score", "total_score"),
        "raw_result_value", "result_date", "source_type", "comment",
    ]
)
ask(
    "changes_created",
    f"SELECT 'new-' || change_id AS id, {WRITTEN} FROM rows_written WHERE op = 'create'",
    "rows_written",
)
ask(
    "changes_updated",
    f"SELECT result_id, change_id, {WRITTEN} FROM rows_written WHERE op = 'update'",
    "rows_written",
)
ask("changes_deleted", "SELECT id FROM gone", "gone")
ask("changes_rejected", "SELECT change_id, rules FROM judged WHERE rules <> ''", "judged")
KEPT = WRITTEN.replace("result_date,", f"{day('result_date', 'result_date')},")
CTE["asked_large"] = re.sub(
    "WHEN bonus = 0 THEN ''", "WHEN bonus = 0 THEN '' WHEN CAST(bonus AS VARCHAR) LIKE '9%' THEN '99999999'", CTE["asked"]
)
CTE["ruled_large"] = CTE["ruled"].replace("FROM asked", "FROM asked_large")
NEEDS["asked_large"], NEEDS["ruled_large"] = ["lines"], ["asked_large"]
LARGE = (
    "CASE WHEN m.base_score > 40 THEN 99999999 ELSE m.base_score END "
    "+ coalesce(try_cast(nullif(bonus_text, '') AS DECIMAL(12,4)), 0) >= 100000000"
)
CTE["judged_large"] = CTE["judged"].replace("ruled ", "ruled_large ").replace(
    "CASE WHEN op <> 'delete' AND p.id IS NULL",
    f"CASE WHEN op <> 'delete' AND {LARGE} THEN 'total_score_precision' END, CASE WHEN op <> 'delete' AND p.id IS NULL",
)
NEEDS["judged_large"] = ["ruled_large", "results", "people", "marks"]
ask("changes_oversized", "SELECT change_id, rules FROM judged_large WHERE rules <> ''", "judged_large")
ask(
    "changes_results",
    f"SELECT id, {KEPT} FROM results WHERE id NOT IN (SELECT id FROM gone) "
    "AND id NOT IN (SELECT result_id FROM rows_written WHERE op = 'update') UNION ALL "
    f"SELECT result_id, {WRITTEN} FROM rows_written WHERE op = 'update' "
    "AND result_id NOT IN (SELECT id FROM gone) UNION ALL "
    f"SELECT 'new-' || change_id, {WRITTEN} FROM rows_written WHERE op = 'create'",
    "rows_written", "gone",
)
ask(
    "changes_links",
    "SELECT line_key AS student_result_id, supp AS teacher_id, 100.0::DOUBLE AS share_percent, "
    f"{num('base + bonus', 'score_assigned')} FROM lines "
    "WHERE line_key NOT IN (SELECT id FROM gone)",
    "gone",
)
ask(
    "changes_items",
    "SELECT concat_ws('-', yr, supp) AS teacher_calculation_id, line_key AS student_result_id, "
    f"yr AS academic_period_id, cust AS student_id, {num('base + bonus', 'base_points')} "
    "FROM lines WHERE line_key NOT IN (SELECT id FROM gone)",
    "gone",
)
ask(
    "changes_log",
    """SELECT coalesce(actor, 'system') AS actor_name, 'system' AS actor_role, op AS action_type,
      'student_result' AS entity_type,
      CASE op WHEN 'create' THEN 'new-' || change_id ELSE result_id END AS entity_id,
      CASE op WHEN 'delete' THEN '{}' ELSE '{"studentId":' || student_id || ',"criterionId":'
        || criterion_id || ',"gradeAtResult":' || grade || ',"gradeTrack":"' || track
        || '","dynamicBonus":"' || bonus_text || '","rawResultValue":"' || value_text
        || '","resultDate":"' || date_text || '","comment":"' || comment_text || '"}'
        END AS details
    FROM judged WHERE rules = ''""",
    "judged",
)

# The summary once more, over the results as the batch leaves them.
CTE["after"] = """
      SELECT academic_period_id AS yr, student_id AS cust, grade_at_result AS grade, grade_track AS track,
             base_score AS base, dynamic_bonus AS bonus
      FROM results WHERE id NOT IN (SELECT id FROM gone)
        AND id NOT IN (SELECT result_id FROM rows_written WHERE op = 'update')
      UNION ALL
      SELECT academic_period_id, student_id, grade_at_result, grade_track, base_score, dynamic_bonus
      FROM rows_written
      WHERE op = 'create' OR result_id NOT IN (SELECT id FROM gone)"""
NEEDS["after"] = ["results", "rows_written", "gone"]
_below = {"hits": "lines", "counted": "hits", "evened": "counted", "totalled": "evened", "summed": "totalled"}
_named = {"lines": "after"}
for _part, _source in _below.items():
    _named[_part] = f"{_part}_after"
    CTE[_named[_part]] = re.sub(rf"\b(FROM|JOIN) {_source}\b", rf"\1 {_named[_source]}", CTE[_part])
    NEEDS[_named[_part]] = [_named[_source], *(n for n in NEEDS[_part] if n != _source)]
NEEDS["hits_after"] = ["taught", "after"]
ask("summary_after_changes", f"SELECT {SUMMARY} FROM summed_after", "summed_after")

# --- validity rules ---------------------------------------------------------


def _violations(*rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'student_results' AS table_name, '{rule}' AS rule, id AS row_key "
        f"FROM faulty WHERE {broken}"
        for rule, broken in rules
    )


CHECKS = (
    ("grade_at_result_range", "grade NOT BETWEEN 2 AND 11"),
    ("base_score_not_negative", "base < 0"),
    ("dynamic_bonus_not_negative", "bonus < 0"),
)
REQUIRED = (("student_id_required", "student_id IS NULL"), ("dynamic_bonus_required", "bonus IS NULL"))
WORDS = (("grade_track_word", f"track NOT IN {schemas.TRACKS}"),)
LENGTHS = (("raw_result_value_length", "length(raw_value) > 100"),)
ask("dq_checks", _violations(*CHECKS), "faulty")
ask("dq_required", _violations(*REQUIRED), "faulty")
ask("dq_enum", _violations(*WORDS), "faulty")
ask("dq_length", _violations(*LENGTHS), "faulty")
ask("dq_all_row_rules", _violations(*CHECKS, *REQUIRED, *WORDS, *LENGTHS), "faulty")
ask(
    "dq_precision",
    "SELECT 'student_results' AS table_name, 'base_score_precision' AS rule, line_key AS row_key "
    "FROM lines WHERE qty > 45 UNION ALL "
    "SELECT 'student_results', 'dynamic_bonus_precision', line_key FROM lines WHERE qty = 13",
    "lines",
)
ask(
    "dq_rounding",
    "SELECT o_orderkey, round(CAST(CAST(CAST(o_totalprice AS DECIMAL(14,3)) + 0.005 "
    "AS DECIMAL(14,2)) AS DOUBLE), 4) AS up, round(CAST(CAST(-(CAST(o_totalprice AS DECIMAL(14,3)) "
    "+ 0.005) AS DECIMAL(14,2)) AS DOUBLE), 4) AS down FROM orders",
)
ask(
    "dq_unique",
    "SELECT 'student_teacher_assignments' AS table_name, "
    "'student_id_teacher_id_academic_period_id_grade_grade_track_assignment_type_unique' AS rule, "
    "concat_ws('|', cust, supp, yr, grade, track, 'main') AS row_key, count(*) AS n_rows "
    "FROM lines GROUP BY cust, supp, yr, grade, track HAVING count(*) > 1",
    "lines",
)
ask(
    "dq_references",
    "SELECT 'student_results' AS table_name, 'criterion_id_known' AS rule, id AS row_key "
    "FROM faulty WHERE criterion_id NOT IN (SELECT p_partkey FROM part) UNION ALL "
    "SELECT 'student_results', 'student_id_known', id FROM faulty "
    "WHERE student_id NOT IN (SELECT c_custkey FROM customer)",
    "faulty",
)


def _broken(table: str, rule: str, source: str, key: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS row_key "
        f"FROM {source} WHERE {condition}"
    )


def _rows(name: str, table: str, source: str, key: str, rules: dict[str, str], *parts: str) -> None:
    ask(name, " UNION ALL ".join(_broken(table, r, source, key, c) for r, c in rules.items()), *parts)


_rows(
    "dq_assignment_rows", "student_teacher_assignments", "lines", "line_key",
    {
        "student_id_required": "qty = 3",
        "grade_range": "tax = 0.08 AND grade + 3 > 11",
        "grade_track_word": "qty = 11",
        "assignment_type_word": "tax = 0.01",
        "share_percent_range": "qty IN (5, 6)",
    },
    "lines",
)
_rows(
    "dq_link_rows", "student_result_teacher_links", "lines", "line_key",
    {
        "teacher_id_required": "qty = 7",
        "share_percent_range": "qty = 5",
        "score_assigned_not_negative": "qty = 6",
        "score_assigned_required": "qty = 8",
    },
    "lines",
)
_rows(
    "dq_criteria_rows", "criteria", "part", "p_partkey",
    {
        "name_required": "p_size = 1",
        "base_score_not_negative": "p_size = 2",
        "max_dynamic_bonus_not_negative": "p_size = 3",
        "code_length": "p_size = 4",
    },
)
_rows(
    "dq_weight_rows", "criterion_grade_weights", "lines", "line_key",
    {
        "criterion_id_required": "qty = 9",
        "grade_range": "qty = 10",
        "grade_track_word": "qty = 12",
        "weight_value_not_negative": "qty = 13",
    },
    "lines",
)
_rows(
    "dq_student_rows", "students", "customer", "c_custkey",
    {"full_name_required": "c_acctbal < 0", "last_name_length": "c_acctbal > 5000"},
)
_rows(
    "dq_teacher_rows", "teachers", "supplier", "s_suppkey",
    {
        "dismissal_dated": "s_acctbal < 0 AND s_nationkey NOT IN (3, 4, 6, 7)",
        "full_name_required": "s_nationkey = 3",
        "is_dismissed_required": "s_nationkey = 6",
        "short_name_length": "s_nationkey = 5",
    },
)
_rows(
    "dq_period_rows", "academic_periods", "orders", "o_orderkey",
    {
        "dates_in_order": "o_orderpriority = '2-HIGH'",
        "date_end_required": "o_orderpriority = '5-LOW'",
        "name_required": "o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P'",
        "name_length": "o_orderpriority = '1-URGENT'",
    },
)
_rows(
    "dq_group_rows", "criterion_groups", "part", "p_partkey",
    {
        "code_required": "p_size = 1", "code_length": "p_size = 2", "name_required": "p_size = 3",
        "name_length": "p_size = 4", "sort_order_required": "p_size = 5",
    },
)
_rows(
    "dq_enrollment_rows", "student_enrollments", "lines", "line_key",
    {
        "student_id_required": "qty = 3", "academic_period_id_required": "qty = 6",
        "grade_range": "tax = 0.08 AND grade + 3 > 11", "grade_label_length": "qty = 4",
        "class_letter_length": "qty = 5", "grade_track_word": "qty = 11",
    },
    "lines",
)
_rows(
    "dq_setting_rows", "calculation_settings", "orders", "o_orderkey",
    {
        "total_fund_not_negative": "o_orderstatus = 'F' AND o_totalprice > 0",
        "total_fund_required": "o_orderstatus = 'P'",
        "total_points_sum_not_negative": "o_orderpriority = '1-URGENT'",
        "dismissed_fund_not_negative": "o_orderpriority = '2-HIGH'",
        "uvsotr_value_not_negative": "o_orderpriority = '3-MEDIUM' AND o_totalprice > 0",
        "avg_group_size_not_negative": "o_orderpriority = '5-LOW'",
    },
)
_rows(
    "dq_calculation_rows", "teacher_calculations", "lines", "line_key",
    {
        "teacher_id_required": "qty = 1", "raw_points_not_negative": "qty = 2", "raw_points_required": "qty = 3",
        "normalized_points_not_negative": "qty = 4", "reverse_weight_not_negative": "qty = 5",
        "employee_share_not_negative": "qty = 6", "uvsotr_amount_not_negative": "qty = 7",
        "final_amount_not_negative": "qty = 8", "final_amount_required": "qty = 9",
        "student_count_with_results_not_negative": "qty = 10", "total_student_count_not_negative": "qty = 11",
    },
    "lines",
)
_rows(
    "dq_item_rows", "teacher_calculation_items", "lines", "line_key",
    {
        "student_result_id_required": "qty = 1", "base_points_not_negative": "qty = 2", "base_points_required": "qty = 3",
        "normalized_points_not_negative": "qty = 4", "applied_share_percent_range": "qty IN (5, 6)",
        "applied_share_percent_required": "qty = 7", "final_points_to_teacher_not_negative": "qty = 8",
    },
    "lines",
)
_rows(
    "dq_enrollment_references", "student_enrollments", "placed", "id",
    {"student_id_known": "cust IN (SELECT id FROM broke)", "academic_period_id_known": "grade = 7"},
    "placed", "broke",
)
ask(
    "dq_restrict",
    "SELECT 'criteria' AS table_name, 'used_by_student_results' AS rule, "
    "CAST(p_partkey AS VARCHAR) AS row_key FROM part WHERE p_size > 45 "
    "AND p_partkey IN (SELECT l_partkey FROM lineitem)",
)
ask(
    "dq_cascade",
    "SELECT line_key AS id, cust AS student_id FROM lines "
    "WHERE cust NOT IN (SELECT id FROM people WHERE NOT known)",
    "lines", "people",
)
ask(
    "dq_cascade_assignments",
    "SELECT cust AS student_id, supp AS teacher_id, yr AS academic_period_id, grade, "
    "track AS grade_track, is_active, 'main' AS assignment_type FROM taught "
    "WHERE cust NOT IN (SELECT id FROM people WHERE NOT known)",
    "taught", "people",
)
ask(
    "dq_cascade_links",
    "SELECT line_key AS student_result_id, supp AS teacher_id, " + num("base + bonus", "score_assigned")
    + " FROM lines WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "lines",
)
ask(
    "dq_cascade_items",
    "SELECT concat_ws('-', yr, supp) AS teacher_calculation_id, line_key AS student_result_id, "
    "cust AS student_id, " + num("base + bonus", "base_points") + " FROM lines WHERE yr <> 1997",
    "lines",
)
ask(
    "dq_cascade_counts",
    "SELECT 'students' AS table_name, count(*) AS n_gone FROM customer WHERE c_acctbal < 0 "
    "UNION ALL SELECT 'student_enrollments', count(*) FROM placed WHERE cust IN (SELECT id FROM broke) "
    "UNION ALL SELECT 'student_results', count(*) FROM lines WHERE cust IN (SELECT id FROM broke)",
    "lines", "placed", "broke",
)
ask(
    "dq_restrict_below",
    "SELECT 'teachers' AS table_name, u.rule, CAST(s_suppkey AS VARCHAR) AS row_key FROM supplier, "
    "(VALUES ('used_by_student_teacher_assignments'), ('used_by_student_result_teacher_links'), "
    "('used_by_teacher_calculations')) AS u(rule) "
    "WHERE s_acctbal < 0 AND s_suppkey IN (SELECT supp FROM lines WHERE yr <> 1997)",
    "lines",
)
ask(
    "dq_set_null",
    "SELECT id, CASE WHEN grade_at_result <> 5 THEN student_enrollment_id END "
    "AS student_enrollment_id FROM results",
    "results",
)
ask(
    "dq_defaults",
    f"SELECT id, {num('coalesce(bonus, 0)', 'dynamic_bonus')}, "
    "CASE WHEN track = 'evening' THEN 'regular' ELSE track END AS grade_track FROM faulty",
    "faulty",
)
ask(
    "dq_generated",
    f"SELECT id, {num('base', 'base_score')}, {num('bonus', 'dynamic_bonus')}, "
    f"{num('base + bonus', 'total_score')} FROM faulty",
    "faulty",
)
ask(
    "dq_generated_names",
    "SELECT full_name, " + key("full_name") + " AS full_name_normalized FROM "
    "(SELECT '  ' || upper(s_name) || ' ' AS full_name FROM supplier "
    "UNION ALL SELECT c_name FROM customer)",
)
ask(
    "upsert_unchanged",
    f"SELECT {WEIGHTED}, {num('min(qty) / 100', 'weight_value')} FROM lines WHERE st = 'F' "
    "GROUP BY part, grade, track",
    "lines",
)
