"""The model tables derived from a star schema of orders and line items.

A line item with its order is one scored result: the customer is the student,
the supplier the teacher, the part the criterion, the order year the period.
Every table is built from all rows of its sources. Keys that have no number of
their own are texts made of the natural keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meritpool.functions.text import grade_label


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def _padded(name: str, width: int) -> Column:
    return F.lpad(F.col(name).cast("string"), width, "0")


class StarSchema:
    """Lazily built frames over one data folder, named as in ``Tables``.

    ``shared`` is for a job that takes several frames from the line items: rows travel to their
    orders whole, so that Spark fills one exchange for all of them.
    """

    def __init__(self, spark: SparkSession, folder: str, shared: bool = False):
        self.spark = spark
        self.folder = folder
        self.is_shared = shared

    @cached_property
    def shared(self) -> StarSchema:
        return StarSchema(self.spark, self.folder, shared=True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    # --- line items with their order ----------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        """Scored line items in model terms; readers prune what they skip."""
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("student_id"),
            F.year("o_orderdate").cast("bigint").alias("academic_period_id"),
        )
        items = self.read("lineitem").drop("l_extendedprice")
        if self.is_shared:
            items, orders = (
                df.select("l_orderkey", F.array(F.struct(*[c for c in df.columns if c != "l_orderkey"])).alias(name))
                for df, name in ((items, "_item"), (orders, "_order"))
            )
            joined = items.join(orders, "l_orderkey").select("l_orderkey", "_order", F.inline_outer("_item"))
            joined = joined.select(*[c for c in joined.columns if c != "_order"], F.inline_outer("_order"))
        else:
            joined = items.join(orders, "l_orderkey")
        return (
            joined
            .select(
                F.concat_ws(
                    "-", _padded("l_orderkey", 12),
                    *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")],
                    F.unix_date(F.col("l_shipdate").cast("date")).cast("string"),
                ).alias("line_key"),
                "academic_period_id", "student_id",
                F.col("l_suppkey").alias("teacher_id"),
                F.col("l_partkey").alias("criterion_id"),
                (F.col("l_linenumber") + 4).cast("smallint").alias("grade"),
                F.when(F.col("l_returnflag") == "N", "regular")
                .when(F.col("l_returnflag") == "A", "course")
                .otherwise("practicum").alias("grade_track"),
                F.col("l_quantity").cast("decimal(12,4)").alias("base_score"),
                (F.col("l_discount") * 100).cast("decimal(12,4)").alias("dynamic_bonus"),
                F.col("l_shipdate").cast("date").alias("ship_day"),
                F.col("l_linestatus").alias("line_status"),
                F.col("l_returnflag").alias("return_flag"),
                F.col("l_tax").alias("tax"),
                F.col("l_quantity").alias("quantity"),
                "l_orderkey",
            )
        )

    # --- dimensions ---------------------------------------------------------

    @cached_property
    def periods(self) -> DataFrame:
        return (
            self.read("orders")
            .groupBy(F.year("o_orderdate").cast("bigint").alias("id"))
            .agg(
                F.min("o_orderdate").cast("date").alias("date_start"),
                F.max("o_orderdate").cast("date").alias("date_end"),
            )
            .select("id", F.col("id").cast("string").alias("name"), "date_start", "date_end")
        )

    @cached_property
    def students(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("id"),
            F.translate("c_name", "#", " ").alias("full_name"),
            F.lower(F.translate("c_name", "#", " ")).alias("full_name_normalized"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    @cached_property
    def teachers(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("full_name"),
            F.concat(F.lit("S. "), F.right("s_name", F.lit(9))).alias("short_name"),
            (F.col("s_acctbal") < 0).alias("is_dismissed"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        types = self.read("part").select("p_type").distinct()
        return types.select(
            F.lower("p_type").alias("id"),
            F.lower("p_type").alias("code"),
            F.col("p_type").alias("name"),
            F.length("p_type").alias("sort_order"),
        )

    @cached_property
    def criteria(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"),
            F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
            F.lower("p_type").alias("group_code"),
            F.col("p_size").cast("decimal(12,4)").alias("base_score"),
            (F.col("p_size") <= 45).alias("is_active"),
            F.col("p_size").alias("sort_order"),
        )

    # --- bridges and facts --------------------------------------------------

    @cached_property
    def assignments(self) -> DataFrame:
        """Who taught whom; active while one of the lines is open."""
        return (
            self.lines.groupBy(
                "student_id", "teacher_id", "academic_period_id", "grade", "grade_track"
            )
            .agg(F.bool_or(F.col("line_status") == "O").alias("is_active"))
            .withColumn("assignment_type", F.lit("main"))
            .withColumn(
                "share_percent", (25 * (1 + F.col("teacher_id") % 4)).cast("decimal(5,2)")
            )
        )

    @cached_property
    def enrollments(self) -> DataFrame:
        return (
            self.lines.select("student_id", "academic_period_id", "grade", "grade_track")
            .distinct()
            .withColumn("class_letter", F.lit(None).cast("string"))
            .withColumn("grade_label", grade_label(F.col("grade"), F.col("grade_track")))
            .withColumn(
                "id",
                F.concat_ws(
                    "-", *[F.col(c).cast("string") for c in
                           ("student_id", "academic_period_id", "grade", "grade_track")]
                ),
            )
        )

    @cached_property
    def results(self) -> DataFrame:
        """One result per line item; lines still open have no date."""
        return self.lines.select(
            F.col("line_key").alias("id"),
            "academic_period_id", "student_id", "criterion_id",
            F.concat_ws(
                "-", *[F.col(c).cast("string") for c in
                       ("student_id", "academic_period_id", "grade", "grade_track")]
            ).alias("student_enrollment_id"),
            F.col("grade").alias("grade_at_result"),
            "grade_track", "base_score", "dynamic_bonus",
            (F.col("base_score") + F.col("dynamic_bonus")).cast("decimal(12,4)").alias("total_score"),
            F.col("return_flag").alias("raw_result_value"),
            F.when(F.col("line_status") == "F", F.col("ship_day")).alias("result_date"),
            F.lit("excel_import").alias("source_type"),
            F.lit(None).cast("string").alias("comment"),
        )

    @cached_property
    def links(self) -> DataFrame:
        return self.lines.select(
            F.col("line_key").alias("student_result_id"),
            "teacher_id",
            F.lit(100).cast("decimal(5,2)").alias("share_percent"),
            (F.col("base_score") + F.col("dynamic_bonus")).cast("decimal(12,4)")
            .alias("score_assigned"),
        )

    @cached_property
    def settings(self) -> DataFrame:
        """Funds by year."""
        price = F.col("o_totalprice").cast("decimal(14,2)")
        return (
            self.read("orders")
            .groupBy(F.year("o_orderdate").cast("bigint").alias("academic_period_id"))
            .agg(
                F.sum(price).alias("total_fund"),
                F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("dismissed_fund"),
                F.count("*").cast("decimal(14,6)").alias("uvsotr_value"),
            )
        )

    @cached_property
    def log(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_name"),
            F.lit("editor").alias("actor_role"),
            F.col("event_type").alias("action_type"),
            F.lit("student_result").alias("entity_type"),
            F.col("user_id").cast("string").alias("entity_id"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
        )

    # --- stored outcomes ----------------------------------------------------

    def _stored(self, *keys: str) -> DataFrame:
        score = F.col("base_score") + F.col("dynamic_bonus")
        return (
            self.lines.groupBy(*keys)
            .agg(
                F.sum(score).alias("points"),
                F.count_distinct("student_id").alias("students"),
                F.max("ship_day").alias("last_day"),
            )
            .select(
                F.concat_ws("-", *keys).alias("id"),
                "academic_period_id", "teacher_id",
                F.col("points").cast("decimal(14,4)").alias("raw_points"),
                (F.col("points") / 2).cast("decimal(14,4)").alias("normalized_points"),
                F.lit(0).cast("decimal(18,10)").alias("reverse_weight"),
                F.lit(0).cast("decimal(18,10)").alias("employee_share"),
                F.lit(0).cast("decimal(14,4)").alias("uvsotr_amount"),
                F.col("points").cast("decimal(14,2)").alias("final_amount"),
                F.col("students").cast("int").alias("student_count_with_results"),
                F.col("students").cast("int").alias("total_student_count"),
                F.lit(None).cast("decimal(14,6)").alias("avg_group_ratio"),
                F.lit(False).alias("is_dismissed_snapshot"),
                F.col("last_day").cast("timestamp").alias("calculated_at"),
            )
        )

    @cached_property
    def calculations(self) -> DataFrame:
        """An older snapshot: one row by period and teacher."""
        return self._stored("academic_period_id", "teacher_id")

    @cached_property
    def calculation_history(self) -> DataFrame:
        """Several calculations by period and teacher, one per track."""
        return self._stored("academic_period_id", "teacher_id", "grade_track")

    @cached_property
    def items(self) -> DataFrame:
        """The results behind the older snapshot."""
        return self.lines.select(
            F.concat_ws("-", "academic_period_id", "teacher_id").alias("teacher_calculation_id"),
            F.col("line_key").alias("student_result_id"),
            "academic_period_id", "student_id",
            (F.col("base_score") + F.col("dynamic_bonus")).cast("decimal(12,4)")
            .alias("base_points"),
        )

    # --- staging ------------------------------------------------------------

    @cached_property
    def named_lines(self) -> DataFrame:
        """Line items with names as people type them: capitals and stray blanks
        by return flag and line status."""
        students = self.read("customer").select(
            F.col("c_custkey").alias("student_id"), F.translate("c_name", "#", " ").alias("s_name")
        )
        typed = (
            F.when(F.col("return_flag") == "R", F.concat(F.lit("  "), F.upper("s_name")))
            .when(F.col("return_flag") == "A", F.concat(F.replace("s_name", F.lit(" "), F.lit("   ")), F.lit(" ")))
            .otherwise(F.col("s_name"))
        )
        return self.lines.join(students, "student_id").withColumn("student_name", typed)

    @cached_property
    def staged_results(self) -> DataFrame:
        criteria = self.criteria.select(
            F.col("id").alias("criterion_id"), F.col("name").alias("criterion_name")
        )
        bonus = F.nullif(F.col("dynamic_bonus"), F.lit(0).cast("decimal(12,4)"))
        return self.named_lines.join(criteria, "criterion_id").select(
            F.col("line_key").alias("row_key"),
            "student_name", "criterion_name", "base_score",
            bonus.alias("dynamic_bonus"),
            (F.col("base_score") + F.col("dynamic_bonus")).cast("decimal(12,4)").alias("total_score"),
        )

    @cached_property
    def staged_matrix(self) -> DataFrame:
        typed = F.when(
            F.col("line_status") == "O", F.concat(F.lit(" s.   "), _padded("teacher_id", 9))
        ).otherwise(F.concat(F.lit("S. "), _padded("teacher_id", 9)))
        return self.named_lines.select(
            F.col("line_key").alias("row_key"),
            "student_name", "grade", "grade_track", typed.alias("teacher_name"),
        )

    # --- second batches -----------------------------------------------------

    @cached_property
    def given_teachers(self) -> DataFrame:
        """The known teachers typed in capitals, and all customers as new ones."""
        known = self.read("supplier").select(
            F.concat(F.lit("  "), F.upper("s_name"), F.lit(" ")).alias("full_name")
        )
        return known.unionByName(self.read("customer").select(F.col("c_name").alias("full_name")))

    @cached_property
    def older_criteria(self) -> DataFrame:
        """What was known before the batch; the dearer parts have other codes."""
        prefix = F.when(F.col("p_retailprice") < 950, "c").otherwise("o")
        return self.read("part").select(
            F.concat(prefix, F.col("p_partkey").cast("string")).alias("code"),
            F.lower("p_type").alias("criterion_group_id"),
            F.col("p_name").alias("name"),
            F.lit("old").alias("raw_value_label"),
            F.col("p_size").cast("decimal(12,4)").alias("base_score"),
            F.col("p_size").cast("decimal(12,4)").alias("max_dynamic_bonus"),
            F.lit(True).alias("is_active"),
            F.lit(0).alias("sort_order"),
            F.lit("2020-01-01").cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def given_criteria(self) -> DataFrame:
        return self.read("part").select(
            F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"),
            F.lower("p_type").alias("group_code"),
            F.upper("p_name").alias("name"),
            F.col("p_brand").alias("raw_value_label"),
            (F.col("p_size") + 1).cast("decimal(12,4)").alias("base_score"),
            (F.col("p_size") <= 45).alias("is_active"),
            F.col("p_size").alias("sort_order"),
        )

    @cached_property
    def older_weights(self) -> DataFrame:
        return self._weights("F", F.min("quantity")).select(
            "criterion_id", "grade", "grade_track", "weight_value"
        )

    @cached_property
    def given_weights(self) -> DataFrame:
        return self._weights("O", F.max("quantity")).select(
            F.concat(F.lit("c"), F.col("criterion_id").cast("string")).alias("code"),
            "grade", "grade_track", "weight_value",
        )

    def _weights(self, line_status: str, quantity: Column) -> DataFrame:
        lines = self.lines.where(F.col("line_status") == line_status)
        return lines.groupBy("criterion_id", "grade", "grade_track").agg(
            (quantity / 100).cast("decimal(12,6)").alias("weight_value")
        )

    @cached_property
    def given_settings(self) -> DataFrame:
        price = F.col("o_totalprice").cast("decimal(14,2)")
        return (
            self.read("orders")
            .groupBy(F.year("o_orderdate").cast("string").alias("period_name"))
            .agg(
                F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("total_fund"),
                F.lit(0).cast("decimal(38,2)").alias("dismissed_fund"),
            )
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Every line item as a change to the first result of its order."""
        # the lines come by order already: they are read and shuffled once
        first = F.min("line_key").over(Window.partitionBy("l_orderkey"))
        quantity, open_line = F.col("quantity"), F.col("line_status") == "O"
        return self.lines.withColumn("result_id", first).select(
            F.col("line_key").alias("change_id"),
            F.when(quantity == 49, "merge")
            .when(F.col("return_flag") == "R", "delete")
            .when(F.col("return_flag") == "A", "update")
            .otherwise("create").alias("op"),
            F.when(quantity == 31, F.concat(F.lit("x"), F.col("result_id")))
            .otherwise(F.col("result_id")).alias("result_id"),
            F.when(F.col("tax") != 0.01, F.col("student_id")).alias("student_id"),
            F.when(quantity == 5, F.lit(-1)).otherwise(F.col("criterion_id")).alias("criterion_id"),
            F.when(quantity == 7, F.lit(0)).otherwise(F.col("grade")).cast("smallint")
            .alias("grade_at_result"),
            F.when(quantity == 11, "evening").otherwise(F.col("grade_track")).alias("grade_track"),
            F.when(quantity == 13, "n/a").when(F.col("dynamic_bonus") == 0, "")
            .otherwise(F.col("dynamic_bonus").cast("string")).alias("dynamic_bonus"),
            F.when(open_line, "").otherwise(F.col("return_flag")).alias("raw_result_value"),
            F.when(quantity == 17, "bad").when(open_line, "")
            .otherwise(F.date_format("ship_day", "yyyy-MM-dd")).alias("result_date"),
            F.when(open_line, "").otherwise(F.lit("checked")).alias("comment"),
            F.when(~open_line, F.concat(F.lit("user-"), F.col("teacher_id").cast("string")))
            .alias("actor_name"),
        )

    # --- rows that break rules ----------------------------------------------

    @cached_property
    def broken_results(self) -> DataFrame:
        """Results with something wrong at certain quantities and taxes."""
        quantity = F.col("quantity")
        return self.lines.select(
            F.col("line_key").alias("id"),
            "academic_period_id",
            F.when(quantity != 3, F.col("student_id")).alias("student_id"),
            F.when(quantity == 2, F.lit(-1)).otherwise(F.col("criterion_id")).alias("criterion_id"),
            F.when(F.col("tax") == 0.08, F.col("grade") + 3).otherwise(F.col("grade"))
            .cast("smallint").alias("grade_at_result"),
            F.when(quantity == 11, "evening").otherwise(F.col("grade_track")).alias("grade_track"),
            F.when(quantity == 50, -F.col("base_score")).otherwise(F.col("base_score"))
            .alias("base_score"),
            F.when(F.col("tax") != 0, F.col("dynamic_bonus")).alias("dynamic_bonus"),
            F.when(quantity == 1, F.repeat(F.lit("x"), 101)).otherwise(F.col("return_flag"))
            .alias("raw_result_value"),
        )

    @cached_property
    def wide_numbers(self) -> DataFrame:
        """Scores as text, some too large for their column."""
        return self.lines.select(
            F.col("line_key").alias("id"),
            F.concat(
                F.col("quantity").cast("int").cast("string"),
                F.when(F.col("quantity") > 45, "00000000").otherwise(""),
            ).alias("base_score"),
            F.when(F.col("quantity") == 13, "n/a")
            .otherwise(F.col("dynamic_bonus").cast("string")).alias("dynamic_bonus"),
        )
