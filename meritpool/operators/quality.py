"""Validity rules as frames of violations (table, rule, row)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.operators.deletes import deletion
from meritpool.operators.joins import spread_join
from meritpool.schemas import ENUMS, Table


def _false(condition: Column) -> Column:
    """True where a rule is broken; a null outcome passes, as in SQL."""
    return F.coalesce(~condition, F.lit(False))


def check_rules(table: Table) -> dict[str, Column]:
    return {name: _false(F.expr(sql)) for name, sql in table.checks.items()}


def required_rules(table: Table) -> dict[str, Column]:
    return {f"{c.name}_required": F.col(c.name).isNull() for c in table.columns if c.required}


def enum_rules(table: Table) -> dict[str, Column]:
    return {
        f"{c.name}_word": _false(F.col(c.name).isin(*ENUMS[c.enum]))
        for c in table.columns
        if c.enum
    }


def length_rules(table: Table) -> dict[str, Column]:
    return {
        f"{c.name}_length": _false(F.char_length(c.name) <= c.length)
        for c in table.columns
        if c.length
    }


def precision_rules(table: Table) -> dict[str, Column]:
    """For incoming text or wider numbers: the value must fit the column."""
    return {
        f"{c.name}_precision": F.col(c.name).isNotNull() & F.col(c.name).try_cast(c.type).isNull()
        for c in table.columns
        if c.type.startswith("decimal")
    }


ROW_RULES = {
    "checks": check_rules,
    "required": required_rules,
    "enum": enum_rules,
    "length": length_rules,
    "precision": precision_rules,
}


def row_rules(table: Table, df: DataFrame, kinds: Sequence[str] = tuple(ROW_RULES)) -> dict[str, Column]:
    """The rules of one row that ``df`` holds the columns for."""
    held = set(df.columns)
    known = {c.name for c in table.columns}
    rules: dict[str, Column] = {}
    for kind in kinds:
        for name, broken in ROW_RULES[kind](table).items():
            needed = _columns_of(table, kind, name)
            if needed & known <= held:
                rules[name] = broken
    return rules


def _columns_of(table: Table, kind: str, rule: str) -> set[str]:
    if kind != "checks":
        return {rule.rsplit("_", 1)[0]}
    words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", table.checks[rule])))
    return {c.name for c in table.columns if c.name in words}


def skipped_rules(table: Table, df: DataFrame, kinds: Sequence[str] = tuple(ROW_RULES)) -> list[str]:
    """The rules of one row that cannot be checked, as ``df`` lacks a column."""
    held = row_rules(table, df, kinds)
    return [name for kind in kinds for name in ROW_RULES[kind](table) if name not in held]


def broken_text(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks, by commas; empty for a sound row."""
    return F.concat_ws(",", *[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def rule_list(text: Column) -> Column:
    """The names as an array. Kept as text until then, as text stays in
    compiled code where a filter over an array would not."""
    return F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def row_violations(
    df: DataFrame, table: Table, key: str = "id", kinds: Sequence[str] = tuple(ROW_RULES)
) -> DataFrame:
    """All rules of single rows in one pass over the table."""
    broken = broken_text(row_rules(table, df, kinds))
    return (
        df.select(F.col(key).cast("string").alias("row_key"), broken.alias("_rules"))
        .where("_rules <> ''")
        .select(
            F.lit(table.name).alias("table_name"),
            F.explode(F.split("_rules", ",")).alias("rule"),
            "row_key",
        )
    )


def divert(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that pass and rows that do not, the latter with ``rules``."""
    marked = df.withColumn("_rules", broken_text(rules))
    passed = marked.where("_rules = ''").drop("_rules")
    failed = marked.where("_rules <> ''").withColumn("rules", rule_list(F.col("_rules")))
    return passed, failed.drop("_rules")


def unique_violations(df: DataFrame, table: Table) -> DataFrame:
    """Keys held by more than one row; a null in the key never conflicts."""
    found = None
    for key in table.unique:
        counted = (
            df.where(" and ".join(f"{k} is not null" for k in key))
            .groupBy(*key)
            .agg(F.count("*").alias("n_rows"))
            .where("n_rows > 1")
            .select(
                F.lit(table.name).alias("table_name"),
                F.lit("_".join(key) + "_unique").alias("rule"),
                F.concat_ws("|", *key).alias("row_key"),
                "n_rows",
            )
        )
        found = counted if found is None else found.unionByName(counted)
    return found


def reference_violations(
    df: DataFrame, table: Table, parents: dict[str, DataFrame], key: str = "id"
) -> DataFrame:
    """Rows that name a parent which is not there. Nulls name none.

    All references are looked at in one pass: the distinct keys that the rows
    name are held against the parents, and only missing keys, few as a rule,
    are joined back to the rows, salted, as a reference to a table of few rows has nothing but
    hot keys. References whose parent or column is not given
    are left out; ``unchecked_references`` names them.
    """
    refs = [r for r in table.references if r.table in parents and r.column in df.columns]
    if not refs:
        raise ValueError(f"no reference of {table.name} can be checked")
    named = df.select(
        F.col(key).cast("string").alias("row_key"),
        F.explode(
            F.array(*[
                F.struct(F.lit(f"{r.column}_known").alias("rule"), F.col(r.column).cast("string").alias("named"))
                for r in refs
            ])
        ).alias("_ref"),
    ).select("row_key", "_ref.rule", "_ref.named").where("named is not null")
    known = None
    for ref in refs:
        ids = parents[ref.table].select(
            F.lit(f"{ref.column}_known").alias("rule"), F.col("id").cast("string").alias("named")
        )
        known = ids if known is None else known.unionByName(ids)
    missing = named.select("rule", "named").distinct().join(known, ["rule", "named"], "left_anti")
    return spread_join(named, missing, ["rule", "named"], "left_semi", ["row_key"]).select(
        F.lit(table.name).alias("table_name"), "rule", "row_key"
    )


def unchecked_references(df: DataFrame, table: Table, parents: dict[str, DataFrame]) -> list[str]:
    return [
        r.column for r in table.references
        if r.table not in parents or r.column not in df.columns
    ]


def restrict_violations(
    deleted: DataFrame, children: Sequence[tuple[Table, DataFrame]], parent: Table
) -> DataFrame:
    """Deleted keys that rows of a restricting child still name."""
    found = None
    for child, rows in children:
        for ref in child.references:
            if ref.table != parent.name or ref.on_delete != "restrict":
                continue
            used = rows.select(F.col(ref.column).alias("id")).distinct()
            still = deleted.select("id").join(used, "id", "left_semi").select(
                F.lit(parent.name).alias("table_name"),
                F.lit(f"used_by_{child.name}").alias("rule"),
                F.col("id").cast("string").alias("row_key"),
            )
            found = still if found is None else found.unionByName(still)
    return found


def cascade(
    deleted: DataFrame, children: Sequence[tuple[Table, DataFrame]], parent: Table
) -> dict[str, DataFrame]:
    """What deletes in ``parent`` leave of the tables below it: rows of a cascading
    reference go with all that hangs on them, a set-null reference is emptied."""
    tables = {child.name: rows for child, rows in children}
    return deletion(tables, {parent.name: deleted}).after


def with_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Fill absent columns with the default; given nulls are left to the rules."""
    for c in table.columns:
        if c.name not in df.columns and c.default is not None:
            df = df.withColumn(c.name, F.expr(c.default).cast(c.type))
    return df


def with_null_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Fill nulls of columns that have a default as well as absent columns."""
    filled = with_defaults(df, table)
    return filled.withColumns(
        {
            c.name: F.coalesce(F.col(c.name), F.expr(c.default).cast(c.type))
            for c in table.columns
            if c.default is not None
        }
    )


def with_generated(df: DataFrame, table: Table) -> DataFrame:
    made = {c.name: F.expr(c.generated) for c in table.columns if c.generated}
    return df.withColumns(made) if made else df


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Defaults, generated columns, declared types and column order."""
    full = with_generated(with_defaults(df, table), table)
    return full.select(
        *[
            (F.col(c.name) if c.name in full.columns else F.lit(None)).cast(c.type).alias(c.name)
            for c in table.columns
        ]
    )
