"""Search for a text inside of names, by an index of their letters.

The index has a row for each name and each three letters in a row that it holds, in
lower case; two marks after the end make a group begin at every letter. A name
that holds a text of three letters or more has all of its groups; one that holds a shorter text has
a group that begins with it. What the index names is then looked at itself, so the
outcome is that of a scan over all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.functions.text import contains_text

#: Letters of a group.
SIZE = 3
#: Stands after the end of a name.
END = "\x00"


def groups_of(name: Column) -> Column:
    """The different groups of a name; none of an empty or null one."""
    padded = F.concat(F.lower(name), F.lit(END * (SIZE - 1)))
    starts = F.sequence(F.lit(1), F.char_length(F.lower(name)))
    found = F.transform(starts, lambda i: F.substring(padded, i, F.lit(SIZE)))
    return F.when(F.char_length(F.lower(name)) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def name_index(names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """(letters, key) of all names, in the order of the letters, so that files and row
    groups hold few of them and a search reads those that can hold its own."""
    rows = names.select(F.explode(groups_of(F.col(name))).alias("letters"), F.col(key).alias("key"))
    return rows.repartitionByRange("letters", "key").sortWithinPartitions("letters", "key")


def candidates(index: DataFrame, query: str) -> DataFrame:
    """Keys of the names that may hold the text; ``query`` has a letter at least.

    Only rows of the text's own groups are read. A group that most names hold is counted in the
    map tasks first.
    """
    text = query.lower()
    if len(text) < SIZE:
        return index.where(F.col("letters").startswith(text)).select("key").distinct()
    wanted = sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})
    rows = index.where(F.col("letters").isin(wanted))
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("key")


def holding(
    names: DataFrame, index: DataFrame, query: str | None, name: str = "name", key: str = "id"
) -> DataFrame:
    """The rows of ``names`` that hold the text, ignoring case; all of them without one."""
    text = (query or "").strip()
    if not text:
        return names
    keys = candidates(index, text).withColumnRenamed("key", key)
    return names.join(keys, key, "left_semi").where(contains_text(F.col(name), query)).select(*names.columns)
