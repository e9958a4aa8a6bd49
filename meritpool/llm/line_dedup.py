"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is its lines without blank ones, compared without spaces at the ends.
A run of RUN lines that also stands earlier, in the order of (doc_id, text key,
place), is a repeat, and every line of it goes. So a repeated passage goes as a whole if
it has RUN lines or more, and its first place stays.

Each window of RUN line hashes selects its smallest, the rightmost where some are
equal. Equal windows select the same place, so a repeat never goes unseen though
only selected lines are looked up. Lines whose hash is selected somewhere else too are
extended both ways to the windows that selected them; those are joined with their
first place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritpool.llm.frames import text_key

#: Lines of the shortest repeat that is removed.
RUN = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not once for each use."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _solid(text: Column) -> Column:
    """Line hashes of the lines that are not blank."""
    return F.transform(
        F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != F.lit("")), lambda x: F.xxhash64(x)
    )


def _selected(hashes: Column, run: int) -> Column:
    """The place that each window of ``run`` hashes selects."""

    def place(start: Column) -> Column:
        window = F.reverse(F.slice(hashes, start + 1, run))
        return start + run - F.array_position(window, F.array_min(window)).cast("int")

    return F.when(F.size(hashes) >= run, F.transform(F.sequence(F.lit(0), F.size(hashes) - run), place)).otherwise(
        F.array().cast("array<int>")
    )


def _prints(text: Column, run: int) -> Column:
    """For each selected line its hash, the first window that selects it, and the lines of all that do."""

    def changes(selected: Column) -> Column:
        at = F.transform(selected, lambda p, i: F.when((i == 0) | (p != F.get(selected, i - 1)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def rows(hashes: Column, selected: Column, starts: Column) -> Column:
        def row(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(selected))
            return F.struct(
                F.get(hashes, F.get(selected, start)).alias("print"),
                start.alias("start"),
                F.slice(hashes, start + 1, end - start + run - 1).alias("around"),
            )

        return F.transform(starts, row)

    return _let(
        _solid(text),
        lambda h: _let(_selected(h, run), lambda s: _let(changes(s), lambda c: rows(h, s, c))),
    )


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Windows of ``run`` lines that stand earlier too.

    doc_id, key, start (place among the lines that are not blank), and first: the
    doc_id, key and start of the earliest such window. A line or window that a
    large part of the documents share is counted in the map tasks first; the joins
    have an exchange on both sides, so that Spark can split its rows.
    """
    prints = docs.select("doc_id", text_key().alias("key"), F.inline(_prints(F.col("text"), run)))
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print").hint("rebalance")
    around = prints.join(shared, "print", "left_semi")

    def window(i: Column) -> Column:
        lines = F.slice("around", i + 1, run)
        return F.struct((F.col("start") + i).alias("start"), F.xxhash64(lines).alias("h"), F.hash(lines).alias("g"))

    windows = around.select(
        "doc_id", "key", F.inline(F.transform(F.sequence(F.lit(0), F.size("around") - run), window))
    )
    first = (
        windows.groupBy("h", "g")
        .agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
        .hint("rebalance")
    )
    return windows.join(first, ["h", "g"]).where(~F.struct("doc_id", "key", "start").eqNullSafe(F.col("first"))).drop("h", "g")


def dedup_rows(docs: DataFrame, run: int = RUN) -> DataFrame:
    """row (the columns of ``docs``), kept (the text that is left), n_lines and n_removed.

    n_lines counts all lines, blank ones too, which always stay. A null text stays
    null, with no lines. Rows that agree in doc_id and text are one document: a
    repeat between them does not count. A null doc_id comes before all others. Texts of
    fewer than ``run`` lines are left as they are. Extra columns, whatever their names, come
    through in row. An empty table gives no rows.
    """
    found = repeats(docs.select("doc_id", "text"), run)
    # windows of repeated rows of one document come more than once
    gone = found.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["text"].alias("text"), text_key().alias("key"))
    joined = rows.join(gone, rows["row.doc_id"].eqNullSafe(gone["doc_id"]) & (rows["key"] == gone["key"]), "left")

    def places(lines: Column) -> Column:
        solid = F.transform(lines, lambda x, i: F.when(F.trim(x) != F.lit(""), i))
        return F.filter(solid, lambda i: i.isNotNull())

    def left(lines: Column, solid: Column) -> Column:
        covered = F.flatten(F.transform("starts", lambda s: F.slice(solid, s + 1, run)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("kept"),
            (F.size(lines) - F.size(kept)).alias("n_removed"),
        )

    cut = F.when(
        F.col("starts").isNotNull(), _let(_lines(F.col("text")), lambda x: _let(places(x), lambda s: left(x, s)))
    ).otherwise(F.struct(F.col("text").alias("kept"), F.lit(0).alias("n_removed")))
    return joined.select("row", cut.alias("cut"), F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines")).select(
        "row", "cut.kept", F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "cut.n_removed"
    )


def dedup(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with the repeats cut out of their text."""
    out = dedup_rows(docs, run)
    return out.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
