"""Arithmetic of points, shares and typed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritpool.functions.text import empty_to_null
from meritpool.schemas import TRACKS


def share_of(part: Column, total: Column) -> Column:
    """part / total, 0 where the total is missing or not positive."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def part_of_fund(fund: Column, part: Column, total: Column) -> Column:
    """fund * part / total; null without a fund or a positive total."""
    return F.when(fund.isNotNull() & (total > 0), fund * (part / total))


def reverse_weight(points: Column) -> Column:
    return F.when(points > 0, F.lit(1.0) / points).otherwise(F.lit(0.0))


def exact_sum(value: Column) -> Column:
    """The sum of doubles, the same to the last bit in whatever order they come.

    Each double is cut into a decimal of twelve places and what is left of it, as a decimal of
    thirty; decimals add up exactly. For values and sums below 1e26.
    """
    upper = value.cast("decimal(38,12)")
    lower = ((value - upper.cast("double")) * 1e12).cast("decimal(38,18)")
    return F.sum(upper).cast("double") + F.sum(lower).cast("double") * 1e-12


def track_rank(track: Column) -> Column:
    """Place of a track in declaration order; null for any other word."""
    ranks = [F.when(track == word, F.lit(place)) for place, word in enumerate(TRACKS)]
    return F.coalesce(*ranks)


def max_track(track: Column) -> Column:
    """Highest track by declaration order (a maximum of the words would go by
    the alphabet); null where no row has one."""
    highest = F.max(track_rank(track))
    return F.coalesce(*[F.when(highest == place, F.lit(w)) for place, w in enumerate(TRACKS)])


def number_from_text(text: Column) -> Column:
    """A score from form text; null where it is empty or no number."""
    return empty_to_null(F.trim(text)).try_cast("decimal(12,4)")


def missing_number(number: Column) -> Column:
    return F.coalesce(number, F.lit(0)) == 0


def missing_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""
