"""The three conventions for undefined ratios, kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_one(numerator: Column, denominator: Column) -> Column:
    """One when the denominator is zero (preservation of an empty set)."""
    return F.coalesce(ratio(numerator, denominator), F.lit(1.0))


def exact_prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 where empty against empty is perfect and any other zero denominator is 0."""
    nothing = (tp + fp + fn) == 0

    def part(numerator: Column, denominator: Column) -> Column:
        return F.when(nothing, F.lit(1.0)).otherwise(F.coalesce(ratio(numerator, denominator), F.lit(0.0)))

    return part(tp, tp + fp), part(tp, tp + fn), part(2 * tp, 2 * tp + fp + fn)


def nullable_prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 where every undefined value is null."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def mean_and_defined(name: str, column: Column | None = None) -> list[Column]:
    """Mean over the rows where a metric is defined, and how many those are."""
    column = F.col(name) if column is None else column
    return [F.avg(column).alias(name), F.count(column).alias(f"{name}_defined")]
