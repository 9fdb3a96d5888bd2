"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value: ColumnLike, decimals: int = 0) -> Column:
    """Round halves towards +infinity (Spark's ``round`` moves them away from zero)."""
    if decimals == 0:
        return F.floor(col(value) + F.lit(0.5))
    factor = F.lit(float(10**decimals))
    return F.floor(col(value) * factor + F.lit(0.5)) / factor


def clamp(value: ColumnLike, low: ColumnLike | float, high: ColumnLike | float) -> Column:
    low_c = F.lit(low) if isinstance(low, (int, float)) else col(low)
    high_c = F.lit(high) if isinstance(high, (int, float)) else col(high)
    # greatest/least skip nulls, so a missing value has to be kept missing by hand.
    return F.when(col(value).isNotNull(), F.greatest(low_c, F.least(high_c, col(value))))


def is_finite(value: ColumnLike) -> Column:
    """True only for a non-null, non-NaN, non-infinite number."""
    number = col(value).cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def between(value: ColumnLike, low: float, high: float) -> Column:
    """Finite and inside the closed interval; null counts as outside."""
    return is_finite(value) & F.coalesce((col(value) >= low) & (col(value) <= high), F.lit(False))


def holds(condition: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(condition, F.lit(False))


def reasons(checks: Iterable[tuple[str, Column]]) -> Column:
    """Names of the failed checks, in the order given; each pair is (name, condition that must hold)."""
    items = [F.when(~holds(ok), F.lit(name)) for name, ok in checks]
    return F.filter(F.array(*items), lambda item: item.isNotNull())


def split_valid(df: DataFrame, checks: Iterable[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every check, the rest with ``reject_reasons``)."""
    marked = df.withColumn("reject_reasons", reasons(list(checks)))
    valid = marked.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return valid, marked.filter(F.size("reject_reasons") > 0)


def require_all_valid(df: DataFrame, checks: Iterable[tuple[str, Column]], what: str) -> DataFrame:
    """Strict form: the job fails on the first row that breaks a check."""
    marked = df.withColumn("_rejects", reasons(list(checks)))
    problem = F.concat(F.lit(f"{what}: "), F.array_join("_rejects", ","))
    ok = F.size("_rejects") == 0
    return marked.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))).drop("_rejects")


def steps(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Add columns stage by stage, so a long formula stays a flat chain of projections."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables. Spark's guess of its size misses rows that were unfolded and how well
    files are packed, so it might pass through the driver as a broadcast; it is merged instead."""
    return df.hint("merge")
