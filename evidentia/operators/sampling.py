"""Seeded, reproducible samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *keys: str | Column) -> Column:
    """A hash of the seed and the keys, by which rows are shuffled."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in columns]).cast("binary"))


def shuffled_head(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in an order that depends on the seed and the keys only."""
    return rows.orderBy(order_key(seed, *keys), *keys).limit(n)


def pattern_counts(rows: DataFrame, pattern: list[str]) -> DataFrame:
    """How often each pattern occurs."""
    return rows.groupBy(*pattern).agg(F.count("*").alias("n_occurrences"))


def sample_patterns(rows: DataFrame, pattern: list[str], occurrence: list[str], n: int, seed: int) -> DataFrame:
    """``n`` distinct patterns with one occurrence each and their number of occurrences.

    Raises if there are fewer patterns.
    """
    counts = pattern_counts(rows, pattern)
    if (have := counts.count()) < n:
        raise ValueError(f"{n} patterns wanted, {have} there")
    chosen = shuffled_head(counts, pattern, n, seed)
    order = Window.partitionBy(*pattern).orderBy(order_key(seed + 1, *occurrence), *occurrence)
    one = rows.join(F.broadcast(chosen), pattern).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return one.select(*pattern, *occurrence, "n_occurrences")


def with_case_index(cases: DataFrame, order: list[str]) -> DataFrame:
    """Numbers a small sample of cases from 0 in a stored order."""
    return cases.withColumn("case_index", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
