"""Invariants, as queries that return their violations or raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def must_be_empty(violations: DataFrame, what: str) -> None:
    if some := violations.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not there: runs, cases or accessions."""
    return expected.select(*keys).distinct().join(actual.select(*keys), keys, "left_anti")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in both, which must be none for disjoint stages."""
    return a.select(*keys).intersect(b.select(*keys))


def same_rows(before: DataFrame, after: DataFrame) -> None:
    """A merge must not add or lose rows."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"{n} rows before, {m} after")


def updated_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> int:
    """Distinct keys whose strategy changed."""
    changed = before.select(*keys, F.col("strategy").alias("s")).join(after.select(*keys, F.col("strategy").alias("t")), keys).where("s <> t")
    return changed.select(*keys).distinct().count()


def unique(rows: DataFrame, keys: list[str], what: str) -> None:
    must_be_empty(rows.groupBy(*keys).count().where("count > 1"), what)


def known(wanted: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """The first lookup row of each wanted key; a key without one raises."""
    must_be_empty(missing(wanted, lookup, [key]), f"no {key} for")
    return lookup.join(wanted.select(key).distinct(), key, "left_semi").dropDuplicates([key])
