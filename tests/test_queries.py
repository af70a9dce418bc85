"""Every query of the catalogue runs; those with SQL agree with it."""

import pytest
from tests.oracle import compare

from evidentia.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs_and_repeats(spark, name):
    rows = lambda: sorted(map(repr, QUERIES[name](spark, SF).collect()))
    first = rows()
    assert first and first == rows()


def test_sampled_rarefaction_is_near_the_closed_form(spark):
    exact = {r["year"]: r["expected_values"] for r in QUERIES["rarefaction_exact"](spark, SF).collect()}
    for r in QUERIES["rarefaction_mc"](spark, SF).collect():
        assert abs(r["mean_values"] - exact[r["year"]]) <= 4 * r["std_values"] / r["n_iter"] ** 0.5 + 1e-6


def test_shards_of_the_residual_are_disjoint_and_complete(spark):
    from pyspark.sql import functions as F

    from evidentia.functions.text import shard_of

    rows = spark.range(1000).select(F.col("id").cast("string").alias("a"))
    counts = [rows.where(shard_of(F.col("a"), 4) == k).count() for k in range(4)]
    assert sum(counts) == 1000 and min(counts) > 150


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["trace_normalized", "trace_fuzzy", "priority_filter", "trace_ontology", "trace_bag_of_words"])
def test_rows_of_one_row_group_go_to_many_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4  # spark.sql.shuffle.partitions; the scan is one task
