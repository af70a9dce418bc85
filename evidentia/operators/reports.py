"""Aggregate analytics over trace tables.

Every report is a declarative aggregation: one pass with conditional counts
instead of separate scans, explicit pivot values, and a stated tie-break wherever
an order matters.  Percentages of nothing are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_name, percent
from ..schema import LLM, NOT_FOUND, STRATEGIES
from ..scratch import store
from .sampling import order_key

# Attribute names, normalised, that hold free text.
FREE_TEXT_FIELDS = [
    "title", "samplename", "sourcename", "comment", "submitterid", "studyname", "submittedsampleid", "biospecimenrepositorysampleid",
    "biospecimenrepository", "sample", "sampledescription", "submitterhandle", "description", "name", "sampleid", "group", "id", "identifier",
    "label", "accession",
]


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def coverage(trace: DataFrame, *by: str) -> DataFrame:
    """Total, resolved and residual values, and the share resolved."""
    total, resolved = F.count("*"), count_if(F.col("strategy") != NOT_FOUND)
    out = trace.groupBy(*by).agg(total.alias("total"), resolved.alias("resolved"), (total - resolved).alias("residual"))
    return out.withColumn("pct_resolved", percent(F.col("resolved"), F.col("total")))


def reconciled_coverage(trace: DataFrame, passes: list[str]) -> DataFrame:
    """Coverage with the values that each pass of the model resolved; one row."""
    by = [count_if((F.col("strategy") == LLM) & (F.col("llm_pass") == p)).alias(f"llm_{p}") for p in passes]
    found = count_if(F.col("strategy").isin(STRATEGIES)).alias("deterministic")
    out = trace.agg(F.count("*").alias("total"), found, *by, count_if(F.col("strategy") == NOT_FOUND).alias("residual"))
    return out.withColumn("pct_deterministic", percent(F.col("deterministic"), F.col("total"))).withColumn("pct_residual", percent(F.col("residual"), F.col("total")))


def negated_by_field(trace: DataFrame, field: str = "target_field") -> DataFrame:
    """Per field the residual values and how many of them were negated; a field without any shows 0."""
    rows = trace.where((F.col("strategy") == NOT_FOUND) & F.col(field).isNotNull())
    out = rows.groupBy(field).agg(count_if(F.col("row_negated")).alias("n_negated"), F.count("*").alias("n_residual"))
    return out.withColumn("pct_negated", percent(F.col("n_negated"), F.col("n_residual"))).orderBy(F.desc("n_negated"), field)


def confusion(pairs: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """Confusion counts with precision, recall and accuracy, NaN where they have no denominator."""
    rows = pairs.select(*by, predicted.alias("p"), actual.alias("a"))
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    counts = {"tp": F.col("p") & F.col("a"), "fp": F.col("p") & ~F.col("a"), "fn": ~F.col("p") & F.col("a"), "tn": ~F.col("p") & ~F.col("a")}
    out = rows.groupBy(*by).agg(*[count_if(c).alias(n) for n, c in counts.items()])
    ratio = lambda top, bottom: F.when(bottom == 0, F.lit(float("nan"))).otherwise(top / bottom)
    tp, every = F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select("*", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(tp + F.col("tn"), every).alias("accuracy"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value with their share of all rows, nulls left out."""
    rows = rows.where(F.col(column).isNotNull())
    total = rows.agg(F.count("*").alias("_total"))
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counts.select(column, "n", percent(F.col("n"), F.col("_total")).alias("pct"))


def strategy_crosstab(trace: DataFrame, field: str = "target_field") -> DataFrame:
    """Counts by field and strategy in fixed columns, and the share found."""
    names = [*STRATEGIES, LLM, NOT_FOUND]
    out = trace.where(F.col(field).isNotNull()).groupBy(field).pivot("strategy", names).count().na.fill(0)
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    return out.withColumn("total", total).withColumn("pct_found", percent(F.col("total") - F.col(f"`{NOT_FOUND}`"), F.col("total")))


def strategy_buckets(crosstab: DataFrame, field: str = "target_field") -> DataFrame:
    """Four display groups of the crosstab as shares of each field's total."""
    groups = {"verbatim": STRATEGIES[:2], "tolerant": STRATEGIES[2:5], "ontology": STRATEGIES[5:], "model": [LLM]}
    part = lambda cols: sum((F.col(f"`{c}`") for c in cols[1:]), F.col(f"`{cols[0]}`"))
    return crosstab.select(field, *[percent(part(cols), F.col("total")).alias(f"pct_{name}") for name, cols in groups.items()])


def pass_tallies(rows: DataFrame, field: str = "target_field") -> DataFrame:
    """Accepted model rows of each field, those of the attributes pass apart."""
    found = F.col("strategy") == LLM
    return rows.groupBy(field).agg(count_if(found & (F.col("llm_pass") == "attributes")).alias("n_attributes"), count_if(found).alias("n_llm"))


def pooled(crosstab: DataFrame) -> DataFrame:
    """Totals over all fields and the share of each strategy, one row a strategy."""
    names = [*STRATEGIES, LLM, NOT_FOUND]
    sums = crosstab.agg(*[F.sum(f"`{n}`").alias(n) for n in names], F.sum("total").alias("total"))
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"`{n}`").alias("n")) for n in names])
    return sums.select(F.explode(rows).alias("r"), "total").select("r.strategy", "r.n", percent(F.col("r.n"), F.col("total")).alias("pct"))


def multi_match_share(trace: DataFrame) -> DataFrame:
    found = F.col("strategy") != NOT_FOUND
    out = trace.agg(count_if(found).alias("n_found"), count_if(found & (F.col("n_matches") > 1)).alias("n_multi"))
    return out.withColumn("pct_multi", percent(F.col("n_multi"), F.col("n_found")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows share their key with another (all of them count), and distinct keys."""
    counts = rows.groupBy(*keys).count()
    return counts.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n_duplicate_rows"), F.count("*").alias("n_distinct_keys"))


def agreement(rows: DataFrame, case: str, condition: str, values: list[str], verdict: str) -> DataFrame:
    """Agreement of two conditions over the cases that have both, and flips either way.

    A case that has a condition twice raises.
    """
    first, second = values
    pick = lambda v: F.max(F.when(F.col(condition) == v, F.col(verdict)))
    cells = rows.where(F.col(condition).isin(values)).groupBy(case).agg(*[pick(v).alias(n) for v, n in ((first, "x"), (second, "y"))], *[count_if(F.col(condition) == v).alias(n) for v, n in ((first, "nx"), (second, "ny"))])
    once = F.when((F.col("nx") > 1) | (F.col("ny") > 1), F.raise_error(F.lit("a case has a condition twice")).cast("boolean")).otherwise(True)
    both = cells.where(once).where("x is not null and y is not null")
    out = both.agg(F.count("*").alias("n_cases"), count_if(F.col("x") == F.col("y")).alias("n_agree"), count_if(F.col("x") & ~F.col("y")).alias("n_lost"), count_if(~F.col("x") & F.col("y")).alias("n_gained"))
    return out.withColumn("agreement", F.try_divide("n_agree", "n_cases"))


def hallucinations(rows: DataFrame, *by: str) -> DataFrame:
    """Verdicts of found that were not accepted, as some quote is not in the record."""
    said = F.col("llm_verdict")
    return rows.groupBy(*by).agg(count_if(said).alias("n_claimed"), count_if(said & ~F.coalesce("accepted", F.lit(False))).alias("n_hallucinated"))


def symbol_collisions(trace: DataFrame, term_id: str, expected: list[str]) -> DataFrame:
    """Rows that were given a term although their value is none of its usual names."""
    rows = trace.where(F.col("assigned_term_id") == term_id)
    out = rows.agg(F.count("*").alias("n_rows"), count_if(~F.lower("target_value").isin([e.lower() for e in expected])).alias("n_other"))
    return out.withColumn("pct_other", percent(F.col("n_other"), F.col("n_rows")))


def explode_raw_fields(trace: DataFrame) -> DataFrame:
    """One row for each matched raw field of a found value; a found row without any keeps a null."""
    rows = trace.where(F.col("strategy") != NOT_FOUND)
    return rows.select(*[c for c in trace.columns if c != "raw_fields"], F.explode_outer("raw_fields").alias("raw_field"))


def normalized_field_counts(fields: DataFrame, column: str = "raw_field") -> DataFrame:
    """Occurrences of each field name, spelling variants together, and whether it holds free text."""
    rows = fields.where(F.col(column).isNotNull()).select(field_name(F.col(column)).alias("field"))
    return rows.groupBy("field").agg(F.count("*").alias("n")).withColumn("is_free_text", F.col("field").isin(FREE_TEXT_FIELDS))


def concentration_curve(rows: DataFrame, column: str) -> DataFrame:
    """Cumulative share of the most frequent values; of equal counts the smaller name comes first.

    The counts are dealt to ranges in this order and written; each range sums up by
    itself and is moved by the totals of the ranges before, which are one row each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranged = store(counts.repartitionByRange(parts, F.desc("n"), F.asc(column)).withColumn("_p", F.spark_partition_id()), "counts")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))
    totals = totals.select("_p", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    order = Window.partitionBy("_p").orderBy(F.desc("n"), F.asc(column))
    out = ranged.withColumn("_r", F.row_number().over(order)).withColumn("_s", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(F.broadcast(totals), "_p")  # one row a partition
    return out.select(column, "n", (F.col("_rank") + F.col("_r")).cast("int").alias("n_fields"), F.round(100 * (F.col("_upto") + F.col("_s")) / F.col("_all"), 4).alias("cumulative_pct"))


def rarefied(rows: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """Expected distinct values in k units, k the fewest units of any group, without sampling.

    A value that stands in m of N units is missed by k of them with probability
    C(N-m, k) / C(N, k), a product of m factors (N-k-i) / (N-i).
    """
    seen = rows.select(group, unit, value).dropna().distinct()
    units = seen.groupBy(group).agg(F.countDistinct(unit).alias("n_units"))
    k = units.agg(F.min("n_units").alias("k"))
    per_value = seen.groupBy(group, value).agg(F.count("*").alias("m")).groupBy(group, "m").agg(F.count("*").alias("n_values"))
    joined = per_value.join(units, group).crossJoin(F.broadcast(k))  # one row
    steps = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    big, kk = F.col("n_units"), F.col("k")
    missed = F.aggregate(steps, F.lit(1.0), lambda p, i: p * F.greatest(big - kk - i, F.lit(0)) / (big - i))
    joined = joined.withColumn("e", F.col("n_values") * (1 - missed))
    return joined.groupBy(group).agg(F.first("n_units").alias("n_units"), F.first("k").alias("k"), F.sum("n_values").alias("n_values"), F.round(F.sum("e"), 4).alias("expected_values"))


def rarefied_by_sampling(rows: DataFrame, group: str, unit: str, value: str, n_iter: int = 20, seed: int = 1) -> DataFrame:
    """(group, n_units, k, mean_values, std_values, n_iter): distinct values in seeded samples of k units, k the fewest units of any group.

    A draw gives each unit a hash, and a sample takes the k least of a group.  The
    k-th is found by counts of bins and the rows of one bin, so no task orders the
    units of a group.  A unit then has one bit a draw that takes it, and a value the
    bits of all its units: one narrow aggregation serves all draws, and no rows are
    made distinct before it.
    """
    draws = range(n_iter)
    seen = rows.select(group, unit, value).dropna()
    hashes = [F.conv(F.substring(order_key(seed, F.lit(d + 1), unit), 1, 15), 16, 10).cast("long").alias(f"h{d}") for d in draws]
    pairs = seen.select(group, unit).distinct()
    units = store(pairs.join(pairs.select(unit).distinct().select(unit, *hashes), unit), "units")
    sizes = units.groupBy(group).agg(F.count("*").alias("n_units"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.min("n_units").alias("k"))))  # one row
    each = units.select(group, F.posexplode(F.array(*[f"h{d}" for d in draws])).alias("draw", "h")).withColumn("bin", F.shiftright("h", 48))
    run = Window.partitionBy(group, "draw").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = each.groupBy(group, "draw", "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(run)).join(sizes, group)
    last = bins.where("upto >= k and upto - c < k").select(group, "draw", "bin", (F.col("k") - F.col("upto") + F.col("c")).alias("left"))
    inside = each.join(last, [group, "draw", "bin"]).withColumn("r", F.row_number().over(Window.partitionBy(group, "draw").orderBy("h")))
    cuts = inside.where("r = left").groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "h"))), lambda x: x["h"]).alias("cuts"))  # one number a draw
    words = range(0, n_iter, 63)  # of bits, in a long each
    taken = lambda d: F.when(F.col(f"h{d}") <= F.get("cuts", F.lit(d)), F.lit(1 << d % 63)).otherwise(0).cast("long")
    bits = [reduce(Column.bitwiseOR, [taken(d) for d in draws[w : w + 63]]).alias(f"b{w}") for w in words]
    masks = units.join(F.broadcast(cuts), group).select(group, unit, *bits).where(" or ".join(f"b{w} <> 0" for w in words))  # cuts: one row a group
    drawn = seen.join(masks, [group, unit]).groupBy(group, value).agg(*[F.bit_or(f"b{w}").alias(f"b{w}") for w in words])
    counts = drawn.groupBy(group).agg(*[F.count_if(F.col(f"b{d // 63 * 63}").bitwiseAND(F.lit(1 << d % 63).cast("long")) != 0).alias(f"d{d}") for d in draws])
    found = counts.select(group, F.explode(F.array(*[f"d{d}" for d in draws])).alias("d")).groupBy(group)
    out = found.agg(F.avg("d").alias("mean_values"), F.stddev_pop("d").alias("std_values"), F.count("*").alias("n_iter"))
    return sizes.join(out, group).select(group, "n_units", "k", "mean_values", "std_values", "n_iter")


def first_per_strategy(trace: DataFrame, order: list[str], strategies: list[str] = STRATEGIES, curated: DataFrame | None = None) -> DataFrame:
    """The first row of each strategy, in the fixed order of strategies, then the curated rows; columns that these lack are null."""
    place = F.array_position(F.array(*[F.lit(s) for s in strategies]), F.col("strategy"))
    ranked = trace.where(F.col("strategy").isin(strategies)).withColumn("_n", F.row_number().over(Window.partitionBy("strategy").orderBy(*order)))
    out = ranked.where("_n = 1").withColumn("_n", place)
    if curated is not None:
        out = out.unionByName(curated.withColumn("_n", F.lit(len(strategies) + 1).cast("long")), allowMissingColumns=True)
    return out.orderBy("_n").drop("_n")


def thin_labels(positions: DataFrame, at: str, gap: float = 6.0) -> DataFrame:
    """Labels kept from the top down so that neighbours are ``gap`` apart.

    For the few labels of a chart: they are folded as one array.
    """
    every = positions.agg(F.sort_array(F.collect_list(F.col(at).cast("double")), asc=False).alias("every"))
    far = lambda kept, x: (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1)) - x >= gap)
    kept = F.aggregate("every", F.array().cast("array<double>"), lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return every.select(F.explode(kept).alias(at))
