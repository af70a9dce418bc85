"""Source mixing to target weights by capped water-filling.

Each source gets a share of the budget in proportion to its weight, but no more
than ``max_epochs`` times its own size; what the capped sources leave is shared
among the others by weight until none is above its cap.  A source then takes
whole repetitions of all its rows and, for the fraction that is left, the rows
that come first in a seeded hash order.

Scale: the hash order is cut by two levels of sums (buckets by the first digits
of the hash, as many as keep ``BUCKET_ROWS`` rows in one, then the rows of the one
bucket in which the cut falls), so no task orders a source.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

#: Words are maximal runs of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = 7
#: Rows of a bucket, about.
BUCKET_ROWS = 50_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")


def fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources get the weights in turn, in code point order, null last.  One row a
    source, so the unpartitioned windows see a few rows only.
    """
    ranked = sources.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int")).cast("long"))
    line = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("r").asc())
    before, rest = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("left", F.sum("source_size").over(whole) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(rest))
    level = level.withColumn("free", (F.col("w") * F.col("left")).cast("double") / F.col("ws") <= (max_epochs * F.col("source_size")).cast("double"))
    first = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("w")).alias("a"), "r", "left", "ws"))).over(whole)
    level = level.withColumn("f", first).withColumn("share", (F.col("w") * F.col("f.left")).cast("double") / F.col("f.ws"))
    capped = F.struct((F.col("source_size") / F.col("w")).alias("a"), "r") < F.struct("f.a", "f.r")
    target = F.when(capped, (max_epochs * F.col("source_size")).cast("double")).otherwise(F.col("share"))
    return level.select("source", "source_size", target.alias("target"))


def _cuts(sized: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """Adds per source: whole repetitions, and the bucket and key up to which one more is taken."""
    same = F.col("source").eqNullSafe(F.col("s_source"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = sized.groupBy(F.col("source").alias("s_source"), F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("s_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("size").over(run)).join(plan.select("source", "part"), same)
    at = sums.where("upto > part and part > 0").groupBy("source", "part").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("base"))).alias("c"))
    at = at.select(F.col("source").alias("s_source"), "part", "c.bucket", "c.base")
    near = sized.withColumn("bucket", F.substring("key", 1, digits)).join(at.withColumnRenamed("bucket", "c_bucket"), same & (F.col("bucket") == F.col("c_bucket")))
    run = Window.partitionBy("s_source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("mid", F.col("base") + F.sum("size").over(run) - F.col("size") / 2).where("mid <= part")
    keys = near.groupBy("s_source").agg(F.max("key").alias("last"))
    at = at.join(keys.withColumnRenamed("s_source", "k_source"), F.col("s_source").eqNullSafe(F.col("k_source")), "left")
    return plan.join(at.select("s_source", "bucket", "last"), same, "left").drop("s_source")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """(row, size, source_size, target, copies), ``row`` holding the columns of ``docs``."""
    sized = store(docs.select("source", order_key(seed), n_words().alias("size")), "sizes")
    plan = fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    digits = max(3, ceil(log(max(1, sized.count() / BUCKET_ROWS), 16)))
    plan = store(_cuts(sized, store(plan, "targets"), digits), "cuts")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "bucket", "last")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words().alias("size"), order_key(seed))
    out = out.join(plan, F.col("row.source").eqNullSafe(F.col("s")))
    head = F.substring("key", 1, digits)
    more = F.coalesce((head < F.col("bucket")) | ((head == F.col("bucket")) & F.coalesce(F.col("key") <= F.col("last"), F.lit(False))), F.lit(False))
    return out.select("row", "size", "source_size", "target", (F.col("whole") + more.cast("long")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with the columns size, source_size, target and copies (replacing any of those names).

    ``docs`` needs doc_id, source and text.  ``size`` is the number of words
    (null text: 0).  ``copies`` is how often the mix takes the row, 0 to
    ``max_epochs``.  A null source is a source of its own; rows with equal doc_id
    are taken alike; rows without words are taken as often as their place in the
    order says and add nothing; a source without words has target 0 and is not
    taken.  An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    return _mixed(docs, weights, max_epochs, seed).select("row.*", "size", "source_size", "target", "copies")


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of each row."""
    out = mix(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with its columns as they are, as often as the mix takes it."""
    out = _mixed(docs, weights, max_epochs, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source asc nulls last) - 1 as r
  from sized group by source),
weighed as (select *, ([5, 2, 1])[(r % 3 + 1)::int] as w from src),
lev as (
  select *, source_size / w as ratio,
         (sum(source_size) over ())::bigint
           - 3 * coalesce(sum(source_size) over (order by source_size / w, r rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
         (sum(w) over (order by source_size / w, r rows between current row and unbounded following))::bigint as ws
  from weighed),
cut as (
  select ratio, r, rest, ws from lev
  where (w * rest)::double / ws <= (3 * source_size)::double
  order by ratio, r limit 1),
tgt as (
  select lev.source, lev.source_size,
         case when lev.ratio < cut.ratio or (lev.ratio = cut.ratio and lev.r < cut.r)
              then (3 * lev.source_size)::double else (lev.w * cut.rest)::double / cut.ws end as target
  from lev cross join cut),
run as (
  select s.doc_id, s.size, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as whole,
         (sum(s.size) over (partition by s.source order by s.key rows between unbounded preceding and current row))::bigint as upto
  from sized s join tgt t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       size * (whole + case when target - whole * source_size > 0
                             and upto - size / 2.0::double <= target - whole * source_size then 1 else 0 end) as taken
from run
"""
