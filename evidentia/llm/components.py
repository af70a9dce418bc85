"""Connected components of a graph by alternating star contractions.

Large-star and small-star steps (Kiveris et al., 2014) run as aggregations and
joins, so neither links nor components reach the driver and a vertex with very
many links is pre-aggregated before each shuffle and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store

#: A key is hot with more rows than this share of all, and these at least.  So at most ``HOT_SHARE`` keys are hot in a large table.
HOT_SHARE, HOT_ROWS = 2048, 1000


def hot_limit(total: int) -> int:
    return max(HOT_ROWS, total // HOT_SHARE)


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, total: int, count: str = "c") -> DataFrame:
    """Joins ``rows`` (``total`` at most) with one row a key that holds the key's number of rows.

    Rows of hot keys stay where they are: the hot keys, of which there are no more
    than ``HOT_SHARE`` (or ``total / HOT_ROWS`` in a small table), are broadcast.  All
    others are shuffled, and no task gets more than the hot limit for one key.
    """
    hot = F.col(count) > hot_limit(total)
    names = [*rows.columns, *[c for c in per_key.columns if c != key]]
    few = rows.join(per_key.where(~hot).hint("shuffle_hash"), key).select(*names)
    if per_key.where(hot).isEmpty():
        return few
    many = per_key.where(hot)
    cold = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(per_key.where(~hot).hint("shuffle_hash"), key)
    return rows.join(F.broadcast(many), key).select(*names).unionByName(cold.select(*names))


def _hang(pairs: DataFrame, total: int, hot: bool) -> DataFrame:
    """Every (u, v) becomes (v, least of u and all its v); ``hot`` tells whether some u may have very many v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
    if hot:
        return join_counted(pairs, store(least, "least"), "u", total).select("u", "v", "m")
    return pairs.join(least.drop("c"), "u").select("u", "v", "m")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Returns (id, component) for each id that occurs in ``links`` (a, b).

    ``component`` is the smallest id reachable.  Links may repeat, point both
    ways or join an id to itself; an id with only a self link is its own
    component.  Null ends are ignored.  An empty table gives an empty result.
    """
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges = store(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        total, most, stars = _shape(edges)
        if stars:
            every = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v"))
            return every.groupBy("id").agg(F.min("component").alias("component"))
        hot = most > hot_limit(2 * total)
        both = _both(edges.where("u <> v"), ("u", "v"), ("v", "u"))
        # in the second step no vertex has more links than in the first
        large = _hang(both, 2 * total, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(edges.where("u = v"))
        large = store(large, "links") if hot else large
        edges = store(_both(_hang(large, 2 * total, hot), ("v", "m"), ("u", "m")).distinct(), "links")
    raise RuntimeError(f"no convergence after {max_rounds} rounds")


def _both(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Two pairs (u, v) from each row."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])).alias("e")).select("e.*")


def _shape(edges: DataFrame) -> tuple[int, int, bool]:
    """Links, the most links of a vertex, and whether each vertex but the centres, which are the least of their stars, has one link."""
    real = edges.where("u <> v")
    ends = real.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    each = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("c"))
    row = each.agg(F.sum("c"), F.max("c"), F.max("up"), F.max(((F.col("up") > 0) & (F.col("c") > F.col("up"))).cast("int"))).first()
    return (row[0] or 0) // 2, row[1] or 0, (row[2] or 0) <= 1 and not row[3]
