"""Shards of near-equal size by minimax contiguous partition.

Equal texts form one atomic group; groups are ordered by the digest of their
text.  A binary search finds the smallest shard capacity for which a greedy pass
over the ordered group sizes needs no more than the wanted number of shards, and
the sequence is cut there.

The driver never sees all groups.  It holds byte totals of at most 2**16 runs of
groups, those whose digests share their first digits; where a greedy cut falls
into a run, the totals of the runs inside it are fetched, level by level, and at
last the sizes of at most ``BLOCK_GROUPS`` groups.  A few hundred such levels are
kept.  A cut is a digest or the first digits of one, so rows are assigned by
comparing their own digest with at most ``shards - 1`` constants, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

#: Groups whose sizes are fetched together; a larger run is fetched as totals.
BLOCK_GROUPS = 20_000
#: Digits by which the whole sequence and a run inside it are divided, at most.
FIRST_DIGITS, MORE_DIGITS = 4, 3
#: Levels that the driver keeps.
KEPT = 256
#: Rows that one task numbers.
SLOT_ROWS = 50_000


def _text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def digest(text: str = "text") -> Column:
    """Names a group of equal texts; a null text counts as an empty one."""
    return F.md5(_text(text).cast("binary"))


def row_size(text: str = "text") -> Column:
    return (F.octet_length(_text(text)) + F.lit(1)).cast("long")


@dataclass(frozen=True)
class ShardPlan:
    """``cuts``: last digest of each shard but the final one; ``capacity``: bytes of the fullest."""

    shards: int
    capacity: int
    cuts: tuple[str, ...]

    def shard(self, key: Column) -> Column:
        """The shard of a digest."""
        out = F.lit(0)
        for cut in self.cuts:
            out = out + (key > F.lit(cut)).cast("int")
        return out.cast("int")


class _Totals:
    """Byte offsets of groups in digest order, fetched where they are asked for."""

    def __init__(self, groups: DataFrame, n_groups: int):
        self.groups = groups
        self.kept: dict[str, tuple[np.ndarray, list[str], list[int] | None]] = {}
        digits = next((d for d in range(FIRST_DIGITS) if n_groups <= BLOCK_GROUPS * 16**d), FIRST_DIGITS)
        self.root = self.runs("", digits) if digits else self.members("")

    def runs(self, prefix: str, digits: int) -> tuple[np.ndarray, list[str], list[int] | None]:
        rows = self.groups.where(F.col("digest").startswith(prefix)).groupBy(F.substring("digest", 1, len(prefix) + digits).alias("name")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: r["name"])
        return np.cumsum([r["size"] for r in rows]), [r["name"] for r in rows], [r["n"] for r in rows]

    def members(self, prefix: str) -> tuple[np.ndarray, list[str], list[int] | None]:
        rows = sorted((r["digest"], r["size"]) for r in self.groups.where(F.col("digest").startswith(prefix)).select("digest", "size").collect())
        return np.cumsum([s for _, s in rows]), [d for d, _ in rows], None

    def level(self, prefix: str, n: int) -> tuple[np.ndarray, list[str], list[int] | None]:
        if prefix not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[prefix] = self.members(prefix) if n <= BLOCK_GROUPS else self.runs(prefix, MORE_DIGITS)
        return self.kept[prefix]

    def cut(self, limit: int) -> tuple[int, str]:
        """The largest offset up to ``limit`` at which a group ends, and a digest (or its first digits) between that group and the next."""
        base, level = 0, self.root
        while True:
            ends, names, counts = level
            k = int(np.searchsorted(ends, limit - base, "right"))
            if k == len(names):
                raise ValueError("the limit lies behind the last group")
            before = base + (int(ends[k - 1]) if k else 0)
            if counts is None:
                return before, names[k - 1] if k else names[0][:-1]
            if before == limit:
                return before, names[k]  # all of this run come behind its first digits
            base, level = before, self.level(names[k], counts[k])


def plan_shards(sized: DataFrame, shards: int) -> ShardPlan:
    """Cuts rows (digest, size) into ``shards`` contiguous runs of groups with the least possible maximum.

    An empty table gives a plan without cuts.
    """
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = sized.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = store(groups.repartitionByRange(parts, "digest").sortWithinPartitions("digest"), "groups")
    n, total, top = groups.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        return ShardPlan(shards, 0, ())
    totals = _Totals(groups, n)

    def greedy(capacity: int) -> list[str] | None:
        """Cuts with this capacity, or None if it is too small."""
        at, cuts = 0, []
        for _ in range(shards):
            if at + capacity >= total:
                return cuts
            end, name = totals.cut(at + capacity)
            if end <= at:
                return None
            at = end
            cuts.append(name)
        return None

    low, high = max(top, -(-total // shards)), -(-total // shards) + top
    while low < high:
        mid = (low + high) // 2
        if greedy(mid) is None:
            low = mid + 1
        else:
            high = mid
    return ShardPlan(shards, low, tuple(greedy(low)[: shards - 1]))


def number_slots(rows: DataFrame, by: str = "shard", order: tuple[str, ...] = ("digest", "doc_id")) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... inside each shard.

    Rows are dealt to buckets by a hash of the order columns, numbered inside
    their bucket and moved by the counts of the buckets before, so no task
    numbers a whole shard.
    """
    k = rows.count() // SLOT_ROWS + 1
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(k)))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(by, "_b").count().select(by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)))
    return numbered.join(base, [by, "_b"]).withColumn("slot", (F.col("_base") + F.col("_n") - 1).cast("long")).drop("_b", "_n", "_base")


def shard_table(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Returns doc_id, size, text_crc32, law, shard, slot and grown_shard for each row.

    ``size`` is the UTF-8 length of the text plus one (null: one) and the law is
    ``bytes``.  Equal texts share a shard; a null text counts as an empty one.
    Null and repeated doc_ids are ordinary rows.  ``grown_shard`` is null, as
    cuts by bytes move when shards are added.  An empty table gives no rows.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_size().alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), digest().alias("digest"))
    sized = store(sized, "sized")
    plan = plan_shards(sized.select("digest", "size"), shards)
    out = number_slots(sized.withColumn("shard", plan.shard(F.col("digest"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with a column ``shard`` added (replacing one of that name).

    Equal texts share a shard; a null text counts as an empty one, a very long one
    is a group like any other.  Ids and other columns are not looked at, so they may
    be null, repeat or have any name; repeated rows share a shard.  An empty table
    gives an empty result.
    """
    sized = store(docs.select(row_size().alias("size"), digest().alias("digest")), "sized")
    plan = plan_shards(sized, shards)
    return docs.withColumn("shard", plan.shard(digest()))
