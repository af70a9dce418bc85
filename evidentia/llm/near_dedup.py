"""Near-duplicate groups by b-bit MinHash.

Every document becomes a set of hashed word shingles.  Minima of seeded
permutations give band keys for candidate generation; only the low bits of the
minima are kept, packed into a signature.  Inside a bucket, signatures are
compared by bit counts, corrected for chance collisions; what may be similar
joins a loose cluster.  Inside a cluster every pair of sets is intersected
exactly, so each reported link is confirmed on full sets and none is lost
inside a cluster.  Connected components of the links are the groups.

Scale: identical sets are merged before banding; buckets and clusters are cut
into blocks of bounded size.  A task compares the members of one block with each
other and with a few leaders that all blocks of a group get, and emits a spanning
forest of what it found.  In a group of copies this joins nearly all; only the
members that are left outside the group's main part are then compared with every
block, in blocks of their own.  A pair inside the main part is not compared, as it
can join nothing new.  So a hot group is neither gathered in one task nor expanded
into pairs, and no link that would join two parts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, join_counted
from .storage import store
from .wordhash import blocks, constants, hash_words, mix, windows


@dataclass(frozen=True)
class MinHash:
    """Parameters: five-word shingles and similarity at least 0.85 by default.

    With 32 bands of 5 rows a pair at the threshold shares no bucket with
    probability 7e-9; ``slack`` is how far below the threshold (over five
    standard errors of the b-bit estimate) a pair still joins a loose cluster.
    """

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 5
    bits: int = 2
    slack: float = 0.19
    seed: int = 17
    bucket_block: int = 512
    cluster_block: int = 400_000  # shingles
    leaders: int = 16

    @property
    def size(self) -> int:
        return self.bands * self.rows


#: Parameters where no other similarity is asked for: 0.8, missed with probability 5e-9.
USUAL = MinHash(percent=80, bands=48)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets."""
    w = hash_words(texts, lower=True)
    g, off = windows(w, words)
    count = w.count
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        c = constants(words, 3)
        add = np.array([(w.hash[w.off[i] : w.off[i + 1]] * c[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i]) for i in short], dtype=np.uint64)
        g = np.insert(g, off[short], mix(add))
        size = np.diff(off)
        size[short] = 1
        off = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(count)), np.diff(off))
    order = np.lexsort((g, doc))
    g = g[order]  # doc is already ascending
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(count)))]).astype(np.int64)


def signatures(sets: np.ndarray, off: np.ndarray, p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (n, bytes) and band keys (n, bands) of nonempty sets."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    mult = (constants(p.size, p.seed) >> np.uint64(13)).astype(np.uint32) | np.uint32(1)
    add = constants(p.size, p.seed + 1).astype(np.uint32)
    low = np.uint32((1 << p.bits) - 1)
    n = len(off) - 1
    bits = np.empty((n, p.size, p.bits), dtype=bool)
    keys = np.zeros((n, p.bands), dtype=np.uint64)
    fold = constants(p.rows, p.seed + 2)
    for j in range(p.size):
        least = np.minimum.reduceat(x * mult[j] + add[j], off[:-1])
        for b in range(p.bits):
            bits[:, j, b] = (least & low) >> np.uint32(b) & np.uint32(1)
        keys[:, j // p.rows] += least.astype(np.uint64) * fold[j % p.rows]
    keys = mix(keys + np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.packbits(bits.reshape(n, -1), axis=1), keys


def similarity(a: np.ndarray, b: np.ndarray, p: MinHash) -> np.ndarray:
    """Collision-corrected similarity of all rows of ``a`` against all of ``b``."""
    size = p.size * p.bits
    width = -(-size // 64) * 8

    def wide(s: np.ndarray) -> np.ndarray:
        return (s if s.shape[1] == width else np.pad(s, ((0, 0), (0, width - s.shape[1])))).view(np.uint64)

    x, y = wide(a), wide(b)
    even = np.uint64(0x5555555555555555)
    differ = np.zeros((len(x), len(y)), dtype=np.int32)
    for k in range(x.shape[1]):
        d = x[:, k, None] ^ y[None, :, k]
        if p.bits == 2:  # a position differs if either of its bits does
            d = (d | d >> np.uint64(1)) & even
        differ += np.bitwise_count(d)
    equal = 1 - differ / p.size
    chance = 0.5**p.bits
    return (equal - chance) / (1 - chance)


def describe(docs: DataFrame, p: MinHash) -> DataFrame:
    """(doc_id, n_shingles, cid, sig, bands) per document.

    ``cid`` names the set (a 64-bit digest of it); an empty set has null cid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                sets, off = shingle_sets(part.column(1), p.words)
                size = np.diff(off)
                some = np.flatnonzero(size)
                n = part.num_rows
                cid, sig, bands = [None] * n, [None] * n, [None] * n
                if len(some):
                    tight = np.concatenate([off[some], [off[-1]]])
                    packed, keys = signatures(sets, tight, p)
                    for i, c, a, b in zip(some.tolist(), digests(sets, tight).tolist(), packed, keys.view(np.int64), strict=True):
                        cid[i], sig[i], bands[i] = c, a.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "cid", "sig", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cid long, sig binary, bands array<long>")


def digests(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each nonempty set."""
    return mix(np.add.reduceat(mix(sets * constants(1, 99)[0]), off[:-1])).view(np.int64)


def _spanning(linked: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """(member, root) rows of the components of a boolean matrix over ids."""
    up = np.arange(len(ids))
    left = np.ones(len(ids), dtype=bool)  # breadth-first, a row of the matrix at a time
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & left)
            left[near] = False
            up[near] = i
            todo += near.tolist()
    got = np.flatnonzero(up != np.arange(len(up)))
    return ids[got].tolist(), ids[up[got]].tolist()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns, whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cut = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(cols[a].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _joined(members: DataFrame, sizes: DataFrame, payload: DataFrame, total: int, compare, p: MinHash) -> DataFrame:
    """Links (a, b) that join the members of each group as far as ``compare`` links them.

    ``members`` is (grp, id, w), ``total`` rows; ``sizes`` (grp, c, n) its rows and blocks; ``payload`` (id, data).
    ``compare`` gets whole runs of (grp, x, y, id, rank, data) and gives (grp, a, b) of a spanning forest, whose roots b
    are of the least rank.  All are written tables.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(join_counted(members, sizes, "grp", total).withColumn("blk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int")), "dealt")
    blocks_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.join(payload, "id").select("grp", "x", "y", "id", "rank", "data").repartition(parts, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
        return store(rows.mapInArrow(compare, "grp long, a long, b long"), "links")

    last = F.lit(p.leaders + 1)
    own = dealt.select("grp", F.col("blk").alias("x"), F.lit(0).alias("y"), "id", last.alias("rank"))
    hot = dealt.where("n > 1")
    if hot.isEmpty():
        return compared(own).select("a", "b")
    first = Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id")
    leaders = hot.groupBy("grp", "blk").agg(F.min("id").alias("id"), F.first("n").alias("n")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.leaders)
    # in its own block a leader stands twice, which makes no difference
    shown = leaders.withColumn("x", blocks_of("n")).select("grp", "x", F.lit(0).alias("y"), "id", "rank")
    found = compared(own.unionByName(shown))
    links = found.select("a", "b")
    # members that do not hang on the leader on whom most of their group do
    on = found.join(sizes.where("n > 1"), "grp", "left_semi").distinct()
    main = on.groupBy("grp", "b").agg(F.count("*").alias("k")).groupBy("grp").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    main = store(sizes.where("n > 1").join(main, "grp", "left"), "main")
    named = join_counted(hot.select("grp", "id", "w", "blk"), main, "grp", total).where("b is null or id <> b")
    rest = store(named.join(on.select("grp", F.col("a").alias("id"), "b"), ["grp", "id", "b"], "left_anti").select("grp", "id", "w", "blk", "n"), "rest")
    if rest.isEmpty():
        return links
    per_group = rest.groupBy("grp").agg(F.count("*").alias("m"), F.sum("w").alias("w"))
    per_group = store(per_group.join(sizes, "grp").select("grp", "c", F.ceil(F.greatest(F.col("m") / p.bucket_block, F.col("w") / p.cluster_block)).cast("int").alias("many")), "sizes")
    apart = join_counted(rest, per_group, "grp", total).withColumn("y", F.pmod(F.xxhash64("id", F.lit(7)), F.col("many")).cast("int"))
    there = join_counted(hot.select("grp", "id", "blk"), per_group, "grp", total).withColumn("y", blocks_of("many")).select("grp", F.col("blk").alias("x"), "y", "id", last.alias("rank"))
    both = there.unionByName(apart.withColumn("x", blocks_of("n")).select("grp", "x", "y", "id", last.alias("rank"))).distinct()
    return links.unionByName(compared(both).select("a", "b"))


def _forest(group: pa.Table, linked: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    a, b = _spanning(linked, ids)
    some = [k for k in range(len(a)) if a[k] != b[k]]
    return [group.column(0)[0].as_py()] * len(some), [a[k] for k in some], [b[k] for k in some]


def _ordered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids by rank, then id, and their rows."""
    ids, rank = group.column(3).to_numpy(), group.column(4).to_numpy()
    order = np.lexsort((ids, rank))
    return ids[order], order


_LINKS = pa.schema([("grp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _edges_of_buckets(p: MinHash):
    floor = p.percent / 100 - p.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], ...] = ([], [], [])
        for group in _grouped(batches, 3):
            if group.num_rows < 2:
                continue
            ids, order = _ordered(group)
            sig = np.frombuffer(b"".join(group.column(5).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
            for column, more in zip(out, _forest(group, similarity(sig, sig, p) >= floor, ids), strict=True):
                column += more
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_LINKS)
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_LINKS)

    return run


def _intersections(sets: list[np.ndarray], step: int = 1 << 16) -> np.ndarray:
    """Sizes of all pairwise intersections: bit rows over the shared shingles, a slice of columns at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~(new & np.concatenate([new[1:], [True]]))
    row, column = row[shared], np.cumsum(new[shared]) - 1
    both = np.zeros((n, n), dtype=np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        wide = -(-(int(column[hi - 1]) - a + 1) // 64) * 64
        m = np.zeros((n, wide), dtype=bool)
        m[row[lo:hi], column[lo:hi] - a] = True
        bits = np.packbits(m, axis=1).view(np.uint64)
        for i in range(n):
            both[i] += np.bitwise_count(bits[i] & bits).sum(axis=1, dtype=np.int64)
    return both


def _links_of_clusters(p: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            if group.num_rows < 2:
                continue
            ids, order = _ordered(group)
            raw = group.column(5).to_pylist()
            sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
            size = np.array([len(s) for s in sets])
            both = _intersections(sets)
            linked = 100 * both >= p.percent * (size[:, None] + size[None, :] - both)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _forest(group, linked, ids)], schema=_LINKS)

    return run


def _sets(texts: DataFrame, p: MinHash) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                sets, off = shingle_sets(part.column(0), p.words)
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    cid = digests(sets, np.concatenate([off[some], [off[-1]]]))
                    yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array([sets[off[i] : off[i + 1]].tobytes() for i in some], pa.binary())], names=["id", "data"])

    return texts.select("text").mapInArrow(run, "id long, data binary")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  Words are split
    at ASCII space and lower-cased in A-Z.  With fewer words than a shingle the
    whole sequence is one shingle; null, empty or blank texts have none and are
    linked with nothing.  Equal sets are always linked.  ``component_id`` is the
    smallest doc_id reachable and ``kept`` tells whether it is the row's own; a
    repeated doc_id gives a row each.  A null doc_id takes no part: its
    component_id is null and it is kept.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = store(describe(docs, p), "minhash")
    classes = known.where("cid is not null and doc_id is not null").groupBy(F.col("cid").alias("id"))
    classes = store(classes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    # candidate buckets: band keys that two classes or more share
    band = classes.select(F.explode("bands").alias("grp"), "id", F.lit(0).cast("long").alias("w"))
    sizes = band.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp", "c", F.ceil(F.col("c") / p.bucket_block).cast("int").alias("n"))
    loose = _joined(band, store(sizes, "buckets"), classes.select("id", F.col("sig").alias("data")), p.bands * classes.count(), _edges_of_buckets(p), p)
    clusters = store(connected_components(loose), "clusters")
    # exact links inside clusters
    wanted = clusters.join(classes.select("id", "doc_id", "n_shingles"), "id").select(F.col("component").alias("grp"), "id", "doc_id", F.col("n_shingles").alias("w"))
    wanted = store(wanted, "members")
    cut = wanted.groupBy("grp").agg(F.count("*").alias("c"), F.ceil(F.sum("w") / p.cluster_block).cast("int").alias("n")).where("c > 1")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = store(_sets(texts, p).groupBy("id").agg(F.first("data").alias("data")), "sets")
    links = _joined(wanted.select("grp", "id", "w"), store(cut, "cut"), sets, clusters.count(), _links_of_clusters(p), p)
    groups = connected_components(links)
    # back to documents
    found = classes.select("id", "doc_id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(first, "component").select(F.col("id").alias("cid"), "component_id")
    out = known.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of their group.

    Rows with a null doc_id stay; rows that share a doc_id stay or go together.
    Other columns may have any name.  An empty table gives an empty result.
    """
    gone = near_duplicates(docs, p).where("not kept").select(F.col("doc_id").alias("name")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    return rows.join(gone, "name", "left_anti").select("kept.*")


GROUPS_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
g as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(list_slice(w, i, i + 4), ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * n_both >= 85 * (x.n + y.n - n_both)),
e as (select a, b from l union all select b, a from l),
r as (select a as doc_id, a as c from e union select r.doc_id, e.b from r join e on e.a = r.c),
m as (select doc_id, min(c) as c from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, w.doc_id) as component_id, w.doc_id = coalesce(m.c, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join m on m.doc_id = w.doc_id
"""
