"""Removal of repeated passages by prefix-partitioned suffix trees.

A repeat is a window of ``window`` words that also starts earlier in the corpus.
Equal windows agree on the least-hashed run of ``prefix`` words inside them, so it
is enough to build the trees of the suffixes that start at such anchors (about
one word in eight): a window is then what lies ``d`` words to the left and
``window - d`` words to the right of an anchor.  Suffixes are split into groups
by their prefix.  A prefix that occurs once has no internal node below it and
drops out before its suffixes are made.

Inside a group the tree of the suffixes, and that of the reversed words before
the anchors, are grown from the root word by word; a node that holds one leaf is
not grown further.  A node of depth ``window - d`` of the one and a node of depth
``d`` of the other name a passage of ``window`` words, and of the suffixes below
both all but the first repeat it.  Runs of such windows are the maximal repeats.
Words are compared by 48 bits of their hashes, each word by itself.

Scale: documents are dealt to blocks by a hash of their id and text, and a block
counts each prefix once, so the counts of a prefix that stands in a third of all
documents are one row a block.  The texts are shuffled once; all steps read that
exchange.  Below a prefix above ``group_size`` suffixes a block first grows the
trees of its own: of a suffix whose windows all stand earlier in the block only
the place goes on, without words.  The others are dealt to subgroups by a hash of
the place; what is new in its subgroup is then compared under the prefix
grown to the whole window (by a 128-bit hash of its words), of which every
subgroup has one suffix at most.  So no
task holds more than a block of documents, ``group_size`` suffixes or one suffix
from each subgroup, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordhash import Words, blocks, constants, hash_words, mix, windows


@dataclass(frozen=True)
class Repeat:
    """``window`` words make a repeat; ``prefix`` words name a group of suffixes, of ``group_size`` at most.

    ``blocks`` is the number of blocks of documents in a shuffle partition.
    """

    window: int = 20
    prefix: int = 5
    group_size: int = 20_000
    blocks: int = 8


_NO_ID = -(1 << 63)
#: Bytes of a word's hash that are compared.
WIDTH = 6
_COMPARED = np.uint64((1 << 8 * WIDTH) - 1)
#: Suffixes whose trees are grown at a time, if no group has more.
TOGETHER = 100_000


@dataclass
class Anchors:
    """Anchors of texts and the run of windows that each one stands for."""

    doc: np.ndarray
    key: np.ndarray
    first: np.ndarray  # word position, in its document, of the first window
    left: np.ndarray  # words from there to the anchor
    count: np.ndarray  # windows of the run


def anchors(w: Words, p: Repeat) -> Anchors:
    """For each window the leftmost least-hashed prefix inside it; equal windows agree on it."""
    g, goff = windows(w, p.prefix, seed=21)
    span = p.window - p.prefix + 1
    room = np.maximum(w.count - p.window + 1, 0)
    off = np.concatenate([[0], np.cumsum(room)])
    n = int(off[-1])
    doc = np.repeat(np.arange(len(room)), room)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Anchors(none, none.astype(np.uint64), none, none, none)
    start = np.arange(n) - off[doc] + goff[doc]  # of each window, in g
    least = g[start].copy()
    where = np.zeros(n, dtype=np.int64)
    for j in range(1, span):
        value = g[start + j]
        less = value < least
        least[less] = value[less]
        where[less] = j
    anchor = start + where
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return Anchors(doc[at], least[at], start[at] - goff[doc[at]], where[at], np.diff(np.append(at, n)))


def _block(table: pa.Table) -> pa.RecordBatch:
    """The rows (id, text) of a block in their order: by id, then text, so that a place in it is always the same."""
    table = table.select(["id", "text"]).combine_chunks()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    tied = np.flatnonzero(np.diff(ids[order]) == 0)
    if len(tied):
        texts = table.column("text").take(pa.array(order)).to_pylist()
        order = order[sorted(range(len(order)), key=lambda k: (ids[order[k]], texts[k]))]
    table = table.take(pa.array(order)).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["id", "text"])


def _parts(block: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a block that are worked on at a time, with the place of their first row."""
    at = 0
    for part in blocks(block, "text"):
        yield at, part
        at += part.num_rows


def _prefixes(p: Repeat):
    """How often each prefix starts a suffix in a block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = [anchors(hash_words(part.column("text")), p).key for _, part in _parts(_block(table))]
        keys, runs = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return pa.table({"b": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "key": pa.array(keys.view(np.int64)), "runs": pa.array(runs.astype(np.int32))})

    return run


def _around(w: Words, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words from word ``begin`` on, one after another, and their offsets."""
    off = np.concatenate([[0], np.cumsum(size)])
    return off, w.hash[np.arange(off[-1]) + np.repeat(begin - off[:-1], size)]


def _known(w: Words, key: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, count: np.ndarray, split: np.ndarray, p: Repeat) -> np.ndarray:
    """Which suffixes of split prefixes have only windows that stand in an earlier row."""
    done = np.zeros(len(key), dtype=bool)
    hot = np.flatnonzero(split)
    if len(hot):
        off, words = _around(w, begin[hot], size[hot])
        again = repeated(np.unique(key[hot], return_inverse=True)[1], words & _COMPARED, off, left[hot], count[hot], p)
        done[hot] = np.logical_and.reduceat(again, np.cumsum(count[hot]) - count[hot])
    return done


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_SUFFIXES = "grp long, salt int, split boolean, id long, b int, k int, start int, left int, n int, words binary"


def _suffixes(p: Repeat):
    """Suffixes below the prefixes that repeat, with the words around them.

    A row stands for the ``n`` windows of an anchor, the first of which starts at word ``start`` and
    ``left`` words before the anchor.  Where each of them repeats one of the same part of the block, and the
    prefix is split, the row has no words and may go to any task.
    """

    def run(key: tuple, texts: pa.Table, keys: pa.Table) -> pa.Table:
        out = []
        named = keys.column("key").to_numpy().view(np.uint64)
        order = np.argsort(named)
        named, total = named[order], keys.column("n").to_numpy()[order]
        block = _block(texts)
        for at, part in _parts(block):
            w = hash_words(part.column("text"))
            a = anchors(w, p)
            place = np.minimum(np.searchsorted(named, a.key), max(len(named) - 1, 0))
            got = np.flatnonzero(named[place] == a.key) if len(named) else np.zeros(0, np.int64)
            if not len(got):
                continue
            doc, first, count = a.doc[got], a.first[got], a.count[got]
            n = total[place[got]]
            groups = -(-n // p.group_size)
            k = at + doc
            begin, size = w.off[doc] + first, count + p.window - 1
            done = _known(w, a.key[got], begin, size, a.left[got], count, groups > 1, p)
            size[done] = 0
            off, words = _around(w, begin, size)
            where = mix(k.astype(np.uint64) * np.uint64(1 << 20) + first.astype(np.uint64) + np.uint64(key[0].as_py() << 40))
            grp = np.where(done, where, a.key[got])
            salt = np.where(done, -1, (where % groups.astype(np.uint64)).astype(np.int64))
            words = np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
            binary = pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer((WIDTH * off).astype(np.int32)), pa.py_buffer(words)])
            columns = [grp.view(np.int64), salt.astype(np.int32), groups > 1, block.column("id").to_numpy()[k], np.full(len(got), key[0].as_py(), np.int32), k.astype(np.int32), first.astype(np.int32), a.left[got].astype(np.int32), count.astype(np.int32)]
            out.append(pa.Table.from_arrays([*map(pa.array, columns), binary], names=_names(_SUFFIXES)))
        return pa.concat_tables(out) if out else _NO_SUFFIXES

    return run


_NO_SUFFIXES = pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())], names=_names(_SUFFIXES))


def grown(root: np.ndarray, words: np.ndarray, first: np.ndarray, step: int, length: np.ndarray, depth: int) -> np.ndarray:
    """Nodes (n, depth + 1) of the tree of sequences below their roots, -1 where a sequence ended or is alone.

    Sequence ``i`` is made of the words ``first[i]``, ``first[i] + step`` ..., ``length[i]`` of them.  Sequences are
    below one node of a depth if they have one root and agree in as many words.
    """
    out = np.full((len(root), depth + 1), -1, dtype=np.int64)
    size = np.bincount(root)
    live = np.flatnonzero(size[root] > 1)
    node = root[live]
    out[live, 0] = node
    for d in range(1, depth + 1):
        more = length[live] >= d
        live, node = live[more], node[more]
        word = words[first[live] + step * (d - 1)]
        order = np.lexsort((word, node))
        live, node, word = live[order], node[order], word[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        node = np.cumsum(new) - 1
        several = np.bincount(node)[node] > 1 if len(node) else new
        live, node = live[several], node[several]
        out[live, d] = node
    return out


def repeated(group: np.ndarray, words: np.ndarray, off: np.ndarray, left: np.ndarray, count: np.ndarray, p: Repeat) -> np.ndarray:
    """Of all windows of suffixes, in turn, which repeat one of an earlier row of their group.

    ``words[off[i]:off[i + 1]]`` are the words around suffix ``i``, which starts at its ``left[i]``-th word.
    """
    ends = np.cumsum(count)
    again = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
    anchor = off[:-1] + left
    after = grown(group, words, anchor, 1, off[1:] - anchor, p.window)
    before = grown(group, words, anchor - 1, -1, left, p.window - p.prefix)
    for d in range(p.window - p.prefix + 1):
        x, y = after[:, p.window - d], before[:, d]
        rows = np.flatnonzero((x >= 0) & (y >= 0) & (left >= d) & (left - d < count))
        order = np.lexsort((y[rows], x[rows]))  # stable: earlier rows first
        r = rows[order]
        same = (x[r][1:] == x[r][:-1]) & (y[r][1:] == y[r][:-1])
        late = r[1:][same]
        again[ends[late] - count[late] + left[late] - d] = True
    return again


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with equal leading columns) of a sorted stream."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(rows, dtype=bool)
        for k in range(keys):
            c = table.column(k).to_numpy()
            last &= c == c[-1]
        cut = rows - int(last.sum())
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


_HITS = "b int, k int, start int, n int, bits binary"
_FOUND = "grp long, name long, id long, b int, k int, start int, n int, bits binary"


def _grow(p: Repeat):
    """Repeats of each group, as bits of the windows of a suffix; and of split groups the other windows, one row each without bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 2):
            table = table.combine_chunks()
            col = {n: table.column(n).chunk(0) for n in _names(_SUFFIXES)}
            key, salt, left, count = (col[n].to_numpy() for n in ("grp", "salt", "left", "n"))
            off = np.frombuffer(col["words"].buffers()[1], np.int32)[col["words"].offset : col["words"].offset + len(key) + 1].astype(np.int64)
            wide = np.zeros(((off[-1] - off[0]) // WIDTH, 8), dtype=np.uint8)
            wide[:, :WIDTH] = np.frombuffer(col["words"].buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, WIDTH)
            words = wide.view("<u8")[:, 0]
            off = (off - off[0]) // WIDTH
            done = off[1:] == off[:-1]  # known in their block
            new = done.copy()  # each by itself, so no tree has them
            new[:1] = True
            new[1:] |= (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            left, count = left.astype(np.int64), count.astype(np.int64)
            again = repeated(np.cumsum(new) - 1, words, off, left, count, p)
            ends = np.cumsum(count)
            row = np.repeat(np.arange(len(key)), count)
            again |= done[row]
            some = np.flatnonzero(np.bincount(row[again], minlength=len(key)))
            at = pa.array(some)
            bits = pa.array([np.packbits(again[ends[i] - count[i] : ends[i]]).tobytes() for i in some.tolist()], pa.binary())
            nowhere = pa.array(mix(some.astype(np.uint64) + np.uint64(1)).view(np.int64))  # these rows may go to any task
            yield pa.RecordBatch.from_arrays([nowhere, pa.nulls(len(some), pa.int64()), *(col[n].take(at) for n in ("id", "b", "k", "start", "n")), bits], names=_names(_FOUND))
            others = np.flatnonzero(~again & col["split"].to_numpy(zero_copy_only=False)[row])
            for a in range(0, len(others), TOGETHER):
                f = others[a : a + TOGETHER]
                r = row[f]
                shift = f - (ends[r] - count[r])
                own = words[(off[r] + shift)[:, None] + np.arange(p.window)]
                name = [pa.array(mix((own * c).sum(axis=1, dtype=np.uint64)).view(np.int64)) for c in (constants(p.window, 31), constants(p.window, 32))]
                at = pa.array(r)
                place = [col[n].take(at) for n in ("id", "b", "k")]
                start = pa.array((col["start"].to_numpy()[r] + shift).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*name, *place, start, pa.array(np.ones(len(r), np.int32)), pa.nulls(len(r), pa.binary())], names=_names(_FOUND))

    return run


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with bits; and of windows, sorted by (grp, name) and their place, all but the first of each passage."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bits = batch.column("bits")
        yield batch.filter(bits.is_valid()).select(_names(_HITS))
        rest = batch.filter(bits.is_null())
        if rest.num_rows == 0:
            continue
        names = np.stack([rest.column(c).to_numpy() for c in ("grp", "name")], axis=1)
        late = np.append([last is not None and (names[0] == last).all()], (names[1:] == names[:-1]).all(axis=1))
        last = names[-1]
        late = rest.filter(pa.array(late)).select(_names(_HITS)[:-1])
        yield pa.RecordBatch.from_arrays([*late.columns, pa.array([b"\x80"] * late.num_rows, pa.binary())], names=_names(_HITS))


def _cut(p: Repeat):
    """Removes what the repeated windows of a block's documents cover."""

    def run(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for k, start, n, bits in zip(*(hits.column(c).to_pylist() for c in ("k", "start", "n", "bits")), strict=True):
            found.setdefault(k, []).append((start, n, bits))
        block = _block(texts)
        counts, removed, kept, spans = [], [], [], []
        for k, text in enumerate(block.column("text").to_pylist()):
            words = text.encode().split()
            n = len(words)
            out: list[int] = []
            if k in found:
                edge = np.zeros(n + 1, dtype=np.int32)
                for start, many, bits in found[k]:
                    starts = start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=many))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + p.window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
            spans.append(out)
        ids = pc.if_else(pc.equal(block.column("id"), _NO_ID), None, block.column("id"))
        return pa.Table.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, p: Repeat = Repeat()) -> DataFrame:
    """Returns (doc_id, n_words, n_removed, kept, spans) for each row of ``docs``.

    ``kept`` joins the words that no repeated window covers by one space;
    ``spans`` lists start and end (exclusive) of each removed run of words in turn.
    A window is removed if the same words start earlier: under a smaller doc_id,
    or earlier in the same document.  All windows are judged on the input.  A null
    text has no words; a null doc_id stands before all others; rows that share a
    doc_id, and those without one, are ordered by a hash of their text, equal rows
    follow each other; other columns are ignored; an empty table gives an empty
    result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(parts * p.blocks)).cast("int")).repartition(parts, "b")
    counted = rows.groupBy("b").applyInArrow(_prefixes(p), "b int, key long, runs int").repartition(parts, "key")
    counted = counted.withColumn("n", F.sum("runs").over(Window.partitionBy("key"))).where("n > 1").select("b", "key", "n")
    suffixes = rows.groupBy("b").cogroup(counted.groupBy("b")).applyInArrow(_suffixes(p), _SUFFIXES)
    suffixes = suffixes.repartition(parts, "grp", "salt").sortWithinPartitions("grp", "salt", "id", "b", "k", "start")
    found = suffixes.mapInArrow(_grow(p), _FOUND).repartition(parts, "grp").sortWithinPartitions("grp", "name", "id", "b", "k", "start")
    hits = found.mapInArrow(_late, _HITS)
    return rows.groupBy("b").cogroup(hits.groupBy("b")).applyInArrow(_cut(p), "doc_id long, n_words long, n_removed long, kept string, spans array<int>")


def repeat_table(docs: DataFrame, p: Repeat = Repeat()) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return remove_repeats(docs, p).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPEATS_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20),
k as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) as h from s),
r as (select doc_id, i from k qualify row_number() over (partition by h order by doc_id, i) > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as j from r),
g as (select doc_id, list(j) as gone from c group by doc_id),
m as (select w.doc_id, w.w, coalesce(g.gone, []) as gone from w left join g on w.doc_id = g.doc_id),
x as (select doc_id, w, gone, unnest(range(1, len(w) + 1)) as j from m where len(gone) > 0),
y as (select x.doc_id, string_agg(w[x.j], ' ' order by x.j) as kept from x left join c on c.doc_id = x.doc_id and c.j = x.j where c.j is null group by x.doc_id)
select m.doc_id, len(m.w)::bigint as n_words, len(m.gone)::bigint as n_removed,
       sha256(case when len(m.gone) = 0 then array_to_string(m.w, ' ') else coalesce(y.kept, '') end) as kept_sha256
from m left join y on m.doc_id = y.doc_id
"""
