"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation and lower-cased; numbers, names and units
become typed placeholders.  Windows of template words are matched by hash against
those of the benchmark, and a match counts only if its slots are consistent:
within one alignment a slot value of the benchmark always stands against the same
value of the document and the other way round.  So a question whose numbers or
names were exchanged is caught, while prose that merely shares a common frame is
not.

Scale: windows of the documents and of the benchmark meet in a hash join.  A
Bloom filter of fixed size (``filter_bits``) over the benchmark's windows goes to
the tasks, so of the documents, which are read once, only those that may share a
window go on, with the hashes that passed; neither the benchmark nor anything that
grows with the corpus is gathered.  What the join names is compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import store
from .wordhash import Words, blocks, hash_spans, hash_words, mix, windows

# Unit words (lower case).
UNITS = """km m cm mm mi mile miles metre metres meter meters kilometre kilometres kilometer kilometers foot feet inch inches
kg mg gram grams kilogram kilograms lb lbs pound pounds ounce ounces litre litres liter liters ml
second seconds minute minutes hour hours day days week weeks month months year years
usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph""".split()

NUMBER, UNIT, NAME = (np.uint64(k) for k in (0x4E554D0000000001, 0x554E490000000002, 0x4E414D0000000003))


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_DIGIT = _table(b"0123456789")
_NUMERIC = _table(b"0123456789.,:/%+-")
_UPPER = _table(bytes(range(65, 91)))
_STOP = _table(b".!?:")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Template:
    """``words`` a window, ``literal`` of them no placeholders; ``cover`` matched words make a leak.

    Beside a matched window a run of ``flank`` words counts as well, if no more than ``flank`` words
    of the document or the item lie between.
    """

    words: int = 8
    literal: int = 5
    cover: int = 13
    flank: int = 4
    filter_bits: int = 1 << 23  # of the filter of benchmark windows


def canonical(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Template words of texts (as Words), the hash of each word's surface and whether it is a slot.

    Words of punctuation only are left out.
    """
    w = hash_words(texts, hashes=False)
    data, start, end = w.data, w.start.copy(), w.end.copy()
    raw_end = w.end
    while len(start):
        go = (start < end) & _PUNCT[data[np.minimum(start, len(data) - 1)]]
        if not go.any():
            break
        start[go] += 1
    while len(start):
        go = (start < end) & _PUNCT[data[end - 1]]
        if not go.any():
            break
        end[go] -= 1
    keep = start < end
    doc = np.repeat(np.arange(len(w.off) - 1), w.count)[keep]
    start, end, raw_end = start[keep], end[keep], raw_end[keep]
    off = np.searchsorted(doc, np.arange(len(w.off))).astype(np.int64)
    surface = hash_spans(_LOWER[data], start, end)

    def inside(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
        return total[end] - total[start]

    size = end - start
    number = (inside(_NUMERIC) == size) & (inside(_DIGIT) > 0)
    unit = np.isin(surface, _unit_hashes())
    opens = np.ones(len(start), dtype=bool)  # the first word of a text or sentence
    if len(start):
        opens[1:] = (doc[1:] != doc[:-1]) | _STOP[data[raw_end[:-1] - 1]]
        name = (inside(_UPPER) == 1) & _UPPER[data[start]] & (size > 1) & ~opens
    else:
        name = np.zeros(0, dtype=bool)
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, surface)))
    return Words(data, w.text_off, start, end, template, off), surface, number | unit | name


def _unit_hashes() -> np.ndarray:
    return np.sort(hash_words(pa.array(UNITS)).hash)


@dataclass
class Index:
    """Windows of some benchmark items, sorted by hash."""

    size: np.ndarray  # template words of each item
    off: np.ndarray
    template: np.ndarray
    surface: np.ndarray
    hash: np.ndarray  # of windows, ascending
    item: np.ndarray  # row of items
    pos: np.ndarray
    whole: list[int]  # rows of items whose windows cannot make a leak


#: An item that must match as a whole is looked up by so many of its first words, or all if it has fewer.
HEAD = 8


def _window_hashes(w: Words, slot: np.ndarray, p: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text row and word position of all windows with enough literal words."""
    h, off = windows(w, p.words, seed=11)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pos = np.arange(len(h)) - off[row]
    total = np.concatenate([[0], np.cumsum(~slot)])
    at = w.off[row] + pos
    good = total[at + p.words] - total[at] >= p.literal if len(at) else np.zeros(0, dtype=bool)
    return h[good], row[good], pos[good]


def _heads(w: Words, surface: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` surface words, and their offsets a text."""
    h, off = windows(Words(w.data, w.text_off, w.start, w.end, surface, w.off), k, seed=12)
    return mix(h + np.uint64(k)), off


def build_index(texts: list[str | None], p: Template) -> Index:
    w, surface, slot = canonical(pa.array(texts, pa.string()))
    h, row, pos = _window_hashes(w, slot, p)
    order = np.argsort(h, kind="stable")
    places: dict[int, set[int]] = defaultdict(set)
    for i, s in zip(row.tolist(), pos.tolist(), strict=True):
        places[i].update(range(s, s + p.words))
    whole = [i for i, n in enumerate(w.count.tolist()) if n and len(places[i]) < min(p.cover, n)]
    return Index(w.count, w.off, w.hash, surface, h[order], row[order], pos[order], whole)


def _keys_of_items(p: Template):
    """(h, k, item): the hashes by which each item is found; ``k`` is 0 for template windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                index = build_index(part.column(1).to_pylist(), p)
                h, k, item = [index.hash], [np.zeros(len(index.hash), np.int32)], [index.item]
                w, surface, _ = canonical(part.column(1))
                for n in {min(int(index.size[i]), HEAD) for i in index.whole}:
                    heads, off = _heads(w, surface, n)
                    rows = np.array([i for i in index.whole if min(int(index.size[i]), HEAD) == n])
                    h.append(heads[off[rows]])
                    k.append(np.full(len(rows), n, np.int32))
                    item.append(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(k)), part.column(0).take(pa.array(np.concatenate(item)))], names=["h", "k", "item"])

    return run


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each hash in a filter."""
    return [(h >> np.uint64(s)) % np.uint64(bits) for s in (0, 20, 40)]


def _may(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for b in _bits(h, 64 * len(filter_)):
        out &= (filter_[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _filter(keys: DataFrame, p: Template) -> np.ndarray:
    """The Bloom filter of the hashes; the driver gets at most ``filter_bits`` / 64 words of it."""
    unsigned = F.shiftrightunsigned
    places = F.array(*[F.pmod(unsigned("h", s), F.lit(p.filter_bits)) if s else F.pmod(F.col("h"), F.lit(p.filter_bits)) for s in (0, 20, 40)])
    at = keys.select(F.explode(places).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("m")).collect()
    out = np.zeros(p.filter_bits // 64, dtype=np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    return out


def _consistent(index: Index, item: int, surface: np.ndarray, slot: np.ndarray, shift: int, starts: list[int], p: Template) -> set[int]:
    """Item positions covered by the windows of one alignment.

    All windows count if the slots of the whole alignment map one to one; else
    only those whose words are the item's own.
    """
    base = int(index.off[item])
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    sound = True
    places = sorted({k for s in starts for k in range(s, s + p.words)})
    for k in places:
        if slot[k + shift]:
            a, b = int(index.surface[base + k]), int(surface[k + shift])
            sound &= there.setdefault(a, b) == b and back.setdefault(b, a) == a
    if sound:
        return set(places)
    same = lambda s: (index.surface[base + s : base + s + p.words] == surface[s + shift : s + shift + p.words]).all()
    return {k for s in starts if same(s) for k in range(s, s + p.words)}


@dataclass
class _Chain:
    """Alignments that follow each other: the shift of each covered item position, and what each slot value stands for."""

    shift: dict[int, int]
    there: dict[int, int]
    back: dict[int, int]

    def ends(self) -> tuple[int, int]:
        """The last covered position of the item and of the document."""
        k = max(self.shift)
        return k, k + self.shift[k]

    def with_(self, index: Index, item: int, surface: np.ndarray, slot: np.ndarray, places: list[int], shift: int) -> _Chain | None:
        """The chain and these places, or None where a slot value would stand for two."""
        base = int(index.off[item])
        there, back = dict(self.there), dict(self.back)
        for k in places:
            if slot[k + shift]:
                a, b = int(index.surface[base + k]), int(surface[k + shift])
                if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    return None
        return _Chain(self.shift | dict.fromkeys(places, shift), there, back)


def _flanked(index: Index, item: int, template: np.ndarray, surface: np.ndarray, slot: np.ndarray, chain: _Chain, p: Template) -> _Chain:
    """The chain with the short runs before, between and after its places."""
    n, base = int(index.size[item]), int(index.off[item])

    def run(k: int, d: int, step: int, k_end: int, d_end: int) -> list[int]:
        """Item positions from ``k`` on whose words are those of the document from ``d`` on."""
        out = []
        while k != k_end and d != d_end and index.template[base + k] == template[d]:
            out.append(k)
            k, d = k + step, d + step
        return out

    def grow(chain: _Chain, k: int, d: int, step: int, k_end: int, d_end: int) -> _Chain:
        while True:
            found = []
            for over in range(p.flank + 1):
                for lost in range(p.flank + 1):
                    i, j = k + step * (1 + lost), d + step * (1 + over)
                    if (k_end - i) * step <= 0 or (d_end - j) * step <= 0:
                        continue
                    got = run(i, j, step, k_end, d_end)
                    solid = sum(not slot[x + j - i] for x in got)
                    if len(got) >= p.flank and solid * p.words >= p.literal * len(got) or (got and over == lost == 0):
                        found.append((len(got), -over - lost, got, j - i))
            for _, _, got, shift in sorted(found, reverse=True):
                more = chain.with_(index, item, surface, slot, got, shift)
                if more is not None:
                    chain, k, d = more, got[-1], got[-1] + shift
                    break
            else:
                return chain

    places = sorted(chain.shift)
    first = places[0]
    out = grow(chain, first, first + chain.shift[first], -1, -1, -1)
    for k, after in zip(places, [*places[1:], n], strict=True):
        if after != k + 1 or after == n:
            out = grow(out, k, k + chain.shift[k], 1, after, after + chain.shift[after] if after < n else len(template))
    return out


def _joined(index: Index, item: int, template: np.ndarray, surface: np.ndarray, slot: np.ndarray, lines: dict[int, list[int]], p: Template) -> dict[int, int]:
    """{item position: shift} of the alignments of an item that cover most of it when joined.

    An alignment may follow another one if it lies behind it in both the item and
    the document, with no more words between than the item has.
    """
    size = int(index.size[item])
    best: dict[int, int] = {}
    runs: list[tuple[int, int, list[int]]] = []  # first word in the document, shift, places
    for shift, starts in lines.items():
        starts = sorted(starts)
        alone = _consistent(index, item, surface, slot, shift, starts, p)
        if len(alone) > len(best):
            best = dict.fromkeys(alone, shift)
        cut = [0, *(i for i in range(1, len(starts)) if starts[i] > starts[i - 1] + p.words), len(starts)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            places = sorted({k for s in starts[a:b] for k in range(s, s + p.words)})
            runs.append((places[0] + shift, shift, places))
    if len(best) == size:
        return best
    runs.sort()
    empty = _Chain({}, {}, {})
    chains: list[_Chain | None] = []
    for j, (d, shift, places) in enumerate(runs):
        top = empty.with_(index, item, surface, slot, places, shift)
        parts = [places]
        if top is None:  # a slot at an end may be half of what was inserted
            a, b = int(slot[places[0] + shift]), int(slot[places[-1] + shift])
            parts = [places[x : len(places) - y] for x, y in ((a, 0), (0, b), (a, b)) if x + y]
            same = _consistent(index, item, surface, slot, shift, [s for s in lines[shift] if places[0] <= s <= places[-1]], p)
            parts += [sorted(same)] if same else []
            alone = [c for c in (empty.with_(index, item, surface, slot, x, shift) for x in parts) if c is not None]
            top = max(alone, key=lambda c: len(c.shift), default=None)
        for i in range(j - 1, -1, -1):
            if d - runs[i][0] > 2 * size:
                break
            if chains[i] is None:
                continue
            last, end = chains[i].ends()
            for part in parts:
                rest = [k for k in part if k > last and k + shift > end]
                if rest and rest[0] + shift - end - 1 <= size and (top is None or len(chains[i].shift) + len(rest) > len(top.shift)):
                    top = chains[i].with_(index, item, surface, slot, rest, shift) or top
        chains.append(top)
    for chain in sorted((c for c in chains if c is not None), key=lambda c: -len(c.shift)):
        whole = _flanked(index, item, template, surface, slot, chain, p)
        if len(whole.shift) > len(best):
            best = whole.shift
        if len(best) >= size:
            break
    return best


def _compare(text: pa.Array, index: Index, p: Template) -> dict[int, tuple[int, int]]:
    """{item: (covered words, same words)} of one text and the items that it may hold."""
    w, surface, slot = canonical(text)
    n = int(w.off[1])
    h, _, pos = _window_hashes(w, slot, p)
    first, last = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
    many = last - first
    j = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    item, start = index.item[j], index.pos[j]
    shift = np.repeat(pos, many) - start
    order = np.lexsort((start, shift, item))
    item, start, shift = item[order], start[order], shift[order]
    best: dict[int, tuple[int, int]] = {}
    for a, b in _runs(item):
        i = int(item[a])
        lines = {int(shift[a + x]): start[a + x : a + y].tolist() for x, y in _runs(shift[a:b])}
        covered = _joined(index, i, w.hash, surface, slot, lines, p)
        if len(covered) >= min(p.cover, int(index.size[i])):
            base = int(index.off[i])
            best[i] = (len(covered), sum(int(index.surface[base + k]) == int(surface[k + s]) for k, s in covered.items()))
    for i in index.whole:
        own = index.surface[index.off[i] : index.off[i + 1]]
        if any((surface[at : at + len(own)] == own).all() for at in np.flatnonzero(surface[: max(n - len(own) + 1, 0)] == own[0])):
            best[i] = (len(own), len(own))
    return best


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cut[:-1], cut[1:], strict=True)) if len(x) else []


def _suspects(filter_: np.ndarray, heads: list[int], p: Template):
    """Of (doc_id, text) the rows with a hash that may be one of the benchmark's, and these hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                w, surface, slot = canonical(part.column(1))
                h, row, _ = _window_hashes(w, slot, p)
                found = [(h, row)]
                for k in heads:
                    g, off = _heads(w, surface, k)
                    found.append((g, np.repeat(np.arange(part.num_rows), np.diff(off))))
                h, row = (np.concatenate(c) for c in zip(*found, strict=True))
                may = _may(filter_, h)
                h, row = h[may].view(np.int64), row[may]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                some, at = np.unique(row, return_index=True)
                if len(some):
                    rows = part.take(pa.array(some))
                    hits = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(h))
                    yield pa.RecordBatch.from_arrays([*rows.columns, hits], names=["doc_id", "text", "hits"])

    return run


def _compared(p: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Index] = {}
        for batch in batches:
            out = []
            for k, (doc_id, row, items) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                items.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["text"]))
                key = tuple(x["text"] for x in items)
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = build_index(list(key), p)
                for i, (n, same) in sorted(_compare(batch.column(1).slice(k, 1), known[key], p).items()):
                    out += [(doc_id, items[i]["item_id"], n, same, row)] * items[i]["copies"]
            if out:
                columns = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["doc_id", "item_id", "n_matched", "n_same", "row"])

    return run


def _row() -> Column:
    """Names a row by its id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"))


def _found(docs: DataFrame, benchmark: DataFrame, p: Template) -> DataFrame:
    """The rows of ``leaks`` with the name of each row."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies")).withColumn("item", F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.lit(":"), "text").cast("binary")))
    items = store(items, "items")
    keys = store(items.select("item", "text").mapInArrow(_keys_of_items(p), "h long, k int, item string").distinct(), "keys")
    heads = sorted(r["k"] for r in keys.where("k > 0").select("k").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    suspects = store(rows.mapInArrow(_suspects(_filter(keys, p), heads, p), "doc_id long, text string, hits array<long>").withColumn("row", _row()), "suspects")
    pairs = suspects.select("row", F.explode("hits").alias("h")).distinct().join(keys.select("h", "item").distinct(), "h").select("row", "item").distinct()
    named = pairs.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "text", "copies")).alias("items"))
    return suspects.join(named, "row").select("doc_id", "text", "row", "items").mapInArrow(_compared(p), "doc_id long, item_id long, n_matched long, n_same long, row string")


def leaks(docs: DataFrame, benchmark: DataFrame, p: Template = Template()) -> DataFrame:
    """One row (doc_id, item_id, n_matched, n_same) for each row of ``docs`` and item that it holds.

    ``n_matched`` is the number of template words of the item covered on the best
    joined alignments (``cover`` at least, or the whole item), ``n_same`` how many
    of them are the same words.  An item whose windows cover less than that, as one
    with fewer than ``words`` template words or with many placeholders, matches
    where all its words stand in a row.  Null and empty items match nothing, as do
    null and empty texts.  Repeated items and
    rows are reported each; null ids are reported as null.  Other columns are
    ignored.  Without documents or items there are no rows.
    """
    return _found(docs, benchmark, p).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Template = Template()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item.

    Rows are judged by id and text, so ids may be null or repeat, and other
    columns may have any name.  The rows to drop are a written table of names, so
    the join broadcasts them only if their size allows it.
    """
    gone = store(_found(docs, benchmark, p).select(F.col("row").alias("name")).distinct(), "leaks")
    rows = docs.select(_row().alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    return rows.join(gone, "name", "left_anti").select("kept.*")
