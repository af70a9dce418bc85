"""A factorisation machine for document quality.

Features are hashed words and structure statistics (and, if asked for, numeric
metadata columns).  Pairwise interactions have rank ``rank`` and are scored in
time linear in the features by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.

The model is fitted on the driver from a bounded number of labelled rows
(``max_train``); scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import blocks, hash_spans, hash_words, text_buffer


#: Numeric columns of the documents table that the model may see; lang, source and doc_id are never inputs.
METADATA = ("n_chars",)


@dataclass(frozen=True)
class Machine:
    """Parameters of the model and its training."""

    buckets: int = 1 << 15
    rank: int = 8
    max_train: int = 6000
    epochs: int = 10
    updates: int = 900  # at least, for few rows
    rate: float = 0.1
    decay: float = 2e-5
    batch: int = 64
    seed: int = 5
    threshold: float = 0.3


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=np.int32)
    t[list(chars)] = 1
    return t


_CLASSES = [
    _table(bytes(range(65, 91))),  # capitals
    _table(b"0123456789"),
    _table(b"#*$%&|<>"),
    _table(b"!?"),
    _table(b".,;:'\"()-"),
    _table(b"{}[]=_/\\^~`@+"),
    _table(b"\n"),
]
N_STATS = len(_CLASSES) + 7


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (n, N_STATS) of texts, their word hashes (lower case) and word offsets."""
    w = hash_words(texts, lower=True)
    raw, off = text_buffer(texts)
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    out = np.zeros((n, N_STATS), dtype=np.float32)
    for k, kind in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        out[:, k] = np.sqrt((total[off[1:]] - total[off[:-1]]) / size)
    k = len(_CLASSES)
    words = np.maximum(w.count, 1)
    out[:, k] = np.log1p(w.count) / 8
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    out[:, k + 1] = (length[w.off[1:]] - length[w.off[:-1]]) / words / 16
    doc = np.repeat(np.arange(n), w.count)
    order = np.lexsort((w.hash, doc))
    h = w.hash[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    out[:, k + 2] = np.bincount(doc[new], minlength=n) / words
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    out[:, k + 3] = np.bincount(doc[same], minlength=n) / words
    # lines
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    solid = raw != 10
    first, last = solid.copy(), solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    line_doc = np.searchsorted(off, start, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    lh = hash_spans(raw, start, end)
    order = np.lexsort((lh, line_doc))
    lh, ld = lh[order], line_doc[order]
    again = np.zeros(len(lh), dtype=bool)
    again[1:] = (lh[1:] == lh[:-1]) & (ld[1:] == ld[:-1])
    out[:, k + 4] = np.bincount(ld[again], minlength=n) / np.maximum(lines, 1)
    out[:, k + 5] = np.log1p(size / np.maximum(lines, 1)) / 10
    out[:, k + 6] = w.count == 0
    return out, w.hash, w.off


def features(texts: pa.Array, m: Machine, meta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (offsets, indices, values): unit-length word weights, then statistics and metadata."""
    stats, h, off = statistics(texts)
    if meta is not None:
        stats = np.concatenate([stats, meta], axis=1)
    n, extra = stats.shape
    doc = np.repeat(np.arange(n), np.diff(off))
    cell, count = np.unique(doc * m.buckets + (h & np.uint64(m.buckets - 1)).astype(np.int64), return_counts=True)
    doc, index = cell // m.buckets, cell % m.buckets
    value = 1 + np.log(count)
    value /= np.sqrt(np.bincount(doc, weights=value**2, minlength=n))[doc]
    row = np.concatenate([doc, np.repeat(np.arange(n), extra)])
    index = np.concatenate([index, np.tile(np.arange(m.buckets, m.buckets + extra), n)])
    value = np.concatenate([value, stats.ravel()]).astype(np.float32)
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), index[order].astype(np.int32), value[order]


@dataclass
class Fitted:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, off: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Log-odds of rows; every row has features (the statistics)."""
        if len(off) < 2:
            return np.zeros(0)
        linear = np.add.reduceat(self.weight[index] * value, off[:-1])
        vx = self.factor[index] * value[:, None]
        pair = np.add.reduceat(vx, off[:-1]) ** 2 - np.add.reduceat(vx**2, off[:-1])
        return self.bias + linear + 0.5 * pair.sum(axis=1)


def fit(off: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, m: Machine, width: int) -> Fitted:
    """Logistic loss by mini-batch AdaGrad; the same rows give the same model."""
    rng = np.random.default_rng(m.seed)
    f = Fitted(0.0, np.zeros(width, np.float32), rng.normal(0, 0.02, (width, m.rank)).astype(np.float32))
    if len(label) == 0:
        return f
    share = np.clip(label.mean(), 0.02, 0.98)
    f.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(width, 1e-3, np.float32), np.full((width, m.rank), 1e-3, np.float32)
    gb = 1e-3
    for _ in range(max(m.epochs, -(-m.updates * m.batch // len(label)))):
        order = rng.permutation(len(label))
        for a in range(0, len(order), m.batch):
            rows = order[a : a + m.batch]
            size = off[rows + 1] - off[rows]
            local = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(local[-1]) - np.repeat(local[:-1], size) + np.repeat(off[rows], size)
            i, x = index[at], value[at]
            vx = f.factor[i] * x[:, None]
            total = np.add.reduceat(vx, local[:-1])
            raw = f.bias + np.add.reduceat(f.weight[i] * x, local[:-1]) + 0.5 * (total**2 - np.add.reduceat(vx**2, local[:-1])).sum(axis=1)
            g = (1 / (1 + np.exp(-raw)) - label[rows]).astype(np.float32) / len(rows)
            gx = np.repeat(g, size) * x
            dv = gx[:, None] * (np.repeat(total, size, axis=0) - vx)
            u, inverse = np.unique(i, return_inverse=True)
            sw = np.bincount(inverse, weights=gx).astype(np.float32) + m.decay * f.weight[u]
            sv = np.stack([np.bincount(inverse, weights=dv[:, k]) for k in range(m.rank)], axis=1).astype(np.float32) + m.decay * f.factor[u]
            gw[u] += sw**2
            gv[u] += sv**2
            f.weight[u] -= m.rate * sw / np.sqrt(gw[u])
            f.factor[u] -= m.rate * sv / np.sqrt(gv[u])
            gb += float(g.sum()) ** 2
            f.bias -= m.rate * float(g.sum()) / gb**0.5
    return f


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, m: Machine = Machine(), meta: tuple[str, ...] = ()) -> Fitted:
    """Fits on at most ``max_train`` labelled rows outside fold 0, chosen by a hash of the id.

    ``labels`` has doc_id and quality; rows with a null in either are skipped, of
    an id with several labels the largest counts, an id without a document is
    ignored and of documents that share an id the one with the least text is used.  Without labelled rows
    the model scores 0.5.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    named = named.where("doc_id is not null and quality is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(m.max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(meta)])
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", *[f"m{k}" for k in range(len(meta))])).alias("r"))
    rows = rows.select("doc_id", "r.*", "quality").mapInArrow(_sparse(m, len(meta)), "doc_id long, quality double, indices binary, weights binary")
    data = sorted(rows.collect(), key=lambda r: r["doc_id"])  # max_train rows at most
    index = [np.frombuffer(r["indices"], np.int32) for r in data]
    value = [np.frombuffer(r["weights"], np.float32) for r in data]
    off = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64)
    flat = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (index, value))
    return fit(off, *flat, np.array([float(r["quality"] > 0) for r in data], dtype=np.float32), m, m.buckets + N_STATS + len(meta))


def _meta(part: pa.RecordBatch, first: int, n: int) -> np.ndarray | None:
    """Metadata columns on a log scale; a null is 0."""
    if not n:
        return None
    cols = [np.nan_to_num(part.column(first + k).cast(pa.float64()).to_numpy(zero_copy_only=False)) for k in range(n)]
    return np.stack([np.sign(c) * np.log1p(np.abs(c)) / 10 for c in cols], axis=1).astype(np.float32)


def _sparse(m: Machine, n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                off, index, value = features(part.column(1), m, _meta(part, 2, n_meta))
                cut = list(zip(off[:-1], off[1:], strict=True))
                quality = part.column(part.schema.get_field_index("quality"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), quality, pa.array([index[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())],
                    names=["doc_id", "quality", "indices", "weights"],
                )

    return run


def _scores(model: Fitted, part: pa.RecordBatch, text: int, m: Machine, first: int = 0, n_meta: int = 0) -> np.ndarray:
    raw = model.raw(*features(part.column(text), m, _meta(part, first, n_meta)))
    return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -500, 500)))


def score(docs: DataFrame, model: Fitted, m: Machine = Machine(), meta: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; labels, lang, source and doc_id are no inputs.

    ``meta`` names the numeric columns that the model was trained with; a null in
    one counts as 0.  Null and empty texts are scored by their statistics.  A null
    doc_id has null ``held_out``.  Rows are scored each by itself, so repeated rows
    and ids get equal scores; an empty table gives an empty result.
    """
    sent = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                s = _scores(sent, part, 1, m, 2, len(meta))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(meta)])
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= m.threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Fitted, m: Machine = Machine(), meta: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject.

    A row is judged by its text and ``meta`` columns alone, as ``score`` does it:
    nulls, empty and very long texts have a score as well, ids may be null or
    repeat, equal rows stay or go together, and other columns may have any name.  An
    empty table gives an empty result.
    """
    at = docs.columns.index("text")
    places = [docs.columns.index(c) for c in meta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                known = part.select([at, *places])
                yield part.filter(pa.array(_scores(model, known, 0, m, 1, len(meta)) >= m.threshold))

    return docs.mapInArrow(run, docs.schema)
