"""Secrets in texts: fixed patterns, and random strings told from identifiers by Markov models.

Two first-order character models, one of random strings and one of ordinary
identifiers, are compared by their log-likelihood ratio: a run of key characters,
or a part of one between separators, is reported if the ratio a character exceeds
a threshold that falls with the length of the run.

The models are trained from labelled samples.  A bounded sample of the documents
(``max_docs``, by a hash) gives both labels: what the fixed patterns find is
random, plain words in one case are ordinary.  As identifiers join words, and as
a corpus may hold few secrets, seeded rules add joined words and numbers to the
one and strings drawn from the alphabets of keys to the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]?[a-z]{2,23}|[A-Z]{3,24})(?![A-Za-z0-9+/_=-])")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Words of identifiers where a corpus has none.
WORDS = ["account", "buffer", "client", "data", "error", "file", "group", "handler", "index", "key", "list", "manager", "name", "object", "path", "query", "result", "server", "table", "user", "value", "window"]


@dataclass(frozen=True)
class Scan:
    """Bounds of the training sample, and the thresholds.

    A run of ``n`` characters is reported if its mean log-likelihood ratio is above
    ``threshold + slack / n``.
    """

    max_docs: int = 4_000
    max_strings: int = 4_000  # of each label
    threshold: float = 0.6
    slack: float = 8.0
    seed: int = 13


def corpus_strings(docs: DataFrame, p: Scan = Scan()) -> tuple[list[str], list[str]]:
    """(plain words, values of the fixed patterns) of about ``max_docs`` documents, ``max_strings`` of each at most.

    Documents, and of too many strings those that are kept, are chosen by a hash, so the same table gives the same lists.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("k")).where("text is not null")
    share = min(1.0, p.max_docs / max(1, docs.count()))
    rows = rows.where(F.pmod("k", F.lit(1 << 30)) <= int(share * (1 << 30))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        found: tuple[set, set] = (set(), set())
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[0].update(PLAIN.findall(text))
                found[1].update(text[a:b].rsplit("=", 1)[-1] if k else _value(text[a:b]) for a, k, b in base_spans(text))
            for strings in found:
                if len(strings) > 8 * p.max_strings:
                    kept = sorted(strings, key=lambda s: (crc32(s.encode()), s))[: p.max_strings]
                    strings.clear()
                    strings.update(kept)
        for label, strings in enumerate(found):
            kept = sorted(strings, key=lambda s: (crc32(s.encode()), s))[: p.max_strings]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(kept), pa.int32()), pa.array(kept, pa.string())], names=["label", "string"])

    # every task gives max_strings of each label at most
    strings = rows.mapInArrow(run, "label int, string string").distinct()
    order = Window.partitionBy("label").orderBy(F.crc32(F.col("string").cast("binary")), "string")
    kept = strings.withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.max_strings).orderBy("label", "r").collect()
    return [r["string"] for r in kept if not r["label"]], [r["string"] for r in kept if r["label"]]


def _value(assignment: str) -> str:
    return ASSIGN.match(assignment)[2]


def labelled_samples(words: list[str], secrets: list[str], p: Scan = Scan()) -> list[tuple[str, int]]:
    """Strings with label 1 (random) or 0 (ordinary): those given, and seeded ones made of words, digits and key alphabets."""
    rng = np.random.default_rng(p.seed)
    out = [(s, 1) for s in secrets] + [(w, 0) for w in words if len(w) >= 4]
    words = [w.lower() for w in words] + WORDS
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", ALPHABET[26:62]]
    for i in range(p.max_strings):
        chars = alphabets[i % len(alphabets)]
        out.append(("".join(chars[k] for k in rng.integers(0, len(chars), int(rng.integers(16, 56)))), 1))
        parts = [words[k] for k in rng.integers(0, len(words), int(rng.integers(2, 6)))]
        style = i % 7  # the last one: dates and numbers
        if style == 0:
            word = parts[0] + "".join(x.title() for x in parts[1:])
        elif style == 6:
            word = ("", "-", "/", "_")[int(rng.integers(0, 4))].join(f"{k:02d}" for k in rng.integers(0, 100, int(rng.integers(2, 12))))
        else:
            word = ("_", "-", "/", "", "_")[style - 1].join(parts)
            word = word.upper() if style == 5 else word
        out.append((word + str(int(rng.integers(0, 10_000))) if rng.random() < 0.3 else word, 0))
    return out


@dataclass(frozen=True)
class Markov:
    """``ratio[a, b]``: log-likelihood ratio of character b after a; code 67 stands for the start and others."""

    ratio: np.ndarray

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio of a string, positive for random ones."""
        codes = _codes(text)
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
    return np.concatenate([[len(ALPHABET)], _CODE[raw & 127]])


def train(samples: list[tuple[str, int]], smoothing: float = 0.5) -> Markov:
    """Two first-order models with additive smoothing, as one table of ratios."""
    n = len(ALPHABET) + 1
    counts = np.full((2, n, n), smoothing)
    for text, label in samples:
        c = _codes(text)
        np.add.at(counts[int(label)], (c[:-1], c[1:]), 1)
    log = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Markov((log[1] - log[0]).astype(np.float64))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _random(text: str, start: int, end: int, model: Markov, p: Scan) -> Iterator[tuple[int, int]]:
    """Spans inside a run of key characters that the models take for random: the run, or else its parts between separators."""
    run = text[start:end]
    own = run.strip("=-_/+")
    if len(own) < 16:
        return
    start += run.index(own)
    if model.score(own) > p.threshold + p.slack / len(own):
        yield start, start + len(own)
        return
    for m in PART.finditer(own):
        if len(m[0]) < len(own) and model.score(m[0]) > p.threshold + p.slack / len(m[0]):
            yield start + m.start(), start + m.end()


def all_spans(text: str, model: Markov, p: Scan) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans, and these with the random strings outside them."""
    base = base_spans(text)
    extra = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for a, _, b in base:  # what a fixed pattern covers is cut out
            if a < end and at < b:
                extra += [(s, 3, e) for s, e in _random(text, at, max(a, at), model, p)]
                at = max(at, b)
        if at < end:
            extra += [(s, 3, e) for s, e in _random(text, at, end, model, p)]
    return base, sorted(base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: Markov | None = None, p: Scan = Scan()) -> DataFrame:
    """Returns (doc_id, kinds, starts, ends, base, spans) for each row of ``docs``.

    Positions are code points, ends exclusive.  ``kinds``, ``starts`` and ``ends``
    are parallel arrays ordered by start; ``base`` and ``spans`` are the same
    written out, without and with the models' finds.  Without a model one is
    trained from ``docs``.  A null text is empty; null and repeated ids are ordinary
    rows; other columns are ignored; an empty table gives an empty result.
    """
    model = model or train(labelled_samples(*corpus_strings(docs, p), p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                b, s = all_spans(text or "", model, p)
                base.append(written(b))
                spans.append(s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[KINDS[k] for _, k, _ in s] for s in spans], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in s] for s in spans], pa.list_(pa.int32())),
                    pa.array([[b for _, _, b in s] for s in spans], pa.list_(pa.int32())),
                    pa.array(base, pa.string()),
                    pa.array([written(s) for s in spans], pa.string()),
                ],
                names=["doc_id", "kinds", "starts", "ends", "base", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, kinds array<string>, starts array<int>, ends array<int>, base string, spans string")


def secret_table(docs: DataFrame) -> DataFrame:
    """Counts of each fixed pattern, their digest and all spans of each document."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
