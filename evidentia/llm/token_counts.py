"""Token counts of unigram vocabularies without building tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
position; dynamic programming carries the best score and the number of pieces
of the path that has it.  Ties follow the tokenizer library: at an end position
a path replaces another only if it scores strictly more, and paths are tried
from the longest last piece to the shortest.  A character that no one-character
piece covers may also be taken as unknown, at ten below the least score, and
counts as its UTF-8 bytes if the vocabulary falls back to bytes, otherwise as one
unknown token for a whole run.

A text is cut before each run of spaces (written as U+2581), as pieces never cross
from a word into the next space, so a word is scored once and remembered in a
bounded table.  With a vocabulary whose pieces do cross, whole texts are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers; the table is emptied when it is full.
REMEMBERED = 300_000


@dataclass
class Unigram:
    """Pieces with their scores; ``fallback``: unknown characters become bytes."""

    pieces: dict[str, float]
    fallback: bool = True
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            a = ahocorasick.Automaton()
            for piece, score in self.pieces.items():
                a.add_word(piece, (len(piece), score))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __post_init__(self):
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.pieces)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}  # each worker builds its own


def load_pieces(path: str) -> Unigram:
    """Pieces and scores of a SentencePiece model file; control and byte pieces are no text pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    pieces = {model.id_to_piece(i): float(model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return Unigram(pieces, any(model.is_byte(i) for i in ids))


def best_path(word: str, u: Unigram) -> tuple[int, float]:
    """Number of tokens and score of the best segmentation of a word."""
    n = len(word)
    if n == 0:
        return 0, 0.0
    unknown = u.unknown
    score = [0.0] * (n + 1)
    count = [0] * (n + 1)
    open_run = [False] * (n + 1)  # the path ends in an unknown character
    done = 0

    def close(end: int) -> None:
        """Offers the unknown character before ``end`` if no one-character piece is there."""
        c = word[end - 1]
        if c in u.pieces:
            return
        s = score[end - 1] + unknown
        if count[end] == 0 or s > score[end]:
            score[end] = s
            count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if u.fallback else 0 if open_run[end - 1] else 1)
            open_run[end] = True

    for last, (size, value) in u.automaton().iter(word):
        while done < last:  # ends before this one are complete
            done += 1
            close(done)
        end = last + 1
        start = end - size
        s = score[start] + value
        if count[end] == 0 or s > score[end]:
            score[end], count[end], open_run[end] = s, count[start] + 1, False
    while done < n:
        done += 1
        close(done)
    return count[n], score[n]


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


def segments(text: str, crossing: bool = False) -> list[str]:
    """The text with a leading space and spaces as marks, cut before each run of marks unless pieces cross there."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    if marked[0] != MARK:
        marked = MARK + marked
    return [marked] if crossing else _SEGMENT.findall(marked)


def count_tokens(docs: DataFrame, vocabulary: Unigram) -> DataFrame:
    """Returns (doc_id, n_tokens, score) for each row.

    Whole texts are counted; null and empty ones have 0 tokens and score 0.
    Null and repeated ids are ordinary rows; other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        class Table(dict):
            def __missing__(self, word: str) -> tuple[int, float]:
                if len(self) >= REMEMBERED:
                    self.clear()
                got = best_path(word, vocabulary)
                self[word] = got
                return got

        known = Table()
        for batch in batches:
            counts, scores = [], []
            for text in batch.column(1).to_pylist():
                got = [known[s] for s in segments(text or "", vocabulary.crossing)]
                counts.append(sum(c for c, _ in got))
                scores.append(float(np.sum([s for _, s in got])) if got else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
