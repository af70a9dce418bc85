"""Token ids as length-delimited binary records with an offset index.

A record is framed as ``uint64 length, uint32 masked crc32 of the length, data,
uint32 masked crc32 of the data`` (little-endian); a mask is the checksum rotated
right by 15 bits plus 0xA282EAD8, so that checksums of data that hold checksums
stay apart.  The data are a header (doc_id, the number of ids, the bytes of an id,
whether the doc_id is null) and the ids, as uint16 where all fit, else uint32.  Beside each file lies an index of fixed rows (doc_id, byte offset,
number of ids), with which records can be read in any order.

Files are written under a name of the attempt and then renamed, and what a task
reports is stored before it is read, so a lost executor or a second attempt
leaves whole files only.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import folder, store
from .wordhash import blocks

# The frame of a record and the mask of its checksums.
HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
BODY = struct.Struct("<qQBB")  # doc_id, ids, bytes of an id, whether doc_id is null
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u8")])
MASK_DELTA = 0xA282EAD8
#: Texts that one file holds, about.
FILE_BYTES = 64 << 20
#: Words that a worker remembers, at most as many again from the table before.
REMEMBERED = 600_000
#: New words that the library encodes at a time.
TOGETHER = 20_000
#: Stands in the table for a word that cannot be encoded by itself; no ids have its length.
ODD = b"?"
#: A space as byte-level vocabularies write it.
SPACE = "\u0120"
#: Text that is encoded at a time; a longer text is one block.
BLOCK_BYTES = 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + FOOT.pack(masked(size)) + data + FOOT.pack(masked(data))


def unframe(read) -> Iterator[tuple[int, bytes]]:
    """Offset and data of each record of a binary file object; a broken frame raises."""
    at = 0
    while head := read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError(f"truncated frame at {at}")
        size, check = HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError(f"damaged length at {at}")
        data = read(size)
        foot = read(FOOT.size)
        if len(data) < size or len(foot) < FOOT.size or FOOT.unpack(foot)[0] != masked(data):
            raise ValueError(f"damaged record at {at}")
        yield at, data
        at += HEAD.size + size + FOOT.size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return frame(BODY.pack(doc_id or 0, len(ids), 2 if narrow else 4, doc_id is None) + ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids as little-endian uint32."""
    doc_id, n, width, null = BODY.unpack_from(data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", count=n, offset=BODY.size).astype("<u4")


@dataclass
class Encoder:
    """A byte-level tokenizer of the ``tokenizers`` library, loaded from a file.

    Such a tokenizer splits a text into pre-tokens and merges inside each.  A
    single space between two characters that are no white space always starts a
    pre-token, so texts are split at spaces in one Arrow call, each distinct word
    of a block is looked up once, and another Arrow call puts their ids in turn.
    New words go to the library many at a time.  A text goes to the library whole if
    white space touches a space in it, if it holds the content of an added token, or
    if the file describes another kind of tokenizer.
    """

    path: str

    def __post_init__(self):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.byte_level = _is_byte_level(json.loads(self.tokenizer.to_str()))
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(self.tokenizer.get_vocab_size() + 1)])
        solid = r"[^\s\x1c-\x1f\x85\u180e\u200b\ufeff]"  # no white space by anyone's definition
        self.solid = re.compile(f"{solid}(?:.*{solid})?", re.DOTALL).fullmatch
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a space that are not in the table, which gets them; ``ODD`` where white space touches the spaces around one.

        The library encodes new words as one text; each word's first token is the only one that opens with a space.
        """
        found = list(map(self.older.get, words))
        new = [k for k, f in enumerate(found) if f is None]
        for k in new:
            if not self.solid(words[k]):
                found[k] = ODD
        new = [k for k in new if found[k] is None]
        for a in range(0, len(new), TOGETHER):
            part = new[a : a + TOGETHER]
            text = " " + " ".join([words[k] for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part):
                raw, ends = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
                for k, x, y in zip(part, ends[:-1], ends[1:], strict=True):
                    found[k] = raw[x:y]
            else:  # a vocabulary with spaces inside tokens
                for k in part:
                    found[k] = self.whole(" " + words[k])
        self.known.update(zip(words, found, strict=True))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the offsets of each text; a null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = np.zeros(len(texts), dtype=bool) if self.byte_level else np.ones(len(texts), dtype=bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:  # words that are used again move over
            self.older, self.known = self.known, {}
        rows = pc.split_pattern(texts, " ")
        coded = rows.flatten().dictionary_encode()
        off = rows.offsets.to_numpy()
        first = off[:-1] - off[0]  # what stands before the first space has none before it
        code = coded.indices.to_numpy().copy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        for k, i in zip(new, self.learn([words[k] for k in new]), strict=True):
            ids[k] = i
        n = len(ids)
        texts = texts.to_pylist()
        heads = [t.split(" ", 1)[0] for t in texts]
        whole |= [h != "" and not self.solid(h[-1]) for h in heads]
        table = pa.array(ids, pa.large_binary())
        odd = np.diff(np.frombuffer(table.buffers()[1], np.int64)[: n + 1]) == len(ODD)
        code[first] = n  # an empty entry
        whole |= np.add.reduceat(np.append(odd, False)[code], first) > 0
        code[np.repeat(whole, np.diff(off))] = n
        code[first] = np.arange(n + 1, n + 1 + len(texts))
        rest = [b"", *[self.whole(text if w else head) for text, head, w in zip(texts, heads, whole.tolist(), strict=True)]]
        joined = pa.concat_arrays([table, pa.array(rest, pa.large_binary())]).take(pa.array(code))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(code) + 1] // 4
        return np.frombuffer(joined.buffers()[2], np.uint32)[: ends[-1]], ends[np.append(first, len(code))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder, which remembers words from one task to the next."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _is_byte_level(tokenizer: dict) -> bool:
    """Whether a tokenizer file describes what the shortcuts of ``Encoder`` rest on."""
    before, model = tokenizer["pre_tokenizer"] or {}, tokenizer["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(tokenizer["normalizer"] is None and split and model["type"] == "BPE" and plain)


def _write(path: str, encoder_path: str, end: int):
    tail = np.uint32(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        encode = encoder(encoder_path).encode
        fs, root = FileSystem.from_uri(path)
        shard = TaskContext.get().partitionId()
        out, name, rows, n_ids, at, files = None, "", [], 0, 0, []

        def finish() -> None:
            out.close()
            fs.move(f"{root}/{name}", f"{root}/{name}.rec")
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(rows, dtype=INDEX).tobytes())
            files.append((shard, len(files), f"{name}.rec", len(rows), n_ids))

        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                flat, off = encode(part.column(1))
                for doc_id, a, b in zip(part.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    if out is None:
                        name, rows, n_ids, at = f"part-{shard:06d}-{len(files):04d}-{uuid.uuid4().hex[:12]}", [], 0, 0
                        out = fs.open_output_stream(f"{root}/{name}")
                    ids = np.append(flat[a:b], tail)
                    data = pack(doc_id, ids)
                    rows.append((doc_id or 0, at, len(ids)))
                    out.write(data)
                    at += len(data)
                    n_ids += len(ids)
                    if at >= FILE_BYTES:
                        finish()
                        out = None
        if out is not None:
            finish()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*files, strict=True)], names=["shard", "part", "file", "docs", "ids"])

    return run


def write_records(docs: DataFrame, path: str, encoder_path: str, end: int = 2) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order; returns the manifest.

    The manifest has a row (shard, part, file, docs, ids) for each file; shard and
    part give the order of the files.  ``path`` is a URI of a folder that all
    machines share.  A null text is empty; each sequence ends in ``end``.  Null
    doc_ids come first and rows that share a doc_id follow each other.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return store(rows.mapInArrow(_write(path, encoder_path, end), "shard long, part long, file string, docs long, ids long"), "manifest")


def read_records(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records, read from the files.

    ``start`` counts the ids of all records before; the only global step is a
    running sum over the manifest's rows, one a file.  Each file is held against
    its index, and a difference raises.
    """
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "base").repartition(parts, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                index = read_index(fs, f"{root}/{name}")
                with fs.open_input_stream(f"{root}/{name}") as f:
                    for k, (at, data) in enumerate(unframe(f.read)):
                        doc_id, ids = unpack(data)
                        if k >= len(index) or (doc_id or 0, at, len(ids)) != index[k].item():
                            raise ValueError(f"record {k} of {name} is not where the index says")
                        rows.append((doc_id, base, len(ids), ids.tobytes()))
                        base += len(ids)
                        size += ids.nbytes
                        if size > 8 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                if k + 1 != len(index):
                    raise ValueError(f"{len(index)} records in the index of {name}, {k + 1} in the file")
                if rows:
                    yield _records(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def read_index(fs, path: str) -> np.ndarray:
    """The index rows of a file of records."""
    with fs.open_input_stream(f"{path.removesuffix('.rec')}.idx") as f:
        return np.frombuffer(f.read(), dtype=INDEX)


def read_at(path: str, name: str, rows: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file in any order, by way of its index."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(path)
    index = read_index(fs, f"{root}/{name}")
    out = []
    with fs.open_input_file(f"{root}/{name}") as f:
        for k in rows:
            f.seek(int(index["offset"][k]))
            out.append(unpack(next(unframe(f.read))[1]))
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """A URI for pyarrow of a path that may name no file system; it then lies in the cluster's default one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def record_table(docs: DataFrame, encoder_path: str, end: int = 2) -> DataFrame:
    """Writes the records to the scratch folder, reads them back and sums them up for each document."""
    path = qualified(docs.sparkSession, folder(docs.sparkSession, "records"))
    manifest = write_records(docs, path, encoder_path, end)
    return read_records(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
