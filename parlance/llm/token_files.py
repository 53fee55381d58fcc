"""Token ids in files of fixed-width packed integers.

A file holds one run of documents:

    "PTOK1\\0"  bits u8  spare u8  ids per block u32      12 bytes, little-endian as all numbers
    blocks                                               64-bit words; id j of a block takes bits [j * bits, (j + 1) * bits)
    block offsets u64 * (blocks + 1)                     from the start of the file
    document ids i64 * documents
    null marks u8 * documents                            1 where the document id is null
    first ids u64 * (documents + 1)                      index of each document's first id in this file
    ids u64  blocks u64  documents u64  "PTOKEND\\0"       the last 32 bytes

bits is the least width that holds the largest id of the vocabulary. Any id is found from its index
by one block offset; a block is unpacked with 64 array operations whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import pretokens
from parlance.llm.common import mapped, new_path, number_rows, ready, written

MAGIC, END = b"PTOK1\0", b"PTOKEND\0"
HEAD, TAIL = struct.Struct("<6sBBI"), struct.Struct("<QQQ8s")
#: Ids in a block: a multiple of 64, so that each block is whole 64-bit words.
BLOCK = 1 << 16
#: Ids, and documents, after which a new file is begun (at the next document).
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 22
#: Characters by which texts of one doc_id are ordered first.
ORDER_CHARS = 32
#: Words held ready with their ids in a worker; when full, the store starts anew.
STORE = 600_000
#: Longer words are not held.
STORED_CHARS = 48

_WORDS = re.compile(rf"[{pretokens.LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{pretokens.LETTERS}]+")


def width(largest: int) -> int:
    """Bits that hold 0 to largest."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, filled up with zeros to a multiple of 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    if bits == 16:
        return padded.astype("<u2").tobytes()
    rows = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of pack()'s result, as uint32."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        rows[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            rows[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    rows &= np.uint64((1 << bits) - 1)
    return rows.reshape(-1)[:n].astype(np.uint32)


class Writer:
    """Writes one file; holds one block of ids and 17 bytes a document."""

    def __init__(self, path: str, bits: int) -> None:
        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where.rpartition("/")[0], recursive=True)
        self._out, self._bits = system.open_output_stream(where), bits
        self._out.write(HEAD.pack(MAGIC, bits, 0, BLOCK))
        self._held: list[np.ndarray] = []
        self._held_n = 0
        self.n_ids, self._at, self._offsets = 0, HEAD.size, [HEAD.size]
        self._docs, self._first = array("q"), array("Q", [0])
        self._null = bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(doc_id or 0)
        self._null.append(doc_id is None)
        self.n_ids += len(ids)
        self._first.append(self.n_ids)
        self._held.append(ids)
        self._held_n += len(ids)
        if self._held_n >= BLOCK:
            whole = np.concatenate(self._held)
            cut = len(whole) // BLOCK * BLOCK
            for k in range(0, cut, BLOCK):
                self._block(whole[k : k + BLOCK])
            self._held, self._held_n = [whole[cut:].copy()], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self._bits)
        self._out.write(data)
        self._at += len(data)
        self._offsets.append(self._at)

    @property
    def n_docs(self) -> int:
        return len(self._docs)

    def close(self) -> int:
        """Ends the file; the number of its documents."""
        if self._held_n:
            self._block(np.concatenate(self._held))
        for values, kind in ((self._offsets, "<u8"), (self._docs, "<i8"), (self._null, "u1"), (self._first, "<u8")):
            self._out.write(np.array(values, kind).tobytes() if kind != "u1" else bytes(values))
        self._out.write(TAIL.pack(self.n_ids, len(self._offsets) - 1, len(self._docs), END))
        self._out.close()
        return len(self._docs)


class Reader:
    """Random access to one file; reads the tables at its end, then only the blocks asked for."""

    def __init__(self, path: str) -> None:
        system, where = fs.FileSystem.from_uri(path)
        self._in = system.open_input_file(where)
        size = self._in.size()
        magic, self.bits, _, self.block = HEAD.unpack(self._in.read_at(HEAD.size, 0))
        self.n_ids, blocks, docs, end = TAIL.unpack(self._in.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or end != END:
            raise ValueError(f"not a whole token file: {path}")
        tables = self._in.read_at(8 * (blocks + 1) + 17 * docs + 8, size - TAIL.size - 8 * (blocks + 1) - 17 * docs - 8)
        at = 8 * (blocks + 1)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1)
        self.doc_ids = np.frombuffer(tables, "<i8", docs, at)
        self.null = np.frombuffer(tables, "u1", docs, at + 8 * docs)
        self.first = np.frombuffer(tables, "<u8", docs + 1, at + 9 * docs)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, of however many documents."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        data = self._in.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out, at = [], 0
        for k in range(a, b + 1):
            size = int(self.offsets[k + 1] - self.offsets[k])
            out.append(unpack(data[at : at + size], min(self.block, self.n_ids - k * self.block), self.bits))
            at += size
        return np.concatenate(out)[start - a * self.block : end - a * self.block]

    def documents(self, ids_at_once: int = 1 << 22) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, index of its first id, its ids) in order, a few blocks at a time."""
        k = 0
        while k < len(self.doc_ids):
            low = int(self.first[k])
            stop = max(k + 1, int(np.searchsorted(self.first, low + ids_at_once, "right")) - 1)
            held = self.ids(low, int(self.first[stop]))
            for j in range(k, stop):
                a, b = int(self.first[j]), int(self.first[j + 1])
                yield None if self.null[j] else int(self.doc_ids[j]), a, held[a - low : b - low]
            k = stop

    def close(self) -> None:
        self._in.close()


class WordTokenizer:
    """The tokenizers library, asked once for each word of texts in common characters.

    The split removes what is between words and merges stay inside a word, whose last token carries
    the mark of a word's end. So new words go to the library together, one space between them, and the
    marks show which ids are whose. Any text with other characters goes to the library whole.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(spec)
        doc = json.loads(spec)
        mark = doc["model"]["end_of_word_suffix"]
        if not mark:
            raise ValueError("the vocabulary has no mark of a word's end")
        self._added = [t["content"] for t in doc["added_tokens"]]
        self.largest = max([*doc["model"]["vocab"].values(), *(t["id"] for t in doc["added_tokens"])])
        self._ends = np.zeros(self.largest + 1, bool)
        self._ends[[i for t, i in doc["model"]["vocab"].items() if t.endswith(mark)]] = True
        self._store: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        words: list[list[str] | None] = []
        for text in texts:
            common = not pretokens.UNCOMMON.search(text) and not any(x in text for x in self._added)
            words.append(_WORDS.findall(text.lower()) if common else None)
        if len(self._store) > STORE:
            self._store.clear()
        store = self._store
        new = [w for w in set().union(*(w for w in words if w)) if w not in store]
        if new:
            ids = self._ids(" ".join(new))
            ends = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if len(ends) != len(new):  # a word was cut in two: the library has the texts whole
                return [self._ids(text) for text in texts]
            held, at = ids.tobytes(), 0
            for word, end in zip(new, ends.tolist(), strict=True):
                store[word] = held[at:end]
                at = end
        out = [self._ids(text) if own is None else np.frombuffer(b"".join(map(store.__getitem__, own)), np.uint32) for text, own in zip(texts, words, strict=True)]
        for word in new:
            if len(word) > STORED_CHARS:
                del store[word]
        return out


def tokenizer_of(spec: str) -> WordTokenizer:
    return ready("token_files", hashlib.sha256(spec.encode()).hexdigest(), lambda: WordTokenizer(spec))


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the ids of each text, then end_id, in ascending order of doc_id; returns the list of files.

    vocabulary: path of a tokenizers JSON file. folder: one that all executors share (a new one in
    spark.checkpoint.dir if not given). A null text counts as empty and gives the end id alone; a null
    doc_id goes first; rows of one doc_id go in order of their texts' first ORDER_CHARS characters, then of a
    hash, so that they are spread over tasks however many they are; an empty table gives no files.
    The list has shard, part, path, n_docs, n_ids and start, the number of ids in all files before.
    A task that runs again writes under another name; only files in the list count.
    """
    spark = docs.sparkSession
    folder = (folder or new_path(spark, "tokens")).rstrip("/")
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    file_ids, file_docs = FILE_IDS, FILE_DOCS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        bits = width(max(tokenizer.largest, end_id))
        shard, listed, out, path = TaskContext.get().partitionId(), [], None, ""
        last = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                if out is None:
                    path = f"{folder}/tokens-{shard:06d}-{len(listed):04d}-{uuid.uuid4().hex}.bin"
                    out = Writer(path, bits)
                out.add(doc_id, np.concatenate([ids, last]))
                if out.n_ids >= file_ids or out.n_docs >= file_docs:
                    listed.append((shard, len(listed), path, out.close(), out.n_ids))
                    out = None
        if out is not None:
            listed.append((shard, len(listed), path, out.close(), out.n_ids))
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*listed, strict=True)], ["shard", "part", "path", "n_docs", "n_ids"])

    held, uid = number_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    order = ["doc_id", "head", "hash", "uid"]
    held = held.select("doc_id", "text", F.substring("text", 1, ORDER_CHARS).alias("head"), F.xxhash64("text").alias("hash"), F.col(uid).alias("uid"))
    ordered = held.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = written(mapped(ordered, rows, "shard long, part long, path string, n_docs long, n_ids long", ("token_files",)), "token-files")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the listed files.

    Each file is read by one task, some blocks at a time. ids_crc32: of the ids as little-endian
    unsigned 32-bit integers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, out = Reader(path), []
                for doc_id, first, ids in reader.documents():
                    out.append((doc_id, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 50_000:
                        yield _table(out)
                        out = []
                reader.close()
                if out:
                    yield _table(out)

    n = min(files.count(), 10_000)
    listed = files.select("path", "start").repartitionByRange(max(1, n), "start")
    return mapped(listed, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
