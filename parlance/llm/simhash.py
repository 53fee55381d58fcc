"""SimHash near duplicates: texts whose 64-bit fingerprints differ in few bits, found by pigeonring filtering.

A fingerprint is a ring of segments. If two differ in at most `most` bits, there is a segment from which on
every chain of l consecutive segments differs in at most l * most / segments bits in all: the first
segment is equal, the first two differ in one bit at most (by default), and so on.

1. Equal fingerprints are one node.
2. Each node is held under its chain of two segments from every start, and asks for all chains that
   differ from its own within the budgets: held and asked meet in one shuffle by 32 bits and the start.
3. Where they meet, longer chains are held against their budgets, shortest first; what is left
   gets the full Hamming check. A task connects what it finds before anything goes on.
4. Chains of two that very many nodes hold, and their neighbours, are replaced by chains of three: no more
   than 2^16 different fingerprints have one in common.
5. The links' connected components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import joined_to_one, kept, mapped, number_rows, scratch, without_rows, written
from parlance.llm.components import components, stars

#: Chains of two are too common when so many nodes hold them, and a SHARE-th of all nodes.
HELD, SHARE = 2000, 20_000
#: Nodes whose rows are made at a time, and pairs that are compared at a time.
NODES, PAIRS = 10_000, 2_000_000
#: Nodes whose rows a task makes.
TASK_NODES = 20_000
_U = np.uint64
_LONGER = 1 << 60


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half of the XXH64 (seed 42) of all runs of so many words; of all words, if they are fewer; 0 without words.

    Words are cut at ASCII white space, A-Z lower-cased.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    n = min(words, len(parts))
    count = len(parts) - n + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(parts[k:] for k in range(n)), strict=False)), repeat(42)), _U, count)
    times = np.zeros(64, np.int64)
    for k in range(0, count, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        times += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * times > count, bitorder="little").tobytes(), "little")


class Ring:
    """Chains of segments of 64-bit fingerprints that differ in so many bits at most."""

    def __init__(self, most: int) -> None:
        if not 0 <= most <= 7:
            raise ValueError("most must be from 0 to 7")
        self.most, self.segments = most, max(4, most + 1)
        borders = [64 * k // self.segments for k in range(self.segments + 1)]
        self._first = borders[:-1]
        self._bits = [list(range(a, b)) for a, b in zip(borders, borders[1:], strict=False)]

    def budget(self, length: int) -> int:
        """In how many bits a chain of that many segments may differ."""
        return length * self.most // self.segments

    def mask(self, start: int, length: int) -> int:
        return sum(1 << b for k in range(length) for b in self._bits[(start + k) % self.segments])

    def changes(self, segment: int, most: int) -> list[tuple[int, int]]:
        """(bits to change, how many) of all changes of up to so many bits of a segment."""
        bits = self._bits[segment % self.segments]
        return [(sum(1 << b for b in chosen), n) for n in range(most + 1) for chosen in combinations(bits, n)]

    def key(self, nodes: np.ndarray, start: int, length: int) -> np.ndarray:
        """The chain from start on, turned to the low bits, with its start: of two or three segments at most 48 bits."""
        chain, turn = nodes & _U(self.mask(start, length)), self._first[start]
        if turn:
            chain = chain >> _U(turn) | chain << _U(64 - turn)
        return chain.astype(np.int64) | start << 56 | (_LONGER if length == 3 else 0)

    def holds(self, different: np.ndarray, start: int) -> np.ndarray:
        """Positions of the differences that stay within all budgets from start on, the whole ring's included."""
        left = np.arange(len(different))
        for length in range(1, self.segments + 1):
            left = left[np.bitwise_count(different[left] & _U(self.mask(start, length))) <= self.budget(length)]
        return left


def _held_keys(ring: Ring):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(_U)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ring.key(nodes, s, 2) for s in range(ring.segments)]))], ["key"])

    return rows


def _neighbours(ring: Ring, keys: np.ndarray) -> np.ndarray:
    """Keys of chains of two that a chain with one of keys asks for, sorted."""
    out = []
    for start in range(ring.segments):
        own = keys[keys >> 56 == start]
        width = len(ring._bits[start])
        # In a key the chain's second segment comes after the bits of its first.
        shift = (ring._first[(start + 1) % ring.segments] - ring._first[start]) % 64
        assert shift == width
        for change, _ in ring.changes(start + 1, ring.budget(2)):
            turned = change >> ring._first[(start + 1) % ring.segments] << shift
            out.append(own ^ turned)
    return np.unique(np.concatenate(out)) if out else keys


def _sent(ring: Ring, common):
    """(key, asked, node): each node under its own chains, and under all those that it asks for; common chains of two as chains of three."""

    def one(keys: np.ndarray, asked: bool, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), asked)), pa.array(nodes.view(np.int64))], ["key", "asked", "node"])

    def of(nodes: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(ring.segments):
            for asked, changes in ((False, [(0, 0)]), (True, ring.changes(start + 1, ring.budget(2)))):
                plain_keys, plain_nodes = [], []
                for change, n in changes:
                    moved = nodes ^ _U(change)
                    keys = ring.key(moved, start, 2)
                    is_common = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
                    plain_keys.append(keys[~is_common])
                    plain_nodes.append(nodes[~is_common])
                    if is_common.any():
                        own, moved = nodes[is_common], moved[is_common]
                        more = ring.changes(start + 2, ring.budget(3) - n) if asked else [(0, 0)]
                        longer = np.concatenate([ring.key(moved ^ _U(c), start, 3) for c, _ in more])
                        yield one(longer, asked, np.tile(own, len(more)))
                yield one(np.concatenate(plain_keys), asked, np.concatenate(plain_nodes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = common.value
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(_U)
            for k in range(0, len(nodes), NODES):
                yield from of(nodes[k : k + NODES], hot)

    return rows


def _linked(ring: Ring, held: np.ndarray, first: np.ndarray, many: np.ndarray, asked: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of asked nodes with held ones do; of each asked one held[first : first + many] are compared."""
    some = np.flatnonzero(many)
    cuts = np.flatnonzero(np.diff(np.cumsum(many[some]) // PAIRS)) + 1
    for part in np.split(some, cuts):
        times = many[part]
        row = np.repeat(np.arange(len(part)), times)
        at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[part][row]
        x, y, s = asked[part][row], held[at], start[part][row]
        ok = np.flatnonzero(x != y)
        x, y, s, row = x[ok], y[ok], s[ok], row[ok]
        for one in np.unique(s):
            of = np.flatnonzero(s == one)
            left = of[ring.holds(x[of] ^ y[of], int(one))]
            if not len(left):
                continue
            # Each asked node with the first it links with, and that one with the others.
            heads = np.concatenate([[True], row[left][1:] != row[left][:-1]])
            lead = y[left][heads][np.cumsum(heads) - 1]
            yield x[left][heads], lead[heads]
            rest = np.unique(np.stack([lead[~heads], y[left][~heads]]), axis=1)
            if rest.size:
                yield rest[0], rest[1]


def _met(ring: Ring):
    """Edges (u, v) from rows sorted by key, with what is held before what is asked."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_held = -1, np.zeros(0, _U)  # of the last key of the batch before, which may go on
        for batch in batches:
            key, asked, node = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(_U)
            if not len(key):
                continue
            if key[0] == last_key and len(last_held):
                n = len(last_held)
                key, asked, node = np.concatenate([np.full(n, last_key), key]), np.concatenate([np.zeros(n, bool), asked]), np.concatenate([last_held, node])
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n_held = np.add.reduceat((~asked).astype(np.int64), heads)
            run = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(key)))
            rows = np.flatnonzero(asked & (n_held[run] > 0))
            for u, v in _linked(ring, node, heads[run[rows]], n_held[run[rows]], node[rows], (key[rows] >> 56) & 7):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u.view(np.int64), v.view(np.int64))), pa.array(np.minimum(u.view(np.int64), v.view(np.int64)))], ["u", "v"])
            last_key, last_held = key[-1], node[heads[-1] : heads[-1] + n_held[-1]]

    return lambda batches: stars(edges(batches))


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Edges (u, v) that connect the different numbers in nodes' only column, without nulls, as all pairs within so many bits do."""
    ring, spark = Ring(most), nodes.sparkSession
    nodes = nodes.toDF("node")
    held = mapped(nodes, _held_keys(ring), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    count = nodes.count()
    least = max(HELD, count // SHARE)
    # Each node holds one key for each segment: at most segments * SHARE of them are so common.
    keys = np.array([r.key for r in held.where(F.col("n") > least).select("key").collect()], np.int64)
    common = spark.sparkContext.broadcast(_neighbours(ring, keys))
    # A node makes some seventy rows: tasks get so many nodes, not so many bytes of them.
    nodes = nodes.repartition(-(-count // TASK_NODES) or 1, "node")
    met = mapped(nodes, _sent(ring, common), "key long, asked boolean, node long").repartition("key").sortWithinPartitions("key", "asked")
    return mapped(met, _met(ring), "u long, v long")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id", uid: str | None = None) -> DataFrame:
    """doc_id and fingerprint (long) of each row, and uid, if a column is named."""
    more = [uid] if uid else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fingerprint", *(["uid"] if uid else [])])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text, *more)
    return mapped(narrow, rows, "doc_id long, fingerprint long" + (", uid long" if uid else ""))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, text: str = "text", doc_id: str = "doc_id", uid: str | None = None) -> DataFrame:
    """doc_id, fingerprint (long), root and component_id of each row (and uid, if a column is named): components of fingerprints linked at most so many bits apart.

    component_id is the smallest doc_id of the component, null only if all there are; rows of one component have the same
    root, a fingerprint. A null or empty text, or one of white space, has the fingerprint 0, which links like any other.
    Repeated rows are rows of their own; an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        found = written(fingerprints(docs, words, text, doc_id, uid), "fingerprints")
        # A task sums up its rows of a fingerprint before any are sent.
        nodes = written(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "nodes")
        roots = components(links(nodes.select("fingerprint"), most), "u", "v")
        rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", "rows", F.coalesce("root", "fingerprint").alias("root"))
        rooted = written(rooted, "rooted")
        of_root = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), "roots")
        named = written(joined_to_one(rooted.select("fingerprint", "rows", "root"), of_root, ["root"], "nodes"), "named")
        out = joined_to_one(found, named, ["fingerprint"], "rows")
        return kept(out.select("doc_id", "fingerprint", "root", "component_id", *(["uid"] if uid else [])), "duplicates")


def without_near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of near_duplicates(), with all columns of docs: that of the smallest doc_id, then any one of those."""
    held, uid = number_rows(docs)
    with scratch(docs.sparkSession):
        found = near_duplicates(held, words, most, text, doc_id, uid)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")
        stays = written(found.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "n", F.col("first.uid").alias("stays")), "stays")
        dropped = kept(joined_to_one(found.select("uid", "root"), stays, ["root"], "n").where("uid != stays").select("uid"), "dropped")
    return without_rows(held, uid, dropped, docs.columns)


def simhash_table(docs: DataFrame) -> DataFrame:
    """op13's columns: doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
