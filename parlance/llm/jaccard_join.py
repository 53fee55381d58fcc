"""N-gram Jaccard join: which documents share so large a part of their shingles that they link.

1. Each document becomes the sorted set of its shingles, as 64-bit hashes.
2. Sets that can be similar meet by signatures. Sets of neighbouring size classes differ in at most H
   shingles if they link; the range of hashes is cut into AGREE and more parts than H, so at least AGREE
   parts of the two are the same and not empty. A signature is the content of one part. Where few
   documents have one, each pair of them is noted, and pairs noted fewer than AGREE times are left out.
   A frequent one, as a passage makes that texts share, joins only those of its bearers that have
   more frequent ones than parts to spare: any other shares AGREE rare ones with all it links with.
   A set with few filled parts sends its empty ones too; what it links with may not, so it can spare
   no frequent filled one.
   Tasks send what they have often seen to where its bearer goes, not to one place.
3. What hangs together by signatures is a block; nothing links across blocks. Within a block each set
   is looked up among the smaller ones by T-occurrence search: the shingles' inverted lists are split
   by length, the short ones are merged with a heap that leaps over documents found too rarely, and
   the candidates left are probed for in all, the rarest first, by binary search (DivideSkip). Short
   lists hold a document only by the first of its own shingles in order of length. Documents already
   known to be connected with the sought one are taken off the lists first.
4. The links' connected components are the result.

A block is searched by neighbouring size classes, a group for each two; what fits one task is one unit. A
larger group is dealt out in chunks, each searched with the same PIVOTS of the group beside its own, as many as hold PIVOT_SHINGLES: what is
near one of them hangs together over all chunks. Where sets are left that don't, noted pairs are
compared as such. Those that only frequent signatures lead to are made out by inverted lists of prefixes:
in any one order of shingles two sets that link share one of the first few, and with those that many hold put last, few
others do. Only what meets there in units is searched again; its most numerous label isn't
compared with itself.

Shingles are 64-bit hashes: of two sets of n shingles a pair collides with probability n^2 / 2^64, and such a
collision counts one shingle too many in common.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from parlance.llm.common import kept, mapped, number_rows, scratch, small, without_rows, written
from parlance.llm.components import components

#: Chunks of a block hold about so many shingles and documents at most.
CHUNK_SHINGLES, CHUNK_DOCS = 750_000, 3000
#: Signatures that sets which link have in common at least; bearers of one up to which pairs are noted.
AGREE, FEW = 3, 6
#: Short lists that a document is found in at least.
SHARED = 3
#: Sets of a group of several chunks that each of its chunks is searched with, and their shingles in all: a task holds no more than a chunk and these.
PIVOTS, PIVOT_SHINGLES = 64, 250_000
#: Shingles of a chunk that are put last, most common last, and documents that hold one of them at least.
COMMON, COMMON_DOCS = 32_768, 4
#: Rows of units that go to every executor, some 40 bytes each; more are joined by a shuffle.
BROADCAST_UNITS = 500_000
#: Signatures that a task remembers with their first bearer.
SEEN_BITS = 20
#: Words with their hashes held ready in a worker.
STORE = 300_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingles:
    """Sorted distinct hashes of the runs of so many words of a text; of all its words, if it has fewer."""

    def __init__(self, words: int) -> None:
        self._n, self._store = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII spaces only
        if not words:
            return np.zeros(0, _U)
        if len(self._store) > STORE:
            self._store.clear()
        h = np.fromiter(map(self._store.__getitem__, words), _U, len(words))
        n = min(self._n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, _U)
            for k in range(n):
                out = _mix(out * _U(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


class Signatures:
    """Keys of which two sets share AGREE at least if they link, 100 * common >= percent * all."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent < 100:
            raise ValueError("percent must be from 50 to 99")
        self._p = percent
        self._starts = [1]

    def size_class(self, n: int) -> int:
        """Size classes: sets that link are in the same or in neighbouring ones."""
        while self._starts[-2 if len(self._starts) > 1 else -1] <= n or len(self._starts) < 3:
            # The first size that is too large to link with the class's first.
            self._starts.append(self._starts[-1] * 100 // self._p + 1)
        return bisect_right(self._starts, n) - 1

    def _split(self, g: int) -> tuple[int, int]:
        """Of group g, with the sets of classes g - 1 and g: the largest difference of two that link, and the number of parts."""
        largest = 2 * (self._starts[g + 1] - 1)
        differ = largest * (100 - self._p) // (100 + self._p)
        return differ, differ + AGREE + 4 + differ // 20

    def _differ(self, n: int) -> int:
        """The largest difference of a set of n from one that it links with: all of both are n * 100 / percent at most."""
        return n * 100 // self._p * (100 - self._p) // 100

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The keys, whose last bit tells the two groups apart and the one before it empty parts, and for each group (even, odd) how many frequent keys can be spared."""
        n, spare = len(hashes), [0, 0]
        if not n:
            return np.zeros(0, _U), spare
        own, found = self.size_class(n), []
        top = hashes >> _U(32)
        mixed = _mix(hashes)
        for g in (own, own + 1):
            differ, parts = self._split(g)
            if not differ:
                continue  # sets so small link only when equal
            # Of the group's bound a small set of it needs only what its own size allows.
            differ = min(differ, self._differ(n))
            part = (top * _U(parts)) >> _U(32)  # grows with the hash, so each part is a run
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.add.reduceat(mixed, heads)
            seed = _U((g << 32) + parts)
            keys = [_mix((content ^ _mix(part[heads] + _U(1))) + seed) & ~_U(3)]
            # Of the equal parts so many at least are filled; AGREE of them must not be frequent.
            spare[g & 1] = len(heads) - differ - AGREE
            if spare[g & 1] < 0:
                # Too few of the equal parts may be filled: empty ones count too.
                empty = np.setdiff1d(np.arange(parts, dtype=_U), part[heads])
                keys.append(_mix(_mix(empty * _U(0xC2B2AE3D27D4EB4F) + _U(1)) + seed) & ~_U(3) | _U(2))
                spare[g & 1] = parts - differ - AGREE
            found.append(np.concatenate(keys) | _U(g & 1))
        return (np.unique(np.concatenate(found)) if found else np.zeros(0, _U)), spare


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(document, number of lists) of the documents in at least so many of the sorted lists, by a heap of their heads."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need:
        doc, popped = heap[0][0], []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            out.append((doc, len(popped)))
            target = doc + 1
        else:
            # No document before the head of the need-th list can be in enough lists.
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], target, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return out


def search_block(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (as positions in sets) that connect the same sets as all links among them do; sets are sorted by size.

    label: the same number for sets known to be connected.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values = np.concatenate(sets)
    holders = np.repeat(np.arange(n), sizes)
    order = np.lexsort((holders, values))
    values, holders = values[order], holders[order]
    del order
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    shingles, lengths = values[heads], np.diff(heads, append=len(values))
    list_of = np.repeat(np.arange(len(heads)), lengths)
    del values, heads
    keys = list_of * n + holders  # sorted by list, then document
    # Lists in order of length. What two sets that link have in common first of all is, the SHARED first ones
    # of it, among the first of both in this order: lists of prefixes hold documents by those alone.
    rank = np.empty(len(shingles), np.int64)
    rank[np.argsort(lengths, kind="stable")] = np.arange(len(shingles))
    by_doc = np.argsort(holders * len(shingles) + rank[list_of])
    del list_of
    place = np.empty(len(holders), np.int64)
    place[by_doc] = np.arange(len(holders)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    del by_doc
    own_size = sizes[holders]
    in_prefix = place < own_size + (-percent * 2 * own_size) // (100 + percent) + SHARED
    prefix_keys, prefix_holders = keys[in_prefix], holders[in_prefix]
    del place, own_size, in_prefix
    label, links = np.arange(n) if label is None else label.copy(), []
    recent: list[int] = []

    def join(q: int, c: int) -> None:
        links.append((q, c))
        old, new = label[q], label[c]
        if old != new:
            label[label == old] = new

    for q in range(1, n):
        size = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-percent * size // 100)))
        if low >= q:
            recent.append(q)
            continue
        for p in reversed(recent[-3:]):
            if p >= low and (100 + percent) * len(np.intersect1d(sets[p], sets[q], assume_unique=True)) >= percent * (size + int(sizes[p])):
                join(q, p)
                break
        recent.append(q)
        if (label[low:q] == label[q]).all():
            continue
        t = -(-percent * (size + int(sizes[low])) // (100 + percent))
        shared = min(SHARED, t)
        own = np.searchsorted(shingles, sets[q])
        own = own[np.argsort(rank[own])]
        # The t - shared longest lists are probed; of the others, documents in so few as SHARED are found by heap.
        short = own[: size - t + shared]
        first, last = np.searchsorted(prefix_keys, short * n + low), np.searchsorted(prefix_keys, short * n + q)
        # Documents already connected with q need not be found again.
        lists = [x[label[x] != label[q]].tolist() for x in (prefix_holders[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True) if j > i)]
        docs = np.array([d for d, _ in merge_skip([x for x in lists if x], shared)], np.int64)
        if not len(docs):
            continue
        need = -(-percent * (size + sizes[docs]) // (100 + percent))
        counts = np.zeros(len(docs), np.int64)
        first, last = np.searchsorted(keys, own * n + low), np.searchsorted(keys, own * n + q)
        for left, i, j in zip(range(size, 0, -1), first.tolist(), last.tolist(), strict=True):
            may = counts + left >= need
            if not may.all():
                docs, counts, need = docs[may], counts[may], need[may]
                if not len(docs):
                    break
            if j > i:
                held = holders[i:j]
                counts += held[np.minimum(np.searchsorted(held, docs), j - i - 1)] == docs
        for d in docs[counts >= need].tolist():
            if label[d] != label[q]:
                join(q, d)
    return links


#: A document's row in the shuffle, beside its uid: whether it has a doc_id, that, and the size, size class, spare keys and digest of its set.
_DOC = np.dtype([("given", "u1"), ("doc_id", "<i8"), ("n", "<i8"), ("kind", "<i8"), ("spare", "<i8", 2), ("digest", "V16")])


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(words: int, percent: int):
    """Rows (key, uid, more) of each task's documents.

    more is null for a signature and 8 bytes of signature for one that the task has often seen (key is
    then the uid, so that rows of a frequent signature go to all tasks); else it is a document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signatures = Shingles(words), Signatures(percent)
        seen, times = np.zeros(1 << SEEN_BITS, _U), np.zeros(1 << SEEN_BITS, np.int8)
        for batch in batches:
            uids, more = [], []
            sent_keys, sent_uids = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text)
                sent, spare = signatures(found)
                # Below 0 where empty parts are sent, which is read back in _candidates.
                spare = [-1 - x if (sent & _U(3) == _U(side | 2)).any() else x for side, x in enumerate(spare)]
                uids.append(uid)
                more.append(np.array([(doc_id is not None, doc_id or 0, len(found), signatures.size_class(len(found)), spare, _digest(found))], _DOC).tobytes())
                slot = (sent & _U((1 << SEEN_BITS) - 1)).astype(np.int64)
                same = (seen[slot] == sent) & (times[slot] > 0)
                # Only what more than FEW rows have been sent of, so that it counts as frequent where rows meet.
                frequent = same & (times[slot] > FEW)
                if frequent.any():
                    for one in sent[frequent]:
                        uids.append(uid)
                        more.append(one.tobytes())
                    sent, slot, same = sent[~frequent], slot[~frequent], same[~frequent]
                times[slot] = np.where(same, times[slot] + 1, 1)
                seen[slot] = sent
                sent_keys.append(sent)
                sent_uids.append(np.full(len(sent), uid, np.int64))
            sent = np.concatenate(sent_keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(uids, pa.int64()), pa.array(more, pa.binary())], ["key", "uid", "more"])
            yield pa.RecordBatch.from_arrays([pa.array(sent), pa.array(np.concatenate(sent_uids)), pa.nulls(len(sent), pa.binary())], ["key", "uid", "more"])

    return rows


_MET = "what int, a long, b long, doc_id long, n long, kind long, even long, odd long, digest binary"
_DOCUMENT, _PAIR, _FREQUENT = range(3)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: documents (a), pairs (a, b) of the few bearers of a signature, and bearers (a) of frequent signatures (b)."""
    held_key, held = 0, []  # the last signature and its bearers so far
    many = False  # whether it is frequent: its bearers have been given out

    def some(what: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        n = len(rows)
        a, b = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.int32()), a, b, *(pa.nulls(n, pa.int64()) for _ in range(5)), pa.nulls(n, pa.binary())], names)

    names = ["what", "a", "b", "doc_id", "n", "kind", "even", "odd", "digest"]
    for batch in batches:
        key, uid, more = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        size = pc.fill_null(pc.binary_length(more), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(size == 8)
        frequent = list(zip(uid[known].tolist(), np.frombuffer(b"".join(more.take(pa.array(known)).to_pylist()), "<i8").tolist(), strict=True)) if len(known) else []
        pairs: list[tuple[int, int]] = []
        k, u = key[size < 0], uid[size < 0]
        if len(k):
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            ends = np.concatenate([heads[1:], [len(k)]])
            # Of the runs only those of two and more, the first, which may go on, and the last, which may be gone on with.
            chosen = np.unique(np.concatenate([[0], np.flatnonzero(ends - heads > 1), [len(heads) - 1]]))
            for r in chosen.tolist():
                run, this = u[heads[r] : ends[r]].tolist(), int(k[heads[r]])
                if this != held_key:
                    pairs += [(max(x, y), min(x, y)) for i, x in enumerate(held) for y in held[:i]]
                    held_key, held, many = this, [], False
                if not many:
                    held += run
                    if len(held) > FEW:
                        many, run, held = True, held, []
                if many:
                    frequent += [(x, this) for x in run]
        if pairs:
            yield some(_PAIR, pairs)
        if frequent:
            yield some(_FREQUENT, frequent)
        docs = np.flatnonzero(size > 8)
        if len(docs):
            found, n = np.frombuffer(b"".join(more.take(pa.array(docs)).to_pylist()), _DOC), len(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_DOCUMENT] * n, pa.int32()), pa.array(uid[docs]), pa.nulls(n, pa.int64()), pa.array(found["doc_id"].copy(), mask=found["given"] == 0), pa.array(found["n"].copy()), pa.array(found["kind"].copy()),
                    pa.array(found["spare"][:, 0].copy()), pa.array(found["spare"][:, 1].copy()), pa.array([x.tobytes() for x in found["digest"]], pa.binary()),
                ],
                names,
            )
    yield some(_PAIR, [(max(x, y), min(x, y)) for i, x in enumerate(held) for y in held[:i]])


def _candidates(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) noted AGREE times, and edges (a, b) that hang together by frequent signatures: both together all sets that can link.

    Of frequent signatures those bearers that have more of them than they can spare. A set that can spare
    its frequent ones has AGREE others in common with each that it links with. So of two that link and aren't a pair both
    are needy, that is in the second table.
    Of a set that sends empty parts, some of these may not send theirs: all filled ones in common must be rare.
    """
    pairs = met.where(F.col("what") == _PAIR).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= AGREE).select("a", "b")
    frequent = met.where(F.col("what") == _FREQUENT).select(F.col("a").alias("uid"), F.col("b").alias("key"), F.col("b").bitwiseAND(F.lit(1)).alias("side"))
    spare = met.where(F.col("what") == _DOCUMENT).select(F.col("a").alias("uid"), "even", "odd")
    counts = frequent.groupBy("uid", "side").agg(F.count(F.lit(1)).alias("has"), F.count(F.when(F.col("key").bitwiseAND(F.lit(2)) == 0, 1)).alias("filled")).join(spare, "uid")
    can = F.when(F.col("side") == 0, F.col("even")).otherwise(F.col("odd"))
    needy = counts.where(F.when(can < 0, (F.col("filled") > 0) | (F.col("has") > -1 - can)).otherwise(F.col("has") > can)).select("uid", "side")
    bearers = frequent.join(needy, ["uid", "side"], "left_semi")
    first = bearers.groupBy("key").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("bearers")).where("bearers > 1")
    # Near copies have dozens of keys, whose first bearers are few: each set goes to the least of its own, and those to each other.
    firsts = bearers.join(first, "key").groupBy("uid").agg(F.collect_set("first").alias("firsts"), F.min("first").alias("b"))
    stars = firsts.select(F.explode(F.array_append("firsts", F.col("uid"))).alias("a"), "b").distinct()
    return pairs, stars


_UNIT = ["block", "kind", "i", "j"]
_FOUND = "large boolean, a long, b long, block long, kind long, common binary"


def _units(batches: Iterator[pa.RecordBatch], shingles: Shingles) -> Iterator[tuple[tuple, list[tuple]]]:
    """(unit, (uid, label, large, set) of its rows); rows of a unit come together, with their texts last."""
    unit, held = None, []
    for batch in batches:
        for *own, _, uid, label, large, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != unit:
                if held:
                    yield unit, held
                unit, held = own, []
            held.append((uid, label, large, shingles(text)))
    if held:
        yield unit, held


def _searched(words: int, percent: int):
    """Links found in each unit, and of the first chunk of a large group its common shingles; rows of a unit are sorted by size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for (block, kind, i, _), held in _units(batches, shingles):
            uids, labels, sets, large = [r[0] for r in held], np.array([r[1] for r in held]), [r[3] for r in held], held[0][2]
            found = search_block(sets, percent, np.unique(labels, return_inverse=True)[1]) if len(sets) > 1 else []
            n = len(found)
            more = [pa.array([x], k) for x, k in zip((True, None, None, block, kind, _common(sets)), _KINDS, strict=True)] if large and not i else [pa.array([], k) for k in _KINDS]
            links = [pa.array([large] * n, pa.bool_()), *(pa.array([uids[x[k]] for x in found], pa.int64()) for k in (0, 1)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(links, more, strict=True)], ["large", "a", "b", "block", "kind", "common"])

    return rows


_KINDS = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _common(sets: list[np.ndarray]) -> bytes:
    """The shingles that most sets hold, in ascending order of their number."""
    found, times = np.unique(np.concatenate(sets), return_counts=True)
    chosen = np.flatnonzero(times >= COMMON_DOCS)
    return found[chosen[np.argsort(times[chosen], kind="stable")]][-COMMON:].tobytes()


def prefixes(found: np.ndarray, common: np.ndarray, percent: int, smallest: int = 0) -> tuple[np.ndarray, int]:
    """The first shingles of a set, and how many of them are enough to be met by.

    Shingles are ordered by their place among the common ones (others before), then by value. Two sets that
    link share one of the first ones of the larger and of the ones enough of the smaller. smallest: the
    size of the smallest set there is.
    """
    n = len(found)
    by_value = np.argsort(common)
    at = np.searchsorted(common, found, sorter=by_value)
    at = by_value[np.minimum(at, len(common) - 1)] if len(common) else at
    place = np.where(common[at] == found, at + 1, 0) if len(common) else np.zeros(n, np.int64)
    ordered = found[np.lexsort((found, place))]
    smallest = max(smallest, -(-percent * n // 100))
    least = -(-percent * (n + smallest) // (100 + percent))
    as_smaller = -(-percent * 2 * n // (100 + percent))
    return ordered[: n - least + 1], n - as_smaller + 1


def _prefixed(words: int, percent: int):
    """(block, kind, shingle, uid, label, enough) for the prefix of each set of a unit; the unit's first row has the common shingles."""
    names = ["block", "kind", "shingle", "uid", "label", "enough"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, unit, common, least = Shingles(words), None, np.zeros(0, _U), 0
        for batch in batches:
            out: list[list] = [[np.zeros(0, np.int64)] for _ in names]
            for *own, uid, label, blob, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != unit:
                    unit, common, least = own, np.zeros(0, _U), 0
                if blob is not None:
                    common, least = np.frombuffer(blob, _U), label
                    continue
                first, enough = prefixes(shingles(text), common, percent, least)
                n = len(first)
                for column, values in zip(out, (*(np.full(n, x, np.int64) for x in own[:2]), first.view(np.int64), *(np.full(n, x, np.int64) for x in (uid, label)), np.arange(n) < enough), strict=True):
                    column.append(values)
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:-1]), pa.array(columns[-1].astype(bool))], names)

    return rows


def link_table(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", uid: str | None = None) -> DataFrame:
    """uid, root, doc_id, n_shingles and component_id of each row: the components of the documents that link.

    Words are cut at ASCII white space, A-Z lower-cased. A document's set has the distinct runs of so
    many words; with fewer words the whole as one. Two link when 100 * common >= percent * all. component_id
    is the smallest doc_id that links reach (null only if all there are null). A null text, an empty
    one or one without words has no shingles and links with nothing, its own doc_id is its component;
    rows, not doc_ids, are compared: repeated rows link with each other, and rows of one doc_id only if their
    texts do. Rows of one component have the same root. An empty table gives no rows. uid: a column
    that tells rows apart and is the same whenever docs is read, if there is one.
    """
    if uid is None:
        docs, uid = number_rows(docs.select(doc_id, text))
    with scratch(docs.sparkSession):
        return kept(_linked(docs, words, percent, text, doc_id, uid), "linked")


def _with_texts(narrow: DataFrame, units: DataFrame) -> tuple[DataFrame, int]:
    """Rows of units (by uid) with their texts, and in how many tasks each has a chunk's shingles on average."""
    units = written(units, "units")
    rows, shingles = units.agg(F.count(F.lit(1)), F.sum("n")).first()
    tasks = max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((shingles or 0) / CHUNK_SHINGLES))
    return narrow.select("uid", "text").join(F.broadcast(units) if rows <= BROADCAST_UNITS else units, "uid"), tasks


def _search(narrow: DataFrame, units: DataFrame, words: int, percent: int) -> DataFrame:
    """What is found in units: rows of _UNIT, n, uid, label, large."""
    held, tasks = _with_texts(narrow, units)
    held = held.select(*_UNIT, "n", "uid", "label", "large", "text").repartition(tasks, *_UNIT).sortWithinPartitions(*_UNIT, "n", "uid")
    return mapped(held, _searched(words, percent), _FOUND)


def _chunk(by: str) -> Column:
    return F.pmod(F.xxhash64("uid"), F.col(by))


def _chunks(docs: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(docs / CHUNK_DOCS, shingles / CHUNK_SHINGLES))


def _pivots(large: DataFrame, order: WindowSpec) -> DataFrame:
    """The first sets of each group, as many as hold PIVOT_SHINGLES shingles together: where sets are so large that there is none, all is left to what comes after."""
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return large.withColumns({"place": F.row_number().over(order), "upto": upto}).where((F.col("place") <= PIVOTS) & (F.col("upto") <= PIVOT_SHINGLES)).drop("upto")


def _each(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _linked(docs: DataFrame, words: int, percent: int, text: str, doc_id: str, uid: str) -> DataFrame:
    narrow = docs.select(F.col(uid).alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = mapped(narrow, _signed(words, percent), "key long, uid long, more binary").repartition("key").sortWithinPartitions("key")
    met = written(mapped(signed, _met, _MET), "met")
    every = met.where(F.col("what") == _DOCUMENT).select(F.col("a").alias("uid"), "doc_id", "n", "kind", "digest")
    # Equal sets: the least uid stands for all.
    first = every.where("n > 0").groupBy("digest").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = every.where("n > 0").join(first.where("copies > 1"), "digest").where("uid != rep").select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    pairs, stars = (written(x, "candidates") for x in _candidates(met))
    blocks = components(pairs.unionByName(stars))
    members = every.join(first.select(F.col("rep").alias("uid")), "uid", "left_semi")
    members = members.join(blocks, F.col("uid") == F.col("node")).select("uid", "n", F.col("root").alias("block"), "kind")
    # Sets that link are of one size class or of neighbouring ones: each goes to its own and the next.
    members = members.withColumn("kind", F.explode(F.array(F.col("kind"), F.col("kind") + 1)))
    sizes = members.groupBy("block", "kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    sizes = sizes.select("block", "kind", _chunks(F.col("docs"), F.col("shingles")).alias("chunks"))
    members = written(members.join(small(sizes), ["block", "kind"]).withColumn("i", _chunk("chunks")), "members")
    large = members.where("chunks > 1")
    any_large = bool(large.limit(1).count())
    # Texts travel, not sets: they are half as large.
    chunk = members.select("block", "kind", "i", F.col("i").alias("j"), "n", "uid", F.col("uid").alias("label"), (F.col("chunks") > 1).alias("large"))
    if any_large:
        order = Window.partitionBy("block", "kind").orderBy(F.xxhash64("uid", F.lit(1)), "uid")
        pivots = _pivots(large, order)
        pivots = pivots.withColumn("to", F.explode(_each(F.col("chunks")))).where("to != i")
        chunk = chunk.unionByName(pivots.select("block", "kind", F.col("to").alias("i"), F.col("to").alias("j"), "n", "uid", F.col("uid").alias("label"), F.lit(True).alias("large")))
    found = _search(narrow, chunk, words, percent)
    if any_large:  # read several times
        found = written(found, "links")
    links = found.where("a is not null").select("a", "b")
    if any_large:
        links = links.unionByName(_between_chunks(narrow, large, found, pairs, stars, words, percent))
    found = components(links.unionByName(copies))
    found = found.join(every.select("uid", "doc_id"), F.col("node") == F.col("uid")).select("node", "root", "doc_id")
    least = found.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = found.join(least, "root").select("node", "root", "least")
    out = every.join(named, F.col("uid") == F.col("node"), "left")
    component = F.when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("uid", F.coalesce("root", "uid").alias("root"), "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _between_chunks(narrow: DataFrame, large: DataFrame, found: DataFrame, pairs: DataFrame, stars: DataFrame, words: int, percent: int) -> DataFrame:
    """The links that are still missing in groups of several chunks: between sets not yet connected."""
    labels = components(found.where("large and a is not null").select("a", "b"))
    held = large.join(labels, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "uid")).drop("node", "root")
    held = written(held, "labelled")
    zero = F.lit(0).cast("long")
    # Pairs noted as such: each set with those it is to be compared with. They are few, as rare signatures have few bearers.
    of = held.select("uid", "n", "label").distinct()
    side = lambda x: of.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"label_{x}"))
    apart = written(pairs.join(side("a"), "a").join(side("b"), "b").where("label_a != label_b"), "apart")
    noted = apart.select(F.col("a").alias("block"), F.col("n_b").alias("n"), F.col("b").alias("uid"), F.col("label_b").alias("label")).unionByName(apart.select(F.col("a").alias("block"), F.col("n_a").alias("n"), F.col("a").alias("uid"), F.col("label_a").alias("label")).distinct())
    noted = noted.select("block", F.lit(3).cast("long").alias("kind"), zero.alias("i"), zero.alias("j"), "n", "uid", "label", F.lit(False).alias("large"))
    # All others are needy.
    needy = stars.select(F.col("a").alias("uid")).distinct()
    held = held.join(needy, "uid", "left_semi")
    open_groups = held.groupBy("block", "kind").agg((F.min("label") < F.max("label")).alias("open"), F.min("n").alias("least")).where("open")
    held = written(held.join(small(open_groups), ["block", "kind"]), "open")
    # Sets by their prefixes, those of a chunk after the common shingles and the least size of its group.
    common = found.where("common is not null").select("block", "kind", "common").join(small(held.select("block", "kind", "i", "least").distinct()), ["block", "kind"])
    sets, tasks = _with_texts(narrow, held.select("block", "kind", "i", "n", "uid", "label"))
    null = lambda kind: F.lit(None).cast(kind)
    first = common.select("block", "kind", "i", null("long").alias("uid"), F.col("least").alias("label"), "common", null("string").alias("text"))
    sets = first.unionByName(sets.select("block", "kind", "i", "uid", "label", null("binary").alias("common"), "text"))
    sets = sets.repartition(tasks, "block", "kind", "i").sortWithinPartitions("block", "kind", "i", F.col("uid").asc_nulls_first())
    rows = written(mapped(sets, _prefixed(words, percent), "block long, kind long, shingle long, uid long, label long, enough boolean"), "prefixes")
    at = ["block", "kind", "shingle"]
    meet = rows.groupBy(*at).agg(F.min("uid").alias("first"), F.max("enough").alias("any"), (F.min("label") < F.max("label")).alias("differ")).where("any and differ")
    near = components(rows.join(small(meet), at).select(F.col("uid").alias("a"), F.col("first").alias("b")).distinct())
    again = near.join(held.select("kind", "uid", "n", "label"), F.col("node") == F.col("uid")).select(F.col("root").alias("block"), "kind", "uid", "n", "label")
    group = ["block", "kind"]
    by_label = again.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    most = by_label.groupBy(*group).agg(F.max(F.struct("docs", "label", "shingles")).alias("m"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).where("docs > m.docs")
    rest_of = lambda c: F.col(c) - F.col(f"m.{c}")
    most = most.select(*group, F.col("m.label").alias("most"), _chunks(F.col("docs"), F.col("shingles")).alias("all"), _chunks(F.col("m.docs"), F.col("m.shingles")).alias("own"), _chunks(rest_of("docs"), rest_of("shingles")).alias("rest"))
    again = again.join(small(most), group).withColumn("is_most", F.col("label") == F.col("most"))
    # Units of each group: 0, all of it; 1, two chunks of the rest; 2, a chunk of the rest and one of the most numerous label.
    unit = lambda what, i, j: F.struct((F.col("kind") * 4 + what).alias("kind"), i.alias("i"), j.alias("j"))
    rest, own = _chunk("rest"), _chunk("own")
    among = F.transform(_each(F.col("rest")), lambda k: unit(1, F.least(rest, k), F.greatest(rest, k)))
    across = F.transform(_each(F.col("own")), lambda k: unit(2, rest, k))
    with_rest = F.transform(_each(F.col("rest")), lambda k: unit(2, k, own))
    to = F.when(F.col("all") == 1, F.array(unit(0, zero, zero))).when(F.col("is_most"), with_rest).otherwise(F.concat(among, across))
    units = again.select("block", F.explode(to).alias("u"), "n", "uid", "label").select("block", "u.kind", "u.i", "u.j", "n", "uid", "label", F.lit(False).alias("large"))
    return _search(narrow, units.unionByName(noted), words, percent).select("a", "b")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of link_table(), with all columns of docs: that of the smallest doc_id, then any one of those."""
    held, uid = number_rows(docs)
    with scratch(docs.sparkSession):
        dropped = kept(_to_drop(link_table(held, words, percent, text, doc_id, uid)), "dropped")
    return without_rows(held, uid, dropped, docs.columns)


def _to_drop(found: DataFrame) -> DataFrame:
    """uid of all rows of a component but the first."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")
    stays = found.groupBy("root").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", F.col("first.uid").alias("stays"))
    return found.join(stays, "root").where("uid != stays").select("uid")
