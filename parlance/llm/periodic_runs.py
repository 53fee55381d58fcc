"""Periodic runs: stretches of words that repeat with some period at least four times over.

Words become small ids, and each bit of the ids one big integer: the planes. Shifted by a lag q and XORed,
OR over all planes, they show which words differ from the one q further on; a stretch of zeros is a
stretch of period q. AND of the matches with themselves, shifted by doubled distances, leaves what starts a
stretch that is long enough.

Only few lags need that. A stretch of period q >= s has 2 * s words at a multiple of s that are equal to those q further on:
hashes of windows, doubled from level to level, are compared at these places for all lags from s to 2 * s - 1 at once,
n comparisons a level. Equal words have equal hashes, so no lag is lost; the planes then decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import mapped, own_name

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
_U = np.uint64

Run = tuple[int, int, int]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (a * _U(0x9E3779B97F4A7C15)) ^ (a >> _U(29)) ^ (b * _U(0xD6E8FEB86659FD93))
        return out ^ (out >> _U(32))


def numbered(words: list) -> np.ndarray:
    """Each word as the number of its first place among the distinct ones."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class _Planes:
    """The bits of ids, one big integer for each; made when first needed."""

    def __init__(self, ids: np.ndarray) -> None:
        bits = max(1, int(ids.max()).bit_length())
        self._n = len(ids)
        self._planes = [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(bits)]

    def stretches(self, lag: int) -> list[tuple[int, int]]:
        """(start, end) of the longest stretches of period lag that are long enough for a run."""
        differ = 0
        for plane in self._planes:
            differ |= plane ^ (plane >> lag)
        places = self._n - lag
        same = ~differ & ((1 << places) - 1)
        need, have = max(LEAST_WORDS, LEAST_TIMES * lag) - lag, 1
        while have < need and same:
            step = min(have, need - have)
            same &= same >> step
            have += step
        if not same:
            return []
        bits = np.unpackbits(np.frombuffer(same.to_bytes((places + 7) // 8, "little"), np.uint8), count=places, bitorder="little")
        edges = np.flatnonzero(np.diff(bits, prepend=0, append=0))  # of uint8: 1 and 255
        # A one says that need matches start there; the last of them ends need - 1 matches later, and a lag after that the stretch.
        return [(s, e + need - 1 + lag) for s, e in edges.reshape(-1, 2).tolist()]


def find_runs(words: list) -> list[Run]:
    """(start, length, period) of every run of words, by start, then period.

    A run has its smallest period, no neighbouring word extends it, and it has LEAST_WORDS words and
    LEAST_TIMES periods at least.
    """
    n = len(words)
    found: list[Run] = []
    if n < LEAST_WORDS:
        return found
    ids = numbered(words)
    planes = None
    # Of the runs found so far: start, end and period.
    known = np.zeros((3, 0), np.int64)
    window, s = ids.astype(_U) + _U(1), 1
    while LEAST_TIMES * s <= n:
        window = _mix(window[:-s], window[s:])  # now of 2 * s words
        rows = -(-len(window) // s) - 1
        if rows < 1:
            break
        grid = np.zeros((rows + 1, s), _U)
        grid.reshape(-1)[: len(window)] = window
        met = grid[1:] == grid[:-1, :1]  # [j, k]: the window at j * s and the one s + k further on
        met.reshape(-1)[len(window) - s :] = False
        for k in np.flatnonzero(met.any(axis=0)).tolist():
            q = s + k
            if LEAST_TIMES * q > n:
                break
            at = np.flatnonzero(met[:, k]) * s
            # What lies in a run whose period divides q has that period: a run of smallest period q overlaps it by less than q words.
            for start, end, _ in known[:, q % known[2] == 0].T:
                at = at[(at < start) | (at + q > end)]
                if not len(at):
                    break
            if not len(at):
                continue
            planes = planes or _Planes(ids)
            new = [(a, b) for a, b in planes.stretches(q) if not ((known[0] <= a) & (known[1] >= b) & (q % known[2] == 0)).any()]
            found += [(a, b - a, q) for a, b in new]
            if new:
                known = np.concatenate([known, np.array([(a, b, q) for a, b in new], np.int64).T], axis=1)
        s *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with most repetitions, as an exact ratio; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def collapsed(words: list, runs: list[Run]) -> list:
    """words without what runs repeat: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, text: str = "text", rewritten: Callable[[dict, list[bytes]], list[bytes]] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """docs with three more columns: runs, strongest and collapsed.

    runs: array of (start, length, period), in words from 0; words are cut at ASCII white space. strongest: one of
    them, null if there is none. collapsed: the words without repetitions, joined by one space. A null or
    empty text has no words, no runs and an empty collapsed text. Every row gives one row, repeated ones
    too; underscores tell the new columns' names from those that docs has. An empty table gives no rows.

    rewritten: what to do with the words of a row beforehand; it gets the columns by of that row and the words.
    One text is one piece of work: its words and its planes are in memory, some 100 bytes a word.
    """
    taken = docs
    names = []
    for name in ("runs", "strongest", "collapsed"):
        names.append(own_name(taken, name))
        taken = taken.withColumn(names[-1], F.lit(None))
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.ArrayType(run), run, T.StringType()), strict=True))])
    at = docs.columns.index(text)
    beside = {c: docs.columns.index(c) for c in by}
    arrow = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, rest = [], [], []
            values = {c: batch.column(k).to_pylist() for c, k in beside.items()}
            for row, value in enumerate(batch.column(at).to_pylist()):
                words = (value or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only
                if rewritten:
                    words = rewritten({c: v[row] for c, v in values.items()}, words)
                runs = find_runs(words)
                found.append([named(r) for r in runs])
                best.append(named(strongest(runs)))
                rest.append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
            more = [pa.array(found, pa.list_(arrow)), pa.array(best, arrow), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return mapped(docs, rows, schema)


def repeating(row: dict, words: list[bytes]) -> list[bytes]:
    """The words as op11's contract plants repetitions: in a tenth of the documents, by a checksum of doc_id, from some word on a few words recur.

    A null doc_id plants nothing.
    """
    if row["doc_id"] is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(row["doc_id"]).encode()), 10)
    if tenth:
        return words
    n = len(words)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + [words[first + i % period] for i in range(n - first)]


def run_digests(docs: DataFrame) -> DataFrame:
    """op11's columns from with_runs(), after repeating(): counts, the strongest run and digests of all runs and of the collapsed text.

    Rows without a run have null start, length, period and exponent_milli. A null doc_id stays null.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = with_runs(narrow, rewritten=repeating, by=("doc_id",))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = {x: F.col(f"strongest.{x}") for x in ("start", "length", "period")}
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(c.alias(x) for x, c in best.items()),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
