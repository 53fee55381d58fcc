"""Benchmark decontamination by templates.

A text is read in two ways. As words: letters and numbers, lower-cased. As a template: numbers, names
(runs of capitalised words) and units become typed slots, so a question asked again with other
numbers and other people reads the same. A run of names ends at punctuation and line ends; as a name
can hold them too (Dr. Smith), a text with such runs is read as a template in a second way, in which
they go on. Windows of WINDOW tokens of both readings are joined by hash
with those of the benchmark. Windows that lie at the same distance in document and item are taken
together, and the slots they cover must be filled consistently: equal in the item exactly where equal
in the document. An item with enough windows matched is in the document. A reading of fewer than WINDOW
tokens is one window of its own length. Scripts without spaces are read character by character.

Only windows whose hash is marked in a bitmap of fixed size leave the scan, so the join moves little
more than what matches; a benchmark too large for the bitmap makes it let more through, not less.
An item that needs k windows has one at least outside of its k - 1 most common ones: only those lead
to it, so a phrase that many items share doesn't join each of them with each document that has it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import kept, mapped, number_rows, scratch, small, without_rows, written

#: Tokens in a window, words among them at least, and windows that make a match (all, if an item has fewer).
WINDOW, LEAST_WORDS, ENOUGH = 8, 4, 6
#: Bits of the bitmap: 8 MB, whatever the benchmark.
MARK_BITS = 26
MARK_SLICES = 64
STORE = 200_000
#: Characters of texts that are read end to end, so that short ones don't cost calls of their own.
TEXT_CHARS = 200_000
#: Rows of windows or of classes of items that go to every executor, some 150 bytes each; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000

# Words that stand for units of measure, money and time.
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes gram grams kilogram
    kilograms ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons second seconds minute minutes
    hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees
    meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mph kph watt watts volt volts""".split()
)

#: Units in the plural with their singular: one value of a slot.
SINGULAR = {w: w[:-1] for w in UNITS if w.endswith("s") and w[:-1] in UNITS} | {"inches": "inch", "feet": "foot"}

# Words that begin sentences and are no names even when capitalised.
STARTERS = frozenset(
    """a an the if when while how what which who where why in on at of for from by to with and or but as is are was were
    do does did has have had this that these those there it he she they we you i his her their our your my one each every
    all some suppose given find let after before der die das ein eine wenn wie was wer in im le la les un une si quel el
    los las una cuando en de""".split()
)

# Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e01-\u0e4f\u0e81-\u0ecf\u1000-\u103f\u1780-\u17df\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
# Numbers, words, letters of those scripts, and what is between them but for blanks.
_TOKENS = re.compile(rf"\d+(?:[.,]\d+)*|[^\W\d_{_UNSPACED}]+|[{_UNSPACED}]|[^\w ]+")
_WORD, _NUMBER, _NAME, _UNIT, _BREAK, _JOINT = range(6)
#: What names go on over: Anne-Marie, D'Arcy.
_JOINTS = frozenset("-\u2010\u2011'\u2019\t\u00a0")
_U = np.uint64
_PRIME = _U(0x9E3779B185EBCA87)


class _Tokens(dict):
    """Words with their row in arrays of hashes, slot values and kinds."""

    def __init__(self) -> None:
        self.hashes, self.slots, self.kinds = np.zeros(1024, _U), np.zeros(1024, _U), np.zeros(1024, np.int8)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.hashes):
            self.hashes, self.slots, self.kinds = (np.concatenate([x, np.zeros(k, x.dtype)]) for x in (self.hashes, self.slots, self.kinds))
        self[word] = k
        if not word[0].isalnum():
            self.kinds[k] = _JOINT if _JOINTS.issuperset(word) else _BREAK
            return k
        low = word.lower()
        self.hashes[k] = self.slots[k] = xxhash.xxh3_64_intdigest(low.encode())
        if low in SINGULAR:
            self.slots[k] = xxhash.xxh3_64_intdigest(SINGULAR[low].encode())
        capital = len(word) > 1 and word[0].isupper() and word[1:].islower() and low not in STARTERS
        self.kinds[k] = _NUMBER if word[0].isdigit() else _NAME if capital else _UNIT if low in UNITS else _WORD
        return k


#: Of a reading: hashes and first tokens of its windows, their length, and slot values by token.
Reading = tuple[np.ndarray, np.ndarray, int, np.ndarray]


class Windows:
    """The windows of a text in each reading: as words, as a template, and if that differs as one in which runs of names go on over punctuation.

    lengths: of windows below WINDOW that are given too. As an item, a reading of fewer tokens than WINDOW
    is one window of their number.
    """

    def __init__(self, lengths: tuple[int, ...] = ()) -> None:
        self._tokens, self._lengths = _Tokens(), (*lengths, WINDOW)

    def __call__(self, text: str | None, item: bool = False) -> list[tuple[int, Reading]]:
        return [(k, (h, at, n, values)) for k, (h, at, n, values), _, _ in self.of([text], item)]

    def of(self, texts: list[str | None], item: bool = False) -> Iterator[tuple[int, Reading, np.ndarray, np.ndarray]]:
        """The readings of many texts end to end, whose windows lie within one text each; the text of each token, and the token that each text begins with.

        item: of a single text, whether it is an item.
        """
        if len(self._tokens) > STORE:
            self._tokens = _Tokens()
        known = self._tokens
        found = [_TOKENS.findall(text or "") for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        kinds = known.kinds[rows]
        of = np.repeat(np.arange(len(found)), sizes)
        token = kinds < _BREAK
        breaks = np.cumsum(kinds == _BREAK)[token]
        rows, kinds, of = rows[token], kinds[token], of[token]
        hashes, slots = known.hashes[rows], known.slots[rows]
        name = kinds == _NAME
        goes_on = name[1:] & name[:-1] & (of[1:] == of[:-1])
        broken = goes_on & (breaks[1:] != breaks[:-1])
        read = [(0, hashes, np.zeros(len(hashes), _U), of), (1, *_template(hashes, slots, kinds, of, goes_on & ~broken))]
        if broken.any():
            # Of texts where it makes a difference alone.
            other = np.isin(of, of[1:][broken])
            within = goes_on[np.flatnonzero(other)[1:] - 1]
            read.append((2, *_template(hashes[other], slots[other], kinds[other], of[other], within)))
        for k, own, values, of_own in read:
            begins = np.searchsorted(of_own, np.arange(len(texts)))
            for w in _windows(own, values, of_own, k > 0, (min(WINDOW, len(own)),) if item else self._lengths):
                yield k, w, of_own, begins


def _template(hashes: np.ndarray, slots: np.ndarray, kinds: np.ndarray, of: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The template's tokens, slot values and texts; goes_on: which tokens from the second on are of one name with the one before."""
    if goes_on.any():
        keep = np.concatenate([[True], ~goes_on])
        heads = np.flatnonzero(keep)
        slots = np.add.reduceat(slots * (np.arange(len(slots), dtype=_U) - heads[np.cumsum(keep) - 1].astype(_U) + _U(1)), heads)
        hashes, kinds, of = hashes[heads], kinds[heads], of[heads]
    slot = kinds != _WORD
    return np.where(slot, kinds.astype(_U), hashes), np.where(slot, slots * _PRIME + kinds.astype(_U), _U(0)), of


def _windows(tokens: np.ndarray, values: np.ndarray, of: np.ndarray, template: bool, lengths: tuple[int, ...]) -> Iterator[Reading]:
    """Windows of each length; of a template those with enough words."""
    plain = np.concatenate([[0], np.cumsum(values == 0)]) if template else None
    for n in lengths:
        if not 0 < n <= len(tokens):
            continue
        h, within = _rolled(tokens, n), of[n - 1 :] == of[: len(of) - n + 1]
        if template:
            within &= plain[n:] - plain[:-n] >= LEAST_WORDS
        at = np.flatnonzero(within)
        h = h[at] ^ _U(0x5851F42D4C957F2D) if template else h[at]
        yield h, at, n, values


def _rolled(hashes: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """A hash of each run of so many tokens; runs of different lengths have different hashes."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        if length == WINDOW:  # a power of two: three steps
            out, power, width = hashes, _PRIME, 1
            while width < WINDOW:
                out, power, width = out[:-width] * power + out[width:], power * power, 2 * width
        else:
            out = hashes[:n] + _U(length)
            for k in range(1, length):
                out = out * _PRIME + hashes[k : k + n]
        return (out ^ (out >> _U(32))) * _PRIME


def _kind(template: bool, reading: Reading) -> bytes:
    """What is the same of two readings that match the same documents: windows, and where slots are equal."""
    h, at, n, values = reading
    if not template:
        return xxhash.xxh3_128_digest(h.tobytes()) + b"w"
    covered = np.zeros(len(values) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    held = np.where(np.cumsum(covered[:-1]) > 0, values, _U(0))
    _, first, which = np.unique(held, return_index=True, return_inverse=True)
    return xxhash.xxh3_128_digest(np.concatenate([h, at.astype(_U), np.where(held == 0, 0, first[which] + 1).astype(_U)]).tobytes()) + b"t"


_NAMES = ["uid", "key", "h", "reading", "at", "total", "length", "kind", "slots"]
_SCHEMA = "uid long, key long, h long, reading int, at long, total long, length int, kind binary, slots array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
#: Rows of windows that are given out at a time.
_ROWS = 20_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item."""
    windows, out = Windows(), []
    for batch in batches:
        for uid, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for reading, found in windows(text, True):
                (h, at, n, values), kind = found, _kind(reading > 0, found)
                for k in range(len(h)):
                    a = int(at[k])
                    out.append((uid, key, int(h[k].view(np.int64)), reading, a, len(h), n, kind, values[a : a + n].view(np.int64).tolist() if reading else None))
                    if len(out) == _ROWS:
                        yield _batch(out)
                        out = []
    yield _batch(out)


def _some(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in runs of TEXT_CHARS, or of one text, each with the place of its first."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= TEXT_CHARS:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _documents(marks: Callable[[], np.ndarray], lengths: tuple[int, ...]):
    """A row for each text (h null) and one for each window that is marked; of words each hash once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bits, out = Windows(lengths), marks(), []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            out += [(*own, None, 0, 0, 0, 0, None, None) for own in keys]
            for first, texts in _some(batch.column(2).to_pylist()):
                for reading, (h, at, n, values), of, begins in windows.of(texts):
                    place = h >> _U(64 - MARK_BITS)
                    chosen = np.flatnonzero(bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1)
                    if not reading:
                        # Of a text each hash once, where it is first.
                        chosen = chosen[np.lexsort((chosen, h[chosen], of[at[chosen]]))]
                        held, text = h[chosen], of[at[chosen]]
                        chosen = chosen[np.concatenate([[True], (held[1:] != held[:-1]) | (text[1:] != text[:-1])])[: len(chosen)]]
                    for k in chosen.tolist():
                        a = int(at[k])
                        text = int(of[a])
                        out.append((*keys[first + text], int(h[k].view(np.int64)), reading, a - int(begins[text]), 0, n, None, values[a : a + n].view(np.int64).tolist() if reading else None))
                        if len(out) >= _ROWS:
                            yield _batch(out)
                            out = []
            if out:
                yield _batch(out)
                out = []

    return rows


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The marks of all hashes. Each task makes one slice; the driver gets MARK_SLICES slices, 8 MB in all."""
    width = (1 << MARK_BITS) // MARK_SLICES
    place = F.shiftrightunsigned("h", 64 - MARK_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(0).to_numpy()
            for k in np.unique(places // width).tolist():
                own = places[places // width == k] - k * width
                np.bitwise_or.at(slices.setdefault(k, np.zeros(width // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], ["k", "bits"])

    dealt = windows.select(place.alias("place")).distinct().repartition(MARK_SLICES, F.floor(F.col("place") / width))
    out = np.zeros((MARK_SLICES, width // 8), np.uint8)
    for r in mapped(dealt, rows, "k long, bits binary").toLocalIterator():
        out[r.k] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def matches(docs: DataFrame, benchmark: DataFrame, uid: str, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", items: bool = True) -> DataFrame:
    """uid, doc_id, contaminated, n_items and first_item of each row of docs: the rows of the benchmark that are in it.

    Items with the same windows and the same pattern of equal slots are searched for once. A null or
    empty text on either side matches nothing; an item whose item_id is null is searched for like any
    other. items: whether the items found are counted; without, n_items and first_item are null.
    """
    with scratch(docs.sparkSession):
        return kept(_matches(docs, benchmark, uid, text, doc_id, item_id, item_text, items), "contaminated")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df


def _matches(docs: DataFrame, benchmark: DataFrame, uid: str, text: str, doc_id: str, item_id: str, item_text: str, with_items: bool) -> DataFrame:
    spark = docs.sparkSession
    numbered = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col(item_id).cast("long").alias("key"), F.col(item_text).alias("text"))
    items = written(mapped(numbered, _items, _SCHEMA), "items")
    # Each set of equal windows once, as the first reading of the first item has them.
    first = items.groupBy("kind").agg(F.min(F.struct("uid", "reading")).alias("first"))
    own = items.join(small(first), "kind").where((F.col("uid") == F.col("first.uid")) & (F.col("reading") == F.col("first.reading")))
    often = items.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    need = F.least("total", F.lit(ENOUGH))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("times", "at"))
    sought = own.join(small(often), "h").select("kind", "h", F.col("at").alias("item_at"), "length", need.alias("need"), (F.col("reading") == 0).alias("words"), F.col("slots").alias("item_slots"), (place <= F.col("total") - need + 1).alias("leads"))
    sought = written(sought, "sought")
    lengths = tuple(sorted(r.length for r in sought.where(F.col("length") < WINDOW).select("length").distinct().collect()))
    marks = spark.sparkContext.broadcast(_bitmap(sought))
    read = docs.select(F.col(uid).alias("uid"), F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    found = written(mapped(read, _documents(lambda: marks.value, lengths), _SCHEMA), "windows")
    marks.unpersist()
    hits = found.where("h is not null").select("uid", "h", (F.col("reading") == 0).alias("words"), "reading", "at", "slots")
    # The windows that lead to an item, then for what they lead to the few others.
    by_lead = hits.join(_few(sought.where("leads").drop("leads", "length")), ["h", "words"])
    names = ["uid", "kind", "need", "words", "reading", "at", "slots", "item_at", "item_slots"]
    by_lead = written(by_lead.select(*names), "leads")
    others = by_lead.select("uid", "kind").distinct().join(_few(sought.where(~F.col("leads")).drop("leads", "length")), "kind")
    met = written(by_lead.unionByName(others.join(hits, ["uid", "h", "words"]).select(*names)), "met")
    in_words = met.where("words").groupBy("uid", "kind", "need").agg(F.count(F.lit(1)).alias("n"))
    # Templates: windows of one alignment whose slots are filled one to one. Each template of the
    # document with each of the item: the second is there only where it differs.
    alignment = ["uid", "kind", "reading", "shift"]
    aligned = met.where(~F.col("words")).withColumn("shift", F.col("at") - F.col("item_at"))
    filled = aligned.select(*alignment, F.inline(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))).where("i != 0").distinct()
    filled = filled.groupBy(*alignment).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("i")).alias("of_i"), F.size(F.collect_set("d")).alias("of_d"))
    conflicts = filled.where((F.col("of_i") < F.col("n")) | (F.col("of_d") < F.col("n")))
    in_template = aligned.join(small(conflicts), alignment, "left_anti").groupBy("uid", "kind", "need", "reading").agg(F.count_distinct("item_at").alias("n"))
    there = written(in_words.unionByName(in_template.drop("reading")).where("n >= need").select("uid", "kind").distinct(), "found")
    every = found.where("h is null").select("uid", F.col("key").alias("doc_id"))
    if not with_items:
        of_doc = there.select("uid").distinct().select("uid", F.lit(True).alias("found"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("long").alias("first_item"))
        return every.join(of_doc, "uid", "left").select("uid", "doc_id", F.coalesce("found", F.lit(False)).alias("contaminated"), "n_items", "first_item")
    # Items that are equal in all readings are one class; a document has each class once.
    of_item = items.groupBy("uid", "key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    classes = of_item.groupBy("kinds").agg(F.min("uid").alias("class"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"))
    classes = written(classes.select(F.explode("kinds").alias("kind"), "class", "rows", "least"), "classes")
    by_class = there.join(_few(classes), "kind").select("uid", "class", "rows", "least").distinct()
    by_doc = by_class.groupBy("uid").agg(F.sum("rows").alias("n_items"), F.min("least").alias("first_item"))
    n = F.coalesce("n_items", F.lit(0))
    return every.join(by_doc, "uid", "left").select("uid", "doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "first_item")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, contaminated, n_items and first_item of each row of docs.

    n_items: rows of the benchmark found in the text, in one reading or another, each once; first_item:
    the smallest item_id of them, null if there are none or all are null. A null or empty text is not
    contaminated; an item of fewer than WINDOW tokens is found as a whole, so that one of a single word
    is in every text with that word. Repeated rows give repeated rows; a null doc_id stays null. With
    an empty benchmark nothing is contaminated.
    """
    narrow = docs.select(doc_id, text)
    held, uid = number_rows(narrow)
    out = matches(held, benchmark, uid, text, doc_id)
    return out.select("doc_id", "contaminated", "n_items", "first_item")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that no benchmark item is in, with all their columns."""
    held, uid = number_rows(docs)
    with scratch(docs.sparkSession):
        found = kept(matches(held, benchmark, uid, text, doc_id, items=False).where("contaminated").select("uid"), "dropped")
    return without_rows(held, uid, found, docs.columns)
