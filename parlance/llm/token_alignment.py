"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which go with which.

Both tokenizers cut the same bytes: the text after one space. The ends of their tokens, as running sums of byte lengths,
are merged by binary search; where both end, a group ends, and the two tokens that end there are linked.
Spark counts the links of each pair of ids over all texts, takes each side's largest count, and joins
both back to the texts.

Few pairs make up most of the links. Those with more than a HOT-th of all (text, pair) rows, at most HOT
of them, go to every executor; the others are joined by a shuffle, in which no key has more rows than that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import bpe, pretokens
from parlance.llm.common import kept, mapped, ready, scratch, small, written

#: Pairs of ids that go to every executor at most, some 100 bytes each.
HOT = 100_000
_TEXT = "groups string, n_a long, n_b long, n_groups long, n_links long, pairs array<struct<a:int,b:int,n:int>>"

#: Pairs of ids that a worker keeps written out; when full, the store starts anew.
STORE = 500_000


class Tokens:
    """A tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes]) -> None:
        self.encode, self.spelled = encode, spelled
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The ids of text; None if there is none or they don't spell space + text."""
        if not text:
            return None
        ids = self.encode(text)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        return np.fromiter(ids, np.int64, len(ids)) if b"".join(map(self.spelled.__getitem__, ids)) == whole else None

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends, in bytes."""
        sizes = self.lengths[ids]
        if not sizes.all():
            raise ValueError("a token without bytes")
        return np.cumsum(sizes)


#: So much white space in a row is more than tiktoken's patterns can take.
_LONG_GAP = re.compile(r"\s{1000}")


def _byte_level(spec: str) -> Tokens:
    """space + text by a byte-level BPE vocabulary in the tokenizers JSON format; strings of special tokens are plain text.

    tiktoken merges what has the smallest id; where the merges aren't in the order of ids, and for texts with
    white space that it can't take, op3's encoder gives the ids.
    """
    doc = json.loads(spec)
    bpe._refuse_unsupported(doc)
    added = {t["content"] for t in doc["added_tokens"]}
    ids: dict[str, int] = doc["model"]["vocab"]
    ranks = {bytes(map(pretokens.BYTE_OF.__getitem__, x)): k for x, k in ids.items() if x not in added}
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in doc["model"]["merges"]]
    single = {k for x, k in ids.items() if len(x) == 1}
    in_order = made == sorted(set(made)) and len(single) == 256 and max(single) < made[0] and len(ranks) == len(made) + 256
    quick = tiktoken.Encoding("own", pat_str=pretokens.GENERAL.pattern, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(text: str) -> list[int]:
        text = " " + text
        return bpe.encoder_of(spec)._plain(text) if quick is None or _LONG_GAP.search(text) else quick.encode_ordinary(text)

    spelled = [b""] * (max(ranks.values()) + 1)
    for x, k in ranks.items():
        spelled[k] = x
    return Tokens(encode, spelled)


def _pieces(model: bytes) -> Tokens:
    """text by a sentencepiece model, which puts a space before it."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
    spelled = [bytes([int(x[3:5], 16)]) if processor.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
    return Tokens(lambda text: processor.encode([text], num_threads=1)[0], spelled)


_NONE = np.zeros(0, np.int64)


def tokenizers_of(spec: str, model: bytes) -> tuple[Tokens, Tokens]:
    """Both tokenizers, built once per worker."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), hashlib.sha256(model).hexdigest())
    return ready("token_alignment", key, lambda: (_byte_level(spec), _pieces(model)))


def _both_end(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to each place where both end; ends are ascending, so each is found by binary search among the other side's."""
    if not len(a) or not len(b):
        return _NONE, _NONE
    at = np.searchsorted(b, a)
    both = b[np.minimum(at, len(b) - 1)] == a
    return np.flatnonzero(both) + 1, at[both] + 1


def merge(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """_both_end() of lists."""
    at_a, at_b = _both_end(np.array(ends_a, np.int64), np.array(ends_b, np.int64))
    return at_a.tolist(), at_b.tolist()


class _Written(dict):
    def __missing__(self, pair: int) -> str:
        if len(self) >= STORE:
            self.clear()
        out = self[pair] = f"{pair >> 32}|{pair & 0xFFFFFFFF}"
        return out


_WRITTEN = _Written()


class Aligned:
    """The tokens of one text by both tokenizers, and the places where both end.

    A null or empty text has none, nor has one that a tokenizer doesn't give back byte by byte.
    """

    def __init__(self, a: np.ndarray | None, b: np.ndarray | None, first: Tokens, second: Tokens) -> None:
        self.a = self.b = self.at_a = self.at_b = self.linked = _NONE
        if a is None or b is None:
            return
        self.a, self.b = a, b
        self.at_a, self.at_b = _both_end(first.ends(a), second.ends(b))
        self.linked = a[self.at_a - 1] << 32 | b[self.at_b - 1]

    def groups(self) -> str:
        """a1,a2|b1;a3|b2,b3: the ids of each group."""
        out = list(map(_WRITTEN.__getitem__, self.linked.tolist()))
        first_a, first_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (self.at_a, self.at_b))
        for k in np.flatnonzero((self.at_a - first_a > 1) | (self.at_b - first_b > 1)).tolist():
            a, b = self.a[first_a[k] : self.at_a[k]].tolist(), self.b[first_b[k] : self.at_b[k]].tolist()
            out[k] = ",".join(map(str, a)) + "|" + ",".join(map(str, b))
        return ";".join(out)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of ids that is linked, and how often."""
        found, times = np.unique(self.linked, return_counts=True)
        return found >> 32, found & 0xFFFFFFFF, times


def _array(parts: list[tuple[np.ndarray, ...]]) -> pa.Array:
    columns = [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0)]).astype(np.int32)) for k in range(3)]
    offsets = np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["a", "b", "n"]))


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, digest: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, groups, n_a, n_b, n_groups, n_links and pairs (array of a, b, n) of each row.

    byte_vocabulary and piece_model: paths, read on the driver (1.5 and 0.5 MB, sent once to each executor). groups: the
    ids by group, a1,a2|b1;a3|b2,b3; with digest the lowercase hex SHA-256 of it. Either is '' where there are no
    tokens: texts that are null, empty, or that a tokenizer doesn't give back byte by byte. Every row gives one row,
    repeated ones too; a null doc_id stays null; an empty table gives no rows. Other columns go.
    """
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(open(byte_vocabulary, encoding="utf-8").read())
    model = context.broadcast(open(piece_model, "rb").read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers_of(spec.value, model.value)
        for batch in batches:
            groups, counts, parts = [], [], []
            texts = batch.column(1).to_pylist()
            # One tokenizer after the other, not by turns: the tables of one push those of the other out of the processor's cache.
            for a, b in zip(*(list(map(tokens, texts)) for tokens in (first, second)), strict=True):
                one = Aligned(a, b, first, second)
                found = one.groups()
                groups.append(hashlib.sha256(found.encode()).hexdigest() if digest and found else found)
                counts.append((len(one.a), len(one.b), len(one.linked), len(one.linked)))
                parts.append(one.pairs())
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string()), *numbers, _array(parts)], ["doc_id", "groups", "n_a", "n_b", "n_groups", "n_links", "pairs"])

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text), rows, f"doc_id long, {_TEXT}", ("token_alignment", "bpe"))


def pair_table(found: DataFrame) -> DataFrame:
    """a, b, links, texts, most_a and most_b of each linked pair of aligned(): its links over all texts, the texts that have it, the largest count of any pair with its a and with its b.

    A task sums up its own pairs before any are sent. An id has at most as many pairs as the other side has ids.
    """
    each = found.select(F.explode("pairs").alias("p")).select("p.*")
    pairs = written(each.groupBy("a", "b").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("texts")), "pairs")
    for side in ("a", "b"):
        pairs = pairs.join(pairs.groupBy(side).agg(F.max("links").alias(f"most_{side}")), side)
    return pairs.select("a", "b", "links", "texts", "most_a", "most_b")


def with_counts(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """found, a written aligned() with a column uid that tells rows apart, with n_best_a, n_best_b and count_sum instead of pairs.

    n_best_b: links whose pair has the largest count of its b, ties included; n_best_a likewise; count_sum: the
    counts of all links. 0 for rows without links.
    """
    one = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)
    each = found.select("uid", F.explode("pairs").alias("p")).select("uid", one("p.a", "p.b").alias("pair"), "p.n")
    total = pairs.agg(F.sum("texts").alias("total"))
    # At most HOT pairs are in more than a HOT-th of all rows of each.
    marks = [(F.col("texts") * HOT > F.col("total")).alias("hot"), (F.col("links") == F.col("most_a")).alias("best_a"), (F.col("links") == F.col("most_b")).alias("best_b")]
    marked = written(pairs.crossJoin(F.broadcast(total)).select(one("a", "b").alias("pair"), "links", *marks), "marked")
    hot, cold = marked.where("hot"), marked.where("not hot")
    times = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    sums: list[Column] = [times("best_a").alias("n_best_a"), times("best_b").alias("n_best_b"), F.sum(F.col("n") * F.col("links")).alias("count_sum")]
    # Each task sums up the rows of a text as they come: one is sent.
    counted = each.join(F.broadcast(hot), "pair").groupBy("uid").agg(*sums)
    if cold.limit(1).count():
        left = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(small(cold), "pair")
        counted = counted.unionByName(left.groupBy("uid").agg(*sums)).groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("n_best_a", "n_best_b", "count_sum")))
    out = found.drop("pairs").join(counted, "uid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best_a", "n_best_b", "count_sum")})


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, digest: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """aligned() with the counts of with_counts(): one row for each row of docs."""
    with scratch(docs.sparkSession):
        found = aligned(docs, byte_vocabulary, piece_model, digest, text, doc_id)
        found = written(found.withColumn("uid", F.monotonically_increasing_id()), "aligned")
        return kept(with_counts(found, pair_table(found)).drop("uid"), "alignment")


def alignment_digests(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """op12's columns from align()."""
    out = align(docs, byte_vocabulary, piece_model, digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("n_best_b").alias("n_best"), "count_sum", F.col("groups").alias("groups_sha256"))
