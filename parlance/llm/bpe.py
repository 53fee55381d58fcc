"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one token that ends its encoding. An automaton over the
vocabulary reports the tokens that end at a position, longest first; a token is the last one of
the prefix if it can stand behind the last token of the prefix it leaves over. Whether two tokens
can stand side by side is read from the merges along the touching edges of the two. Following the
stored tokens back from the end gives exactly the ids that repeated merging gives, in time linear
in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import pretokens
from parlance.llm.common import mapped, own_name, ready

#: Words held ready with their ids in a worker; when full, the store starts anew.
STORE = 300_000
#: Longer words are encoded each time they come.
STORED_CHARS = 48
_LAST = 1 << 62


def _refuse_unsupported(doc: dict) -> None:
    """An error for a tokenizer that does something else than this module: it would be encoded wrongly without a word."""
    model, before = doc["model"], doc.get("pre_tokenizer") or {}
    wrong = [
        ("model", model.get("type", "BPE") != "BPE"),
        ("normalizer", doc.get("normalizer") is not None),
        ("pre_tokenizer", before.get("type") != "ByteLevel" or before.get("add_prefix_space", False) or not before.get("use_regex", True)),
        ("decoder", (doc.get("decoder") or {}).get("type") != "ByteLevel"),
        *((name, bool(model.get(name))) for name in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")),
        *((f"added token {t['content']!r}: {name}", True) for t in doc["added_tokens"] for name in ("lstrip", "rstrip", "single_word") if t.get(name)),
    ]
    found = [name for name, is_wrong in wrong if is_wrong]
    if found:
        raise ValueError(f"not supported in this tokenizer: {', '.join(found)}")


class Encoder:
    """Encodes and decodes text with a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: str) -> None:
        doc = json.loads(spec)
        _refuse_unsupported(doc)
        self.ids: dict[str, int] = doc["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(doc["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[left], self.ids[right]
            self.rank[a, b] = k
            parts[self.ids[left + right]] = (a, b, k)
        if len(parts) != len(self.rank):
            raise ValueError("two merges give the same token: its parts are not known from its id")
        # The tokens along an edge, outermost first, each with the rank of the merge that takes it up.
        self._right = {t: self._edge(t, 1, parts) for t in self.ids.values()}
        self._left = {t: self._edge(t, 0, parts) for t in self.ids.values()}
        self._beside: dict[int, bool] = {}
        sound: dict[int, bool] = {}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self._bytes = [b""] * size
        self._length = [0] * size
        self._digits = [str(i) for i in range(size)]
        for text, t in self.added.items():
            self._bytes[t] = text.encode()
        found = ahocorasick.Automaton()
        for text, t in sorted(self.ids.items(), key=lambda x: parts.get(x[1], (0, 0, -1))[2]):
            if t in parts:
                a, b, k = parts[t]
                sound[t] = sound[a] and sound[b] and not self._crossed(a, b, k)
            else:
                sound[t] = True
            self._bytes[t] = bytes(map(pretokens.BYTE_OF.__getitem__, text))
            self._length[t] = len(text)
            if sound[t]:
                found.add_word(text, t)
        found.make_automaton()
        self._found = found
        self._store = _Store(self)

    @staticmethod
    def _edge(token: int, side: int, parts: dict[int, tuple[int, int, int]]) -> tuple[tuple[int, int], ...]:
        edge, taken = [(token, _LAST)], token
        while taken in parts:
            rank = parts[taken][2]
            taken = parts[taken][side]
            edge.append((taken, rank))
        return tuple(edge)

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge over the border of a and b comes before both sides are built, and before that rank."""
        rank = self.rank.get
        for x, taken_x in self._right[a]:
            for y, taken_y in self._left[b]:
                r = rank((x, y))
                # At equal rank the leftmost merge goes first.
                if r is not None and r < before and r < taken_x and r <= taken_y:
                    return True
        return False

    def beside(self, a: int, b: int) -> bool:
        """Whether b can follow a in an encoding."""
        key = a << 20 | b
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) >= 1_000_000:
                self._beside.clear()
            known = self._beside[key] = not self._crossed(a, b, _LAST)
        return known

    def word(self, spelled: str) -> tuple[int, ...]:
        """The ids of one word, given in the alphabet of bytes."""
        whole = self.ids.get(spelled)
        last = [-1] * (len(spelled) + 1)
        length, beside = self._length, self.beside
        for end, token in self._found.iter(spelled):
            if last[end + 1] < 0:
                start = end + 1 - length[token]
                if start == 0 or (last[start] >= 0 and beside(last[start], token)):
                    last[end + 1] = token
        if whole is not None and last[-1] == whole:
            return (whole,)
        out, at = [], len(spelled)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"no encoding of {spelled[:at]!r}")
            out.append(token)
            at -= length[token]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """The ids of text. Strings of added tokens stand for those tokens."""
        if self._cut is None or not any(x in text for x in self.added):
            return self._plain(text)
        out: list[int] = []
        for part in self._cut.split(text):
            out += [self.added[part]] if part in self.added else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if len(self._store) > STORE:
            self._store.clear()
        return list(chain.from_iterable(map(self._store.__getitem__, pretokens.split(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    def written(self, ids: Iterable[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self._digits.__getitem__, ids))


class _Store(dict):
    def __init__(self, encoder: Encoder) -> None:
        self._encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self._encoder.word(pretokens.spelled(word))
        if len(word) <= STORED_CHARS:
            self[word] = ids
        return ids


def encoder_of(spec: str) -> Encoder:
    """The encoder of a vocabulary, built once per worker."""
    return ready("bpe", hashlib.sha256(spec.encode()).hexdigest(), lambda: Encoder(spec))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of each text as array<int>, and with decoded the text that the ids give back.

    vocabulary: path of a tokenizers JSON file with a byte-level BPE model, read on the driver (about
    1.5 MB, sent once to each executor). A null text counts as empty: no ids. Every row gives one
    row; other columns stay, and underscores tell the new ones' names from theirs.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    ids, decoded = own_name(docs, ids), decoded and own_name(docs, decoded)
    at = docs.columns.index(text)
    more_fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*docs.schema.fields, *more_fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        for batch in batches:
            found = [encoder.encode(x or "") for x in batch.column(at).to_pylist()]
            more = [pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                more.append(pa.array([encoder.decode(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, ids, *([decoded] if decoded else [])])

    return mapped(docs, rows, schema, ("bpe",))


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, without moving the ids back to the JVM.

    The digests are of the decimal ids joined by commas and of the text that decoding the ids gives.
    A null text counts as empty, a null doc_id stays null, repeated rows give repeated rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value)
        sha = hashlib.sha256
        for batch in batches:
            counts, coded, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                counts.append(len(ids))
                coded.append(sha(encoder.written(ids).encode()).hexdigest())
                back.append(sha(encoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(narrow, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ("bpe",))
