"""Token counts by a longest-match automaton.

Greedy word-piece segmentation takes the longest piece at each place of a word. The automaton is a
trie of the pieces with failure links; each link carries how many pieces are complete when it is
followed, found once when the trie is built. A word is read once, character by character, and the
counts along the followed links add up to its number of pieces; no piece is ever cut out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import pretokens
from parlance.llm.common import mapped, ready

#: Words: runs of letters and digits; any other visible character alone.
WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")
STORE = 400_000
STORED_CHARS = 48


class LongestMatch:
    """Counts greedy longest-match pieces of words.

    first: pieces that can start a word; later: pieces that can stand behind another one.
    A word that can't be cut into pieces counts as one unknown token.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str]) -> None:
        # Node 0 starts words, node 1 continues them. Parallel lists instead of objects keep it small.
        self._next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    step = self._next[at].get(c)
                    if step is None:
                        step = self._next[at][c] = len(self._next)
                        self._next.append({})
                        ends.append(False)
                    at = step
                if at != root:
                    ends[at] = True
        self._fail = [-1] * len(self._next)
        self._popped = [0] * len(self._next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self._next[parent].items():
                if ends[node]:
                    self._fail[node], self._popped[node] = 1, 1
                else:
                    count, back = self._popped[parent], self._fail[parent]
                    while back >= 0 and c not in self._next[back]:
                        count += self._popped[back]
                        back = self._fail[back]
                    if back >= 0:
                        self._fail[node], self._popped[node] = self._next[back][c], count
                queue.append(node)

    def count(self, word: str) -> int:
        """Pieces of word; -1 if it can't be cut into pieces, 0 if it is empty."""
        if not word:
            return 0
        step, fail, popped = self._next, self._fail, self._popped
        node, count = 0, 0
        for c in word:
            while c not in step[node]:
                if fail[node] < 0:
                    return -1
                count += popped[node]
                node = fail[node]
            node = step[node][c]
        while node != 1:
            if fail[node] < 0:
                return -1
            count += popped[node]
            node = fail[node]
        return count


def pieces_of(spec: str) -> tuple[set[str], set[str]]:
    """Word-starting and continuing pieces of a byte-level BPE vocabulary: its tokens with and without a leading space."""
    space = pretokens.ALPHABET[0x20]
    vocab = json.loads(spec)["model"]["vocab"]
    return {t[1:] for t in vocab if t.startswith(space) and len(t) > 1}, {t for t in vocab if not t.startswith(space)}


class _Counts(dict):
    def __init__(self, automaton: LongestMatch) -> None:
        self._automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self._automaton.count(pretokens.spelled(word))
        if len(word) <= STORED_CHARS:
            self[word] = n
        return n


def counts_of(spec: str) -> _Counts:
    return ready("token_counts", hashlib.sha256(spec.encode()).hexdigest(), lambda: _Counts(LongestMatch(*pieces_of(spec))))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of each text.

    A word that can't be cut into pieces counts as one token and as unknown. A null or empty text has
    no words. Every row gives one row; a null doc_id stays null. vocabulary: path of a tokenizers
    JSON file with a byte-level BPE model, read on the driver and sent once to each executor.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_of(spec.value)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                if len(known) > STORE:
                    known.clear()
                counts = list(map(known.__getitem__, WORDS.findall(text or "")))
                lost = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(narrow, rows, "doc_id long, n_words long, n_tokens long, n_unknown long", ("token_counts",))
