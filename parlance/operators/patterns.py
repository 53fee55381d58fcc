"""Many word patterns and groups of patterns at once: one automaton over all of them, and one pass over the words.

Patterns (with * for any run of characters) share a trie; the sets of its nodes that a word can be in are made
states when they first occur, so a word is read once, however many patterns there are. Groups are sequences of patterns in a
second trie, walked along an utterance. Tasks sum up what they find before it is sent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.operators.frequency import frequency

#: Transitions, and words with their patterns, that a worker keeps; counts that a task holds before it sends them.
KEPT, HELD = 500_000, 200_000


class _Node:
    __slots__ = ("ends", "loops", "next", "star")

    def __init__(self, loops: bool = False) -> None:
        self.next: dict[str, _Node] = {}
        self.star: _Node | None = None
        self.loops = loops
        self.ends: list[int] = []


class WordAutomaton:
    """Which of many patterns a word matches as a whole."""

    def __init__(self, patterns: Iterable[str]) -> None:
        self._root = _Node()
        for number, pattern in enumerate(patterns):
            node = self._root
            for c in pattern:
                if c != "*":
                    node = node.next.setdefault(c, _Node())
                elif not node.loops:
                    node.star = node.star or _Node(loops=True)
                    node = node.star
            node.ends.append(number)
        self._states: list[tuple[_Node, ...]] = []
        self._numbers: dict[frozenset[int], int] = {}
        self._accepted: list[tuple[int, ...]] = []
        self._step: dict[tuple[int, str], int] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._start = self._state([self._root])

    def _state(self, nodes: list[_Node]) -> int:
        every = {id(n): n for n in nodes}
        for n in nodes:
            if n.star:
                every[id(n.star)] = n.star
        key = frozenset(every)
        if key not in self._numbers:
            self._numbers[key] = len(self._states)
            self._states.append(tuple(every.values()))
            self._accepted.append(tuple(sorted(k for n in every.values() for k in n.ends)))
        return self._numbers[key]

    def _next(self, state: int, c: str) -> int:
        nodes = [n.next[c] for n in self._states[state] if c in n.next] + [n for n in self._states[state] if n.loops]
        out = self._step[state, c] = self._state(nodes)
        return out

    def __call__(self, word: str) -> tuple[int, ...]:
        """Numbers of the patterns that match, ascending."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > KEPT or len(self._step) > KEPT:
                self._states, self._accepted = [], []
                for held in (self._numbers, self._step, self._known):
                    held.clear()
                self._start = self._state([self._root])
            state = self._start
            for c in word:
                step = self._step.get((state, c))
                state = self._next(state, c) if step is None else step
            found = self._known[word] = self._accepted[state]
        return found


class _Place:
    __slots__ = ("ends", "next")

    def __init__(self) -> None:
        self.next: dict[int, _Place] = {}
        self.ends: list[int] = []


class Groups:
    """Groups of patterns, each for one word of an utterance; a group of one is a plain pattern."""

    def __init__(self, groups: list[list[str]], case_sensitive: bool = False) -> None:
        self._fold = (lambda w: w) if case_sensitive else str.lower
        self.sizes = [len(g) for g in groups]
        numbers: dict[str, int] = {}
        self._slots: dict[int, list[tuple[int, int]]] = {}
        self._root = _Place()
        for g, group in enumerate(groups):
            place = self._root
            for k, pattern in enumerate(map(self._fold, group)):
                atom = numbers.setdefault(pattern, len(numbers))
                self._slots.setdefault(atom, []).append((g, k))
                place = place.next.setdefault(atom, _Place())
            place.ends.append(g)
        self._words = WordAutomaton(numbers)

    def _atoms(self, words: list[str]) -> list[tuple[int, ...]]:
        return [self._words(self._fold(w)) for w in words]

    def _from(self, atoms: list[tuple[int, ...]], at: int) -> Iterator[tuple[int, int]]:
        """(group, words) of the groups that match from a word on, shorter ones first."""
        places, n = [self._root], 0
        for found in atoms[at:]:
            places = list({id(p.next[a]): p.next[a] for p in places for a in found if a in p.next}.values())
            n += 1
            if not places:
                return
            yield from sorted((g, n) for p in places for g in p.ends)

    def in_order(self, words: list[str], exclusive: bool = False) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Each group's matches from left to right, without overlaps of its own; exclusive: without any, the leftmost and of those the longest, then the first given."""
        atoms, free = self._atoms(words), {}
        at = 0
        while at < len(atoms):
            best = None
            for g, n in self._from(atoms, at) if atoms[at] else ():
                if exclusive:
                    best = (g, n) if best is None or n > best[1] else best
                elif free.get(g, 0) <= at:
                    free[g] = at + n
                    yield g, tuple(range(at, at + n))
            if best:
                yield best[0], tuple(range(at, at + best[1]))
            at += best[1] if best else 1

    def any_order(self, words: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Sets of words that fill all places of a group: each word fills the first free place it fits."""
        filled: dict[int, dict[int, int]] = {}
        for at, atoms in enumerate(self._atoms(words)):
            free: dict[int, int] = {}
            for g, k in (x for a in atoms for x in self._slots[a]):
                if k not in filled.get(g, ()):
                    free[g] = min(k, free.get(g, k))
            for g, k in free.items():
                own = filled.setdefault(g, {})
                own[k] = at
                if len(own) == self.sizes[g]:
                    yield g, tuple(own[k] for k in range(self.sizes[g]))
                    del filled[g]


def group_counts(
    turns: DataFrame, groups: list[str], by: tuple[str, ...] = ("speaker",), any_order: bool = False, sole: bool = False, exclusive: bool = False, show: bool = False, case_sensitive: bool = False, words: str = "cw"
) -> DataFrame:
    """by, group, count: how often the words of utterances match each group of patterns, given as one text with blanks.

    By default a group's patterns match words in a row, each group by itself and without overlaps of its own. any_order: words in any
    order fill the places of the group. sole: the group is the whole utterance. exclusive: a word belongs to one match, the leftmost
    and longest. show: also by what was matched, as matched. Groups without a match have no row; null and empty utterances have none.
    Equal groups count each; groups without a word are refused. The automaton is as large as the patterns, and goes to every executor.
    """
    parsed = [g.split() for g in groups]
    if not all(parsed):
        raise ValueError("a group without a word")
    if any_order and exclusive:
        raise ValueError("exclusive groups are in order")
    names = list(by)
    rows_of = turns.select(*names, words)
    out = rows_of.limit(0).select(*names, F.lit("").alias("group"), *([F.lit("").alias("matched")] if show else []), F.lit(0).cast("long").alias("count")).schema
    arrow = to_arrow_schema(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = Groups(parsed, case_sensitive), Counter()

        def sent() -> pa.RecordBatch:
            held = [(*key, n) for key, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for *key, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not said:
                    continue
                for g, at in automaton.any_order(said) if any_order else automaton.in_order(said, exclusive):
                    if not sole or len(said) == automaton.sizes[g]:
                        shown = (" ".join(said[k] if case_sensitive else said[k].lower() for k in at),) if show else ()
                        counts[(*key, " ".join(parsed[g]), *shown)] += 1
            if len(counts) > HELD:
                yield sent()
        yield sent()

    found = rows_of.mapInArrow(rows, out)
    return found.groupBy(*names, "group", *(["matched"] if show else [])).agg(F.sum("count").alias("count"))


def pattern_counts(turns: DataFrame, patterns: list[str], by: tuple[str, ...] = ("speaker",), case_sensitive: bool = False) -> DataFrame:
    """by, pattern, count: a word counts once for each pattern that it matches. Each different word is looked at once for each group of by."""
    counts = frequency(turns, by, case_sensitive=case_sensitive)
    single = counts.select(*by, F.array("word").alias("cw"), "count")
    schema = single.limit(0).select(*by, F.lit("").alias("pattern"), F.lit(0).cast("long").alias("count")).schema
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = WordAutomaton(patterns if case_sensitive else map(str.lower, patterns))
        for batch in batches:
            found = [(*key, patterns[k], n) for *key, said, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in match(said[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return single.mapInArrow(rows, schema).groupBy(*by, "pattern").agg(F.sum("count").alias("count"))


def frequency_with_groups(turns: DataFrame, groups: list[str], by: tuple[str, ...] = ("speaker",), **more) -> DataFrame:
    """frequency() with the groups' counts among the words': a group's text stands as its word."""
    plain = frequency(turns, by, case_sensitive=more.get("case_sensitive", False))
    return plain.unionByName(group_counts(turns, groups, by, **more).withColumnRenamed("group", "word"))
