"""Filters of turns, applied in the order range, length, speaker, gem, word, id, role; all must hold.

utt_idx is a column of the data, so filtering by it counts turns as they were before any filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.morphology import traced_morphemes
from parlance.functions.words import capitalised, like_pattern, matches_any


def in_range(turns: DataFrame, first: int, last: int) -> DataFrame:
    """Turns first to last of each file, both included, from 1."""
    if first < 1 or last < first:
        raise ValueError(f"no range: {first}-{last}")
    return turns.where(F.col("utt_idx").between(first, last))


_LENGTH = re.compile(r"\s*([<>=])\s*(\d+)\s*([wcm])\s*")


def of_length(turns: DataFrame, bound: str, left_out: list[str] = ()) -> DataFrame:
    """bound: <, > or =, a number, and w for words, c for characters or m for morphemes; left_out: patterns of words that aren't counted."""
    if not (m := _LENGTH.fullmatch(bound)):
        raise ValueError(f"no length: {bound!r}")
    words = F.filter("cw", lambda w: ~matches_any(w, list(left_out))) if left_out else F.col("cw")
    if m[3] == "w":
        n = F.size(words).cast("long")
    elif m[3] == "c":
        n = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))
    else:
        n = F.coalesce(traced_morphemes("mor"), F.lit(0))
    k = int(m[2])
    return turns.where({"<": n < k, ">": n > k, "=": n == k}[m[1]])


def of_speakers(turns: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Speakers by their exact code."""
    if include:
        turns = turns.where(F.col("speaker").isin(*include))
    return turns.where(~F.col("speaker").isin(*exclude)) if exclude else turns


def in_gems(turns: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Turns with an active gem of such a label, whatever its case; without any of the excluded ones."""
    active = lambda labels: F.coalesce(F.exists("active_gems", lambda g: F.lower(g).isin(*(x.lower() for x in labels))), F.lit(False))
    if include:
        turns = turns.where(active(include))
    return turns.where(~active(exclude)) if exclude else turns


def with_words(turns: DataFrame, include: list[str] = (), exclude: list[str] = (), case_sensitive: bool = False) -> DataFrame:
    """Turns where a counted word matches an included pattern and none an excluded one."""
    some = lambda globs: F.exists("cw", lambda w: matches_any(w, list(globs), case_sensitive))
    if include:
        turns = turns.where(some(include))
    return turns.where(~some(exclude)) if exclude else turns


def with_id(turns: DataFrame, ids: DataFrame, pattern: str) -> DataFrame:
    """Speakers one of whose @ID rows matches a pattern with *; those without a row never do; an empty pattern lets all pass."""
    if not pattern:
        return turns
    low = F.lower("id_raw")
    fits = low.like(like_pattern(pattern.lower())) if "*" in pattern else low == pattern.lower()
    return turns.join(ids.where(fits).select("file", "speaker").distinct(), ["file", "speaker"], "left_semi")


def with_role(turns: DataFrame, ids: DataFrame, roles: list[str]) -> DataFrame:
    """Speakers of such a role, whatever its case; those without an @ID row pass."""
    first = ids.groupBy("file", "speaker").agg(F.min_by("role", "line_no").alias("role") if "line_no" in ids.columns else F.min("role").alias("role"))
    others = first.where(~F.lower("role").isin(*(r.lower() for r in roles))).select("file", "speaker")
    return turns.join(others, ["file", "speaker"], "left_anti")


def without_solo(turns: DataFrame, words: list[str]) -> DataFrame:
    """Without turns that say nothing but such words."""
    return turns.where(~((F.size("cw") > 0) & F.forall("cw", lambda w: F.lower(w).isin(*(x.lower() for x in words)))))


def with_countable(turns: DataFrame) -> DataFrame:
    return turns.where(F.size("cw") > 0)


def capital_words(words: Column, place: str) -> Column:
    return F.filter(words, lambda w: capitalised(w, place))


@dataclass
class Filters:
    """All filters together; apply() puts them in their order."""

    range: tuple[int, int] | None = None
    length: str | None = None
    length_left_out: list[str] = field(default_factory=list)
    speakers: list[str] = field(default_factory=list)
    not_speakers: list[str] = field(default_factory=list)
    gems: list[str] = field(default_factory=list)
    not_gems: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    not_words: list[str] = field(default_factory=list)
    case_sensitive: bool = False
    id_pattern: str = ""
    roles: list[str] = field(default_factory=list)

    def apply(self, turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        if self.range:
            turns = in_range(turns, *self.range)
        if self.length:
            turns = of_length(turns, self.length, self.length_left_out)
        turns = of_speakers(turns, self.speakers, self.not_speakers)
        turns = in_gems(turns, self.gems, self.not_gems)
        turns = with_words(turns, self.words, self.not_words, self.case_sensitive)
        if self.id_pattern or self.roles:
            if ids is None:
                raise ValueError("filters by id or role need the table of ids")
            turns = with_id(turns, ids, self.id_pattern)
            turns = with_role(turns, ids, self.roles) if self.roles else turns
        return turns
