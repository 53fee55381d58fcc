"""Functions of words: what counts as one, its forms and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of words that don't count, and the marks of overlaps.
NOT_COUNTED = ("omission", "filler", "nonword", "fragment")
OVERLAPS = "⌈⌉⌊⌋"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row, however often then uses it: a lambda over an array of one element."""
    return F.transform(F.array(value), then)[0]


def split_words(text: Column | str) -> Column:
    """Words of plain text: cut at white space, without punctuation at their edges."""
    return F.filter(F.transform(F.split(col(text), r"\s+"), lambda x: F.regexp_replace(x, _EDGES, "")), lambda x: x != "")


def countable(words: Column | str, retraced: bool = False, originals: bool = False, restored: tuple[str, ...] = ()) -> Column:
    """Cleaned words that count. retraced: those in retraces too; originals: what was said instead of its replacement."""
    shown = lambda w: w["untranscribed"].isNull() | w["untranscribed"].isin(*restored) if restored else w["untranscribed"].isNull()
    kept = lambda w: (
        shown(w)
        & ~F.coalesce(w["category"].isin(*NOT_COUNTED), F.lit(False))
        & (w["cleaned"] != "")
        & (F.lit(retraced) | ~w["in_retrace"])
        & ~(w["replacement"] if originals else w["replaced"])
    )
    return F.transform(F.filter(col(words), kept), lambda w: w["cleaned"])


def folded(words: Column | str, case_sensitive: bool = False) -> Column:
    return col(words) if case_sensitive else F.transform(col(words), F.lower)


def display(word: Column | str, case_sensitive: bool = True) -> Column:
    """Raw form without overlap marks."""
    bare = F.translate(col(word), OVERLAPS, "")
    return bare if case_sensitive else F.lower(bare)


def parentheses(word: Column | str, mode: int = 1) -> Column:
    """being(g): 1 takes the brackets away, 2 leaves all, 3 takes away what is in them too."""
    word = col(word)
    return {1: F.translate(word, "()", ""), 2: word, 3: F.regexp_replace(word, r"\([^)]*\)", "")}[mode]


def prosody(word: Column | str, keep: bool = False) -> Column:
    """Without the marks of lengthening, blocking and stress, unless they are kept."""
    return col(word) if keep else F.translate(col(word), ":^~", "")


def split_at(word: Column | str, delimiters: str) -> Column:
    """Parts of a word between further delimiters."""
    return F.filter(F.split(F.translate(col(word), delimiters, " " * len(delimiters)), " +"), lambda x: x != "") if delimiters else F.array(col(word))


def reversed_word(word: Column | str) -> Column:
    return F.reverse(col(word))


def length_without(word: Column | str, left_out: str) -> Column:
    """Characters of a word but some: + and ' for the longest words, ' for histograms of lengths."""
    return F.char_length(F.translate(col(word), left_out, "")).cast("long")


def capitalised(word: Column | str, place: str = "initial") -> Column:
    """initial: first character in upper case; mid: any later one."""
    return F.rlike(col(word), F.lit(r"^\p{Lu}" if place == "initial" else r"^.+\p{Lu}"))


def like_pattern(glob: str) -> str:
    """A word pattern with * for any run, as a LIKE pattern."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in glob)


def matches(word: Column | str, glob: str, case_sensitive: bool = False) -> Column:
    """Whether a whole word matches a pattern with *."""
    word, glob = (col(word), glob) if case_sensitive else (F.lower(col(word)), glob.lower())
    return word.like(like_pattern(glob)) if "*" in glob else word == glob


def matches_any(word: Column | str, globs: list[str], case_sensitive: bool = False) -> Column:
    """Whether a word matches one pattern at least; plain words are looked up in a set."""
    word = col(word) if case_sensitive else F.lower(col(word))
    globs = globs if case_sensitive else [g.lower() for g in globs]
    out = F.lit(False)
    if plain := [g for g in globs if "*" not in g]:
        out = word.isin(*plain)
    for g in globs:
        if "*" in g:
            out = out | word.like(like_pattern(g))
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(col(a) / col(b))


def population_sd(values: Column | str) -> Column:
    """Standard deviation over n; null for fewer than two values."""
    return F.when(F.count(col(values)) < 2, F.lit(None).cast("double")).otherwise(F.stddev_pop(col(values)))


def sample_sd(values: Column | str) -> Column:
    """Standard deviation over n - 1; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(col(values)), F.lit(0.0))
