"""Functions of morphological tiers: morpheme counts, parts of speech, patterns, relations, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.words import col

# Features that count as a morpheme for utterance length, and for word lengths.
TRACED = ("Plur", "PL", "PAST", "Past", "POSS", "PASTP", "Pastp", "PRESP", "Ger")
TRACED_IN_WORDS = ("PL", "PAST", "Past", "POSS", "PASTP", "Pastp", "PRESP")
# Parts of speech in the order in which they are told apart: class, equal tags, prefixes.
CLASSES = (
    ("noun", ("noun", "propn", "n"), ("n:prop",)),
    ("aux", ("aux", "v:aux"), ()),
    ("verb", ("verb",), ("v",)),
    ("mod", ("mod",), ()),
    ("prep", ("adp", "prep"), ()),
    ("adj", ("adj",), ()),
    ("adv", (), ("adv",)),
    ("conj", ("cconj", "sconj"), ("conj",)),
    ("det", (), ("det",)),
    ("pron", ("pron",), ("pro",)),
)
# What is left out when tokens of a tier are counted.
LEFT_OUT = {"gra": ("PUNCT", "BEGP", "ENDP", "LP"), "mor": ("beg", "end", "cm", "bq", "eq", "bq2", "eq2"), "": (".", "?", "!")}


def all_words(mor: Column | str) -> Column:
    """Main words and clitics of all items, in order."""
    return F.flatten(F.transform(col(mor), lambda i: F.concat(F.array(i["main"]), i["post_clitics"])))


def traced_morphemes(mor: Column | str, traced: tuple[str, ...] = TRACED) -> Column:
    """One for each word, one more if it has a traced feature."""
    marks = F.array(*map(F.lit, traced))
    each = F.transform(all_words(mor), lambda w: F.when(F.arrays_overlap(w["features"], marks), 2).otherwise(1))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def feature_morphemes(mor: Column | str) -> Column:
    """One for each word and one for each of its features."""
    return F.aggregate(all_words(mor), F.lit(0).cast("long"), lambda a, w: a + 1 + F.size(w["features"]))


def rendered(word: Column) -> Column:
    """pos|lemma-feature..."""
    return F.concat(word["pos"], F.lit("|"), F.array_join(F.concat(F.array(word["lemma"]), word["features"]), "-"))


def classify(pos: Column) -> Column:
    """The class of a part of speech, null for none."""
    out = F.lit(None).cast("string")
    for name, equal, prefixes in reversed(CLASSES):
        fits = pos.isin(*equal) if equal else F.lit(False)
        for p in prefixes:
            fits = fits | pos.startswith(p)
        out = F.when(fits, name).otherwise(out)
    return out


def inflections(features: Column) -> dict[str, Column]:
    """Whether features have a plural, past, present participle or past participle (which is a past too)."""
    has = lambda test: F.exists(features, test)
    low = F.lower
    past_participle = has(lambda f: low(f).isin("pastp") | (F.contains(low(f), F.lit("part")) & F.contains(low(f), F.lit("past"))))
    return {
        "plurals": has(lambda f: low(f).isin("plur", "pl")),
        "past": has(lambda f: low(f).isin("past")) | past_participle,
        "present_participle": has(lambda f: low(f).isin("presp", "ger") | (F.contains(low(f), F.lit("part")) & F.contains(low(f), F.lit("pres")))),
        "past_participle": past_participle,
    }


def item_matches(word: Column, pattern: str) -> Column:
    """POS-FEAT: prefix of the part of speech and part of a feature; else one of the two; case doesn't matter."""
    pattern = pattern.strip("|").lower()
    pos, feature = F.lower(word["pos"]), lambda part: F.exists(word["features"], lambda f: F.contains(F.lower(f), F.lit(part)))
    if "-" in pattern:
        head, _, part = pattern.partition("-")
        return pos.startswith(head) & feature(part)
    return pos.startswith(pattern) | feature(pattern)


def any_item_matches(words: Column, pattern: str) -> Column:
    """Whether any of all_words() matches."""
    return F.exists(words, lambda w: item_matches(w, pattern))


def any_pos_starts(words: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(words, lambda w: reduce(lambda a, b: a | b, [w["pos"].startswith(p) for p in prefixes]))


def is_verb(pos: Column) -> Column:
    return F.rlike(pos, F.lit("^(v|verb|cop|aux|mod|part)(:|$)"))


def without_fusion(lemma: Column | str) -> Column:
    return F.substring_index(col(lemma), "&", 1)


def base_relation(relation: Column | str) -> Column:
    """The label before any - or :, in upper case."""
    return F.upper(F.regexp_extract(col(relation), "^[^-:]*", 0))


def code_items(content: Column | str) -> Column:
    """Codes of a coding tier: <...> only selects a word for the next one, and the final stop is none."""
    return F.filter(F.split(F.trim(col(content)), r"\s+"), lambda x: (x != ".") & (x != "") & ~F.rlike(x, F.lit("^<.*>$")))


def tier_tokens(content: Column | str, label: str = "") -> Column:
    """Tokens of a dependent tier, without those that aren't counted."""
    out = F.filter(F.split(F.trim(col(content)), r"\s+"), lambda x: (x != "") & ~x.isin(*LEFT_OUT[""]))
    if label == "gra":
        out = F.filter(out, lambda x: ~F.element_at(F.split(x, r"\|"), -1).isin(*LEFT_OUT["gra"]))
    if label == "mor":
        out = F.filter(out, lambda x: ~F.substring_index(x, "|", 1).isin(*LEFT_OUT["mor"]))
    return out


def phone_bucket(phone: Column | str) -> Column:
    """Order of phones: Latin-1, IPA, a to z, others."""
    code = F.ascii(col(phone))
    return F.when(code.between(0xC0, 0xFF), 0).when(code.between(0x250, 0x2AF), 1).when(code.between(0x61, 0x7A), 2).otherwise(3)
