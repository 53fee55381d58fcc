import fnmatch
import random

import pytest

from parlance.operators import patterns

SCHEMA = "file string, utt_idx long, speaker string, cw array<string>"


def test_words_against_each_pattern():
    rnd = random.Random(1)
    globs = sorted({"".join(rnd.choices("ab*c", k=rnd.randint(1, 6))) for _ in range(400)} | {"*", "**", "a**b"})
    match = patterns.WordAutomaton(globs)
    for word in ["", "a", *("".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(500))]:
        assert match(word) == tuple(k for k, g in enumerate(globs) if fnmatch.fnmatchcase(word, g)), word


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(patterns, "KEPT", 5)
    match = patterns.WordAutomaton(["a*", "*b", "ab"])
    assert [match(w) for w in ["ab", "aa", "bb", "c", "ab", "xb", "a", "ab"] * 3] == [(0, 1, 2), (0,), (1,), (), (0, 1, 2), (1,), (0,), (0, 1, 2)] * 3


def plain(words, groups, any_order, exclusive):
    """Each group tried at each place."""
    fits = lambda g, k, w: fnmatch.fnmatchcase(w.lower(), g[k])
    out = []
    if exclusive:
        at = 0
        while at < len(words):
            hits = [(len(g), -n) for n, g in enumerate(groups) if at + len(g) <= len(words) and all(fits(g, k, words[at + k]) for k in range(len(g)))]
            if hits:
                size, n = max(hits)
                out.append((-n, tuple(range(at, at + size))))
            at += max(hits)[0] if hits else 1
        return out
    for n, g in enumerate(groups):
        if any_order:
            places = [None] * len(g)
            for at, w in enumerate(words):
                k = next((k for k in range(len(g)) if places[k] is None and fits(g, k, w)), None)
                if k is not None:
                    places[k] = at
                if None not in places:
                    out.append((n, tuple(places)))
                    places = [None] * len(g)
        else:
            at = 0
            while at + len(g) <= len(words):
                if all(fits(g, k, words[at + k]) for k in range(len(g))):
                    out.append((n, tuple(range(at, at + len(g)))))
                    at += len(g)
                else:
                    at += 1
    return out


@pytest.mark.parametrize(("any_order", "exclusive"), [(False, False), (False, True), (True, False)])
def test_groups_against_a_search(any_order, exclusive):
    rnd = random.Random(2)
    for _ in range(200):
        groups = [[rnd.choice(["a", "b", "a*", "*b", "*", "ab", "c"]) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 12))]
        words = ["".join(rnd.choices("abC", k=rnd.randint(1, 2))) for _ in range(rnd.randint(0, 14))]
        found = patterns.Groups(groups)
        got = list(found.any_order(words) if any_order else found.in_order(words, exclusive))
        assert sorted(got) == sorted(plain(words, groups, any_order, exclusive))


def test_counts(spark):
    turns = spark.createDataFrame([("f", 1, "A", ["The", "big", "dog", "the", "dog"]), ("f", 2, "A", ["the", "dog"]), ("f", 3, "B", []), ("f", 4, None, ["dog", "the"]), ("f", 5, "B", None)], SCHEMA)
    rows = lambda df: sorted(tuple(r) for r in df.collect() if r.speaker)
    assert rows(patterns.group_counts(turns, ["the  dog", "the *", "zebra x"])) == [("A", "the *", 3), ("A", "the dog", 2)]
    assert rows(patterns.group_counts(turns, ["the dog"], sole=True)) == [("A", "the dog", 1)]
    assert rows(patterns.group_counts(turns, ["the *"], show=True)) == [("A", "the *", "the big", 1), ("A", "the *", "the dog", 2)]
    assert patterns.group_counts(turns, ["the dog"], any_order=True).where("speaker is null").first()["count"] == 1
    assert rows(patterns.group_counts(turns, ["The big"], case_sensitive=True)) == [("A", "The big", 1)]
    assert rows(patterns.group_counts(turns, ["the", "the big", "big dog"], exclusive=True)) == [("A", "the", 2), ("A", "the big", 1)]
    assert ("A", "the dog", 2) in rows(patterns.frequency_with_groups(turns, ["the dog"])) and ("A", "the", 3) in rows(patterns.frequency_with_groups(turns, ["the dog"]))
    assert patterns.group_counts(turns.limit(0), ["a b"]).count() == 0
    with pytest.raises(ValueError, match="without a word"):
        patterns.group_counts(turns, ["a", " "])


def test_ten_thousand_patterns(spark):
    turns = spark.createDataFrame([("f", k, "A", [f"w{k}x{j}" for j in range(10)]) for k in range(200)], SCHEMA)
    globs = [f"w{k}x*" for k in range(5000)] + [f"*x{k}" for k in range(5000)]
    found = {r.pattern: r["count"] for r in patterns.pattern_counts(turns, globs).collect()}
    assert found == {f"w{k}x*": 10 for k in range(200)} | {f"*x{j}": 200 for j in range(10)}
