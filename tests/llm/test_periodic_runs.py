import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest

from parlance.llm import periodic_runs as pr


def plain_runs(words):
    """Every run, by trying each period at each place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_against_every_period():
    rnd = random.Random(3)
    for trial in range(1500):
        words, letters = [], "ab" if trial % 3 else "abcdefgh"
        while len(words) < rnd.randint(0, 150):
            part = [rnd.choice(letters) for _ in range(rnd.randint(1, 12))]
            words += part * rnd.choice([1, 1, 2, 4, 5, 7]) + part[: rnd.randint(0, len(part))]
        assert pr.find_runs(words) == plain_runs(words), words


@pytest.mark.parametrize("words", ["", "a", "aaaaa", "aaaaaa", "ababab", "abababab", "abcabcabcab", "abcabcabcabc", "a" * 300, "aab" * 40 + "a" * 9 + "baa" * 40])
def test_borders(words):
    assert pr.find_runs(list(words)) == plain_runs(list(words))


def test_runs_in_runs():
    inner = list("aaaaaaab")
    words = (inner * 6 + ["x"]) * 5
    assert pr.find_runs(words) == plain_runs(words)
    assert pr.strongest([(0, 8, 2), (3, 12, 3), (5, 4, 1)]) == (0, 8, 2)
    assert pr.strongest([]) is None


def test_collapsed_words():
    words = "x a b a b a b a b y".split()
    assert pr.collapsed(words, pr.find_runs(words)) == "x a b y".split()


def test_long_texts():
    """A million equal words, and a million different ones with a long period in them."""
    start = time.time()
    assert pr.find_runs([b"a"] * 1_000_000) == [(0, 1_000_000, 1)]
    words = [b"%d" % k for k in range(500_000)]
    words += words[:100_003] * 4 + words[:99_991]
    assert pr.find_runs(words) == [(500_000, 500_003, 100_003)]
    # One run for each of many periods.
    words = [w for q in range(1, 300) for w in [b"%d-%d" % (q, k) for k in range(q)] * 4 + [b"x%d" % q]]
    assert [r[2] for r in pr.find_runs(words)] == list(range(2, 300))
    assert time.time() - start < 60


def test_query_against_plain_version(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["the", "a", "in", "été", " ", "A"]) for _ in range(rnd.randint(0, 120)))) for k in range(300)]
    rows += [(k, " ".join(map(str, range(rnd.randint(60, 400))))) for k in range(300, 420)]
    rows += [(None, "a " * 50), (7, None), (7, ""), (7, " \t\n"), (7, "b c " * 9), (7, "b c " * 9), (8, "x\x0by\x0c" * 30), (9, "x y " * 30)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_runs string")
    out = [tuple(r) for r in pr.run_digests(docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((plain_row(*r) for r in rows), key=key)
    assert sorted(out, key=key) == want
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)
    assert pr.run_digests(docs.limit(0)).count() == 0


def test_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([("k", "a b " * 5, 1), ("l", None, 2), ("l", None, 2)], "Runs string, text string, strongest int")
    out = pr.with_runs(docs)
    assert out.columns == ["Runs", "text", "strongest", "runs_", "strongest_", "collapsed"]
    got = sorted((r.Runs, r["runs_"], r["strongest_"], r.collapsed) for r in out.collect() if r.text)
    assert [(r[0], [tuple(x) for x in r[1]], tuple(r[2]), r[3]) for r in got] == [("k", [(0, 10, 2)], (0, 10, 2), "a b")]
    assert [(r["runs_"], r["strongest_"], r.collapsed) for r in out.collect() if not r.text] == [([], None, "")] * 2
