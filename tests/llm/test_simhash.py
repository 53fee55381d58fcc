import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from test_jaccard_join import roots

from parlance.llm import simhash as sh


def plain_fingerprint(text, words=3):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not parts:
        return 0
    n = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[k : k + n]).encode(), 42) for k in range(len(parts) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, words=3, most=3):
    prints = [plain_fingerprint(t, words) for _, t in rows]
    top = roots(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= most])
    least = {}
    for (d, _), r in zip(rows, top, strict=True):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, top, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def groups_of(edges, nodes):
    at = {x: k for k, x in enumerate(nodes)}
    return roots(len(nodes), [(at[u], at[v]) for u, v in edges])


def near_prints(rnd, n, most, centres=12):
    out = set()
    for _ in range(centres):
        at = rnd.getrandbits(64)
        for _ in range(n // centres):
            bits = rnd.sample(range(64), rnd.randint(0, most + 2))
            out.add(at ^ sum(1 << b for b in bits))
            if rnd.random() < 0.3:
                at ^= 1 << rnd.randrange(64)
    return [x - (1 << 64) if x >> 63 else x for x in sorted(out)]


def test_fingerprints():
    rnd = random.Random(1)
    texts = [None, "", " \t", "a", "A b", "É a É", "x\x0by\x1cz"] + [" ".join(rnd.choices(["a", "B", "é", "cc", "日"], k=rnd.randint(1, 60))) for _ in range(80)]
    for text in texts:
        for words in (1, 3):
            assert sh.fingerprint(text, words) == plain_fingerprint(text, words)
    assert sh.fingerprint(" ".join(f"w{k}" for k in range(200_000))) == plain_fingerprint(" ".join(f"w{k}" for k in range(200_000)))


def test_every_link_has_a_start():
    """What differs in few enough bits keeps all budgets from some start on, and meets there under a key that is asked for."""
    rnd = random.Random(2)
    for most in (0, 1, 2, 3, 5, 7):
        ring = sh.Ring(most)
        for _ in range(300):
            different = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, most)))
            starts = [s for s in range(ring.segments) if len(ring.holds(np.array([different], np.uint64), s))]
            assert starts
            x = np.array([rnd.getrandbits(64)], np.uint64)
            asked = {int(ring.key(x ^ np.uint64(c), starts[0], 2)[0]) for c, _ in ring.changes(starts[0] + 1, ring.budget(2))}
            assert int(ring.key(x ^ np.uint64(different), starts[0], 2)[0]) in asked
            assert asked == set(sh._neighbours(ring, ring.key(x, starts[0], 2)).tolist())


@pytest.mark.parametrize(("most", "held"), [(3, 2000), (3, 3), (1, 2000), (5, 4), (0, 2000)])
def test_links_against_all_pairs(spark, monkeypatch, most, held):
    """With a small bound for common chains most go by chains of three."""
    monkeypatch.setattr(sh, "HELD", held)
    monkeypatch.setattr(sh, "PAIRS", 50)
    rnd = random.Random(most)
    nodes = near_prints(rnd, 400, most)
    edges = [(r.u, r.v) for r in sh.links(spark.createDataFrame([(x,) for x in nodes], "n long"), most).collect()]
    assert all(u != v for u, v in edges)
    want = [(a, b) for a, b in combinations(nodes, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most]
    assert groups_of(edges, nodes) == groups_of(want, nodes)
    assert bool(want) == bool(most)


def test_dense_group(spark, monkeypatch):
    """All numbers that differ in twelve bits of one segment: one component, few edges."""
    monkeypatch.setattr(sh, "HELD", 500)
    nodes = [(5 << 40) + k for k in range(1 << 12)]
    edges = sh.links(spark.createDataFrame([(x,) for x in nodes], "n long").repartition(3)).collect()
    assert len(edges) < 12 * len(nodes)
    assert set(groups_of([(r.u, r.v) for r in edges], nodes)) == {0}


def some_rows():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 400))
        rows.append((rnd.randint(0, 10_000), " ".join(words)))
        for _ in range(k % 5):
            words = list(words)
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((rnd.randint(0, 10_000), " ".join(words)))
    return rows + [(None, None), (17, ""), (18, " \n"), (None, rows[0][1]), rows[0], rows[0], (20_000, "A  B"), (20_001, "a b"), (None, "q"), (3, " ".join(f"v{k}" for k in range(100_000)))]


def test_query_against_all_pairs(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    out = [tuple(r) for r in sh.simhash_table(docs).collect()]
    want = plain(rows)
    assert ordered(out) == ordered(want)
    assert len({r[2] for r in want}) < len({r[1] for r in want})
    assert sh.simhash_table(docs.limit(0)).count() == 0


def test_keys_joined_by_shuffle(spark, monkeypatch):
    from parlance.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = some_rows()
    out = [tuple(r) for r in sh.simhash_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert ordered(out) == ordered(plain(rows))


def test_one_row_of_each_component_stays(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    kept = sh.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in plain(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
