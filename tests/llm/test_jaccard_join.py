import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import jaccard_join as jj
from parlance.llm.components import components


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def shingle_set(text, words):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w[k : k + min(words, len(w))]) for k in range(len(w) - min(words, len(w)) + 1)} if w else set()


def near_copies(rnd, n_base, n_copies, length):
    out = []
    for _ in range(n_base):
        base = ["w%d" % rnd.randrange(500) for _ in range(rnd.choice(length))]
        for _ in range(rnd.randint(1, n_copies)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = "x%d" % rnd.randrange(10**6)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_signatures_agree_for_all_links(percent):
    rnd = np.random.default_rng(percent)
    sig = jj.Signatures(percent)
    for n in [*range(3, 40), 60, 100, 150, 333, 800]:
        for _ in range(12):
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            # the largest change that still links: leave some out, put others in
            most = int(len(a) * (100 - percent) / 100)
            out = int(rnd.integers(0, most + 1))
            b = np.unique(np.concatenate([a[rnd.permutation(len(a))[out:]], rnd.integers(0, 1 << 63, int(rnd.integers(0, most + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(a) != common and 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(sig(a)[0], sig(b)[0])) >= jj.AGREE


def test_frequent_keys_can_be_spared():
    """Whatever keys are frequent, a set with no more of them than it can spare has AGREE others in common with what it links with."""
    rnd = np.random.default_rng(9)
    sig = jj.Signatures(80)
    for _ in range(400):
        n = int(rnd.integers(12, 300))
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        most = int(len(a) * 0.1)
        b = np.unique(np.concatenate([a[most:], rnd.integers(0, 1 << 63, most, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        (ka, spare), (kb, _) = sig(a), sig(b)
        both = np.intersect1d(ka, kb)
        for side in (0, 1):
            # the worst case: the frequent ones are among those in common
            shared = both[(both & np.uint64(1)) == side]
            if len(shared) and spare[side] >= 0:
                g = max(sig.size_class(len(a)), sig.size_class(len(b)))
                if g & 1 == side:
                    assert len(shared) - spare[side] >= jj.AGREE


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_spare_keys_by_their_own_size(percent):
    """Sets of all sizes of a group have frequent keys to spare and filled parts enough, and what they spare is right for the smallest and the largest sets they link with."""
    rnd = np.random.default_rng(percent)
    sig = jj.Signatures(percent)
    for n in range(120, 900, 13):
        a = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        keys, spare = sig(a)
        assert min(spare) >= 1 and not (keys & np.uint64(2)).any(), n
        smaller = np.sort(a[rnd.permutation(n)[: -(-percent * n // 100)]])
        larger = np.unique(np.concatenate([a, rnd.integers(0, 1 << 64, n * 100 // percent - n, dtype=np.uint64)]))
        for b in (smaller, larger):
            both = np.intersect1d(keys, sig(b)[0])
            side = max(sig.size_class(n), sig.size_class(len(b))) & 1
            for can in (spare, sig(b)[1]):
                assert ((both & np.uint64(1)) == side).sum() - can[side] >= jj.AGREE


def test_a_shared_line_leads_to_no_other_set(spark, monkeypatch):
    """Texts that share a line of a tenth of their words, the smallest of their size class: they have frequent signatures, but none more than it can spare."""
    monkeypatch.setattr(jj, "FEW", 3)
    rnd = random.Random(23)
    sig = jj.Signatures(80)
    first = next(n for n in range(400, 800) if sig.size_class(n) > sig.size_class(n - 1))
    line = ["line%d" % k for k in range(40)]
    texts = []
    for k in range(120):
        own = ["w%d" % rnd.randrange(10**7) for _ in range(first - 36 + k % 8)]
        texts.append(" ".join(own[:100] + line + own[100:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3).selectExpr("uid", "uid as doc_id", "text")
    signed = jj.mapped(docs, jj._signed(5, 80), "key long, uid long, more binary").repartition(4, "key").sortWithinPartitions("key")
    met = jj.mapped(signed, jj._met, jj._MET).cache()
    assert met.where(F.col("what") == jj._FREQUENT).count()
    assert not jj._candidates(met)[1].count()


def test_stars_of_near_copies_are_few(spark):
    """Sets with many frequent keys, of different first bearers: an edge for each set and one for each of those, and all hang together."""
    met = [(jj._DOCUMENT, uid, None, uid, 99, 9, 0, 0, b"x") for uid in range(200)]
    met += [(jj._FREQUENT, uid, key * 4, None, None, None, None, None, None) for uid in range(200) for key in range(30) if uid >= key]
    pairs, stars = jj._candidates(spark.createDataFrame(met, jj._MET))
    edges = [tuple(r) for r in stars.collect()]
    assert len({a for a, _ in edges}) == 200 and sum(a != b for a, b in edges) <= 200 + 60
    assert {tuple(r) for r in components(stars).collect()} == {(uid, 0) for uid in range(200)}


def test_merge_skip():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(30), rnd.randint(0, 12))) for _ in range(rnd.randint(1, 8))]
        need = rnd.randint(1, 5)
        want = [(d, c) for d in range(30) if (c := sum(d in x for x in lists)) >= need]
        assert jj.merge_skip(lists, need) == want


@pytest.mark.parametrize("percent", [80, 90])
def test_search_connects_what_all_pairs_connect(percent):
    rnd = random.Random(percent)
    for trial in range(12):
        make = jj.Shingles(3)
        sets = sorted((make(t) for t in near_copies(rnd, 4, 25, [5, 12, 40, 90])), key=len)
        sets = [s for k, s in enumerate(sets) if not any(np.array_equal(s, x) for x in sets[:k])]
        want = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= percent * (len(sets[a]) + len(sets[b]) - c)]
        got = jj.search_block(sets, percent)
        assert {(min(x), max(x)) for x in got} <= set(want)
        assert roots(len(sets), got) == roots(len(sets), want), trial


def expected(rows, words, percent):
    """doc_id, set size and component_id of each row (doc_id, text), from all pairs."""
    sets = [shingle_set(t, words) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), d) if x is not None), default=None)
    return sorted(((d, len(sets[k]), least[root[k]]) for k, (d, _) in enumerate(rows)), key=str), len(set(root))


def found(docs, words, percent):
    return sorted(map(tuple, jj.link_table(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_table_against_all_pairs(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jj, "CHUNK_DOCS", 9)  # several chunks for the larger blocks
    monkeypatch.setattr(jj, "PIVOTS", 2)
    monkeypatch.setattr(jj, "COMMON_DOCS", 3)
    rnd = random.Random(words)
    texts = near_copies(rnd, 25, 14, [2, 3, 8, 30, 70, 200]) + [None, "", " \n\t", "a", "A", "a b", "É x y z", "é x y z"] + ["same text in many rows " * 9] * 40
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)] + [(5, "lone row of this kind"), (5, "lone row of this kind"), (None, texts[0])]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, uid string").repartition(5)
    want, n_kept = expected(rows, words, percent)
    assert found(docs, words, percent) == want
    kept = jj.without_near_duplicates(docs, words, percent)
    assert kept.columns == docs.columns and kept.count() == n_kept
    assert jj.link_table(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_groups_against_all_pairs(spark, monkeypatch, broadcast):
    """Groups of many chunks: near copies, chains of them, and texts most of which is one passage; doc_ids null or the same."""
    monkeypatch.setattr(jj, "CHUNK_DOCS", 12)
    monkeypatch.setattr(jj, "PIVOTS", 2)
    monkeypatch.setattr(jj, "COMMON_DOCS", 3)
    if not broadcast:
        monkeypatch.setattr(jj, "BROADCAST_UNITS", 0)
    rnd = random.Random(17)
    word = lambda: "w%d" % rnd.randrange(10**6)
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(60):  # each near the base, not all near each other
        copy = list(base)
        for k in rnd.sample(range(100), rnd.choice([1, 1, 2])):
            copy[k] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(80)]
    for k in range(70):  # each near the next ones only
        chain = chain[1:] + [word()]
        texts.append(" ".join(chain))
    passage = [word() for _ in range(90)]
    texts += [" ".join([word() for _ in range(rnd.randint(2, 14))] + passage + [word() for _ in range(rnd.randint(2, 14))]) for _ in range(80)]
    ends = [word() for _ in range(14)]
    texts += [" ".join([*passage, *ends[:k], word(), *ends[k + 1 :]]) for k in range(0, 14, 2)]
    rows = [(rnd.choice([None, 7, k]), t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for words, percent in ((5, 80), (3, 90)):
        assert found(docs, words, percent) == expected(rows, words, percent)[0]


def test_prefixes_meet():
    rnd = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(400):
            a = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1, 80)), dtype=np.uint64))
            b = np.unique(np.concatenate([a[rnd.permutation(len(a))[int(rnd.integers(0, len(a) // 5 + 1)) :]], rnd.integers(0, 1 << 63, int(rnd.integers(0, 9)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            common = rnd.permutation(np.concatenate([a, b]))[:30]
            common = np.array(list(dict.fromkeys(common.tolist())), np.uint64)
            small, large = sorted((a, b), key=len)
            first, enough = jj.prefixes(small, common, percent)
            assert len(np.intersect1d(first[:enough], jj.prefixes(large, common, percent)[0]))


def test_components(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    clean = [x for x in links if None not in x and x[0] != x[1]]
    root = roots(200, clean)
    assert found == {k: root[k] for x in clean for k in x}


def test_sets_with_and_without_empty_parts_meet_by_frequent_keys(spark):
    """Of two that link one sends its empty parts and the other doesn't; all but two of the keys in common are frequent."""
    make, sign = jj.Shingles(5), jj.Signatures(80)
    found = None
    for k in range(3000):
        words = ["w%d" % (k * 100 + i) for i in range(12)]
        texts = [" ".join(words), " ".join(words[:11])]
        sets = [make(t) for t in texts]
        g = max(sign.size_class(len(x)) for x in sets)
        differ, parts = sign._split(g)
        filled = [len(np.unique((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32))) for x in sets]
        both = np.intersect1d(sign(sets[0])[0], sign(sets[1])[0])
        both = both[both & np.uint64(1) == g & 1]
        if min(filled) < differ + jj.AGREE <= max(filled) and 2 < len(both) - 1 <= parts - differ - jj.AGREE:
            found = texts, both[2:].view(np.int64).tolist()
            break
    assert found
    texts, frequent = found
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array(texts)], ["uid", "doc_id", "text"])
    documents = [b for b in jj._signed(5, 80)(iter([batch])) if b.column(2).null_count == 0]
    met = [tuple(r.values()) for b in jj._met(iter(documents)) for r in b.to_pylist()]
    met += [(jj._FREQUENT, uid, key, None, None, None, None, None, None) for uid in (1, 2) for key in frequent]
    pairs, stars = jj._candidates(spark.createDataFrame(met, jj._MET))
    assert {tuple(sorted(r)) for r in pairs.unionByName(stars).where("a != b").collect()} == {(1, 2)}


def test_a_task_holds_a_chunk_and_bounded_pivots(spark, monkeypatch):
    """Near copies of long texts: what a unit is searched with stays within the bounds, and the result is that of all pairs, with few pivots or none."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(5000)}" for _ in range(600)]
    texts = []
    for k in range(64):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = f"own{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows, 5, 80)[0]
    held = []
    search = jj._search

    def watched(narrow, units, words, percent):
        units = units.cache()
        held.append(units.groupBy("block", "kind", "i", "j").agg(F.sum("n").alias("n"), F.max("n").alias("largest")).collect())
        return search(narrow, units, words, percent)

    monkeypatch.setattr(jj, "_search", watched)
    monkeypatch.setattr(jj, "CHUNK_SHINGLES", 6000)
    for bound in (3000, 100):
        monkeypatch.setattr(jj, "PIVOT_SHINGLES", bound)
        held.clear()
        assert found(docs, 5, 80) == want
        # Sets are dealt out by a hash, so a chunk may have some more than its share.
        assert len(held[0]) > 4 and all(r.n <= 2 * 6000 + bound + r.largest for r in held[0])
