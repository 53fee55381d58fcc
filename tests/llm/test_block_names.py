import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import block_names as bn


def expected(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            d = rows[m[3]][0]
            out.append((d, rows[best[3]][0], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def test_against_plain_grouping(spark, monkeypatch):
    monkeypatch.setattr(bn, "BLOCK", 16)
    rnd = random.Random(7)
    base = ["".join(rnd.choices("ab é\n", k=rnd.choice([0, 1, 15, 16, 17, 40, 300, 2000]))) for _ in range(40)]
    texts = [rnd.choice(base) for _ in range(150)] + [re.sub("a", " a", b) for b in base[:20]] + [None, "", " \t\n\x0b\x0c\r", "x y", "xy", "\x1cxy"]
    texts += ["ab" * 8 + "c", "ab" * 8 + "d", "ab" * 16, "ab" * 24] + ["hot text of some length"] * 300
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "abc"), (3, "abc"), (None, "abc"), (None, None)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, UID string").repartition(7)
    got = bn.duplicate_groups(docs).collect()
    want, n_groups = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n_groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_names_are_ranks_and_do_not_depend_on_partitions(spark, block):
    rnd = random.Random(block)
    rows = [(k, "".join(rnd.choices("ab", k=rnd.randint(0, 40)))) for k in range(60)]
    found = []
    for parts in (1, 9):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append({(r.doc_id, r.level, r.name) for r in bn.name_texts(docs, "doc_id", block=block).collect()})
    assert found[0] == found[1]
    by_level = {}
    for _, level, name in found[0]:
        by_level.setdefault(level, set()).add(name)
    assert len({(lv, n) for _, lv, n in found[0]}) == len({t for _, t in rows})


def test_kept_rows(spark):
    rows = [(1, "a b", "x"), (2, "ab", "y"), (2, "ab", "y"), (3, None, None), (4, "", None), (5, "q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert sorted(map(tuple, bn.without_duplicates(docs).collect())) == [(1, "a b", "x"), (3, None, None), (5, "q", "z")]
    assert bn.without_duplicates(docs.limit(0)).count() == 0


def test_colliding_hashes(spark, monkeypatch):
    """Hashes of three values, or of one, over many tasks: blocks are still told apart and equal ones have one name."""
    monkeypatch.setattr(bn, "BLOCK", 8)
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["".join(rnd.choices("ab", k=rnd.randint(0, 60))), "hot text that is in many rows"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want, _ = expected(rows)
    for n in (1, 3):
        monkeypatch.setattr(bn, "_hash", lambda key, n=n: F.pmod(F.xxhash64(key), F.lit(n)))
        got = bn.duplicate_groups(docs).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want


def test_long_texts(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcdefgh \n", k=3_000_000))
    rows = [(1, long), (2, long.replace(" ", "")), (3, long[:-1] + "x"), (4, "x" + long)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in bn.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
