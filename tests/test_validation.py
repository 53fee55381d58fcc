import random

import pytest
from oracle import same

from parlance.operators import validation
from parlance.plans import planted
from parlance.sources import chat

GOOD = "@UTF8\n@PID:\tx\n@Begin\n@Languages:\teng\n@Participants:\tCHI Ann Target_Child\n@ID:\teng|c|CHI|2;06.|||WC|Target_Child|||\n*CHI:\ta .\n%com:\tx\n@End\n"
KINDS = {"@UTF8": validation.UTF8, "@Begin": validation.BEGIN, "@End": validation.END, "@PID:\tx": validation.EARLY, "@Comment:\tx": validation.HEADER, "*CHI:\ta .": validation.TURN, "%com:\tx": validation.TIER, "hm": validation.OTHER}


@pytest.mark.parametrize("name", sorted(planted.QUERIES))
def test_queries(spark, name):
    """On the next larger tables, so that each fault is there."""
    same(spark, planted.QUERIES[name], planted.ORACLES[name], "/root/testdata/sf0.01")


def numbers_of(spark, text, **more):
    scanned = chat.scan(spark.createDataFrame([("f", text)], "file string, text string"), ("line", "turn", "problem"))
    return sorted((r.line_no, r.number) for r in validation.check(scanned, **more).collect())


def test_a_good_file(spark):
    assert numbers_of(spark, GOOD, target=True, unused=True) == []


def test_include_and_exclude(spark):
    text = GOOD.replace("*CHI:\ta .", "*CHI:\ta 3").replace("WC", "rich")
    assert numbers_of(spark, text) == [(6, 144), (7, 21), (7, 38), (7, 47)]
    assert numbers_of(spark, text, include=[21, 47]) == [(7, 21), (7, 47)]
    assert numbers_of(spark, text, exclude=[21, 47]) == [(6, 144), (7, 38)]
    assert validation.numbers(spark).count() == len(validation.MESSAGES) >= 60


def test_cascades(spark):
    assert numbers_of(spark, GOOD.replace("@UTF8\n", "")) == [(1, 69)]
    assert [n for _, n in numbers_of(spark, GOOD.replace("@Begin\n", ""))] == [6]
    assert [n for _, n in numbers_of(spark, GOOD + "*CHI:\tb .\n")] == [44]


def test_gems(spark):
    gems = lambda *x: GOOD.replace("*CHI", "".join(f"@{g}\n" for g in x) + "*CHI")
    assert numbers_of(spark, gems("Bg:\ta", "Eg:\tA")) == []
    assert [n for _, n in numbers_of(spark, gems("Eg:\ta", "Bg:\ta", "Eg:\ta"))] == [46]
    assert [n for _, n in numbers_of(spark, gems("Eg:\ta", "Bg:\ta"))] == [46, 45]
    assert [n for _, n in numbers_of(spark, gems("Bg:\ta", "Bg:\tb", "Eg:\ta"))] == [45]


def test_stretches_compose(spark, monkeypatch):
    """Files cut in stretches of a few lines give what one pass over each file gives."""
    rnd = random.Random(9)
    rows, want = [], []
    for k in range(40):
        state, file, lines = validation.START, f"f{k}", rnd.choices(list(KINDS), weights=[1, 1, 1, 1, 4, 9, 6, 1], k=rnd.randint(1, 60))
        for n, line in enumerate(lines, 1):
            rows.append((file, n, line))
            state, wrong = validation.TABLE[state][KINDS[line]]
            want += [(file, n, x) for x in wrong]
        if state != validation.ENDED:
            want.append((file, len(lines), 7))
    rnd.shuffle(rows)
    texts = spark.createDataFrame(rows, "file string, line_no int, raw string")
    lines = texts.selectExpr("file", "line_no", "case when substr(raw, 1, 1) in ('@', '*', '%') then substr(raw, 1, 1) else '?' end as sign", "regexp_extract(raw, '^[@*%]([^:]*)', 1) as label")
    for size in (10_000, 7, 1):
        monkeypatch.setattr(validation, "STRETCH", size)
        assert sorted(map(tuple, validation.order_findings(lines).collect())) == sorted(want)
    assert validation.order_findings(lines.limit(0)).count() == 0
