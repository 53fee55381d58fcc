import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import diversity
from parlance.operators.frequency import diversity_curve

SCHEMA = "file string, utt_idx long, speaker string, cw array<string>"


def turns_of(spark, groups):
    return spark.createDataFrame([("f", k, s, words[i : i + 20]) for s, words in groups.items() for k, i in enumerate(range(0, len(words), 20), 1)], SCHEMA)


def test_samples_without_replacement(spark):
    """Of fifty different words a sample of any size has as many types as words; of fifty equal ones, one; below fifty there are none."""
    groups = {"A": [f"w{k}" for k in range(50)], "B": ["w"] * 50, "C": ["x"] * 49}
    rows = diversity.sampled_ratios(turns_of(spark, groups), samples=20, trials=1).collect()
    assert {(r.speaker, r.n) for r in rows} == {(s, n) for s in "AB" for n in range(35, 51)}
    assert all((r.types, r.ttr, r.sd, r.d) == ((r.n, 1.0, 0.0, 0.0) if r.speaker == "A" else (1.0, 1 / r.n, 0.0, pytest.approx(0.5 / r.n / (1 - 1 / r.n)))) for r in rows)
    trials = {r.speaker: r for r in diversity.sampled_trials(diversity.sampled_ratios(turns_of(spark, groups), samples=20)).where("trial = 1").collect()}
    assert (trials["A"].d_optimum, trials["A"].error) == (0.0, None)
    assert 0 < trials["B"].d_optimum < 0.1
    assert diversity.sampled_diversity(turns_of(spark, {"C": ["x"] * 49})).count() == 0


def test_near_the_expected_curve(spark):
    """Many samples come near to what is expected of them, whatever the bins; seeds differ."""
    rnd = random.Random(2)
    words = [f"w{min(int(rnd.paretovariate(0.7)), 400)}" for _ in range(3000)]
    turns = turns_of(spark, {"A": words, "B": words[:60]})
    expected = {(r.speaker, r.n): r.ttr for r in diversity_curve(turns).collect()}
    found = {(r.speaker, r.n): r for r in diversity.sampled_ratios(turns, samples=127, trials=1).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(r.ttr - expected[k]) < 4 * r.sd / 127**0.5 + 0.004 for k, r in found.items())
    other = {(r.speaker, r.n): r.ttr for r in diversity.sampled_ratios(turns, samples=127, trials=1, seed=5).collect()}
    assert other != {k: r.ttr for k, r in found.items()}
    d = {r.speaker: r.d for r in diversity.vocd(turns).collect()}
    sampled = {r.speaker: r.d for r in diversity.sampled_diversity(turns).collect()}
    assert all(abs(d[s] - sampled[s]) < 0.1 * d[s] + 1 for s in d)


def test_bins_do_not_matter(spark, monkeypatch):
    rnd = random.Random(3)
    turns = turns_of(spark, {"A": rnd.choices("abcdefghij", weights=[50, *range(1, 10)], k=500)})
    one = sorted(map(tuple, diversity.sampled_ratios(turns, samples=10, trials=1).collect()))
    for bins in (1, 7, 499):
        monkeypatch.setattr(diversity, "BINS", bins)
        assert sorted(map(tuple, diversity.sampled_ratios(turns, samples=10, trials=1).collect())) == one


@pytest.mark.parametrize("d", [0.5, 12.345, 99.999, 4321.0])
def test_fitted(spark, d):
    points = [(n, d / n * ((1 + 2 * n / d) ** 0.5 - 1)) for n in range(35, 51)]
    row = spark.createDataFrame([(points,)], "points array<struct<n:int,ttr:double>>").select(diversity.fitted("points").alias("d")).first()
    assert row.d == pytest.approx(d, abs=0.002 * max(1, d / 100))


def test_least(spark):
    row = spark.range(1).select(*(diversity.least(lambda k, at=at: F.abs(k - at), F.lit(-1000), F.lit(1000))["k"].alias(f"c{i}") for i, at in enumerate((-1000, -999, 0, 17, 1000)))).first()
    assert list(row) == [-1000, -999, 0, 17, 1000]
