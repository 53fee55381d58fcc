import random
import statistics

import pytest

from parlance.operators import norms, profiles
from parlance.sources.tables import conversation_turns, read, with_tiers

ENTRY = "language string, grp string, sex string, age_months int, speaker_code string, scores array<double>"
WHO = "file string, speaker string, language string, age_months int"


def test_cohorts_against_every_norm(spark):
    rnd = random.Random(7)
    entries = [(rnd.choice(["eng", "ENG", "deu"]), "", None, rnd.choice([None, *range(20, 60)]), "CHI", [float(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 3))]) for _ in range(150)]
    ages = [("x", "s", language, age) for language in ("eng", "Deu", "fra") for age in [None, *range(0, 90, 3)]]
    found = {}
    for r in norms.cohorts(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(ages, WHO), widths=(1, 4), least=4).collect():
        found[r.language, r.age_months, r.measure] = (r.width, r.entries, pytest.approx(r.mean), pytest.approx(r.sd), r.n)
    want = {}
    for _, _, language, age in ages:
        own = [e for e in entries if e[0].lower() == language.lower()]
        for width in (1, 4, norms.ALL_AGES):
            near = own if width == norms.ALL_AGES else [e for e in own if age is not None and e[3] is not None and abs(e[3] - age) <= width]
            if len(near) >= 4 or width == norms.ALL_AGES:
                break
        for k in range(3):
            scores = [e[5][k] for e in near if len(e[5]) > k]
            if scores:
                want[language.lower(), age, k] = (width, len(near), statistics.mean(scores), statistics.stdev(scores) if len(scores) > 1 else 0.0, len(scores))
    assert found == want
    assert {v[0] for v in want.values()} == {1, 4, norms.ALL_AGES}


def test_filtered_norms_and_groups_without_any(spark):
    entries = spark.createDataFrame([("eng", "TD", "male", 30, "CHI", [1.0, 5.0]), ("eng", "td", "female", 30, "CHI", [3.0, 9.0]), ("eng", "SLI", "male", 30, "CHI", [100.0, 100.0])], ENTRY)
    measures = (norms.Measure("A", 0, "a"), norms.Measure("B", 1, "b"), norms.Measure("C", 2, "c"))
    done = spark.createDataFrame([("f", "CHI", 4, 5.0, 1), ("g", "CHI", 1, None, 1)], "file string, speaker string, a int, b double, c int")
    who = spark.createDataFrame([("f", "CHI", "Eng", 30), ("g", "CHI", "zho", 30)], WHO)
    rows = {(r.file, r.label): r for r in norms.against_norms(done, who, entries, measures, group="td").collect()}
    a = rows["f", "A"]
    assert (a.score, a.mean, a.sd, a.n, a.z, a.width, a.entries) == (4.0, 2.0, pytest.approx(2**0.5, abs=1e-6), 2, pytest.approx(2**0.5, abs=1e-6), norms.ALL_AGES, 2)
    assert rows["f", "C"].n == 0 and rows["f", "C"].z is None
    assert (rows["g", "A"].n, rows["g", "A"].mean, rows["g", "B"].z) == (0, None, None)
    assert len(rows) == 6
    assert all(r.n == 0 for r in norms.against_norms(done, who, entries.limit(0), measures).collect())


def test_columns(spark):
    """What goes out as norms in columns is read back by the same columns."""
    turns = with_tiers(conversation_turns(read(spark, "/root/testdata/sf0.001", "conversations")))
    found = profiles.child_evaluation(turns)
    got = {(r.speaker, r.label): r.score for r in norms.measured(found, ("speaker",), norms.KIDEVAL).collect()}
    assert len({label for _, label in got}) == 8  # errors are no field of it
    for r in norms.as_norms(found.withColumn("word_errors", found.utterances * 0), norms.KIDEVAL).collect():
        assert {m.label: r.scores[m.column] for m in norms.KIDEVAL if (r.speaker, m.label) in got} == {label: x for (s, label), x in got.items() if s == r.speaker}
    assert len({m.column for m in norms.EVAL}) == len(norms.EVAL) == 21
