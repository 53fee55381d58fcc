import random

import pytest
from oracle import same

from parlance.operators import linkers
from parlance.plans import audits


@pytest.mark.parametrize("name", sorted(audits.QUERIES))
def test_queries(spark, name):
    same(spark, audits.QUERIES[name], audits.ORACLES[name], "/root/testdata/sf0.01")


SCHEMA = "file string, utt_idx long, speaker string, terminator string, linkers array<string>"


def test_pairs_against_a_search(spark):
    rnd = random.Random(4)
    rows = []
    for f in range(30):
        rows += [(f"f{f}", k, rnd.choice("ABC"), rnd.choice([".", "+...", "+/.", '+"/.', None]), rnd.choice([None, [], ["++"], ["+,"], ['+"'], ["+<", "++"]])) for k in range(1, rnd.randint(2, 40))]
    want = []
    for linker, (ends, other) in linkers.ANNOUNCED.items():
        for f in {r[0] for r in rows}:
            own, taken = sorted(r for r in rows if r[0] == f), set()
            for _, k, speaker, _, links in own:
                if linker in (links or []):
                    back = [j for _, j, s, t, _ in own if j < k and t in ends and (s != speaker) == other]
                    at = back[-1] if back and back[-1] not in taken else None
                    taken.add(at)
                    want.append((f, linker, at, k))
            want += [(f, linker, j, None) for _, j, _, t, _ in own if t in ends and j not in taken]
    got = [tuple(r) for r in linkers.linker_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: (r[0], r[1], r[2] or 0, r[3] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_conversation(spark):
    rows = [("f", 1, "A", "+...", ["++"]), ("f", 2, "B", "+/.", ["++"]), ("f", 3, "B", '+"/.', ["+,", "+<"]), ("f", 4, "A", ".", ["+<"]), ("f", 5, "B", ".", ['+"']), ("f", 6, "B", None, ['+"', "+^"]), ("f", 7, "B", "≋", ["+≋"]), ("f", 8, "A", ".", None)]
    r = linkers.linker_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.utterances, r.pp_first_utterance, r.pp_correct, r.sc_correct, r.qf_correct, r.qf_chained) == (8, 1, 1, 1, 1, 1)
    assert (r.lo_blocks, r.lo_block_size_2, r.lo_max_speakers_in_block, r.lo_same_speaker_start, r.lo_combined_with_other) == (1, 1, 2, 1, 1)
    assert (r.qu_same_speaker, r.tcu_tech_same_speaker, r.term_technical_break, r.trailing_off_followed, r.interruption_followed) == (1, 1, 1, 1, 1)
    s = linkers.linker_summary(linkers.linker_stats(spark.createDataFrame(rows, SCHEMA))).first()
    assert (s.files, s.files_with_linkers, s.files_with_anomalies, s.trailing_off_rate, s.interruption_rate) == (1, 1, 1, 1.0, 1.0)
    empty = linkers.linker_summary(linkers.linker_stats(spark.createDataFrame([], SCHEMA))).first()
    assert (empty.files, empty.utterances, empty.trailing_off_rate) == (0, 0, None)
