"""Known results on two small transcripts, and what must hold between results."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import comparison, filters, frequency, interaction, lengths, places, profiles
from parlance.sources import chat

TALK = """@UTF8
@Begin
@Languages:	eng
@Participants:	SPE Speaker, GES Gesturer
@ID:	eng|corpus|SPE|||||Speaker|||
@ID:	eng|corpus|GES|||||Target_Child|||
*SPE:	Triangle kept going .
*GES:	angle kept going .
*SPE:	and he twirled up the hill until
	he got to the top .
*GES:	twirled up the hill .
*GES:	until he got to the to .
@End
"""
MOR = """@UTF8
@Begin
@Languages:	eng
@Participants:	CHI Child, MOT Mother
@ID:	eng|corpus|CHI|3;00.||||Child|||
@ID:	eng|corpus|MOT|||||Mother|||
*CHI:	it's I want cookies .
%mor:	pron|it~aux|be-Fin-Ind-Pres-S3 pron|I-Prs-Nom-S1 verb|want-Fin-Ind-Pres noun|cookie-Plur .
%gra:	1|4|NSUBJ 2|1|AUX 3|4|NSUBJ 4|0|ROOT 5|4|OBJ 6|4|PUNCT
*MOT:	Mommy will get them .
%mor:	propn|Mommy aux|will verb|get-Inf pron|they-Prs-Acc-Plur .
%gra:	1|3|SUBJ 2|3|AUX 3|0|ROOT 4|3|OBJ 5|3|PUNCT
@End
"""


@pytest.fixture(scope="module")
def talk(spark):
    return chat.turns(spark.createDataFrame([("talk", TALK)], "file string, text string")).cache()


@pytest.fixture(scope="module")
def mor(spark):
    return chat.turns(spark.createDataFrame([("mor", MOR)], "file string, text string")).cache()


def rows(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_frequency(talk):
    found = rows(frequency.types_and_tokens(frequency.frequency(talk)), "speaker")
    assert [(found[s,].types, found[s,].tokens, round(found[s,].ttr, 3)) for s in ("SPE", "GES")] == [(13, 15, 0.867), (11, 13, 0.846)]
    words = rows(frequency.frequency(talk), "speaker", "word")
    assert ("SPE", "Triangle") in words and words["SPE", "the"]["count"] == 2


def test_distance(talk):
    found = rows(places.distances(talk), "word")
    assert tuple(found["got",])[2:] == (2, 3, 5, 1.0)
    assert tuple(found["he",])[2:] == (3, 3, 5, 0.666667)
    assert found["triangle",]["last"] is None


def test_turns(talk):
    found = rows(lengths.turn_lengths(talk), "speaker")
    assert [tuple(found[s,])[1:4] for s in ("SPE", "GES")] == [(2, 2, 15), (2, 3, 13)]


def test_clusters(talk):
    (r,) = places.cluster_totals(talk).collect()
    assert (r.unique, r.instances, r.utterances) == (15, 23, 5)


def test_word_lengths(talk):
    found = rows(lengths.means(lengths.length_histograms(talk.drop("mor"))), "section", "speaker")
    assert (round(found[1, "SPE"]["mean"], 3), round(found[1, "GES"]["mean"], 3)) == (3.733, 3.615)


def test_morphemes(mor):
    found = rows(lengths.mean_length(mor, morphemes=True), "speaker")
    assert [(found[s,].utterances, found[s,].total, found[s,].sd) for s in ("CHI", "MOT")] == [(1, 6, None), (1, 5, None)]


def test_positions(mor):
    (r,) = places.positions(mor).agg(*(F.sum(c).alias(c) for c in ("initial", "other", "final", "one_word"))).collect()
    assert tuple(r) == (2, 4, 2, 0)


def test_complexity(mor):
    found = rows(profiles.complexity(mor), "speaker")
    assert [(found[s,].complex, found[s,].relations) for s in ("CHI", "MOT")] == [(0, 5), (0, 4)]


def test_agreement(spark):
    a = spark.createDataFrame([(1, ["$NOM"]), (2, ["$VRB"]), (3, ["$ADJ", "$ADV"])], "utt_idx long, cod array<string>")
    b = spark.createDataFrame([(1, ["$NOM"]), (2, ["$VRB"]), (3, ["$VRB", "$ADV"])], "utt_idx long, cod array<string>")
    by = comparison.agreement(a, b)
    assert {r.code: (r.first, r.second, r.agreed) for r in by.select("code", F.col("first"), "second", "agreed").toDF("code", "first", "second", "agreed").collect() for r in [r]} == {"$ADJ": (1, 0, 0), "$ADV": (1, 1, 1), "$NOM": (1, 1, 1), "$VRB": (1, 2, 1)}
    (k,) = comparison.kappa(by).collect()
    assert (k.percent, round(k.kappa, 4)) == (75.0, 0.6667)


def test_phones_and_replicas(spark):
    t = spark.createDataFrame([("CHI", ["ˈmɑmiː", "abc"], ["ˈmɑmiː"])], "speaker string, pho array<string>, mod array<string>")
    found = {r.phone: (r.total, r.initial, r.final, r.other) for r in comparison.phones(t).collect()}
    assert found["m"] == (2, 1, 0, 1) and found["i"] == (1, 0, 1, 0) and found["a"] == (1, 1, 0, 0)
    assert [tuple(r) for r in comparison.replicas(t).collect()] == [("CHI", "ˈmɑmiː", "ˈmɑmiː", 1)]


def test_parts_make_the_whole(talk, spark):
    whole = frequency.frequency(talk, combine_speakers=True).agg(F.sum("count")).first()[0]
    parts = [frequency.frequency(filters.of_speakers(talk, [s])).agg(F.sum("count")).first()[0] for s in ("SPE", "GES")]
    assert sum(parts) == whole == 28
    ids = chat.ids(spark.createDataFrame([("talk", TALK)], "file string, text string"))
    assert filters.with_id(talk, ids, "*|Target_Child|*").count() == 3 and filters.with_id(talk, ids, "nothing").count() == 0
    assert filters.with_role(talk, ids, ["SPEAKER"]).count() == 2
    once = filters.in_range(talk, 2, 4)
    assert sorted(map(str, filters.in_range(once, 2, 4).collect())) == sorted(map(str, once.collect()))


def test_echo_of_itself_is_exact(spark):
    t = spark.createDataFrame([("f", 1, "A", ["a", "b"]), ("f", 2, "B", ["B", "A"]), ("f", 3, "A", ["b", "c", "d"]), ("f", 4, "A", ["x"])], "file string, utt_idx long, speaker string, cw array<string>")
    assert [tuple(r)[2:] for r in interaction.echoes(t).orderBy("utt_idx").collect()] == [("A", "B", "exact"), ("B", "A", "overlap")]


def test_chains_are_sums(spark):
    data = [(1, "A", ["x", "x"]), (2, "B", ["y"]), (3, "A", ["x"]), (4, "A", ["y"]), (5, "A", ["x"])]
    t = spark.createDataFrame([("f", *d) for d in data], "file string, utt_idx long, speaker string, cod array<string>")
    found = {(r.speaker, r.code): (r.chains, r["mean"], r.least, r.most) for r in interaction.chains(t).collect()}
    assert found["A", "x"] == (2, 2.0, 1, 3) and found["A", "y"] == (1, 1.0, 1, 1)


def test_moving_ratio_is_the_mean_of_windows(talk):
    words = [w.lower() for r in talk.orderBy("utt_idx").collect() for w in r.cw if r.speaker == "SPE"]
    naive = sum(len(set(words[i : i + 5])) / 5 for i in range(len(words) - 4)) / (len(words) - 4)
    found = rows(frequency.moving_ratio(talk, 5), "speaker")
    assert found["SPE",].mattr == pytest.approx(naive, abs=1e-6)
    assert rows(frequency.moving_ratio(talk, 99), "speaker")["SPE",].mattr is None


def test_overlaps(spark):
    t = spark.createDataFrame([("f", 1, "A", "one ⌈two⌉", 0, 1000), ("f", 2, "B", "⌊hm⌋ yes", 900, 1500), ("f", 3, "B", "⌊lone⌋", 9000, 9500), ("g", 1, "A", "none", None, None)], "file string, utt_idx long, speaker string, text string, start_ms long, end_ms long")
    found = rows(interaction.overlap_audit(t), "file")
    assert (found["f",].groups, found["f",].orphan_bottoms, found["f",].timed, found["f",].consistent) == (1, 0, 2, 1)
    assert found["g",].quality == "none"


def test_norms(spark):
    norms = spark.createDataFrame([([1.0, 4.0],), ([3.0, 4.0],), ([5.0],)], "scores array<double>")
    scores = spark.createDataFrame([("CHI", 0, 5.0), ("CHI", 1, 9.0)], "speaker string, measure int, score double")
    found = rows(comparison.z_scores(scores, norms), "measure")
    assert (found[0,].z, found[0,].n) == (1.0, 3) and found[1,].z is None
