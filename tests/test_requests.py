import pytest
from pyspark.sql import functions as F
from test_goldens import MOR, TALK

from parlance.plans import requests
from parlance.plans.requests import run_line
from parlance.sources import chat

# Known results: words of each speaker, with their counts.
SPE = {"Triangle": 1, "and": 1, "going": 1, "got": 1, "he": 2, "hill": 1, "kept": 1, "the": 2, "to": 1, "top": 1, "twirled": 1, "until": 1, "up": 1}
GES = {"angle": 1, "going": 1, "got": 1, "he": 1, "hill": 1, "kept": 1, "the": 2, "to": 2, "twirled": 1, "until": 1, "up": 1}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    (out / "talk.cha").write_text(TALK)
    (out / "stop.cut").write_text("the\nto\n")
    (out / "mor").mkdir()
    (out / "mor" / "mor.cha").write_text(MOR)
    return out


def test_a_line_over_files(spark, folder):
    found = run_line(spark, f"freq {folder}/talk.cha").collect()
    assert {(r.speaker, r.word): r["count"] for r in found} == {("SPE", w): n for w, n in SPE.items()} | {("GES", w): n for w, n in GES.items()}
    types = {r.speaker: (r.types, r.tokens, round(r.ttr, 3)) for r in run_line(spark, f"freq +d4 {folder}/talk.cha").collect()}
    assert types == {"SPE": (13, 15, 0.867), "GES": (11, 13, 0.846)}


def test_flags_reach_their_commands(spark, folder):
    files = chat.read_files(spark, str(folder / "talk.cha"))
    run = lambda line: run_line(spark, line, files)
    words = lambda line: {r.word: r["count"] for r in run(line).collect()}
    assert words("freq +tSPE") == SPE and words("freq -t*SPE") == GES
    assert words("freq +tSPE +k") == {w.lower(): n for w, n in SPE.items()}
    assert words(f"freq +tSPE -s@{folder}/stop.cut") == {w: n for w, n in SPE.items() if w not in ("the", "to")}
    assert words("freq +t#Target_Child +z1-2") == {"angle": 1, "kept": 1, "going": 1}
    assert words("freq +tSPE '+sthe hill' +sgo*") == {"the hill": 1, "going": 1, "got": 1}
    assert {(r.group, r.matched) for r in run("freq '+sthe *' +c7").collect()} == {("the *", "the hill"), ("the *", "the top"), ("the *", "the to")}
    assert {r.speaker: r.mean for r in run("mlu -t%mor").collect()} == {"SPE": 7.5, "GES": round(13 / 3, 6)}
    assert {r.utt_idx for r in run("kwal +shill").collect()} == {3, 4}
    assert [r.word for r in run("maxwd +c1 +tSPE").collect()] == ["triangle"]
    assert {r.number for r in run("check").collect()} == {15, 142}  # a role that is none, and not the one its @ID has
    assert run("check -e15 -e142").count() == 0 and run("check +e").count() >= 60
    assert {r.number for r in run("check +g2 +e68").collect()} == {68}
    assert run("uniq").where("line like '*spe%'").count() == 2


@pytest.mark.parametrize("name", sorted(requests.COMMANDS))
def test_every_command_runs(spark, folder, name):
    (folder / "rules.cut").write_text("AND noun n|\n")
    given = {"gemfreq": "+gx", "kwal": "+swant", "combo": "+sI+want", "keymap": "+bx", "mortable": f"+l{folder}/rules.cut", "rely": f"--second-file {folder}/mor/mor.cha", "script": f"+s{folder}/mor/mor.cha"}
    line = f"{name} {given.get(name, '')} {folder}/mor"
    assert run_line(spark, line).columns
    run_line(spark, line).agg(F.count(F.lit(1))).collect()


def test_a_stored_scan_stands_for_files(spark, folder, tmp_path):
    chat.store(chat.read_files(spark, str(folder)), str(tmp_path / "scan"))
    stored = chat.stored(spark, str(tmp_path / "scan"))
    for line in ("freq +re", "mlu", "check +g5", "dss", "uniq"):
        assert sorted(map(str, run_line(spark, line, stored).collect())) == sorted(map(str, run_line(spark, f"{line} {folder}").collect()))


@pytest.mark.parametrize(("line", "says"), [("mor x", "trained"), ("nope x", "unknown"), ("kwal x", "needs include"), ("gemfreq x", "needs gems"), ("freq +q9 x", "no option"), ("freq --size 3", "no option"), ("freq --range", "wants a value"), ("freq", "needs files"), ("", "unknown")])
def test_what_is_refused(spark, line, says):
    with pytest.raises((ValueError, NotImplementedError), match=says):
        run_line(spark, line)


def test_the_table(spark):
    """Each option's commands are there, and an argument of a command has one name."""
    for option in requests.OPTIONS:
        assert set(option.commands.split()) <= set(requests.COMMANDS)
        assert option.kind in ("flag", "text", "number", "texts", "numbers", "span", "file")
    request = requests.parsed("freq +tCHI -tMOT +gplay +z2-9 +x>3w +xxxx +r5 +r6 +sth* -sx +c -- +odd".split(), lambda p: [])
    f = request.filters
    assert (f.speakers, f.not_speakers, f.gems, f.range, f.length, f.case_sensitive) == (["CHI"], ["MOT"], ["play"], (2, 9), ">3w", True)
    assert request.reading == {"restored": ("xxx",), "originals": True, "retraced": True}
    assert request.arguments == {"include": ["th*"], "exclude": ["x"], "capital": "initial"} and request.paths == ["+odd"]
