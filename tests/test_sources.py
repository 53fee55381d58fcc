import random

import pytest
from pyspark.sql import functions as F

from parlance import render
from parlance.converters import export
from parlance.converters import tables as conv
from parlance.operators import checks, profiles
from parlance.sources import chat, rules
from parlance.transforms import tiers
from parlance.transforms import words as words_of

TEXT = """@UTF8
@Begin
@Languages:	eng
@Participants:	CHI Ann Target_Child, MOT Mother, FAT Father
@ID:	eng|corpus|CHI|2;06.||||Target_Child|||
@Birth of CHI:	28-JAN-2001
@Date:	01-MAR-2003
@Media:	other, audio
@Bg:	Play
*CHI:	<I want> [/] I want goed [: went] [*] bein(g) &-uh xxx (..) ball@f . [+ mlue] \x15100_900\x15
%mor:	pron|I verb|want .
@Eg:	play
*MOT:	++ you [//] we see &+b 0it a:nd dog^gy ?
*MOT:	no end
@End
"""


def files(spark, text=TEXT, name="x.cha"):
    return spark.createDataFrame([(name, text)], "file string, text string")


def test_transcript(spark):
    a, b, c = chat.turns(files(spark)).orderBy("utt_idx").collect()
    assert a.cw == ["I", "want", "went", "being", "ball"]
    assert (a.terminator, a.postcodes, a.start_ms, a.end_ms, a.active_gems, a.unclear, a.n_err) == (".", ["mlue"], 100, 900, ["Play"], True, 1)
    assert (b.cw, b.linkers, b.terminator, b.active_gems) == (["we", "see", "and", "doggy"], ["++"], "?", [])
    assert c.terminator is None
    again = chat.turns(files(spark), retraced=True, originals=True).orderBy("utt_idx").first()
    assert again.cw == ["I", "want", "I", "want", "goed", "being", "ball"]
    assert [m.main.pos for m in a.mor] == ["pron", "verb"]
    assert chat.problems(files(spark, " ")).count() == 1 and chat.turns(files(spark, "")).count() == 0


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.cha").write_text(TEXT)
    (tmp_path / "sub/b.txt").write_text("no")
    assert chat.read_files(spark, str(tmp_path)).count() == 1
    assert chat.turns(chat.read_files(spark, [str(tmp_path / "sub/a.cha")])).count() == 3


def test_checks(spark):
    f = files(spark)
    found = checks.findings(chat.headers(f), chat.ids(f), chat.turns(f), target=True, unused=True)
    got = {(r.number, r.detail) for r in found.collect()}
    assert {(46, "FAT"), (60, "MOT"), (60, "FAT"), (157, "other"), (21, "3")} <= got and not any(n in (68, 69, 7) for n, _ in got)
    left = checks.cascades(spark.createDataFrame([("f", n, "") for n in (6, 69, 18)] + [("g", n, "") for n in (60, 18, 7, 44)], "file string, number int, detail string"))
    assert {(r.file, r.number) for r in left.collect()} == {("f", 69), ("g", 60), ("g", 44)}


def test_fluency(spark):
    (r, m) = profiles.fluency(chat.turns(files(spark))).orderBy("speaker").collect()
    assert (r.phrase_repetitions, r.fillers) == (1, 1)
    assert (m.prolongations, m.broken, m.revisions, m.fragments) == (1, 1, 1, 1)


def test_ages(spark):
    h = chat.headers(files(spark))
    out = tiers.ages(h.where("kind = 'Date'").select("file", "value"), h.where("kind = 'Birth'").select("file", F.col("participant").alias("speaker"), "value"))
    assert [r.comment for r in out.collect()] == ["Age of CHI is 2;01.01"]


def test_fixed_and_longtier(spark):
    assert chat.normalised("@UTF8\n\n*CHI: a\n\tb  c .\n") == "@UTF8\n*CHI:\ta b c .\n"
    assert chat.fixed(files(spark)).first().text.count("\n") == TEXT.count("\n")


def test_rule_files():
    assert rules.word_list("﻿# note\nthe \n\n;%* x\nof*\n") == ["the", "of*"]
    assert rules.sentence_rules("# x\ncopula 2\ncop\naux\nneg 1\nneg\n") == [("copula", ("cop", "aux"), 2), ("neg", ("neg",), 1)]
    assert [tuple(r) for r in rules.syntax_rules("N1\tn|\t\tnoun\nV2\tv|+PAST\tverb\n")] == [("N1", ("n|",), ()), ("V2", ("v|", "PAST"), ())]
    assert rules.morpheme_rules('OR\n"a" +n -v\nAND\n"b" -x\n') == [("OR", "a", ("n",), ("v",)), ("AND", "b", (), ("x",))]
    assert rules.string_changes("a\nb\n") == [("a", "b")]
    assert rules.dictionary("# c\nThe de\nthe da\n") == {"the": "da"}
    assert rules.lexicon("WORD  w er d\nWORD(2)  w o d\n") == [("WORD", "w er d", 0), ("WORD", "w o d", 1)]
    assert rules.rewrite_rules("a b => c\nd ==> e\n") == [("a b", "c"), ("d", "e")]
    assert rules.norm_name("x/eng_td_db.cut") == {"language": "eng", "kind": "td"}


def test_norms(spark):
    text = "V4.0 50\n=a.cha\n+@ID: eng|c|CHI|2;06.-3;00.|male|||Target_Child|||\n1 2\n3\n-\n=b.cha\n+eng|c|CHI|4;|||||||\nG x\n4 5 6\n-\n=c.cha\n+eng|c|CHI|||||||\nbad\n"
    out = rules.norms(spark, [text]).orderBy("path").collect()
    assert [(r.path, r.age_months, r.scores) for r in out] == [("a.cha", 33, [1.0, 2.0, 3.0]), ("b.cha", 48, [4.0, 5.0, 6.0])]


def test_converters(spark):
    of = lambda f, text: [tuple(r) for r in f(files(spark, text, "f")).orderBy("utt_idx").collect()]
    assert of(conv.from_lab, "0.0 1.5 hello\n1.5 2 sil\n2 2.25 you there\n") == [("f", 1, "SPK", "hello", 0, 1500), ("f", 2, "SPK", "you there", 2000, 2250)]
    assert of(conv.from_lab, "0.5 a\n1 sil\n2 b\n") == [("f", 1, "SPK", "a", 500, 1000), ("f", 2, "SPK", "b", 2000, 3000)]
    assert of(conv.from_srt, "1\n00:00:01,500 --> 00:00:02,000\nhi\nyou\n\n2\nbad\n") == [("f", 1, "SPK", "hi you", 1500, 2000)]
    assert of(conv.from_play, "child\t100\t200\thi\n# no\nMOT\tyes\n") == [("f", 1, "CHI", "hi", 100, 200), ("f", 2, "MOT", "yes", None, None)]
    assert of(conv.from_salt, "$ c\n+ x\nC The dog/s go (um) {x}.\nE What?\n") == [("f", 1, "CHI", "The dog go", "."), ("f", 2, "EXA", "What", "?")]
    assert of(conv.from_text, "One. Two\nthree?") == [("f", 1, "TXT", "One", "."), ("f", 2, "TXT", "Two three", "?")]
    grid = 'File type = "ooTextFile"\n"TextGrid"\n0\n2\n<exists>\n1\n"IntervalTier"\n"mother"\n0\n2\n2\n0\n1.25\n"a ""b"""\n1.25\n2\n""\n'
    assert of(conv.from_textgrid, grid) == [("f", 1, "MOT", 'a "b"', 0, 1250)]


def test_exports_come_back(spark):
    data = [("f", 1, "CHI", "a < b", 0, 500), ("f", 2, "MOT", "c & d", 600, 900), ("f", 3, "CHI", "e", 1000, 1500)]
    t = spark.createDataFrame(data, "file string, utt_idx long, speaker string, text string, start_ms long, end_ms long")
    assert [tuple(r) for r in conv.from_eaf(export.eaf(t)).orderBy("utt_idx").collect()] == data
    assert [tuple(r) for r in conv.from_textgrid(export.textgrid(t)).orderBy("utt_idx").collect()] == data
    back = conv.from_srt(export.whole(export.subtitles(t))).orderBy("utt_idx").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in back] == [d[3:] for d in data]
    untimed = spark.createDataFrame([("f", 1, "A", "x", 0, 500), ("f", 2, "A", "y", None, None), ("f", 3, "A", "z", None, None)], t.schema)
    assert [(r.start_ms, r.end_ms) for r in export.filled_times(untimed).orderBy("utt_idx").collect()] == [(0, 500), (500, 1500), (1500, 2500)]
    written = export.chat(t.withColumn("terminator", F.lit(".")))
    again = chat.turns(written).orderBy("utt_idx").collect()
    assert [(r.speaker, r.start_ms) for r in again] == [("CHI", 0), ("MOT", 600), ("CHI", 1000)]


def test_postmortem_and_times(spark):
    line = spark.createDataFrame([("the big dog of the town",)], "x string")
    assert line.select(words_of.postmortem("x", [("of the", "of_the"), ("the * dog", "a $- cat")]).alias("y")).first().y == "a big cat of_the town"
    t = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 50, 60), ("f", 3, 61, 400)], "file string, utt_idx long, start_ms long, end_ms long")
    assert [tuple(r)[1:] for r in tiers.shifted(t, 10).orderBy("utt_idx").collect()] == [(1, 10, 110), (2, 111, 112), (3, 113, 410)]
    assert tiers.aligned_overlaps("*A:\tab ⌈cd⌉\n*B:\t⌊ef⌋").split("\n")[1].index("⌊") == "*A:\tab ⌈cd⌉".index("⌈")


def test_shifted_times_are_those_of_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(str(f), k, s := rng.randrange(400), s + rng.randrange(-3, 40)) for f in range(5) for k in range(60)] + [(None, 1, None, 5)]
    rows = [(f, k, s, e if e is None or e > 0 else 1) for f, k, s, e in rows]
    expected, last = [], {}
    for f, k, s, e in rows:
        if s is not None:
            s = max(s + 7, last.get(f, -1) + 1)
            last[f] = max(e + 7, s + 1)
            expected.append((f, k, s, last[f]))
    t = spark.createDataFrame(rows, "file string, utt_idx long, start_ms long, end_ms long")
    assert sorted(map(tuple, tiers.shifted(t, 7).collect())) == sorted(expected)
    assert tiers.shifted(t.limit(0)).count() == 0
    with pytest.raises(Exception, match="a time below 0"):
        tiers.shifted(t, -300).collect()


def test_render(spark):
    df = spark.createDataFrame([("a,b", 1, 0.5), ("c", 22, None)], "w string, n long, r double")
    assert render.render(df).split("\n")[0].split() == ["w", "n", "r"]
    assert render.render(df, "csv").split("\n")[1] == '"a,b",1,0.5'
    assert '"n": 22' in render.render(df, "json")
    sheet = render.render(df, "xls")
    assert '<Data ss:Type="Number">0.500</Data>' in sheet and '<Data ss:Type="String">.</Data>' in sheet


def test_only_fields_that_are_asked_for(spark, tmp_path):
    """Fields nobody reads aren't made; what is left is the same, and main tiers aren't read for speakers alone."""
    from parlance.plans.requests import run_line

    text = "@UTF8\n@Begin\n@Participants:\tA x\n*A:\t<so it> [//] was xxx &-um zz [: good] [*] .\n%mor:\tn|it\n*B:\tno [+ mlue] .\n*A:\tyes and no .\n@End\n"
    files = spark.createDataFrame([("f", text)], "file string, text string")
    names = ["utt_idx", "cw", "unclear", "n_err"]
    whole, narrow = chat.turns(files, retraced=True), chat.turns(files, retraced=True, only=["utt_idx", "words.n_err"])
    assert narrow.select(names).collect() == whole.select(names).collect() and len(narrow.collect()) == 3
    assert "text" not in narrow.columns and "raw" not in narrow.schema["words"].dataType.elementType.names
    chat.store(files, f"{tmp_path}/scan", ("header", "turn"), only=["speaker"])
    stored = chat.stored(spark, f"{tmp_path}/scan")
    assert [r.speaker for r in chat.turns(stored).orderBy("line_no").collect()] == ["A", "B", "A"]
    assert all("words" not in row for _, kind, row in chat.parse_lines(text, ("turn",), main_tiers=False))
    made = run_line(spark, "mlu -t%mor", files)
    assert "retrace_kind" not in made._jdf.queryExecution().analyzed().toString() and "postcodes" in made._jdf.queryExecution().analyzed().toString()
    assert [tuple(r)[:3] for r in made.collect()] == [("A", 1, 3)]
