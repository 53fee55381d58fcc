import random

import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from parlance.plans import transcripts
from parlance.sources import chat
from parlance.storage import read_packed, read_texts, write_packed, write_texts


def words(text, **more):
    return [(w["cleaned"], w["retrace_kind"], w["replaced"], w["replacement"], w["n_err"]) for w in chat.parse_main(text)["words"]]


def test_groups_nest():
    found = words("<a <b c> [/] d> [//] e [: f] [*] <g h> [*] [/] .")
    assert found == [
        ("a", "full", False, False, 0), ("b", "partial", False, False, 0), ("c", "partial", False, False, 0), ("d", "full", False, False, 0),
        ("e", None, True, False, 1), ("f", None, False, True, 0), ("g", "partial", False, False, 1), ("h", "partial", False, False, 0),
    ]


def test_what_is_left_open():
    assert chat.MainTier("<a b .").problems == ["< without >"]
    assert chat.MainTier("a> [/] b .").problems == ["> without <"]
    assert chat.MainTier("[/] b .").problems == ["[/] without a word before it"]
    assert chat.MainTier("<a <b> [/] c> [/] d .").problems == []


def test_random_groups_against_a_tree():
    """The stack against a recursive reading of the same tree."""
    rnd = random.Random(6)

    def grown(depth):
        parts, flags = [], []
        for _ in range(rnd.randint(1, 3)):
            if depth and rnd.random() < 0.5:
                text, inner = grown(depth - 1)
                mark = rnd.choice(["", "[/]", "[//]", "[/-]"])
                parts.append(f"<{text}> {mark}".strip())
                flags += [f or chat.RETRACES.get(mark) for f in inner]
            else:
                mark = rnd.choice(["", "", "[/]", "[///]"])
                parts.append(f"w{rnd.randint(0, 9)} {mark}".strip())
                flags.append(chat.RETRACES.get(mark))
        return " ".join(parts), flags

    for _ in range(300):
        text, flags = grown(4)
        assert [w["retrace_kind"] for w in chat.parse_main(text + " .")["words"]] == flags, text


def test_words_are_protected(spark):
    odd = ["a:b", "x@y", "(a)", "0", "007", "xxx", "XX", "<b>", "[+a", "+<b", "a^b~", "it's", "“q”", "&-um", "⌈a⌉", "1_2"]
    turns = spark.createDataFrame([("f", 1, "CHI", odd)], "file string, utt_idx long, speaker string, w array<string>")
    text = turns.select("file", F.concat(F.lit("@UTF8\n*CHI:\t"), F.array_join(F.transform("w", chat.protected), " "), F.lit(" .\n@End")).alias("text"))
    row = chat.turns(text).withColumn("cw", chat.unprotected("cw")).first()
    assert row.cw == odd and row.terminator == "."


def test_a_scan_is_parsed_once(spark, tmp_path):
    text = "@UTF8\n@Begin\n@Participants:\tCHI Ann Target_Child\n@ID:\teng|c|CHI|||||Target_Child|||\n*CHI:\ta <b .\n%mor:\tn|a\n@End\n"
    files = spark.createDataFrame([("a", text), ("b", " "), ("c", None), (None, text)], "file string, text string")
    chat.store(files, str(tmp_path / "scan"))
    lines = chat.stored(spark, str(tmp_path / "scan"))
    for of in (files, lines):
        assert sorted((r.file or "", r.problem) for r in chat.problems(of).collect()) == [("", "< without >"), ("a", "< without >"), ("b", "empty"), ("c", "empty")]
        assert chat.ids(of).count() == 2 and chat.headers(of).where("kind = 'Participant'").count() == 2
        assert [(r.cw, r.mor[0].main.lemma, r.line_no) for r in chat.turns(of).collect()] == [(["a", "b"], "a", 5)] * 2
    plan = chat.headers(lines)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "words" not in plan
    assert "words" not in chat.scan(files, ["header"]).schema.simpleString()
    assert "MapInArrow" in chat.turns(files)._jdf.queryExecution().executedPlan().toString()


def test_discovery(spark, tmp_path):
    (tmp_path / "a.b").mkdir()
    for name in ("a.b/one.cha", "a.b/two.cha", "a.b/three.txt"):
        (tmp_path / name).write_text("@UTF8\n*CHI:\ta .\n")
    gone = str(tmp_path / "gone.cha")
    found = {r.name: (r.status, r.reason) for r in chat.discovered(spark, [str(tmp_path), gone], only="one|three").collect()}
    assert found == {"one.cha": ("read", None), "two.cha": ("skipped", "not asked for"), "three.txt": ("skipped", "name"), "gone.cha": ("skipped", "missing")}
    assert chat.read_files(spark, [str(tmp_path / "a.b"), gone]).count() == 2  # a folder with a dot in its name is a folder
    assert chat.read_files(spark, str(tmp_path), only="one").count() == 1
    assert chat.read_files(spark, [str(tmp_path / "a.b/three.txt")]).count() == 1
    assert chat.read_files(spark, gone).count() == 0 and chat.discovered(spark, gone).count() == 1
    with pytest.raises(ValueError, match="not a path"):
        chat.read_files(spark, "+t*CHI")


def test_texts_round_trip(spark, tmp_path):
    rows = [("a b", "one\ntwo\n"), ("1", ""), ("x=y", None), ("é", "tab\t")]
    write_texts(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "t"))
    assert sorted(read_texts(spark, str(tmp_path / "t")).collect()) == sorted((f, t or "") for f, t in rows)


def test_packed_texts(spark, tmp_path):
    rows = [(str(k), f"one {k}\n") for k in range(300)] + [("a b", ""), ("x=y", None), ("\u00e9", "tab\t\n\n")]
    write_packed(spark.createDataFrame(rows, "file string, text string").repartition(2), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("part-*"))) == 2  # not a file for each text
    assert sorted(read_packed(spark, str(tmp_path / "t")).collect()) == sorted((f, (t or "").removesuffix("\n")) for f, t in rows)


def test_queries_write_few_files(spark, tmp_path, monkeypatch):
    rows = [(k, t, "user", "one two three.") for k in range(200) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(transcripts, "new_path", lambda _, tag: str(tmp_path / tag))
    assert transcripts.QUERIES["cha_turns"](spark, str(tmp_path)).count() == 400
    assert transcripts.QUERIES["sheet_wide"](spark, str(tmp_path)).count() == 200
    assert len(list((tmp_path / "transcripts").rglob("part-*"))) + len(list((tmp_path / "sheets").rglob("part-*"))) <= 16


@pytest.mark.parametrize("name", sorted(transcripts.QUERIES))
def test_queries(spark, name):
    same(spark, transcripts.QUERIES[name], transcripts.ORACLES[name])


def test_rows_by_columns_are_those_dict_by_dict():
    """Fields, nulls, empty lists and lists of structs, with objects that stand at several places."""
    kind = pa.struct([("a", pa.int64()), ("w", pa.list_(pa.struct([("x", pa.string()), ("y", pa.list_(pa.string()))]))), ("t", pa.list_(pa.string()))])
    word, other = {"x": "one", "y": ["u", None]}, {"x": None, "y": []}
    rows = [{"a": 1, "w": [word, other, word], "t": ["p"]}, None, {"a": None, "w": [], "t": []}, {"a": 4}, {"a": 5, "w": [word, None, {"y": None}], "t": None}]
    found = chat._column(rows, kind)
    assert found.type == kind and found.to_pylist() == pa.array(rows, kind).to_pylist()
    assert chat._column([], kind).to_pylist() == []


def test_words_in_one_piece_are_those_token_by_token(monkeypatch):
    text = "<zero <oneˈ> [/] 0two> [//]  &-um three [: fou(r) xxx] [*] (.) a@b , “five” \x1512_34\x15 [ six ] seven] \x15 ?"
    found = chat.parse_main(text), chat.MainTier(text).problems
    monkeypatch.setattr(chat, "_PIECE", chat._TOKEN)
    assert found == (chat.parse_main(text), chat.MainTier(text).problems)
    # Unmarked words are one object: they cost one row of a column, however often they stand.
    first, second = chat.parse_main("again and again .")["words"][::2]
    assert first is second


def test_small_files_are_dealt_out_before_they_are_read(spark, capsys):
    transcripts._transcripts(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.index("split(text") < plan.index("REPARTITION_BY_COL")
