import xml.etree.ElementTree as ET
from pathlib import Path

from parlance import sinks

SCHEMA = "file string, utt_idx long, speaker string, cw array<string>"
TURNS = [("a", 1, "CHI", ["the", "dog", "<b>&\"'"]), ("a", 2, "MOT", ["the", "The"]), ("a", 3, "CHI", ["the"]), ("b c", 1, "CHI", ["été"]), ("empty", 1, "CHI", [])]
S = "{urn:schemas-microsoft-com:office:spreadsheet}"


def books(folder):
    """Rows of cells by workbook, read as XML."""
    out = {}
    for file in Path(folder).glob("book=*/part-*"):
        rows = [[c.find(f"{S}Data").text for c in r.findall(f"{S}Cell")] for r in ET.fromstring(file.read_text()).iter(f"{S}Row")]
        assert file.parent.name not in out  # one file for each book
        out[file.parent.name] = rows
    return out


def test_flat_sheets(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, SCHEMA).repartition(3)
    sinks.write_workbooks(sinks.flat_sheet(turns), str(tmp_path / "s"))
    found = books(tmp_path / "s")
    assert set(found) == {"book=a", "book=b c", "book=empty"}
    assert found["book=a"] == [["File", "Code", "Word", "Count"], ["a", "CHI", "<b>&\"'", "1"], ["a", "CHI", "dog", "1"], ["a", "CHI", "the", "2"], ["a", "MOT", "The", "1"], ["a", "MOT", "the", "1"]]
    assert found["book=empty"] == [["File", "Code", "Word", "Count"]]
    read = {(r.book, *r.cells) for r in sinks.read_workbooks(spark, str(tmp_path / "s")).collect()}
    assert read == {(b.removeprefix("book="), *cells) for b, rows in found.items() for cells in rows}


def test_wide_sheets(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, SCHEMA)
    ids = spark.createDataFrame([("a", "CHI", "eng", "2;06."), ("a", "MOT", "eng", "")], "file string, speaker string, language string, age string")
    sinks.write_workbooks(sinks.wide_sheet(turns, ids, mattr=2), str(tmp_path / "s"))
    rows = books(tmp_path / "s")["book=a"]
    assert [r[0] for r in rows[:3]] == list(sinks.CAVEAT)
    assert rows[3] == ["File", "Code", "Language", "Age", "<b>&\"'", "The", "dog", "the", "Types", "Token", "TTR", "MATTR"]
    assert rows[4][:11] == ["a", "CHI", "eng", "2;06.", "1", "0", "1", "2", "3", "4", "0.750"]
    assert rows[5][:11] == ["a", "MOT", "eng", ".", "0", "1", "0", "1", "2", "2", "1.000"]
    sinks.write_workbooks(sinks.wide_sheet(turns, words=False, of_lemmas=True), str(tmp_path / "t"))
    assert books(tmp_path / "t")["book=a"] == [["File", "Code", "Types", "Token", "TTR"], ["a", "CHI", "3", "4", "0.750"], ["a", "MOT", "2", "2", "1.000"]]
    assert not (tmp_path / "t" / "_temporary").exists() and (tmp_path / "t" / "_SUCCESS").exists()
