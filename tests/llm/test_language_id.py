import random
import zlib

import pytest
import zstandard

from parlance.llm import language_id as li

WORDS = {"en": "the and of to in is that was for with house water think great", "de": "der und die das ist nicht mit haus wasser denken groß über", "fr": "le et les des est pas avec maison eau penser grande été"}


def text(lang, n, rnd):
    return " ".join(rnd.choices(WORDS[lang].split(), k=n))


def table(spark, n=240):
    rnd = random.Random(4)
    rows = [(k, text(lang := rnd.choice(list(WORDS)), rnd.randint(20, 200), rnd), lang, "s") for k in range(n)]
    rows += [(n, None, "en", "s"), (n + 1, "", "de", "s"), (n + 2, "123 !!", "fr", "s"), (None, text("de", 40, rnd), "de", None), (5, text("fr", 5000, rnd), None, "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, docs = table(spark)
    out = li.language_table(docs).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r for r in rows[:240]}
    seen = [r for r in out if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 5]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in seen)
    held = [r for r in seen if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][2] for r in held) >= 0.98 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out if r.doc_id in (240, 241, 242))
    (null,) = [r for r in out if r.doc_id is None]
    assert null.lang_pred == "de" and null.held_out is False
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_labels_are_never_read(spark):
    rows, _ = table(spark)
    mixed = [(d, t, "xx" if d is not None and zlib.crc32(str(d).encode()) % 3 == 1 else lang, s) for d, t, lang, s in rows]
    found = li.learn((x := spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string")).where(~li.held_out("doc_id")))
    assert set(found) == set(WORDS) and x.count() == len(rows)


def test_smallest_size_wins():
    rnd = random.Random(1)
    dictionaries = {k: li.folded(text(k, 3000, rnd)) for k in WORDS}
    own = li.Classifier(dictionaries)
    for lang in WORDS:
        t = text(lang, 90, rnd)
        settings = zstandard.ZstdCompressionParameters(**li.SETTINGS)
        sizes = {}
        for k, d in dictionaries.items():
            packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)
            sizes[k] = sum(len(packer.compress(li.folded(t)[i : i + li.BLOCK])) for i in range(0, len(li.folded(t)), li.BLOCK))
        assert own.classify(t)[0] == min(sorted(sizes), key=sizes.get)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    (r,) = li.language_table(docs).collect()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert li.language_table(docs.limit(0)).count() == 0
    assert li.Classifier({"en": b"the and"}).classify("the")[0] == "en"


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        li.learn(table(spark)[1])


def test_letters_are_letters_only(spark):
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2461 12 _"), (2, "\u00bd das haus"), (3, "\u0e01\u0e33")], "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    learned = {k: li.folded(text(k, 300, random.Random(2))) for k in WORDS}
    got = {r.doc_id: r.lang_pred for r in li.predict(docs, learned).collect()}
    assert got[1] == "und" and got[2] == "de" and got[3] != "und"
    assert not li.has_letter("\u00bd \u00b2 \u2461") and li.folded("A\u00bdb_\u00b2 c") == b"a b c"


def test_whole_texts_are_learned_from(spark, monkeypatch):
    """Words far behind the beginning, a key with a third of the rows, and a bound on rows."""
    monkeypatch.setattr(li, "SAMPLE_DOCS", 20)
    rnd = random.Random(8)
    rows = [(k, "1234567890 " * 400 + text(lang, 60, rnd) + f" late{'abcdefghij'[k % 10]}", lang) for k in range(200) for lang in ("en", "de")]
    rows = [(k * 2 + i, t, lang) for i in (0, 1) for k, t, lang in rows[i::2]] + [(7, "zzz " * 50, "en")] * 300
    learned = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert set(learned) == {"en", "de"} and all(b"late" in v for v in learned.values())
    assert learned["en"].count(b"zzz") <= 50 and all(1000 < len(v) < 20 * 600 for v in learned.values())


def test_every_labelled_language_is_learned(spark, monkeypatch):
    """Languages of two keys with many rows each, and one that nearly only has rows without letters."""
    monkeypatch.setattr(li, "SAMPLE_DOCS", 20)
    rows = [(10 * k + n % 2, f"text{chr(97 + k)} word", f"l{k}") for k in range(10) for n in range(600)]
    rows += [(1000 + n, "12 34", "cc") for n in range(6000)] + [(9000 + n, f"letters {n}", "cc") for n in range(5)] + [(None, "x", "none"), (1, "5", "digits"), (1, None, "empty")]
    learned = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert set(learned) == {f"l{k}" for k in range(10)} | {"cc"}
    assert learned["cc"].count(b"letters") == 5 and all(learned[f"l{k}"].count(b"word") == 2 for k in range(10))


def test_a_text_of_megabytes(spark):
    rnd = random.Random(3)
    rows = [(1, text("en", 400_000, rnd), "en"), (2, text("de", 400, rnd), "de"), (3, text("de", 300_000, rnd), "de"), (4, text("en", 500, rnd), "en")]
    learned = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "de"} and all(len(v) <= li.DICTIONARY_BYTES for v in learned.values())
    got = {r.doc_id: r.lang_pred for r in li.predict(spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string"), learned).collect()}
    assert got == {1: "en", 2: "de", 3: "de", 4: "en"}
