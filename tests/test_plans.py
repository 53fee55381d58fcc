import os

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.operators.filters import Filters
from parlance.plans import catalog
from parlance.plans.commands import COMMANDS, Request
from parlance.plans.flags import rewritten
from parlance.sources.tables import conversation_turns, read
from parlance.streaming.windows import codes_by_window, sessions

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize(
    "given,want",
    [
        ("freq +tCHI -t*MOT +t%mor: +s@words.cut -sfoo x.cha", "freq --speaker CHI --exclude-speaker MOT --tier mor --include-word-file words.cut --exclude-word foo x.cha"),
        ("freq +t#Mother +t@ID=eng|* +z10-20 +k +r6 +re +u", "freq --role Mother --id-filter eng|* --range 10-20 --case-sensitive --include-retracings"),
        ("freq +d2 +d20 +d<=50 +c +c1 +c3 +o +o1 +b25 +x>3w +xxxx -xfoo", "freq --spreadsheet wide --spreadsheet flat --speaker-percentage <=50 --capitalization initial --capitalization mid --any-order --sort frequency --sort reverse-concordance --mattr 25 --utterance-length >3w --restore xxx --length-exclude foo"),
        ("mlu -t%mor +t* +sxxx -sxxx +gum", "mlu --words --combine-speakers --include-xxx -sxxx --exclude-solo-word um"),
        ("combo +sa+b -s@x +g7 +w2 -w1", "combo --search a+b --exclude-search-file x --dedupe-matches --context-after 2 --context-before 1"),
        ("chat2srt +v a.cha", "chat2vtt a.cha"),
        ("fixbullets -o500", "fixbullets --offset -500"),
        ("wdsize +w>4", "wdsize --length-filter gt:4"),
        ("freq --format csv -- +tCHI", "freq --format csv -- +tCHI"),
        ("check +e6 -e7 +g5 +g1 +u", "check --error 6 --exclude-error 7 --check-unused --check-ud"),
        ("freq +g +q9", "freq +g +q9"),
    ],
)
def test_flags(given, want):
    assert rewritten(given.split()) == want.split()


def test_requests(spark):
    turns = conversation_turns(read(spark, FOLDER, "conversations"))
    whole = Request("freq").run(turns).agg(F.sum("count")).first()[0]
    assert Request("freq", per_file=True).run(turns).agg(F.sum("count")).first()[0] == whole
    assert Request("freq", Filters(speakers=["nobody"])).run(turns).count() == 0
    assert Request("kwal", Filters(range=(1, 2)), {"keywords": ["*"]}).run(turns).agg(F.max("utt_idx")).first()[0] == 2
    for bad in (Request("mor"), Request("nope"), Request("kwal"), Request("gemfreq")):
        with pytest.raises((ValueError, NotImplementedError)):
            bad.run(turns)
    assert len(COMMANDS) >= 30
    empty = turns.limit(0)
    for name in ("freq", "mlu", "mlt", "maxwd", "freqpos", "cooccur", "dist", "chip", "corelex", "gemlist"):
        Request(name).run(empty).collect()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return out


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return round(float(value), 5) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries(spark, con, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    got = sorted((str([plain(r[c]) for c in names]) for r in found.collect()))
    if name not in catalog.ORACLES:
        assert got
        return
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert got == sorted(str([plain(dict(zip(columns, r, strict=True))[c]) for c in names]) for r in result.fetchall())


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    for make, keys in ((codes_by_window, ["start", "code", "count"]), (sessions, ["start", "end", "user", "count"])):
        batch = sorted(map(str, make(events, late="400 days").select(*keys).collect()))
        stream = make(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), late="400 days")
        query = stream.select(*keys).writeStream.format("memory").queryName(make.__name__).outputMode("complete" if make is codes_by_window else "append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        if make is codes_by_window:
            assert sorted(map(str, spark.table(make.__name__).collect())) == batch
        assert query.exception() is None and batch
