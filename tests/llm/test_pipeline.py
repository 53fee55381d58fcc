import hashlib
import random
import re
from itertools import combinations

import public_tokenizers
from test_decontamination import contains
from test_jaccard_join import near_copies, roots, shingle_set
from tokenizers import Tokenizer

import corpus_pipeline
from parlance.llm import language_id as li

ENGLISH = "the and of to in is that was for with house water think great over under from many people work river stone".split()
GERMAN = "der und die das ist nicht mit haus wasser denken gross ueber viele leute arbeit fluss stein unter von auch".split()


def plain(rows, items, dictionaries):
    classify = li.Classifier(dictionaries).classify
    rows = [r for r in rows if not classify(r[1])[2]]
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    rows = sorted(best.values())
    sets = [shingle_set(t, 5) for _, t, *_ in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = [r for k, r in enumerate(rows) if roots(len(rows), links)[k] == k]
    rows = [r for r in rows if not any(contains(r[1], i) for _, i in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t, *_ in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_against_plain_version(spark, tmp_path):
    rnd = random.Random(6)
    item = " ".join(rnd.choices(ENGLISH, k=30))
    texts = [(" ".join(rnd.choices(w, k=rnd.randint(12, 120))), lang) for _ in range(60) for w, lang in ((ENGLISH, "en"), (GERMAN, "de"))]
    texts += [(t.replace("w", "the w"), "en") for t in near_copies(rnd, 6, 6, [40, 90])]
    texts += [texts[k] for k in range(0, 40, 3)] + [(texts[k][0].replace(" ", "  "), "en") for k in range(0, 30, 4)]
    texts += [(f"{texts[k][0]} {item} {texts[k + 1][0]}", "en") for k in range(5)] + [("12345 !!", None), ("", "en")]
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dictionaries = li.learn(docs.where(~li.held_out("doc_id")))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = plain(rows, [(1, item)], dictionaries)
    assert got == want and 80 < len(want) < len(rows) - 20


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid long, lang_pred string"
    rows = [(None, None, None, None, None, 1, "x"), (1, "the house of the people is great and the water is with the river", "en", "s", 3, 1, "y")] * 2
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= len(given)
