import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.randoms(use_true_random=False))
def test_packing_round_trip(bits, n, rnd):
    ids = np.array([rnd.randrange(1 << bits) for _ in range(n)], np.uint32)
    data = tf.pack(ids, bits)
    assert len(data) == -(-n // 64) * 8 * bits
    assert (tf.unpack(data, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [7, 16, 17])
def test_file_random_access(tmp_path, bits, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 128)
    random.seed(bits)
    docs = [(k if k % 5 else None, np.array([random.randrange(1 << bits) for _ in range(random.choice([0, 1, 50, 700]))], np.uint32)) for k in range(40)]
    out = tf.Writer(f"{tmp_path}/a/x.bin", bits)
    for d, ids in docs:
        out.add(d, ids)
    assert out.close() == 40
    reader, every = tf.Reader(f"{tmp_path}/a/x.bin"), np.concatenate([ids for _, ids in docs])
    for _ in range(50):
        a = random.randrange(len(every))
        b = random.randrange(a, len(every) + 1)
        assert (reader.ids(a, b) == every[a:b]).all()
    back = list(reader.documents(300))
    assert [x[0] for x in back] == [d for d, _ in docs]
    assert all((x[2] == ids).all() for x, (_, ids) in zip(back, docs, strict=True))


def test_same_ids_as_the_library():
    own, library = tf.WordTokenizer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    random.seed(2)
    pools = ["abc DEF 12'sÉÜß.,_-\n", "é ́ẞİ日本²½ \x85\x1cK", "<|endoftext|> x"]
    texts = ["", " ", "İx", "don't", "<|endoftext|>#", "x" * 500, "É"] + ["".join(random.choices(p, k=random.randint(1, 99))) for p in pools for _ in range(150)]
    assert [x.tolist() for x in own.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_a_table(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(k * 7 % 50, f"word{k} the cat's é {'x' * k}", "q") for k in range(50)] + [(None, None, "z"), (7, None, None), (7, "", None), (60, "b", None), (60, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START string").repartition(5)
    got = [tuple(r) for r in tf.read_token_files(tf.write_token_files(docs, PATH, 2)).collect()]
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.read_token_files(tf.write_token_files(docs.limit(0), PATH, 2)).count() == 0


def test_many_empty_texts_and_null_ids(spark, monkeypatch):
    """Files end by documents too, and rows of one doc_id, or of one row repeated, are spread over tasks."""
    monkeypatch.setattr(tf, "FILE_DOCS", 2000)
    docs = spark.range(0, 30_000, 1, 6).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "if(id % 2 = 0, '', concat('w', id % 5000)) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tf.write_token_files(docs, PATH, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = files.collect()
    assert sum(r.n_docs for r in listed) == 30_000 and max(r.n_docs for r in listed) <= 2000
    by_shard = {}
    for r in listed:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n_docs
    assert max(by_shard.values()) < 15_000
    got = sorted(map(tuple, tf.read_token_files(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_words_that_the_library_cuts(monkeypatch):
    own, library = tf.WordTokenizer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    own._ends[:] = True  # as if every token ended a word
    assert [x.tolist() for x in own.encode_batch(["unbelievable things", "x"])] == [library.encode(t, add_special_tokens=False).ids for t in ("unbelievable things", "x")]
