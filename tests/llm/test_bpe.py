import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(both):
    own, library = both
    random.seed(5)
    pools = ["abcdefghij aeiou ", "the and ing tion .,'s 0123456789\n\t", "éèüßñçœ日本語🙂  ́", "aaaaa  bb", "<|endoftext|> "]
    texts = ["", " ", "  x", "a\n\n b", "don't they'll 'S", "x" * 3000, "<|endoftext|>a<|endoftext|>", "<|endoftext", "\x00\x1c\x85a", "²³¼ 12²"]
    texts += ["".join(random.choices(p, k=random.randint(1, 400))) for p in pools for _ in range(120)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_rows_nulls_and_extra_columns(spark, both):
    own, _ = both
    rows = [(1, "the cat", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "é" * 5000 + " the", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_digests(docs, PATH).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.n_tokens) for r in out}
    assert (None, 0) in by and (2, 0) in by
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.ids_sha256, r.decoded_sha256) == (empty, empty) for r in out if not r.n_tokens)
    full = bpe.encode_documents(docs, PATH, decoded="back").collect()
    assert all(r.back == (r.text or "") and r.ids == own.encode(r.text or "") for r in full)
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}}, {"added_tokens": {"lstrip": True}}])
def test_other_tokenizers_are_refused(change):
    doc = json.loads(open(PATH, encoding="utf-8").read())
    for key, value in change.items():
        if key == "added_tokens":
            doc[key][0] |= value
        else:
            doc[key] = doc[key] | value if key == "model" else value
    with pytest.raises(ValueError, match="not supported"):
        bpe.Encoder(json.dumps(doc))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "x")], "doc_id long, text string, IDS string")
    out = bpe.encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "text", "IDS", "ids_"] and out.first().IDS == "x"


def test_worker_lets_go_of_the_encoder(spark):
    """Workers outlive stages: an encoder stays for the next task of its own operator, not beside the work of others."""

    def held(batches):
        import gc

        import pyarrow as pa

        from parlance.llm.bpe import Encoder

        for batch in batches:
            found = sum(isinstance(x, Encoder) for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows, pa.int64())], ["n"])

    rows = spark.range(8).selectExpr("id AS doc_id", "'some words' AS text").repartition(4)
    bpe.encode_documents(rows, PATH).select("ids").collect()
    assert spark.range(4).repartition(4).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 1
    common.mapped(spark.range(64).repartition(8), held, "n long").collect()
    assert common.mapped(spark.range(64).repartition(8), held, "n long").agg({"n": "max"}).first()[0] == 0
