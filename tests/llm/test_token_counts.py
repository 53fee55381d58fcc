import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from parlance.llm import token_counts as tc


def greedy(word, first, later):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_against_greedy_and_library():
    random.seed(3)
    for _ in range(200):
        first = {"".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(6)}
        later = {"".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(6)}
        own = tc.LongestMatch(first, later)
        vocab = {t: i for i, t in enumerate(["[UNK]", *sorted(first), *("##" + x for x in sorted(later))])}
        library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000))
        library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        for _ in range(60):
            word = "".join(random.choices("abcd" if random.random() < 0.1 else "abc", k=random.randint(1, 12)))
            want = greedy(word, first, later)
            assert own.count(word) == want
            got = library.encode(word).tokens
            assert (-1 if got == ["[UNK]"] and want == -1 else len(got)) == want


def test_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    first, later = tc.pieces_of(open(path, encoding="utf-8").read())
    texts = ["The cat_sat, éèß 日本 12345!", None, "", "x" * 2000, "The cat", "The cat"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string")
    out = {r.doc_id: r for r in tc.count_tokens(docs, path).collect()}
    for i, t in enumerate(texts):
        counts = [greedy(tc.pretokens.spelled(w), first, later) for w in tc.WORDS.findall(t or "")]
        assert out[i].n_words == len(counts)
        assert out[i].n_unknown == counts.count(-1)
        assert out[i].n_tokens == sum(1 if c < 0 else c for c in counts)
    assert tc.count_tokens(docs.limit(0), path).count() == 0
