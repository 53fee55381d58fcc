import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlance.llm import pretokens
from parlance.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """Every pair of tokens of a text compared by where they end."""
    first, second = libraries
    texts, links, counts = [], [], Counter()
    for _, text in rows:
        want = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(pretokens.BYTE_OF[c] for c in first.id_to_token(x)) for x in a]
        names = [second.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in names]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            texts.append(([], [], []))
            links.append([])
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(bytes_a), ends(bytes_b)
        cuts = sorted(set(ea) & set(eb))
        groups, before = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, e in zip(a, ea) if before < e <= cut) + "|" + ",".join(str(x) for x, e in zip(b, eb) if before < e <= cut))
            before = cut
        texts.append((a, b, groups))
        links.append([(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f])
        counts.update(links[-1])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (doc_id, _), (a, b, groups), own in zip(rows, texts, links, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), digest))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def some_rows():
    rnd = random.Random(4)
    pools = ["abcdefghij aeiou ", "the and ing tion .,'s 0123456789\n\t", "éèüßñçœ日本語🙂  ́ ", "aaaaa  bb", "<|endoftext|> <s> </s> <0x41> <unk>"]
    rows = [(k, "".join(rnd.choices(p, k=rnd.randint(1, 150)))) for k, p in enumerate(pools * 12)]
    rows += [(None, "the cat"), (None, None), (3, ""), (3, " "), (3, "  x"), (3, "a\r\nb"), (4, "x▁y"), (4, "ﬁ ½"), (4, "\x00a"), (5, "the cat"), (5, "the cat"), (6, "the " * 400), (7, "é"), (8, "x" * 3000), (9, "a" + "\n " * 2000 + "b")]
    return rows


def test_query_against_plain_version(spark, libraries):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int")
    out = [tuple(r) for r in ta.alignment_digests(docs, A, B).collect()]
    want = plain(rows, libraries)
    assert ordered(out) == ordered(want)
    assert any(r[4] > r[5] > 0 for r in want) and any(not r[1] for r in want)
    assert ta.alignment_digests(docs.limit(0), A, B).count() == 0


def test_rare_pairs_by_shuffle(spark, libraries, monkeypatch):
    """With a bound of five pairs most are joined by a shuffle; the result is the same."""
    monkeypatch.setattr(ta, "HOT", 5)
    rows = some_rows()
    out = [tuple(r) for r in ta.alignment_digests(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()]
    assert ordered(out) == ordered(plain(rows, libraries))


def test_groups_as_text(spark):
    row = ta.align(spark.createDataFrame([(1, "The cat sat. Naïve!")], "doc_id long, text string"), A, B).first()
    groups = [[side.split(",") for side in g.split("|")] for g in row.groups.split(";")]
    assert len(groups) == row.n_groups == row.n_links
    assert (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups)) == (row.n_a, row.n_b)
    assert row.n_best_a <= row.n_links and row.count_sum >= row.n_links


def test_ends_of_long_texts_are_arrays():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 200_000):
        a, b = (np.unique(rng.integers(1, 3 * size + 2, size)) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        at_a, at_b = ta._both_end(a, b)
        assert a[at_a - 1].tolist() == b[at_b - 1].tolist() == both
    spelled = ta.Tokens(lambda text: [0, 1], [b" ", b"ab"])
    assert spelled("ab").tolist() == [0, 1] and spelled("abc") is None and spelled("") is None and spelled(None) is None
    assert isinstance(spelled.ends(spelled("ab")), np.ndarray)


def test_merge_of_ends():
    assert ta.merge([1, 4, 6, 9], [2, 4, 9]) == ([2, 4], [2, 3])
    assert ta.merge([], [1]) == ta.merge([1], []) == ([], [])
    assert ta.merge([3], [1, 2, 3]) == ([1], [3])
    assert ta.merge([1, 2, 5], [1, 3]) == ([1], [1])


def test_very_long_text(spark, libraries):
    first, second = libraries
    text = " ".join(f"word{k % 5000} über" for k in range(120_000))
    row = ta.alignment_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert (row.n_a, row.n_b) == (len(first.encode(" " + text, add_special_tokens=False).ids), len(second.encode(text)))
    assert 0 < row.n_links <= row.n_a and row.count_sum > row.n_links


def test_both_ways_to_byte_level_ids():
    """Merges out of the order of ids go by the other encoder; ids are the same but for their names."""
    spec = json.loads(open(A, encoding="utf-8").read())
    plain = ta._byte_level(json.dumps(spec))
    vocabulary = spec["model"]["vocab"]
    top = max(vocabulary.values())
    spec["model"]["vocab"] = {k: top - v for k, v in vocabulary.items()}
    spec["added_tokens"] = []
    other = ta._byte_level(json.dumps(spec))
    for text in ["the cat", "<|endoftext|>x", "", "Ünï 日本 \n\n x", " " * 5000 + "z"]:
        assert [top - x for x in other.encode(text)] == plain.encode(text)
