"""BPE against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from ledgerlens.llm import bpe  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_matches_the_library(spark, reference):
    r = np.random.default_rng(7)
    texts = [None, "", " ", "don't  stop\n\n", "the the", "a" * 3000, "naïve übergrößen ñandú 北京 👍🏽", "=" * 700,
             "x" * 64, "x" * 65, "<|endoftext|>", "   tab\t", "0123456789" * 90,
             "".join(r.choice(list("abcdefghé "), 4000)), "".join(r.choice(list("etaoinsh"), 2000))]
    texts += ["".join(r.choice(list("abcstionghéñ 12.,'\n"), r.integers(1, 60))) for _ in range(200)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "null id", ""), (3, texts[3], "again")]
    out = bpe.digests(spark.createDataFrame(rows, SCHEMA), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for k, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_real_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for d in docs.collect():
        ids = reference.encode_ordinary(d.text)
        assert out[d.doc_id].n_tokens == len(ids)
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words(reference):
    """Words of 10^6 equal and 10^5 random letters, and many of mixed kinds, in bounded memory."""
    r = np.random.default_rng(4)
    coder = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    ids = np.frombuffer(coder.encode(["a" * 10**6])[0], dtype="<u4")
    assert ids.tolist() == reference.encode_ordinary("aaaa") * 250_000
    texts = ["".join(r.choice(list("etaoinshrdlu"), 10**5)), "a" * 9_999, "the" * 3_001, "".join(r.choice(["tion", "ing", "str", "a", "qz"], 2_000)),
             "".join(r.choice(list("éñü北京a"), 3_000)), "=" * 5_001]
    texts += ["".join(r.choice(list(letters), int(r.integers(250, 900)))) for letters in ("abc", "aab", "0", "xyzé", "etaoinsh") for _ in range(30)]
    codes = coder.encode(texts)
    assert [np.frombuffer(c, dtype="<u4").tolist() for c in codes] == [reference.encode_ordinary(t) for t in texts]
    assert coder.decode(codes) == [t.encode() for t in texts]


def test_full_memory_keeps_the_words_at_hand(monkeypatch):
    """The words of the texts at hand are not encoded again when the memory is full."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258}
    monkeypatch.setattr(bpe, "MEMO", 2)
    coder = bpe.Coder(ranks, r"[a-z]+", bpe.merge_table(ranks))
    learnt, learn = [], coder.learn
    coder.learn = lambda words: (learnt.append(set(words)), learn(words))
    texts = (["abababa bab", "", "aab"], ["aab bbb"], [""], ["aab bab"])
    got = [coder.encode(x) for x in texts]
    assert learnt == [{"abababa", "bab", "aab"}, {"bbb"}, set(), {"bab"}]
    want = [[[257, 256, 97], [98, 256], [97, 256]], [[97, 256], [98, 98, 98]], [], [[97, 256], [98, 256]]]
    flat = [np.frombuffer(b"".join(x), dtype="<u4").tolist() for x in got]
    assert flat == [[t for word in w for t in word] for w in want]
    assert [len(x) // 4 for x in got[0]] == [5, 0, 2]
