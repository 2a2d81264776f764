import base64
import os
import random

import pytest
import tiktoken

from tallywright.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary")
TEXTS = ["", None, " ", "\n\n  x", "it's 1234 !!! I'LL we've", "aaaaaaaaaaaaaa aaaaa", "ab" * 3000, " " * 500, "日本語のテキスト 🎓🎓", "<|endoftext|>", "é é ​﻿", "\x00\x01", "MiXeD_case-and/paths.com?x=1", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_tokenizers(spark, public):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcde fghij  ÀÉ12.,\n") for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["".join(rng.choice("abcdefghij") for _ in range(3000))]
    df = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id long, text string, out string")
    got = {r["doc_id"]: r["ids"] for r in K.encode(df).collect()}
    assert len(got) == len(texts)
    for n, t in enumerate(texts):
        assert got[n] == public.encode_ordinary(t or ""), repr(t)
        assert public.decode(got[n]) == (t or "")
    lengths = {r["doc_id"]: r["n_tokens"] for r in K.encode(df, lengths_only=True).collect()}
    assert lengths == {n: len(i) for n, i in got.items()}


def test_repeated_rows_empty_tables_and_forgetting(spark, public, monkeypatch):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["ids"]) for r in K.encode(df).collect()) == [("1", public.encode_ordinary("same"))] * 2 + [("None", public.encode_ordinary("x"))]
    assert K.encode(df.limit(0)).collect() == []
    monkeypatch.setattr(K, "REMEMBERED", 3)
    e = K.Encoder(K.Vocabulary.read())
    for t in ("one two three four five", "six seven", "one six nine"):
        assert e.encode([t])[0].tolist() == public.encode_ordinary(t)


def test_decoding_gives_the_text(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["bytes"]).decode() for r in K.decode(K.encode(df)).collect()}
    assert got == {n: t or "" for n, t in enumerate(TEXTS)}
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["bytes"]) for r in K.decode(empty).collect()] == [b"", b""] and K.decode(empty.limit(0)).count() == 0
    for bad in ([-1], [10**7], [None]):
        with pytest.raises(Exception, match="vocabulary"):
            K.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>")).collect()
