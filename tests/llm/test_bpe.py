import base64
import os
import random

import pytest
import tiktoken

from vellum.llm import bpe

from conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "\n\n  x", "a" * 5000, "ё" * 700, " " * 900, "Le café, 2-й актъ — 1898–99 🎭🎭", "<|endoftext|> x", "don't we'll I'VE", "\u0000​﻿", "漢字かな", "ⅩⅣ ½", "tab\tnew\r\nline "]


def test_hard_texts(reference):
    enc = bpe.text_encoder()
    for t in HARD:
        assert enc.encode(t) == reference.encode_ordinary(t), t[:20]
    assert enc.encode(None) == []


def test_corpus(spark, reference):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = bpe.encode_corpus(docs, "doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == (reference.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])


def test_append_and_edit(reference):
    enc, rnd = bpe.text_encoder().encoder, random.Random(3)
    data = b""
    table = bpe.PieceTable(enc)
    for _ in range(60):
        more = bytes(rnd.choice(b"abcdeflmnost -") for _ in range(rnd.randrange(9)))
        table.append(more)
        data += more
        assert table.ids() == enc.encode_bytes(data) if data else table.ids() == []
    for _ in range(60):
        a = rnd.randrange(len(data) + 1)
        b = rnd.randrange(a, min(len(data), a + 6) + 1)
        new = bytes(rnd.choice(b"abcdefg ") for _ in range(rnd.randrange(5)))
        table.edit(a, b, new)
        data = data[:a] + new + data[b:]
        fresh = bpe.PieceTable(enc, data)
        assert table.last == fresh.last and table.ids() == fresh.ids()


def test_reencode_near_edit(reference):
    enc, rnd = bpe.text_encoder(), random.Random(4)
    before = "The running total disagrees with the printed one by 38; no correction was made. " * 4
    ids = enc.encode(before)
    for _ in range(50):
        a = rnd.randrange(len(before))
        after = before[:a] + rnd.choice(["", "x", " ", "ъ", "  \n"]) + before[a + rnd.randrange(4) :]
        assert enc.reencode(before, ids, after) == reference.encode_ordinary(after)


def test_repeats_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "", 4), (2, "a b", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df, "doc_id", "text").collect()) == [(1, []), (1, []), (2, [64, 275])]
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").collect() == []
    assert [r.n_tokens for r in bpe.token_counts(df, ["doc_id"], "text").orderBy("doc_id", "n_tokens").collect()] == [0, 0, 2]
