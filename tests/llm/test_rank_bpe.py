"""Rank-queue BPE against the tiktoken library, on its own vocabulary and on made-up ranks."""

import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mirepoix.llm.queries import QUERIES
from mirepoix.llm.rank_bpe import RankBpe, RankQueue, decode, encode, id_array

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return RankBpe.load(*VOCABULARY)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_queue_pops_ranks_in_order():
    draw = random.Random(2)
    queue, want = RankQueue(300_000), {}
    for position in range(4000):
        rank = draw.choice([draw.randrange(300_000), draw.randrange(40)])
        queue.push(rank, position)
        want.setdefault(rank, []).append(position)
    got = []
    while (least := queue.pop()) is not None:
        got.append((least[0], least[1].tolist()))
    assert got == sorted(want.items())


def test_texts_as_the_library(own, library):
    draw = random.Random(1)
    letters = "abcdefghijklmnop  aaaaeeeetttt éß漢😀\n\t'1239-_=|<>\0"
    texts = ["".join(draw.choices(letters, k=draw.randrange(1, 200))) for _ in range(1500)]
    texts += [t.replace(" ", "") for t in texts[:500]] + ["", None, "<|endoftext|>", "  ", "a"]
    want = [packed(library.encode_ordinary(t or "")) for t in texts]
    assert own.encode(texts) == want
    assert [own.decode(w).decode() for w in want] == [t or "" for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000 + "x", "=" * 99_999, "ab" * 60_000 + "é" * 9999])
def test_very_long_pre_tokens(own, library, text):
    assert own.encode([text]) == [packed(library.encode_ordinary(text))]


def test_long_text_is_cut_into_stretches(own, library, monkeypatch):
    monkeypatch.setattr("mirepoix.llm.rank_bpe.SHORT_TEXT", 50)
    monkeypatch.setattr("mirepoix.llm.rank_bpe.AT_ONCE", 7)
    texts = ["one two  three " * n for n in (1, 40, 3, 90)]
    assert own.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_any_ranks(seed):
    """Ranks in no order that training could give, so that merges make pairs of lower ranks."""
    draw = random.Random(seed)
    tokens = ["".join(t) for n in (2, 3, 4, 5) for t in itertools.product("abc", repeat=n)]
    tokens = [t.encode() for t in draw.sample(tokens, 60)]
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
    own = RankBpe(ranks, "[a-c]+|[^a-c]+")
    library = tiktoken.Encoding("made", pat_str="[a-c]+|[^a-c]+", mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join("".join(draw.choices("abc", k=draw.choice([3, 9, 200]))) for _ in range(30)) for _ in range(20)]
    assert own.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        RankBpe({b"a": 0}, ".+")


def test_edges_and_clashing_names(spark, documents):
    rows = [(1, None), (2, ""), (3, "hello hello"), (3, "hello hello"), (4, "x" * 70_000)]
    df = documents(*rows).withColumnsRenamed({"n": "a.b", "source": "id"}).withColumn("__text", F.col("doc_id"))
    coded = decode(encode(df, *VOCABULARY), *VOCABULARY)
    got = sorted((r.doc_id, bytes(r.decoded).decode(), len(r.ids) // 4) for r in coded.collect())
    assert [(i, t) for i, t, _ in got] == [(i, t or "") for i, t in rows]
    assert got[0][2] == got[1][2] == 0
    renamed = encode(df, *VOCABULARY).withColumnsRenamed({"ids": "c0", "doc_id": "a.b"}).withColumn("decoded", id_array("c0"))
    back = decode(renamed, *VOCABULARY, ids_col="c0")
    assert back.columns == ["a.b", "c0", "decoded"] and back.count() == 5
    assert encode(df.filter("doc_id > 9"), *VOCABULARY).count() == 0


def test_id_array(spark, documents, library):
    text = "ids of several bytes: é漢 12345"
    got = encode(documents((1, text), (2, "")), *VOCABULARY).select("doc_id", id_array("ids").alias("a")).collect()
    assert {r.doc_id: r.a for r in got} == {1: library.encode_ordinary(text), 2: []}


def test_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op13_rank_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, row = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
