import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fareflow.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.cache
def _public():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def public():
    return _public()


def ids(text):
    return np.frombuffer(bpe.encoder(PATH, PATTERN).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab cdes'ther \n\t 　Éß1234567.,!?<|>日本\U0001f600\x1c\x85"), max_size=80))
def test_same_as_the_public_library(text):
    assert ids(text) == _public().encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 999, " " * 2000, "thethethe" * 200, "=" * 777 + "-" * 333, "x \n y  z ", "日本語" * 300, "1" * 500])
def test_long_matches(public, text):
    assert ids(text) == public.encode_ordinary(text)


def test_join_is_associative():
    own, rng = bpe.encoder(PATH, PATTERN).pairs, random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"aethions ") for _ in range(rng.randint(3, 60)))
        i, j = sorted(rng.sample(range(len(data) + 1), 2))
        a, b, c = (own.reduced(x) if x else [] for x in (data[:i], data[i:j], data[j:]))
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own.merged(data)
        assert own.decode(own.merged(data)) == data


def test_columns(spark, public):
    rows = [(1, "That and\nonesen  erblest"), (2, None), (None, ""), (1, "That and\nonesen  erblest"), (3, "é" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_text", F.lit(0))
    out = bpe.encode(docs, PATH, PATTERN).withColumn("back", bpe.decode_udf(PATH, PATTERN)("ids"))
    got = {(r["doc_id"], bytes(r["ids"]), bytes(r["back"])) for r in out.collect()}
    assert got == {(d, np.array(public.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows}
    assert out.count() == len(rows)
    once = bpe.encode(docs, PATH, PATTERN, decoded="back")
    assert once.columns == ["doc_id", "ids", "back"] and got == {(r["doc_id"], bytes(r["ids"]), bytes(r["back"])) for r in once.collect()}
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
    clashing = bpe.encode(docs, PATH, PATTERN, keep=("doc_id", "_text", "text"))
    assert clashing.columns == ["doc_id", "_text", "text", "ids"] and clashing.count() == len(rows)


def test_decoding_up_the_tree(public):
    text = "erblest thing " * 4000
    found = ids(text)
    assert len(found) > 4 * bpe.DECODED and bpe.encoder(PATH, PATTERN).pairs.decode(found) == text.encode()


def test_whole_query(spark, public):
    from fareflow.llm import queries

    got = {r["doc_id"]: r for r in queries.bpe_query(spark, "/root/testdata/sf0.001").collect()}
    for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect():
        want = np.array(public.encode_ordinary(r["text"] or ""), "<u4")
        own = got.pop(r["doc_id"])
        assert own["n_tokens"] == len(want) and own["ids_sha256"] == hashlib.sha256(want.tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert not got
