import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fareflow.llm import queries, token_files
from fareflow.llm.common import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, SHARED = Tokenizer.from_file(PATH), token_files.Encoder(PATH)


def plain(texts):
    own = Tokenizer.from_file(PATH)
    return [[*x.ids, 2] for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_against_the_library(spark):
    rows = sorted(queries.table(spark, "/root/testdata/sf0.01", "documents").collect(), key=lambda r: r["doc_id"])
    start, want = 0, []
    for r, ids in zip(rows, plain(r["text"] for r in rows), strict=True):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.token_files_query(spark, "/root/testdata/sf0.01").collect())) == want


def test_odd_rows(spark, tmp_path):
    texts = ["a  b \n c", None, "", " x", "x ", "<|endoftext|> y", "w " * 20_000, "a  b \n c", "  z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, None).when(F.col("doc_id") == 3, 2).otherwise(F.col("doc_id")))
    docs = docs.withColumn("start", F.lit("clash")).repartition(3)
    folder = token_files.write(docs, PATH, 2, f"file://{tmp_path}/files", length=16)
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 2, 4, 5, 6, 8]
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(plain(texts))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_fixed_size_lists(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string").coalesce(1)
    token_files.write(docs, PATH, 2, f"file://{tmp_path}/files", length=8)
    n = 0
    for path in tmp_path.glob("files/*.arrow"):
        with pa.memory_map(str(path)) as source:
            table = pa.ipc.open_file(source).read_all()
            assert table.schema.field("tokens").type.list_size == table.schema.field("mask").type.list_size == 8
            n += int(np.sum(table["mask"].combine_chunks().flatten().to_numpy(zero_copy_only=False)))
    assert n == sum(map(len, plain(["some words here"] * 50)))


def test_encoder_against_the_library():
    own = Tokenizer.from_file(PATH)
    texts = [
        "hello", "", " ", "\n", "a\nb c\n\nd. e\n\n\nf g", "\n x", "x\n", "x \n", "a\tb c\td", "a\r\nb c", "don't won't' x'", "Wort,*** zwei.## 12.%% x)) y$", "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>",
        "\u00a0a b\u00a0c", "a\u2003 b", "a\x1cb c", "日本語 です\n日本", "é è. ö,\nü", "x\n\ny\n", " lead\ntwo", "tail ", "Ġ Ċ Ġa b", "\n\n", "a \u0301b c\u0301. d",
    ]
    for some in (texts, texts[::-1], [texts[0]] * 600, [""] * 3, *([t] for t in texts)):
        encoder = token_files.Encoder(PATH)
        for _ in range(2):  # the second time from the memo
            got = encoder.encode(some)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in some]


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r.,'!$aBéĠ1中<|>\u00a0\u0301"), max_size=12), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_on_any_text(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in SHARED.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_little_memo(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 5)
    encoder = token_files.Encoder(PATH)
    for some in ["one two three. four"], ["two five six"], ["one seven, two"], ["three four five six seven eight"]:
        assert np.frombuffer(encoder.encode(some)[0], "<u4").tolist() == LIBRARY.encode(some[0], add_special_tokens=False).ids


def test_copies_and_nulls(spark, tmp_path):
    texts = ["some words here"] * 600 + [None] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = token_files.read(spark, token_files.write(docs, PATH, 2, f"file://{tmp_path}/files")).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == plain(texts)


def test_slices_by_size():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 30, "", "c", "d" * 5]})
    assert [s.num_rows for s in slices(batch, 0, 2, 100)] == [2, 2, 2]
    assert [s.num_rows for s in slices(batch, 0, 9, 12)] == [2, 1, 3]
    assert [*slices(batch.slice(0, 0), 0)] == []


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.write(docs, PATH, 2, f"file://{tmp_path}/files")).count() == 0
