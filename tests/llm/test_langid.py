import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fareflow.llm import langid, queries


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, path, "documents").collect()}
    got = queries.language_id_query(spark, path).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)


def test_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    net = langid.train([b"the and of" * 9, b"der die das" * 9] * 8, ["en", "de"] * 8, epochs=1)
    x = rng.integers(0, langid.N_CLASSES, (5, langid.WINDOW))
    e, last = net.embedding[x], langid.WINDOW - langid.WIDEST + 1
    plain = sum(e[:, k : k + last] @ net.filters[k] for k in range(langid.WIDEST)).max(axis=1)
    pairs = np.vstack([(x[:, :-1] * langid.N_CLASSES + x[:, 1:]).T])
    assert np.allclose(langid._pooled(pairs, *net.tables()), plain, atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 .. \n", None), (4, "the and of that with " * 9, "en"), (None, "der die und das nicht " * 9, "de"), (4, "the and of that with " * 9, "en"), (6, "der und die " * 30_000, "de"), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "_found": F.lit(1), "_FOUND2": F.lit(2)})
    net = langid.fit(docs)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows) and all(r["_found"] == 1 and r["_FOUND2"] == 2 for r in got)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[None][0] == by[6][0] == "de" and by[7][0] in ("en", "de")
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def plain(net, text):
    """By plain convolution of each window in turn."""
    data, stride = text.encode(), langid.WINDOW - langid.WIDEST + 1
    total = np.zeros(len(net.labels))
    for at in range(0, max(1, len(data) - langid.WIDEST + 1), stride):
        x = np.zeros(langid.WINDOW, int)
        part = [int(langid.CLASSES[b]) for b in data[at : at + langid.WINDOW]]
        x[: len(part)] = part
        e = net.embedding[x]
        sums = sum(e[k : stride + k] @ net.filters[k] for k in range(langid.WIDEST))
        z = np.maximum(sums.max(axis=0) + net.bias, 0) @ net.dense + net.dense_bias
        p = np.exp(z - z.max())
        total += p / p.sum() * sum(c >= 4 for c in part)
    return total / total.sum()


def test_query_against_plain_convolution(spark):
    path = "/root/testdata/sf0.001"
    docs = queries.table(spark, path, "documents")
    net, texts = queries.language_model(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.language_id_query(spark, path).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == (langid.UNKNOWN, 0.0)
            continue
        p = plain(net, text)
        assert abs(p.max() - r["score"]) < 1e-3 and p[net.labels.index(r["lang_pred"])] > p.max() - 1e-3


def test_sample_is_bounded_by_distinct_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(n=Counter(labels)))
    copies = [(f"only one text of label {k % 20}", f"l{k % 20:02}") for k in range(8000)]
    many = [(f"text number {k} of the last label", "many") for k in range(5000)]
    langid.fit(spark.createDataFrame(copies + many, "text string, lang string"))
    assert {k: n for k, n in seen["n"].items() if k != "many"} == {f"l{k:02}": 1 for k in range(20)}
    assert 1400 <= seen["n"]["many"] <= 1500
