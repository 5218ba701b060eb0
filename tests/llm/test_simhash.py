import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fareflow.llm import common, queries, simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """By doc_id: the least id reachable; compares all pairs."""
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    while True:
        low = np.array([label[near[k]].min() for k in range(len(ids))])
        if (low == label).all():
            return {i: ids[k] for i, k in zip(ids, label, strict=True)}
        label = low


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    docs = queries.table(spark, f"/root/testdata/{sf}", "documents").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    parts = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.simhash_query(spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "One TWO"), (7, "one\x0btwo"), (None, "one two"), (8, "é" * 50_000), (8, "é" * 50_000), (1, "Ünter den 　 Linden a b"), (6, "ünter den 　 linden a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "component_id": F.lit(0), "root": F.lit(1)})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["component_id"] for i in (3, 4, 5)] == [3, 3, 3] and by[3]["fp"] == 0
    assert by[9]["component_id"] == by[7]["component_id"] == by[None]["component_id"] == 7
    for d, t in rows:
        assert by[d]["fp"] & (1 << 64) - 1 == plain_fingerprint(t)
    assert by[1]["fp"] != by[6]["fp"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [4, 40, 5000])
def test_dense_groups_over_many_leaves(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(150)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["component"] for r in common.components(simhash.fingerprint_links(frame)).collect()}
    want = plain_components({x: x & (1 << 64) - 1 for x in signed})
    assert {x: got.get(x, x) for x in signed} == want


def test_tree_finds_all_and_prunes():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    x = np.unique(np.r_[x, x[:3000] ^ np.uint64(1 << 40), x[:3000] ^ np.uint64((1 << 63) + 2)])
    x = x[np.argsort(simhash.gray_rank(x))]
    tree = simhash.GrayTree(x, np.full(len(x), simhash.ALL))
    i, j = tree.reach(x[:2000])
    assert set(zip(i.tolist(), j.tolist())) == {(k, int(m)) for k in range(2000) for m in np.flatnonzero(np.bitwise_count(x[k] ^ x) <= 2)}
    assert tree.compared < 0.1 * 2000 * len(x)


def test_whole_leaves_are_pruned():
    x = np.random.default_rng(6).integers(0, 1 << 63, 64 * 128, dtype=np.uint64)
    x = np.unique(x)[np.argsort(simhash.gray_rank(np.unique(x)))]
    leaves = np.arange(0, len(x), 16)
    ones, any_ = np.bitwise_and.reduceat(x, leaves), np.bitwise_or.reduceat(x, leaves)
    batch = pa.RecordBatch.from_arrays([pa.array((np.arange(len(x)) // 16).astype(np.int32)), pa.array(x.view(np.int64))], ["leaf", "fp"])
    sent = sum(int((~np.asarray(b["own"])).sum()) for b in simhash._routed(np.arange(len(leaves)), ones, ~(ones ^ any_), iter([batch])))
    assert 0 < sent < 0.2 * len(x) * len(leaves) / 2


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
