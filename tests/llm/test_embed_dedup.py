import numpy as np
import pytest
from pyspark.sql import functions as F

from fareflow.llm import embed_dedup, queries


def plain(rows, t=embed_dedup.THRESHOLD):
    """rows: (vec_id, vector, label); compares all pairs."""
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n, link = len(good), {}
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in good]
    edges = [(i, j) for i in range(n) for j in range(i) if good[i][2] == good[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t]
    label = {r[0]: r[0] for r in rows if r[0] is not None}
    count = dict.fromkeys(range(n), 0)
    for i, j in edges:
        count[i] += 1
        count[j] += 1
    for _ in range(n):
        for i, j in edges:
            low = min(label[good[i][0]], label[good[j][0]])
            if label[good[i][0]] == label[good[j][0]] == low:
                continue
            label[good[i][0]] = label[good[j][0]] = low
            link["changed"] = True
        if not link.pop("changed", False):
            break
    links = {good[i][0]: c for i, c in count.items()}
    return {i: (links.get(i, 0), c, i == c) for i, c in label.items()}


def test_query_against_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.table(spark, path, "embeddings").collect()]
    got = {r["vec_id"]: tuple(r)[1:] for r in queries.embedding_query(spark, path).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize(("groups", "most", "lengths"), [(6, 32, 16), (3, 2, 0), (1, 100, 16)])
def test_small_tiles(spark, monkeypatch, groups, most, lengths):
    for name, value in (("TILE", 16), ("GROUPS", groups), ("MOST", most), ("LENGTHS", lengths)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + 0.22 * rng.normal(size=24)).tolist(), int(rng.integers(0, 2))) for i in range(300)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(frame.repartition(3)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize(("tiles", "copies"), [(1, 1), (5, 5), (25, 6), (64 * 6, 12)])
def test_a_tile_is_sent_to_as_many_tasks_as_there_are_groups(spark, tiles, copies):
    lead = {f"{side}{k}": 1.0 for k in range(embed_dedup.LEAD) for side in ("lo", "hi")}
    rows = spark.range(tiles).select(F.format_string("%08d", "id").alias("tile"), F.lit("x").alias("label"), F.lit(8).alias("d"), *[F.lit(v).alias(c) for c, v in lead.items()], F.lit(1.0).alias("rest"), *[F.lit(b"").alias(c) for c in ("ids", "counts", "body")])
    placed, pairs = embed_dedup._dealt(rows)
    sizes = {r["group"]: r["count"] for r in placed.groupBy("group").count().collect()}
    assert len(sizes) == copies and max(sizes.values()) <= embed_dedup.MOST and max(sizes.values()) - min(sizes.values()) <= 1
    sent = pairs.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("group")).groupBy("group").count().collect()
    assert {r["count"] for r in sent} == {copies} and pairs.count() == copies * (copies + 1) // 2


def test_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LENGTHS", 2)
    rng = np.random.default_rng(7)
    rows = [(i, (np.ones(1 + i % 9) + 0.3 * rng.normal(size=1 + i % 9)).tolist(), 0) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(frame).collect()} == plain(rows)


def test_tiles_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE_BYTES", 24 * 8 * 10)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=24).tolist(), "x") for i in range(95)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>, label string").withColumns({"n": F.lit(1).cast("long"), "d": F.lit(24)})
    tiles = embed_dedup._tiles(frame.select("label", "d", "vec_id", "n", "v"), embed_dedup.principal_axes(frame)).collect()
    assert sum(len(t["ids"]) // 8 for t in tiles) == 95 and max(len(t["body"]) for t in tiles) == 24 * 8 * 10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.1], 0), (12, [1.0], 0), (13, [3.0], 0), (14, [1e-200, 0.0], 0)]
    frame = spark.createDataFrame([*rows, (None, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int").withColumns({"kept": F.lit("clash"), "h": F.lit(1)})
    got = embed_dedup.near_duplicates(frame).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got if r["vec_id"] is not None} == plain(rows[:-1]) | {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False), 14: (3, 1, False)}
    assert [tuple(r)[1:] for r in got if r["vec_id"] is None] == [(0, None, False)]
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0
