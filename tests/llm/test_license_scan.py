import random

from pyspark.sql import functions as F

from fareflow.llm import license_scan, queries
from tests.oracle import connection, same


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.01"
    assert same(queries.license_query(spark, path), license_scan.oracle(), path) > 10


def test_odd_rows(spark):
    fill = "some other words that mean nothing here "
    rows = [(i, f"{fill * (i % 5)}{text.upper() if i % 2 else text}\n{fill * 3}") for i, text in enumerate(license_scan.NOTICES.values())]
    long = license_scan.NOTICES["GPL-text"].split()
    rows += [(20, None), (21, ""), (22, fill * 500 + license_scan.NOTICES["MIT"]), (22, "All rights reserved"), (22, "All rights reserved"), (None, "all RIGHTS\n\nreserved!"), (23, " ".join(long[:25])), (24, " ".join(long[:5] + ["x"] + long[5:])), (25, "licensed"), (26, "rights")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("clash"), "word": F.lit(1), "m": F.lit(2)})
    con = connection("/nowhere")
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert same(license_scan.matches(docs), license_scan.oracle(), None, con) >= 13
    found = {(r["doc_id"], r["license"]) for r in license_scan.matches(docs).collect()}
    assert {(i, n) for i, n in enumerate(license_scan.NOTICES)} <= found
    assert license_scan.matches(docs.limit(0)).count() == 0


def test_long_text(spark):
    fill = "some other words that mean nothing here "
    docs = spark.createDataFrame([(22, fill * 5000 + license_scan.NOTICES["MIT"])], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["containment"]) for r in license_scan.matches(docs).collect()] == [(22, "MIT", 1.0)]


def test_anchors_leave_no_match_out():
    for text in license_scan.NOTICES.values():
        words = license_scan.notice_words(text)
        shingles, chosen = license_scan.notice_shingles(words), license_scan.anchors(words)
        without = [s for s in shingles if not set(chosen) & set(s.split())]
        assert len(without) < -(-4 * len(shingles) // 5)
        size, _ = license_scan.window_shape(words)
        k = min(license_scan.SHINGLE, len(words))
        need = -(-4 * len(shingles) // 5)
        similar = need / (len(shingles) + size - k + 1 - need)
        assert 1 - (1 - similar) ** license_scan.BANDS > 0.999997


def best_span(words, notice):
    """The greatest share of the notice's shingles in a span of any place, as long as such spans may be."""
    of = set(license_scan.notice_shingles(notice))
    k, span = min(license_scan.SHINGLE, len(notice)), len(notice) + len(notice) // 2
    return max(len(of & {" ".join(words[j : j + k]) for j in range(i, min(i + span, len(words)) - k + 1)}) / len(of) for i in range(len(words)))


def test_edited_notices_at_every_place(spark):
    text = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    rows = [(i, "pad " * i + text + " pad" * 40) for i in range(40)]
    rng = random.Random(4)
    for i in range(100, 160):
        words = license_scan.NOTICES["Apache-2.0-text"].split()
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(words))
            words[at:at] = ["pad"] * rng.randint(1, 6)
        rows.append((i, "pad " * rng.randrange(40) + " ".join(words)))
    notices = {n: license_scan.NOTICES[n] for n in ("MIT-text", "Apache-2.0-text")}
    found = {(r["doc_id"], r["license"]) for r in license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"), notices=notices).collect()}
    for i, t in rows:
        name = "MIT-text" if i < 100 else "Apache-2.0-text"
        assert (i, name) in found or best_span(license_scan.notice_words(t), license_scan.notice_words(notices[name])) < license_scan.CONTAINED
    assert {(i, "MIT-text") for i in range(40)} <= found


def test_own_notices_of_hundreds_of_words(spark):
    rng = random.Random(8)
    notices = {f"n{k}": " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "may", "not", "copy", "grant"]) + str(rng.randrange(50)) for _ in range(300 + k)) for k in range(5)}
    rows = []
    for k, t in enumerate(notices.values()):
        words = t.split()
        rows.append((k, "intro " * (31 * k) + " ".join(words[:100] + ["put", "in"] + words[100:250] + words[252:])))
        rows.append((k + 10, " ".join(words[:120])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = connection("/nowhere")
    con.register("documents", docs.toPandas())
    assert same(license_scan.matches(docs, notices=notices), license_scan.oracle(notices), None, con) == 5
    assert license_scan.matches(docs, notices={}).count() == 0


def test_same_by_shuffle_and_in_batches(spark, monkeypatch):
    fill = "some other words that mean nothing here "
    rows = [(i if i % 4 else None, f"{fill * (i % 5)}{text}\n{fill * 3}") for i, text in enumerate(license_scan.NOTICES.values())] * 2
    docs = spark.createDataFrame([*rows, (50, None), (51, fill * 200)], "doc_id long, text string")
    want = sorted(map(str, license_scan.matches(docs).collect()))
    assert len(want) >= len(license_scan.NOTICES)
    monkeypatch.setattr(license_scan, "SENT", 0)
    monkeypatch.setattr(license_scan, "EARLY", 0)
    assert sorted(map(str, license_scan.matches(docs).collect())) == want
    monkeypatch.setattr(license_scan, "BATCH", 7)
    assert sorted(map(str, license_scan.matches(docs).collect())) == want


def test_thousands_of_notices(spark):
    """Made notices of 60 words, so that bands come by shuffle; each text holds one, with two words replaced or none."""
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "may", "not", "copy", "grant") for b in range(400)]
    notices = {f"n{k:05d}": " ".join(rng.choices(vocabulary, k=60)) for k in range(3000)}
    rows = []
    for i in range(60):
        words = notices[f"n{i * 37:05d}"].split()
        if i % 2:
            words[10], words[40] = "other", "other"
        rows.append((i, "intro " * (i % 50) + " ".join(words) + " end" * 30))
    rows += [(100, "intro " * 300), (101, " ".join(notices["n00001"].split()[:30]))]
    got = license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"), notices=notices).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(i, f"n{i * 37:05d}") for i in range(60)}
    assert {r["containment"] for r in got} == {1.0, 46 / 56}
