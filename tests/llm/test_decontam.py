import random
import re

import pytest
from pyspark.sql import functions as F

from fareflow.llm import decontam, queries
from tests.oracle import same


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for k, t in items:
            b = words(t)
            n = min(13, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(k))
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    got = df.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("item_ids", ","), "contaminated").collect()
    return sorted(map(tuple, got), key=str)


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.01"
    assert same(queries.decontamination_query(spark, path), decontam.ORACLE, path) == 1000


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["a", "B", "the", "É", "é", "x1", "of"]) for _ in range(n))
    items = [(1, some(20)), (2, None), (3, ""), (4, "the of"), (5, "É"), (6, some(13)), (7, some(30)), (7, some(14)), (None, some(15)), (10, "K x1")]
    docs = [(i, f"{some(5)}. {items[rng.choice([0, 5, 6, 7, 8])][1].upper() if i % 3 else ''}\n{some(rng.randint(0, 60))}") for i in range(60)]
    docs += [(1, "other text of the same id"), (2, None), (3, ""), (4, "..."), (None, items[0][1]), (5, docs[5][1]), (70, f"{items[6][1]} " * 300), (71, "Kelvin K x1 K x1")]
    return docs, items


@pytest.mark.parametrize(("in_plan", "vocabulary"), [(20_000, 1_000_000), (1, 1_000_000), (1, 1)])
def test_odd_rows(spark, odd, monkeypatch, in_plan, vocabulary):
    monkeypatch.setattr(decontam, "IN_PLAN", in_plan)
    monkeypatch.setattr(decontam, "VOCABULARY", vocabulary)
    docs, items = odd
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "h": F.lit(1), "words": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = {(r[0], r[1], r[2]) for r in rows(decontam.contamination(d, b))}
    assert got == {(r[0], r[1], r[2]) for r in plain(docs, items)}
    without_null = b.where("item_id is not null")
    assert rows(decontam.contamination(d, without_null)) == plain(docs, [x for x in items if x[0] is not None])


def test_empty_tables(spark, odd):
    d = spark.createDataFrame(odd[0], "doc_id long, text string")
    b = spark.createDataFrame(odd[1], "item_id long, text string")
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert {r["contaminated"] for r in decontam.contamination(d, b.limit(0)).collect()} == {False}


def test_no_python(spark):
    plan = queries.decontamination_query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
