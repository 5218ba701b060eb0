import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareflow.llm import queries, spelling


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def linked(words):
    """Near words by the sets of words that deleting a code point gives."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].add(w)
    out = defaultdict(set)
    for group in by.values():
        for a in group:
            for b in group:
                if a != b and distance_is_one(a, b):
                    out[a].add(b)
    return out


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near, form = linked(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, f"/root/testdata/{sf}", "documents").collect()]
    want = brute({w: n for w, n in counted(docs).items() if n >= 3 and len(w) >= 5})
    assert rows(queries.spelling_query(spark, f"/root/testdata/{sf}")) == want
    assert len(want) > 1000


@pytest.mark.parametrize("node", [3, 50, spelling.NODE])
def test_same_for_any_depth_of_the_upper_levels(spark, node):
    rng = random.Random(7)
    words = {"".join(rng.choice("aeté×日") for _ in range(rng.randint(0, 6))): rng.randint(1, 40) for _ in range(900)}
    words |= {"e" * k: 2**k for k in range(9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(df, node=node)) == brute(words)


def test_long_words_and_repeated_rows(spark):
    a = "xylo" * 5000
    words = {a: 9, a + "s": 3, a[:9000] + a[9001:]: 4, a[:9000] + "q" + a[9001:]: 1, a[1:] + "x": 7, "z" * 70: 5, "z" * 71: 11, "z" * 69 + "y": 2}
    df = spark.createDataFrame([*words.items(), (None, 4)], "word string, n long").withColumn("form", F.lit("clash"))
    assert rows(spelling.variants(df)) == brute(words)
    twice = df.union(df)
    assert rows(spelling.variants(twice)) == brute({w: 2 * n for w, n in words.items()})
    assert spelling.variants(df.limit(0)).count() == 0


def test_counts_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    monkeypatch.setattr(spelling, "LISTED", 20)
    docs = [(1, "ÉCOLE École école"), (1, "a b c d e f g"), (None, "Word word"), (2, None), (2, ""), (3, "x×y÷z ŒUVRE naïve 日本"), *((k, f"q w{'e' * (k % 3)}") for k in range(200))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("_id", F.lit(2))
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == counted(docs) and "" in got
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, one_in=0).where("word = 'q'").collect()} == {"q": 200}


def test_verification_in_blocks(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    own = spelling.Words(words, np.ones(len(words), bool))
    i, j = own.pairs()
    got = {frozenset((own.words[a], own.words[b])) for a, b in zip(i, j, strict=True)}
    assert got == {frozenset((a, b)) for a, to in linked(words).items() for b in to} and len(got) == len(i)


def test_circles_are_refused(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)
