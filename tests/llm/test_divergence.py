import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fareflow.llm import divergence, queries
from tests.oracle import same


def brute(docs, least_docs=10, top=10):
    n, docs_with, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in docs):
        groups[lang].add(source)
        found = [re.sub("[A-Z]", lambda c: c.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n[lang, source].update(found)
        docs_with[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, k in docs_with[lang].items() if k >= least_docs]
        whole = sum((n[lang, s] for s in sources), Counter())

        def shares(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        q, p = shares(whole), {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if n[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    assert same(queries.divergence_query(spark, f"/root/testdata/{sf}"), divergence.ORACLE, f"/root/testdata/{sf}") > 500


def invented(seed=4):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "日本語", "x", "q\x00r", "naïve", "A1B", "end.", "İ", "ſ"]
    docs = [(" ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "", None, "fr"]), f"s{rng.randint(0, 8)}") for _ in range(400)]
    return [*docs, (None, "en", "silent"), ("", None, None), (None, "xx", "one"), (None, "xx", "two"), ("a lone text", "yy", "z"), ("long " * 90_000, "en", "s0")]


@pytest.mark.parametrize(("sources", "shard", "held", "terms"), [(64, 50_000, 200_000, 2048), (2, 5, 4, 2), (1, 1, 1, 1)])
def test_same_for_any_blocks_and_shards(spark, monkeypatch, sources, shard, held, terms):
    for name, value in (("SOURCES", sources), ("SHARD", shard), ("HELD", held), ("TERMS", terms)):
        monkeypatch.setattr(divergence, name, value)
    docs = invented()
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("clash"))
    want = brute(docs)
    assert rows(divergence.audit(df)) == want
    assert ("xx", "one", "pair", "two", 0, 1) in want and any(r[1] == "silent" for r in want)


def test_repeated_rows_other_names_and_no_rows(spark):
    docs = invented(5)[:120] * 2
    df = spark.createDataFrame(docs, "body string, tongue string, site string")
    assert rows(divergence.audit(df, "body", "tongue", "site", least_docs=3, top=2)) == brute(docs, 3, 2)
    assert divergence.audit(df.limit(0), "body", "tongue", "site").count() == 0


def test_shares_of_large_counts(spark):
    n, total, kept = 9 * 10**17, 4 * 10**18, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert got["p"] == 1 + 10**9 * (n + 2) // (total + 2 * kept) and got["none"] is None
