import random
import re

import numpy as np
from pyspark.sql import functions as F

from fareflow.llm import chunk_dedup, queries


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "re", "on", "éa", "st", "ou", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_rolling_hash_is_the_recurrence():
    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunk_dedup.GEAR[b])) % (1 << 16)
        want.append(h)
    assert chunk_dedup.rolling(data).tolist() == want


def test_cuts_resist_insertions():
    text = prose(random.Random(1), 2000).encode()
    ends = chunk_dedup.cuts(np.frombuffer(text, np.uint8))
    moved = chunk_dedup.cuts(np.frombuffer(b"inserted bytes" + text, np.uint8))
    assert len(ends) > 200 and len(set(moved - 14) & set(ends)) >= len(ends) - 3
    assert all(text[s:e].decode() for s, e in zip([0, *ends[:-1]], ends))


def shortest(text):
    """A text's passages, by plain counting of words."""
    data = text.encode()
    ends = chunk_dedup.cuts(np.frombuffer(data, np.uint8)).tolist()
    starts = [0, *ends[:-1]]
    out = []
    for i, s in enumerate(starts):
        for e in ends[i:]:
            part = data[s:e].decode()
            words = len(re.findall(r"[^\x00-\x20]+", part))
            han = sum("\u3000" <= c <= "\u9fff" for c in part)
            if 2 * words + han >= 2 * chunk_dedup.RUN_WORDS:
                out.append((s, e))
                break
    return out


def plain(rows):
    """By (doc_id, text): the bytes repeated and to remove, by plain dictionaries."""
    low = chunk_dedup.LOWEST
    where, cut = {}, {}
    for d, t in rows:
        if t:
            cut[d, t] = [(s, e, t.encode()[s:e]) for s, e in shortest(t)]
            for _, _, p in cut[d, t]:
                where.setdefault(p, set()).add(low if d is None else d)
    out = {}
    for (d, t), ps in cut.items():
        met = [(s, e, min(where[p])) for s, e, p in ps if len(where[p]) > 1]
        repeated = {b for s, e, _ in met for b in range(s, e)}
        gone = {b for s, e, first in met if (low if d is None else d) > first for b in range(s, e)}
        out[d, t] = len(repeated), gone
    return out


def kept(t, gone):
    return bytes(b for i, b in enumerate(t.encode()) if i not in gone).decode()


def check(spark, rows, docs):
    want = plain(rows)
    got = chunk_dedup.annotated(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        repeated, gone = want.get((r["doc_id"], r["text"]), (0, set()))
        assert (r["_repeated"], r["_removed"]) == (repeated, len(gone))
        assert {b for s in r["_spans"] for b in range(s["start"], s["end"])} == gone
    texts = sorted(((r["doc_id"], r["text"]) for r in chunk_dedup.deduplicated(docs).collect()), key=str)
    assert texts == sorted(((d, t and kept(t, want[d, t][1])) for d, t in rows), key=str)


def test_query_table_against_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], docs)


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    passages = [prose(rng, 55) for _ in range(40)]
    rows = [(2 * i + j, f"{prose(rng, 30)} {p} {prose(rng, 40)}") for i, p in enumerate(passages) for j in range(2)] + [(1000 + i, prose(rng, 120)) for i in range(40)]
    got = {r["doc_id"]: r for r in chunk_dedup.annotated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i]["_repeated"] > 0 and got[2 * i + 1]["_removed"] > 0 for i in range(40)) >= 38
    assert not any(got[1000 + i]["_repeated"] for i in range(40))


def test_odd_rows(spark):
    rng = random.Random(9)
    p = prose(rng, 80)
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, f"x {p}"), (4, f"{p} y"), (4, f"other {p}"), (5, "é" * 100_000), (6, "a"), (7, " \n"), (8, prose(rng, 30_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit("clash"), "start": F.lit(1), "digest": F.lit(2)})
    check(spark, rows, docs)
    assert chunk_dedup.deduplicated(docs).columns == docs.columns
    assert chunk_dedup.annotated(docs.limit(0)).count() == 0


def test_only_what_recurs_together_counts(spark):
    rng = random.Random(12)
    passage = prose(rng, 60)
    data = np.frombuffer(passage.encode(), np.uint8)
    ends = chunk_dedup.cuts(data).tolist()
    parts = [passage.encode()[s:e].decode() for s, e in zip([0, *ends[:-1]], ends)]
    # document 1 has each chunk of document 2, but no more than two of them together
    rows = [(1, "".join(f"{prose(rng, 9)} {p}{q} {prose(rng, 9)} " for p, q in zip(parts, parts[1:]) if len((p + q).split()) < 11)), (2, passage)]
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200))
    other = ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(80)) for _ in range(4)]
    rows += [(3, other[0] + han + other[1]), (4, other[2] + han + other[3])]
    got = {r["doc_id"]: r for r in chunk_dedup.annotated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["_removed"] == 0
    assert got[3]["_removed"] == 0 and 450 <= got[4]["_removed"] <= 600


def test_long_runs_are_covered():
    rng = random.Random(6)
    missed = []
    for _ in range(300):
        shared = prose(rng, 51)
        sides = [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(2)]
        a, b = ({t.encode()[s:e] for s, e in shortest(t)} for t in sides)
        text = sides[0].encode()
        both = {i for s, e in shortest(sides[0]) if text[s:e] in a & b for i in range(s, e)}
        missed.append(1 - len(both) / len(shared.encode()))
    assert np.mean(np.array(missed) < 1) >= 0.99 and np.mean(missed) < 0.3


def test_rows_of_one_id_and_any_columns(spark):
    rng = random.Random(3)
    p, q = prose(rng, 60), prose(rng, 60)
    rows = [(1, f"{p} {q}"), (7, p), (7, q), (7, q)] + [(None, "null id " + p)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("_id", "_hash", "_d", "_k", "_u", "_row", "_ROW2")})
    check(spark, rows, docs)
    assert chunk_dedup.annotated(docs).columns == [*docs.columns, "_repeated", "_removed", "_spans"]
    got = chunk_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.where("_id = 5 and _hash = 5 and _row = 5").count() == len(rows)


def test_any_text_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "bc", " d", "\n", "é", "漢", "字", "xyz "]) for _ in range(rng.randint(1, 400)))
        starts, ends, _ = chunk_dedup.passages(text.encode())
        assert list(zip(starts.tolist(), ends.tolist())) == shortest(text)


def test_recall_by_length():
    """A passage of n words, put into two texts, is found if they share a passage's bytes."""
    rng, found = random.Random(11), {}
    for n in (15, 20, 25, 30, 40, 51):
        hits = 0
        for _ in range(200):
            common = prose(rng, n)
            a, b = (f"{prose(rng, 40)} {common} {prose(rng, 40)}".encode() for _ in range(2))
            hits += bool(set(chunk_dedup.passages(a)[2]) & set(chunk_dedup.passages(b)[2]))
        found[n] = hits / 200
    assert found[51] >= 0.99 and found[40] >= 0.98 and found[30] >= 0.95 and found[25] >= 0.9 and found[20] >= 0.5, found
    assert not set(chunk_dedup.passages(prose(rng, 5000).encode())[2]) & set(chunk_dedup.passages(prose(rng, 5000).encode())[2])


def test_words_of_a_passage_are_a_parameter(spark):
    rng = random.Random(12)
    common = prose(rng, 30)
    docs = spark.createDataFrame([(k, f"{prose(rng, 30)} {common} {prose(rng, 30)}") for k in range(3)], "doc_id long, text string")
    size = lambda words: chunk_dedup.annotated(docs, run_words=words).agg(F.sum("_repeated")).first()[0]
    assert size(8) >= size(12) > 0 and size(60) == 0
