r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are maximal runs of [0-9A-Za-z] and characters from U+0080 up, A-Z lower-cased. A benchmark
item gives windows of 13 consecutive words (shorter items: one window of all words; none: no window).
A window occurs where all its words follow each other in a document, so any one of its words is a
necessary prefix of the join. Words are ordered by rarity, their count over all documents, and the
rarest word of a window is its prefix token. Document positions of prefix tokens join the windows;
the position in the window fixes where the window must begin (positional bound), it must not begin
before or end after the document (length bound), and the words around the position are compared with
the window's words. A document word inside any occurrence is hit.

While there are at most `IN_PLAN` prefix tokens, they are looked up inside each document's word list,
and only the words around a hit leave the scan. Up to `VOCABULARY` of them, words are exploded and looked
up in a broadcast table, so that only hits are shuffled. Beyond, words and tokens are joined by shuffle.

A row is identified by doc_id and text, so repeated ids with other texts are judged alone, and
repeated rows get equal results. Null texts and items have no words; null ids are kept. Other columns
are ignored. Without items or documents the result is all clean, or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import written

WINDOW = 13
#: Between words, before case folding.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Prefix tokens looked up inside the scan at most, and benchmark words that are broadcast at most.
IN_PLAN, VOCABULARY = 20_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: Column) -> Column:
    """The words in their own case, with an empty string where the text begins or ends with a break."""
    return F.split(text, BREAKS)


def n_words(words: Column) -> Column:
    n = F.size(words)
    ends = F.when(words[0] == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return F.when(words.isNull(), 0).otherwise(n - ends).cast("long")


def coarse(word: Column) -> Column:
    """Equal for words that are equal up to case; cheap, and checked exactly later."""
    return F.xxhash64(F.lower(word))


def exact(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window, n): each item's windows."""
    words = items.select(F.col(item_id).alias("item_id"), F.filter(pieces(F.col(text)), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1))
    return words.select("item_id", "w", n.alias("n"), starts.alias("i")).select("item_id", exact(F.slice("w", F.col("i"), F.col("n"))).alias("window"), "n").distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, count) over all words of all documents, for the keys of the benchmark's words."""
    keys = docs.select(F.explode(pieces(F.col("text"))).alias("w")).select(coarse(F.col("w")).alias("key"))
    if vocabulary.count() <= VOCABULARY:
        keys = keys.join(F.broadcast(vocabulary), "key", "left_semi")
    return keys.groupBy("key").count()


def prefix_index(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, at, n, window): each distinct window by its rarest word, at being that word's place in it."""
    distinct = found.select("window", "n").distinct()
    words = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("at", "w")).withColumn("key", coarse(F.col("w")))
    counts = word_counts(docs, words.select("key").distinct())
    rarity = F.struct(F.coalesce("count", F.lit(0)), "at").alias("rarity")
    ranked = words.join(counts, "key", "left").select("window", "n", "key", "at", rarity)
    return ranked.groupBy("window", "n").agg(F.min_by(F.struct("key", "at"), "rarity").alias("p")).select("p.key", "p.at", "n", "window")


def _with_context(words: Column, positions: Column) -> Column:
    """For each position, the words that any window through it can have."""
    return F.transform(positions, lambda p: F.struct(
        p.alias("p"), F.greatest(p - (WINDOW - 1), F.lit(0)).alias("first"),
        F.slice(words, F.greatest(p - (WINDOW - 1), F.lit(0)) + 1, F.least(p, F.lit(WINDOW - 1)) + WINDOW).alias("around")))


def _hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """docs with doc_id, h (hash of the text), n_words and hits, the places of prefix tokens with their context."""
    keys = index.select("key").distinct()
    n = keys.count()
    split = docs.select("doc_id", F.xxhash64("text").alias("h"), pieces(F.col("text")).alias("words"))
    if not n:
        return split.select("doc_id", "h", n_words(F.col("words")).alias("n_words"), _with_context(F.col("words"), F.array().cast("array<int>")).alias("hits"))
    if n <= IN_PLAN:
        listed = ",".join(f"{r['key']}L" if r["key"] != -(1 << 63) else "(-9223372036854775807L - 1L)" for r in keys.collect())
        at = F.expr(f"filter(transform(words, (w, i) -> if(xxhash64(lower(w)) in ({listed}), i, null)), p -> p is not null)")
        return split.select("doc_id", "h", n_words(F.col("words")).alias("n_words"), "words", at.alias("at")).select("doc_id", "h", "n_words", _with_context(F.col("words"), F.col("at")).alias("hits"))
    exploded = split.select("doc_id", "h", F.posexplode("words").alias("p", "w")).select("doc_id", "h", "p", coarse(F.col("w")).alias("key"))
    # a key is eight bytes, so VOCABULARY of them are a few MB; beyond, the words meet the keys by shuffle
    listed = F.broadcast(keys) if n <= VOCABULARY else keys
    at = exploded.join(listed, "key", "left_semi").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("p")).alias("at")).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "at")
    joined = split.join(at, split["doc_id"].eqNullSafe(at["_d"]) & (split["h"] == at["_h"]), "left")
    return joined.select("doc_id", "h", n_words(F.col("words")).alias("n_words"), _with_context(F.col("words"), F.col("at")).alias("hits"))


def contamination(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, h, n_words, n_hit, n_items, item_ids (texts, sorted), contaminated.

    Contaminated: hit words are a twentieth of the words at least, and not none.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = written(windows(items, item_id, item_text), "windows")
    index = written(prefix_index(found, docs), "index")
    rows = written(_hits(docs, index), "hits")
    around = rows.where(F.size("hits") > 0).select("doc_id", "h", F.explode("hits").alias("x")).select("doc_id", "h", "x.*")
    candidates = around.withColumn("key", coarse(F.col("around")[F.col("p") - F.col("first")])).join(index, "key").withColumn("start", F.col("p") - F.col("at"))
    matches = candidates.where(
        (F.col("start") >= 0) & (F.col("start") >= F.col("first")) & (exact(F.slice("around", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.col("n"))) == F.col("window")))
    by_doc = matches.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"), F.collect_set("window").alias("found"))
    # the union of spans in order: each adds what lies beyond the end so far
    seen = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")))["n"]
    by_doc = written(by_doc.select("doc_id", "h", seen.cast("long").alias("n_hit"), "found"), "matches")
    of_items = by_doc.select("doc_id", "h", "n_hit", F.explode("found").alias("window")).join(found.select("window", "item_id"), "window")
    of_items = of_items.groupBy("doc_id", "h").agg(F.first("n_hit").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    of_items = of_items.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "n_hit", "item_ids")
    joined = rows.drop("hits").join(of_items, rows["doc_id"].eqNullSafe(of_items["_d"]) & (rows["h"] == of_items["_h"]), "left").drop("_d", "_h")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least({WINDOW}, len(w)) as n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') as t
  from (select *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as i from b where len(w) > 0)),
dw as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
m as (select rid, i, dw.n, item_id from dw join win using (t)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
it as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from m group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (rid) left join it using (rid)
"""
