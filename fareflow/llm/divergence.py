"""Divergence of the sources of each language by their terms, as an Arrow pipeline.

Inside `mapInArrow`, texts go through Arrow's own functions: `ascii_lower`, `split_pattern_regex`, `dictionary_encode`
and hash `group_by`; out come partial counts of (lang, source, term), merged within a task up to a bounded number of
rows. Spark merges them over all tasks. A language keeps the terms of at least `least_docs` of its documents.

Each group (lang, source), and each language, gives a kept term the smoothed share
p = 1 + floor(1e9 (count + 2) / (N + 2 V)), N its count over all kept terms and V their number. The divergence of two
shares is f = floor((p - q)^2 / (p + q)). Two sources differ by the sum of f over all kept terms; a source's terms
are those that it uses more than its language does, by f.

Sums over pairs of sources are made in columnar shards: sources are dealt to blocks, and terms to shards of a
language, so that a task has a bounded number of counts and of pairs of sources. Terms of which a pair of blocks has none
are added by their number, as their f is the same.

Nulls of text, lang and source count as ''. A repeated row is a document of its own. Groups without terms take part. All
arithmetic is in integers, with decimals where 64 bits could overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import slices, written

#: What separates terms: ASCII but for its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of partial counts in a task; sources of a block, counts of a block's shard, and terms at once in a matrix.
HELD, SOURCES, SHARD, TERMS = 200_000, 64, 50_000, 2048

_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])
_SUMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("item", T.StringType()), T.StructField("sum", T.LongType()), T.StructField("terms", T.LongType())])


def counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents; each group has a row without a term, too."""
    langs, sources, texts = (pc.fill_null(batch.column(k), "") for k in range(3))
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    wide = len(sources.dictionary)
    group = pc.add(pc.multiply(langs.indices.cast(pa.int64()), wide), sources.indices.cast(pa.int64()))
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    terms, doc = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(terms), 0)
    terms, doc = terms.filter(full).dictionary_encode(), doc.filter(full)
    by_doc = pa.table({"doc": doc, "term": terms.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    # the group's own row has no term, no occurrence and each of its documents
    rows = pa.concat_tables([
        pa.table({"group": group.take(by_doc["doc"].combine_chunks()), "term": by_doc["term"].combine_chunks(), "n": by_doc["count_all"].combine_chunks()}),
        pa.table({"group": group, "term": pa.nulls(len(group), pa.int32()), "n": pa.array(np.zeros(len(group), np.int64))}),
    ])
    met = rows.group_by(["group", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    of = met["group"].combine_chunks()
    lang = langs.dictionary.take(pc.divide(of, wide))
    source = sources.dictionary.take(pc.subtract(of, pc.multiply(pc.divide(of, wide), wide)))
    return pa.table([lang, source, terms.dictionary.take(met["term"].combine_chunks()), met["n_sum"], met["count_all"]], _COUNTS.names)


def _merged(tables: list[pa.Table]) -> pa.Table:
    keys = _COUNTS.names[:3]
    both = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return both.select([*keys, "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = before = 0
    for batch in batches:
        for part in slices(batch, 2):
            held.append(counted(part))
            rows += held[-1].num_rows
            if rows > HELD + before:
                held = [_merged(held)]
                rows = before = held[0].num_rows
                if rows > HELD:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows, before = [], 0, 0
    if held:
        yield from _merged(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of terms and documents with them; a group's row with a null term has all its documents."""
    found = docs.select(F.col(lang).cast("string"), F.col(source).cast("string"), F.col(text)).mapInArrow(_partial, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly: products and quotients have up to 38 digits."""
    wide = "decimal(20,0)"
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast(wide)
    whole = F.call_function("div", over, (total.cast(wide) + F.lit(2).cast("decimal(1,0)") * kept.cast("decimal(18,0)")).cast(wide))
    return F.when(kept > 0, whole + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sums(table: pa.Table) -> pa.Table:
    """One shard of a pair of blocks: for each two sources, one of either block, the sum of f over the shard's terms.

    Rows without a term name the sources of both blocks, with their p of a count of 0.
    """
    lang, left, right = (table[c][0].as_py() for c in ("lang", "left", "right"))
    named = table.filter(pc.is_null(table["term"]))
    names, block, zero = named["source"].to_pylist(), named["block"].to_numpy(), named["p"].to_numpy()
    rows = table.filter(pc.is_valid(table["term"]))
    source = pc.index_in(rows["source"].combine_chunks(), pa.array(names, pa.string())).to_numpy()
    code = rows["term"].combine_chunks().dictionary_encode()
    terms, term, p = len(code.dictionary), code.indices.to_numpy(), rows["p"].to_numpy()
    order = np.argsort(term, kind="stable")
    source, term, p = source[order], term[order], p[order]
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    sums = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, terms, TERMS):
        wide = min(TERMS, terms - at)
        here = slice(*np.searchsorted(term, [at, at + wide]))
        matrix = np.repeat(zero[:, None], wide, axis=1)
        matrix[source[here], term[here] - at] = p[here]
        other = matrix[b]
        for k, x in enumerate(matrix[a]):
            sums[k] += ((x - other) ** 2 // (x + other)).sum(axis=1)
    i, j = (x.ravel() for x in np.indices(sums.shape))
    i, j, total = a[i], b[j], sums.ravel()
    if left == right:
        i, j, total = i[i != j], j[i != j], total[i != j]
    else:
        i, j, total = np.r_[i, j], np.r_[j, i], np.r_[total, total]
    own = pa.array(names, pa.string())
    return pa.table([pa.array([lang] * len(i), pa.string()), own.take(pa.array(i)), own.take(pa.array(j)), pa.array(total), pa.array(np.full(len(i), terms))], _SUMS.names)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair` has each other source of the language with the divergence between both, all ranks. Part `term` has the
    `top` terms of a group with p over the language's p. A language with one source has no pairs.
    """
    counts = written(term_counts(docs, text, lang, source), "counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    rows = written(terms.join(kept.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")

    # a language's numbers of kept terms, of their occurrences, of sources and of counts
    found = rows.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"), F.count("*").alias("rows"))
    of_lang = found.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"), F.sum("rows").alias("rows"))
    groups = counts.where("term is null").select("lang", "source")
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(of_lang, "lang", "left").na.fill(0, ["kept", "lang_total", "rows"])
    blocks = F.ceil(F.col("sources") / SOURCES)
    of_lang = of_lang.withColumns({"blocks": blocks, "shards": F.greatest(F.ceil(F.col("rows") / (blocks * SHARD)), F.lit(1))})
    of_group = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    of_group = of_group.join(of_lang, "lang").withColumns({
        "zero": share(F.lit(0).cast("long"), F.col("total"), F.col("kept")),
        "block": F.pmod(F.xxhash64("source"), F.col("blocks")),
    })
    of_group = written(of_group, "groups")

    shares = rows.join(of_group, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    shares = shares.select("lang", "source", "term", "p", "lang_n", "lang_total", "kept", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    by_term = _ranked(over, "term").where(F.col("rank") <= top)

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return rows.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "shard", "source", "term", "p", "block")

    names = of_group.where("kept > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    names = names.withColumns({"term": F.lit(None).cast("string"), "p": F.col("zero")})
    both = dealt(shares).unionByName(dealt(names))
    sums = both.groupBy("lang", "left", "right", "shard").applyInArrow(_sums, _SUMS)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms"))

    one = of_group.select("lang", "source", "zero", "kept")
    two = of_group.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"))
    pairs = sums.join(one, ["lang", "source"]).join(two, ["lang", "item"])
    rest = (F.col("kept") - F.col("terms")) * divergence(F.col("zero"), F.col("zero_item"))
    by_source = pairs.select("lang", "source", "item", (F.col("sum") + rest).alias("value"))
    # a language without kept terms has differences of 0
    none = one.where("kept = 0").join(two.select("lang", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return _ranked(by_source.unionByName(none), "pair").unionByName(by_term)


ORACLE = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
groups as (select distinct lang, source from d),
t as (select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct doc) as docs from t group by all),
kept as (select lang, term, sum(n)::bigint as lang_n from c group by all having sum(docs) >= 10),
of_lang as (select lang, count(*) as v, sum(lang_n)::bigint as lang_total from kept group by all),
counts as (select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) as n from groups g join kept k on g.lang = k.lang
     left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
of_group as (select lang, source, sum(n)::bigint as total from counts group by all),
p as (select c.lang, c.source, c.term, c.n, (1 + (1000000000::hugeint * (c.n + 2)) // (g.total + 2 * l.v))::bigint as p,
     (1 + (1000000000::hugeint * (c.lang_n + 2)) // (l.lang_total + 2 * l.v))::bigint as q
     from counts c join of_group g on g.lang = c.lang and g.source = c.source join of_lang l on l.lang = c.lang),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint as value
     from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value
     from groups a join groups b on a.lang = b.lang and a.source <> b.source
     left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q),
parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
from parts qualify part = 'pair' or rank <= 10
"""
