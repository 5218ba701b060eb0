r"""Line deduplication by a log-template tree, in DataFrame functions only.

A text's lines are cut at line feeds, a line's tokens at white space, and tokens with a digit become
the variable `<*>`; a line of nothing but variables is compared by its own tokens instead. The tree has fixed
depth: the number of tokens, then the leading `DEPTH` tokens lead to a leaf. A line whose tokens recur in
`MIN_DOCS` documents at least is a template as it is, however short. The other lines of a leaf are
generalised: a token's support is the number of the leaf's documents that have it at its place, and a
line keeps its leading tokens and the `SIMILARITY` share of its other places that has the greatest
support, and has `<*>` elsewhere. So a leaf has as many templates as its lines have, each document
counts once, and other lines of the leaf don't outvote a template. A generalised template recurs if
`MIN_GENERAL` documents have it; lines with fewer than four places after the leading ones keep all of
them. Recurring templates are dropped from all documents but the one of smallest doc_id, so that no
content is lost from the corpus.

A recurrence within one document is kept. Ties of support go to the earlier place. Blank lines are
always kept. Null texts stay null and have no lines; null ids count as one document, the first. A row is
identified by doc_id and text; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import unused, written

DEPTH, MIN_DOCS, MIN_GENERAL, SIMILARITY = 3, 2, 3, 0.7
#: Tokens from which a line has a place to give up.
LONG = DEPTH + 4
VARIABLE = "<*>"
#: White space within a line.
GAP = r" \t\r\f\x0B"
LOWEST = -(1 << 63)


def masked(line: Column) -> Column:
    """Tokens with a digit become the variable."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"[^{GAP}]*[0-9][^{GAP}]*", VARIABLE)).otherwise(line)


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, f"[{GAP}]+"), lambda t: t != "")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, n, leaf, m, tokens) for each line that isn't blank; tokens only where a line may be generalised."""
    # in two steps, so that the text does not go along with each of its lines
    cut = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    cut = cut.select("doc_id", "h", F.posexplode("lines").alias("line_no", "line"))
    split = cut.select("doc_id", "h", "line_no", "line", tokens(masked(F.col("line"))).alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    lead = F.concat_ws(" ", F.slice("tokens", 1, DEPTH))
    joined = F.concat_ws(" ", "tokens")
    blind = F.forall("tokens", lambda t: t == VARIABLE)
    own = F.when(blind, F.concat_ws(" ", tokens(F.col("line")))).otherwise(joined)
    return split.select("doc_id", "h", "line_no", "n", F.xxhash64("n", lead).alias("leaf"), F.xxhash64(own).alias("m"), F.when((F.col("n") >= LONG) & ~blind, joined).alias("tokens"))


def _recurring(rows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, first) of the keys that so many documents have; first is the least of these."""
    once = rows.groupBy(key, "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy(key).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")).where(F.col("n_docs") >= least).select(key, "first")


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line_no) of the lines to drop."""
    rows = written(lines(docs), "lines")
    small = rows.select("doc_id", "h", "line_no", "m")
    as_is = written(_recurring(small, "m", MIN_DOCS), "as_is")
    dropped = small.join(as_is, "m").where(F.col("doc_id") > F.col("first")).select("doc_id", "h", "line_no")
    # the rest of each shared leaf: the support of each token at its place
    long = rows.where("tokens is not null")
    leaves = written(_recurring(long.select("leaf", "doc_id"), "leaf", MIN_GENERAL).select("leaf"), "leaves")
    rest = long.join(leaves, "leaf", "left_semi").join(as_is, "m", "left_anti")
    places = F.posexplode(F.slice(F.split("tokens", " "), F.lit(DEPTH + 1), F.col("n"))).alias("at", "token")
    rest = written(rest.select("doc_id", "h", "line_no", "leaf", "n", places), "rest")
    once = rest.groupBy("leaf", "at", "token", "doc_id").agg(F.lit(1).alias("one"))
    support = written(once.groupBy("leaf", "at", "token").agg(F.count("*").alias("support")).where(F.col("support") >= MIN_GENERAL), "support")
    backed = rest.join(support, ["leaf", "at", "token"]).groupBy("doc_id", "h", "line_no", "leaf", "n").agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("back"), "at", "token"))).alias("best"))
    keeps = F.ceil((F.col("n") - DEPTH) * F.lit(SIMILARITY)).cast("int")
    kept = F.sort_array(F.transform(F.slice("best", F.lit(1), keeps), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    general = backed.where(F.size("best") >= keeps).select("doc_id", "h", "line_no", F.xxhash64("leaf", kept).alias("template"))
    general = written(general, "general")
    shared = _recurring(general, "template", MIN_GENERAL)
    return dropped.unionByName(general.join(shared, "template").where(F.col("doc_id") > F.col("first")).select("doc_id", "h", "line_no"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with the text less its dropped lines, and _n_lines and _n_dropped (lines of any length), which replace columns of these names."""
    docs = docs.drop("_n_lines", "_n_dropped")
    own, h, other_id, other_h, drop = unused(docs, "id", "h", "doc", "hash", "drop")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # which lines go, as a flag for each line up to the last of them, made here so that it is made once a row
    ordered = recurring(slim).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line_no")).alias("at"))
    ordered = ordered.withColumn("before", F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1)))
    flags = F.flatten(F.zip_with("at", "before", lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True)))))
    found = ordered.select(F.col("doc_id").alias(other_id), F.col("h").alias(other_h), F.struct(F.size("at").alias("n"), flags.alias("flags")).alias(drop))
    keyed = docs.withColumns({own: F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)), h: F.xxhash64(F.col(text))})
    joined = keyed.join(found, (F.col(own) == F.col(other_id)) & (F.col(h) == F.col(other_h)), "left")
    cut = F.split(F.col(text), "\n")
    kept = F.filter(cut, lambda _, i: ~F.coalesce(F.get(F.col(drop)["flags"], i), F.lit(False)))
    return joined.withColumns({
        "_n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(cut)).cast("long"),
        "_n_dropped": F.coalesce(F.col(drop)["n"], F.lit(0)).cast("long"),
        text: F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).drop(own, h, other_id, other_h, drop)


ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents),
l0 as (select rid, coalesce(doc_id, {LOWEST}) as doc_id, i, regexp_extract_all(ls[i], '[^ \t\r\f\x0B]+') as raw from (select *, unnest(range(1, len(ls) + 1)) as i from d)),
l as (select rid, doc_id, i, t, len(t) as n, array_to_string(t[1:{DEPTH}], ' ') as lead,
    case when len(list_filter(t, lambda x: x <> '{VARIABLE}')) = 0 then concat('=', array_to_string(raw, ' ')) else concat('~', array_to_string(t, ' ')) end as m
  from (select *, list_transform(raw, lambda x: case when regexp_matches(x, '[0-9]') then '{VARIABLE}' else x end) as t from l0) where len(t) > 0),
as_is as (select m, min(doc_id) as first from l group by m having count(distinct doc_id) >= {MIN_DOCS}),
long as (select * from l where n >= {LONG} and m[1] = '~'),
leaves as (select n, lead from long group by n, lead having count(distinct doc_id) >= {MIN_GENERAL}),
rest as (select * from (select long.*, unnest(range({DEPTH + 1}, n + 1)) as p from long semi join leaves using (n, lead) anti join as_is using (m))),
support as (select n, lead, p, t[p] as token, count(distinct doc_id) as s from rest group by all having s >= {MIN_GENERAL}),
ranked as (select r.rid, r.doc_id, r.i, r.n, r.lead, r.p, x.token, row_number() over (partition by r.rid, r.i order by s desc, r.p) as k
  from rest r join support x on r.n = x.n and r.lead = x.lead and r.p = x.p and r.t[r.p] = x.token),
general as (select rid, doc_id, i, n, lead, string_agg(concat(p, ':', token), ' ' order by p) as template from ranked
  where k <= ceil((n - {DEPTH}) * {SIMILARITY}) group by rid, doc_id, i, n, lead having count(*) = ceil((n - {DEPTH}) * {SIMILARITY})),
shared as (select n, lead, template, min(doc_id) as first from general group by all having count(distinct doc_id) >= {MIN_GENERAL}),
gone as (select rid, i from l join as_is using (m) where doc_id > first union select rid, i from general join shared using (n, lead, template) where doc_id > first),
per as (select rid, list(i) as gone from gone group by rid)
select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped,
  sha256(case when gone is null then text else array_to_string(list_filter(ls, lambda x, k: not list_contains(gone, k)), chr(10)) end) as kept_sha256
from d left join per using (rid)
"""
