from pyspark.sql import functions as F

from fareflow.llm import line_dedup, queries
from tests.oracle import connection, same


def test_query_against_sql(spark):
    path = "/root/testdata/sf0.01"
    assert same(queries.line_dedup_query(spark, path), line_dedup.ORACLE, path) == 1000


def test_templates(spark):
    rows = [(i, f"Only here {'xyz'[i % 3]}{i}\nPage {i} of 99 pages\nSession opened for user name{'abcdefgh'[i]} from the main gate today\nOf.\n\nlast words {i * 7} in document number") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 8):
        assert got[i].strip() == ""  # short lines count as well


def dropped(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["_n_dropped"] for r in line_dedup.deduplicated(docs).orderBy("doc_id").collect()]


def test_short_lines_and_two_documents(spark):
    assert dropped(spark, "Advertisement\nown words a", "Advertisement\nown words b", "Read more\nx", "もっと読む\ny", "もっと読む\nz\nRead more") == [0, 1, 0, 0, 2]


def test_numeric_rows_are_no_template(spark):
    assert dropped(spark, "1 2 3\n4 5 6 7 8 9 10 11", "7 8 9\n4 5 6 7 8 9 10 12", "1 2 4\n0 0 0 0 0 0 0 0", "1 2 3") == [0, 0, 0, 1]


def test_several_templates_of_a_leaf(spark):
    first = [f"the job of user{c} was ended by the night watch again" for c in "abcd"]
    second = [f"the job of printing was {c * 2} at noon because paper lacked" for c in "abcd"]
    other = [f"the job of {c} {c}{c} x{c} y{c} z{c} {c}w {c}v {c}u" for c in "mnop"]
    assert dropped(spark, *first, *second, *other) == [0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0]


def test_one_long_document_has_one_vote(spark):
    many = "\n".join(f"the state of pump {c} is q{c} w{c} e{c} r{c} t{c}" for c in "abcdefghij")
    some = [f"the state of pump seven is bad in hall {w} today" for w in ("east", "west", "north")]
    assert dropped(spark, many, *some) == [0, 0, 1, 1]


def test_half_a_million_lines(spark):
    text = "\n".join(f"line {'abcdefghij'[k % 10]}{k % 7}x of the log" if k % 2 else f"k{k} end" for k in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert got[1]["_n_dropped"] == 0 and got[2]["_n_dropped"] == 500_000 and got[2]["text"] == "last"


def odd(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "some line that recurs\nx"), (4, "some line that recurs\ny z"), (5, "some line that recurs"), (5, "some line that recurs\nother"), (6, "some line that recurs\n" * 3), (6, "some line that recurs\n" * 3), (7, "w1 " * 50_000), (8, "one two three four five\r\nsix  seven\teight")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_odd_rows(spark):
    docs, con = odd(spark), connection("/nowhere")
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    out = line_dedup.deduplicated(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
    assert same(out, line_dedup.ORACLE, None, con) == 11


def test_other_columns_and_empty(spark):
    docs = odd(spark).withColumns({c: F.lit("clash") for c in ("line_no", "h", "leaf", "_id", "_H", "_doc", "_hash", "_drop", "__id")})
    out = line_dedup.deduplicated(docs).drop("_n_lines", "_n_dropped")
    assert out.columns == docs.columns and out.where("_id = 'clash' and _h = 'clash' and _drop = 'clash'").count() == 11
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
