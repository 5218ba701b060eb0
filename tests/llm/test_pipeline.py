import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fareflow.llm import bpe, langid, line_dedup, queries
from tests.llm.test_decontam import plain as contaminated
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.oracle import connection

PATH = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, PATH, "documents")
    columns, data = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, PATH).cache()
        data[name] = before, [tuple(r) for r in out.select(*out.columns[:2]).collect()]
        if name != "encoding":
            assert out.columns == columns
        docs = out
    before, after = data["language_id"]
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    before, after = data["line_deduplication"]
    con = connection("/nowhere")
    con.register("documents", spark.createDataFrame(before, "doc_id long, text string").toPandas())
    want = dict(con.execute(line_dedup.ORACLE.replace("sha256(case", "(case").replace("end) as kept_sha256", "end) as t").replace("select doc_id, cast(coalesce(len(ls)", "select doc_id, case when gone is null then text else array_to_string(list_filter(ls, lambda x, k: not list_contains(gone, k)), chr(10)) end as kept, cast(coalesce(len(ls)")).df()[["doc_id", "kept"]].itertuples(index=False))
    was = dict(before)
    assert dict(after) == {d: t for d, t in want.items() if t == was[d] or t.strip()}
    before, after = data["near_deduplication"]
    parts = plain_components({d: plain_fingerprint(t) for d, t in before})
    assert sorted(after) == sorted((d, t) for d, t in before if parts[d] == d)
    before, after = data["decontamination"]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, PATH, "benchmark").collect()]
    bad = {x[0] for x in contaminated(before, items) if x[-1]}
    assert sorted(after) == sorted((d, t) for d, t in before if d not in bad)
    before, after = data["encoding"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
    assert {d: bytes(i) for d, i in after} == {d: np.array(own.encode_ordinary(t), "<u4").tobytes() for d, t in before}
    assert docs.where(~F.col("round_trip")).count() == 0


def test_run_is_the_stages(spark):
    out = pipeline.run(spark, PATH)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and out.count() > 50


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ..", None), (None, "the and of that with " * 9, "en"), (None, "der und die nicht von " * 9, "de"), (5, "the and of that with " * 9, None), (5, "der die und das " * 9, "de"), (5, "der die und das " * 9, "de"), (6, "und der die auf " * 20_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "h": F.lit("clash"), "fp": F.lit(1), "_x": F.lit(2)})
    for _, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), PATH)
        assert empty.count() == 0
        docs = stage(spark, docs, PATH)
    got = docs.collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} <= {None, 5, 6} and len(got) >= 3
    assert langid.UNKNOWN == "und"


def test_ids_do_not_merge_components(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(90)], 60)) for _ in range(6)]
    # three unlike texts without an id, one of them twice; two unlike texts of one id; a component with an id and without
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (None, texts[5]), (8, texts[5] + " "), (8, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.near_deduplication(spark, docs, PATH)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"].strip()) for r in out.collect()), key=str)
    assert got == sorted([*[(None, t) for t in texts[:3]], (7, texts[3]), (7, texts[4]), (8, texts[5])], key=str)
