from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fareflow.llm import chat, queries

TEXT = st.lists(st.sampled_from(["<", "|", "\\", "\n", "a", ">", "im_end", chat.START, chat.END, "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_round_trip(turns):
    whole, found = chat.located(turns)
    assert chat.parse(whole) == turns
    assert len(found) == len(turns) and "".join(whole[s:e] for s, e in found) == whole
    for turn, span in zip(turns, found, strict=True):
        s, e = chat.text_span(turn, span, chat.template)
        assert chat.unescape(whole[s:e]) == turn[1]


def test_long_conversations_take_the_linear_way():
    calls = []

    def counted(turns):
        calls.append(len(turns))
        return chat.template(turns)

    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(500)]
    whole, found = chat.located(turns, counted)
    assert sum(calls) < 3_500 and whole == chat.template(turns) and len(found) == 500
    assert found == chat.spans(turns, chat.template)[1]


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    counted = lambda turns: f"{len(turns)} turns: " + chat.template(turns)
    for render in (last_only, counted):
        for n in (3, 100):
            assert chat.located([("user", f"t{i}") for i in range(n)], render)[1] is None


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for k, v in by.items():
        turns = [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x))]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[k] = (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [*queries.table(spark, path, "conversations").collect(), *chat.probe(spark).collect()]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.chat_query(spark, path).collect()}
    assert -1 in got and got == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 2, "user", None), (1, None, None, "x"), (1, 2, "assistant", "same"), (1, 2, "assistant", "same"), (None, 1, "a\nb\\", chat.END), (3, 0, "assistant", "w " * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2), "_turn": F.lit(0)})
    out = chat.formatted(chat.conversations(frame))
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(out).collect()} == plain(frame.collect())
    assert chat.digests(chat.formatted(chat.conversations(frame.limit(0)))).count() == 0


def test_given_conversation_of_the_probes_id(spark, tmp_path):
    rows = [(-1, 0, "user", "given"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["conv_id"] or 0, r["n_turns"]) for r in queries.chat_query(spark, str(tmp_path)).collect())
    assert got == [(-1, 1), (-1, 2), (0, 2)]


def test_the_length_of_a_conversation_does_not_choose_the_rule(spark):
    tenth = lambda turns: "" if len(turns) == 10 else chat.template(turns)
    rows = [(n, i, "user", f"t{i}") for n in (9, 20, 60) for i in range(n)]
    grouped = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["rewrites"] for r in chat.formatted(grouped, tenth).collect()} == {9: False, 20: True, 60: True}
    assert {r["conv_id"]: r["rewrites"] for r in chat.formatted(grouped, tenth, back=chat.BACK).collect()} == {9: False, 20: False, 60: False}
