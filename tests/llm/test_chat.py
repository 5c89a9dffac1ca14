import hashlib

from pyspark.sql import functions as F

from askgauge.llm import chat


def test_layouts_are_told_apart_by_their_paths(spark):
    kind = (
        "k int, messages array<struct<role string, content string>>, conversations array<struct<from string, value string>>, "
        "prompt string, completion string, instruction string, input string, output string, system string, layout string"
    )
    none = [None] * 9
    data = [
        (1, [("user", "hi"), ("assistant", None)], *none[:8]),
        (2, None, [("human", "a"), ("gpt", "b")], *none[:7]),
        (3, None, None, "p", "c", None, None, None, None, "mine"),
        (4, None, None, None, None, "do", "this", "done", "be kind", None),
        (5, None, None, None, None, "do", None, "done", None, None),
        (6, None, None, "p", None, None, None, None, None, None),
        (7, [], None, None, None, None, None, None, None, None),
        (8, [(None, None)], None, None, None, None, None, None, None, None),
    ]
    rows = {r["k"]: r for r in chat.format_chats(spark.createDataFrame(data, kind)).collect()}
    turns = {k: [tuple(t) for t in r["turns"]] if r["turns"] is not None else None for k, r in rows.items()}
    assert turns[1] == [("user", "hi"), ("assistant", "")]
    assert turns[2] == [("user", "a"), ("assistant", "b")]
    assert turns[3] == [("user", "p"), ("assistant", "c")]
    assert turns[4] == [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]
    assert turns[5] == [("user", "do"), ("assistant", "done")]
    assert turns[6] is None and rows[6]["layout"] is None and turns[7] is None
    assert turns[8] == [("", "")]
    assert rows[4]["fingerprint"] != rows[5]["fingerprint"] and rows[4]["layout"] == rows[5]["layout"] == "instruction"


def test_control_strings_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<", "|>", "<\\\\|\n", "", None, "<" * 3 + "|", "<|" * 4, "%0A%25\n<"]
    rows = spark.createDataFrame([(7, i, ["user", "assistant", "a\nb<|im_end|>%0A", None][i % 4], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.gather_messages(rows))
    got = out.select(chat.parse_formatted(chat.formatted(F.col("segments"))).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in got["t"]] == [(["user", "assistant", "a\nb<|im_end|>%0A", ""][i % 4], t or "") for i, t in enumerate(texts)]
    assert got["loss"] == "".join(t or "" for i, t in enumerate(texts) if i % 4 == 1)
    joined = "".join(f"{r or ''}\n{t or ''}\n" for r, t in ((["user", "assistant", "a\nb<|im_end|>%0A", None][i % 4], t) for i, t in enumerate(texts)))
    assert chat.chat_digests(out).first()["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_ties_nulls_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string, messages string, layout string"
    data = [(1, 0, "user", "b", "x", "y"), (1, 0, "user", "a", "x", "y"), (1, 0, "user", "a", "x", "y"), (1, None, "system", "s", None, None), (None, 0, "user", "n", None, None)]
    rows = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(chat.gather_messages(spark.createDataFrame(data, kind)))).collect()}
    assert rows[1]["n_turns"] == 4 and rows[None]["n_turns"] == 1
    assert rows[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert chat.chat_digests(chat.format_chats(chat.gather_messages(spark.createDataFrame([], kind)))).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = chat.op1_chat_format(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_that_only_share_a_name_with_a_list_of_turns(spark):
    kind = "k int, prompt string, completion string, messages string, conversations array<string>, segments int"
    row = chat.format_chats(spark.createDataFrame([(1, "p", "c", "x", ["m"], 4)], kind)).first()
    assert [tuple(t) for t in row["turns"]] == [("user", "p"), ("assistant", "c")] and row["messages"] == "x" and len(row["segments"]) == 6
