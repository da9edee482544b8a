import hashlib

import duckdb
from pyspark.sql import functions as F

from clewline.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_conv(df):
    return {r.conv_id: r for r in chat.digest(chat.prefix_targets(df)).collect()}


def want(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hard_texts(frame):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "<\\\\|x|>", "a<", "|im_end|>\n", "\\", "$1 \\1", "<|nl|>", "ü🤦🏼‍♂️\n\n", "", None]
    rows, turns = [], {}
    for c, a in enumerate(nasty):
        turns[c] = [("system", a), ("user", a), ("assistant", a), ("a\nb<|", a), ("assistant", a), (None, a)]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns[c])]
    got = by_conv(frame(rows, SCHEMA))
    for c, said in turns.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(said), said


def test_examples(frame):
    df = frame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "only"), (3, 0, "assistant", "first")], SCHEMA)
    got = {(r.conv_id, r.example): (r.prompt, r.target, r.closing) for r in chat.prefix_targets(df).collect()}
    u, a = "<|im_start|>user\n", "<|im_start|>assistant\n"
    assert got == {
        (1, 0): (f"{u}q<|im_end|>\n{a}", "a", "<|im_end|>\n"),
        (1, 1): (f"{u}q<|im_end|>\n{a}a<|im_end|>\n{u}r<|im_end|>\n{a}", "b", "<|im_end|>\n"),
        (2, 0): (f"{u}only<|im_end|>\n", None, ""),
        (3, 0): (a, "first", "<|im_end|>\n")}


def test_nulls_ties_and_other_columns(frame):
    df = frame([(None, None, None, None), (None, 1, "assistant", "z"), (5, 2, "assistant", "b"), (5, 2, "assistant", "b"), (5, 2, "assistant", "a")], SCHEMA).withColumn("segments", F.lit("x"))
    got = by_conv(df)
    assert (got[None].n_turns, got[None].loss_chars) == (2, 1)
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_chars, got[5].loss_sha256) == want([("assistant", t) for t in "abb"])
    assert by_conv(df.where("false")) == {}


def test_only_column_expressions(frame):
    plan = chat.digest(chat.prefix_targets(frame([(1, 0, "user", "x")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_long_conversation(frame):
    got = by_conv(frame([(1, k, "user" if k % 2 else "assistant", "x" * 500) for k in range(200)], SCHEMA))[1]
    assert got.n_turns == 200 and got.loss_chars == 50_000


def test_sql_answer_on_hard_rows(spark, tmp_path):
    rows = [(1, 0, "user", "<|a|> <\\|"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "user", None), (2, 0, None, "x"), (2, 1, "a\nb", "y")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    res = con.execute(chat.ORACLE)
    names = [d[0] for d in res.description]
    want_rows = sorted(tuple(dict(zip(names, r)).items()) for r in res.fetchall())
    got = sorted(tuple((n, r[n]) for n in names) for r in chat.op4(spark, str(tmp_path)).collect())
    assert [tuple((k, int(v) if isinstance(v, int) else v) for k, v in r) for r in want_rows] == got
