"""Chat formatting: layouts, escaping, reading back."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from metagauge.llm import chat
from metagauge.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
TRICKY = ["", "plain", "<|end|>\n", "<|turn|>user\nhi", "</s>[INST] ok [/INST]", "\\", "\\0\\1\\2\\3", "<<SYS>>", "<", "|", "<<|", "é\n日", "a" * 50_000]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_matches_its_twin(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    result = duck.execute(SQL["op1_chat_format"])
    names, expected = [d[0] for d in result.description], sorted(result.fetchall())
    df = QUERIES["op1_chat_format"](spark, SF_DIR)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == expected
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_every_text_comes_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "a\nb<|", "\\3"]) for t, text in enumerate(TRICKY)]
    out = chat.format_turns(_rows(spark, rows)).select("*", chat.read_turns().alias("turns"), chat.read_loss().alias("loss"))
    for r in out.collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == ("".join(TRICKY) if own[0][2] == "assistant" else "")
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == len(TRICKY) == r.n_turns
        for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in r.formatted


def test_nulls_ties_and_order(spark):
    rows = [(None, 1, "user", "b"), (None, None, None, None), (1, 2, "assistant", "z"), (1, 2, "assistant", "a"), (1, 0, "user", "q")]
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(_rows(spark, rows + rows[:1]))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[None].turns_sha256 == digest("\n\nuser\nb\nuser\nb\n") and found[None].n_turns == 3
    assert found[1].turns_sha256 == digest("user\nq\nassistant\na\nassistant\nz\n")
    assert (found[1].loss_chars, found[1].loss_sha256) == (2, digest("az"))
    assert chat.format_turns(_rows(spark, [])).count() == 0


def test_layouts_by_schema(spark):
    messages = spark.sql("SELECT 1L conv_id, array(named_struct('role', 'Human', 'content', 'a', 'weight', 1)) messages, 'x' input")
    assert chat.layout_of(messages.schema).name == "messages"
    assert [tuple(r) for r in chat.canonical_turns(messages).collect()] == [(1, 0, "user", "a")]
    flat = spark.createDataFrame([(1, "do", "", "done"), (2, None, "in", None)], "id long, instruction string, input string, output string")
    found = [tuple(r) for r in chat.canonical_turns(flat, "id").collect()]
    assert found == [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "in"), (2, 1, "assistant", "")]
    shared = spark.sql("SELECT 1L conv_id, cast(null as array<struct<`from`: string, value: string>>) conversations")
    assert chat.layout_of(shared.schema).name == "from and value" and chat.canonical_turns(shared).count() == 0
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)


def test_fingerprints_tell_layouts_apart():
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b", "a"]) != chat.fingerprint(["a"])


def test_layouts_by_document(spark):
    given = [
        '{"messages":[{"role":"human","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"instruction":"x","input":"","output":"y"}',
        '{"conversations":[{"from":"gpt","value":"v"}],"id":7}',
        "no json",
        None,
        '{"prompt":"p","response":"r","system":"s","n":1.5}',
        '{"messages":[]}',
        '{"question":1,"answer":null}',
        '{"dialog":[{"speaker":"bot","text":"t","mood":{"x":1}}]}',
    ]
    df = spark.createDataFrame(list(enumerate(given)), "conv_id long, turn string").withColumnRenamed("turn", "json")
    found = sorted(tuple(r) for r in chat.canonical_turns_of_json(df.withColumn("role", F.lit(1)), "json").collect())
    assert found == [
        (0, 0, "user", "a"),
        (0, 1, "assistant", "b"),
        (1, 0, "user", "x"),
        (1, 1, "assistant", "y"),
        (2, 0, "assistant", "v"),
        (5, 0, "system", "s"),
        (5, 1, "user", "p"),
        (5, 2, "assistant", "r"),
        (7, 0, "user", "1"),
        (7, 1, "assistant", ""),
        (8, 0, "assistant", "t"),
    ]
