"""Layouts to canonical turns, reversible escapes, loss masks, the query against SQL and by hand."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripparity.llm import chatformat as C

CASES = [
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None}]}, [("user", "a"), ("tool", "")]),
    ("messages", {"messages": []}, []),
    ("messages", {"id": 7, "meta": {"x": [1]}, "messages": [{"role": "user", "content": "", "name": "n"}]}, [("user", "")]),
    ("message_parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "s"},
     [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ("prompt_response", {"prompt": "p", "response": "", "system": None}, [("user", "p"), ("assistant", "")]),
    ("prompt_completion", {"completion": "c", "prompt": "p", "system": ""}, [("system", ""), ("user", "p"), ("assistant", "c")]),
    ("instruction", {"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("question_answer", {"data": {"question": "q", "answer": "a"}}, [("user", "q"), ("assistant", "a")]),
    ("alternating", {"turns": ["a", "b", "c"]}, [("user", "a"), ("assistant", "b"), ("user", "c")]),
    (None, {"prompt": "p"}, None),
    (None, {"prompt": 5, "response": "r"}, None),
    (None, {"prompt": "p", "response": "r", "messages": [{"role": "u", "content": "c"}]}, None),
    (None, {}, None),
]


@pytest.mark.parametrize("name, record, turns", CASES)
def test_layouts(name, record, turns):
    key, layout, got = C.Registry().canonical(json.dumps(record))
    assert (layout, got) == (name, turns) and len(key) == 16


def test_key_order_and_extra_fields_do_not_matter_but_kinds_do():
    one = C.Registry().canonical('{"b":1,"prompt":"p","response":"r"}')
    two = C.Registry().canonical('{"response":"x","prompt":"y"}')
    assert one[0] == two[0] != C.Registry().canonical('{"response":true,"prompt":"y"}')[0]
    with pytest.raises(ValueError):
        C.Registry((C.Layout("a", ("x:text",), ()), C.Layout("b", ("x:text",), ())))


@pytest.mark.parametrize("text", [None, "", "null", "[1]", "{", '"x"', "9" * 5000, "[" * 100000])
def test_what_is_no_record(text):
    assert C.Registry().canonical(text) == (None, None, None)


nasty = st.lists(st.sampled_from(["<", "|", ">", "[", "]", "\\", "-", "n", "\n", "/", "s", "INST", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>",
                                  C.START, C.END, "<|im_end", "im_end|>", "é\U0001f600", " "]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), nasty), nasty), max_size=5))
def test_round_trip_and_mask(turns):
    formatted, loss = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[s:e]) for s, e in loss] == [t for r, t in turns if r == "assistant"]
    assert formatted.count(C.START) == formatted.count(C.END) == len(turns)
    for _, text in turns:
        assert not C.re.search(C.CONTROL, C.escape(text))


def test_frame_of_mixed_records(spark):
    rows = [(i, None if r is None else json.dumps(r), "clash") for i, (_, r, _) in enumerate(CASES)]
    rows += [(90, None, "x"), (91, "{", "x"), (92, '{"prompt":"\\ud800","response":"\\ud83d\\ude00"}', "x"), (0, rows[0][1], "x"),
             (93, json.dumps({"prompt": "long " * 200000, "response": "</s>"}), "x")]
    frame = spark.createDataFrame(rows, "id int, record string, chat string")
    got = {r["id"]: r["chat"] for r in C.format_chats(frame).collect()}
    assert C.format_chats(frame).count() == len(rows)
    for i, (name, _, turns) in enumerate(CASES):
        assert got[i]["layout"] == name
        assert (None if got[i]["turns"] is None else [tuple(t) for t in got[i]["turns"]]) == turns
    assert [tuple(t) for t in got[92]["turns"]] == [("user", "\ufffd"), ("assistant", "\U0001f600")]
    assert got[93]["formatted"].endswith("assistant\n<\\-/s><|im_end|>\n")
    unknown = {r["fingerprint"]: r["n_records"] for r in C.undeclared_layouts(frame).collect()}
    assert unknown[None] == 2 and len(unknown) == 5
    assert C.format_chats(frame.limit(0)).count() == 0


def test_query_against_sql_and_hand(spark, tmp_path):
    rows = [(i, t, r, f"{r} {t} of {i} \\ <s> é") for i in range(40) for t, r in enumerate(["system", "user", "assistant", "user"][i % 3 == 0:2 + i % 3])]
    rows += [(100, 0, None, None), (100, 1, "tool\n</s>", "x"), (101, None, "user", None), (101, 1, "assistant", ""), (None, 0, "user", "u"),
             (102, 1, "user", "b"), (102, 1, "user", "b"), (102, 1, "assistant", "a"), (103, 0, "user,assistant", "one"), (104, 0, "assistant", "z" * 300000), (105, 0, "user", "q"), (105, 1, "assistant", "r")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in C.op13_chat_format(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(C.OP13_SQL).fetchall(), key=str)
    planted = next(r for r in got if r[0] == -1)
    said = "</s>[INST] ok [/INST]"
    assert planted[1:5] == (2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    layouts = {r["layout"] for r in C.format_chats(C.conversation_records(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).select("chat.layout").collect()}
    assert layouts == {"messages", "conversations", "prompt_response", "instruction"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in C.op13_chat_format(spark, str(tmp_path)).collect()] == [-1]
