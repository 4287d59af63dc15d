import json

from paperloom.llm.chat_format import chat_format


def call(i, name, arguments, after=None):
    return {"id": i, "name": name, "arguments": arguments} | ({"after": after} if after else {})


def test_links_order_and_validation(spark):
    calls = [call("c", "search", {"query": "x"}, ["b"]), call("b", "lookup", {"row": 3, "table": "t"}, ["a"]), call("a", "calculate", {"precise": True, "expression": "1+1"}), call("bad", "lookup", {"table": 5}), call("no", "unknown", {}), call("loop", "search", {"query": "q", "limit": "many"}, ["loop"])]
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", '{"tool_call_id": "a", "content": "2"}'), (1, 3, "tool", '{"tool_call_id": "a", "content": "later"}'),
        (1, 4, "tool", '{"tool_call_id": "zz", "content": "?"}'), (2, 0, "tool", '{"tool_call_id": "a", "content": "other conversation"}'), (2, 1, "assistant", "{not json"), (2, 1, "assistant", "{not json"), (None, None, None, None), (3, 0, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS h", "'x' AS call_id")
    got = {(r.conv_id, r.turn): r for r in chat_format(spark, turns).collect()}
    assert chat_format(spark, turns).count() == len(rows)
    r = got[1, 1]
    assert (r.n_calls, r.n_answered, r.n_invalid) == (6, 1, 3)
    made = json.loads(r.json)
    assert [c["id"] for c in made["calls"]] == ["a", "bad", "no", "b", "c", "loop"]
    assert made["calls"][0] == {"arguments": '{"expression":"1+1","precise":true}', "id": "a", "name": "calculate", "result": "2", "valid": True}
    assert [c["valid"] for c in made["calls"]] == [True, False, False, True, True, False]
    assert got[1, 4].orphan and got[2, 0].orphan and not got[1, 2].orphan
    assert got[1, 0].json == '{"content":"say \\"hi\\"\\n","role":"user","turn":0}' and got[2, 1].json == '{"content":"{not json","role":"assistant","turn":1}'
    assert got[None, None].json == "{}"
    assert chat_format(spark, turns.limit(0)).count() == 0


def test_content_and_fields_beside_calls_stay(spark):
    calls = [call("a", "search", {"query": "x"})]
    texts = [
        {"content": 'I look "that" up.\n日本', "tool_calls": calls, "zeta": {"b": [1, "2"], "a": None}, "model": "m", "n": 1.5, "nothing": None},
        {"tool_calls": calls, "content": [{"type": "text", "text": "parts"}]},
        {"tool_calls": calls, "content": None},
        {"tool_calls": calls},
    ]
    turns = spark.createDataFrame([(1, i, "assistant", json.dumps(t)) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.turn: json.loads(r.json) for r in chat_format(spark, turns).collect()}
    assert all(len(got[i]["calls"]) == 1 for i in range(4))
    rest = [{k: v for k, v in got[i].items() if k != "calls"} for i in range(4)]
    assert rest[0] == {"content": 'I look "that" up.\n日本', "other": {"model": "m", "n": 1.5, "zeta": {"a": None, "b": [1, "2"]}}, "role": "assistant", "turn": 0}
    assert list(got[0]) == ["calls", "content", "other", "role", "turn"] and list(got[0]["other"]) == ["model", "n", "zeta"]
    assert rest[1] == {"content": [{"type": "text", "text": "parts"}], "role": "assistant", "turn": 1}
    assert rest[2:] == [{"role": "assistant", "turn": 2}, {"role": "assistant", "turn": 3}]


def test_twice_named_fields_beside_calls(spark):
    text = '{"content": "one", "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}}], "x": 1, "x": 2, "deep": {"k": 1, "k": 2}}'
    (got,) = chat_format(spark, spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()
    made = json.loads(got.json)
    assert made["content"] == "one" and set(made["other"]) == {"deep", "x"} and made["other"]["deep"].count('"k"') == 2
