import io
import json
import zipfile

from spoorlake.functions import udfs
from spoorlake.schema import EVENTS, validate_events
from spoorlake.sources import archive, detect, jsonl, normalize


def files(spark, **texts):
    return spark.createDataFrame([*texts.items()], "path string, content string")


def raw(spark, rows, adapter, interface):
    lines = spark.createDataFrame([("f", i + 1, json.dumps(r)) for i, r in enumerate(rows)], "path string, line long, value string")
    return normalize.raw_envelopes(lines, adapter, interface)


def shape(events):
    return [(r.event_type, r.actor, r.status) for r in events.orderBy("sequence").collect()]


def test_json_lines_and_diagnostics(spark):
    good, bad = jsonl.parse_lines(files(spark, a='{"x":1}\r\n[1]\n\nnope\n{"y":2}\n'))
    assert [r.line for r in good.orderBy("line").collect()] == [1, 5]
    assert [(r.line, r.code) for r in bad.orderBy("line").collect()] == [(2, "non_object"), (3, "empty_line"), (4, "invalid_json")]


def test_detection(spark):
    texts = {
        "g": '[{"mapping": {"n": {"message": null}}}]', "c": '[{"uuid": "u", "chat_messages": []}]', "t": '[{"time": "2024", "products": ["Gemini Apps"], "title": "Prompted hi"}]',
        "r": '{"choices": [], "object": "chat.completion"}', "l": '{"role": "user"}\n{"role": "assistant"}\n', "h": "<!DOCTYPE html><p>x", "z": "PK\x03\x04rest", "p": "plain",
    }
    got = {r.path: (r.format, r.records) for r in detect.detect(files(spark, **texts)).collect()}
    assert got == {"g": ("message_graph_export", 1), "c": ("chat_list_export", 1), "t": ("activity_takeout", 1), "r": ("completion", 1), "l": ("message_jsonl", 2), "h": ("html", 0), "z": ("rejected_zip", 0), "p": ("text", 0)}


def test_export_messages_link_parents(spark):
    graph = [{"mapping": {"n1": {"message": {"id": "m1", "author": {"role": "user"}, "content": {"parts": ["hi"]}, "create_time": 1.0}}, "n2": {"parent": "n1", "message": {"id": "m2", "author": {"role": "assistant"}, "content": {"parts": ["yo", "there"]}, "create_time": 2.0}}}}]
    docs = spark.createDataFrame([("f", json.dumps(graph))], "path string, value string")
    events = {r.text: r for r in normalize.chat_messages(detect.graph_messages(docs)).collect()}
    assert events["yo\nthere"].parent_span_id == events["hi"].span_id and events["hi"].sequence == 0 and events["yo\nthere"].actor == "assistant"
    chat = spark.createDataFrame([("f", json.dumps([{"uuid": "u", "chat_messages": [{"uuid": "a", "sender": "human", "text": "q"}, {"sender": "assistant", "text": "r"}]}]))], "path string, value string")
    assert [(r.message_id, r.role, r.text) for r in detect.list_messages(chat).orderBy("seq").collect()] == [("a", "human", "q"), ("1", "assistant", "r")]
    act = spark.createDataFrame([("f", json.dumps([{"time": "2024-01-01", "products": ["Gemini Apps"], "title": "Prompted  tell me", "description": "d"}]))], "path string, value string")
    assert [(r.role, r.text) for r in detect.activity_messages(act).orderBy("seq").collect()] == [("user", "tell me"), ("environment", "d")]
    done = spark.createDataFrame([("f", json.dumps({"id": "r", "model": "m", "choices": [{"index": 0, "message": {"content": "t", "tool_calls": [{"id": "c", "function": {"name": "n", "arguments": "{}"}}]}}], "usage": {"prompt_tokens": 3}}))], "path string, value string")
    row = detect.completion_messages(done).collect()[0]
    assert (row.text, row.tool_calls[0].name, row.input_tokens) == ("t", "n", 3)


def test_message_stream(spark):
    rows = [
        {"type": "system", "session_id": "s"},
        {"type": "assistant", "message": {"id": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hello"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"p": 1}}], "usage": {"input_tokens": 5, "output_tokens": -1}}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out", "is_error": True}]}},
        {"type": "stream_event", "event": {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "he"}}},
        {"type": "result", "subtype": "success", "result": "fine", "total_cost_usd": 0.5},
    ]
    events = normalize.normalize(raw(spark, rows, "messages", "stream-v1"), "messages", "stream-v1").cache()
    assert shape(events) == [("reasoning", "assistant", "ok"), ("message", "assistant", "ok"), ("tool.call", "assistant", "ok"), ("tool.result", "tool", "error"), ("model.inference", "assistant", "partial"), ("evaluation", "system", "ok")]
    first = events.orderBy("sequence").first()
    assert first.input_tokens == 5 and first.output_tokens is None and first.session_id == "s" and first.content[0].type == "reasoning"
    assert {r.call_id for r in events.where("call_id IS NOT NULL").collect()} == {"c1"} and events.select("trace_id").distinct().count() == 1
    assert all(not r.violations for r in validate_events(events.withColumn("ordinal", events.sequence)).collect())
    assert normalize.normalize(raw(spark, rows, "messages", "stream-v1"), "messages", "other") is None


def test_item_stream(spark):
    rows = [
        {"type": "thread.started", "thread_id": "t"},
        {"type": "item.started", "item": {"id": "c", "type": "command_execution", "command": "ls", "status": "in_progress"}},
        {"type": "item.completed", "item": {"id": "c", "type": "command_execution", "aggregated_output": "x", "exit_code": 2}},
        {"type": "item.completed", "item": {"id": "m", "type": "agent_message", "text": "done"}},
        {"type": "turn.completed", "usage": {"input_tokens": 9, "cached_input_tokens": 4}},
    ]
    events = normalize.item_stream(raw(spark, rows, "items", "exec-v1"))
    assert shape(events) == [("tool.call", "assistant", "partial"), ("tool.result", "tool", "error"), ("message", "assistant", "ok"), ("model.inference", "system", "ok")]
    last = events.orderBy("sequence").collect()
    assert last[1].exit_code == 2 and last[1].content[0].value == "x" and last[3].cache_read_tokens == 4


def test_hooks_and_durable_gap(spark):
    rows = [{"session_id": "s", "hook_event_name": "BeforeTool", "tool_name": "t", "tool_input": {"a": 1}}, {"session_id": "s", "hook_event_name": "AfterTool", "tool_name": "t", "tool_input": {"a": 1}, "tool_response": {"error": "no"}}, {"session_id": "s", "hook_event_name": "PermissionDenied"}, {"session_id": "s", "hook_event_name": "Odd"}]
    events = normalize.hook_stream(raw(spark, rows, "hooks", "hooks-v1")).orderBy("sequence").collect()
    assert [(r.event_type, r.status) for r in events] == [("tool.call", "ok"), ("tool.result", "error"), ("approval.decision", "cancelled")]
    assert events[0].call_id == events[1].call_id and events[0].call_id.startswith("synthetic:")
    kinds = [(0, "message/user"), (1, "message/assistant"), (3, "tool/call"), (4, "message/user")]
    rows = [{"session_id": "s", "event_id": f"s:{q}", "event": {"seq": q, "type": k, "time": 1700000000000 + q, "data": {"text": "x", "turn": 1}}} for q, k in kinds]
    got = normalize.durable_stream(raw(spark, rows, "durable", "session-v1"))
    assert shape(got) == [("message", "user", "ok"), ("message", "assistant", "ok")]


def test_zip_entries(spark, tmp_path):
    def make(name, *entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, t in entries:
                z.writestr(n, t)

    make("good.zip", ("b.json", "{}"), ("a.txt", "x"))
    make("up.zip", ("../x", "y"))
    make("twice.zip", ("A", "1"), ("a", "2"))
    (tmp_path / "bad.zip").write_bytes(b"PK nope")
    got = {(r.path.rpartition("/")[2], r.entry, r.rejected) for r in archive.zip_entries(spark, str(tmp_path)).collect()}
    assert got == {("good.zip", "a.txt", None), ("good.zip", "b.json", None), ("up.zip", None, "traversal"), ("twice.zip", None, "name_collision"), ("bad.zip", None, "damaged")}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x", "0" * 100)
    assert archive.inspect(data.getvalue(), {"entries": 1, "entry_bytes": 10, "total_bytes": 10})[1] == "entry_too_large"


def test_udf_functions(spark):
    assert udfs.canonical_json({"b": [1.0, 0.5, None], "a": "é"}) == '{"a":"é","b":[1,0.5,null]}'
    assert udfs.scrub({"type": "thinking", "signature": "x", "k": [{"encrypted_content": "y"}]}) == ({"type": "thinking", "k": [{}]}, 2)
    assert udfs.redact("mail a.b@example.com now") == "mail [REDACTED:EMAIL] now"
    assert [s[0] for s in udfs.spans("call +1 (555) 123-4567 on 2024-01-02 12")] == ["phone"]
    assert udfs.redact_structured({"apiToken": "abc", "note": "x@y.io", "sha256": "0" * 64}) == {"apiToken": "[REDACTED:SENSITIVE_KEY]", "note": "[REDACTED:EMAIL]", "sha256": "0" * 64}
    assert [udfs.is_spdx(x) for x in ("MIT", "MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)", "MIT AND", "(MIT", "", "MIT MIT")] == [True, True, False, False, False, False]
    df = spark.createDataFrame([('{"b":1,"a":2}', "ﬁ"), (None, None)], "j string, t string")
    assert [tuple(r) for r in df.select(udfs.canonical_json_udf()("j"), udfs.nfkc_udf()("t")).collect()] == [('{"a":2,"b":1}', "fi"), (None, None)]
    assert spark.createDataFrame([], EVENTS).count() == 0
