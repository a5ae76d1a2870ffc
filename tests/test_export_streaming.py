import json

from spoorlake.schema import validate_examples
from spoorlake.sources import export, normalize
from spoorlake.streaming import ingest
from tests.test_sources import raw

ROWS = [
    {"type": "user", "session_id": "s", "message": {"content": "please"}},
    {"type": "assistant", "message": {"id": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"p": 1}}, {"type": "tool_use", "id": "c2", "name": "cat", "input": {}}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c2", "content": "two"}, {"type": "tool_result", "tool_use_id": "c1", "content": "one"}]}},
    {"type": "assistant", "message": {"id": "m2", "content": [{"type": "text", "text": "done"}]}},
]


def events(spark):
    return normalize.message_stream(raw(spark, ROWS, "messages", "stream-v1"))


def test_trajectory_documents_and_spans(spark):
    ev = events(spark).cache()
    doc = json.loads(export.trajectory_documents(ev).collect()[0].document)
    assert doc["final_metrics"]["total_prompt_tokens"] == 5
    calls = [s for s in doc["steps"] if "tool_calls" in s]
    assert sum(len(s["tool_calls"]) for s in calls) == 2 and all(s["observation"][0]["source_call_id"] == s["tool_calls"][0]["tool_call_id"] for s in calls)
    assert any(s.get("message") == "done" for s in doc["steps"]) and any(s.get("reasoning_content") == "hm" for s in doc["steps"])
    assert len(json.loads(export.spans(ev).collect()[0].spans)) == ev.count()


def test_examples_are_valid_and_round_trip(spark, tmp_path):
    made = export.examples(events(spark)).cache()
    row = validate_examples(made).collect()[0]
    assert row.violations == [] and [m.role for m in row.messages] == ["user", "assistant", "assistant", "assistant", "tool", "tool", "assistant"]
    assert row.assistant_loss_mask == [False, True, True, True, False, False, True] and [t.function.name for t in row.tools] == ["cat", "ls"]
    path = str(tmp_path / "out")
    export.publish(spark, path, {"examples": lambda p: made.write.parquet(p), "lines": lambda p: made.write.json(p)})
    back = spark.read.parquet(f"{path}/examples")
    assert export.compare_rows(made, back).count() == 0 and export.verify(spark, path).count() == 0
    lines = spark.read.schema(made.schema).json(f"{path}/lines")
    assert export.compare_rows(made, lines).count() == 0
    assert [r.label for r in export.compare_rows(made, made.limit(0)).collect()] == [f"missing:{row.id}"]


def test_streaming_contiguity_and_publication(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 3, "z"), ("a", 4, "w"), ("b", 0, "p"), ("b", 0, "q"), ("b", 1, "r"), ("c", 1, "late")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"session_id": s, "seq": q, "event_id": f"{s}{q}", "captured_at": "2024-01-01T00:00:00Z", "payload": p}) for s, q, p in rows))
    stream = ingest.admit(ingest.read(spark, str(tmp_path / "in")))
    ingest.publish(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    good = sorted((r.session_id, r.seq, r.sequence) for r in spark.read.parquet(str(tmp_path / "good")).collect())
    bad = sorted((r.session_id, r.seq, r.verdict) for r in spark.read.parquet(str(tmp_path / "bad")).collect())
    assert good == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0)]
    assert bad == [("a", 1, "duplicate"), ("a", 3, "gap"), ("a", 4, "quarantined"), ("b", 0, "conflict"), ("b", 1, "quarantined"), ("c", 1, "gap")]


def test_streaming_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"session_id": "a", "seq": 0, "event_id": "e", "captured_at": "2024-01-01T00:00:00Z", "payload": "p"}
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, [row, row, row | {"event_id": "f"}])))
    q = ingest.drop_repeats(ingest.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("repeats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("repeats").count() == 2
