from spoorlake.operators.replay import INPUT, request_epochs

START = [(0, "session/start"), (1, "request/header"), (2, "turn/start"), (3, "step/start")]


def session(name, *rows):
    out = []
    for seq, kind, *more in rows:
        op, start, end, sources = [*more, None, None, None, None][:4]
        out.append((name, seq, kind, op, start, end, sources, 1, 1))
    return out


def test_epochs(spark):
    good = session("a", *START, (4, "user/message", "append"), (5, "assistant/message", "append"), (6, "tool/result", "append"), (7, "system/message", "replace", 4, 6, [4, 5, 6]), (8, "assistant/message", "append"), (9, "step/end"))
    gap = session("b", *START, (5, "user/message", "append"), (6, "assistant/message", "append"))
    bad = session("c", *START, (4, "user/message", "append"), (5, "system/message", "replace", 4, 4, []), (6, "assistant/message", "append"))
    odd = session("d", *START, (4, "new/kind", "ignorable"), (5, "other/kind"), (6, "assistant/message", "append"))
    bare = session("e", (0, "user/message", "append"), (1, "assistant/message", "append"))
    got = {(r.session_id, r.output_seq): r for r in request_epochs(spark.createDataFrame(good + gap + bad + odd + bare, INPUT)).collect()}
    assert (got["a", 5].context, got["a", 8].context, got["a", 8].header_seq, got["a", 8].turn, got["a", 8].blocked) == ([4], [7], 1, 1, None)
    assert [got[k].blocked for k in (("b", 6), ("c", 6), ("d", 6), ("e", 1))] == ["sequence_gap_or_duplicate", "surface_sources_incomplete", "unknown_required_event", "header_missing"]
    assert request_epochs(spark.createDataFrame([], INPUT)).count() == 0
