"""Session files of each format, made here, against what they must come to."""

import json
import sqlite3

import pytest

from colloquy.sources.ingest import parse_lines, read_sessions
from colloquy import parsers
from colloquy.sources.lines import detect_kinds, session_lines


def lines_of(spark, named):
    """Lines as they would be read from files of these names and texts."""
    rows = [(name, n, line) for name, text in named.items() for n, line in enumerate(text.split("\n"), 1) if line.strip(" \t")]
    return spark.createDataFrame(rows, "path string, source_seq long, line string")


def files(spark, **named):
    return lines_of(spark, {name: "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) for name, lines in named.items()})


@pytest.fixture(autouse=True)
def blocks(monkeypatch):
    """All parsers with files of many blocks; the registered queries have files of one."""
    monkeypatch.setattr(parsers, "BLOCK_LINES", 3)


def collected(parsed):
    return {t: [r.asDict() for r in getattr(parsed, t).collect()] for t in ("sessions", "messages", "tool_calls", "errata")}


def event(n, kind, message=None, **more):
    out = {"uuid": f"e{n}", "type": kind, "timestamp": f"2026-06-20T11:00:{n:02d}Z", "sessionId": "s1", "version": "1", "cwd": "/work/app"} | more
    return out | ({"message": message} if message is not None else {})


@pytest.mark.parametrize("split", [1 << 27, 64, 7])
def test_lines_keep_their_numbers_in_splits_of_any_size(spark, tmp_path, split, rng=__import__("random").Random(3)):
    texts = {
        "a.jsonl": "\ufeff{\"a\":1}\r\n\r\n  \nlast", "b.jsonl": "", "c.jsonl": "\n\n\t\n", "sub/d.jsonl": "\r\n" * 30 + "é\u2028x\ry\r\r\n",
        "e.jsonl": "\n".join("w" * rng.randrange(40) for _ in range(300)) + "\n", "f.jsonl": "x" * 500, "subagents/g.jsonl": "hidden", "h.txt": "no session",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    want = set()
    for name in ("a.jsonl", "b.jsonl", "c.jsonl", "sub/d.jsonl", "e.jsonl", "f.jsonl"):
        for n, line in enumerate(texts[name].removeprefix("\ufeff").split("\n"), 1):
            line = line.removesuffix("\r")
            if line.strip(" \t"):
                want.add((name, n, line))
    names = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        rows = session_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == len(want) and {(r.path.partition(f"{tmp_path}/")[2], r.source_seq, r.line) for r in rows} == want


def test_kinds(spark):
    named = {
        "a": [event(1, "user")], "b": [{"type": "session_meta", "payload": {"id": "x"}}], "c": [{"kind": 0, "v": {"sessionId": "q"}}],
        "d": [{"type": "session.start", "sessionId": "q"}], "e": ["nonsense"]
    }
    assert {r.path: r.kind for r in detect_kinds(files(spark, **named)).collect()} == {
        "a": "claude", "b": "codex", "c": "copilot-chat", "d": "copilot-transcript", "e": None
    }


def test_a_blank_first_line_hides_the_kind(spark):
    lines = lines_of(spark, {"f": "\n" + json.dumps(event(1, "user"))})
    assert [r.kind for r in detect_kinds(lines).collect()] == [None]
    out = collected(parse_lines(lines))
    assert out["sessions"] == [] and [e["kind"] for e in out["errata"]] == ["parse_error"]


def test_discovery_counts_and_tells_what_fails(spark, tmp_path):
    from colloquy.sources.discover import discover_all, total_count

    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    (tmp_path / ".claude/projects/p/a.jsonl").write_text(json.dumps(event(1, "user", {"content": "x"})))
    (tmp_path / ".claude/projects/p/b.jsonl").write_text("something else")
    (tmp_path / ".codex/sessions").mkdir(parents=True)
    (tmp_path / ".hermes").mkdir()
    (tmp_path / ".hermes/state.db").write_text("no database at all")
    found = {d.source: d for d in discover_all(spark, str(tmp_path), env={})}
    assert found["claude"].sessions == 1 and found["codex"].sessions == 0 and found["codex"].errors == []
    assert found["hermes"].sessions == 0 and "database" in found["hermes"].errors[0] and total_count([*found.values()]) == 1


def test_calls_without_their_request_are_errata(spark):
    from colloquy.sources.ingest import one_path_a_session

    rows = [
        {"type": "session.start", "sessionId": "q", "timestamp": 0}, {"type": "tool.execution_start", "tool_call_id": "t", "tool_name": "x", "timestamp": 1},
        {"type": "user.message", "content": "hi", "timestamp": 2}
    ]
    out = collected(one_path_a_session(parse_lines(files(spark, f=rows))))
    assert len(out["tool_calls"]) == 1 and "unmatched_request" in [e["kind"] for e in out["errata"]]


def test_claude(spark):
    lines = [
        event(1, "user", {"content": "List files."}),
        event(
            2, "assistant",
            {
                "model": "m1",
                "content": [
                    {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "I'll list."},
                    {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}
                ],
                "usage": {"input_tokens": 3, "output_tokens": 10}
            }
        ),
        event(
            3, "user",
            {
                "content": [
                    {
                        "type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}],
                        "is_error": False
                    },
                    {"type": "text", "text": "and?"}
                ]
            },
            gitBranch="main"
        ),
        event(4, "system", {"content": "x"}),
        event(5, "custom-title", {"content": "A title"}),
        event(6, "weird"),
        event(7, "user", {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "image"}]}]}),
        "{broken",
        event(9, "assistant", {"model": "m2", "content": "Bye.", "usage": {"output_tokens": 2, "cache_read_input_tokens": 7}}),
    ]
    out = collected(parse_lines(files(spark, f=lines)))
    (s,) = out["sessions"]
    assert (s["source"], s["native_id"], s["title"], s["model"], s["git_branch"], s["project_slug"]) == ("claude", "s1", "A title", "m1", "main", "app")
    assert (
        s["input_tokens"], s["output_tokens"], s["cache_read_tokens"], s["total_tokens"], s["message_count"], s["tool_call_count"], s["error_count"]
    ) == (3, 12, 7, 22, 4, 1, 3)
    assert (s["started_at"], s["ended_at"]) == ("2026-06-20T11:00:01Z", "2026-06-20T11:00:09Z")
    messages = sorted(out["messages"], key=lambda m: m["source_seq"])
    assert [(m["role"], m["content"], m["thinking"], m["turn_number"]) for m in messages] == [
        ("user", "List files.", None, 1), ("assistant", "I'll list.", "hm", 2), ("user", "one\ntwo\nand?", None, 3), ("assistant", "Bye.", None, 4)
    ]
    (c,) = out["tool_calls"]
    assert (c["call_id"], c["tool_name"], c["tool_input"], c["tool_output"], c["is_error"]) == ("c1", "Bash", '{"command":"ls"}', "one\ntwo", False)
    assert c["request_message"] == messages[1]["uuid"] and c["response_message"] == messages[2]["uuid"]
    assert sorted((e["kind"], e["source_seq"]) for e in out["errata"]) == [("parse_error", 7), ("parse_error", 8), ("unknown_event_kind", 6)]


def test_a_used_id_overwrites_and_takes_the_later_result(spark):
    use = lambda n, name: event(n, "assistant", {"content": [{"type": "tool_use", "id": "c", "name": name, "input": {}}]})
    answer = lambda n, text: event(n, "user", {"content": [{"type": "tool_result", "tool_use_id": "c", "content": text}]})
    out = collected(
        parse_lines(files(spark, f=[answer(1, "stray"), use(2, "A"), answer(3, "first"), use(4, "B")], g=[use(2, "A"), answer(3, "x"), answer(5, "y")]))
    )
    calls = {c["tool_name"]: c["tool_output"] for c in out["tool_calls"]}
    assert calls == {"B": None, "A": "y"}


def item(n, kind, payload, at=True):
    return {"timestamp": f"2026-01-01T00:00:{n:02d}Z", "type": kind, "payload": payload}


def test_codex(spark):
    lines = [
        item(1, "session_meta", {"id": "x1", "cwd": "/w/proj", "git": {"branch": "dev"}, "forked_from_id": "x0", "originator": "cli"}),
        item(2, "turn_context", {"model": "gpt", "summary": ""}),
        item(3, "event_msg", {"type": "user_message", "message": "Do it " * 30}),
        item(
            4, "response_item",
            {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "ok"}, {"type": "image"}, {"type": "text", "text": ""}]}
        ),
        item(5, "response_item", {"type": "function_call", "call_id": "c1", "name": "exec", "arguments": "{\"a\":1}"}),
        item(6, "response_item", {"type": "function_call_output", "call_id": "c1", "output": "done"}),
        item(7, "event_msg", {"type": "exec_command_end", "call_id": "c1", "exit_code": 1, "aggregated_output": "late"}),
        item(8, "event_msg", {"type": "mcp_tool_call_begin", "call_id": "c2", "arguments": {"q": 2}}),
        item(9, "event_msg", {"type": "mcp_tool_call_end", "call_id": "c2", "tool": "mcp", "result": "r"}),
        item(
            10, "event_msg",
            {
                "type": "token_count",
                "info": {"total_token_usage": {"input_tokens": 150, "output_tokens": 60, "cached_input_tokens": 70, "reasoning_output_tokens": 20}}
            }
        ),
        item(11, "event_msg", {"type": "token_count", "input": 10, "output": 5}),
        item(12, "response_item", {"type": "reasoning", "text": "why"}),
        item(13, "response_item", {"type": "function_call_output", "call_id": "nobody", "output": "x"}),
        item(14, "world_state", {}), item(15, "world_state", {}), item(
            16, "event_msg", {"type": "turn_started"}
        ), item(17, "event_msg", {"type": "odd"}), item(18, "other", {}),
        item(
            19, "event_msg", {"type": "warning", "message": "careful"}
        ), item(20, "compacted", {"summary": "s"}), item(21, "response_item", {"type": "strange"}),
    ]
    out = collected(parse_lines(files(spark, f=lines)))
    (s,) = out["sessions"]
    assert (s["input_tokens"], s["output_tokens"], s["cache_read_tokens"], s["cache_write_tokens"]) == (150, 80, 70, 0)
    assert s["title"] == ("Do it " * 30)[:80] and s["model"] == "gpt" and s["git_branch"] == "dev" and s["project_slug"] == "proj" and s["parent_session_id"]
    messages = sorted(out["messages"], key=lambda m: m["source_seq"])
    assert [(m["role"], m["content"], m["thinking"]) for m in messages][1:] == [("assistant", "ok", None), ("assistant", None, "why")]
    calls = {c["call_id"]: c for c in out["tool_calls"]}
    assert calls["c1"]["tool_output"] == "done" and calls["c1"]["is_error"] is True and calls["c1"]["tool_input"] == '"{\\"a\\":1}"' and calls["c1"]["response_message"] == messages[1]["uuid"]
    assert (calls["c2"]["tool_name"], calls["c2"]["tool_output"], calls["c2"]["tool_input"], calls["c2"]["is_error"]) == ("mcp", "r", '{"q":2}', None)
    kinds = sorted(e["kind"] for e in out["errata"])
    assert kinds == sorted(
        [
            "dropped_metadata", "tool_call_from_event_msg", "unpaired_tool_output", "skipped_event", "skipped_event", "unknown_event_type", "warning",
            "history_compacted", "unknown_response_subtype"
        ]
    )


def test_codex_orphans_and_lost_files(spark):
    lines = [item(1, "session_meta", {"id": "x"}), item(2, "response_item", {"type": "function_call", "call_id": "c", "name": "f"})]
    out = collected(parse_lines(files(spark, f=lines)))
    (c,) = out["tool_calls"]
    assert c["request_message"] == c["response_message"] and [e["kind"] for e in out["errata"]] == ["orphan_tool_call"]


def test_copilot_chat(spark):
    lines = [
        {
            "kind": 0,
            "v": {
                "sessionId": "q", "creationDate": 1750000000123, "customTitle": "Old",
                "requests": [
                    {
                        "message": {"text": "hi"}, "model": "m",
                        "responseItems": [{"kind": "text", "text": "a"}, {"kind": "code", "text": "b"}, {"kind": "x", "text": "no"}]
                    }
                ]
            }
        },
        {"kind": 1, "k": ["customTitle"], "v": "New"},
        {"kind": 2, "k": ["requests"], "v": [{"message": {"parts": [{"type": "text", "text": "p"}]}, "response": [{"value": "r1"}, {"value": "r2"}]}]},
        {"kind": 1, "k": ["other"], "v": 1}, {"kind": 2, "k": ["x", "y"], "v": []}, {"kind": 9, "v": 0}, "{",
    ]
    out = collected(parse_lines(files(spark, f=lines)))
    (s,) = out["sessions"]
    assert (s["title"], s["model"], s["started_at"], s["ended_at"], s["message_count"]) == ("New", "m", "2025-06-15T15:06:40.123Z", None, 4)
    assert [m["content"] for m in sorted(out["messages"], key=lambda m: m["turn_number"])] == ["hi", "a\nb", "p", "r1\nr2"]
    assert sorted(e["kind"] for e in out["errata"]) == ["parse_error", "unhandled_array_patch", "unhandled_property_patch", "unknown_patch_kind"]


def test_copilot_transcript(spark):
    lines = [
        {"type": "session.start", "sessionId": "t", "timestamp": 1000},
        {"type": "user.message", "content": "q", "timestamp": 2000},
        {"type": "tool.execution_start", "tool_call_id": "a", "tool_name": "early", "timestamp": 2500},
        {"type": "assistant.message", "content": [{"type": "text", "text": "x"}], "model": "m1"},
        {"type": "tool.execution_start", "tool_call_id": "b", "tool_name": "tool", "timestamp": 3000},
        {"type": "tool.execution_complete", "tool_call_id": "b", "result": "out", "timestamp": 4000},
        {"type": "tool.execution_complete", "tool_call_id": "c", "result": {"z": 1}, "timestamp": 5000},
        {"type": "assistant.message", "content": "y", "model": "m2"}, {"type": "odd"},
    ]
    out = collected(parse_lines(files(spark, f=lines)))
    (s,) = out["sessions"]
    assert (s["started_at"], s["ended_at"], s["model"], s["message_count"]) == ("1970-01-01T00:00:01.000Z", "1970-01-01T00:00:05.000Z", "m2", 3)
    calls = {c["call_id"]: c for c in out["tool_calls"]}
    assert calls["b"]["tool_output"] == "out" and calls["b"]["ended_at"] == "1970-01-01T00:00:04.000Z" and calls["c"]["tool_output"] is None and calls["a"]["response_message"]
    assert sorted(e["kind"] for e in out["errata"]) == ["dangling_tool_start", "orphan_tool_complete", "tool_before_assistant", "unknown_transcript_event"]


@pytest.fixture
def opencode(tmp_path):
    path = tmp_path / "opencode.db"
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE session(id TEXT, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT, model TEXT, cost REAL, tokens_input INT, tokens_output INT, tokens_reasoning INT, tokens_cache_read INT, tokens_cache_write INT);
      CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, time_created INT, data TEXT);""")
    db.execute("INSERT INTO session VALUES('s', NULL, '/w/p', 'T', 1000, 2000, '{\"id\":\"m\"}', NULL, 1, 2, 0, 3, 4)")
    say = lambda k, role, n, **more: db.execute("INSERT INTO message VALUES(?,?,?,?)", (k, "s", n, json.dumps({"role": role} | more)))
    say("m1", "user", 1), say("m2", "assistant", 2, parentID="m1", tokens={"input": 5, "output": 6}), say("m3", "tool", 3)
    db.execute("INSERT INTO message VALUES('m4','s',4,'{bad')")
    part = lambda k, m, n, **data: db.execute("INSERT INTO part VALUES(?,?,?,?)", (k, m, n, json.dumps(data)))
    part("p1", "m1", 1, type="text", text="hello"), part(
        "p2", "m2", 2, type="reasoning", text="think"
    ), part("p3", "m2", 3, type="text", text="b"), part("p4", "m2", 1, type="text", text="a")
    state = {"status": "completed", "input": {"x": 1}, "output": "o", "time": {"start": 1500, "end": 1600}}
    part("p5", "m2", 4, type="tool", tool="t", callID="c", state=state), part("p6", "m2", 5, type="tool", tool="t", callID="c", state=state), part("p7", "m2", 6, type="step-start"), part("p8", "m2", 7, type="new"), part("p9", "m2", 8, type="tool", tool="u", callID="d", state={"status": "running"})
    db.commit()
    return str(path)


def test_opencode(spark, opencode):
    out = collected(read_sessions(spark, opencode))
    (s,) = out["sessions"]
    assert (s["title"], s["model"], s["started_at"], s["total_tokens"], s["project_slug"]) == ("T", "m", "1970-01-01T00:00:01.000Z", 10, "p")
    messages = {m["source_seq"]: m for m in out["messages"]}
    assert messages[2]["content"] == "a\nb" and messages[2]["thinking"] == "think" and messages[2]["parent_uuid"] == messages[1]["uuid"] and messages[2]["output_tokens"] == 6 and len(messages) == 2
    calls = {c["call_id"]: c for c in out["tool_calls"]}
    assert calls["c"]["is_error"] is False and calls["c"]["tool_output"] == "o" and calls["d"]["is_error"] is None and len(out["tool_calls"]) == 2
    assert sorted(e["kind"] for e in out["errata"]) == ["duplicate_tool_call", "incomplete_tool_call", "parse_error", "unknown_part_type"]


def test_hermes(spark, tmp_path):
    path = str(tmp_path / "state.db")
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE compression_locks(x); CREATE TABLE sessions(id TEXT, source TEXT, model TEXT, parent_session_id TEXT, started_at REAL, ended_at REAL, title TEXT, cwd TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, archived INT);
      CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_call_id TEXT, tool_calls TEXT, reasoning_content TEXT, timestamp REAL, active INT);""")
    for row in (("s0", "telegram", "m", None, 1.0, 2.0, None, "/w/q", 1, 1, 1, 1, 1), ("s1", "telegram", "m", "s0", 10.9996, None, "T", "", 1, 2, 3, 4, 0)):
        db.execute("INSERT INTO sessions VALUES(?,?,?,?,?,?,?,?,?,?,?,?,?)", row)
    call = lambda k: json.dumps([{"call_id": k, "function": {"name": f"f{k}", "arguments": "{}"}}])
    rows = [
        ("session_meta", "x", None, None), ("tool", "orphan", "a", None), ("user", "hi", None, None), ("assistant", "", None, call("a")),
        ("assistant", "two", None, call("a")), ("tool", '{"exit_code": 3}', "a", None), ("tool", "", "a", None), ("assistant", None, None, call("z")),
        ("assistant", None, None, "{}"), ("ghost", "", None, None)
    ]
    for n, (role, content, call_id, calls) in enumerate(rows, 1):
        db.execute("INSERT INTO messages VALUES(?,?,?,?,?,?,?,?,1)", (n, "s1", role, content, call_id, calls, "r" if role == "assistant" else None, float(n)))
    db.execute("INSERT INTO messages VALUES(99,'s1','user','gone',NULL,NULL,NULL,9,0)")
    db.commit()
    out = collected(read_sessions(spark, path))
    (s,) = out["sessions"]
    assert s["native_id"] == "telegram:s1" and s["started_at"] == "1970-01-01T00:00:11.000Z" and s["parent_session_id"] and s["message_count"] == 5
    calls = sorted(out["tool_calls"], key=lambda c: c["source_seq"])
    assert [(c["call_id"], c["tool_output"], c["is_error"], c["ended_at"]) for c in calls] == [
        ("a", '{"exit_code": 3}', True, "1970-01-01T00:00:06.000Z"), ("a", None, None, "1970-01-01T00:00:07.000Z"), ("z", None, None, None)
    ]
    assert sorted(e["kind"] for e in out["errata"]) == ["duplicate_call_id", "orphaned_tool_response", "parse_error", "unknown_role", "unresolved_tool_call"]
    assert [m["content"] for m in sorted(out["messages"], key=lambda m: m["source_seq"])][:3] == ["hi", None, "two"]


def _store(path, n):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE session (id TEXT, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT, model TEXT, tokens_input INT, tokens_output INT, tokens_cache_read INT, tokens_cache_write INT)")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)")
    db.execute("CREATE TABLE part (id TEXT, message_id TEXT, time_created INT, data TEXT)")
    for k in range(n):
        db.execute("INSERT INTO session VALUES (?, NULL, '/w', 't', ?, 1, NULL, 1, 1, 0, 0)", (f"s{k}", 1_000_000 * k))
        db.execute("INSERT INTO message VALUES (?, ?, 1, ?)", (f"m{k}", f"s{k}", json.dumps({"role": "user"})))
        db.execute("INSERT INTO part VALUES (?, ?, 1, ?)", (f"p{k}", f"m{k}", json.dumps({"type": "text", "text": f"said {k}"})))
    db.execute("DELETE FROM message WHERE id = 'm3'")
    db.commit()
    db.close()


def test_a_store_is_read_by_ranges_of_rows_and_only_what_is_asked(spark, tmp_path):
    from datetime import datetime, timezone

    from colloquy.operators.periods import Recency
    from colloquy.sources import sqlite as stores

    (tmp_path / "odd name%20#").mkdir()
    _store(tmp_path / "odd name%20#" / "a.db", 25)
    (tmp_path / "b.sqlite").write_text("no database")
    rows = stores.store_rows(spark, str(tmp_path), rows=4)
    assert rows.rdd.getNumPartitions() == 7 * 3 + 1  # ranges of three tables, and what is broken
    whole = sorted((r.kind, r["table"], r.row) for r in rows.collect())
    assert [k for k, _, _ in whole].count("broken") == 1 and len(whole) == 25 + 24 + 24 + 1
    sessions = rows.where("kind = 'opencode' and table = 'session'")
    assert sessions.rdd.getNumPartitions() == 7 and sessions.count() == 25
    plan = sessions._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan session_stores" in plan and "Filter " not in plan  # all conditions went to the source
    bytes_ = sorted((r.kind, r["table"], r.row) for r in stores._bytes_rows(spark, f"file://{tmp_path}", 0.0).collect())
    assert [x for x in bytes_ if x[0] != "broken"] == [x for x in whole if x[0] != "broken"] and len(bytes_) == len(whole)
    late = stores.store_rows(spark, str(tmp_path / "odd name%20#" / "a.db"), Recency(datetime.fromtimestamp(20_000, timezone.utc)), rows=3)
    assert late.groupBy("table").count().collect() and {(r["table"], r["count"]) for r in late.groupBy("table").count().collect()} == {("session", 5), ("message", 5), ("part", 5)}


def test_joins_of_a_store_send_nothing_through_the_driver(spark):
    """Spark takes aggregated texts for short and would broadcast them."""
    from colloquy.plans.round_trips import opencode_rows
    from colloquy.sources.ingest import parse_stores

    turns = spark.createDataFrame([(f"s{k // 4}", k % 4 + 1, ("user", "assistant")[k % 2], f"text {k}") for k in range(40)], "path string, n long, role string, content string")
    parsed = parse_stores(opencode_rows(turns))
    for table, n in ((parsed.sessions, 10), (parsed.messages, 40), (parsed.tool_calls, 20), (parsed.errata, 0)):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString() and table.count() == n
