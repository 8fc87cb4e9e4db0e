import hashlib
import json
import stat
import struct
import sys
import uuid
from datetime import datetime, timezone

import pytest

from colloquy import cli
from colloquy.errors import EmbedderError, NotFound, UsageError
from colloquy.functions.columns import NAMESPACE
from colloquy.operators import periods, report
from colloquy.streaming import watch
from colloquy.vault import Vault

NOW = datetime(2026, 6, 30, 12, tzinfo=timezone.utc)


def claude_file(path, native, day, texts, model="m", cwd="/w/app"):
    lines = []
    for n, text in enumerate(texts):
        kind = "user" if n % 2 == 0 else "assistant"
        lines.append(
            {
                "uuid": f"{native}-{n}", "type": kind, "timestamp": f"2026-06-{day:02d}T10:00:{n:02d}Z", "sessionId": native, "version": "1", "cwd": cwd,
                "message": {"content": text, "model": model, "usage": {"input_tokens": 10, "output_tokens": 1}}
            }
        )
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")


@pytest.fixture
def embedder(tmp_path):
    program = tmp_path / "embedder.py"
    program.write_text(f"""#!{sys.executable}
import hashlib, json, struct, sys
print(json.dumps({{"type": "model", "model": "hash", "dimensions": 4}}))
for line in sys.stdin:
    row = json.loads(line)
    print(json.dumps({{"id": row["id"], "embedding": [x / 0xFFFFFFFF for x in struct.unpack("<4I", hashlib.sha256(row["text"].encode()).digest()[:16])]}}))
""")
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    return str(program)


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "logs"
    claude_file(root / "a" / "one.jsonl", "s1", 10, ["kafka migration plan", "migrating now", "thanks"])
    claude_file(root / "b" / "two.jsonl", "s2", 29, ["other words", "nothing here"], "m2", "/w/lib")
    claude_file(root / "a" / "subagents" / "x.jsonl", "sx", 10, ["hidden"])
    return root


@pytest.fixture
def vault(spark, tmp_path):
    return Vault(spark, f"file://{tmp_path}/vault").init()


def sid(native):
    return str(uuid.uuid5(uuid.UUID(NAMESPACE), f"claude:{native}"))


def test_taking_in_twice_changes_nothing(vault, logs):
    first = vault.ingest(str(logs)).collect()
    assert {r["session_id"]: r["message_count"] for r in first} == {sid("s1"): 3, sid("s2"): 2}
    counts = {t: vault.table(t).count() for t in ("sessions", "messages", "tool_calls", "errata")}
    vault.ingest(str(logs / "a" / "one.jsonl"))
    assert {t: vault.table(t).count() for t in counts} == counts == {"sessions": 2, "messages": 5, "tool_calls": 0, "errata": 0}
    claude_file(logs / "a" / "one.jsonl", "s1", 10, ["only this"])
    vault.ingest(str(logs))
    assert vault.table("messages").count() == 3 and vault.init().table("sessions").count() == 2
    assert len(vault.manifest()["segments"]) == 3
    vault.merge(all_of_them=True)
    assert len(vault.manifest()["segments"]) == 1
    vault.vacuum()
    assert vault.table("messages").count() == 3 and vault.table("postings").where("term = 'kafka'").count() == 0
    with pytest.raises(NotFound):
        vault.ingest(str(logs / "missing"))


def test_segments_merge_by_size_and_stay_right(vault, logs, monkeypatch):
    from colloquy import vault as store

    monkeypatch.setattr(store, "MERGE_SHARE", 1e9)  # never
    for n in range(4):
        claude_file(logs / "a" / "one.jsonl", "s1", 10, [f"kafka take {n}"] * (n + 1))
        claude_file(logs / "n" / f"{n}.jsonl", f"n{n}", 11, ["plain words"])
        vault.ingest(str(logs))
    found = lambda: ({t: vault.table(t).count() for t in store.ALL}, [r["snippet"] for r in vault.grep("kafka")])
    before = found()
    assert len(vault.manifest()["segments"]) == 4 and before[0]["messages"] == 4 + 2 + 4 and before[1] == ["kafka take 3"] * 4
    monkeypatch.setattr(store, "MERGE_SHARE", 0.5)
    vault.merge()
    assert len(vault.manifest()["segments"]) == 1 and found() == before
    assert vault.vacuum() > 0 and found() == before


def test_the_last_path_of_a_session_wins_whole(vault, logs):
    claude_file(logs / "z" / "again.jsonl", "s1", 10, ["the other copy"])
    vault.ingest(str(logs))
    rows = vault.table("messages").where(f"session_id = '{sid('s1')}'").collect()
    own = vault.table("sessions").where(f"session_id = '{sid('s1')}'").first()
    assert [r.content for r in rows] == ["the other copy"] and own.message_count == 1 and own.raw_path.endswith("again.jsonl")


def test_errata_of_a_file_go_when_it_is_taken_in_again(vault, logs):
    bad = logs / "bad.jsonl"
    bad.write_text("no session\n")
    for _ in range(2):
        vault.ingest(str(logs))
        assert [r.kind for r in vault.table("errata").collect()] == ["parse_error"]
    claude_file(bad, "s9", 12, ["mended"])
    vault.ingest(str(logs))
    assert vault.table("errata").count() == 0 and vault.table("sessions").count() == 3
    vault.note("/some/file", "it broke")
    assert [(r.kind, r.raw_path) for r in vault.table("errata").collect()] == [("ingest_error", "/some/file")]


def test_old_vaults_are_migrated(spark, vault, logs, tmp_path):
    vault.ingest(str(logs))
    old = Vault(spark, f"file://{tmp_path}/old")
    tables = {}
    for name in ("sessions", "messages", "tool_calls", "errata"):
        rows = vault.table(name).drop("n_tokens", *([] if name in ("sessions", "errata") else ["raw_path"]))
        rows.write.parquet(f"{old.path}/{name}/v=2/bucket=0")
        tables[name] = {"0": 2, "1": 0}
    old.store.publish({"version": 2, "tables": tables, "config": {"kept": 1}})
    old.init()
    assert old.table("messages").count() == 5 and old.manifest()["config"] == {"kept": 1} and len(old.grep("kafka")) == 1
    assert not old.migrate()


def test_segments_of_format_2_stay_where_they_are(spark, vault, logs, tmp_path):
    vault.ingest(str(logs))
    vault.report("monthly", now=NOW)
    segment, n = vault.manifest()["segments"][0]
    old = Vault(spark, f"file://{tmp_path}/old")
    for name in (*store_tables(), "replaced"):
        spark.read.parquet(f"{vault.path}/{name}/{segment}").write.parquet(f"{old.path}/{name}/v=2")
    vault.rollup().write.parquet(f"{old.path}/usage_summary/v=3")
    config = {"rollup": 3, "remotes": {"/w/app": "https://host.example/team/app.git"}, "reports": {"global|2026-06-01|2026-06-15": {"saved": True}}}
    old.store.publish({"version": 4, "format": 2, "segments": [[2, n]], "config": config})
    old.init()
    assert old.manifest()["segments"] == [["v=2", n]] and set(old.manifest()["config"]) == {"remotes"}
    assert old.table("messages").count() == 5 and old.rollup().count() == 2 and {r.git_repo for r in old.projects().collect()} == {"app", None}
    assert old.report("custom", "2026-06-01", "2026-06-15", save=True, now=NOW) == {"saved": True, "from_cache": True}
    old.vacuum(abandoned=0)
    assert old.table("messages").count() == 5 and len(old.grep("kafka")) == 1


def store_tables():
    from colloquy.vault import ALL

    return ALL


def test_a_write_that_dies_half_way_harms_nothing(vault, logs, monkeypatch):
    vault.ingest(str(logs))
    before = vault.manifest()
    real = Vault._keys

    def dies(rows):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(Vault, "_keys", staticmethod(dies))
    with pytest.raises(RuntimeError):
        vault.ingest(str(logs))
    monkeypatch.setattr(Vault, "_keys", staticmethod(real))
    # one that has written its segment and dies before it is published
    change = type(vault.store).change
    monkeypatch.setattr(type(vault.store), "change", lambda self, make: dies(None))
    with pytest.raises(RuntimeError):
        vault.ingest(str(logs))
    monkeypatch.setattr(type(vault.store), "change", change)
    assert vault.manifest() == before and vault.table("messages").count() == 5
    (logs / "c.jsonl").write_text((logs / "b" / "two.jsonl").read_text().replace("s2", "s3"))
    vault.note("/a/file", "it broke")
    vault.ingest(str(logs))
    assert vault.table("sessions").count() == 3 and vault.table("errata").count() == 1
    assert vault.vacuum() and len(vault.store.names("messages")) == 4  # what died may still be at work
    assert vault.vacuum(abandoned=0) and len(vault.store.names("messages")) == len(vault.manifest()["segments"]) == 3
    assert vault.table("messages").count() == 7


def test_manifests_are_published_by_one_writer_each(vault):
    from concurrent.futures import ThreadPoolExecutor

    number = vault.manifest()["version"] + 1
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: vault.store.publish({"version": number, "segments": [], "config": {"by": k}}), range(8)))
    assert sum(won) == 1 and vault.manifest()["config"]["by"] == won.index(True)

    def add(k):
        return vault.store.change(lambda m: m | {"config": m["config"] | {str(k): k}})["version"]

    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(add, range(16)))
    assert len(set(versions)) == 16 and set(map(str, range(16))) <= set(vault.manifest()["config"])
    assert not [n for n in vault.store.names("manifests") if n.startswith(".")]


def test_two_writers_both_count(spark, vault, logs):
    from concurrent.futures import ThreadPoolExecutor

    other = Vault(spark, vault.path)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda job: job[0].ingest(str(job[1])), [(vault, logs / "a"), (other, logs / "b")]))
    assert {r.native_id for r in vault.table("sessions").collect()} == {"s1", "s2"} and vault.table("messages").count() == 5
    assert len(other.grep("kafka")) == 1 and len(vault.grep("words")) == 1


def test_embedding_gives_way_to_sessions_that_change_meanwhile(spark, vault, logs, embedder, monkeypatch):
    from colloquy import vault as module

    vault.ingest(str(logs))
    real, late = module.embedding.embed, []

    def embed(*args):
        if not late:  # while the program runs, another writer takes in a session anew
            late.append(1)
            claude_file(logs / "a" / "one.jsonl", "s1", 10, ["written later"])
            Vault(spark, vault.path).ingest(str(logs / "a" / "one.jsonl"))
        return real(*args)

    monkeypatch.setattr(module.embedding, "embed", embed)
    assert vault.embed(embedder) == 3
    rows = vault.table("messages").collect()
    assert sorted(r.content for r in rows) == ["nothing here", "other words", "written later"] and all(r.embedding for r in rows)


def test_projects_and_remotes(spark, vault, logs, tmp_path):
    from colloquy.operators import projects

    vault.ingest(str(logs))
    assert {(r.root_path, r.slug, r.session_count) for r in vault.projects().collect()} == {("/w/app", "app", 1), ("/w/lib", "lib", 1)}
    urls = {
        "https://host.example/team/tool.git": ("team", "tool"), "https://user@host.example:8443/team/tool/": ("team", "tool"), "ssh://git@host.example/team/tool.git": ("team", "tool"),
        "git@host.example:team/tool.git": ("team", "tool"), "https://host.example/group/sub/tool.git": ("group", "sub"), "git@host.example:a/b/c": (None, None), "/a/path": (None, None), "https://host.example/one": (None, None), "": (None, None),
    }
    sessions = spark.createDataFrame([(str(k), f"/w/{k}", f"p{k}") for k in range(len(urls))], "session_id string, project_root string, project_slug string")
    remotes = spark.createDataFrame([(f"/w/{k}", u) for k, u in enumerate(urls)], projects.REMOTES)
    found = {r.git_remote: (r.git_owner, r.git_repo) for r in projects.projects(sessions, remotes).collect()}
    assert found == urls
    assert projects.read_remotes([str(tmp_path)]) == []


def test_grep_and_export(vault, logs):
    vault.ingest(str(logs))
    assert [r["snippet"] for r in vault.grep("migrations")] and {r["session_id"] for r in vault.grep("migrations")} == {sid("s1")}
    assert vault.grep("words", project="app") == [] and len(vault.grep("words", project="lib")) == 1
    text = vault.export(sid("s1"))
    assert text.startswith("# Untitled session\n\n- **Session ID:** ") and "## [1] user\nkafka migration plan\n" in text and "- **Project:** app\n" in text
    with pytest.raises(NotFound):
        vault.export("nobody")


def test_increments_add_to_the_sums_that_sessions_keep(vault, logs, embedder, monkeypatch):
    from colloquy.operators import vectors

    whole, summed = vectors.vector_sums, []

    def counted(rows, key, column="embedding"):
        summed.append(rows.where(f"{column} is not null").count())
        return whole(rows, key, column)

    monkeypatch.setattr(vectors, "vector_sums", counted)
    vault.ingest(str(logs))
    assert vault.embed(embedder, limit=4) == 4 and vault.embed(embedder) == 1
    assert summed == [4, 0, 1, 0]  # the second run reads its own vector only
    vector = lambda text: [x / 0xFFFFFFFF for x in struct.unpack("<4I", hashlib.sha256(text.encode()).digest()[:16])]
    for native, texts in {
        "s1": ["user\nkafka migration plan", "assistant\nmigrating now", "user\nthanks"], "s2": ["user\nother words", "assistant\nnothing here"]
    }.items():
        row = vault.table("sessions").where(f"session_id = '{sid(native)}'").first()
        assert row.summary_embedding == pytest.approx([sum(x) / len(texts) for x in zip(*map(vector, texts))], rel=1e-5)
        assert [p.n for p in row.embedding_sums] == [len(texts)] * 4
    before = {r.session_id: r.summary_embedding for r in vault.table("sessions").collect()}
    assert vault.embed(embedder, force=True, limit=2) == 2  # replaced vectors don't count twice
    assert {r.session_id: r.summary_embedding for r in vault.table("sessions").collect()} == {k: pytest.approx(v, rel=1e-6) for k, v in before.items()}


def test_embedding_search_and_similar(vault, logs, embedder):
    vault.ingest(str(logs))
    assert vault.search("anything") == [] and vault.similar(sid("s1")) == []
    assert vault.embed(embedder) == 5 and vault.embed(embedder) == 0 and vault.embed(embedder, force=True, limit=2) == 2
    found = vault.search("user\nkafka migration plan", 3)
    assert len(found) == 3 and [r["distance"] for r in found] == sorted(r["distance"] for r in found)
    vector = lambda text: struct.unpack("<4I", hashlib.sha256(text.encode()).digest()[:16])
    rows = vault.table("sessions").where(f"session_id = '{sid('s2')}'").first()
    mean = [sum(x) / 2 / 0xFFFFFFFF for x in zip(vector("user\nother words"), vector("assistant\nnothing here"))]
    assert rows.summary_embedding == pytest.approx(mean, rel=1e-5)
    assert [r["session_id"] for r in vault.similar(sid("s1"))] == [sid("s2")]
    vault.ingest(str(logs / "a" / "one.jsonl"))
    assert vault.table("messages").where("embedding is null").count() == 3


def test_programs_may_answer_late_or_wrongly(tmp_path):
    from colloquy.operators.embedding import Embedder

    def program(body):
        path = tmp_path / "program.py"
        path.write_text(f"#!{sys.executable}\nimport json, sys\n{body}")
        path.chmod(0o755)
        return str(path)

    late = program(
        "rows = [json.loads(x) for x in sys.stdin]\nprint(json.dumps({'type': 'model', 'model': 'm', 'dimensions': 1}))\nfor r in rows[::-1]: print(json.dumps({'id': r['id'], 'embedding': [len(r['text'])]}))"
    )
    with Embedder(late) as running:
        for k in range(50):
            running.give([(f"{k}-{j}", "x" * 2000, "s") for j in range(20)])
        found = running.taken() + running.finish()
    assert len(found) == 1000 and all(v == [2000.0] and s == "s" for _, s, v in found)
    head = "print(json.dumps({'type': 'model', 'model': 'm', 'dimensions': 2}))\n"
    for body in (
        "sys.exit(3)", "", head, head + "print('{}')", head + "[print(json.dumps({'id': json.loads(x)['id'], 'embedding': [1]})) for x in sys.stdin]",
        head + "[print(json.dumps({'id': 'other', 'embedding': [1, 2]})) for x in sys.stdin]",
        head + "[print(json.dumps({'id': json.loads(x)['id'], 'embedding': [1, 2]})) for x in sys.stdin for _ in 'ab']"
    ):
        with pytest.raises(EmbedderError), Embedder(program(body)) as running:
            running.give([("a", "b", None)])
            running.finish()


def test_a_failing_embedder_changes_nothing(vault, logs, tmp_path):
    vault.ingest(str(logs))
    bad = tmp_path / "bad.sh"
    bad.write_text("#!/bin/sh\nexit 3\n")
    bad.chmod(0o755)
    version = vault.manifest()["version"]
    with pytest.raises(Exception, match="status 3|EmbedderError"):
        vault.embed(str(bad))
    assert vault.manifest()["version"] == version
    from colloquy.operators.embedding import parse_header

    with pytest.raises(EmbedderError):
        parse_header('{"id": "x"}')


def test_reports(vault, logs):
    vault.ingest(str(logs))
    doc = vault.report("monthly", now=NOW)
    m = doc["metrics"]
    assert (m["total_sessions"], m["message_count"], m["unique_models"], m["total_tokens"], m["estimated_cost_usd"]) == (2, 5, 2, 55, None)
    assert m["messages_by_role"] == [{"role": "user", "count": 3}, {"role": "assistant", "count": 2}] and m["avg_session_duration_seconds"] == 1.5
    assert [d["date"] for d in m["daily_breakdown"]] == ["2026-06-10", "2026-06-29"]
    assert vault.report("weekly", now=NOW)["metrics"]["total_sessions"] == 1 and vault.report("weekly", project="app", now=NOW)["metrics"] == report.EMPTY
    assert vault.rollup().count() == 2
    vault.report("custom", "2026-06-10", "2026-06-10", now=NOW)
    days = lambda: dict(vault.store.listing("usage_days"))
    before = days()
    assert vault.rollup().count() == 2 and set(before) >= {"date=2026-06-10", "date=2026-06-29"}
    vault.report("custom", "2026-06-29", "2026-06-29", now=NOW)
    assert days()["date=2026-06-10"] == before["date=2026-06-10"] and vault.rollup().count() == 2
    text = report.render_markdown(doc)
    assert "- Tokens: in=50 out=5 cache_r=0 cache_w=0 total=55\n" in text and "1. app — 1 sessions, 33 tokens\n" in text and "- Avg session duration: 2s\n" in text
    assert json.loads(report.render_json(doc)) == doc


def test_saved_reports_are_served_for_closed_periods(vault, logs):
    vault.ingest(str(logs))
    ask = lambda **more: vault.report("custom", "2026-06-01", "2026-06-15", save=True, now=NOW, **more)
    assert not ask()["from_cache"] and ask()["from_cache"] and not ask(source="claude")["from_cache"]
    open_ = lambda: vault.report("monthly", save=True, now=NOW)
    assert not open_()["from_cache"] and not open_()["from_cache"]


def test_watching_once_takes_in_what_changed(vault, logs, tmp_path, spark):
    (logs / "broken.jsonl").write_text("no session\n")
    told = []
    watch.watch(vault, [str(logs)], f"file://{tmp_path}/check", once=True, report=told.append)
    assert vault.table("sessions").count() == 2
    claude_file(logs / "c.jsonl", "s3", 12, ["new"])
    watch.watch(vault, [str(logs)], f"file://{tmp_path}/check", once=True, report=told.append)
    assert vault.table("sessions").count() == 3
    (logs / "store.db").write_text("no database")
    watch.watch(vault, [str(logs)], f"file://{tmp_path}/check", once=True, report=told.append)
    assert vault.table("sessions").count() == 3


def test_files_come_when_they_are_quiet_and_stores_once_an_interval(tmp_path):
    import os
    import time

    file, store = tmp_path / "a.jsonl", tmp_path / "b.db"
    file.write_text("x")
    store.write_text("x")
    reader = watch._Changes({"paths": json.dumps([str(tmp_path)]), "log": str(tmp_path / "log"), "debounce": "60", "interval": "1000"})
    names = lambda rows: [os.path.basename(p) for p, _ in rows]
    rows, offset = reader.read(reader.initialOffset())
    assert names(rows) == ["b.db"]  # the file was written just now
    os.utime(file, (1, time.time() - 100))
    os.utime(store, (1, time.time() - 50))
    rows, after = reader.read(offset)
    assert names(rows) == ["a.jsonl"] and names(reader.readBetweenOffsets(offset, after)) == ["a.jsonl"]
    reader.polled -= 2000
    rows, last = reader.read(after)
    assert names(rows) == ["b.db"] and names(reader.read(last)[0]) == []


def test_offsets_stay_small_and_the_log_is_compacted(tmp_path, monkeypatch):
    import os

    files = {f"/logs/project-{k % 100}/session-{k}.jsonl": 1.0 for k in range(100_000)}
    monkeypatch.setattr(watch._Changes, "_list", lambda self: dict(files))
    monkeypatch.setattr(watch, "COMPACTED", 3)
    options = {"paths": "[]", "log": str(tmp_path / "log")}
    reader = watch._Changes(options)
    rows, offset = reader.read(reader.initialOffset())
    assert len(list(rows)) == 100_000 and len(json.dumps(offset)) < 20
    assert reader.read(offset)[1] == offset  # nothing new, no batch
    gone = files.popitem()[0]
    files["/logs/new.jsonl"] = 2.0
    first = offset
    for k in range(5):
        files["/logs/project-0/session-0.jsonl"] = 3.0 + k
        rows, offset = reader.read(offset)
        rows = list(rows)
        assert rows == ([("/logs/new.jsonl", 2.0)] if not k else []) + [("/logs/project-0/session-0.jsonl", 3.0 + k)]
        reader.commit(offset)
        if not k:
            assert list(reader.readBetweenOffsets(first, offset)) == rows
    names = os.listdir(tmp_path / "log")
    assert sorted(names) == ["000000000006.all"] and offset == {"n": 6}
    again = watch._Changes(options)  # a new process
    assert again.read(offset)[1] == offset and again.known == files and gone not in again.known
    files[gone] = 1.0
    rows, last = again.read(offset)
    assert list(rows) == [(gone, 1.0)] and last == {"n": 7}
    # what was read but never came to be an offset is read again
    files["/logs/late.jsonl"] = 9.0
    assert [n for n, _ in watch._Changes(options).read(offset)[0]] == ["/logs/late.jsonl", gone]


def test_one_failing_file_of_a_batch_is_recorded(spark, logs):
    class Fails:
        noted, taken, dumb = [], [], False

        def ingest(self, path):
            if isinstance(path, list) or "one" in path:
                raise ValueError("broken")
            self.taken.append(path)

        def note(self, path, message):
            if self.dumb:
                raise OSError("no space")
            self.noted.append((path, message))

    fails, told = Fails(), []
    watch.take_in(fails, told.append)(spark.createDataFrame([("x/one.jsonl", 1.0), ("x/two.jsonl", 1.0)], "path string, mtime double"), 0)
    assert fails.noted == [("x/one.jsonl", "broken")] and fails.taken == ["x/two.jsonl"] and len(told) == 1
    Fails.dumb = True
    watch.take_in(fails, told.append)(spark.createDataFrame([("x/one.jsonl", 1.0)], "path string, mtime double"), 1)
    assert told[-1] == "x/one.jsonl can't be noted: no space"


def test_periods_and_windows():
    when = lambda *a: (str(periods.period(*a).start), str(periods.period(*a).end))
    assert when("daily", NOW) == ("2026-06-30",) * 2 and when("weekly", NOW)[0] == "2026-06-24" and when("monthly", NOW)[0] == "2026-06-01" and when("last-30-days", NOW)[0] == "2026-06-01"
    assert when(None, NOW, "2026-01-01", "2026-01-02") == ("2026-01-01", "2026-01-02")
    for bad in (
        (None,), (None, "2026-01-01"), (None, "2026-02-02", "2026-01-01"), (None, "2026-02-30", "2026-03-01"), ("yearly",),
        ("daily", "2026-01-01", "2026-01-02")
    ):
        with pytest.raises(UsageError):
            periods.period(bad[0], NOW, *bad[1:])
    assert periods.recency(2, None, NOW).cutoff == datetime(2026, 6, 28, tzinfo=timezone.utc)
    assert periods.recency(None, "2026-06-01", NOW).cutoff == datetime(2026, 6, 1, tzinfo=timezone.utc)
    for bad in ((0, None), (1, "2026-01-01"), (None, "1/2/2026")):
        with pytest.raises(UsageError):
            periods.recency(*bad, NOW)


def test_recency_leaves_old_files_out(vault, logs):
    import os

    os.utime(logs / "a" / "one.jsonl", (1, 1))
    assert vault.ingest(str(logs), periods.recency(None, "2020-01-01", NOW)).count() == 1


def test_commands(spark, tmp_path, logs, capsys, monkeypatch):
    place, said = f"file://{tmp_path}/cli", []
    run = lambda *a: cli.main(["--vault", place, *a], said.append)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert run("grep", "x") == 1 and run("init") == 0 and run("ingest", str(logs)) == 0 and said[-1] == "2 sessions"
    assert run("report", "--from", "2026-06-01", "--to", "2026-06-30") == 0 and said[-1].startswith("# Usage Report — global")
    assert run("report", "--from", "2020-06-01", "--to", "2020-06-30", "--format", "json") == 0 and said[-1] == "no sessions found"
    assert run("ingest", str(logs), "--recency", "1", "--since", "2026-01-01") == 1 and run("report") == 1
    assert run("init") == 1 and run("init", "--force") == 0 and run("projects", "--remotes") == 0 and "/w/lib lib" in said[-1] and run("vacuum") == 0
    home = tmp_path / "home"
    claude_file(home / ".claude/projects/a/one.jsonl", "s1", 10, ["hello there"])
    (home / ".claude/projects/a/other.jsonl").write_text("nothing\n")
    (home / ".hermes").mkdir()
    (home / ".hermes/state.db").write_text("no database")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.setattr("builtins.input", lambda question: "n")
    assert run("setup") == 0 and said[-1] == "nothing done" and run("setup", "--yes") == 0 and "1 sessions found" in said and "1 sessions taken in" in said
    assert any("file is not a database" in x for x in said)
    assert run("export", sid("s1")) == 0 and run("similar", sid("s1")) == 0 and run("watch", "--once", str(logs)) == 0
    assert run("autostart", "/x") == 0 and "watch /x" in said[-1]
    with pytest.raises(SystemExit) as e:
        run("nonsense")
    assert e.value.code == 2


def test_default_roots(tmp_path):
    from colloquy.sources.roots import default_roots, resolve_store

    for name in (".claude/projects", ".config/codex/sessions", ".local/share/hermes"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / ".local/share/hermes/state.db").write_text("")
    found = default_roots(str(tmp_path), {})
    assert set(found) == {"claude", "codex", "hermes"} and resolve_store(str(tmp_path / ".local/share/hermes")) == found["hermes"][0]
