"""Each log format on small files with answers worked out by hand."""

import json
import os
import sqlite3

import pytest

from ledgerspark.operators.dedup import deduplicate, file_grain, thread_totals, valid
from ledgerspark.operators.sessions import fold
from ledgerspark.sources import corpus, logs, sqlite
from ledgerspark.sources.lines import files

COUNTS = ("input", "output", "cache_read", "cache_creation")


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(rows if isinstance(rows, str) else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def counts(row):
    return tuple(row[c] for c in COUNTS)


def claude_line(ts, mid, usage, **more):
    inner = {"id": mid, "model": "claude-opus-4-8", "usage": usage} | more.pop("message", {})
    return {"type": "assistant", "timestamp": ts, "sessionId": "s", "version": "1.2.3", "requestId": f"r-{mid}", "message": inner} | more


def test_claude_replays_subagents_and_gate(spark, tmp_path):
    use = {"input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 1}
    a = claude_line("2026-01-01T00:00:00Z", "m1", use)
    put(tmp_path / "p" / "t1.jsonl", [
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "uuid": "u1", "message": {"content": "<command-name>/plan</command-name>"}},
        a, a | {"message": a["message"] | {"usage": use | {"output_tokens": 30}}},
        claude_line("2026-01-01T00:01:00Z", "m2", use, version="nope"),
        claude_line("2026-01-01T00:01:00Z", "m3", {"input_tokens": "12", "output_tokens": 7}),
        "{broken",
    ])
    put(tmp_path / "p" / "t1" / "subagents" / "x.jsonl", [claude_line("2026-01-01T00:02:00Z", "m9", use, isSidechain=True)])
    put(tmp_path / "p" / "t2.jsonl", [a, {"type": "progress", "data": {"message": {"timestamp": "2026-01-01T00:03:00Z", "requestId": "q", "message": {"id": "m7", "model": "gpt-5", "usage": {"input_tokens": 3, "output_tokens": 4}}}}}])
    atoms = logs.claude(files(spark, str(tmp_path), "*.jsonl"))
    good = atoms.usage.where(valid())
    assert good.count() == 6  # m1 twice, m3, m9, m1 again, m7
    from pyspark.sql import functions as F

    ranked = good.withColumn("ord", F.struct("ts", "thread", "ord"))
    kept = {r["message_id"]: r for r in deduplicate(ranked).collect()}
    assert counts(kept["m1"]) == (10, 30, 5, 1) and kept["m1"]["owner"] == "t1"
    assert counts(kept["m3"]) == (0, 7, 0, 0)
    assert kept["m9"]["owner"] == "t1" and kept["m9"]["entry_point"] == "subagent"
    assert counts(kept["m7"]) == (3, 4, 0, 0) and kept["m7"]["owner"] == "t2"
    totals = {r["thread"]: r for r in thread_totals(ranked, deduplicate(ranked)).collect()}
    assert totals["t1"]["messages"] == 3 and totals["t2"]["messages"] == 1
    assert file_grain(ranked).count() == 5
    assert [(r["kind"], r["id"], r["key"]) for r in atoms.skills.collect()] == [("skill", "plan", "cmd:u1:plan")]
    assert atoms.health.where("bad").count() == 1
    assert atoms.events.where("is_prompt").count() == 1


def snap(ts, total, inp, cached, out):
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total, "input_tokens": inp, "cached_input_tokens": cached, "output_tokens": out, "reasoning_output_tokens": 0}}}}


def test_codex_cumulative_with_stale_dip(spark, tmp_path):
    put(tmp_path / "2026" / "01" / "rollout-a.jsonl", [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sid", "cwd": "/w"}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "turn_context", "payload": {"model": "gpt-5"}},
        snap("2026-01-01T00:00:02Z", 1000, 900, 500, 100), snap("2026-01-01T00:00:03Z", 990, 890, 495, 99), snap("2026-01-01T00:00:04Z", 1200, 1050, 600, 150),
        {"timestamp": "2026-01-01T00:00:05Z", "type": "turn_context", "payload": {"model": "gpt-5.4"}},
        snap("2026-01-01T00:00:06Z", 1300, 1100, 600, 200), {"timestamp": "2026-01-01T00:00:07Z", "type": "event_msg", "payload": {"type": "user_message"}},
    ])
    atoms = logs.codex(files(spark, str(tmp_path), "rollout-*.jsonl"))
    rows = [(r["model"], *counts(r)) for r in atoms.usage.orderBy("ts").collect()]
    assert rows == [("gpt-5", 400, 100, 500, 0), ("gpt-5", 50, 50, 100, 0), ("gpt-5.4", 50, 50, 0, 0)]
    assert atoms.meta.first()["tool_session_id"] == "sid"
    assert atoms.events.where("is_prompt").count() == 1


def test_codex_limits_last_snapshot(spark, tmp_path):
    line = lambda ts, p: {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "rate_limits": {"primary": {"used_percent": p, "window_minutes": 300, "resets_at": 1000}, "secondary": {"used_percent": 5.5, "window_minutes": 10080, "resets_in_seconds": 60}}}}
    put(tmp_path / "rollout-a.jsonl", [line("2026-01-01T00:00:00Z", 10), line("2026-01-01T01:00:00Z", 42)])
    rows = {r["slot"]: r for r in logs.codex_limits(files(spark, str(tmp_path))).collect()}
    assert (rows["primary"]["percent"], rows["primary"]["resets_at_ms"]) == (42.0, 1_000_000)
    assert rows["secondary"]["resets_at_ms"] == 1767229200000 + 60_000


def test_grok_as_of_skew(spark, tmp_path):
    inf = lambda ms, p, c: {"ts": f"1970-01-01T00:00:0{ms / 1000:.3f}Z", "sid": "s1", "msg": "shell.turn.inference_done", "ctx": {"prompt_tokens": p, "cached_prompt_tokens": c, "completion_tokens": 7}}
    put(tmp_path / "logs" / "unified.jsonl", [inf(4500, 100, 30), inf(3000, 50, 60), inf(1000, 5, 0), {"msg": "other"}, inf(2000, "x", 0)])
    put(tmp_path / "sessions" / "c" / "s1" / "summary.json", json.dumps({"info": {"id": "s1", "cwd": "/w"}, "current_model_id": "own"}))
    put(tmp_path / "sessions" / "c" / "s1" / "events.jsonl", [{"ts": "1970-01-01T00:00:05Z", "type": "turn_started", "model_id": "grok-4.5"}, {"ts": "1970-01-01T00:00:06Z", "type": "turn_ended"}])
    atoms = logs.find(spark, str(tmp_path), "grok")
    rows = {r["ts"]: (r["model"], *counts(r)) for r in atoms.usage.collect()}
    assert rows[4500] == ("grok-4.5", 70, 7, 30, 0)
    assert rows[3000] == ("own", 0, 7, 60, 0)  # a turn exactly 2 s later is not in force; cached is not cut
    assert rows[1000][0] == "own"
    assert atoms.health.where("bad").count() == 1
    assert atoms.events.where("is_prompt").count() == 1


def test_grok_credits(spark, tmp_path):
    line = lambda p: {"ts": "2026-01-01T00:00:00Z", "msg": "billing: fetched credits config", "ctx": {"subscriptionTier": "T", "config": {"creditUsagePercent": p, "currentPeriod": {"type": "WEEKLY", "end": "2026-01-08T00:00:00Z"}}}}
    put(tmp_path / "unified.jsonl", [line(3), line(9), {"msg": "billing: fetched credits config", "ctx": 1}])
    row = logs.grok_credits(files(spark, str(tmp_path))).first()
    assert (row["percent"], row["period"]) == (9.0, "WEEKLY")


def test_pi_models_and_drift(spark, tmp_path):
    msg = lambda ts, model, **u: {"type": "message", "timestamp": ts, "message": {"role": "assistant", "model": model, "usage": u}}
    put(tmp_path / "--w--" / "f.jsonl", [
        {"type": "session", "id": "pid", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z"}, msg("2026-01-01T00:00:01Z", "early", input=1, output=2, cacheRead=3, cacheWrite=4),
        {"type": "model_change", "timestamp": "2026-01-01T00:01:00Z", "modelId": "m2"}, msg("2026-01-01T00:02:00Z", "own", input=5, output=6),
        msg("2026-01-01T00:02:00Z", "own", input="5", output=6), {"type": "mystery"}, {"type": "message", "timestamp": "2026-01-01T00:03:00Z", "message": {"role": "user"}},
    ])
    atoms = logs.pi(files(spark, str(tmp_path)))
    assert [(r["session"], r["model"], *counts(r)) for r in atoms.usage.orderBy("ts").collect()] == [("pid", "early", 1, 2, 3, 4), ("pid", "m2", 5, 6, 0, 0)]
    assert atoms.health.where("bad").count() == 2
    assert atoms.events.where("is_prompt").count() == 1


def test_openclaw_aliases(spark, tmp_path):
    msg = lambda provider, model, usage: {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "provider": provider, "model": model, "usage": usage}}
    put(tmp_path / "agents" / "a" / "sessions" / "x.jsonl", [
        {"type": "session", "id": "oc"}, msg("p", "m1", {"prompt_tokens": 100.9, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 40}}),
        msg("p", "", {"input": 7, "output": 8, "cacheRead": 9, "cacheWrite": 1}), msg("openclaw", "delivery-mirror", {"input": 1, "output": 1}), msg("p", "m", {"total": 5}),
    ])
    put(tmp_path / "agents" / "a" / "sessions" / "x.trajectory.jsonl", [msg("p", "never", {"input": 1, "output": 1})])
    atoms = logs.openclaw(files(spark, str(tmp_path)))
    assert sorted((r["session"], r["model"], *counts(r)) for r in atoms.usage.collect()) == [("oc", "m1", 60, 5, 40, 0), ("oc", "p", 7, 8, 9, 1)]
    assert atoms.health.where("bad").count() == 1


def test_gemini_prompt_includes_cache(spark, tmp_path):
    put(tmp_path / "chats" / "session-1.json", json.dumps({"sessionId": "g", "messages": [
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "gemini", "timestamp": "2026-01-01T00:00:05Z", "model": "gemini-3-pro", "tokens": {"input": 10, "output": 3, "cached": 15, "thoughts": 2}},
        {"type": "gemini", "timestamp": "2026-01-01T00:00:06Z", "tokens": {"input": "1"}}, {"type": "info"},
    ]}))
    put(tmp_path / "chats" / "broken.json", "{")
    atoms = logs.gemini(files(spark, str(tmp_path), "*.json"))
    row = atoms.usage.first()
    assert (row["session"], row["thinking"], *counts(row)) == ("g", 2, 0, 3, 10, 0)
    assert atoms.health.where("bad").count() == 2
    one = fold(atoms.usage, atoms.events, "gemini").first()
    assert (one["turns"], one["active_ms"], one["wall_ms"]) == (1, 36_000, 36_000)


@pytest.fixture
def store(tmp_path):
    def make(name, script):
        path = tmp_path / name
        db = sqlite3.connect(path)
        db.executescript(script)
        db.commit()
        db.close()
        return str(path)

    return make


def test_hermes(spark, store):
    path = store("state.db", """
      CREATE TABLE sessions(id TEXT, source TEXT, model TEXT, started_at REAL, ended_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, parent_session_id TEXT, cwd TEXT);
      CREATE TABLE messages(session_id TEXT, role TEXT, timestamp REAL);
      INSERT INTO sessions VALUES ('a','cli','gpt-5',100,200,10,20,3,4,5,NULL,'/w'),('b','cli',NULL,100,NULL,1,2,NULL,NULL,NULL,NULL,NULL),('c','cli','m',100,NULL,'many',2,0,0,0,NULL,NULL);
      INSERT INTO messages VALUES ('a','user',101),('a','assistant',103.5);""")  # fmt: skip
    atoms = sqlite.hermes(spark, [path, path + ".missing"])
    assert sorted((r["session"], r["model"], *counts(r)) for r in atoms.usage.collect()) == [("a", "gpt-5", 10, 20, 3, 4), ("b", "unknown", 1, 2, 0, 0)]
    assert atoms.health.where("bad").count() == 1
    assert sorted((r["session"], r["ts"], r["is_prompt"]) for r in atoms.events.collect()) == [("a", 101_000, True), ("a", 103_500, False), ("b", 100_000, False)]


def broken(path):
    """Overwrite some pages in the middle of a store."""
    with open(path, "r+b") as out:
        out.seek(4096 * (os.path.getsize(path) // 8192))
        out.write(b"\xff" * 3 * 4096)


def test_a_store_that_breaks_off_counts_for_nothing_and_is_reported(spark, store, tmp_path):
    """20,000 sessions with three bad pages among them: none is counted, the other store's all are."""
    make = """
      CREATE TABLE sessions(id TEXT, source TEXT, model TEXT, started_at REAL, ended_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, cwd TEXT);
      CREATE TABLE messages(session_id TEXT, role TEXT, timestamp REAL);
      WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 20000) INSERT INTO sessions SELECT 's' || k, 'cli', 'm', k, k + 1, 1, 1, 0, 0, 0, '/w' FROM n;
      INSERT INTO messages VALUES ('s1', 'user', 1);"""
    roots = [tmp_path / "one", tmp_path / "two"]
    for r in roots:
        r.mkdir()
        os.rename(store("state.db", make), r / "state.db")
    both = lambda: corpus.read(spark, {"hermes": [str(r) for r in roots], "codex": str(tmp_path / "none")})
    found = both()
    assert found.usage.count() == 40_000 and sorted(map(tuple, found.state.collect())) == [("codex", "absent", 0), ("hermes", "read", 0)]
    broken(roots[0] / "state.db")
    found = both()
    assert found.usage.count() == 20_000 and sorted(map(tuple, found.state.collect())) == [("codex", "absent", 0), ("hermes", "partial", 1)]
    assert [(r["harness"], r["path"]) for r in found.lost.collect()] == [("hermes", str(roots[0] / "state.db"))] and found.lost.first()["reason"]
    assert [tuple(r)[:3] for r in found.health.select("harness", "unknown", "total").collect()] == [("hermes", 1, 20_001)]
    broken(roots[1] / "state.db")
    found = both()
    assert found.usage.count() == 0 == found.events.count() and ("hermes", "failed", 2) in set(map(tuple, found.state.collect()))


def test_stores_are_read_in_ranges_of_rows(spark, store):
    path = store("r.db", "CREATE TABLE t(v INT); WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 1000) INSERT INTO t SELECT k FROM n; DELETE FROM t WHERE v % 3 = 0; CREATE TABLE w(v INT PRIMARY KEY) WITHOUT ROWID; INSERT INTO w VALUES (1), (2); CREATE TABLE e(v INT);")
    spark.dataSource.register(sqlite.SqliteSource)
    read = lambda table: spark.read.format("sqlite_table").schema("db_path string, v struct<text:string,kind:string>").option("table", table).option("paths", path).option("range", "100").load()
    assert read("t").rdd.getNumPartitions() == 10 and sorted(int(r["v"]["text"]) for r in read("t").collect()) == [k for k in range(1, 1001) if k % 3]
    assert read("w").count() == 2 and read("e").count() == 0 == read("missing").count()


def test_opencode_homes_with_files_and_databases(spark, store, tmp_path):
    """Files alone are enough for the gate; beside a database a session kept as files counts once, as the files have it."""
    root = tmp_path / "oc"
    for s, tokens in (("a", 7), ("b", 9)):
        (root / "storage/session/info").mkdir(parents=True, exist_ok=True)
        (root / f"storage/session/message/{s}").mkdir(parents=True)
        (root / f"storage/session/info/{s}.json").write_text(json.dumps({"id": s, "directory": "/w/files", "time": {"created": 5}}))
        (root / f"storage/session/message/{s}/m.json").write_text(json.dumps({"role": "assistant", "providerID": "p", "modelID": "m", "time": {"created": 6}, "tokens": {"input": tokens, "output": 1, "cache": {"read": 0, "write": 0}, "reasoning": 0}}))
    rows = lambda: sorted((r["session"], r["model"], r["input"], r["project"]) for r in corpus.read(spark, {"opencode": str(root)}).usage.collect())
    files = [("a", "p/m", 7, "files"), ("b", "p/m", 9, "files")]
    assert rows() == files
    os.rename(store("x.db", """
      CREATE TABLE session(id TEXT, directory TEXT, model TEXT, tokens_input INT, tokens_output INT, tokens_reasoning INT, tokens_cache_read INT, tokens_cache_write INT, time_created INT, time_updated INT);
      CREATE TABLE message(session_id TEXT, time_created INT);
      INSERT INTO session VALUES ('a', '/w/db', '{"id":"m"}', 100, 1, 0, 0, 0, 1, 2), ('c', '/w/db', '{"id":"m"}', 50, 1, 0, 0, 0, 1, 2);"""), root / "opencode-dev.db")
    assert rows() == [*files, ("c", "m", 50, "db")]


def test_opencode_files_replace_database(spark, store, tmp_path):
    path = store("opencode.db", """
      CREATE TABLE session(id TEXT, directory TEXT, model TEXT, tokens_input INT, tokens_output INT, tokens_reasoning INT, tokens_cache_read INT, tokens_cache_write INT, time_created INT, time_updated INT);
      CREATE TABLE message(id TEXT, session_id TEXT, time_created INT);
      INSERT INTO session VALUES ('s1','/w','{"id":"m","providerID":"p"}',1,2,0,3,4,1000,2000),('s2','/w','{"id":"m"}',5,6,0,0,0,1000,2000),('z','/w',NULL,0,0,0,0,0,1,1);
      INSERT INTO message VALUES ('x','s2',1500);""")  # fmt: skip
    root = tmp_path / "storage"
    put(root / "session" / "info" / "s1.json", json.dumps({"id": "s1", "directory": "/f", "time": {"created": 900}}))
    put(root / "session" / "info" / "kid.json", json.dumps({"id": "kid", "parentID": "s1"}))
    put(root / "session" / "message" / "s1" / "m1.json", json.dumps({"role": "assistant", "modelID": "m", "providerID": "q", "tokens": {"input": 9, "output": 8, "cache": {"read": 7, "write": 6}}, "time": {"created": 1000}}))
    put(root / "session" / "message" / "s1" / "m0.json", json.dumps({"role": "user", "time": {"created": 950}}))
    put(root / "session" / "message" / "kid" / "m1.json", json.dumps({"role": "assistant", "tokens": {"input": 99}}))
    both = sqlite.opencode_overlaid(logs.find(spark, str(root), "opencode"), sqlite.opencode(spark, [path]))
    assert sorted((r["session"], r["model"], *counts(r)) for r in both.usage.collect()) == [("s1", "q/m", 9, 8, 7, 6), ("s2", "m", 5, 6, 0, 0)]
    assert sorted((r["session"], r["ts"]) for r in both.events.collect() if r["session"] != "z") == [("s1", 950), ("s1", 1000), ("s2", 1500)]


def test_copilot_prefers_traces(spark, store):
    events = store("session-store.db", """
      CREATE TABLE sessions(id TEXT, cwd TEXT); INSERT INTO sessions VALUES ('a','/w');
      CREATE TABLE assistant_usage_events(session_id TEXT, turn_index INT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, created_at TEXT);
      INSERT INTO assistant_usage_events VALUES ('a',0,'gpt-5',1,2,3,4,5,'2026-01-01T00:00:00Z'),('a',1,'gpt-5',1,2,3,4,5,'never');""")  # fmt: skip
    attrs = json.dumps({"copilot.session.id": "t", "gen_ai.request.model": "gpt-5.4", "gen_ai.usage.input_tokens": 11, "gen_ai.usage.output_tokens": 12})
    traces = store("agent-traces.db", f"""
      CREATE TABLE spans(session_id TEXT, start_time_unix_nano INT, attributes TEXT);
      INSERT INTO spans VALUES (NULL, 5000000, '{attrs}'), ('u', 5000000, 'not json');""")  # fmt: skip
    alone = sqlite.copilot(spark, [traces + ".none"], [events])
    assert [(r["session"], *counts(r)) for r in alone.usage.collect()] == [("a", 1, 2, 3, 4)] and alone.health.where("bad").count() == 1
    both = sqlite.copilot(spark, [traces], [events])
    assert [(r["session"], r["ts"], r["model"], *counts(r)) for r in both.usage.collect()] == [("t", 5, "gpt-5.4", 11, 12, 0, 0)]


def test_wrong_columns_give_no_rows(spark, store):
    path = store("state.db", "CREATE TABLE sessions(id TEXT); INSERT INTO sessions VALUES ('a');")
    assert sqlite.read_table(spark, [path], "sessions", ["id", "model"]).count() == 0


def test_vendor_limits(spark):
    lane = {"kind": "session", "group": "session", "percent": 12, "severity": "normal", "resets_at": "t", "scope": {"model": {"display_name": "Opus"}}}
    bodies = [(json.dumps({"limits": [lane, lane | {"percent": "12"}]}),), (json.dumps({"limits": [], "five_hour": {"utilization": 3, "resets_at": "t"}}),), ("junk",)]
    rows = sorted((r["kind"], r["percent"], r["scope"]) for r in logs.vendor_limits(spark.createDataFrame(bodies, "value string")).collect() if r["scope"]) + [r["percent"] for r in logs.vendor_limits(spark.createDataFrame(bodies, "value string")).collect() if not r["scope"]]
    assert rows == [("session", 12.0, "Opus"), 3.0]


def test_a_log_is_parsed_once(spark, tmp_path):
    """What follows the reading of a log reads a narrow table: no plan of usage, events, health or sessions parses JSON again, and numbers stay strict."""
    name = tmp_path / "rollout-a.jsonl"
    name.write_text('{"type":"session_meta","payload":{"id":"s","cwd":"/w"}}\n \t\n{"type":"turn_context","payload":{"model":"m"}}\n{"type":"event_msg","timestamp":"2024-01-01T00:00:00Z","payload":{"type":"token_count","info":{"total_token_usage":{"total_tokens":9,"input_tokens":7,"output_tokens":2,"cached_input_tokens":"3"}}}}\n')
    codex = logs.codex(files(spark, str(tmp_path), "rollout-*.jsonl"))
    (tmp_path / "p.jsonl").write_text('{"type":"session","id":"p","cwd":"/w"}\n{"type":"message","timestamp":"2024-01-01T00:00:00Z","message":{"role":"assistant","model":"m","usage":{"input":7,"output":2,"cacheRead":"3"}}}\n')
    found = files(spark, str(tmp_path), "p.jsonl")
    for atoms in (codex, logs.pi(found), logs.openclaw(found)):
        for frame in (atoms.usage, atoms.events, atoms.health, atoms.meta):
            plan = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "extended")
            assert "parseJson" not in plan and "parse_json" not in plan
        assert [(r["model"], r["input"], r["output"], r["cache_read"]) for r in atoms.usage.collect()] == [("m", 7, 2, 0)]


def test_a_home_is_listed_once_for_its_gate_and_its_readers(spark, tmp_path, monkeypatch):
    """A listing is a task a folder: those of grok and gemini have a folder or more a session."""
    from ledgerspark.sources import lines

    made, reader = [], lines._reader
    monkeypatch.setattr(lines, "_reader", lambda spark, glob, since: made.append(glob) or reader(spark, glob, since))
    texts = {
        "g/logs/unified.jsonl": '{"ts":"2024-01-01T00:00:00Z","sid":"s","msg":"shell.turn.inference_done","ctx":{"prompt_tokens":7,"completion_tokens":2}}\n',
        "g/sessions/c/s/events.jsonl": '{"ts":"1970-01-01T00:00:00Z","type":"turn_started","model_id":"grok-4.5"}\n',
        "g/sessions/c/s/summary.json": '{"info":{"id":"s",\n"cwd":"/w/p1"}}', "g/config.toml": 'source = "xai-org/plugin-marketplace"\n',
        "m/tmp/a/chats/c.json": '{"sessionId":"a","messages":[{"type":"gemini","timestamp":"2024-01-01T00:00:00Z","model":"m","tokens":{"input":3,"output":1,"cached":1}}]}',
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = corpus.read(spark, {"grok": str(tmp_path / "g"), "gemini": str(tmp_path / "m")})
    rows = {(r["harness"], r["session"], r["model"], r["input"], r["output"], r["cache_read"], r["project"]) for r in found.usage.collect()}
    assert rows == {("grok", "s", "grok-4.5", 7, 2, 0, "p1"), ("gemini", "a", "m", 2, 1, 1, "(unknown)")}
    assert len(made) == len(set(made)) == 3
