"""Incremental passes and keyed state."""

import json
import os
import random

from pyspark.sql import functions as F

from ledgerspark.operators.joins import changed
from ledgerspark.sources import discovery
from ledgerspark.streaming import incremental as I
from ledgerspark.streaming import stateful as S


def test_state_table_versions_and_epochs(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "d", "session string, digest string", buckets=1)
    assert t.read().count() == 0
    for k in range(3):
        t.upsert(spark.createDataFrame([("a", f"x{k}"), (f"b{k}", "y")], t.schema))
    assert sorted(map(tuple, t.read().collect())) == [("a", "x2"), ("b0", "y"), ("b1", "y"), ("b2", "y")]
    assert t.files() == 3
    assert I.StateTable(spark, str(tmp_path), "d", t.schema, epoch=2).read().count() == 0


def test_state_table_rewrites_only_what_it_touches(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "d", "session string, n long", buckets=8)
    t.upsert(spark.createDataFrame([(f"s{k}", k) for k in range(100)], t.schema))
    t.upsert(spark.createDataFrame([("s7", -7)], t.schema))
    assert sorted(len(parts) for parts in t.manifest()["parts"].values()) == [1] * 7 + [2]  # one bucket has got one part more
    assert {r["session"]: r["n"] for r in t.read().collect()} == {f"s{k}": k if k != 7 else -7 for k in range(100)}
    assert [tuple(r) for r in t.read(spark.createDataFrame([("s7",), ("none",)], "session string")).collect()] == [("s7", -7)]
    t.upsert(t.read().where("n > 10"))  # rows that come from the table itself
    assert t.read().count() == 100


def rows_read(df):
    """Rows that the scans of a frame gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, total = plan.collectLeaves(), 0
    todo = [leaves.apply(k) for k in range(leaves.size())]
    while todo:
        at = todo.pop()
        name = at.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            inner = (at.executedPlan() if name == "AdaptiveSparkPlanExec" else at.plan()).collectLeaves()
            todo += [inner.apply(k) for k in range(inner.size())]
        elif name == "FileSourceScanExec":
            total += at.metrics().apply("numOutputRows").value()
    return total


def test_few_keys_of_a_large_table_cost_a_hundredth(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "big", "session string, n long", bucket_rows=100_000)
    t.upsert(spark.range(1_000_000).select(F.concat(F.lit("s"), "id").alias("session"), F.col("id").alias("n")))
    assert t.manifest()["buckets"] == 10
    keys = spark.createDataFrame([(f"s{k * 19_997 % 1_000_000}",) for k in range(50)], "session string")
    found = t.read(keys)
    assert rows_read(found) < 10_000 and {r["session"]: r["n"] for r in found.collect()} == {f"s{k * 19_997 % 1_000_000}": k * 19_997 % 1_000_000 for k in range(50)}
    t.upsert(keys.withColumn("n", F.lit(-1).cast("long")))
    assert t.read(keys).where("n = -1").count() == 50 and t.read().count() == 1_000_000
    many = spark.range(0, 1_000_000, 1000).select(F.concat(F.lit("s"), "id").alias("session"))
    assert t.read(many).count() == 1000


def test_many_batches_keep_a_bounded_number_of_parts(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "many", "session string, n long", bucket_rows=200, deltas=3)
    want = {}
    for k in range(30):
        new = {f"s{(k * 37 + j * 11) % 500}": k * 1000 + j for j in range(40)}
        want |= new
        t.upsert(spark.createDataFrame(sorted(new.items()), t.schema))
        assert t.files() <= 4 * t.manifest()["buckets"]
    assert {r["session"]: r["n"] for r in t.read().collect()} == want
    left = [d for d in os.listdir(t.base) if d != "manifest"]
    assert len(left) <= t.files() + 8 and 2 <= t.manifest()["buckets"] <= 10 and len([f for f in os.listdir(f"{t.base}/manifest") if f.endswith(".json")]) <= 2


def test_a_version_written_again_takes_its_own_place(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "h", "session string, n long", history=True, bucket_rows=20, deltas=2)
    part = lambda v, more=0: [(f"s{k % 7}", 100 * v + k + more) for k in range(12)]
    for v in range(6):
        t.write(spark.createDataFrame(part(v, 5), t.schema), v)
        t.write(spark.createDataFrame(part(v), t.schema), v)  # done again, with other rows
    assert sorted(map(tuple, t.read().collect())) == sorted(x for v in range(6) for x in part(v))
    assert sorted(map(tuple, t.version(5).collect())) == sorted(part(5))


def test_an_attribution_flip_folds_every_file_again(spark, tmp_path):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    table = lambda name, schema: I.StateTable(spark, str(tmp_path), name, schema)
    cursors, digests, stamps = table("c", "path string, size long"), table("d", "session string, digest string"), table("s", "name string, stamp string")
    sent = []

    def run(attribution, whole=False, rows=files):
        fold = lambda g: g.select(F.col("path").alias("session"), F.concat("path", F.lit(attribution or "none"), F.col("size")).alias("digest"))
        sent.clear()
        return I.sync_once(rows, cursors, digests, fold, lambda df: sent.extend(sorted(r["session"] for r in df.collect())), stamps, attribution, whole)

    assert run("x") == 2 and run("x") == 0 and run(None) == 0 and sent == []
    assert run("y") == 2 and sent == ["a", "b"] and run("y") == 0
    grown = spark.createDataFrame([("a", 9), ("b", 2)], files.schema)
    assert run("y", rows=grown) == 1 and sent == ["a"]
    digests.upsert(spark.createDataFrame([("b", "stale")], digests.schema))
    assert run("y", True, spark.createDataFrame([("a", 10), ("b", 2)], files.schema)) == 2 and sent == ["a", "b"]


def test_sync_sends_only_changes_and_keeps_state_on_failure(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("1\n2\n")
    (logs / "b.jsonl").write_text("5\n")
    cursors = I.StateTable(spark, str(tmp_path / "s"), "cursors", "path string, size long")
    digests = I.StateTable(spark, str(tmp_path / "s"), "digests", "session string, digest string")

    def fold(grown):
        paths = [r["path"] for r in grown.select("path").collect()]
        if not paths:
            return spark.createDataFrame([], "session string, payload string, digest string")
        rows = spark.read.text(paths).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("session"), F.col("value").cast("long").alias("n"))
        return rows.groupBy("session").agg(F.sum("n").cast("string").alias("payload")).withColumn("digest", F.sha2("payload", 256))

    sent = []
    run = lambda: I.sync_once(I.listing(spark, str(logs)), cursors, digests, fold, lambda df: sent.append(sorted(map(tuple, df.select("session", "payload").collect()))))
    run()
    run()
    (logs / "a.jsonl").write_text("1\n2\n3\n")
    run()
    assert sent == [[("a.jsonl", "3"), ("b.jsonl", "5")], [], [("a.jsonl", "6")]]
    (logs / "b.jsonl").write_text("5\n1\n")

    def refuse(df):
        raise RuntimeError("offline")

    try:
        I.sync_once(I.listing(spark, str(logs)), cursors, digests, fold, refuse)
    except RuntimeError:
        pass
    run()
    assert sent[-1] == [("b.jsonl", "6")]


def test_watermark_never_goes_back(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "w", "store string, ts long")
    for ts in (5, 9, 3):
        I.advance_watermark(t, spark.createDataFrame([("x", ts)], t.schema))
    assert [tuple(r) for r in t.read().collect()] == [("x", 9)]


def test_fingerprint_follows_the_listing(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    first = I.fingerprint(I.listing(spark, str(tmp_path)))
    assert first == I.fingerprint(I.listing(spark, str(tmp_path)))
    (tmp_path / "a").write_text("12")
    assert first != I.fingerprint(I.listing(spark, str(tmp_path)))


def batches(spark, tmp_path, schema, parts):
    """A file stream that sees one part per batch."""
    src = tmp_path / "src"
    src.mkdir()
    for k, rows in enumerate(parts):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{k}.json", (1_700_000_000 + k * 60,) * 2)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def test_block_stream_matches_a_replay(spark, tmp_path):
    h = 3_600_000
    stream = batches(spark, tmp_path, "session string, ts long, total long", [[{"session": "a", "ts": 0, "total": 1}, {"session": "a", "ts": 2 * h, "total": 2}], [{"session": "a", "ts": 5 * h, "total": 4}], [{"session": "a", "ts": 6 * h, "total": 8}]])
    q = S.block_stream(stream).writeStream.outputMode("update").format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r["last_ts"]: (r["block_start"], r["used"]) for r in spark.table("blocks").collect()}
    assert rows[6 * h] == (5 * h, 12)  # the block opens anew exactly five hours after its start


def test_live_stream_starts_at_zero(spark, tmp_path):
    stream = batches(spark, tmp_path, "session string, tokens long, signature string", [[{"session": "a", "tokens": 100, "signature": "x"}], [{"session": "a", "tokens": 130, "signature": "y"}]])
    q = S.live_stream(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["delta"] for r in spark.table("live").collect()) == [0, 30]


def test_sync_stream_sends_totals_over_all_batches(spark, tmp_path):
    parts = [[("a", 10), ("b", 1), ("c", 4)], [("a", 5), ("b", 1)], [("a", 1), ("c", 0)], [("b", 2)]]  # b has equal sums twice
    stream = batches(spark, tmp_path, "session string, n long", [[{"session": s, "n": n} for s, n in p] for p in parts])
    digests = I.StateTable(spark, str(tmp_path / "s"), "digests", "session string, digest string")
    atoms = I.StateTable(spark, str(tmp_path / "s"), "atoms", "session string, n long", history=True)
    sent = []
    fold = lambda b: b.groupBy("session").agg(F.sum("n").cast("string").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    send = lambda df, k: sent.append(sorted((r["session"], r["payload"]) for r in df.collect()))
    I.sync_stream(stream, atoms, digests, fold, send, str(tmp_path / "c")).awaitTermination(120)
    assert [s for s in sent if s] == [[("a", "10"), ("b", "1"), ("c", "4")], [("a", "15"), ("b", "2")], [("a", "16")], [("b", "4")]]
    last = dict(x for part in sent for x in part)
    whole = spark.createDataFrame([x for p in parts for x in p], "session string, n long")
    assert last == {r["session"]: r["payload"] for r in fold(whole).collect()}


def owned(rows):
    """Each message's best record, for the session that has it first; a session that owns nothing has 0."""
    kept = rows.groupBy("message").agg(F.max("n").alias("n"), F.min_by("session", "ord").alias("session"))
    totals = rows.select("session").distinct().join(kept.groupBy("session").agg(F.sum("n").alias("n")), "session", "left")
    return totals.select("session", F.coalesce("n", F.lit(0)).cast("string").alias("payload")).withColumn("digest", F.sha2("payload", 256))


def replays(spark, tmp_path, parts):
    """What each batch sends, and what all that was sent amounts to."""
    schema = "session string, message string, n long, ord long"
    stream = batches(spark, tmp_path, schema, [[dict(zip(("session", "message", "n", "ord"), r)) for r in p] for p in parts])
    table = lambda name, schema, **more: I.StateTable(spark, str(tmp_path / "s"), name, schema, **more)
    digests, atoms = table("digests", "session string, digest string"), table("atoms", schema, history=True)
    copies = table("copies", "message string, session string, n long, ord long", history=True)
    sent = []
    I.sync_stream(stream, atoms, digests, owned, lambda df, k: sent.append(sorted((r["session"], r["payload"]) for r in df.collect())), str(tmp_path / "c"), copies).awaitTermination(300)
    want = {r["session"]: r["payload"] for r in owned(spark.createDataFrame([r for p in parts for r in p], schema)).collect()}
    return sent, dict(x for part in sent for x in part), want


def test_a_late_replay_changes_the_session_that_went_out(spark, tmp_path):
    """A message replayed in another session with more tokens: its first session goes out again with the better record."""
    sent, last, want = replays(spark, tmp_path, [[("a", "m1", 5, 1), ("a", "m2", 1, 2)], [("z", "m9", 3, 3)], [("b", "m1", 50, 4), ("b", "m3", 2, 5)]])
    assert sent == [[("a", "6")], [("z", "3")], [("a", "51"), ("b", "2")]] and last == want


def test_a_replay_leaves_older_messages_with_their_owner(spark, tmp_path):
    """C has m2, B has it too and m1; A replays m1. B's m2 still is C's."""
    sent, last, want = replays(spark, tmp_path, [[("C", "m2", 5, 1), ("B", "m2", 5, 2), ("B", "m1", 1, 3)], [("A", "m1", 1, 4)]])
    assert sent == [[("B", "1"), ("C", "5")], [("A", "0")]] and last == want == {"A": "0", "B": "1", "C": "5"}


def test_chains_of_replays_in_any_order_equal_one_fold(spark, tmp_path):
    draw = random.Random(8)
    rows = [(f"s{s}", f"m{m}", draw.randrange(9), 0) for s in range(10) for m in range(3 * s, 3 * s + 6)]  # each shares messages with the next
    rows = [(s, m, n, k) for k, (s, m, n, _) in enumerate(draw.sample(rows, len(rows)))]
    draw.shuffle(rows)
    _, last, want = replays(spark, tmp_path, [rows[k::5] for k in range(5)])
    assert last == want


def test_gates():
    assert I.scan_due(20_000, None, 1000) and I.scan_due(5000, 4000, 1000) and not I.scan_due(3500, 3000, 1000) and not I.scan_due(5000, 900, 1000)
    assert I.scan_due(7000, 6900, 1000)
    assert S.push_due(True, 50_000, 1000, "a", "b") and not S.push_due(True, 50_000, 1000, "a", "a") and not S.push_due(False, 50_000, None, "a", None)
    assert S.sync_due("Stop", 300_000, 0) and not S.sync_due("Stop", 299_999, 0) and S.sync_due("SessionEnd", 60_000, 0)


def test_discovery(spark):
    env = {"HOME": "/h", "CLAUDE_CONFIG_DIR": "/a, /b,/a"}
    there = lambda p: p != "/b/projects"
    assert discovery.roots(env | {"APPDATA": "/d"}, exists=there) == ["/a/projects", "/h/.config/claude/projects", "/d/claude/projects", "/h/.claude/projects"]
    assert discovery.roots({"LEDGER_CLAUDE_DIR": "/x,y"}, exists=there) == ["/x,y"] and discovery.roots({"LEDGER_CLAUDE_DIR": "/b/projects"}, exists=there) == []
    listing = spark.createDataFrame([("/h/opencode/session/a/b.json",), ("/h/opencode/project/p.json",), ("/h/opencode/session/a/b/c.json",), ("/h/.hermes/sessions/s.jsonl",), ("/h/.hermes/sessions/sessions.json",)], "path string")
    assert {r["harness"]: r["files"] for r in discovery.legacy_counts(listing).collect()} == {"opencode": 2, "hermes": 1}
    assert discovery.home("codex", env, "LEDGER_CODEX") == "/h/.codex/sessions"
    found = spark.createDataFrame([("/r1/a.jsonl", "a.jsonl", 5), ("/r2/a.jsonl", "a.jsonl", 9), ("/r1/a/subagents/a.jsonl", "a.jsonl", 1)], "path string, name string, size long")
    assert sorted(r["path"] for r in discovery.unique_transcripts(found).collect()) == ["/r1/a/subagents/a.jsonl", "/r2/a.jsonl"]
    assert discovery.preferred_store(["/no", "/yes"], lambda p: p == "/yes") == "/yes"


def test_changed(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "session string, digest string")
    old = spark.createDataFrame([("a", "1"), ("b", "x")], "session string, digest string")
    assert sorted(r["session"] for r in changed(rows, old).collect()) == ["b", "c"]


def test_chunks_cover_every_row(spark, tmp_path):
    rows = spark.range(250).selectExpr("cast(id as string) as payload").repartition(2)
    out = str(tmp_path)

    def post(chunk):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(chunk))

    I.send_in_chunks(rows, post, 100)
    sizes = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert max(map(len, sizes)) <= 100 and sorted(int(x) for c in sizes for x in c) == list(range(250))


def test_block_stream_follows_time_across_frames(spark, tmp_path):
    h = 3_600_000
    times = [k * h // 4 for k in range(120)]
    rows = [{"session": "a", "ts": t, "total": 1} for t in times[::-1]]
    anchor, used = None, 0
    for t in times:
        if anchor is None or t >= anchor + 5 * h:
            anchor, used = t, 0
        used += 1
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = batches(spark, tmp_path, "session string, ts long, total long", [rows])
        S.block_stream(stream).writeStream.outputMode("update").format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert [(r["block_start"], r["last_ts"], r["used"]) for r in spark.table("framed").collect()] == [(anchor, times[-1], used)]


def test_by_time_merges_runs_from_scratch_files():
    import numpy as np
    import pandas as pd

    ts = np.random.default_rng(2).permutation(20_000)
    frames = [pd.DataFrame({"ts": ts[k : k + 700], "total": ts[k : k + 700] * 2}) for k in range(0, len(ts), 700)]
    for at_once in (1 << 20, 5000, 1):
        assert list(S.by_time(iter(frames), at_once)) == [(t, 2 * t) for t in range(20_000)]


def test_rows_are_stored_once_where_they_stay(spark, tmp_path):
    """Buckets split before a batch comes in, for all its rows; what is there already moves only where its bucket splits."""
    t = I.StateTable(spark, str(tmp_path), "once", "session string, n long", bucket_rows=100)
    rows = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("session"), F.col("id").alias("n"))
    t.upsert(rows)
    assert t.manifest()["buckets"] == 10 == len(t.manifest()["parts"]) and {p[0].split("/")[0] for parts in t.manifest()["parts"].values() for p in parts} == {"v1"}
    t.upsert(rows.withColumn("n", -F.col("n")))
    parts = [p for parts in t.manifest()["parts"].values() for p in parts]
    assert t.manifest()["buckets"] == 20 and sum(p[2] for p in parts if p[0].startswith("v2/")) == 1000
    assert {r["session"]: r["n"] for r in t.read().collect()} == {f"s{k}": -k for k in range(1000)}


def test_a_version_written_again_may_split_buckets(spark, tmp_path):
    t = I.StateTable(spark, str(tmp_path), "again", "session string, n long", history=True, bucket_rows=20, deltas=1)
    part = lambda v, n: spark.createDataFrame([(f"s{k % 9}", 1000 * v + k) for k in range(n)], t.schema)
    for v in range(3):
        t.write(part(v, 10), v)
    for n in (300, 30):
        t.write(part(2, n), 2)
        assert sorted(r["n"] for r in t.read().collect()) == [1000 * v + k for v, m in enumerate((10, 10, n)) for k in range(m)]


def test_batches_of_replays_are_written_in_one_pass(spark, tmp_path):
    from ledgerspark.plans.fact_plans import fed

    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(look, "id long")
    fed(rows, F.pmod("id", F.lit(4)), f"{tmp_path}/fed")
    assert seen.value == 100 and sorted(r["id"] for r in spark.read.schema("id long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/fed/batch={{0,3}}").collect()) == [k for k in range(100) if k % 4 in (0, 3)]
