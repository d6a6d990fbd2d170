"""Operators at their borders, with answers worked out by hand or by plain loops."""

import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import pricing as P
from ledgerspark.functions import text as T
from ledgerspark.operators import activity as A
from ledgerspark.operators import dedup as D
from ledgerspark.operators import joins as J
from ledgerspark.operators import ordered as O
from ledgerspark.operators import views as V
from ledgerspark.sources import sinks

MIN, DAY = 60_000, 86_400_000
COUNTS = P.COUNTS


def times(spark, *ts, prompts=()):
    return spark.createDataFrame([("s", t, t in prompts) for t in ts], "session string, ts long, is_prompt boolean")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    ("ts", "active", "idle"),
    [((0,), 30_000, 0), ((0, 5 * MIN), 5 * MIN + 30_000, 0), ((0, 500), 31_000, 0), ((0, 0, 0), 32_000, 0), ((0, 20 * MIN), 5 * MIN + 30_000, 15 * MIN)],
)
def test_activity(spark, ts, active, idle):
    r = only(A.activity(times(spark, *ts)))
    assert (r["active_ms"], r["idle_ms"], r["wall_ms"]) == (active, idle, active + idle)


def test_slices_add_up_over_midnights_and_buckets(spark):
    rnd = random.Random(2)
    rows = [(f"s{rnd.randint(0, 5)}", rnd.choice([rnd.randint(0, 5 * DAY), DAY - rnd.randint(0, 9 * MIN)])) for _ in range(400)]
    events = spark.createDataFrame(rows, "session string, ts long").withColumn("is_prompt", F.lit(False))
    whole = {r["session"]: (r["active_ms"], r["idle_ms"]) for r in A.activity(events).collect()}
    parts = {r["session"]: (r["a"], r["i"]) for r in A.day_slices(events).groupBy("session").agg(F.sum("active_ms").alias("a"), F.sum("idle_ms").alias("i")).collect()}
    assert whole == parts
    for s in whole:
        t = sorted(x for n, x in rows if n == s)
        gaps = [b - a for a, b in zip(t, t[1:])]
        assert whole[s] == (sum(min(max(g, 1000), 300_000) for g in gaps) + 30_000, sum(max(g - 300_000, 0) for g in gaps))


def test_loops(spark):
    r = only(A.loops(times(spark, 0, MIN, 2 * MIN, 2 * MIN, 3 * MIN, 60 * MIN, prompts=(MIN, 60 * MIN))))
    assert (r["turns"], r["longest_loop_ms"]) == (2, 2 * MIN)  # the idle way to the next prompt does not count
    r = only(A.loops(times(spark, 0, MIN, 2 * MIN)))
    assert (r["turns"], r["longest_loop_ms"]) == (0, 0)


@pytest.mark.parametrize(("totals", "want"), [([100, 500, 495, 600, 10, 50], [100, 400, 100, 0, 40]), ([1000, 980], [1000]), ([1000, 979, 979], [1000, 0, 0]), ([5, 5], [5, 0])])
def test_watermark_guard(spark, totals, want):
    df = spark.createDataFrame([("f", k, t, t) for k, t in enumerate(totals)], "key string, ord long, total long, n long")
    assert [r["n"] for r in O.cumulative_deltas(df, "key", ["ord"], "total", ["n"]).orderBy("ord").collect()] == want


@pytest.mark.parametrize(("hours", "start"), [([0, 2, 6, 11], 11), ([0, 5], 5), ([0, 4.9], 0), ([x / 2 for x in range(17)], 5)])
def test_block_is_anchored(spark, hours, start):
    df = spark.createDataFrame([("k", int(h * 3_600_000), 1) for h in hours], "k string, ts long, v long")
    r = only(O.anchored_block(df, "k", "ts", "v", 5 * 3_600_000))
    assert (r["block_start"], r["used"]) == (start * 3_600_000, sum(h >= start for h in hours))


def test_blocks_of_long_activity_equal_a_plain_walk(spark):
    """Keys without a pause over hundreds of windows, with pauses of every length, with one event, and without a name."""
    rnd, w = random.Random(21), 1000
    rows = []
    for k in range(12):
        t = rnd.randrange(10**6)
        for _ in range(rnd.choice((1, 3, 400, 900))):
            t += rnd.choice((0, 1, rnd.randrange(300), rnd.randrange(1100), 999, 1000, 1001 if k % 3 else 5, 2500 if k % 4 == 0 else 700))
            rows.append((None if k == 5 else f"k{k}", t, rnd.randrange(9) or None))
    want = set()
    for key in {r[0] for r in rows}:
        start = used = end = None
        for _, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if start is None or t >= start + w:
                start, used = t, 0
            end, used = t, used + (v or 0)
        want.add((key, start, end, used, start + w))
    df = spark.createDataFrame(rows, "k string, ts long, v long").repartition(5)
    found = O.anchored_block(df, "k", "ts", "v", w)
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert O.anchored_block(df.where("false"), "k", "ts", "v", w).count() == 0


def test_deltas_equal_a_plain_walk(spark):
    """Rising totals with stale dips of one and of many rows, resets, dips at the border of the guard, and dips that end in a reset, over buckets of ten rows."""
    rnd = random.Random(22)
    rows = []
    for k in range(8):
        total = 0
        for at in range(400):
            kind = rnd.random()
            total = max(0, total + rnd.randrange(50)) if kind < 0.7 else int(total * rnd.choice((0.98, 0.99, 0.985, 0.97, 0.1, 0.5))) if kind < 0.95 else rnd.choice((0, total, 7))
            rows.append((f"k{k}" if k else None, at, total if rnd.random() < 0.98 else None, rnd.randrange(1000), rnd.choice((None, at * 3))))
    want = []
    for key in {r[0] for r in rows}:
        held, before = 0, (0, 0)
        for _, at, total, a, b in [r for r in rows if r[0] == key]:
            total, values = total or 0, (a or 0, b or 0)
            if held * 0.98 <= total < held:
                continue
            held = total
            want.append((key, at, max(0, values[0] - before[0]), max(0, values[1] - before[1]), total))
            before = values
    df = spark.createDataFrame(rows, "k string, ord long, total long, a long, b long").repartition(5)
    found = O.cumulative_deltas(df, "k", ["ord"], "total", ["a", "b"], width=10)
    assert found.columns == ["k", "ord", "a", "b", "accepted"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def usage(spark, rows):
    return spark.createDataFrame([("s", k, k, c, o, 0, 0, False, "m") for k, (c, o) in enumerate(rows)], "session string, ord long, ts long, input long, output long, cache_read long, cache_creation long, is_sidechain boolean, model string")


def test_efficiency_slopes(spark):
    assert abs(only(A.efficiency(usage(spark, [(30_000, 1000)] * 10)))["alpha"] - 1) < 1e-9
    r = only(A.efficiency(usage(spark, [((2 * t - 1) * 1000, 1000) for t in range(1, 11)])))
    assert abs(r["alpha"] - 2) < 1e-9 and r["points"] == 10 and r["c_ideal"] == 10_000
    assert A.efficiency(usage(spark, [(30_000, 1000)] * 5)).count() == 0
    assert only(A.efficiency(usage(spark, [(20_000, 1), (9_999, 1)] * 5)))["compactions"] == 5


def test_occupancy_takes_undated_rows_last(spark):
    df = spark.createDataFrame([("s", 1, 5, 10, "a", False), ("s", 2, None, 20, "b", False), ("s", 3, 9, 30, "c", True), ("s", 4, 7, 0, "d", False)], "session string, ord long, ts long, input long, model string, is_sidechain boolean")
    for c in ("output", "cache_read", "cache_creation"):
        df = df.withColumn(c, F.lit(0).cast("long"))
    r = only(A.occupancy(df))
    assert (r["occupancy"], r["model"]) == (20, "b")


def better(a, b):
    if a["is_sidechain"] != b["is_sidechain"]:
        return b["is_sidechain"]
    ka, kb = (sum(x[c] for c in COUNTS) for x in (a, b))
    if ka != kb:
        return ka > kb
    if a["cost"] != b["cost"]:
        return a["cost"] > b["cost"]
    return a["has_speed"] and not b["has_speed"]


@pytest.mark.parametrize(("side", "messages", "seed"), [(0.15, 120, 11), (0.8, 60, 12), (0.5, 400, 13), (1.0, 30, 14)])
def test_dedup_against_a_linear_scan(spark, side, messages, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(1500):
        rows.append({"ord": k, "thread": f"t{rnd.randint(0, 5)}", "message_id": rnd.choice([None, *(f"m{x}" for x in range(messages))]), "request_id": rnd.choice([None, "r1", "r2", "r3"]), "is_sidechain": rnd.random() < side, "cost": rnd.choice([0.0, 0.5]), "has_speed": rnd.random() < 0.5, "input": rnd.randint(0, 3), "output": rnd.randint(0, 2), "cache_read": 0, "cache_creation": 0})
    held = []
    for r in rows:
        at = None
        if r["message_id"] is not None:
            own = [h for h in held if h["message_id"] == r["message_id"]]
            at = next((h for h in own if h["request_id"] == r["request_id"]), None) or next((h for h in own if r["is_sidechain"] or h["is_sidechain"]), None)
        if at is None:
            held.append(r | {"owner": r["thread"]})
        elif better(r, at):
            at.update(r | {"owner": at["owner"]})
    schema = "ord long, thread string, message_id string, request_id string, is_sidechain boolean, cost double, has_speed boolean, input long, output long, cache_read long, cache_creation long"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(7)
    got = sorted((r["ord"], r["owner"]) for r in D.deduplicate(df).collect())
    assert got == sorted((h["ord"], h["owner"]) for h in held)
    assert not any(x in D.deduplicate(df)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_session_and_bucket_ties(spark):
    rows = [("a", 5, 1, 3), ("a", 5, 0, 3), ("a", 4, 2, 9)]
    df = spark.createDataFrame(rows, "session string, ended_at long, ord long, input long")
    for c in COUNTS[1:]:
        df = df.withColumn(c, F.lit(0).cast("long"))
    assert only(D.latest_sessions(df))["ord"] == 0
    counts = spark.createDataFrame([("t", f"i{k:02}", 20 - k) for k in range(18)], "thread string, id string, n long")
    got = {r["id"]: r["n"] for r in D.cap_buckets(counts, "thread").collect()}
    assert len(got) == 16 and got["other"] == 5 + 4 + 3
    assert D.cap_buckets(counts.limit(16), "thread").where("id = 'other'").count() == 0


def test_as_of_is_strict_at_the_skew(spark):
    events = spark.createDataFrame([("s", 4500), ("s", 3000), ("s", 9000), ("q", 1)], "session string, ts long")
    turns = spark.createDataFrame([("s", 5000, "m1"), ("s", 8000, None)], "session string, ts long, model string")
    got = {(r["session"], r["ts"]): r["model_in_force"] for r in J.model_in_force(events, turns).collect()}
    assert got == {("s", 4500): "m1", ("s", 3000): "unknown", ("s", 9000): "m1", ("q", 1): "unknown"}


def test_order_and_partitions_do_not_matter(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{k % 5}", rnd.randint(0, 40 * DAY), rnd.choice([None, k])) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, ord long, v long").dropDuplicates(["key", "ord"])
    want = {}
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted(df.where(F.col("key") == key).collect(), key=lambda r: r["ord"]):
            last = r["v"] if r["v"] is not None else last
            want[key, r["ord"]] = last
    for width in (DAY, 100 * DAY):
        got = {(r["key"], r["ord"]): r["x"] for r in O.carried(df.repartition(5), "key", "ord", F.col("v"), "x", width=width).collect()}
        assert got == want


@pytest.mark.parametrize(
    ("model", "key"),
    [("claude-opus-4-8", "claude-opus-4-8"), ("claude-opus-4-8[1m]", "claude-opus-4-8"), ("gpt-5.6-luna", "gpt-5.6-luna"), ("gpt-5.6-nova", "gpt-5"), ("kimi-k2-0905", "kimi-k2"), ("kimi-k2-thinking", None), ("gemini-3-pro-preview", None), ("openrouter/openrouter/x-ai/grok-code-fast-1", "grok-code-fast"), ("vendor/unknown", None), ("x/gpt-5", "gpt-5"), ("", None), ("GPT-5", None)],
)
def test_price_lookup(spark, model, key):
    df = spark.createDataFrame([(model,)], "model string")
    assert [r["model_key"] for r in P.with_rates(df, P.rates(spark)).collect()] == [key]
    if model == "gpt-5.6-nova":
        assert P.resolve(df, P.rates(spark), strict=True).count() == 0


def test_windows(spark):
    ids = ["claude-opus-4-8", "claude-opus-4-8[1m]", "gpt-5.4-mini", "gemini-3-pro-preview", "openrouter/anthropic/claude-haiku-4-5", "nope"]
    got = {r["model"]: r["window_tokens"] for r in P.with_window(spark.createDataFrame([(i,) for i in ids], "model string"), P.windows(spark), P.rates(spark)).collect()}
    assert [got[i] for i in ids] == [200_000, 1_000_000, 1_050_000, 1_048_576, 200_000, None]


def test_bands(spark):
    days = spark.createDataFrame([("2026-01-01",), ("2026-07-20",), ("2026-07-21",), (None,), ("junk",)], "day string")
    got = {r["day"]: r["premium_min"] for r in P.band_as_of(days, P.tier_bands(spark)).collect()}
    assert got == {"2026-01-01": 10.0, "2026-07-20": 10.0, "2026-07-21": 20.0, None: 20.0, "junk": 20.0}


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hmac_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert scalar(spark, T.repo_hash(key, F.lit("/home/me/ My Repo "))) == hmac.new(key, b"my repo", hashlib.sha256).hexdigest()[:32]


@pytest.mark.parametrize(
    ("url", "slug"),
    [("git@host:Owner/Name.git", "owner/name"), ("https://h/a/b/c.git/", "b/c"), ("ssh://git@h:22/o/n", "o/n"), ("name", None), ("", None), (None, None), ("https://h/o/na me", None)],
)
def test_repo_slug(spark, url, slug):
    assert scalar(spark, T.repo_slug(F.lit(url).cast("string"))) == slug


@pytest.mark.parametrize(("raw", "want"), [("/Plan:plan ", "plan"), ("a:b", "a:b"), ("/compact", None), ("bad id", None), ("x" * 65, None)])
def test_skill_ids(spark, raw, want):
    assert scalar(spark, T.skill_id(F.lit(raw))) == want


def test_small_functions(spark):
    assert [scalar(spark, T.compact(F.lit(x))) for x in (999.0, 1234.0, 1_250_000.0, 2e9)] == ["999", "1.2K", "1.3M", "2.0B"]
    assert scalar(spark, T.base_name(F.lit("C:\\"))) is None and scalar(spark, T.base_name(F.lit("/a/b\\c/"))) == "c"
    assert scalar(spark, T.semver(F.lit("1.10.2-rc"))) > scalar(spark, T.semver(F.lit("v1.9.9")))
    assert scalar(spark, T.clock(F.lit(3_900_000))) == "1:05"
    assert scalar(spark, T.command_tags(F.lit("<command-name>/a</command-name> x <command-name>b</command-name>"))) == ["/a", "b"]


def test_mix_bar_fills_its_width(spark):
    rows = spark.createDataFrame([(f"m{k}", 100 - 13 * k) for k in range(7)], "model string, total long")
    got = V.mix_bar(rows, 37).orderBy("part").collect()
    assert sum(r["cells"] for r in got) == 37 and got[-1]["model"] == "+3 more"


def test_health_limits_are_strict(spark):
    rows = spark.createDataFrame([(s, k < bad) for s, bad, n in (("a", 20, 21), ("b", 21, 30), ("c", 21, 420)) for k in range(n)], "src string, bad boolean")
    assert {r["src"]: r["drift"] for r in V.health(rows, "src", F.col("bad")).collect()} == {"a": False, "b": True, "c": False}


def test_wire_rows(spark):
    df = spark.createDataFrame([("s", "m", "/secret", None), ("t", None, "/secret", "h")], "session string, model string, cwd string, repo_hash string")
    got = {r["session"]: r["payload"] for r in sinks.with_digest(sinks.wire(df)).collect()}
    assert got == {"s": '{"session":"s","model":"m","repo_hash":null}', "t": '{"session":"t","repo_hash":"h"}'}


def test_views_write(spark, tmp_path):
    view = spark.createDataFrame([("m", 1, 2.0, False)], "model string, total long, cost_usd double, partial boolean")
    sinks.write_view(view, f"{tmp_path}/v")
    assert spark.read.json(f"{tmp_path}/v").columns == ["model", "total"]
    for day, rate in (("2026-01-01", 1.0), ("2026-01-02", 2.0), ("2026-01-02", 3.0)):
        sinks.write_rates(spark.createDataFrame([("m", rate, day)], "model string, rate double, day string"), f"{tmp_path}/r")
    assert sorted(r["rate"] for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [1.0, 3.0]


def test_group_cost_is_null_only_without_any_price(spark):
    rows = [("g", "a", 1_000_000, 2.0), ("g", "b", 5, None), ("h", "b", 5, None), ("i", "b", 0, None)]
    df = spark.createDataFrame([(g, m if r else None, n, r) for g, m, n, r in rows], "g string, model_key string, input long, input_rate double")
    for c in COUNTS[1:]:
        df = df.withColumn(c, F.lit(0).cast("long"))
    df = df.select("g", "model_key", *COUNTS, F.col("input_rate").cast("decimal(18,6)").alias("input_rate"), *(F.when(F.col("model_key").isNotNull(), F.lit(1)).cast("decimal(18,6)").alias(f"{c}_rate") for c in COUNTS[1:]))
    got = {r["g"]: (r["cost_usd"], r["partial"]) for r in df.groupBy("g").agg(*P.group_cost()).collect()}
    assert got == {"g": (2.0, True), "h": (None, True), "i": (None, False)}
    assert math.isclose(got["g"][0], 2.0)


def test_stored_state_is_read_defensively(spark):
    from ledgerspark.functions import state

    raw = '{"enrolled": true, "checkedAt": 5, "orgId": 7, "attribution": {"grants": [{"grantId": "g", "canonicalRepoId": "c", "slug": "s"}, {"grantId": "g"}, 3]}, "pendingRequests": "no"}'
    found = scalar(spark, state.org_context(F.lit(raw)))
    assert found["enrolled"] and found["org_id"] is None and [g["canonical_id"] for g in found["grants"]] == ["c"] and found["pending"] is None
    assert scalar(spark, state.org_context(F.lit('{"enrolled": "yes", "checkedAt": 5}'))) is None and scalar(spark, state.org_context(F.lit("{"))) is None
    rates = scalar(spark, state.user_rates(F.lit('{"a": {"input": 1, "output": 2.5, "cacheRead": 0}, "b": {"input": 0, "output": 1}, "c": {"input": "1", "output": 1}, "d": 4}')))
    assert list(rates) == ["a"] and rates["a"]["output"] == 2.5 and rates["a"]["cache_write"] is None


def test_numbers_for_reading(spark):
    from ledgerspark.functions import text as T

    values = [(1150, "1.1K"), (1450, "1.4K"), (1250, "1.3K"), (1350, "1.4K"), (999, "999"), (0, "0"), (-5, "-5"), (-1234567, "-1.2M"), (999_950, "1000.0K"), (1_050_000, "1.1M"), (15_700_000_000, "15.7B"), (1000, "1.0K")]
    df = spark.createDataFrame(values, "n long, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", T.compact(F.col("n")).alias("got")).collect())
    spans = spark.createDataFrame([(0, "0m"), (59, "59m"), (60, "1h"), (192, "3h 12m"), (2879, "47h 59m"), (8640, "6d"), (-4, "0m")], "n long, want string")
    assert all(r["got"] == r["want"] for r in spans.select("want", T.short_span(F.col("n")).alias("got")).collect())
    money = spark.createDataFrame([(600.4, "$600"), (1200.0, "$1.2k"), (2000.0, "$2k"), (999.5, "$1000")], "n double, want string")
    assert all(r["got"] == r["want"] for r in money.select("want", T.money_tick(F.col("n")).alias("got")).collect())
    assert spark.range(1).select(T.grouped(F.lit(10412388.5))).first()[0] == "10,412,389"
    pairs = spark.createDataFrame([("1.2.3", " v1.2.4 ", -1), ("2.0.0-rc1", "1.99.99", 1), ("1.2.3", "v1.2.3", 0), ("x", "1.0.0", 0), (None, "1.0.0", 0), ("1.10.0", "1.9.0", 1)], "a string, b string, want int")
    assert all(r["got"] == r["want"] for r in pairs.select("want", T.newer(F.col("a"), F.col("b")).alias("got")).collect())
    names = spark.createDataFrame([("Terminal", "cli"), (" telegram ", "telegram"), ("", "unknown"), (None, "unknown"), ("two words", "unknown"), ("vscode", "vscode")], "a string, want string")
    assert all(r["got"] == r["want"] for r in names.select("want", T.hermes_entry_point(F.col("a")).alias("got")).collect())


def test_commits_of_sessions_are_never_paired(spark):
    """Sessions of all lengths at the borders of blocks, against a plain loop; no join compares times (it would pair a folder's sessions with its commits)."""
    at = lambda k: (k * 7919) % 5000 - 1000
    commits = [("a" if k % 3 else "b", f"{(k * 31) % 700:x}", at(k)) for k in range(1500)] + [("a", None, 5), (None, "x", 5)]
    spans = [(s, s + n) for s in (-1000, -64, -1, 0, 1, 511, 512, 1000) for n in (0, 1, 2, 3, 63, 64, 127, 128, 1000, 4999)] + [(10, 9)]
    sessions = [(k, "ab"[k % 2], *x) for k, x in enumerate(spans)] + [(900, "none", 0, 10), (901, None, 0, 10)]
    found = J.commits_in_session(spark.createDataFrame(sessions, "session long, cwd string, started_at long, ended_at long"), spark.createDataFrame(commits, "cwd string, sha string, at long"), 7)
    wanted = {s: sorted({sha for c, sha, t in commits if c == cwd and c and sha and begin <= t <= end})[:7] for s, cwd, begin, end in sessions}
    assert {r["session"]: r["shas"] for r in found.collect()} == wanted
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert all(line.endswith(": None") for line in plan.splitlines() if line.startswith("Join condition"))


def test_commits_of_sessions_are_all_listed(spark):
    """A session has any number of commits, copies of a commit count once, and a block has more sessions than are answered beside one copy of its commits."""
    rows = [("a", f"{k % 900:x}", (k * 7919) % 4096) for k in range(2500)]
    spans = [(k, 100 + k % 50, 3000 + k % 7) for k in range(1200)] + [(5000, 0, 4096), (5001, 4000, 4096), (5002, 9000, 9001)]
    own = spark.createDataFrame([(k, "a", *x) for k, *x in spans] + [(None, "a", 0, 9), (7000, None, 0, 9), (7001, "a", None, 9)], "session long, cwd string, started_at long, ended_at long")
    commits = spark.createDataFrame(rows, "cwd string, sha string, at long")
    wanted = {s: sorted({sha for _, sha, t in rows if begin <= t <= end}) for s, begin, end in spans} | {None: [], 7000: [], 7001: []}
    assert max(map(len, wanted.values())) == 900
    found = J.commits_in_session(own, commits).collect()
    assert len(found) == len(wanted) and {r["session"]: r["shas"] for r in found} == wanted and all(r["n"] == len(r["shas"]) for r in found)
    texts = J.commits_in_session(own, commits, between=",").collect()
    assert {r["session"]: (r["n"], r["shas"]) for r in texts} == {s: (len(x), ",".join(x)) for s, x in wanted.items()}


def test_commits_query_has_no_cap(spark, tmp_path):
    import duckdb

    from ledgerspark.plans.join_plans import ORACLE, QUERIES

    con, name = duckdb.connect(), "j5_commits_in_session"
    con.execute("create table orders as select i AS o_orderkey, (i % 2) * 15 AS o_custkey from range(24000) t(i)")
    con.execute("create table events as select i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i * 17) AS ts, i % 20 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{\"k\": 1}' AS props from range(40) t(i)")
    for t in ("orders", "events"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    found = {r["session"]: (r["n"], r["shas"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert found == {s: (n, shas) for s, n, shas in con.sql(f"select session, n, shas from ({ORACLE[name]})").fetchall()}
    own = sorted(f"c{k}" for k in range(24000) if k % 2 and 0 <= k * 7919 % 2592000 - 5 * 17 * 3600 <= 86400)  # of session 5, in folder p5
    assert found[5] == (len(own), ",".join(own)) and len(own) > 200
