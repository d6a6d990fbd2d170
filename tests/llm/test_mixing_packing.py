import itertools
import random
from collections import defaultdict

import duckdb
import pytest

from ledgerspark.llm import mixing, packing
from tests.llm.helpers import DOCS, folder, prose, rows, table

words = lambda t: len((t or "").split())


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    d = folder(spark, tmp_path_factory.mktemp("mix"), table(spark))
    return d, mixing.query(spark, d).collect()


def test_mix_equals_its_sql(mixed):
    d, got = mixed
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    want = con.sql(mixing.ORACLE)
    names = want.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want.fetchall(), key=key)


def test_mix_sums(mixed):
    _, got = mixed
    assert len(got) == len(rows())
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in rows())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    total = sum(words(r[1]) for r in rows())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 50}
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    order = sorted(s for s in sizes if s) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
    want = fixed | share
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in order)
    assert [got[s]["rank"] for s in order] == [0, 1, 2, 3, 4]


def test_demand_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for schedule in (*mixing.SCHEDULES, ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.3, 1.0), (1.0, 0.0))):
        df = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn("t", mixing.demand_time(F.col("share"), schedule))

        def reached(t):
            total = done = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
                total += (t1 - t0) * (w0 + w1) / 2
                x = min(max(t - t0, 0), t1 - t0)
                done += x * (w0 + (w1 - w0) / (t1 - t0) * x / 2)
            return done / total

        assert all(abs(reached(r["t"]) - r["share"]) < 1e-9 for r in df.collect())


def test_mix_rows_in_order_with_clashing_columns(spark):
    data = [(k, prose(k, 30), "en", f"s{k % 2}", 1) for k in range(20)]
    docs = table(spark, data, ("size", "mix_pass", "copies", "before", "target"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_mix_pass", "_mix_position", "_mix_words"]
    got = [r["_mix_position"] for r in out.collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    per = defaultdict(int)
    for r in out.collect():
        per[r["source"]] += r["_mix_words"]
    assert abs(sum(per.values()) - 900) <= 2


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    d = folder(spark, tmp_path, empty)
    assert mixing.query(spark, d).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.query(spark, d).count() == 0


def test_boundaries_are_optimal():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(1, 7)
        lengths, counts, k = sorted(rnd.sample(range(1, 30), n)), [rnd.randint(1, 9) for _ in range(n)], rnd.randint(1, 5)
        cost = lambda bs: sum(c * min(b for b in bs if b >= x) for x, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost([*some, lengths[-1]]) for m in range(min(k, n)) for some in itertools.combinations(lengths[:-1], m))
        got = packing.best_boundaries(lengths, counts, k)
        assert cost(got) == best and len(got) <= k and got == sorted(got)
    assert packing.best_boundaries([], [], 3) == []


def test_pack_keeps_every_word_and_the_budget(spark):
    got = packing.pack(table(spark, extra=("size", "bucket", "piece")), max_len=50, buckets=3, budget=200).collect()
    have = defaultdict(int)
    for r in got:
        have[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for r in rows():
        want[r[0]] += words(r[1])
    assert have == want
    lengths = defaultdict(int)
    for r in got:
        if r["length"]:
            lengths[r["length"]] += 1
    bounds = packing.best_boundaries(list(lengths), list(lengths.values()), 3)
    batches = defaultdict(set)
    for r in got:
        if not r["length"]:
            assert r["bucket"] is None and r["batch"] is None and r["slot"] is None
            continue
        assert r["bucket"] == min(b for b in bounds if b >= r["length"])
        assert r["slot"] not in batches[r["bucket"], r["batch"]]
        batches[r["bucket"], r["batch"]].add(r["slot"])
    for (bucket, _), slots in batches.items():
        assert len(slots) * bucket <= 200 and slots == set(range(len(slots)))
    for bucket in {b for b, _ in batches}:
        sizes = sorted(len(s) for (b, _), s in batches.items() if b == bucket)
        assert all(n == 200 // bucket for n in sizes[1:])  # one batch may be short
