import re

import numpy as np
import xxhash

from ledgerspark.llm import simhash
from ledgerspark.llm.common import components
from tests.llm.helpers import DOCS, folder, prose, rows, table


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(points):
    root = list(range(len(points)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(points))]


def test_query_against_all_pairs(spark, tmp_path):
    data = [(r[0], r[1]) for r in rows()]
    got = simhash.query(spark, folder(spark, tmp_path, table(spark))).collect()
    points = [plain(t) for _, t in data]
    group = groups_of(points)
    first = {}
    for (i, _), g in zip(data, group):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    want = [(i, f"{p:016x}", first.get(g)) for (i, _), p, g in zip(data, points, group)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_links_lose_nothing_at_any_chunk(spark):
    rng = np.random.default_rng(1)
    found = set()
    for b in rng.integers(0, 2**63, 25).tolist():
        for _ in range(25):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            found.add(x)
    points = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    df = spark.createDataFrame([(x, [x]) for x in signed], "node long, fp array<long>")
    group = groups_of(points)
    names = {}
    for s, g in zip(signed, group):
        names[g] = min(names.get(g, s), s)
    for chunk in (2048, 7):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, chunk=chunk)).collect()}
        assert all(got.get(s, s) == names[g] for s, g in zip(signed, group))


def test_every_block_value_has_an_anchor_in_reach():
    values = np.arange(1 << 15)
    rows_, anchors = simhash._anchors(values, 15)
    near = np.bitwise_count((values[rows_] ^ anchors).astype(np.uint64)) <= 1
    assert len(np.unique(rows_[near])) == 1 << 15  # covering radius 1
    assert (simhash._syndrome(anchors) == 0).all()


def test_golay_anchors_are_perfect():
    values = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    anchor = simhash.golay_anchor(values)
    assert np.bitwise_count((values ^ anchor).astype(np.uint64)).max() <= 3
    assert (simhash._remainder(anchor) == 0).all() and (simhash.golay_anchor(anchor) == anchor).all()


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def cosine(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_copies_at_the_border_of_the_similarity_meet(spark):
    """Recall of near copies with a cosine of 0.8 to 0.9 to their text, as planted edits of three words in a hundred give."""
    import random

    rnd = random.Random(11)
    data, pairs = [], []
    for k in range(150):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        copy, gap = list(base), 26 + k % 20
        for at in range(k % 13, 200, gap):
            copy[at] = f"new{at}"
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        pairs.append(cosine(data[-2][1], data[-1][1]))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    near = [k for k, c in enumerate(pairs) if 0.8 <= c]
    assert len(near) > 100 and min(pairs[k] for k in near) < 0.82 and {2 * k for k in range(150)} <= kept
    assert np.mean([2 * k + 1 not in kept for k in near]) >= 0.95
    assert all(2 * k + 1 in kept for k, c in enumerate(pairs) if c < 0.8)


def test_near_copies_meet_and_others_do_not(spark):
    import random

    rnd = random.Random(3)
    base = [prose(k * 31 + 5, 200 + 20 * (k % 5)) for k in range(40)]
    data, near, far = list(enumerate(base)), [], []
    for k, t in enumerate(base):
        for changes, kind in ((3, near), (60, far)):
            w = t.split()
            for at in rnd.sample(range(len(w)), changes):
                w[at] = f"new{at}"
            data.append((len(data), " ".join(w)))
            a, b = shingles(t), shingles(data[-1][1])
            kind.append((k, data[-1][0], len(a & b) / len(a | b)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(data, "doc_id long, text string"), simhash.NEAR_WORDS, simhash.NEAR_SIZE, (32, simhash.NEAR), simhash.LEAST).collect()}
    assert all(j >= 0.8 for _, _, j in near) and np.mean([got[a] == got[b] for a, b, _ in near]) > 0.9
    assert all(j < 0.4 for _, _, j in far) and not any(got[a] == got[b] for a, b, _ in far)
    assert len({got[k] for k in range(40)}) == 40


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    docs = table(spark, extra=("kept_id", "fp", "component_id"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted(set(ids)) and 17 not in ids and 18 not in ids and {0, 1, 3} <= set(ids)
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_a_large_family_of_edited_copies_is_one_group(spark):
    import random

    rnd = random.Random(5)
    base = [f"w{k}" for k in range(250)]
    data = [(0, " ".join(base))]
    for k in range(1, 301):  # each has 0.82 in common with the base, about 0.67 with another copy
        w, at = list(base), rnd.randrange(0, 20)
        for j in range(5):
            w[at + 45 * j + rnd.randrange(4)] = f"new{k}x{j}"
        data.append((k, " ".join(w)))
    assert all(cosine(data[0][1], t) >= 0.8 for _, t in data)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in simhash.keep_one(docs).collect()] == [0]


def test_alike_joins_what_it_should():
    base = np.arange(100)
    lost = lambda k: (base // 18 == k) if k < 5 else np.isin(base, np.arange(k, 100, 5)[:18])
    copies = [np.sort(np.concatenate((base[~lost(k)], 1000 * (k + 1) + np.arange(18)))) for k in range(8)]  # a cosine of 0.82 to the base, under 0.8 to each other
    assert sorted(simhash.alike(np.arange(9), np.zeros(9, int), [*copies, base], 0.8)) == [(k, 8) for k in range(8)]
    assert simhash.alike(np.arange(9), np.array([0] * 8 + [1]), [*copies, base], 0.8) == [(k, 8) for k in range(8)]
    assert len(simhash.alike(np.array([0, 0, *range(2, 9)]), np.zeros(9, int), [*copies, base], 0.8)) == 7


def test_repeated_lines_neither_hide_nor_make_near_copies(spark):
    import random

    rnd = random.Random(9)
    fresh = lambda n: " ".join(f"x{rnd.randrange(10**9)}" for _ in range(n))
    line, body = fresh(13), fresh(150)
    data = [(0, f"{line} " * 100 + fresh(30)), (1, f"{line} " * 100 + fresh(30)), (2, f"{line} {body}"), (3, f"{line} " * 40 + body)]
    sets = [shingles(t) for _, t in data]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.3 and len(sets[2] & sets[3]) / len(sets[2] | sets[3]) > 0.9
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def test_rows_without_or_with_shared_ids_are_judged_each_by_its_text(spark):
    def edited(t, at):
        w = t.split()
        w[at] = "edited"
        return " ".join(w)

    a, b, c, d, e = (prose(1000 + 31 * k, 200) for k in range(5))
    data = [(1, a), (2, b), (None, a), (None, edited(a, 50)), (None, c), (None, c), (None, edited(c, 90)), (7, d), (7, e), (7, edited(b, 20))]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    first = {(r["doc_id"], r["text"]) for r in got}
    assert len(got) == 5 and first >= {(1, a), (2, b), (7, d), (7, e)}
    assert [t in (c, edited(c, 90)) for i, t in first if i is None] == [True]
