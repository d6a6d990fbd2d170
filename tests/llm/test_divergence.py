"""Divergence of sources against plain counts in whole numbers."""

import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from ledgerspark.llm import divergence

from .helpers import folder, rows, table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(data, least_docs=3, top=200):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in data:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = sum((counts[lang, s] for s in own), Counter())
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in own}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own - {s}]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


CASES = [
    *((2000 + k, f"Ça va BIEN-sûr ÉTÉ été {'x' * (k % 4 + 1)} mot{k % 3} ÅNGSTRÖM", "fr", f"s{k % 4}", 1) for k in range(30)),
    (2100, None, "fr", "silent", 0), (2101, "1234 !!", "fr", None, 0), (2102, "solo", "xx", "one", 0), (2103, "rare words only", "yy", "a", 0), (2104, "other things", "yy", "b", 0),
    (2105, "tie one two three tie one two three", "zz", "a", 0), (2106, "tie one two three", "zz", "b", 0), (2107, "tie one two three", "zz", "c", 0), (2107, "tie one two three", "zz", "c", 0),
    (2108, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(9000)), "big", "a", 0), *((2109 + k, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}zz" for k in range(300)), "big", "b", 0) for k in range(3)),
]


def test_audit_equals_plain_counts(spark):
    data = [*rows(), *CASES]
    df = table(spark, data, extra=("rank", "value", "term", "salt"))
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    found = sorted(map(tuple, got.collect()))
    assert found == plain(data)
    assert ("yy", "a", "pair", "b", 0, 1) in found and not [r for r in found if r[0] == "xx"] and ("fr", "silent") in {r[:2] for r in found}
    assert sorted(map(tuple, divergence.audit(df, top=2).collect())) == plain(data, top=2)


def test_dense_shares_are_never_written(spark, monkeypatch):
    """Of 26 terms and 20 sources a row a term and a row a source go to tables, not a row for each of both."""
    written, cut = [], divergence.cut
    monkeypatch.setattr(divergence, "cut", lambda df, kept=False: written.append((kept, (found := cut(df, kept)).count())) or found)
    data = [(k, " ".join(f"w{chr(97 + t)}q" for t in range(26) if (t + k) % 3), "en", f"s{k % 20}", 0) for k in range(60)]
    assert sorted(map(tuple, divergence.audit(table(spark, data)).collect())) == plain(data)
    assert max(n for kept, n in written if not kept) == 26


def test_empty_table(spark):
    assert divergence.audit(table(spark).where("false")).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    terms = 10**9 + 7
    for n in (0, 9 * 10**9 - 1, 9 * 10**9, 7 * 10**17 + 3):
        for total in (n + 1, 4 * 10**18, 9 * 10**18):
            row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()
            assert row[0] == 1 + 10**9 * (n + 1) // (total + terms)


def test_query_equals_duckdb(spark, tmp_path):
    path = folder(spark, tmp_path, table(spark, [*rows(), *CASES]))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want, got = con.sql(divergence.ORACLE), divergence.query(spark, path)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
