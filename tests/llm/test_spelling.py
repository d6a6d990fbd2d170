"""Spelling variants against a comparison of all pairs of words."""

import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from ledgerspark.llm import spelling

from .helpers import folder, prose, rows, table

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(data, least_count=5, times=5):
    counts = Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    forms = {}
    for w, n in words.items():
        own = [o for o in words if abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(own, key=lambda o: (-words[o], o), default=None)
        forms[w] = (len(own), best if best and words[best] >= times * n else None)
    out = []
    for w, (count, form) in forms.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        out.append((w, words[w], count, form, words.get(form), root))
    return sorted(out, key=str)


def corpus():
    stems = ["accommodate", "aaaaaaa", "aaaaaaaa", "aaaaaa", "Êtrangement", "étrangement", "etrangement", "banana", "bananas", "banananas", "mississippi", "misissippi", "mississipi", "ÀÁÂÃÄÅ", "àáâãäå", "letter", "setter", "better", "bettor"]
    data = []
    for k, s in enumerate(stems):
        lengths = range(0, len(s), 2)
        typos = [s, s.upper(), *(s[:i] + s[i + 1 :] for i in lengths), *(s[:i] + "x" + s[i:] for i in lengths), *(s[:i] + "q" + s[i + 1 :] for i in lengths), s[::-1], s + "ß", "÷" + s]
        for j, t in enumerate(typos):
            data.append((5000 + 40 * k + j, f"{t}, " * (5 + (600 if j < 2 else 7 * j % 31)) + f"{t}x1", "en", "s", 1))
    chain = [("rootword", 4000), ("rootwords", 700), ("rootwordsy", 120), ("rootwordsyz", 20)]
    data += [(9000 + k, f"{w} " * n, None, None, None) for k, (w, n) in enumerate(chain)]
    data += [(9100 + k, ("b" * 400 + "c" * k + " ") * 6 + prose(k, 600), None, None, None) for k in range(4)]
    data += [(None, "unnamed unname unnamee " * 9, None, None, None)] * 2
    return [*rows(), *data]


@pytest.mark.parametrize("bits", [64, 3])
def test_variants_equal_all_pairs(spark, bits):
    """With keys of three bits nearly all collide, and strings alone decide."""
    data = corpus()
    df = table(spark, data, extra=("word", "n", "form", "key"))
    got = spelling.variants(df, bits=bits)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plain(data)
    assert len({r[5] for r in found}) < len(found) and max(r[2] for r in found) > 5 and any(r[5] not in (r[0], r[3]) for r in found)


def test_keys_are_those_of_built_strings():
    words = ["aabbcc", "banana", "zzzzzz"]
    codes = np.array([[ord(c) for c in w] for w in words], np.uint32)
    for rows_, key, place, role in spelling.deletion_keys(codes):
        if role == spelling.LESS:
            short = np.array([[ord(c) for c in words[r][:place] + words[r][place + 1 :]] for r in rows_], np.uint32)
            assert (next(iter(spelling.deletion_keys(short)))[1] == key).all()


def test_longest_words_and_empty_tables(spark):
    data = [(k, ("ab" * 30_000 + "c" * (k // 5) + " "), None, None, None) for k in range(10)]
    found = {len(r["word"]): r for r in spelling.variants(table(spark, data)).collect()}
    assert {n: r["n_near"] for n, r in found.items()} == {60_000: 1, 60_001: 1} and found[60_000]["n"] == 5
    assert spelling.variants(table(spark).where("false")).count() == 0


def test_query_equals_duckdb(spark, tmp_path):
    path = folder(spark, tmp_path, table(spark, corpus()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want, got = con.sql(spelling.ORACLE), spelling.query(spark, path)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)
