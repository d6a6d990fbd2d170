"""Fingerprints, classifiers, media, pages and urls on small tables."""

import hashlib
import math
import random
import xml.etree.ElementTree as ET
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from ledgerspark.llm import gif, html_text, language, near, quality, spotsigs, url_filter
from tests.llm.helpers import DOCS, folder, prose, rows, table

key = lambda r: tuple(map(str, r))


# ---- SpotSigs


def test_spotsigs_query_against_plain_order(spark, tmp_path):
    got = spotsigs.query(spark, folder(spark, tmp_path, table(spark))).collect()
    order = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 2
        new = t[: len(t) - n] + after[:n]
        a, b, c = map(spotsigs.signatures, (t, new, after))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), spotsigs.as_text(a), spotsigs.as_text(b), spotsigs.likeness(a, b), spotsigs.likeness(a, c), plain_class(order, k)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def plain_class(docs, k, least=spotsigs.LEAST):
    """The least id among the documents that links of that likeness reach from one."""
    signs = [spotsigs.signatures(t) for _, t in docs]
    seen, todo = {k}, [k]
    while todo:
        at = todo.pop()
        new = {j for j in range(len(docs)) if j not in seen and spotsigs.likeness(signs[at], signs[j]) >= least}
        seen |= new
        todo += new
    return min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)


@pytest.mark.parametrize("data", [[], [(7, "the cat sat", None, None, None)], [(None, "a b", None, None, None), (None, "c", None, None, None)]])
def test_spotsigs_small_tables(spark, tmp_path, data):
    assert spotsigs.query(spark, folder(spark, tmp_path, table(spark, data))).count() == len(data)


def test_signatures_follow_anchors():
    assert len(spotsigs.signatures("The red fox and the big dog ran")) == 3  # the-red-fox, and-big-dog, the-big-dog
    assert (spotsigs.signatures("The RED fox, jumped") == spotsigs.signatures("the red fox jumped")).all()
    listed = " | ".join(f"w{k}" for k in range(40))
    mixed = spotsigs.signatures(listed[: len(listed) // 2] + " the cat ran to the house and sat")
    assert spotsigs.likeness(spotsigs.signatures(listed), mixed) > 0.1  # runs without anchors keep their signatures
    assert len(spotsigs.signatures("")) == 1 == len(spotsigs.signatures("word"))
    a, b = spotsigs.signatures("k m n o p"), spotsigs.signatures("k m n o q")
    assert 0 < spotsigs.likeness(a, b) < 1 and spotsigs.likeness(a, b, least=0.99) in (0.0, spotsigs.likeness(a, b))
    assert spotsigs.likeness(np.arange(2), np.arange(100), least=0.5) == 0.0


def test_only_odd_parts_of_a_text_are_matched(monkeypatch):
    """Texts with letters beyond ASCII are split at spaces and ASCII marks; what else stands between words is matched, with equal words and signatures."""
    seen, found = [], spotsigs._WORD.findall
    monkeypatch.setattr(spotsigs, "_WORD", SimpleNamespace(findall=lambda t: seen.append(t) or found(t)))
    draw, letters = random.Random(8), [*"aeéßΩİ  _-.,\n\x85²Ⅷ日·’“\u0301\u200b\ud800", " the ", " und ", " la "]
    texts = ["".join(draw.choices(letters, k=draw.randrange(120))) for _ in range(500)]
    for t in texts:
        words = found(t.lower())
        assert spotsigs._words(t) == words
        want, gap = set(), 0
        for i, w in enumerate(words):
            gap = 0 if w in spotsigs.ANCHORS else gap + 1
            after = [w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][:2]
            if len(after) == 2 and (not gap or gap > spotsigs.RUN):
                want.add(" ".join([w, *after]))
        want = want or {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} or {t}
        assert set(spotsigs.signatures(t).tolist()) == {int(hashlib.md5(s.encode("utf-8", "replace")).hexdigest()[:8], 16) for s in want}
    assert seen and not any(c in p for p in seen for c in " .,-_")
    seen.clear()
    assert spotsigs._words("Été, la forêt; l'hiver (déjà) là-bas.") == ["été", "la", "forêt", "l", "hiver", "déjà", "là", "bas"] and not seen


def test_near_groups_lose_no_link(spark):
    rnd = random.Random(3)
    base = [prose(k, 120) for k in range(8)]
    chain = [base[7]]
    for _ in range(12):  # each near the one before, the ends far apart
        w = chain[-1].split()
        for at in rnd.sample(range(len(w)), 3):
            w[at] = f"z{rnd.randrange(10**6)}"
        chain.append(" ".join(w))
    near = [t.replace(" mat ", " rug ", 1) for t in base]
    texts = [*base, *near, *chain, base[0], "", "", None, "word", "word"]
    data = [*enumerate(texts), (None, base[1]), (None, "only without an id"), (3, "another text of this id")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for least in (0.8, 0.5):
        got = {(r["doc_id"], r["node"]): r["class_id"] for r in spotsigs.near_groups(docs, least).collect()}
        plain = [(i, t or "") for i, t in data]
        want = {(i, spotsigs.node_of(spotsigs.signatures(t))): plain_class(plain, k, least) for k, (i, t) in enumerate(data)}
        assert got == want
    assert spotsigs.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_refuse_nothing_alike_and_most_else(spark):
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (1, 5, 40, 400, 3000)]
    pairs = []
    for s in sets:
        for lost in range(0, len(s) // 3 + 1, max(1, len(s) // 40)):
            kept = s[rnd.permutation(len(s))[: len(s) - lost]]
            pairs.append((s, np.unique(np.concatenate([kept, rnd.integers(0, 1 << 32, lost // 2, dtype=np.uint32)]))))
    pairs += [(np.unique(rnd.integers(0, 1 << 32, 60, dtype=np.uint32)), np.unique(rnd.integers(0, 1 << 32, 64, dtype=np.uint32))) for _ in range(200)]
    rows_ = [(k, s.view(np.int32).tolist()) for k, s in enumerate(s for p in pairs for s in p)]
    found = {r["node"]: list(r[1:]) for r in spotsigs.sketches(spark.createDataFrame(rows_, "node long, signs array<int>")).collect()}
    x, y = (np.array([found[2 * k + side] for k in range(len(pairs))]) for side in (0, 1))
    fits = spotsigs.may_be_alike(0.8)(x, y)
    assert all(fit for fit, (a, b) in zip(fits, pairs) if spotsigs.likeness(a, b) >= 0.8) and not fits[-200:].any()


def test_keys_of_one_set_go_and_frequent_ones_stay_unseen(spark):
    data = [(k, list(range(k % 5 * 1000, k % 5 * 1000 + 40)) + [10**6 * k + j for j in range(20 + k)]) for k in range(30)]
    classes = spark.createDataFrame(data, "node long, signs array<int>").repartition(5)
    every = [tuple(r) for r in spotsigs.prefix_keys(classes, 0.8, -1).collect()]
    n = Counter(k for k, _ in every)
    assert sorted(map(tuple, spotsigs.prefix_keys(classes, 0.8, 10**9).collect())) == sorted(r for r in every if n[r[0]] > 1) != sorted(every)


def test_alike_sets_share_a_key_and_others_hardly_any(spark):
    """Sets of few distinct signatures share those by chance, but no parts of them."""
    draw = np.random.default_rng(6)
    pick = lambda n: draw.choice(20_000, n, replace=False).astype(np.int64) * 214_748
    sets = [pick(int(n)) for n in draw.integers(1, 300, 1500)]
    for s in [s for s in sets[:300] if len(s) > 4]:
        k = len(s) // 9  # of n signatures n / 9 replaced: a Jaccard coefficient of 0.8 or more; or a fifth left out
        sets += [np.concatenate([s[k:], pick(k) + 1]), s[len(s) // 5 :]]
    data = [(k, np.unique(s.astype(np.uint32)).view(np.int32).tolist()) for k, s in enumerate(sets)]
    held = Counter(k for _, s in data[:1500] for k in s)
    found = [tuple(r) for r in spotsigs.prefix_keys(spark.createDataFrame(data, "node long, signs array<int>").repartition(7), 0.8).collect()]
    keys = {}
    for key_, node in found:
        keys.setdefault(node, set()).add(key_)
    signs = [np.array(s, np.int32).view(np.uint32) for _, s in data]
    at = 1500
    for k in [k for k, s in enumerate(sets[:300]) if len(s) > 4]:
        for other in (at, at + 1):
            if 0.8 <= spotsigs.likeness(np.sort(signs[k]), np.sort(signs[other])) < 1:
                assert keys[k] & keys[other]
        at += 2
    assert sum(n > 1 for n in held.values()) > 0.9 * len(held)
    alone = [(key_, node) for key_, node in found if 300 <= node < 1500]
    assert len(alone) < 0.02 * sum(len(s) for s in sets[300:1500])


def test_unrelated_texts_make_no_candidates(spark, monkeypatch):
    """Links that fail join nothing: the texts of a growing vocabulary of rare words never come together."""
    draw = np.random.default_rng(9)
    common, words = sorted(spotsigs.ANCHORS), np.minimum(draw.zipf(1.2, (3000, 120)), 20_000)
    docs = spark.createDataFrame([(k, " ".join(common[w] if w < len(common) else f"w{w}x" for w in row)) for k, row in enumerate(words.tolist())], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(spotsigs, "pairs", lambda *a, **k: seen.append(near.pairs(*a, **k)) or seen[-1])
    assert spotsigs.near_groups(docs).where("doc_id <> class_id").count() == 0
    assert [df.count() for df in seen] == [0]


def test_candidate_pairs_at_any_chunk(spark):
    """Keys of two labels, over chunks of two rows: every pair of labels that passes is found, and a spanning one joins as much."""
    rnd = random.Random(6)
    rows_ = [(k // 9, 100 + k, (100 + k) if k % 4 else 100 + k // 9 * 9, rnd.randrange(1 << 6)) for k in range(90)]
    df = spark.createDataFrame([r[:3] for r in rows_], "key long, node long, label long")
    drawn = spark.createDataFrame([(r[1], r[3]) for r in rows_], "node long, w0 long")
    fits = lambda x, y: np.bitwise_count(x[:, 0] ^ y[:, 0]) <= 2
    want = {(a[1], b[1]) for a in rows_ for b in rows_ if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and (a[3] ^ b[3]).bit_count() <= 2}
    for chunk in (2, 1000):
        assert {tuple(r) for r in near.pairs(df, drawn, fits, False, chunk).collect()} == want
        some = {tuple(r) for r in near.pairs(df, drawn, fits, True, chunk, "-node").collect()}
        assert some <= want and _joined(rows_, some) == _joined(rows_, want)


def _joined(rows_, links) -> dict:
    root = {n: label for _, n, label, _ in rows_}
    for _ in rows_:
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    return root


# ---- quality and language


def test_quality_learns_and_never_reads_held_out_labels(spark, tmp_path):
    good = [(k, prose(k, 80), "en", "s", 1) for k in range(60)]
    bad = [(100 + k, "!!! ### " * (20 + k) + "BUY " * k, "en", "s", 1) for k in range(60)]
    docs = table(spark, [*good, *bad, (500, None, None, None, None), (None, "", None, None, None)], ("score", "stats", "held_out", "label"))
    truth = {r[0]: int(r[0] < 100) for r in [*good, *bad]}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = spark.createDataFrame([(i, q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int")
    wrong = spark.createDataFrame([(i, 1 - q if held(i) else q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int")
    one = quality.query(spark, folder(spark, tmp_path / "a", docs, labels=labels)).collect()
    two = quality.query(spark, folder(spark, tmp_path / "b", docs, labels=wrong)).collect()
    assert sorted(map(tuple, one), key=key) == sorted(map(tuple, two), key=key)
    assert len(one) == 122
    tested = [r for r in one if r["held_out"]]
    assert tested and all(r["held_out"] == held(r["doc_id"]) for r in one if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested if r["doc_id"] in truth]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in one)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in one if r["score"] >= 0.5}


def test_discriminant_against_plain_densities(spark):
    """Scores from cached Cholesky factors equal the posterior of two normal densities with the shrunk covariances."""
    rng = np.random.default_rng(4)
    d = len(quality.NAMES)
    label = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, d)) * (1 + label[:, None]) + label[:, None] * 0.4
    x[:, 0] = np.abs(x[:, 0]) + 2  # the logarithm of one and the number of words
    x[:7] = x[0]  # repeated rows
    rows_ = [(row.tolist(), int(y)) for row, y in zip(x, label)] + [(x[9].tolist(), None)]
    model = quality.learn(spark.createDataFrame(rows_, "stats array<double>, label int").repartition(3))
    centre = x.mean(0)
    words = np.expm1(x[:, :1])
    z = centre + (x - centre) * words / (words + quality.HALF_WORDS)
    covs = [np.cov(z[label == c].T, bias=True) for c in (0, 1)]
    n = np.bincount(label)
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    ridge = np.diag(np.diag(pooled))
    log = []
    for c in (0, 1):
        s = (1 - quality.RIDGE) * ((1 - quality.POOLED) * covs[c] + quality.POOLED * pooled) + quality.RIDGE * ridge
        away = z - z[label == c].mean(0)
        log.append(np.log(n[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (away * np.linalg.solve(s, away.T).T).sum(1))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    assert np.abs(model.score(x) - want).max() < 1e-6


def test_quality_without_labels(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.query(spark, folder(spark, tmp_path, table(spark), labels=none)).collect()
    assert {r["score"] for r in got} == {0.5}
    assert quality.accepted(spark.createDataFrame([], DOCS), none).count() == 0


def test_language_on_held_out_rows(spark, tmp_path):
    de = "der hund und die katze sind nicht im haus aber gehen schnell zur straße"
    fr = "le chien est dans la maison avec une très belle fenêtre où il dort"
    data = [(k, " ".join((de if k % 2 else fr).split()[k % 5 :] * (1 + k % 3)), "de" if k % 2 else "fr", "s", 1) for k in range(80)]
    data += [(90, None, "fr", None, None), (91, "123 !!", "de", None, None), (92, "der hund", None, None, None), (None, "le chien", None, None, None)]
    got = {r["doc_id"]: r for r in language.query(spark, folder(spark, tmp_path, table(spark, data, ("score", "gram", "n")))).collect()}
    assert all(got[k]["lang_pred"] == data[k][2] for k in range(80))
    assert any(got[k]["held_out"] for k in range(80))
    assert (got[90]["lang_pred"], got[91]["lang_pred"], got[92]["lang_pred"], got[None]["lang_pred"]) == ("und", "und", "de", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_with_nothing_to_learn(spark, tmp_path):
    data = [(0, "abc", None, None, None), (1, None, None, None, None)]
    assert {r["lang_pred"] for r in language.query(spark, folder(spark, tmp_path, table(spark, data))).collect()} == {"und"}
    assert language.query(spark, folder(spark, tmp_path / "e", table(spark, []))).count() == 0


def test_filters_return_every_language_of_a_gram(spark):
    docs = spark.createDataFrame([("abab", "x"), ("abab", "y"), ("cdcd", "y")], "text string, lang string")
    f = language.learn(docs)
    assert f.langs == ["x", "y"]
    codes, _ = language.ngrams(["abab"])
    at = language.slots(codes, len(f.masks).bit_length() - 1)
    hit = f.masks[at[0], 0] & f.masks[at[1], 0] & f.masks[at[2], 0]
    assert (hit & np.uint64(1)).all() and (hit & np.uint64(2)).all()


def test_language_against_plain_sets(spark):
    from collections import Counter

    rnd = random.Random(6)
    letters = {"aa": "abcdefg ", "bb": "defghij ", "cc": "ghijklm ", "dd": "abcklm "}
    made = [(lang, "".join(rnd.choice(own) for _ in range(rnd.choice([30, 90, 300])))) for lang, own in letters.items() for _ in range(40)]
    made += [("aa", "abc " * 3000), ("aa", "abc " * 3000), (None, "abc def"), ("bb", None), ("bb", "")]
    grams = lambda t: Counter(f" {t} "[k : k + 3] for k in range(len(t)) if t[k] != " ")
    counts = {lang: sum((grams(t) for own, t in made if own == lang and t), Counter()) for lang in letters}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    sets = {lang: {g for g, x in r.items() if x >= language.SHARE * best[g]} for lang, r in rate.items()}
    model = language.learn(spark.createDataFrame(made, "lang string, text string").repartition(3))
    assert model.langs == sorted(letters) and model.sizes == [len(sets[lang]) for lang in model.langs] and model.false_rate.max() < 1e-6
    for own in letters.values():
        for n in (1, 5, 40):
            t = "".join(rnd.choice(own) for _ in range(n))
            found = grams(t)
            share = [sum(m for g, m in found.items() if g in sets[lang]) / max(sum(found.values()), 1) for lang in model.langs]
            (lang,), (score,) = model.score([t])
            if found and sum(share):
                assert lang == model.langs[int(np.argmax(share))] and abs(score - max(share) / sum(share)) < 1e-5


def test_filters_stay_sparse_whatever_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MODEL_WORDS", 1 << 12)
    rnd = random.Random(7)
    signs = [chr(0x4E00 + k) for k in range(3000)]
    english = "the cat sat on the mat and then it ran off to see what was there"
    data = [("zh", "".join(rnd.choice(signs) for _ in range(3000))) for _ in range(10)] + [("zh", "".join(signs[:50]) * 10), ("en", english)]
    model = language.learn(spark.createDataFrame(data, "lang string, text string"))
    assert len(model.masks) == 1 << 12 and model.false_rate.max() < 0.05 and max(model.sizes) <= 600
    assert model.score([english, "".join(signs[:50])])[0] == ["en", "zh"] and model.score([english])[1][0] > 0.9


def test_more_languages_than_a_word_has_bits(spark):
    data = [(f"l{k:04}", chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) * 2) for k in range(1100)] + [("l0000", "x" * 5000)]
    model = language.learn(spark.createDataFrame(data, "lang string, text string"))
    assert len(model.langs) == 1100 and model.masks.shape[1] == 18
    assert model.score([data[k][1] for k in (0, 70, 1099)])[0] == ["l0000", "l0070", "l1099"]


# ---- GIF


def test_gif_round_trip_of_every_text(spark, tmp_path):
    got = {(r["doc_id"], r["n_bytes"]): r for r in gif.query(spark, folder(spark, tmp_path, table(spark))).collect()}
    for i, t, *_ in rows():
        raw = (t or "").encode()
        full = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def lzw(samples: bytes, size: int) -> bytes:
    """A plain encoder with a growing table."""
    clear, end = 1 << size, (1 << size) + 1
    codes, words, width, word = [(clear, size + 1)], {bytes([i]): i for i in range(clear)}, size + 1, b""
    for k in range(len(samples)):
        c = samples[k : k + 1]
        if word + c in words:
            word += c
            continue
        codes.append((words[word], width))
        if len(words) + 2 < 4096:
            words[word + c] = len(words) + 2
            if len(words) + 2 > 1 << width and width < 12:
                width += 1
        else:
            codes.append((clear, width))
            words, width = {bytes([i]): i for i in range(clear)}, size + 1
        word = c
    codes += [(words[word], width)] if word else []
    codes.append((end, width))
    held = bits = 0
    out = bytearray()
    for code, w in codes:
        held |= code << bits
        bits += w
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8
    return bytes(out) + (bytes([held]) if bits else b"")


def test_lzw_decodes_growing_tables():
    rng = np.random.default_rng(0)
    for size, n in ((2, 50), (4, 3000), (8, 70_000)):
        raw = rng.integers(0, 1 << size, n).astype(np.uint8)
        raw[n // 3 : n // 2] = 1
        assert (gif.lzw_decode(lzw(raw.tobytes(), size), size, n) == raw).all()
    with pytest.raises(ValueError):
        gif.lzw_decode(lzw(bytes(10), 2), 2, 500)


def test_encoder_equals_the_plain_one_and_both_read_back():
    rng = np.random.default_rng(1)
    for n, levels in ((1, 256), (64, 2), (5000, 4), (60_000, 30), (300_000, 256)):
        raw = rng.integers(0, levels, n).astype(np.uint8).tobytes()
        assert (gif.lzw_decode(gif.lzw_encode(raw), 8, n) == np.frombuffer(raw, np.uint8)).all()
        if n <= 3000:  # before the table is full both write the same codes
            assert gif.lzw_encode(raw) == lzw(raw, 8)


def test_repeated_rows_are_transparent_and_payloads_come_from_the_canvas():
    line = bytes(range(32, 96))
    rows_ = [line, line[::-1], bytes(64)] * 200
    rows_[300] = b"x" * 64
    payload = b"".join(rows_)
    media = gif.encode(payload, frame_rows=30)
    frames = gif.decode(media)
    assert len(frames) == 20 and b"".join(map(gif.payload_of, frames)) == payload
    assert {f.disposal for f in frames} == {1, 2} and frames[1].transparent == 255 and (frames[1].samples == 255).all()
    assert len(media) < len(payload) // 6
    every = bytes(range(256)) * 2  # no value is left for transparency
    assert b"".join(map(gif.payload_of, gif.decode(gif.encode(every, frame_rows=4)))) == every


def test_disposal_and_transparency():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    head = b"GIF89a" + (2).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette

    def frame(samples, disposal, transparent=None, left=0):
        flags = disposal << 2 | (transparent is not None)
        body = lzw(bytes(samples), 2)
        return b"\x21\xf9\x04" + bytes([flags, 7, 0, transparent or 0]) + b"\0\x2c" + left.to_bytes(2, "little") + b"\0\0" + len(samples).to_bytes(2, "little") + b"\1\0\0" + b"\2" + bytes([len(body)]) + body + b"\0"

    shown = gif.decode(head + frame([0, 1], 1) + frame([2, 3], 3, transparent=3) + frame([2], 2, left=1) + frame([3, 1], 1, transparent=3) + b"\x3b")
    colours = [[tuple(p) for p in f.canvas[0].tolist()] for f in shown]
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert colours[0] == [red, green]
    assert colours[1] == [blue, green]  # the transparent sample leaves what is below
    assert colours[2] == [red, blue]  # the frame before was put back
    assert colours[3] == [red, green]
    assert [f.delay_ms for f in shown] == [70] * 4
    assert sum(gif.histogram(shown[0])) == 6


def test_store_frames(spark):
    row = gif.store_frames(spark.createDataFrame([(1, "x" * 200), (2, None)], "doc_id long, text string")).orderBy("id").first()
    assert row["frames"][0]["height"] == 4 and row["media"][:6] == b"GIF89a"
    assert [sum(f["histogram"]) for f in row["frames"]] == [3 * 256] and row["frames"][0]["delay_ms"] == 100


def test_gif_query_on_an_empty_table(spark, tmp_path):
    assert gif.query(spark, folder(spark, tmp_path, table(spark, []))).count() == 0


# ---- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="nav-open">
<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Big &amp; bold</h1><p>First   para&shy;graph with <a href=x>a link</a> inside.<p>Second <b>one</b>&nbsp;here<br>and on.</p>
<aside>side</aside><form><input>send</form><div class="share">Share</div><section><p>Third.</p></section></article>
<div id="comments"><p>Great article, I have a very long opinion on all of it.</p></div><footer>(c)</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == "Big & bold First para\u00adgraph with a link inside. Second one here and on. Third."


def test_main_text_by_density_alone():
    blocks = "".join(f"<p>{prose(k, 30)}.</p>" for k in range(4))
    links = "".join(f"<li><a href=/{k}>word {k}</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div>{blocks}</div></div><div><ul>{links}</ul></div></body>"
    assert html_text.main_text(page) == " ".join(f"{prose(k, 30)}." for k in range(4))


def plain_main_text(page):
    """Composite text density by recursion over a well-formed page of div, p, ul, li, a and b, without anything to leave out."""
    body = ET.fromstring(page)
    flat = lambda t: len(" ".join((t or "").split()))

    def counts(e, linked=False):
        linked = linked or e.tag == "a"
        c = flat(e.text)
        lc, t, lt = c * linked, 0, 0
        for child in e:
            for k, v in enumerate(counts(child, linked)):
                c, lc, t, lt = (x + v * (j == k) for j, x in enumerate((c, lc, t, lt)))
            t += child.tag != "b"
            lt += child.tag == "a"
            c += flat(child.tail)
            lc += flat(child.tail) * linked
        return c, lc, t, lt

    whole = counts(body)

    def density(e):
        c, lc, t, lt = counts(e)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + whole[1] / whole[0] * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(max(base, 1 + 1e-9))

    total = lambda e: sum(total(x) if x.tag == "b" else density(x) for x in e)
    above = {x: e for e in body.iter() for x in e}
    nodes = [e for e in body.iter() if e.tag != "b"]
    core = max(nodes, key=lambda e: (total(e), -nodes.index(e)))
    path = [core]
    while path[-1] is not body:
        path.append(above[path[-1]])
    least = min(density(e) for e in path if e.tag != "b")
    chosen = set()
    for e in nodes:
        if density(e) >= least and counts(e)[0]:
            own = [x for x in e.iter() if x.tag != "b"]
            chosen.add(max(own, key=lambda x: (total(x), -own.index(x))))
    out = []

    def walk(e, kept):
        c, lc, _, lt = counts(e)
        menu = e.tag in ("div", "p", "ul") and lt >= 3 and lc >= 0.8 * c and density(e) < least
        kept = e in chosen or kept and not menu
        edge = [" "] if e.tag not in ("a", "b") else []
        out.extend(edge + ([e.text or ""] if kept else []))
        for child in e:
            walk(child, kept)
            out.extend([child.tail or ""] if kept else [])
        out.extend(edge)

    walk(body, False)
    return " ".join("".join(out).split())


def test_core_by_density_equals_a_plain_version():
    rnd = random.Random(2)

    def block(depth):
        kind = rnd.choice(["p", "p", "p", "links", "div", "div"] if depth < 4 else ["p"])
        if kind == "links":
            return "<ul>" + "".join(f"<li><a>{prose(rnd.randrange(99), rnd.randint(1, 4))}</a></li>" for _ in range(rnd.randint(2, 7))) + "</ul>"
        if kind == "p":
            return f"<p>{prose(rnd.randrange(99), rnd.randint(2, 60))} <b>{prose(rnd.randrange(99), 3)}</b> end</p>"
        return "<div>" + "".join(block(depth + 1) for _ in range(rnd.randint(1, 5))) + "</div>"

    seen = set()
    for _ in range(60):
        page = "<body>" + "".join(block(0) for _ in range(rnd.randint(1, 5))) + "</body>"
        want = plain_main_text(page)
        assert html_text.main_text(page) == want
        seen.add(len(want) < len(" ".join(ET.fromstring(page).itertext())) - 40)
    assert seen == {True, False}


def test_article_tags_are_not_needed():
    body = "".join(f"<p>{prose(k, 40)}.</p>" for k in range(5))
    inside = lambda tag: f"<body><nav>menu</nav><{tag}><h1>{prose(77, 9)}</h1>{body}</{tag}><div class=ad>{prose(5, 90)}</div><footer>foot</footer></body>"
    assert len({html_text.main_text(inside(t)) for t in ("article", "main", "div", "section")}) == 1


def test_menus_without_a_name_go_and_linked_prose_stays():
    menu = "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(12))
    page = f"<main><ul>{menu}</ul><p>{prose(1, 40)} <a href=x>see this</a>.</p><p><a href=y>{prose(2, 5)}</a></p><ul><li>{prose(3, 20)}</li></ul></main>"
    assert html_text.main_text(page) == f"{prose(1, 40)} see this. {prose(2, 5)} {prose(3, 20)}"


@pytest.mark.parametrize("page", ["", "<", "<p", "plain", "<script>never closed", "<div>" * 3000 + "deep", "</p></b>x", "<a href='x>y", "<!-- open", "&#xZZ; &bogus; &#0;", "<p>" * 5000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_query(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.query(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got)[2:] == [("2", "", 0), ("None", "", 0)]
    assert got and all(r["n_chars"] == len(r["text"]) for r in got)


# ---- urls


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [None, "", "no scheme/com/en/", "http://example.com/en/7", "http://A.Example.COM/en/8?x", "https://notexample.com/en/71", "x://example.net/de/8/9#f", "x://net/de/1", "x://org/es/", "x://sub.org/es", "x://", "x://?q", "x://com", "a://b://com/en/", "x://com/en/\nfoo", "x://.com/en/", "x://ÄB.com/en/q"]


def test_url_rules_both_ways(spark):
    df = spark.createDataFrame(list(enumerate([*URLS, *URLS])), "page_id long, url string")
    want = [(k, *plain_rule(u, url_filter.RULES)) for k, u in enumerate([*URLS, *URLS])]
    assert sorted(map(tuple, url_filter.filter_urls(df, url_filter.RULES).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, url_filter.filter_urls(df, url_filter.RULES, max_index_bytes=0).collect()), key=key) == sorted(want, key=key)


def test_url_rules_over_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_ROWS", 3)
    listed = [*url_filter.RULES, *(("block", f"h{k}.com", "/x" * (k % 4)) for k in range(30))]
    urls = [*URLS, *(f"http://a.h{k}.com/x/x/x/{k}" for k in range(30))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(k, *plain_rule(u, listed)) for k, u in enumerate(urls)]
    as_table = spark.createDataFrame(listed, "verdict string, host string, path string")
    assert sorted(map(tuple, url_filter.filter_urls(df, as_table).collect()), key=key) == sorted(want, key=key)
    assert url_filter.filter_urls(df.limit(0), as_table).count() == 0


def test_colliding_digests_do_not_decide():
    packed = url_filter.RuleIndex.pack([("block", "com", "/a")])
    index = url_filter.RuleIndex.mapped("t", packed)
    assert index.find(["com"], ["/a"]) == [("com/a", True)]
    broken = url_filter.RuleIndex(index.keys, index.starts, index.verdicts, index.lengths, np.frombuffer(b"com/b", np.uint8))
    assert broken.find(["com"], ["/a"]) == [None]
