"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has a bit for each of 64 positions: set if it is set in more than half of the XXH64 values of the text's
word shingles; further words of 64 bits come from the same values, mixed anew. Fingerprints within a number of differing bits link; components of links are groups.

Candidate search covers the space with anchors, the words of a covering code. A fingerprint goes to every anchor within the
covering radius plus the threshold, and per anchor fingerprints are compared whole. Two codes serve two needs:

* ``Hamming``, for 64 bits and 4 differing ones, loses no link. The bits fall into three blocks of 21, 21 and 22; with at most four
  differing bits, one block differs in one bit at most. An anchor of a block has a word of the perfect Hamming code in
  fifteen bits and anything in the others: covering radius 1, and threshold 1.
* ``Golay``, for 256 bits and the many differing ones of texts whose shingle sets have a cosine of 0.8 (the likeness that SimHash
  bits estimate). Each of ``BLOCKS`` sets of 23 bits has the words of the perfect Golay code as anchors: covering
  radius 3, and threshold 0, so exactly one anchor. Texts at the border of the similarity meet in at least one set with
  probability 0.95, at 0.85 with 0.99. Links so found are then checked on the whole texts, by the exact cosine of their sets of
  shingles. Where links that fail leave apart what the candidates hold together, all texts of that component are compared so.
  The first ``FIRST`` sets go ahead; the others then look only for links between texts that the checked ones leave apart, so that a
  large group costs a few links a text, not one for every set.

Only distinct fingerprints (with checked links: distinct texts, whose repeated shingles count once) are compared, so exact copies cost nothing. An anchor with more than ``CHUNK`` fingerprints
is dealt over pairs of chunks of that size, each a group of its own. A group hands on a spanning forest of its links,
not all of them: as many rows as fingerprints at most. Components are found by alternating large-star and small-star rounds of joins, cut at each round.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other. Fewer words than a
shingle: the whole sequence is the shingle. Repeated rows get equal values. A null doc_id counts last: its
component is the smallest non-null doc_id of the group, or null if there is none; ids are under 2^62. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, map_columns, table

WORDS, SEED, DISTANCE = 4, 42, 4
CHUNK = 2048
#: Five-word shingles, a cosine of their sets of 0.8 or more, 256 bits. At that cosine 52 bits differ on average, with
#: a standard deviation of 6.5; ``NEAR`` bits let 98 of 100 such pairs through to the exact check.
NEAR_WORDS, LEAST, NEAR_SIZE, NEAR = 5, 0.8, 4, 66
BLOCKS, FIRST = 48, 12
#: Fingerprints that only null ids have are named from here on, so that an id is always the lesser name.
NO_ID = 1 << 62
HAMMING_BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = WORDS, size: int = 1, distinct: bool = False) -> list[int]:
    """The fingerprint as ``size`` unsigned numbers; with ``distinct``, repeated shingles count once."""
    flat = b" ".join((text or "").encode().translate(_LOWER).split())
    if not flat:
        return [0] * size
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(flat)]
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    if len(starts) < words:
        starts, ends, words = [0], [len(flat)], 1
    h = np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], "<u8")
    if distinct:
        h = np.unique(h)
    out = []
    for k in range(size):
        set_ = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = h[at : at + (1 << 16)] if k == 0 else _mixed(h[at : at + (1 << 16)], k)
            set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(set_ * 2 > len(h), bitorder="little").view("<u8")[0]))
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other digests out of digests: the finaliser of a split-mix generator."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = WORDS, size: int = 1) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the words of 64 bits as signed longs."""

    def run(ids, texts):
        return {"doc_id": ids, "fp": [[f - (1 << 64) if f >> 63 else f for f in fingerprint(t, words, size)] for t in texts]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp array<long>")


def text_node(text: str = "text") -> Column:
    """What names a distinct text: 64 bits of digest."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def marks(docs: DataFrame, words: int, size: int) -> DataFrame:
    """``doc_id, node, fp`` of every row: the name of its text, and the fingerprint of its distinct shingles."""

    def run(ids, nodes, texts):
        return {"doc_id": ids, "node": nodes, "fp": [[f - (1 << 64) if f >> 63 else f for f in fingerprint(t, words, size, True)] for t in texts]}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node().alias("node"), "text"), run, "doc_id long, node long, fp array<long>")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Of the low fifteen bits: the exclusive or of the positions (1 to 15) of the set ones; 0 for code words."""
    out = np.zeros(word.shape, np.int64)
    for k in range(15):
        out ^= ((word >> k) & 1) * (k + 1)
    return out


def _anchors(block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors: every code word within two bits of each block value. Code word: low fifteen bits Hamming, rest free."""
    rows, found = [], []
    at = np.arange(len(block))
    flips = [0, *(1 << i for i in range(width)), *((1 << i) | (1 << j) for i in range(width) for j in range(i))]
    own = _syndrome(block)
    for f in flips:
        hit = (own ^ int(_syndrome(np.array([f]))[0])) == 0
        rows.append(at[hit])
        found.append(block[hit] ^ f)
    return np.concatenate(rows), np.concatenate(found)


def hamming_anchors(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and anchor names, block by block, of fingerprints of 64 bits."""
    for k, (first, width) in enumerate(HAMMING_BLOCKS):
        rows, anchors = _anchors((fp[:, 0] >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1), width)
        yield rows, anchors << 2 | k


GOLAY = 0xC75  # the generator polynomial
_LEADERS: list[np.ndarray] = []


def _remainder(word: np.ndarray) -> np.ndarray:
    for k in range(22, 10, -1):
        word = word ^ ((word >> k) & 1) * (GOLAY << (k - 11))
    return word


def golay_anchor(word: np.ndarray) -> np.ndarray:
    """The one code word within three bits of each 23-bit value."""
    if not _LEADERS:
        leaders = np.zeros(2048, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                leaders[_remainder(np.array([error]))[0]] = error
        _LEADERS.append(leaders)
    return word ^ _LEADERS[0][_remainder(word)]


def golay_anchors(fp: np.ndarray, blocks: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The anchor of each fingerprint in each of the bit sets, which are fixed draws from all its bits."""
    draw = np.random.default_rng(23)
    rows = np.arange(len(fp))
    for k in range(blocks.stop):
        bits = draw.choice(64 * fp.shape[1], 23, replace=False).tolist()
        if k not in blocks:
            continue
        value = np.zeros(len(fp), np.int64)
        for bit in bits:
            value = value << 1 | (fp[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int64)
        yield rows, golay_anchor(value) >> 11 << 8 | k  # the first twelve bits name a code word


def covered(fps: DataFrame, size: int, blocks: range = range(BLOCKS)) -> DataFrame:
    """``anchor, node, label`` and the words ``w0`` and on of each distinct fingerprint, at every anchor that covers it."""
    words = [f"w{k}" for k in range(size)]
    search = hamming_anchors if size == 1 else lambda fp: golay_anchors(fp, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label, *own = (c.to_numpy() for c in b.columns)
            for rows, anchors in search(np.stack(own, 1).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors), *(pa.array(c[rows]) for c in (node, label, *own))], names=["anchor", "node", "label", *words])

    rows = fps.select("node", "label", *(F.col("fp")[k].alias(w) for k, w in enumerate(words)))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("anchor", "node", "label", *words)))


def forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, *distances: int, label: np.ndarray | None = None) -> np.ndarray:
    """Index pairs of linked fingerprints that span each group's components; ``fp`` has a row of words per fingerprint.

    Rows of one ``label`` are together already. Links are taken up to the first distance, then up to the next, so that close ones span what they can.

    Rows come sorted by group; in a group with two sides only links between them count. One pass per lag compares each row
    with the row so much later, for all groups at once.
    """
    n = len(fp)
    root = np.arange(n)
    if label is not None and n:
        order = np.lexsort((root, label, group))
        new = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])))
        root[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    two = np.repeat(np.maximum.reduceat(side, starts) > 0, np.diff(np.append(starts, n))) if n else np.zeros(0, bool)
    for distance in distances:
        left, lag = np.arange(n), 0
        while len(left):
            lag += 1
            left = left[left + lag < n]
            left = left[group[left] == group[left + lag]]
            bits = np.bitwise_count(fp[left, 0] ^ fp[left + lag, 0]).astype(np.int16)
            for k in range(1, fp.shape[1]):
                bits += np.bitwise_count(fp[left, k] ^ fp[left + lag, k])
            near = left[bits <= distance]
            near = near[(side[near] != side[near + lag]) | ~two[near]]
            near = near[root[near] != root[near + lag]]
            for i in near.tolist():
                a, b = i, i + lag
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((i, i + lag))
            if len(near):
                while (root[root] != root).any():
                    root = root[root]
    return np.array(out, np.int64).reshape(-1, 2)


def links(fps: DataFrame, size: int = 1, distances: tuple[int, ...] = (DISTANCE,), chunk: int = CHUNK, blocks: range = range(BLOCKS)) -> DataFrame:
    """Distinct links ``a, b`` of nodes (a < b) that span the components of the distinct fingerprints ``node, fp``.

    Fingerprints of one ``label`` (if there is such a column) are together already and get no links among themselves.
    """
    words = [f"w{k}" for k in range(size)]
    spread = cut(covered(fps if "label" in fps.columns else fps.withColumn("label", F.col("node")), size, blocks))
    large = cut(spread.groupBy("anchor").count().where(F.col("count") > chunk).select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least("part", q).alias("x"), F.greatest("part", q).alias("y")))
    rows = (
        spread.join(large, "anchor", "left")
        .withColumn("part", part)
        .select("anchor", "node", "label", *words, "part", F.explode(cells).alias("cell"))
        .select(F.xxhash64("anchor", "cell").alias("cell"), F.when(F.col("part") == F.col("cell.x"), 0).otherwise(1).cast("long").alias("side"), "node", "label", *words)
    )

    def compared(held: list[pa.Table]) -> pa.RecordBatch:
        cell, side, node, label, *own = (c.to_numpy() for c in pa.concat_tables(held).columns)
        pairs = node[forest(cell, side, np.stack(own, 1).view(np.uint64), *distances, label=label)].reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of cells that may go on in the next batch, and whole cells before them
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            cell = b.column("cell").to_numpy()
            ends = np.flatnonzero(cell[1:] != cell[:-1])
            if sum(t.num_rows for t in held) >= 1 << 16 and len(ends):
                end = int(ends[-1]) + 1
                yield compared([*held[:-1], held[-1].slice(0, end)])
                held = [held[-1].slice(end)]
        if held:
            yield compared(held)

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "node")
    return dealt.select("cell", "side", "node", "label", *words).mapInArrow(run, "a long, b long").distinct()


def shingle_sets(texts: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """``node, signs``: sorted digests of the distinct word shingles of each whole text of ``node, text`` rows."""

    def run(nodes, texts):
        out = []
        for t in texts:
            w = (t or "").encode().translate(_LOWER).split()
            found = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
            out.append(sorted(xxhash.xxh64_intdigest(x) >> 1 for x in found))
        return {"node": nodes, "signs": out}

    return map_columns(texts.select("node", "text"), run, "node long, signs array<long>")


def sets_of(nodes: DataFrame, own: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The ``shingle_sets`` of the texts ``node``, each read at the least doc_id (``first``) that has it."""
    nodes = cut(own.join(nodes.select("node").distinct(), "node").select(F.col("node").alias("own"), "first"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_node().alias("node"), "text")
    read = texts.join(nodes.hint("shuffle_hash"), (texts["node"] == nodes["own"]) & texts["doc_id"].eqNullSafe(nodes["first"]), "left_semi")
    return cut(shingle_sets(read, words).groupBy("node").agg(F.any_value("signs").alias("signs")))


def checked(found: DataFrame, sets: DataFrame, least: float, jaccard: bool = False) -> DataFrame:
    """The links whose texts have sets of shingles with a cosine (or a Jaccard coefficient) of at least ``least``."""
    left, right = (sets.select(F.col("node").alias(c), F.col("signs").alias(f"{c}_signs")) for c in "ab")
    both = F.size(F.array_intersect("a_signs", "b_signs"))
    n, m = F.size("a_signs").cast("double"), F.size("b_signs").cast("double")
    like = both / (n + m - both) if jaccard else both / F.sqrt(n * m)
    return found.join(left, "a").join(right, "b").where(like >= least).select("a", "b")


def alike(root: np.ndarray, side: np.ndarray, signs: list[np.ndarray], least: float, jaccard: bool = False) -> list[tuple[int, int]]:
    """Index pairs with a cosine (or a Jaccard coefficient) of ``least`` or more that join what ``root`` (an index of a row each) leaves apart.

    Only pairs that links found alike already join are passed over. With two sides only pairs between them count.
    """
    sizes = np.array([len(s) for s in signs])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    code = np.unique(np.concatenate(signs), return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1, bool)
    two = bool(side.any())
    root, out = root.copy(), []
    for i in range(len(signs) - 1):
        later = np.arange(i + 1, len(signs))
        fit = (root[later] != root[i]) & (np.minimum(sizes[later], sizes[i]) >= (least if jaccard else least * least) * np.maximum(sizes[later], sizes[i]))
        if two:
            fit &= side[later] != side[i]
        later = later[fit]
        if not len(later):
            continue
        mine = code[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        if len(later) < 64:
            both = np.array([np.count_nonzero(mark[code[starts[j] : starts[j] + sizes[j]]]) for j in later.tolist()])
        else:
            both = np.add.reduceat(mark[code], starts, dtype=np.int64)[later]
        mark[mine] = False
        against = sizes[later] + sizes[i] - both if jaccard else np.sqrt(sizes[later] * float(sizes[i]))
        for j in later[both >= least * against].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def united(label: DataFrame, found: DataFrame) -> DataFrame:
    """``node, label`` after the links ``a, b`` of ``found``: labels that a link joins become the least of them.

    Only labels that links join are looked at, so that rounds of components run over few rows once groups are formed.
    """
    ends = found.select("a", "b").join(label.withColumnsRenamed({"node": "a", "label": "u"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "v"}), "b")
    roots = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()).withColumnRenamed("node", "label")
    return cut(label.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def compared_in_full(label: DataFrame, found: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float, chunk: int = CHUNK // 2, jaccard: bool = False) -> DataFrame:
    """Checked links ``a, b`` that the candidates ``found`` hide: they span components, so a link that
    fails the check may have stood in for a good one. Labels that such links would join are compared in full, over pairs of chunks.
    """
    ends = found.join(label.withColumnsRenamed({"node": "a", "label": "u"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "v"}), "b").where("u <> v")
    wide = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()).withColumnsRenamed({"node": "label", "root": "wide"})
    apart = cut(label.join(wide, "label").select("node", "wide", F.col("label").alias("root")))
    split = cut(apart.groupBy("wide").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("x"), F.greatest("part", q).alias("y")))
    rows = (
        apart.join(split, "wide")
        .join(sets(apart), "node")
        .withColumn("part", part)
        .select("wide", "node", "root", "signs", "part", F.explode(cells).alias("cell"))
        .select("wide", "cell", F.when(F.col("part") == F.col("cell.x"), 0).otherwise(1).cast("long").alias("side"), "node", "root", "signs")
    )

    def compared(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        side, node, root = (t.column(c).to_numpy() for c in ("side", "node", "root"))
        signs = [x.values.to_numpy() for x in t.column("signs")]
        pairs = node[np.array(alike(np.unique(root, return_inverse=True)[1], side, signs, least, jaccard), np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(1), "b": pairs.max(1)})

    return cut(rows.groupBy("wide", "cell").applyInArrow(compared, "a long, b long").distinct())


def settled(label: DataFrame, found: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float, jaccard: bool = False) -> DataFrame:
    """``node, label`` after all links alike on the whole texts among what the candidates ``found`` reach."""
    sure = cut(checked(found, sets(found.select(F.explode(F.array("a", "b")).alias("node"))), least, jaccard))
    label = united(label, sure)
    more = compared_in_full(label, found.join(sure, ["a", "b"], "left_anti"), sets, least, jaccard=jaccard)
    return label if more.isEmpty() else united(label, more)


def groups(docs: DataFrame, words: int = WORDS, size: int = 1, distances: tuple[int, ...] = (DISTANCE,), least: float | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``; with ``least``, ``near_groups``.

    A fingerprint's node is the least doc_id that has it, or a name over all ids; so a component's root is its id.
    """
    if least is not None:
        return near_groups(docs, words, size, distances, least)
    marked = cut(fingerprints(docs, words, size))
    own = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    own = own.select("fp", F.coalesce("first", F.xxhash64("fp").bitwiseAND(NO_ID - 1) + NO_ID).alias("node"))
    roots = components(links(own, size, distances))
    root = F.coalesce("root", "node")
    named = own.join(roots, "node", "left").select("fp", F.when(root < NO_ID, root).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def near_nodes(docs: DataFrame, words: int, size: int, distances: tuple[int, ...], least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, node, fp`` of every row; ``node, root`` of every distinct text; and ``root, component_id, head`` of every group.

    Every link is checked on the texts, also at equal fingerprints. ``component_id`` and ``head``: the least doc_id of the group,
    nulls last, and of its texts the least name. They are aggregates that combine before the shuffle.
    """
    marked = cut(marks(docs, words, size))
    own = marked.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.min(F.col("fp")[k]).alias(f"w{k}") for k in range(size)))
    own = cut(own.select("node", "first", F.array(*(f"w{k}" for k in range(size))).alias("fp")))
    sets = lambda nodes: sets_of(nodes, own, docs, words)
    label = own.select("node", F.col("node").alias("label"))
    for blocks in (range(FIRST), range(FIRST, BLOCKS)) if size > 1 else (range(BLOCKS),):
        found = cut(links(own.join(label, "node").select("node", "label", "fp"), size, distances, blocks=blocks))
        label = settled(label, found, sets, least)
    named = own.join(label, "node").select("node", "first", F.col("label").alias("root"))
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("least"))
    return marked, named, heads.select("root", F.col("least.first").alias("component_id"), F.col("least.node").alias("head"))


def near_groups(docs: DataFrame, words: int, size: int, distances: tuple[int, ...], least: float) -> DataFrame:
    """``doc_id, fp, component_id`` of every row, from ``near_nodes``."""
    marked, named, heads = near_nodes(docs, words, size, distances, least)
    nodes = named.join(heads, "root").select("node", "component_id")
    return marked.join(nodes, "node").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = NEAR_WORDS, least: float = LEAST) -> DataFrame:
    """One document of each group of near-duplicates, once: the text of its least doc_id, null ids last (of several texts of that id, the one with the least name)."""
    marked, _, heads = near_nodes(docs, words, NEAR_SIZE, (NEAR * 5 // 8, NEAR), least)
    kept_node = cut(heads.select(F.col("component_id").alias("kept_id"), F.col("head").alias("kept_node")))
    of_head = lambda df, doc, node: df.join(kept_node.hint("shuffle_hash"), (node == kept_node["kept_node"]) & doc.eqNullSafe(kept_node["kept_id"]), "left_semi")
    kept = of_head(docs, docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    repeated = of_head(marked, marked["doc_id"], marked["node"]).groupBy("doc_id", "node").count().where("count > 1").limit(1).count()  # equal rows
    if not repeated:
        return kept
    once = kept.withColumn("_kept_text", F.coalesce("text", F.lit("")))  # null counts as empty
    return once.dropDuplicates(["doc_id", "_kept_text"]).drop("_kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text."""
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
