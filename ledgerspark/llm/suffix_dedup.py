"""Suffix-array dedup: remove repeated byte strings of ``LENGTH`` = 100 or more bytes across and within documents.

A byte goes if a 100-byte string that also starts earlier (smaller doc_id, or the same document and an earlier start) covers it.

Suffixes are taken at content-defined places only: in each 100-byte string the place whose leading ``LEAD`` = 16 bytes have the least
digest, so equal strings name equal places and no repeat is missed, with one suffix in about forty bytes. A suffix is
a record of its leading bytes as two words of text, of 128 bits of digest of the stretch it stands for (all strings that name it:
the bytes that equal neighbours in a suffix array would be compared over) and of its place.

1. Each task hands on the first of each stretch of its documents; the others are repeats already. So the most frequent
   passage sends one record per task.
2. Splitters, quantiles over a sample of documents of the leading bytes in text order (then of digests, where a lead is so
   frequent that it spans buckets), range-partition the suffixes into buckets of bounded size. Each bucket is put
   in order by a multikey quicksort over the words and read along: equal stretches after the first are repeats. A
   lead with several different stretches is open: strings may agree in part of them. Such a string reaches half of what
   it has beside the lead to the left or to the right, so only suffixes that share one of those two neighbourhoods, by short
   digests (``more``), with another stretch stay open, and only for the strings on that side. Equal stretches never
   lie on two sides of a border; a lead that does is compared across it by staying open as a whole.
3. For open suffixes their single strings go the same way, bucketed by digest, and the first of each stays.
4. The repeats of each document meet its text, and their union is cut out.

Digests that decide have 128 bits; the bytes left and right of a lead only narrow what step 3 looks at. Text travels twice (3 and 4), never in step 2.

Defined cases: a null text counts as empty; texts under 100 bytes keep all. A null doc_id comes after all others. Rows of
one doc_id are one document: repeated rows get equal values, each start counting once; rows with different
texts are told apart by a digest of the text. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, table

LENGTH, LEAD = 100, 16
#: Documents looked at for the splitters: a share that gives about this many, and of each so many suffixes, spread over its whole text.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 2000, 256
#: Rows a bucket should hold; there are at least two buckets for each shuffle partition.
BUCKET_ROWS = 1 << 20
#: Bytes of text whose suffixes a task holds before it hands them on.
HELD_BYTES = 32 << 20
_PART = 1 << 20  # start of a place within this many bytes, so that a digest and a place share a word
_U = np.uint64
_NULL_ID = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(29))


def _doubled(one: np.ndarray, width: int, join: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """``join`` over every run of ``width`` items, in about log2(width) passes; join(a, b, length of b)."""
    out, have, power, span = None, 0, one, 1
    while True:
        if width & 1:
            if out is None:
                out, have = power, span
            else:
                n = len(one) - have - span + 1
                out, have = join(out[:n], power[have : have + n], span), have + span
        width >>= 1
        if not width:
            return out
        n = len(power) - span
        power, span = join(power[:n], power[span : span + n], span), span * 2


def _powers() -> dict[int, np.uint64]:
    out, base = {}, 0xD6E8FEB86659FD93
    for k in range(16):
        out[1 << k] = _U(base)
        base = base * base % (1 << 64)
    return out


_POWER = _powers()


def suffixes(raw: bytes, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Place, first and last string start and ``more`` of each suffix of a text, in order; they cover all starts.

    ``more``: from the low bits 24 each of the digests of the lead with the bytes right and left of it (0 where
    the text ends before), then 7 each of the number of strings and of how far the suffix is from its first string.
    """
    places, firsts, lasts, mores = [], [], [], []
    half = (length - lead) // 2
    step = _PART - length
    with np.errstate(over="ignore"):
        for base in range(0, max(len(raw) - length + 1, 0), step):
            part = np.frombuffer(raw, np.uint8, min(step + length - 1, len(raw) - base), base)
            x = (part.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
            x ^= x >> _U(29)
            h = _mixed(_doubled(x, lead, lambda a, b, n: a * _POWER[n] + b))
            ranked = (h >> _U(20) << _U(20)) | np.arange(len(h), dtype=_U)
            least = _doubled(ranked, length - lead + 1, lambda a, b, n: np.minimum(a, b))
            place = (least & _U(_PART - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            at, last = place[first], np.append(first[1:], len(place)) - 1
            wide = _mixed(_doubled(x, lead + half, lambda a, b, n: a * _POWER[n] + b)) >> _U(40) | _U(1)
            left = np.where(at >= half, wide[np.maximum(at - half, 0)], _U(0))
            right = np.where(at < len(wide), wide[np.minimum(at, len(wide) - 1)], _U(0))
            mores.append((at - first).astype(_U) << _U(55) | (last - first + 1).astype(_U) << _U(48) | left << _U(24) | right)
            places.append(at + base)
            firsts.append(first + base)
            lasts.append(last + base)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(mores)


def lead_words(raw: bytes, at: np.ndarray, lead: int = LEAD) -> list[np.ndarray]:
    """The leading bytes at the places as two words in text order, 16 bytes at most; bytes after the lead are zeros."""
    view = np.ndarray((len(raw) + 1,), ">u8", raw + bytes(8), strides=(1,))
    gone = [8 * min(8, max(0, 8 + k - lead)) for k in (0, 8)]
    return [view[np.minimum(at + k, len(raw))].astype(_U) & _U(((1 << 64) - (1 << g)) & ((1 << 64) - 1)) for k, g in zip((0, 8), gone)]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """128 bits of digest of each part of a text, as two words."""
    view, digest = memoryview(raw), xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), _U).reshape(-1, 2)
    return [found[:, 0], found[:, 1]]


def multikey_order(words: np.ndarray, small: int = 32) -> np.ndarray:
    """The order of rows by their words (one column each), by multikey quicksort.

    Every part is split in three at a pivot of the word at its depth: lesser and greater rows are split again at that word, equal
    ones at the next. All parts of a round are split at once by whole arrays; parts of up to ``small`` rows are put in order at the end.
    """
    n, depths_in_all = words.shape
    order = np.arange(n)
    at = np.arange(n)  # the places in ``order`` of the parts at hand, one part after the other
    size, depth = np.array([n]), np.zeros(1, np.int64)
    little: list[tuple[np.ndarray, np.ndarray]] = []
    parts = 0
    while len(at):
        few = size <= small
        if few.any():
            mask = np.repeat(few, size)
            little.append((at[mask], parts + np.repeat(np.arange(few.sum()), size[few])))
            parts += int(few.sum())
            at, size, depth = at[~mask], size[~few], depth[~few]
            if not len(at):
                break
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        row = order[at]
        key = words[row, depth[part]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        less, equal = key < pivot, key == pivot
        kinds = [less, equal, ~(less | equal)]
        counts = np.stack([np.add.reduceat(k, first, dtype=np.int64) for k in kinds], 1)
        base = first[:, None] + np.cumsum(counts, 1) - counts  # where each kind of each part begins
        to = np.empty(len(at), np.int64)
        for k, kind in enumerate(kinds):
            seen = np.cumsum(counts[:, k]) - counts[:, k]
            own = part[kind]
            to[kind] = base[own, k] + np.arange(len(own)) - seen[own]
        moved = np.empty_like(row)
        moved[to] = row
        order[at] = moved
        deeper = np.stack([depth, depth + 1, depth], 1).ravel()
        size = counts.ravel()
        go = (size > 1) & (deeper < depths_in_all)
        at, size, depth = at[np.repeat(go, size)], size[go], deeper[go]
    if little:
        at, part = (np.concatenate(c) for c in zip(*little))
        row = order[at]
        order[at] = row[np.lexsort((*(words[row, k] for k in range(depths_in_all - 1, -1, -1)), part))]
    return order


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as sorted maximal runs; spans that touch are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _doc_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``doc`` and ``tag``: what tells a document apart, and how documents are ordered."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag")]


#: Found spans: repeats, or starts of strings that step 3 is to look at (``open``).
_SPAN = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc", "tag", "start", "end")), T.StructField("open", T.BooleanType())])
_SUFFIX = ("w0", "w1", "d0", "d1", "doc", "tag", "start", "more")
_STRING = ("d0", "d1", "doc", "tag", "start")


def _longs(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before in any of the columns; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, open_: bool = False) -> Iterator[pa.RecordBatch]:
    """Spans, those of repeats merged per document."""
    if not len(doc):
        return
    if not open_:
        order = np.lexsort((start, tag, doc))
        doc, tag, start, end = (c[order] for c in (doc, tag, start, end))
        owner = np.cumsum(_changes(doc, tag)) - 1
        # owners lie one after the other on one line, so that one pass merges all
        shift = owner * (int(end.max()) + 2)
        s, e = merged(start + shift, end + shift)
        own = owner[np.searchsorted(start + shift, s)]
        heads = np.flatnonzero(_changes(owner))
        doc, tag, start, end = doc[heads][own], tag[heads][own], s - own * (int(end.max()) + 2), e - own * (int(end.max()) + 2)
    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in (doc, tag, start, end)), pa.array(np.full(len(doc), open_))], names=_SPAN.names)


class _Places:
    """Records of one task, handed on as the first of each equal stretch; the others are spans without digests."""

    def __init__(self, names: tuple[str, ...], length: int) -> None:
        self.names, self.length = names, length
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        cols = dict(zip(self.names, (np.concatenate(c) for c in zip(*self.parts))))
        self.parts, self.size = [], 0
        order = np.argsort(cols["d0"])
        new = _changes(cols["d0"][order])
        several = ~(new & np.append(new[1:], True))
        yield from self._records({n: c[order[~several]] for n, c in cols.items()})
        cols = {n: c[order[several]] for n, c in cols.items()}
        order = np.lexsort(tuple(cols[n] for n in ("tag", "start", "doc", "d1", "d0")))
        cols = {n: c[order] for n, c in cols.items()}
        new = _changes(cols["d0"], cols["d1"])
        repeat = ~new & _changes(cols["doc"], cols["start"], cols["tag"])
        yield from self._records({n: c[new] for n, c in cols.items()})
        for b in _spans(*(c[repeat] for c in (cols["doc"], cols["tag"], cols["start"], _ends(cols, self.length)))):
            none = pa.nulls(b.num_rows, pa.int64())
            known = dict(zip(("doc", "tag", "start", "d1"), b.columns))
            yield pa.RecordBatch.from_arrays([known.get(n, none) for n in self.names], names=self.names)

    def _records(self, cols: dict[str, np.ndarray], at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(cols["doc"]), at_once):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + at_once].view(np.int64)) for c in cols.values()], names=self.names)


def _ends(cols: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Where the stretches end."""
    strings = (cols["more"].astype(_U) >> _U(48) & _U(127)).astype(np.int64) if "more" in cols else 1
    return cols["start"] + strings - 1 + length


def _composite(w0: np.ndarray, w1: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """Keys that are ordered as the three words."""
    return np.stack([c.view(_U) for c in (w0, w1, d0)], 1).astype(">u8").view("S24")[:, 0]


def splitters(docs: DataFrame, partitions: int, length: int, lead: int) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """Bounds of the buckets as composite keys, and the leads that span buckets (each holds a bucket's worth of suffixes or more)."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    sample = docs.sample(share, seed=7).select("text")
    names = ("w0", "w1", "d0", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                raw = (text or "").encode()
                at, first, last, _ = suffixes(raw, length, lead)
                took = np.unique(np.linspace(0, len(at) - 1, min(len(at), SAMPLE_SUFFIXES)).astype(np.int64)) if len(at) else np.empty(0, np.int64)
                keys = [*lead_words(raw, at[took], lead), digests(raw, first[took], last[took] + length)[0]]
                weight = np.full(len(took), len(at) * 1000 // max(len(took), 1))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (*keys, weight)], names=names)

    found = sample.mapInArrow(run, _longs(names)).toArrow()  # at most SAMPLE_DOCS times SAMPLE_SUFFIXES rows or so
    w0, w1, d0, weight = (found.column(n).to_numpy() for n in names)
    buckets = max(2 * partitions, int(weight.sum() / 1000 / share) // BUCKET_ROWS + 1)
    key = _composite(w0, w1, d0)
    order = np.argsort(key)
    upto = np.cumsum(weight[order])
    at = order[np.unique(np.searchsorted(upto, (np.arange(1, buckets) * (int(upto[-1]) if len(upto) else 0)) // buckets))] if len(order) else order
    leads: dict[tuple[int, int], list[int]] = {}
    for k in at.tolist():
        leads.setdefault((int(w0[k]), int(w1[k])), []).append(k)
    whole = np.array([k == own[0] for own in leads.values() for k in own], bool)
    bounds = _composite(w0[at], w1[at], np.where(whole, 0, d0[at])) if len(at) else key[:0]
    return np.unique(bounds), {lead for lead, own in leads.items() if len(own) > 1}


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int, place: Callable[[dict], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Records with their bucket; spans that are known already are dealt by document."""
    for b in batches:
        cols = dict(zip(b.schema.names, b.columns))
        spot = cols["doc"].to_numpy() % buckets if cols["d0"].null_count else place({n: c.to_numpy() for n, c in cols.items()})
        yield pa.RecordBatch.from_arrays([pa.array(spot.astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])


def _dealt(docs: DataFrame, run: Callable, names: tuple[str, ...], buckets: int, place: Callable[[dict], np.ndarray]) -> DataFrame:
    kind = T.StructType([T.StructField("bucket", T.IntegerType()), *_longs(names).fields])
    return docs.mapInArrow(lambda batches: _bucketed(run(batches), buckets, place), kind).repartitionById(buckets, F.col("bucket")).drop("bucket")


def suffix_records(docs: DataFrame, bounds: np.ndarray, length: int, lead: int) -> DataFrame:
    """Step 1: the suffix records of ``doc, tag, text`` rows in their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(_SUFFIX, length)
        for b in slices(batches):
            for doc, tag, text in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode()
                if len(raw) < length:
                    continue
                at, first, last, more = suffixes(raw, length, lead)
                places.add(*lead_words(raw, at, lead), *digests(raw, first, last + length), np.full(len(at), doc), np.full(len(at), tag), first, more)
                places.size += len(raw)
                if places.size >= HELD_BYTES:
                    yield from places.flush()
        yield from places.flush()

    return _dealt(docs, run, _SUFFIX, len(bounds) + 1, lambda c: np.searchsorted(bounds, _composite(c["w0"], c["w1"], c["d0"]), "right"))


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same non-zero side."""
    order = np.lexsort((side, group))
    run = np.cumsum(_changes(group[order], side[order])) - 1
    out = np.empty(len(side), bool)
    out[order] = np.bincount(run)[run] > 1
    return out & (side != 0)


def compared(records: DataFrame, names: tuple[str, ...], length: int, half: int | None = None, crossing: set[tuple[int, int]] = frozenset()) -> DataFrame:
    """Step 2: the repeats among the records of each bucket, and, if ``half`` is given, the open suffixes.

    A bucket is a partition; it is put in order by a multikey quicksort over the words of its records, rows that are equal in all by place.
    """
    words = [n for n in names if n in ("w0", "w1", "d0", "d1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if b.num_rows:
                known = b.column("d0").is_null()
                if b.column("d0").null_count:
                    k = b.filter(known)
                    yield pa.RecordBatch.from_arrays([k.column("doc"), k.column("tag"), k.column("start"), k.column("d1"), pa.array(np.zeros(k.num_rows, bool))], names=_SPAN.names)
                    b = b.filter(b.column("d0").is_valid())
                held.append(b)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        cols = {n: t.column(n).to_numpy() for n in names}
        del held, t
        order = multikey_order(np.stack([cols[n].view(_U) for n in words], 1))
        cols = {n: c[order] for n, c in cols.items()}
        new = _changes(*(cols[n] for n in words))
        several = np.flatnonzero(~(new & np.append(new[1:], True)))
        run_of = np.cumsum(new)
        order = several[np.lexsort((cols["tag"][several], cols["start"][several], cols["doc"][several], run_of[several]))]
        for n, c in cols.items():
            c[several] = c[order]
        doc, tag, start, end = cols["doc"], cols["tag"], cols["start"], _ends(cols, length)
        repeat = ~new & _changes(doc, start, tag)
        yield from _spans(doc[repeat], tag[repeat], start[repeat], end[repeat])
        if half is None:
            return
        new_lead = _changes(cols["w0"], cols["w1"])
        group = np.cumsum(new_lead) - 1
        across = np.zeros(len(group), bool)
        if crossing:
            across = np.array([lead in crossing for lead in zip(cols["w0"][new_lead].tolist(), cols["w1"][new_lead].tolist())])[group]
        go = new & ((np.bincount(group, new)[group] > 1) | across)
        group, across, doc, tag, start, end, more = (c[go] for c in (group, across, doc, tag, start, end, cols["more"]))
        if not len(group):
            return
        bits = (1 << 24) - 1
        left, right = _shared(group, more >> 24 & bits) | across, _shared(group, more & bits) | across
        border = start + (more >> 55) - half  # strings that start up to here reach half to the left
        start = np.where(left, start, np.maximum(start, border + 1))
        end = np.where(right, end, np.minimum(end, border + length))
        go = (left | right) & (end - start >= length)
        yield from _spans(doc[go], tag[go], start[go], end[go], True)

    return records.mapInArrow(run, _SPAN)


def string_records(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 3: a record for each single string of the open suffixes ``spans`` of ``doc, tag, text, spans`` rows, bucketed by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(_STRING, length)
        for b in slices(batches):
            for doc, tag, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode()
                at = np.unique(np.concatenate([np.arange(s["start"], s["end"] - length + 1) for s in spans]))
                places.add(*digests(raw, at, at + length), np.full(len(at), doc), np.full(len(at), tag), at)
                places.size += 30 * len(at)
                if places.size >= HELD_BYTES:
                    yield from places.flush()
        yield from places.flush()

    return _dealt(docs, run, _STRING, buckets, lambda c: (c["d0"].view(_U) % _U(buckets)).astype(np.int64))


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most the places of one text


def repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """``doc, tag, start, end``: byte spans whose union per document is what goes."""
    rows = docs.select(*_doc_keys(), "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, crossing = splitters(docs, partitions, length, lead)
    found = cut(compared(suffix_records(rows, bounds, length, lead), _SUFFIX, length, (length - lead) // 2, crossing))
    strings = found.where("open").agg(F.sum(F.col("end") - F.col("start") - length + 1)).first()[0] or 0
    open_ = rows.join(_gathered(found.where("open")), ["doc", "tag"]).select("doc", "tag", "text", "spans")
    partly = compared(string_records(open_, length, max(2 * partitions, strings // BUCKET_ROWS + 1)), _STRING, length)
    return cut(found.where("not open").unionByName(partly).select("doc", "tag", "start", "end"))


def deduplicated(docs: DataFrame, finish: Callable[[bytes, bytes, int], dict], kind: T.StructType, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """The columns of ``docs`` but ``text``, and what ``finish`` (text, kept bytes, number of runs) gives for each row."""
    gone = _gathered(repeats(docs, length, lead))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text", *_doc_keys())
    joined = rows.join(gone, ["doc", "tag"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode()
                s, e = merged(np.array([x["start"] for x in spans or []], np.int64), np.array([x["end"] for x in spans or []], np.int64))
                kept = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)])) if len(s) else raw
                out.append(finish(raw, kept, len(s)))
            made = pa.Table.from_pylist(out, schema=arrow)
            yield pa.RecordBatch.from_arrays([b.column(0), *(c.combine_chunks() for c in made.columns)], names=["row", *kind.names])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    whole = T.StructType([joined.schema["row"], *kind.fields])
    return joined.mapInArrow(run, whole).select(*(F.col("row")[c].alias(c) for c in others), *kind.names)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars`` after it); a character that loses some of its bytes goes whole."""

    def finish(raw: bytes, kept: bytes, runs: int) -> dict:
        return {"text": kept.decode(errors="ignore")}

    found = deduplicated(docs, finish, T.StructType([T.StructField("text", T.StringType())])).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes and what stays of every whole text."""

    def finish(raw: bytes, kept: bytes, runs: int) -> dict:
        return {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()}

    kind = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), finish, kind)


#: All 100-byte strings of all documents, by digest; the first of each stays, the union of the others goes.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM strings) WHERE k > 1),
marked AS (SELECT doc_id, p, coalesce(p - lag(p) OVER w > 100, true)::INT AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k),
pieces AS (SELECT r.doc_id, s, e, substr(h, 2 * lag(e, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY s) + 1, 2 * (s - lag(e, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY s))) AS before FROM runs r JOIN d USING (doc_id)),
cut AS (SELECT doc_id, string_agg(before, '' ORDER BY s) AS kept, max(e) AS last, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""
