"""Pairs of rows that share a key and may be alike, without the pairs of a group.

Rows name a ``node``, the ``label`` of what it is joined with already, and a sketch in words of 64 bits. Keys that only rows of one label have are
dropped by an aggregate. The others are brought together, those of more than ``chunk`` rows over pairs of chunks, and sketches compared by
a test that never refuses what is alike. ``spanning`` pairs join what may be alike within a key by one pair a row at most; else every pair of two labels
that passes is given, from one pass per lag over all keys at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK = 2048


def met(cell: np.ndarray, side: np.ndarray, label: np.ndarray, sketch: np.ndarray, fits: Callable, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs, lag by lag. Rows come sorted by cell; in a cell with two sides only pairs between them count."""
    n = len(cell)
    order = np.lexsort((label, cell))
    new = np.concatenate(([True], (cell[order][1:] != cell[order][:-1]) | (label[order][1:] != label[order][:-1])))
    root = np.empty(n, np.int64)
    root[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    two = np.repeat(np.maximum.reduceat(side, starts) > 0, np.diff(np.append(starts, n)))
    if not spanning:
        left, lag = np.arange(n), 0
        while len(left):
            lag += 1
            left = left[left + lag < n]
            left = left[cell[left] == cell[left + lag]]
            fit = left[(root[left] != root[left + lag]) & ((side[left] != side[left + lag]) | ~two[left])]
            fit = fit[fits(sketch[fit], sketch[fit + lag])]
            yield fit, fit + lag
        return

    def joined(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = (root[i] != root[j]) & ((side[i] != side[j]) | ~two[i])
        i, j = i[fit], j[fit]
        fit = fits(sketch[i], sketch[j])
        kept = []
        for k, (a, b) in enumerate(zip(i[fit].tolist(), j[fit].tolist())):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(k)
        if kept:
            while (root[root] != root).any():
                root[:] = root[root]
        return i[fit][kept], j[fit][kept]

    # with the first row of each cell before all others: cells of one group so give the same pairs
    yield joined(np.repeat(starts, np.diff(np.append(starts, n))), np.arange(n))
    left, lag = np.arange(n), 0
    while len(left):
        lag += 1
        left = left[left + lag < n]
        left = left[cell[left] == cell[left + lag]]
        yield joined(left, left + lag)


def pairs(rows: DataFrame, sketches: DataFrame, fits: Callable, spanning: bool, chunk: int = CHUNK, order: str = "node") -> DataFrame:
    """Distinct ``a, b`` (a < b) of the nodes of ``rows`` (``key, node, label``; read twice) of two labels that share a key and fit.

    ``sketches`` has a row of ``node`` and words for each node; they join only what keys of two labels leave.
    """
    words = [c for c in sketches.columns if c != "node"]
    counts = rows.groupBy("key").agg(F.count("*").alias("_n"), (F.min("label") < F.max("label")).alias("_two")).where("_two")
    parts = counts.select("key", F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("node"), "_parts").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda q: F.struct(F.least("_part", q).alias("x"), F.greatest("_part", q).alias("y")))
    dealt = rows.join(parts, "key").join(sketches, "node").withColumn("_part", part).select("*", F.explode(cells).alias("_cell"))
    dealt = dealt.select(F.xxhash64("key", "_cell").alias("cell"), F.when(F.col("_part") == F.col("_cell.x"), 0).otherwise(1).cast("long").alias("side"), "node", "label", *words)

    def compared(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        cell, side, node, label, *own = (c.to_numpy() for c in pa.concat_tables(held).columns)
        for i, j in met(cell, side, label, np.stack(own, 1), fits, spanning):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of a cell that may go on in the next batch, and whole cells before it
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            cell = b.column("cell").to_numpy()
            ends = np.flatnonzero(cell[1:] != cell[:-1])
            if sum(t.num_rows for t in held) >= 1 << 16 and len(ends):
                end = int(ends[-1]) + 1
                yield from compared([*held[:-1], held[-1].slice(0, end)])
                held = [held[-1].slice(end)]
        if held:
            yield from compared(held)

    sorted_ = dealt.repartition("cell").sortWithinPartitions("cell", F.expr(order))
    return cut(sorted_.select("cell", "side", "node", "label", *words).mapInArrow(run, "a long, b long").distinct())
