"""Exact pairs of rows by the cosine of their terms, found and scored in cells, so that no pair is written or sent before it is known to count.

The rows of a type are cut into blocks of about CELL rows by their ids; a cell holds two blocks, and every pair of rows meets in
exactly one. The rows are sent once, to the file of their block in the shared folder; a cell reads the files of its two blocks, so what
lies on disk grows with the rows and not with their square. In a cell the terms that most rows have are columns of a dense matrix, whose
product gives their part of all dot products at once; the other terms add theirs by posting lists. Counts of terms are whole numbers, so
the dot products are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldenloom.session import Scratch

#: Rows of a block; partitions over which cells are spread, at least and at most; share of a cell's pairs from which a term is a column, columns at most.
CELL, PARTS, MOST, DENSE, COLUMNS = 16_384, 96, 4_096, 0.0005, 512
#: Cells of the matrix, and steps over posting lists, that are held at a time.
AREA, STEPS = 1 << 21, 1 << 21
#: Half a unit of the fourth place, to which cosines are rounded, and a guard.
SLACK = 6e-5


class Vectors:
    """Counts of the terms of rows."""

    def __init__(self, terms: pa.ListArray):
        n = len(terms)
        size = np.asarray(pc.list_value_length(terms).fill_null(0)).astype(np.int64)
        d = terms.flatten().dictionary_encode()
        self.words = max(len(d.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(n), size) * self.words + np.asarray(d.indices).astype(np.int64), return_counts=True)
        self.row, self.term, self.tf = key // self.words, key % self.words, tf.astype(np.float64)
        self.square = np.bincount(self.row, self.tf * self.tf, n)
        self.norm = np.sqrt(self.square)

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``rows``, term and count of the entries of some rows, in ascending order."""
        place = np.full(len(self.square), -1, np.int64)
        place[rows] = np.arange(len(rows))
        own = np.flatnonzero(place[self.row] >= 0)
        own = own[np.argsort(place[self.row[own]], kind="stable")]
        return place[self.row[own]], self.term[own], self.tf[own]


def near(v: Vectors, left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, dot), p < q, of the pairs of ``left`` and ``right`` (of ``left`` alone if None) whose cosine is ``threshold`` or rounds to it; pairs without a common term are none."""
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):
        return
    kind = np.float32 if v.square.max() < 1 << 24 else np.float64
    (ra, ta, ca), (rb, tb, cb) = v.part(left), v.part(right)
    both = np.bincount(ta, minlength=v.words) * np.bincount(tb, minlength=v.words).astype(np.float64)
    heavy = np.flatnonzero(both >= max(DENSE * len(left) * len(right), 1))
    heavy = heavy[np.argsort(-both[heavy], kind="stable")[:COLUMNS]]
    column = np.full(v.words, -1, np.int64)
    column[heavy] = np.arange(len(heavy))

    def dense(r, t, c, n):
        x, k = np.zeros((n, len(heavy)), kind), column[t] >= 0
        x[r[k], column[t[k]]] = c[k]
        return x, r[~k], t[~k], c[~k].astype(kind)

    x, ra, ta, ca = dense(ra, ta, ca, len(left))
    y, rb, tb, cb = dense(rb, tb, cb, len(right))
    order = np.argsort(tb, kind="stable")
    rb, cb, upto = rb[order], cb[order], np.searchsorted(tb[order], np.arange(v.words + 1))
    least_a, least_b = (v.norm[left] * max(threshold - SLACK, 0.0)).astype(kind), v.norm[right].astype(kind)
    # A square chunk of the lower half is as wide as what follows it.
    rows = max(1, AREA // len(right))
    for c0 in range(0, len(left), rows):
        c1, first = min(c0 + rows, len(left)), c0 if same else 0
        dots = x[c0:c1] @ y[first:].T
        flat = dots.reshape(-1)
        e0, e1 = np.searchsorted(ra, (c0, c1))
        start, count = upto[ta[e0:e1]], upto[ta[e0:e1] + 1] - upto[ta[e0:e1]]
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEPS, "right")))
            n = count[at:to]
            post = np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            j = rb[post] - first
            spot = np.repeat((ra[e0 + at : e0 + to] - c0) * dots.shape[1], n) + j
            add = np.repeat(ca[e0 + at : e0 + to], n) * cb[post]
            ok = j >= 0
            np.add.at(flat, spot[ok], add[ok])
            at = to
        hit = np.flatnonzero(dots >= least_a[c0:c1, None] * least_b[None, first:])
        i, j = np.divmod(hit, dots.shape[1])
        keep = flat[hit] > 0
        if same:
            keep &= j > i
        p, q, dot = left[c0 + i[keep]], right[first + j[keep]], flat[hit[keep]].astype(np.float64)
        yield np.minimum(p, q), np.maximum(p, q), dot


#: Of a cell's rows in the order of their ids, their vectors, and (p, q, dot) of its pairs, makes batches of the result.
Judge = Callable[[pa.Table, Vectors, Iterator], Iterator[pa.RecordBatch]]


def block(path: str, number: int) -> pa.Table | None:
    """The rows of a block that Spark has written in the folder ``path``; None if it has none."""
    files, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    found = files.get_file_info(fs.FileSelector(f"{root}/block={number}", allow_not_found=True))
    own = [pq.read_table(f.path, filesystem=files, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
    return pa.concat_tables(own) if own else None


def pairs(rows: DataFrame, threshold: float, judge: Judge, schema: str) -> DataFrame:
    """What ``judge`` makes of the pairs in each cell of (entity_type, id, terms, ...); with a column ``asks`` of those with a row that asks."""
    scratch = Scratch(rows.sparkSession, "cells")
    kept = scratch.save(rows.where("entity_type IS NOT NULL AND size(terms) > 0"), "rows")
    blocks = kept.groupBy("entity_type").agg(F.ceil(F.count("*") / CELL).cast("bigint").alias("blocks"))
    so_far = Window.orderBy("entity_type")
    blocks = blocks.select("*", F.sum(F.expr("blocks * (blocks + 1) DIV 2")).over(so_far).alias("upto"), (F.sum("blocks").over(so_far) - F.col("blocks")).alias("before"))
    blocks, seen = scratch.save_and(blocks, "types", F.max("upto").alias("cells"), F.sum("blocks").alias("blocks"))
    own = kept.join(F.broadcast(blocks), "entity_type").select(*kept.columns, (F.col("before") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"))
    own.repartitionById(min(max(seen["blocks"] or 0, 1), MOST), F.pmod("block", F.lit(MOST))).write.partitionBy("block").parquet(scratch.path("blocks"))
    scratch.drop("rows")
    path = scratch.qualified("blocks")
    # A task of one cell writes few distinct ids, so a file of its pairs is small.
    parts = min(max(seen["cells"] or 0, PARTS), MOST)
    cells = blocks.withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("j", F.explode(F.expr("sequence(i, blocks - 1)")))
    number = F.expr("upto - 1 - ((blocks - i) * (blocks - i + 1) DIV 2 - 1 - (j - i))")
    cells = cells.select("entity_type", "i", "j", "before", F.pmod(number, F.lit(parts)).cast("int").alias("part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches)).to_pylist()[0]
        both = [block(path, cell["before"] + k) for k in sorted({cell["i"], cell["j"]})]
        # A cell of two blocks of which one is empty has no pairs.
        if any(x is None for x in both):
            return
        table = pa.concat_tables([x.append_column("second", pa.array(np.full(len(x), k > 0))) for k, x in enumerate(both)])
        table = table.sort_by("id").combine_chunks()
        v = Vectors(table["terms"].combine_chunks())
        second = np.asarray(table["second"])
        # Rows of like values follow each other, so their pairs, which are scored together, repeat pairs of values.
        alike = np.arange(len(second))
        if "values" in table.column_names:
            alike = np.asarray(pc.array_sort_indices(pc.binary_join(table["values"].combine_chunks(), " "))).astype(np.int64)
        asks = np.asarray(table["asks"]) if "asks" in table.column_names else np.ones(len(second), bool)
        a, b = alike[~second[alike]], alike[second[alike]]
        parts = [(a[asks[a]], b), (a[~asks[a]], b[asks[b]])] if len(b) else [(a[asks[a]], None), (a[asks[a]], a[~asks[a]])]
        yield from judge(table, v, (x for left, right in parts for x in near(v, left, right, threshold)))

    return cells.repartitionById(parts, "part").groupBy("part", "entity_type", "i", "j").applyInArrow(meet, schema)
