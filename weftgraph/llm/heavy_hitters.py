"""Most frequent values by conservative count-min sketches over hash-partitioned value streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH_BITS, HEAP = 4, 16, 1024
PRE_ROWS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class ConservativeSketch:
    """Count-min sketch whose update raises only the cells below the new estimate. Memory: depth x 2^width_bits counters."""

    def __init__(self, depth: int = DEPTH, width_bits: int = WIDTH_BITS):
        if not 1 <= depth <= len(_ODD):
            raise ValueError(f"depth must be 1 to {len(_ODD)}")
        self.cells = np.zeros((depth, 1 << width_bits), dtype=np.int64)
        self.shift = np.uint64(64 - width_bits)

    def _at(self, hashes: np.ndarray) -> list[np.ndarray]:
        h = hashes.view(np.uint64)
        return [((h ^ (h >> np.uint64(29))) * _ODD[d] >> self.shift).astype(np.int64) for d in range(len(self.cells))]

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add distinct values with their counts; returns the new estimates, never below the true counts."""
        at = self._at(hashes)
        est = np.minimum.reduce([row[i] for row, i in zip(self.cells, at)]) + counts
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, est)
        return est


class Heap:
    """The ``size`` values with the largest estimates so far."""

    def __init__(self, size: int):
        self.size, self.best, self.floor = size, {}, 0

    def offer(self, values: np.ndarray, est: np.ndarray) -> None:
        for i in np.flatnonzero(est >= self.floor):
            self.best[values[i]] = int(est[i])
        if len(self.best) > 2 * self.size:
            self.best = dict(heapq.nlargest(self.size, self.best.items(), key=lambda x: (x[1], x[0])))
            self.floor = min(self.best.values())

    def top(self) -> list[tuple[str, int]]:
        return heapq.nlargest(self.size, self.best.items(), key=lambda x: (x[1], x[0]))


def _pre_aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.concat_tables(held).group_by(["field", "value"]).aggregate([("n", "sum")])
            held.clear()
            yield from pa.table({"field": t["field"].combine_chunks(), "value": t["value"].combine_chunks(), "n": t["n_sum"].combine_chunks()}).to_batches()

    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["field", "value"]).aggregate([([], "count_all")])
        held.append(pa.table({"field": t["field"], "value": t["value"], "n": t["count_all"]}))
        if sum(len(x) for x in held) >= PRE_ROWS:
            yield from flush()
    yield from flush()


def _sketch(depth: int, width_bits: int, heap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, ConservativeSketch] = {}
        heaps: dict[str, Heap] = {}
        totals: dict[str, int] = {}
        for b in batches:
            t = b.to_pandas().groupby(["field", "value", "h"], sort=False, as_index=False)["n"].sum()
            for field, g in t.groupby("field", sort=False):
                s = sketches.setdefault(field, ConservativeSketch(depth, width_bits))
                n = g["n"].to_numpy(np.int64)
                est = s.add(np.ascontiguousarray(g["h"].to_numpy(np.int64)), n)
                totals[field] = totals.get(field, 0) + int(n.sum())
                heaps.setdefault(field, Heap(heap)).offer(g["value"].to_numpy(object), est)
        rows = [(f, v, e, 0) for f, x in heaps.items() for v, e in x.top()] + [(f, None, 0, n) for f, n in totals.items()]
        out = pd.DataFrame(rows, columns=["field", "value", "est", "n"]).astype({"est": "int64", "n": "int64"})
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("field", pa.string()), ("value", pa.string()), ("est", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    return run


def heavy_hitters(stream: DataFrame, depth: int = DEPTH, width_bits: int = WIDTH_BITS, heap: int = HEAP) -> DataFrame:
    """(field, value, est_count, total): at most ``heap`` values a field and hash partition, with estimates never below the truth.

    ``stream`` has string columns field and value, one row per occurrence; NULL values are passed over, '' is a value.
    Occurrences are counted per Arrow batch before the shuffle, so one value with a third of all rows reaches its
    partition as a few rows. Each hash partition feeds one conservative sketch a field and a bounded heap; a value lives in
    one partition, so the heaps are disjoint and their union is the answer. A value with more than 1/heap of its partition's
    occurrences cannot be missed: to be thrown out, ``heap`` others need estimates as high. total counts all occurrences of the
    field. Ties are kept by value. No rows give no rows.
    """
    if heap < 1:
        raise ValueError("heap must be at least 1")
    clean = stream.select(F.col("field").cast("string").alias("field"), F.col("value").cast("string").alias("value")).where("field is not null and value is not null")
    counted = clean.mapInArrow(_pre_aggregate, "field string, value string, n long").withColumn("h", F.xxhash64("field", "value"))
    heaps = counted.repartition("h").mapInArrow(_sketch(depth, width_bits, heap), "field string, value string, est long, n long")
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("field"))
    return heaps.withColumn("total", total).where("value is not null").select("field", "value", F.col("est").alias("est_count"), "total")
