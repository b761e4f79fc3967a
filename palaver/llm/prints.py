"""How often numbers of a fixed width occur over a whole table, at two bytes a number.

Tasks sort their numbers and cut them into parts by their upper bits; a part travels as the lower 16 bits of its numbers and
how many there are for each value of the bits between. One shuffle deals the parts, and each is counted where it lands: the
numbers themselves until there are many, then one counter for each value a part can have, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palaver.llm.common import freed

PARTS = 10  # bits that name a part
SPREAD = "part int, starts binary, lows binary"
_LOW = np.uint64(0xFFFF)


def spread(arrays: Iterable[np.ndarray], bits: int, flush: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of SPREAD rows for arrays of ``bits`` wide numbers (uint64), some millions of them at a time."""
    groups, width = 1 << (bits - 16), 1 << (bits - 16 - PARTS)

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(held))
        at = np.searchsorted(x >> np.uint64(16), np.arange(groups + 1, dtype=np.uint64))
        lows = (x & _LOW).astype(np.uint16)
        for first in range(0, groups, width * 64):
            part = [p for p in range(first, first + width * 64, width) if at[p] < at[p + width]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p // width for p in part], pa.int32()), pa.array([np.diff(at[p : p + width + 1]).astype(np.uint32).tobytes() for p in part], pa.binary()), pa.array([lows[at[p] : at[p + width]].tobytes() for p in part], pa.binary())],
                ["part", "starts", "lows"],
            )

    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size >= flush:
            yield from out(held)
            held, size = [], 0
    if size:
        yield from out(held)


def _tally(bits: int, least: int):
    """Of SPREAD rows sorted by part: (number, count) of those that occur ``least`` times and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << (bits - 16 - PARTS)
        now, held, size, counts = None, [], 0, np.zeros(0, dtype=np.int64)

        def fold() -> None:
            nonlocal held, size, counts
            more = np.bincount(np.concatenate(held), minlength=width << 16)
            counts, held, size = (counts + more if len(counts) else more), [np.zeros(0, dtype=np.int64)], 0

        def out() -> pa.RecordBatch:
            if len(counts):
                fold()
                often = np.flatnonzero(counts >= least)
                many = counts[often]
            else:
                often, many = np.unique(np.concatenate(held), return_counts=True)
                often, many = often[many >= least], many[many >= least]
            return pa.RecordBatch.from_arrays([pa.array(often + now * (width << 16)), pa.array(many.astype(np.int64))], ["number", "count"])

        for b in batches:
            for part, starts, lows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, held, size, counts = part, [], 0, np.zeros(0, dtype=np.int64)
                held.append(np.repeat(np.arange(width, dtype=np.int64) << 16, np.frombuffer(starts, dtype=np.uint32)) + np.frombuffer(lows, dtype=np.uint16))
                size += len(held[-1])
                if size > 4_000_000:
                    fold()
        if now is not None:
            yield out()

    return run


def counted(spread_rows: DataFrame, bits: int, least: int) -> DataFrame:
    """(number, count) of the numbers that occur ``least`` times and more."""
    return spread_rows.repartition("part").sortWithinPartitions("part").mapInArrow(freed(_tally(bits, least)), "number long, count long")
