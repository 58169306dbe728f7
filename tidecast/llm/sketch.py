"""Count-min sketches built per partition, merged by slice, read by every task.

A sketch has ``depth`` rows of ``2 ** log_width`` cells; all that is asked of it is
whether a count may be two or more.  A partition puts out, for each slice of the
cell space, the cells it hit once and those it hit again, as gaps; one task merges one
slice, so no task or driver ever holds more than the sketch itself, whose size
is set by ``log_width`` (at most ``MOST_LOG_WIDTH``) and not by the corpus.  Where
a corpus has far more items than cells, such a sketch rules out less: it makes
more work and never a wrong result.  ``CountMin`` is the form that each task keeps
for its own share, and which is sized for it.

Defined results: nulls are not counted; a value met again counts again; an empty
table gives a sketch that holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean

DEPTH = 2
SLICES = 64
MOST_LOG_WIDTH = 27  # two rows of 16 MB as bits
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def log_width_for(items: int) -> int:
    """Eight cells per item and row, within bounds."""
    return int(min(MOST_LOG_WIDTH, max(13, np.ceil(np.log2(8 * max(items, 1))))))


def cells(h: np.ndarray, log_width: int) -> list[np.ndarray]:
    """Per row, the cell of each 64-bit hash."""
    mixed = h ^ (h >> np.uint64(31))
    return [((mixed * odd) >> np.uint64(64 - log_width)).astype(np.int64) for odd in _ODD]


def packed_cells(at: np.ndarray) -> bytes:
    """Ascending cell numbers as gaps of one byte; 255 stands for 255 cells without a hit."""
    gap = np.diff(at, prepend=0)
    out = np.full(len(at) + int((gap // 255).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def unpacked_cells(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, np.uint8)
    return np.cumsum(gap, dtype=np.int64)[gap != 255]


def merged_sketch(
    rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log_width: int, least: int = 2
) -> list[np.ndarray]:
    """Bit per cell: the summed count is ``least`` (1 or 2) or more.  ``hashes`` gives those of a batch."""
    per_slice = (DEPTH << log_width) // SLICES

    @lean
    def partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = DEPTH << log_width
        once, twice = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
        any_hit = False
        for batch in it:
            for h in hashes(batch):
                for row, c in enumerate(cells(h, log_width)):
                    c, n = np.unique(c + (row << log_width), return_counts=True)
                    bit = np.uint8(1) << (c & 7).astype(np.uint8)
                    again = (n > 1) | ((once[c >> 3] & bit) != 0)
                    np.bitwise_or.at(twice, c[again] >> 3, bit[again])
                    np.bitwise_or.at(once, c >> 3, bit)
                    any_hit = any_hit or len(c) > 0
        for s in range(SLICES if any_hit else 0):
            cut = slice(s * per_slice >> 3, (s + 1) * per_slice >> 3)
            hit, more = (np.flatnonzero(np.unpackbits(x[cut], bitorder="little")) for x in (once, twice))
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([packed_cells(hit)], pa.binary()), pa.array([packed_cells(more)], pa.binary())],
                    names=["slice", "hit", "more"],
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(per_slice, bool), np.zeros(per_slice, bool)
        for hit, more in zip(pdf["hit"], pdf["more"]):
            c = unpacked_cells(hit)
            twice[c[once[c]]] = True
            once[c] = True
            twice[unpacked_cells(more)] = True
        bits = np.packbits(twice if least > 1 else once, bitorder="little")
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "bits": [bits.tobytes()]})

    parts = rows.mapInArrow(partition, "slice int, hit binary, more binary")
    merged = parts.groupBy("slice").applyInPandas(merge, "slice int, bits binary")
    bits = np.zeros((DEPTH << log_width) >> 3, np.uint8)
    for r in merged.collect():  # the sketch, of fixed size
        at = r["slice"] * per_slice >> 3
        bits[at : at + (per_slice >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return np.split(bits, DEPTH)


class CountMin:
    """A count-min sketch in memory that tells whether a count may be two or more.

    Cells are two bits, hit once and hit again; a sketch takes what another has
    counted by ``merge``, as if it had counted it itself.
    """

    def __init__(self, log_width: int) -> None:
        self.log_width = log_width
        self.once = np.zeros((DEPTH, 1 << log_width), bool)
        self.again = np.zeros((DEPTH, 1 << log_width), bool)

    def add(self, h: np.ndarray) -> CountMin:
        for row, c in enumerate(cells(h, self.log_width)):
            c, n = np.unique(c, return_counts=True)
            self.again[row, c[(n > 1) | self.once[row, c]]] = True
            self.once[row, c] = True
        return self

    def merge(self, other: CountMin) -> CountMin:
        self.again |= other.again | (self.once & other.once)
        self.once |= other.once
        return self

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Where the estimate is two or more; never false where the true count is."""
        out = np.ones(len(h), bool)
        for row, c in enumerate(cells(h, self.log_width)):
            out &= self.again[row, c]
        return out


def may_hold(bits: list[np.ndarray], h: np.ndarray, log_width: int) -> np.ndarray:
    """Where no row says no."""
    out = np.ones(len(h), bool)
    for row, c in zip(bits, cells(h, log_width)):
        out &= (row[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
    return out


def key_filter(keys: DataFrame, column: str) -> tuple[list[np.ndarray], int]:
    """A filter of bounded size that holds every (non-null) long of ``keys``, and its width."""
    log_width = log_width_for(keys.count())

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    return merged_sketch(keys.select(F.col(column).cast("bigint")), hashes, log_width, least=1), log_width
