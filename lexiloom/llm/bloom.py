"""Bloom filters of long columns, sized by their count, to leave most rows of another table out of a join.

A filter only saves work: whatever passes wrongly finds no partner in the exact join after it. It has BITS_PER_ID
bits an id, up to 2**MOST_BITS (64 MiB); beyond that more rows pass and the exact join does more of the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.vectext import U64, mix

BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 16, 29


class Bloom:
    """A filter of 2**bits bits as uint64 words; it travels as a broadcast."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def passing(self, ids: np.ndarray) -> np.ndarray:
        first, second = _places(ids, self.bits)
        return self._set(first) & self._set(second)

    def _set(self, places: np.ndarray) -> np.ndarray:
        return ((self.words[places >> 6] >> (places & 63).astype(U64)) & U64(1)).astype(bool)


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.ascontiguousarray(ids).view(U64) + U64(0x2545F491))
    shift = U64(64 - bits)
    return (h >> shift).astype(np.int64), ((h * U64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)


def bloom(ids: DataFrame) -> Bloom:
    """The filter of a table of one column of longs without nulls."""
    bits = min(max((BITS_PER_ID * ids.count() - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(1 << bits >> 6, U64)
        for batch in batches:
            for places in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(held, places >> 6, U64(1) << (places & 63).astype(U64))
        words = held.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used], pa.int64())], names=["place", "word"])

    got = ids.mapInArrow(run, "place long, word long").groupBy("place").agg({"word": "bit_or"}).toArrow()
    words = np.zeros(1 << bits >> 6, np.int64)
    words[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return Bloom(words.view(U64), bits)


def marked(rows: DataFrame, id_col: str, wanted: Bloom, mark: str = "_passes") -> DataFrame:
    """``rows`` with whether their ids pass the filter; a null id does not."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    at = rows.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(at)
            passes = sent.value.passing(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passes)], names=[*batch.schema.names, mark])

    return rows.mapInArrow(run, rows.withColumn(mark, F.lit(True)).schema)
