"""Packing along a space-filling curve.

Every document is tokenised once. Its token counts are hashed to signed buckets (a hashed
document vector), which a fixed random projection takes to few dimensions; as both maps are
linear, one table with a row per token id does both. The coordinates are scaled by the mean and
spread over all documents, turned into grid cells and into the key of the cell on a Hilbert
curve. The documents are range-partitioned and sorted by (key, id), so neighbours on the curve lie
side by side, and each partition is cut into full sequences in one streaming pass. The rest of a
partition is cut into sequences whose lengths are powers of two, so no token of padding is needed.

The range is dealt by key and id together: a third of all documents with one key (copies) still
spreads over many partitions.

Defined results: a null or empty text has only the end id; repeated ids and rows are packed each
on their own; a very long text is cut over as many sequences as it fills; equal keys go by id; an empty table
gives an empty result; other columns are left aside. The vectors of empty texts are zero.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import materialize, small_batches

#: Buckets of the hashed vectors, projected dimensions and bits of a grid coordinate.
BUCKETS, DIMENSIONS, BITS = 1_024, 3, 10


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, by its vocabulary as ranks.

    The file's added tokens are matched in the text first, as that library does; between them the
    text is encoded by the same pattern and merges in the faster implementation. Tests compare the
    ids of both.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as text:
            added = {x["content"]: x["id"] for x in json.load(text)["added_tokens"]}
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = frozenset(added)

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special=self.added, disallowed_special=())


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def encoder(*paths: str) -> Encoder:
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def projection(size: int, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For each id its signed bucket's row of a Gaussian projection."""
    ids = np.arange(size, dtype=np.uint64)
    h = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    rows = np.random.Generator(np.random.PCG64(7)).standard_normal((buckets, dimensions))
    sign = np.where((h >> np.uint64(63)).astype(bool), 1.0, -1.0)
    return rows[(h % np.uint64(buckets)).astype(np.int64)] * sign[:, None]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates below 2**bits.

    Works from the highest bit down: where a coordinate's bit is set, the lower bits of the first
    coordinate are mirrored, else they are exchanged with that coordinate's; the transposed
    coordinates are then Gray-decoded and their bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            is_set = (x[i] & q) != 0
            exchanged = (x[0] ^ x[i]) & low
            x[0] ^= np.where(is_set, low, exchanged)
            if i:
                x[i] ^= np.where(is_set, 0, exchanged)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenize(docs: DataFrame, paths: tuple[str, str, str], end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, ids binary (little-endian; uint16 where the vocabulary allows, else uint32), x array<double>."""
    names = [id_col, "n_tokens", "ids", "x"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(*paths)
        table = projection(enc.size)
        kind = _kind(enc.size)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, held, lo = [], 0, 0
            for i in range(batch.num_rows):
                ids = enc.ids(texts[i].as_py() or "")
                x = (table[ids].sum(0) / len(ids) if ids else np.zeros(DIMENSIONS)).tolist()
                data = np.array([*ids, end_id], dtype=kind).tobytes()
                rows.append((len(ids) + 1, data, x))
                held += len(data)
                if held > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))], names=names)
                    rows, held, lo = [], 0, i + 1

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"{id_col} long, n_tokens long, ids binary, x array<double>"
    )


def _kind(size: int) -> str:
    return "<u2" if size <= 65_536 else "<u4"


def cuts(total: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the sequences of a run of tokens: full ones, then powers of two."""
    at = 0
    while total - at >= length:
        yield at, length
        at += length
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        yield at, size
        at += size


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    end_id: int = 1,
    length: int = 2_048,
    id_col: str = "doc_id",
    text_col: str = "text",
    partition_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    id, curve_key, start (its document's ids before it), length, ids binary (little-endian uint32),
    doc_tokens, sequence_id, offset (in the sequence, gapless from 0), sequence_length.
    The tokenised documents are written once to the shared folder; the only shuffle carries their
    compact ids. Partitions hold about ``partition_bytes`` of ids each, whatever the input's size.
    """
    small_batches(docs.sparkSession)
    paths = (json_path, ranks_path, pattern)
    tokens = materialize(tokenize(docs, paths, end_id, id_col, text_col), "packing-tokens")
    totals = tokens.agg(
        F.sum(F.octet_length("ids")).alias("bytes"),
        *(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("mean", F.avg), ("spread", F.stddev_pop))),
    ).first()
    means = [totals[f"mean{i}"] or 0.0 for i in range(DIMENSIONS)]
    spreads = [totals[f"spread{i}"] or 1.0 for i in range(DIMENSIONS)]
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(default, -(-(totals["bytes"] or 0) // partition_bytes))
    top = (1 << BITS) - 1

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.frombuffer(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, DIMENSIONS)
            # the logistic curve is close to the normal distribution function and spreads the cells evenly
            even = 1 / (1 + np.exp(-1.702 * np.clip((x - means) / spreads, -30, 30)))
            keys = hilbert_keys(np.minimum((even * (top + 1)).astype(np.int64), top), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns[:3]], names=["curve_key", id_col, "n_tokens", "ids"])

    ordered = (
        tokens.mapInArrow(keyed, f"curve_key long, {id_col} long, n_tokens long, ids binary")
        .repartitionByRange(int(partitions), "curve_key", id_col)
        .sortWithinPartitions("curve_key", id_col, "n_tokens", "ids")
        .withColumn("part", F.spark_partition_id())
    )
    wide = encoder(*paths).size > 65_536
    kind = "<u4" if wide else "<u2"
    names = [id_col, "curve_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def fill(batches: Iterator[pa.RecordBatch]):
        """Streams a partition: ``held`` are the pieces of the sequence that is being filled."""
        held: list[tuple] = []
        used, number = 0, 0
        out: list[tuple] = []
        part = 0

        def emit(at: int, size: int) -> None:
            nonlocal number
            sequence = (part << 36) | number
            number += 1
            lo = 0
            for doc, key, start, ids, whole in held:
                a, b = max(lo, at), min(lo + len(ids), at + size)
                if a < b:
                    piece = ids[a - lo : b - lo].astype("<u4").tobytes()
                    out.append((doc, key, start + a - lo, b - a, piece, whole, sequence, a - at, size))
                lo += len(ids)

        def flush():
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for key, doc, whole, data, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B020
                ids = np.frombuffer(data, kind)
                at = 0
                while at < len(ids):
                    took = ids[at : at + length - used]
                    held.append((doc, key, at, took, whole))
                    used += len(took)
                    at += len(took)
                    if used == length:
                        emit(0, length)
                        held, used = [], 0
                if len(out) >= 4_000:
                    yield flush()
        for at, size in cuts(used, length):
            emit(at, size)
        if out:
            yield flush()

    return ordered.mapInArrow(
        fill,
        f"{id_col} long, curve_key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long",
    )


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ids_crc32 (of their little-endian unsigned 32-bit ids) in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "curve_key")


def checksum(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
