"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap by a margin. Every chunk is pre-tokenised on its own, so
the chunks of one very long text run in different tasks. The split pattern only looks forward:
from a true pre-token boundary on, a chunk yields exactly the boundaries of the whole text, as
far as its own end does not interfere. Neighbouring chunks are therefore stitched at the first
boundary that both have inside their overlap (where they resynchronise). If they have none
there (one pre-token longer than the overlap), the later chunk is pre-tokenised again from the
last sure boundary of the earlier one, so the stitched boundaries are always exact. The stitched
text is then cut into pieces at pre-token boundaries; pieces are encoded independently, and
their ids concatenate to the ids of the text. Decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty and has no ids; an empty table gives an empty
result; repeated rows are encoded each on their own; a very long text is encoded by its chunks, whose ids meet in
one task to be stitched; of merges of equal rank (ties) the first in the text is taken; other columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters near a cut end whose pre-token boundaries may differ from those of the whole text.
UNSURE = 4
#: Entries of a worker's cache from pre-token to ids; it starts anew beyond them.
CACHE_ENTRIES = 400_000


class Codec:
    """Ranks and pattern of one vocabulary, with a bounded cache of pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("chunked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.single = self.encoding._core_bpe.encode_single_piece
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        """The pattern's matches; they tile the text."""
        return self.find(text)

    def ids(self, pretokens: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of the pre-tokens, each encoded separately."""
        cache, single, out = self.cache, self.single, []
        for token in pretokens:
            found = cache.get(token)
            if found is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                found = np.array(single(token.encode()), dtype="<u4").tobytes()
                if len(token) <= 64:
                    cache[token] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def chunk_bounds(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of the overlapping chunks of a text."""
    return [(s, min(length, s + chunk + overlap)) for s in range(0, max(1, length - overlap), chunk)] if length else []


def boundaries(find: Codec, text: str, start: int) -> np.ndarray:
    """Absolute start positions of the pre-tokens of a chunk, and its end."""
    lengths = np.fromiter(map(len, find.pretokens(text)), dtype=np.int64)
    return start + np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def stitch(find: Codec, text: str, chunks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Pre-token boundaries of the whole text from those of its chunks, in order."""
    if not chunks:
        return np.zeros(1, np.int64)
    size = len(text)

    def sure(ends: np.ndarray, end: int) -> np.ndarray:
        return ends if end == size else ends[ends <= end - UNSURE]

    _, end, ends = chunks[0]
    parts = [sure(ends, end)]
    for start, stop, own in chunks[1:]:
        known = parts[-1]
        inside = known[known >= start]
        shared = inside[np.isin(inside, own, assume_unique=True)]
        if len(shared):
            at = shared[0]
            parts[-1] = known[known < at]
            tail = own[own >= at]
        else:
            at = int(known[-1])
            parts[-1] = known[:-1]
            tail = boundaries(find, text[at:stop], at)
        parts.append(sure(tail, stop))
    return np.concatenate(parts)


def piece_ranges(ends: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """Ranges of the text of about ``piece`` characters that start and end at pre-token boundaries."""
    out, at, last = [], 0, int(ends[-1])
    while at < last:
        k = max(int(np.searchsorted(ends, at + piece, side="right")) - 1, 0)
        stop = int(ends[k]) if ends[k] > at else int(ends[k + 1])
        out.append((at, stop))
        at = stop
    return out


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Output rows of each input row, flushed at about 8 MB."""
    rows, held = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            for row, weight in make(*(c[i].as_py() for c in columns)):
                rows.append(row)
                held += weight
            if held > 8_000_000 or len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def encode_parts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 65_536,
    overlap: int = 1_024,
) -> tuple[DataFrame, DataFrame]:
    """Pieces of the texts of one chunk, and pieces of the longer texts.

    One row per piece: row_key string (null for texts of one chunk), the id, piece_no int, ids binary (little-endian uint32).

    A text of up to ``chunk + overlap`` characters is its own single chunk and never leaves its
    task. The chunks of longer texts are dealt over the cluster twice, once to pre-tokenise and
    once to encode; between, the boundaries of one text meet in one task for the stitch. Every
    text has a piece 0, also an empty one. Longer texts are told apart by their id and a digest, which a task that
    is run again gives again; repeated rows of one are encoded once, and each has pieces of its own in the result.
    """
    base = docs.select(F.lit(None).cast("string").alias("row_key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("row_key", pa.string()), ("id", pa.int64()), ("piece_no", pa.int32()), ("ids", pa.binary())])
    ddl = "row_key string, id long, piece_no int, ids binary"
    limit = chunk + overlap

    def short(batches):
        c = codec(ranks_path, pattern)

        def make(key, doc, text):
            ids = c.ids(c.pretokens(text))
            yield (key, doc, 0, ids), len(ids)

        yield from _rows(batches, schema, make)

    def cut(batches):
        c = codec(ranks_path, pattern)
        out = pa.schema([("row_key", pa.string()), ("id", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("ends", pa.binary())])

        def make(key, doc, start, text):
            ends = boundaries(c, text, start)
            yield (key, doc, start, text, ends.tobytes()), len(text) + 8 * len(ends)

        yield from _rows(batches, out, make)

    def join(group: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        group = group.sort_by("start")
        key, doc = group["row_key"][0].as_py(), group["id"][0].as_py()
        texts, starts = group["text"].to_pylist(), group["start"].to_pylist()
        whole = "".join([*(x[:chunk] for x in texts[:-1]), texts[-1]])
        parts = [(s, s + len(x), np.frombuffer(e, np.int64)) for s, x, e in zip(starts, texts, group["ends"].to_pylist(), strict=True)]
        ranges = piece_ranges(stitch(c, whole, parts), chunk)
        return pa.table({
            "row_key": pa.array([key] * len(ranges), pa.string()),
            "id": pa.array([doc] * len(ranges), pa.int64()),
            "piece_no": pa.array(range(len(ranges)), pa.int32()),
            "text": pa.array([whole[a:b] for a, b in ranges], pa.string()),
        })

    def encode(batches):
        c = codec(ranks_path, pattern)

        def make(key, doc, piece_no, text):
            ids = c.ids(c.pretokens(text))
            yield (key, doc, piece_no, ids), len(ids)

        yield from _rows(batches, schema, make)

    whole = base.where(F.length("text") <= limit).mapInArrow(short, ddl)
    long = base.where(F.length("text") > limit).groupBy("id", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").cast("string").alias("rows"))
    long = long.select(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "sha", "rows").alias("row_key"), "id", "text")
    size = F.length("text")
    chunks = long.select(
        "row_key", "id", "text", F.explode(F.sequence(F.lit(0).cast("long"), (size - overlap - 1).cast("long"), F.lit(chunk).cast("long"))).alias("start")
    ).select("row_key", "id", "start", F.expr(f"substring(text, cast(start + 1 as int), {limit})").alias("text"))
    cut_chunks = chunks.repartition(F.xxhash64("row_key", "start")).mapInArrow(cut, "row_key string, id long, start long, text string, ends binary")
    pieces = cut_chunks.groupBy("row_key").applyInArrow(join, "row_key string, id long, piece_no int, text string")
    encoded = pieces.repartition(F.xxhash64("row_key", "piece_no")).mapInArrow(encode, ddl)
    copies = F.explode(F.sequence(F.lit(1), F.element_at(F.split("row_key", ":"), -1).cast("int")))
    encoded = encoded.select("*", copies.alias("copy")).select(F.concat_ws("#", "row_key", "copy").alias("row_key"), "id", "piece_no", "ids")
    return whole.withColumnRenamed("id", id_col), encoded.withColumnRenamed("id", id_col)


def encode_pieces(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """All pieces of all texts, see :func:`encode_parts`."""
    whole, encoded = encode_parts(docs, ranks_path, pattern, **options)
    return whole.unionByName(encoded)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Encode every text and decode its ids: id, n_tokens, ids_sha256, decoded_sha256.

    The digests run over the pieces in order. Texts of one piece are digested where they are
    encoded; only texts of several pieces are grouped.
    """
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    out = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), (names[2], pa.string()), (names[3], pa.string())])
    ddl = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    whole, encoded = encode_parts(docs, ranks_path, pattern, id_col=id_col, **options)

    def digest(doc, parts):
        c = codec(ranks_path, pattern)
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in parts:
            n += len(ids) // 4
            of_ids.update(ids)
            of_bytes.update(c.decode(ids))
        return doc, n, of_ids.hexdigest(), of_bytes.hexdigest()

    def single(batches):
        yield from _rows(batches, out, lambda doc, ids: [(digest(doc, [ids]), 200)])

    def several(group: pa.Table) -> pa.Table:
        row = digest(group[id_col][0].as_py(), (x.as_py() for x in group.sort_by("piece_no")["ids"]))
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, out.types, strict=True)], schema=out)

    return whole.select(id_col, "ids").mapInArrow(single, ddl).unionByName(encoded.groupBy("row_key").applyInArrow(several, ddl))
