"""Suffix-array dedup: removes the bytes of passages that also stand in an earlier document.

A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a
smaller id. Every such string has a minimizer, the least hash of the k-byte grams in it, which
depends on the string alone. Neighbouring strings with the same minimizer form one stretch of the
text. Only stretches whose minimizer occurs in two documents can hold a repeated string.

Of stretches with equal content, those of any but the smallest document go whole; only the smallest
document's own ones are sorted. They are dealt into shards by minimizer, so equal strings always meet, and a
shard's stretches are sorted as one suffix array by external induced sorting (``induced``), whose common
prefixes tell which neighbouring suffixes share ``length`` bytes. The smallest document of such a group keeps them. Stretches
that can't share a string with one of another document are not sorted: a string holds at least half of its other bytes on one side of its
minimizer's gram, so in two places of it the bytes on the left or those on the right are equal too (``Partners``).

Scale. The scan of the texts emits four numbers a stretch; texts travel once, to the places of the stretches to be
sorted. Exact copies of a whole text are settled by its digest and take no part in the rest. A minimizer with over a
thousandth of all stretches to sort, and more than a shard's worth, is cut up: its strings of ``length`` bytes are dealt
one by one, by their own hash. Otherwise a shard may be of any size, as the sort needs a bounded part of it in memory.
All decisions are made on the input, in every document at once.

Defined results: null and empty texts have no bytes; shorter texts than ``length`` lose nothing;
rows that share an id never remove one another's bytes, a null id is after all others; repeated rows
lose the same; a very long text is hashed alone, in one piece; an empty table gives an empty result; other columns are
left aside (kept by ``deduplicated``, whatever their names). Texts that share an id are told apart by 25 bits of a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lexiloom.llm.bloom import Bloom, bloom
from lexiloom.llm.induced import Store, repeats
from lexiloom.llm.vectext import SLICE_BYTES, U64, give_back, mix, slices, span_hashes, utf8
from lexiloom.storage import Scratch, batch_rows, small_batches

#: Bytes of a gram, windows of a stretch at most, bytes of stretches in a shard, and the share of all rows that makes a key hot.
GRAM, STRETCH, SHARD_BYTES, HOT_SHARE = 20, 64, 1 << 20, 1_000
#: Distinct stretches of a minimizer that are never cut up, and rows of Arrow batches of texts' stretches.
HOT_LEAST, NUMBER_ROWS = 1 << 15, 4_000
#: Logarithm of the places of the table that tells a shard's stretches with a partner.
PARTNER_BITS = 20
#: A null id in comparisons.
LAST = (1 << 63) - 1
#: Of a place: bits of the number of windows and of the text's tag, below those of the start.
SIZE_BITS, TAG_BITS = 7, 25


def _tag(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - TAG_BITS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), _tag(text).alias("tag"), text.alias("text"))


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw),), "<u8", padded.data, strides=(1,))
    n = len(raw) - gram + 1
    h = words[:n] * U64(0x9E3779B97F4A7C15)
    for k in (*range(8, gram - 7, 8), gram - 8):
        h = (h ^ (h >> U64(31)) ^ words[k : k + n]) * U64(0xD6E8FEB86659FD93)
    return h


def minimizers(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, windows, minimizer) of the stretches of a flat batch."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.view(U64)
    h = _gram_hashes(raw, gram)
    least, width, wanted = h, 1, length - gram + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = np.arange(len(least)) + length <= offsets[rows + 1]
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(first & valid)
    stops = np.flatnonzero(np.append(first[1:] | ~valid[1:], True) & valid) + 1
    size = stops - starts
    pieces = -(-size // STRETCH)
    which = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[which] + place * STRETCH
    return rows[at], at, np.minimum(stops[which] - at, STRETCH), least[at]


_FOUND = "minimizer long, content long, doc long, place long"


def _stretches(texts: DataFrame, length: int, gram: int, left_out: Bloom | None = None) -> DataFrame:
    """minimizer, content (a hash), doc, place of every stretch of the texts, but of those that pass a filter of ids."""
    sent = texts.sparkSession.sparkContext.broadcast(left_out)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if sent.value is not None:
                batch = batch.filter(pa.array(~sent.value.passing(batch.column(0).to_numpy())))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets, SLICE_BYTES):
                part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                rows, at, size, least = minimizers(part, own, length, gram)
                if len(rows):
                    content = span_hashes(part, at, at + size + length - 1)
                    place = (((at - own[rows]) << TAG_BITS | tags[lo:hi][rows]) << SIZE_BITS) | size
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[lo:hi][rows]), pa.array(place)], names=["minimizer", "content", "doc", "place"])
        give_back()

    return texts.mapInArrow(run, _FOUND)


def _repeated(sorted_rows: DataFrame) -> DataFrame:
    """Of rows sorted by all of their columns, those of minimizers of two documents, once each, and ``goes``: a smaller document has the content.

    One pass over each partition, holding a batch and the rows of one document at the end of it.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held = [np.zeros(0, np.int64)] * 4
        going, lead = None, (0, 0, -1)  # the last minimizer if it is known to be repeated; minimizer, content and first document of the last row
        for batch in batches:
            m, c, d, p = (np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns, strict=True))
            if not len(m):
                continue
            fresh = np.ones(len(m), bool)
            fresh[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            m, c, d, p = m[fresh], c[fresh], d[fresh], p[fresh]
            starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
            several[0] |= going is not None and m[0] == going
            cut = len(m) if several[-1] else int(starts[-1])
            going = int(m[-1]) if several[-1] else None
            if not cut:
                held = [m, c, d, p]
                continue
            kept = np.repeat(several, np.diff(np.append(starts, len(m))))[:cut]
            # the first document of each content, which may be in an earlier batch
            opens = np.ones(cut, bool)
            opens[1:] = (m[1:cut] != m[: cut - 1]) | (c[1:cut] != c[: cut - 1])
            first = d[:cut][np.maximum.accumulate(np.where(opens, np.arange(cut), 0))]
            if (int(m[0]), int(c[0])) == lead[:2]:
                first[: int(np.append(np.flatnonzero(opens[1:]) + 1, cut)[0])] = lead[2]
            lead = (int(m[cut - 1]), int(c[cut - 1]), int(first[-1]))
            goes = d[:cut] > first
            held = [x[cut:] for x in (m, c, d, p)]
            if kept.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:cut][kept]) for x in (m, c, d, p)), pa.array(goes[kept])], names=["minimizer", "content", "doc", "place", "goes"])

    return sorted_rows.mapInArrow(run, _FOUND + ", goes boolean")


def _contents(wanted: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, doc, place, bytes of the stretches of each text (doc, tag, text, list); those of hot minimizers window by window."""

    def run(batches: Iterator[pa.RecordBatch]):
        before = (None, None)
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(docs), bool)  # a row may be repeated
            fresh[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
            fresh[:1] = (docs[:1] != before[0]) | (tags[:1] != before[1]) if before[0] is not None else True
            before = (docs[-1], tags[-1]) if len(docs) else before
            batch = batch.filter(pa.array(fresh))
            docs, tags, lists = docs[fresh], tags[fresh], batch.column(3)
            raw, offsets = utf8(batch.column(2))
            least, place, hot = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            row = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
            size, start = place & ((1 << SIZE_BITS) - 1), place >> (SIZE_BITS + TAG_BITS)
            one = np.where(hot, size, 1)
            which = np.repeat(np.arange(len(place)), one)
            start = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(one) - one, one)
            size, cut, row = np.where(hot, 1, size)[which], hot[which], row[which]
            key, at = mix(least.view(U64)[which]), start + offsets[row]
            key[cut] = span_hashes(raw, at[cut], at[cut] + length)
            place = ((start << TAG_BITS | tags[row]) << SIZE_BITS) | size
            for lo in range(0, len(place), 20_000):
                part = slice(lo, lo + 20_000)
                width = size[part] + length - 1
                ends = np.concatenate([[0], np.cumsum(width)])
                data = raw[np.arange(ends[-1]) + np.repeat(at[part] - ends[:-1], width)]
                content = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array((key[part] % U64(shards)).astype(np.int64)), pa.array(docs[row[part]]), pa.array(place[part]), content], names=["shard", "doc", "place", "bytes"])
        give_back()

    return wanted.mapInArrow(run, "shard long, doc long, place long, bytes binary")


_SPANS = "doc long, tag long, start long, stop long"


def _span_batch(doc: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> pa.RecordBatch:
    """The spans of the windows ``first`` to ``last`` of stretches."""
    start, tag = place >> (SIZE_BITS + TAG_BITS), (place >> SIZE_BITS) & ((1 << TAG_BITS) - 1)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start + first), pa.array(start + last + length)], names=["doc", "tag", "start", "stop"])


class Partners:
    """Tells which stretches of a shard may share a string of ``length`` bytes with one of another document.

    A stretch has a key for either side of its minimizer's gram, of the gram and half of a string's other bytes. A table of a fixed size
    holds the smallest and the largest document by key; keys that fall together only leave more stretches in. Stretches that hold the gram
    twice have no sides: they and all others of their minimizer stay.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.low, self.high = np.full(1 << PARTNER_BITS, LAST), np.full(1 << PARTNER_BITS, -LAST - 1)
        self.odd = np.zeros(1 << PARTNER_BITS, bool)

    def keys(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Three columns: the places of the minimizer, and of its left and right side or -1; of strings raw[ends[i]:ends[i + 1]]."""
        h, at, width = _gram_hashes(raw, self.gram), ends[:-1], np.diff(ends)
        wanted, side = self.length - self.gram + 1, (self.length - self.gram) // 2
        least = h[at]
        for o in range(1, wanted):
            least = np.minimum(least, h[at + o])
        where, seen = at.copy(), np.zeros(len(at), np.int64)
        for o in range(2 * wanted - 1):
            hit = (h[np.minimum(at + o, len(h) - 1)] == least) & (o <= width - self.gram)
            seen += hit
            where[hit] = at[hit] + o
        odd = (seen > 1) | (width - self.gram > 2 * wanted - 2)
        shift = U64(64 - PARTNER_BITS)
        out = np.full((len(at), 3), -1)
        out[:, 0] = mix(least) >> shift
        self.odd[out[odd, 0]] = True
        for k, begin in ((1, where - side), (2, where + self.gram)):
            inside = ~odd & (begin >= at) & (begin + side <= ends[1:])
            begin = begin[inside]
            out[inside, k] = mix(least[inside] * U64(2 * k + 1) ^ span_hashes(raw, begin, begin + side)) >> shift
        return out

    def add(self, keys: np.ndarray, doc: np.ndarray) -> None:
        for k in (1, 2):
            known = keys[:, k] >= 0
            np.minimum.at(self.low, keys[known, k], doc[known])
            np.maximum.at(self.high, keys[known, k], doc[known])

    def several(self, keys: np.ndarray) -> np.ndarray:
        met = self.low < self.high
        return self.odd[keys[:, 0]] | (met[keys[:, 1]] & (keys[:, 1] >= 0)) | (met[keys[:, 2]] & (keys[:, 2] >= 0))


def _sorted_spans(shards: DataFrame, length: int, gram: int, budget: int | None) -> DataFrame:
    """The spans of each shard's stretches that an earlier document has, by an external suffix sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Store(budget) as store:
            partners = Partners(length, gram)
            shard: list[tuple[np.ndarray, ...]] = []
            kept: list[tuple[np.ndarray, np.ndarray]] = []

            def stored(values: np.ndarray) -> np.ndarray:
                out = store.empty(values.size, values.dtype.type)
                out[:] = values.ravel()
                return out

            for batch in batches:
                column = batch.column("bytes")
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                if len(ends) < 2:
                    continue
                raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
                ends = ends - ends[0]
                keys, doc = partners.keys(raw, ends), batch.column("doc").to_numpy()
                partners.add(keys, doc)
                shard.append(tuple(stored(x) for x in (doc, batch.column("place").to_numpy(), keys, ends, raw)))

            def strings() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for doc, place, keys, ends, raw in shard:
                    stays = partners.several(keys.reshape(-1, 3))
                    size = np.diff(ends)
                    codes = np.full(len(raw) + len(size), -1, np.int16)
                    codes[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
                    codes = codes[np.repeat(stays, size + 1)]
                    chosen = stored(doc[stays]), stored(place[stays])
                    store.free(doc, place, keys, ends, raw)
                    if len(codes):
                        kept.append(chosen)
                        yield codes, chosen[0]
                shard.clear()

            for (owner, count), (doc, place) in zip(repeats(strings(), length, store), kept, strict=True):
                row = np.repeat(np.arange(len(count)), count)
                window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hit = owner < doc[row]
                row, window = row[hit], window[hit]
                if len(row):
                    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] > window[:-1] + length)])
                    first = np.flatnonzero(cut)
                    last = np.append(first[1:], len(row)) - 1
                    yield _span_batch(doc[row[first]], place[row[first]], window[first], window[last], length)
        give_back()

    return shards.groupBy("shard").applyInArrow(run, _SPANS)


def _whole_spans(rows: DataFrame, length: int) -> DataFrame:
    """The spans of stretches that go whole."""
    size = F.col("place").bitwiseAND((1 << SIZE_BITS) - 1)
    start = F.shiftright("place", SIZE_BITS + TAG_BITS)
    return rows.select("doc", F.shiftright("place", SIZE_BITS).bitwiseAND((1 << TAG_BITS) - 1).alias("tag"), start.alias("start"), (start + size + (length - 1)).alias("stop"))


def _copies(put: Scratch, texts: DataFrame) -> DataFrame:
    """doc, tag, start, stop of the whole texts that a smaller document has too.

    Digests of over a thousandth of all rows, of which there are at most a thousand, are joined by broadcast.
    """
    digest = put(texts.select("doc", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n")), "dedup-digests")
    least = put(digest.groupBy("sha").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "dedup-least")
    hot = F.broadcast(least.where(F.col("rows") > digest.count() / HOT_SHARE))
    cold = least.join(hot.select("sha"), "sha", "left_anti")
    met = digest.join(hot, "sha").unionByName(digest.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold, "sha"))
    return put(met.where(F.col("doc") > F.col("least")).select("doc", "tag", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")).distinct(), "dedup-copies")


def removed_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, budget: int | None = None, owner: Scratch | None = None) -> DataFrame:
    """doc, tag, spans array<struct<start,stop>> (sorted, may overlap) of the documents that lose bytes.

    ``budget`` are the bytes that the sort of a shard holds in memory. The result is a table, which ``owner``
    deletes if given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, id_col, text_col).where(F.octet_length("text") >= length)
    with Scratch(spark) as put:
        copies = _copies(put, texts)
        named = bloom(copies.select("doc"))
        rest = _passing(texts, named).join(copies, ["doc", "tag"], "left_anti").select("doc", "tag", "text")
        every = _stretches(texts, length, gram, named).unionByName(_stretches(rest, length, gram))
        columns = ["minimizer", "content", "doc", "place"]
        with batch_rows(spark, NUMBER_ROWS):
            found = put(_repeated(every.repartition("minimizer").sortWithinPartitions(*columns)), "dedup-stretches")
        leads = found.where("not goes")
        total = leads.agg(F.count("*").alias("n"), F.sum(F.col("place").bitwiseAND((1 << SIZE_BITS) - 1) + (length - 1)).alias("bytes")).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // SHARD_BYTES))
        hot = leads.groupBy("minimizer").count().where(F.col("count") > max(HOT_LEAST, total["n"] / HOT_SHARE)).select("minimizer", F.lit(True).alias("hot"))
        marked = leads.join(F.broadcast(hot), "minimizer", "left")
        entry = F.struct("minimizer", "place", F.coalesce("hot", F.lit(False)).alias("hot"))
        lists = marked.groupBy("doc", F.shiftright("place", SIZE_BITS).bitwiseAND((1 << TAG_BITS) - 1).alias("tag")).agg(F.collect_list(entry).alias("list"))
        wanted = texts.join(lists.hint("shuffle_merge"), ["doc", "tag"]).select("doc", "tag", "text", "list")
        sorted_ = put(_sorted_spans(_contents(wanted, length, shards), length, gram, budget), "dedup-sorted")
        spans = sorted_.unionByName(_whole_spans(found.where("goes"), length)).unionByName(copies)
        spans = put(spans.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "dedup-spans")
        return put.keep(spans) if owner is None else put.give(spans, owner)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _passing(texts: DataFrame, named: Bloom) -> DataFrame:
    """The rows of doc, tag, text whose ids pass a filter."""
    sent = texts.sparkSession.sparkContext.broadcast(named)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.passing(batch.column(0).to_numpy())))

    return texts.mapInArrow(run, "doc long, tag long, text string")


def _parted(docs: DataFrame, named: Bloom, id_col: str, text_col: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose ids do not pass the filter, and the others with the columns ``names``, the id and the tag.

    The filter parts the rows where they are read, so only the second kind, with their
    texts, take part in joins; their texts travel compressed, as binary.
    """
    sent = docs.sparkSession.sparkContext.broadcast(named)
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), names[1]: _tag(text), text_col: text})
    text_at, id_at, width = docs.columns.index(text_col), len(docs.columns), len(docs.columns)

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            pack = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                hit = sent.value.passing(batch.column(id_at).to_numpy())
                kept = batch.filter(pa.array(hit == inside))
                if inside:
                    columns = list(kept.columns)
                    columns[text_at] = pa.array([pack(x.as_buffer().to_pybytes()) if x.is_valid else None for x in kept.column(text_at)], pa.binary())
                    yield pa.RecordBatch.from_arrays(columns, names=kept.schema.names)
                else:
                    yield kept.select(list(range(width)))

        return run

    fields = list(docs.schema.fields)
    clean = StructType(fields[:text_at] + [keyed.schema[text_at]] + fields[text_at + 1 :])
    wide = StructType([*fields[:text_at], StructField(text_col, BinaryType()), *fields[text_at + 1 :], StructField(names[0], LongType()), StructField(names[1], LongType())])
    return keyed.mapInArrow(part(False), clean), keyed.mapInArrow(part(True), wide)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows that surely lose nothing, and the others with a last column of spans (null: they lose nothing either)."""
    names = []
    for name in ("doc", "tag", "spans"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    spans = removed_spans(docs, length, id_col, text_col)
    clean, rest = _parted(docs, bloom(spans.select("doc")), id_col, text_col, names)
    joined = rest.join(spans.toDF(*names), names[:2], "left")
    return clean, joined.select(*(rest[c] for c in docs.columns), joined[names[2]])


def _kept(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal runs removed."""
    runs = merged([(x["start"], x["stop"]) for x in spans or []])
    out, at = [], 0
    for start, stop in runs:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]]), sum(b - a for a, b in runs), len(runs)


def dedup_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    clean, rest = _with_spans(docs, length, id_col, text_col)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = unpacked(text.as_py())
                kept, removed, runs = _kept(data, spans.as_py())
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    whole = clean.select(id_col, F.octet_length(text_col).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text_col, 256).alias("kept_sha256"))
    return whole.unionByName(rest.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def deduplicated(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` without the repeated bytes; documents of which nothing is left go.

    A character that loses some of its bytes loses all of them. ``length_col``, if given, gets the
    new number of characters.
    """
    clean, rest = _with_spans(docs, length, id_col, text_col)
    names, schema = docs.columns, clean.schema
    text_at, spans_at = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at), strict=True):
                data = unpacked(text.as_py()) if text.is_valid else None
                if data is None or not spans.is_valid:
                    texts.append(None if data is None else data.decode())
                    keep.append(True)
                else:
                    kept = _kept(data, spans.as_py())[0].decode("utf-8", "ignore")
                    texts.append(kept)
                    keep.append(bool(kept))
            columns = [*batch.columns[:spans_at]]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = clean.unionByName(rest.mapInArrow(run, schema))
    return out if length_col is None else out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
