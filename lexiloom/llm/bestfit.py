"""Best-fit decreasing packing.

Every document is tokenised once. Documents longer than a sequence are cut into full pieces, which fill
sequences of their own, and one last piece. The last pieces are packed by best-fit decreasing: longest
first, each into the tightest open sequence that has room, else into a new one. A segment tree over remaining
capacities finds the tightest in logarithmic time.

What the packing depends on is the number of last pieces of each length, a table with a row for each length
below the capacity, however many documents there are. So the driver packs that table: pieces of equal
length are placed together, as many as a set of equally filled sequences takes, just as one by one they
would be. The result is a list of runs ("pieces of this length from this rank on go to the sequences from this number
on, at this offset"), whose size is bounded by the capacity. A piece's rank among those of its length
is its rank within its task, which the tokenising task counts, plus the counts of earlier tasks, a sum
over (task, length). Only the compact ids are shuffled, once, and by (task, length), so neither copies nor equal lengths meet in one task.

Defined results: a null or empty text has only the end id; repeated ids and rows are packed each on their own;
a very long text is cut; pieces of equal length (ties) go in the order of task and row; an empty table gives an empty
result; other columns are left aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.storage import Scratch, small_batches

#: Texts of these characters alone are split by the pattern below just as by the file's own normaliser and pattern.
_PLAIN = re.compile(r"[\x01-\x1b\x20-\x7f\xc0-\xff–—‘’“”…]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
_SUFFIX, _END = "</w>", b"\0"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a file of the ``tokenizers`` library whose words end in a mark, without special tokens around a text.

    Plain texts are split here and merged by a faster implementation, for which the mark of a word's end is a zero
    byte: the ids of the file are in the order of its merges, so they serve as ranks. Other texts, and files of any other
    kind, go through the library itself. Tests compare the ids of both.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as text:
            told = json.load(text)
        model, self.added = told["model"], [x["content"] for x in told["added_tokens"]]
        self.size = self.full.get_vocab_size(with_added_tokens=True)
        self.fast = self._ranked(model, set(self.added)) if self._known(told) else None

    @staticmethod
    def _known(told: dict) -> bool:
        steps = told["normalizer"] and [x["type"] for x in told["normalizer"].get("normalizers", [])]
        split = told["pre_tokenizer"] and [x.get("pattern", {}).get("Regex") for x in told["pre_tokenizer"].get("pretokenizers", [])]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        ids, merges = told["model"]["vocab"], told["model"].get("merges", [])
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        return steps == ["NFC", "Replace", "Lowercase"] and split == [pattern, None] and told["model"].get("end_of_word_suffix") == _SUFFIX and made == sorted(made)

    @staticmethod
    def _ranked(model: dict, added: set[str]) -> tiktoken.Encoding:
        byte = byte_of()
        ranks = {}
        for token, rank in model["vocab"].items():
            if token not in added:
                ends = token.endswith(_SUFFIX)
                data = bytes(byte[c] for c in (token.removesuffix(_SUFFIX) if ends else token)) + _END * ends
                if data != _END:  # the byte itself never stands in a plain text
                    ranks[data] = rank
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or not _PLAIN.fullmatch(text) or any(x in text for x in self.added):
            return self.full.encode(text, add_special_tokens=False).ids
        words = _PIECES.findall(text.lower())
        words.append("")
        return self.fast.encode_ordinary("\0".join(words))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Tightest:
    """A segment tree over remaining capacities: whether any sequence has each of them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.held = [False] * (2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        at = room + self.leaves
        self.held[at] = there
        while (at := at >> 1) and self.held[at] != (now := self.held[2 * at] or self.held[2 * at + 1]):
            self.held[at] = now

    def find(self, least: int) -> int | None:
        """The smallest room that is there and at least ``least``."""
        at = least + self.leaves
        if not self.held[at]:
            while at > 1 and (at & 1 or not self.held[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length: (length, rank, n, sequence, offset) of each run, and the number of sequences.

    The n pieces of the length from the rank on go to the n sequences from that number on, each at the offset. Of
    sequences with equal room, those opened first come first.
    """
    tree = Tightest(capacity)
    open_at: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences), in order
    runs, used = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room:
            open_at.setdefault(room, []).append((first, n))
            tree.put(room, True)

    def fill(room: int, first: int, n: int, each: int, length: int, rank: int) -> int:
        """``each`` pieces in each of n sequences that have the room; returns the next rank."""
        for i in range(each):
            runs.append((length, rank, n, first, capacity - room + i * length))
            rank += n
        add(room - each * length, first, n)
        return rank

    for length in sorted(counts, reverse=True):
        rank, need = 0, counts[length]
        while need:
            room = tree.find(length)
            if room is None:
                room, groups = capacity, [(used, -(-need // (capacity // length)))]
                used += groups[0][1]
            else:
                groups = open_at.pop(room)
                tree.put(room, False)
            each = room // length  # a sequence that took one is the tightest for the next, till it has no room
            for first, n in groups:
                whole = min(n, need // each)
                if whole:
                    rank, need = fill(room, first, whole, each, length, rank), need - whole * each
                first, n = first + whole, n - whole
                if n and need:
                    rank, need, first, n = fill(room, first, 1, need, length, rank), 0, first + 1, n - 1
                if n:
                    add(room, first, n)
    return runs, used


def tokenize(docs: DataFrame, path: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, ids binary (little-endian; uint16 where the vocabulary allows, else uint32), and the row's place in its task.

    part is the task, rest the length of the last piece, place the rank among the task's rows with that rest, full_before
    the full pieces of the task's rows before.
    """
    names = [id_col, "n_tokens", "ids", "part", "rest", "place", "full_before"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]):
        enc, part = encoder(path), TaskContext.get().partitionId()
        kind = _kind(enc.size)
        seen, full = np.zeros(length, np.int64), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, held, lo = [], 0, 0
            for i in range(batch.num_rows):
                data = np.array([*enc.ids(texts[i].as_py() or ""), end_id], dtype=kind)
                whole, rest = divmod(len(data), length)
                rows.append((len(data), data.tobytes(), part, rest, int(seen[rest]), full))
                seen[rest] += 1
                full += whole
                held += data.nbytes
                if held > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))], names=names)
                    rows, held, lo = [], 0, i + 1

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(
        run, f"{id_col} long, n_tokens long, ids binary, part int, rest int, place long, full_before long"
    )


def _kind(size: int) -> str:
    return "<u2" if size <= 65_536 else "<u4"


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = 4_096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` tokens.

    id, piece (from 0), start (its document's ids before it), length, ids binary (little-endian uint32), doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0). The tokenised documents are written once to the shared folder.
    """
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as put:
        tokens = put.keep(put(tokenize(docs, path, end_id, length, id_col, text_col), "bestfit-tokens"))
    at_part = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {length}")).alias("full"))
    with Scratch(docs.sparkSession) as put:
        at_part = put.keep(put(at_part, "bestfit-counts"))
    counts = {r["rest"]: r["n"] for r in at_part.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    runs, used = best_fit_runs(counts, length)
    # by (length, rank), for a search in both at once
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    starts = {n: (int(np.searchsorted(table[:, 0], n)), int(np.searchsorted(table[:, 0], n, side="right"))) for n in counts}

    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = at_part.select("part", "rest", before.alias("base"))
    # full pieces have sequences of their own after the others: a task's numbers start where those of the tasks before end
    whole = at_part.groupBy("part").agg(F.sum("full").alias("full"))
    whole_base, total = {}, used
    for row in whole.where("full > 0").orderBy("part").toLocalIterator():
        whole_base[row["part"]] = total
        total += row["full"]
    placed = tokens.join(base.hint("shuffle_hash"), ["part", "rest"])
    wide = _kind(encoder(path).size)
    names = [id_col, "piece", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]):
        out, held = [], 0

        def flush():
            nonlocal out, held
            rows, out, held = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc, tokens_of, data, part, rest, rank, full_before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, wide).astype("<u4")
                for piece in range(tokens_of // length):
                    at = piece * length
                    out.append((doc, piece, at, length, ids[at : at + length].tobytes(), tokens_of, whole_base[part] + full_before + piece, 0))
                if rest:
                    lo, hi = starts[rest]
                    _, first_rank, _, first, offset = table[lo + int(np.searchsorted(table[lo:hi, 1], rank, side="right")) - 1].tolist()
                    out.append((doc, tokens_of // length, tokens_of - rest, rest, ids[tokens_of - rest :].tobytes(), tokens_of, first + rank - first_rank, offset))
                held += 4 * tokens_of
                if held > 8_000_000:
                    yield flush()
        if out:
            yield flush()

    return placed.select(id_col, "n_tokens", "ids", "part", "rest", (F.col("base") + F.col("place")).alias("rank"), "full_before").mapInArrow(
        cut, f"{id_col} long, piece int, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ids_crc32 (of their little-endian unsigned 32-bit ids) in place of the ids."""
    return pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens")
