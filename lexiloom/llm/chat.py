"""Chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins that double the distance give every
message its ancestors: after step i each message knows the one 2**i above it and the sum of the
scores between. So depth 400 needs nine joins, not 400. Leaves are ranked by the mean score of
their branch; the chosen leaves are joined with the kept step tables once more to enumerate their
root-to-leaf paths, and each path is formatted as one conversation.

Template. ``[INST]text[/INST]`` is a user's turn, ``<s>text</s>`` an assistant's, any other turn is
``[ROLE]role[/ROLE]<s>text</s>`` and lies outside the loss mask. Inside roles and texts a backslash is
doubled, and a backslash is put before every control string. So an unescaped control string is
always a mark, and removing one backslash of each pair or before a control string gives the text
back. Control strings start with ``[`` or ``<`` and have neither later on, so a text's end and a mark
never make another.

Defined results: null texts and roles count as empty; equal (tree, turn) rows are ordered by role and
text, so repeated rows are turns of their own; of replies with equal (tree, node) the first by parent, score, role
and text stays; a message whose parent is missing is a root; a tree with a null id is a conversation of its own; a very
long text is escaped whole; an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import materialize

# The control strings.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]"]

_CONTROL = "|".join(map(re.escape, CONTROL))
_SPECIAL = re.compile(rf"\\|{_CONTROL}")
_MARKS = re.compile(rf"\\(?:\\|{_CONTROL})|({_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\|{_CONTROL})")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string, and the range of it that is under the loss mask (empty: 0, 0)."""
    body = escape(text)
    if role == "user":
        return f"[INST]{body}[/INST]", 0, 0
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"[ROLE]{escape(role)}[/ROLE]<s>{body}</s>", 0, 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    marks = [(m.group(1), m.start(), m.end()) for m in _MARKS.finditer(formatted) if m.group(1)]
    turns, k, role = [], 0, None
    while k < len(marks):
        (mark, _, start), (_, stop, _) = marks[k], marks[k + 1]
        inner = unescape(formatted[start:stop])
        if mark == "[ROLE]":
            role = inner
        elif mark == "[INST]":
            turns.append(("user", inner))
        else:
            turns.append(("assistant" if role is None else role, inner))
            role = None
        k += 2
    return turns


def as_replies(conversations: DataFrame) -> DataFrame:
    """tree, node, parent, role, text, score of linear conversations: each turn answers the one before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return base.select("tree", place.cast("long").alias("node"), (place - 1).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def distinct_replies(replies: DataFrame) -> DataFrame:
    """``replies`` with one row for each (tree, node); they are only sorted if some are repeated."""
    if replies.groupBy("tree", "node").count().where("count > 1").isEmpty():
        return replies
    place = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "score", "role", "text"))
    return replies.select("tree", "node", "parent", "role", "text", "score", place.alias("n")).where("n = 1").drop("n")


def root_paths(replies: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, node, place: the paths of the ``branches`` best leaves of each tree, all leaves for None.

    A leaf's rank in its tree is by the mean score of its path, best first, ties to the longer path and
    then the smaller leaf. Each doubling step is written to the shared folder before the next; messages
    whose root is reached take no further part in it.
    Messages that reply to one another in a circle have no root and are left out. (tree, node) must be distinct.
    """
    nodes = replies.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    step = materialize(first.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("size")), "chat-step")
    steps, ended, most = [], [step.where(F.col("up").isNull())], step.count()
    while not (rest := step.where(F.col("up").isNotNull())).isEmpty() and 1 << len(steps) <= most:
        steps.append(rest.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up"))
        above = rest
        for done in ended:
            above = above.unionByName(done)
        above = above.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("sum").alias("s"), F.col("size").alias("z"))
        joined = rest.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left")
        both = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("sum", "s"), ("size", "z"))]
        step = materialize(joined.select("tree", "node", F.col("next").alias("up"), *both), "chat-step")
        ended.append(step.where(F.col("up").isNull()))
    tops = ended[0]
    for done in ended[1:]:
        tops = tops.unionByName(done)
    inner = nodes.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where(F.col("p").isNotNull()).distinct()
    leaves = tops.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("size")), F.desc("size"), "node"))
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "size", rank.cast("long").alias("rank"))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    paths = leaves.select("tree", "leaf", "rank", "size", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("below"))
    for i, jump in enumerate(steps):
        higher = paths.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        higher = higher.select("tree", "leaf", "rank", "size", F.col("up").alias("node"), (F.col("below") + (1 << i)).alias("below"))
        paths = materialize(paths.unionByName(higher), "chat-paths")
    return paths.select("tree", "leaf", "rank", "node", (F.col("size") - 1 - F.col("below")).alias("place"))


def format_paths(replies: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, n_turns, formatted, loss: one conversation a chosen path.

    ``loss`` has the start and stop, in code points of ``formatted``, of each range under the loss mask.
    The turns of a path meet sorted in one partition and are formatted as they stream by.
    """
    replies = distinct_replies(replies)
    texts = replies.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    paths = root_paths(replies, branches)
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = turns.select("tree", "leaf", "rank", "place", "role", "text").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]):
        rows, held = [], 0
        key, parts, loss, at = None, [], [], 0

        def close():
            nonlocal parts, loss, at, held
            rows.append((*key, len(parts), "".join(parts), loss))
            held += at
            parts, loss, at = [], [], 0

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows, held = [], 0
            return out

        for batch in batches:
            for tree, leaf, rank, role, text in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "rank", "role", "text")), strict=True):
                if key != (tree, leaf, rank):
                    if key is not None:
                        close()
                        if held > 4_000_000:
                            yield flush()
                    key = (tree, leaf, rank)
                turn, start, stop = format_turn(role or "", text or "")
                if stop:
                    loss.append({"start": at + start, "stop": at + stop})
                parts.append(turn)
                at += len(turn)
        if key is not None:
            close()
            yield flush()

    return turns.mapInArrow(run, "tree long, leaf long, rank long, n_turns long, formatted string, loss array<struct<start:bigint,stop:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the formatted strings."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for tree, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_turns(text)
                told = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                learnt = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                rows.append((tree, len(turns), told, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
