"""Prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

Building. Turns are range-sorted by (conversation, turn), so a conversation of any length spreads over tasks, and one
pass gives each turn the polynomial sum of the digests before and after it; a conversation that goes on in the next task is carried
over as (turns, sums), a row for each task. A prefix is known by its depth and its sum: 128 bits of SHA-256 values times odd powers, so two
different prefixes are equal with a chance of 2**-128. As the sums can be shifted, a conversation that starts with the first turns
of another gets the keys of its prefixes from both.

Chains. A node whose smallest member and number of members equal its parent's has the same members, so it is the only
child: the pair (smallest member, members) names a chain of such nodes. There are at most two chains a conversation.

Heavy paths. The heavy child of a node is the one with most members (ties: smallest member). Chains are linked to heavy paths by
pointer doubling; a pointer of a chain goes to one that no other chain points to, so nothing is hot. Every other child starts a path of its
own, and has at most half of its parent's members, so a walk to the root leaves at most log2(conversations) paths. In as many
rounds, paths that wait for no other give their sums to the nodes that they are attached to: summed by node first, then by that
node's path. Then one suffix sum along each path's array, in blocks of depths, gives every node the sum over its subtree.

Defined results: conversations are ordered by turn (null first), ties by role and text; null roles and texts are empty; repeated
rows are turns of their own; rows without a conversation id are left out; an empty table gives an empty result, without a root; a very long text
counts whole; other columns are left aside. Remainders have the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import Scratch, small_batches

_ALL = (1 << 64) - 1
#: Odd bases of the two sums.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Turns or nodes that are dealt together: of one long conversation, and of a path's array.
BLOCK = 4_096
#: Ids of members in one row, of those that end at a node.
ENDS = 4_096
#: Nodes with more than this share of all attached paths (and so many at least) are joined by broadcast: there are no more than its inverse.
HOT_SHARE, HOT_LEAST = 1 / 1_000, 1_000

KEY = ["depth", "ka", "kb"]
CHAIN = ["conv", "n_convs"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def summed_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv, part, local, before_a, before_b, after_a, after_b, chars: turns in order, with their task, and place and sums in it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # the last column spreads rows that are repeated very often
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "spread"]
    ordered = base.where("conv is not null").withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv", "part", "local", "before_a", "before_b", "after_a", "after_b", "chars"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        conv, n, sums, powers = None, 0, (0, 0), (1, 1)
        for batch in batches:
            rows = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, n, sums, powers = c, 0, (0, 0), (1, 1)
                told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                before = sums
                sums = tuple((s + int.from_bytes(told[8 * i : 8 * i + 8], "little") * p) & _ALL for i, (s, p) in enumerate(zip(sums, powers, strict=True)))
                powers = tuple(p * b & _ALL for p, b in zip(powers, BASES, strict=True))
                rows.append((c, part, n, *map(_signed, before), *map(_signed, sums), len(text)))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ordered.select("conv", "role", "text").mapInArrow(run, "conv long, part int, local long, before_a long, before_b long, after_a long, after_b long, chars long")


def carried(turns: DataFrame) -> DataFrame:
    """conv, place, before_a, before_b, after_a, after_b, chars: places and sums in whole conversations, from those in a task.

    A row for each task comes to the driver, and what each task's first conversation has before it goes back.
    """
    last = F.max_by(F.struct(F.col("local") + 1, "after_a", "after_b"), F.struct("conv", "local"))
    parts = turns.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), last.alias("told")).orderBy("part").collect()
    before: dict[int, tuple[int, int, int, int]] = {}
    conv, n, sums = None, 0, (0, 0)
    for r in parts:
        count, *own = r["told"]
        if r["first"] == conv:
            before[r["part"]] = (conv, n, *sums)
        if r["first"] == conv == r["last"]:
            sums = tuple((s + x * pow(b, n, 1 << 64)) & _ALL for s, x, b in zip(sums, own, BASES, strict=True))
            n += count
        else:
            conv, n, sums = r["last"], count, tuple(x & _ALL for x in own)
    if not before:
        return turns.select("conv", F.col("local").alias("place"), "before_a", "before_b", "after_a", "after_b", "chars")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            convs, parts, place, *sums = (c.to_numpy() for c in batch.columns[:7])
            place, sums = place.copy(), [s.view(np.uint64).copy() for s in sums]
            for part in np.unique(parts).tolist():
                if part in before:
                    conv, n, *told = before[part]
                    rows = (parts == part) & (convs == conv)
                    place[rows] += n
                    for i, s in enumerate(sums):
                        s[rows] = s[rows] * np.uint64(pow(BASES[i % 2], n, 1 << 64)) + np.uint64(told[i % 2])
            out = [batch.column(0), pa.array(place), *(pa.array(s.view(np.int64)) for s in sums), batch.column(7)]
            yield pa.RecordBatch.from_arrays(out, names=["conv", "place", "before_a", "before_b", "after_a", "after_b", "chars"])

    return turns.mapInArrow(run, "conv long, place long, before_a long, before_b long, after_a long, after_b long, chars long")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the head of its hundred: 0 to 5."""
    return (F.crc32(conv.cast("string")) % 6).cast("int")


def plans(turns: DataFrame) -> DataFrame:
    """conv, n (own turns), h, head (the turns taken: at most h), own_a, own_b: how each conversation is rebuilt."""
    conv, place, h = F.col("conv"), F.col("place"), shared_turns(F.col("conv"))
    own = turns.groupBy("conv").agg((F.max("place") + 1).alias("n"), F.max(F.when(place == h - 1, F.struct("after_a", "after_b"))).alias("own"))
    first = turns.where((conv % 100 == 0) & (place < 5)).groupBy(conv.alias("top"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("place", "before_a", "before_b", "after_a", "after_b", "chars"))).alias("first"))
    both = own.join(first, conv - conv % 100 == F.col("top"), "left")
    none = F.array().cast(first.schema["first"].dataType)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select("conv", "n", h.alias("h"), F.slice(F.coalesce("first", none), 1, h).alias("head"), zero(F.col("own.after_a")).alias("own_a"), zero(F.col("own.after_b")).alias("own_b"))


def memberships(turns: DataFrame, told: DataFrame) -> DataFrame:
    """conv, depth, ka, kb, pa, pb, chars, ends: a row for each conversation and prefix of its rebuilt turns but the empty one.

    (ka, kb) is the key of the prefix, (pa, pb) that of the one before, ``ends`` whether the conversation ends there.
    """
    at = F.explode("head")
    taken = told.select("conv", "n", "h", F.size("head").alias("m"), at.alias("x")).select(
        "conv", (F.col("x.place") + 1).alias("depth"), F.col("x.after_a").alias("ka"), F.col("x.after_b").alias("kb"), F.col("x.before_a").alias("pa"), F.col("x.before_b").alias("pb"),
        F.col("x.chars").alias("chars"), ((F.col("x.place") + 1 == F.col("m")) & (F.col("n") <= F.col("h"))).alias("ends"),
    )
    # what a conversation's turns need of it is dealt by blocks, so a very long one is in many tasks
    tail = F.try_element_at("head", F.lit(-1))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block")
    needs = told.where("n > h").select("conv", blocks, "n", "h", F.size("head").alias("m"), "own_a", "own_b", zero(tail["after_a"]).alias("head_a"), zero(tail["after_b"]).alias("head_b"))
    own = turns.withColumn("block", F.expr(f"place div {BLOCK}")).join(needs, ["conv", "block"]).where("place >= h")
    own = own.select("conv", "place", "n", "h", "m", "before_a", "before_b", "after_a", "after_b", "own_a", "own_b", "head_a", "head_b", "chars")
    shift = [np.array([pow(pow(b, -1, 1 << 64), k, 1 << 64) for k in range(6)], np.uint64) for b in BASES]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            conv, place, n, h, m = (c.to_numpy() for c in batch.columns[:5])
            before, after, own, head = ([batch.column(k + i).to_numpy().view(np.uint64) for i in (0, 1)] for k in (5, 7, 9, 11))
            by = [s[h - m] for s in shift]
            moved = lambda x: [pa.array((head[i] + by[i] * (x[i] - own[i])).view(np.int64)) for i in (0, 1)]  # noqa: E731, B023
            out = [batch.column(0), pa.array(place - h + m + 1), *moved(after), *moved(before), batch.column(13), pa.array(place == n - 1)]
            yield pa.RecordBatch.from_arrays(out, names=["conv", "depth", "ka", "kb", "pa", "pb", "chars", "ends"])

    return taken.unionByName(own.mapInArrow(run, "conv long, depth long, ka long, kb long, pa long, pb long, chars long, ends boolean"))


def chain_paths(chains: DataFrame, put: Scratch) -> DataFrame:
    """conv, n_convs, path_conv, path_n: the first chain of each chain's heavy path, by pointer doubling.

    ``chains`` has conv, n_convs, and up_conv, up_n of the chain above it on its path, null for the first.
    """
    start = chains.select(*CHAIN, "up_conv", "up_n")
    done = [start.where("up_conv is null").select(*CHAIN, F.col("conv").alias("path_conv"), F.col("n_convs").alias("path_n"))]
    rest = start.where("up_conv is not null")
    while not rest.isEmpty():
        # of a chain above: where its own pointer goes, or its path if that is known
        known = rest.select(*CHAIN, "up_conv", "up_n", F.lit(False).alias("known"))
        for d in done:
            known = known.unionByName(d.select(*CHAIN, F.col("path_conv").alias("up_conv"), F.col("path_n").alias("up_n"), F.lit(True).alias("known")))
        above = known.select(F.col("conv").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("up_conv").alias("to_conv"), F.col("up_n").alias("to_n"), "known")
        step = put(rest.join(above, ["up_conv", "up_n"]).select(*CHAIN, F.col("to_conv").alias("up_conv"), F.col("to_n").alias("up_n"), "known"), "trie-step")
        done.append(step.where("known").select(*CHAIN, F.col("up_conv").alias("path_conv"), F.col("up_n").alias("path_n")))
        rest = step.where("not known").drop("known")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def attached_sums(paths: DataFrame, branches: DataFrame, measures: list[str], put: Scratch) -> DataFrame:
    """KEY and for each measure the sum over the subtrees of all paths that are attached to a node.

    ``paths``: path_conv, path_n, KEY of the node it is attached to (null: none), and its own sums; ``branches``: KEY of each
    node with attached paths, their number ``attached``, and the path that the node is on.
    """
    path = ["path_conv", "path_n"]
    waits = branches.groupBy(*path).agg(F.sum("attached").alias("waits"))
    state = put(paths.join(waits, path, "left").fillna(0, "waits"), "trie-paths")
    told = []
    while True:
        sums = state.where("waits = 0 and depth is not null").groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in measures), F.count("*").alias("came"))
        sums = put(sums, "trie-sums")
        if sums.isEmpty():
            break
        told.append(sums)
        gains = sums.join(branches.select(*KEY, *path), KEY).groupBy(*path).agg(*(F.sum(c).alias(f"more_{c}") for c in measures), F.sum("came").alias("came"))
        grown = state.where("waits > 0").join(gains, path, "left").fillna(0, ["came", *(f"more_{c}" for c in measures)])
        state = put(grown.select(*path, *KEY, *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in measures), (F.col("waits") - F.col("came")).alias("waits")), "trie-paths")
    every = told[0] if told else sums
    for sums in told[1:]:
        every = every.unionByName(sums)
    return every.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in measures))


def suffix_sums(rows: DataFrame, path: list[str], at: str, measures: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with every measure replaced by its sum over the rows of the path from this place on.

    Sums within blocks of places, then those of the later blocks: a path of any length is in many tasks.
    """
    rows = rows.withColumn("_block", F.expr(f"{at} div {block}"))
    within = Window.partitionBy(*path, "_block").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*path).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*path, "_block").agg(*(F.sum(c).alias(c) for c in measures))
    totals = totals.select(*path, "_block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"_{c}") for c in measures))
    rows = rows.withColumns({c: F.sum(c).over(within) for c in measures}).join(totals, [*path, "_block"])
    return rows.withColumns({c: F.col(c) + F.col(f"_{c}") for c in measures}).drop("_block", *(f"_{c}" for c in measures))


def ends_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: the digest of the decimal ids, ascending, comma-joined, of the conversations that end at a node.

    A digest is sequential, so the ids of one node meet in one task; they come there as strings of thousands of ids, made where the range
    sort left them, and stream through.
    """
    order = [*KEY, "conv"]
    ordered = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    names, types = [*KEY, "first", "ids"], [*[pa.int64()] * 4, pa.string()]

    def joined(batches: Iterator[pa.RecordBatch]):
        key, held, rows = None, [], []

        def close():
            if held:
                rows.append((*key, held[0], ",".join(map(str, held))))
                held.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(held) == ENDS:
                    close()
                    key = k
                held.append(conv)
            if len(rows) >= 1_000:
                yield flush()
        close()
        if rows:
            yield flush()

    def digest(batches: Iterator[pa.RecordBatch]):
        key, sha, rows = None, None, []

        def flush():
            told = [*KEY, "ends_sha256"]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 3, pa.string()], strict=True)], names=told)
            rows.clear()
            return out

        for batch in batches:
            for *k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if len(rows) >= 10_000:
                yield flush()
        if key is not None:
            rows.append((*key, sha.hexdigest()))
            yield flush()

    strings = ordered.mapInArrow(joined, "depth long, ka long, kb long, first long, ids string")
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, ka, kb (with the depth the node's key).
    """
    spark = conversations.sparkSession
    small_batches(spark)
    with Scratch(spark) as put:
        turns = put(summed_turns(conversations, id_col), "trie-turns")
        placed = put(carried(turns), "trie-placed")
        put.drop(turns)
        told = put(plans(placed), "trie-plans")
        members = put(memberships(placed, told), "trie-members")
        put.drop(placed)

        nodes = members.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        root = told.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
        root = root.select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "n_convs", "conv", zero.alias("chars"), none.alias("pa"), none.alias("pb"))
        nodes = put(nodes.unionByName(root), "trie-nodes")
        # the child with most members; among siblings no two have the same smallest member
        kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
        best = F.max(F.struct("n_convs", -F.col("conv"), F.col("ka").alias("heavy_a"), F.col("kb").alias("heavy_b")))
        kids = put(kids.agg(F.count("*").alias("n_children"), best.alias("best")), "trie-kids")
        heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("best.heavy_a").alias("ka"), F.col("best.heavy_b").alias("kb"), F.lit(True).alias("heavy"))
        known = nodes.join(kids.drop("best"), KEY, "left").join(heavy, KEY, "left").fillna(0, "n_children").fillna(False, "heavy")
        known = put(known.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-known")
        put.drop(nodes, kids)

        # chains of nodes with the same members; of a heavy one, the chain above is its parent's, which no other one asks for
        top = F.min(F.struct("depth", "ka", "kb", "pa", "pb", "heavy"))
        chains = put(known.groupBy(*CHAIN).agg(top.alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved")), "trie-chains")
        tops = chains.select(*CHAIN, (F.col("top.depth") - 1).alias("depth"), F.col("top.pa").alias("ka"), F.col("top.pb").alias("kb"), F.col("top.heavy").alias("heavy"))
        above = known.where("n_children > 0").select(*KEY, F.col("conv").alias("up_conv"), F.col("n_convs").alias("up_n"))
        linked = tops.where("heavy").join(above, KEY).select(*CHAIN, "up_conv", "up_n")
        lone = tops.where("not heavy").select(*CHAIN, none.alias("up_conv"), none.alias("up_n"))
        linked = put(linked.unionByName(lone), "trie-linked")
        paths = put(chain_paths(linked, put), "trie-chain-paths")

        # a path is attached to the parent of its first node
        light = tops.where("not heavy and depth >= 0").groupBy(*KEY).agg(F.count("*").alias("attached"))
        branches = put(light.join(above.withColumnsRenamed({"up_conv": "conv", "up_n": "n_convs"}), KEY).join(paths, CHAIN), "trie-branches")
        own = chains.join(paths, CHAIN).groupBy("path_conv", "path_n").agg(F.sum("saved").alias("saved"), F.lit(1).cast("long").alias("leaves"))
        starts = tops.where("not heavy").select(F.col("conv").alias("path_conv"), F.col("n_convs").alias("path_n"), F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"), "ka", "kb")
        given = put(attached_sums(own.join(starts, ["path_conv", "path_n"]), branches, ["saved", "leaves"], put), "trie-given")

        # node arrays of the paths, dealt by blocks of depths
        blocks = F.explode(F.sequence(F.expr(f"top.depth div {BLOCK}"), F.expr(f"bottom div {BLOCK}"))).alias("block")
        dealt = chains.select(*CHAIN, blocks, F.col("top.depth").alias("top_depth")).join(paths, CHAIN)
        rows = known.withColumn("block", F.expr(f"depth div {BLOCK}")).join(dealt, [*CHAIN, "block"]).drop("block")
        rows = rows.join(given.withColumnsRenamed({"saved": "saved_below", "leaves": "leaves"}), KEY, "left").fillna(0, ["saved_below", "leaves"])
        leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
        rows = rows.withColumns({"saved_tokens": F.col("saved") + F.col("saved_below"), "n_leaves": F.col("leaves") + leaf})
        rows = put(suffix_sums(rows, ["path_conv", "path_n"], "depth", ["saved_tokens", "n_leaves"]), "trie-rows")

        # within a chain the parent has the same smallest member; a heavy chain's is known, others ask for the node they are attached to
        first = F.col("depth") == F.col("top_depth")
        up = linked.where("up_conv is not null").select(*CHAIN, "up_conv").unionByName(_attached_members(tops.where("not heavy and depth >= 0"), branches, put))
        firsts = rows.where(first).join(up, CHAIN, "left").withColumn("parent_conv_id", F.col("up_conv")).drop("up_conv")
        rows = firsts.unionByName(rows.where(~first).withColumn("parent_conv_id", F.col("conv")))
        at_root = told.where((F.size("head") == 0) & (F.col("n") <= F.col("h"))).select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "conv")
        digests = put(ends_digests(members.where("ends").select(*KEY, "conv").unionByName(at_root)), "trie-ends")
        rows = rows.join(digests, KEY, "left").fillna(hashlib.sha256().hexdigest(), "ends_sha256")
        return put.keep(put(rows.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "ka", "kb"), "trie-out"))


def _attached_members(tops: DataFrame, branches: DataFrame, put: Scratch) -> DataFrame:
    """conv, n_convs, up_conv of chains attached to a node: the node's smallest member.

    A node may have a third of all chains attached, so such nodes, few by their share, are broadcast.
    """
    told = branches.agg(F.coalesce(F.sum("attached"), F.lit(0))).first()[0]
    limit = max(HOT_LEAST, told * HOT_SHARE)
    node = branches.select(*KEY, F.col("conv").alias("up_conv"), "attached")
    hot, cold = node.where(F.col("attached") > limit).drop("attached"), node.where(F.col("attached") <= limit).drop("attached")
    asked = tops.select(*CHAIN, *KEY)
    by_hot = asked.join(F.broadcast(hot), KEY)
    return by_hot.unionByName(asked.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(cold, KEY)).select(*CHAIN, "up_conv")
