"""N-gram Jaccard join by a size-aware heavy-light scheme.

A text's set holds the hashes of its distinct word shingles. Sets x and y link when
100 * |x & y| >= percent * |x | y|; their overlap is then at least ceil(percent * |x| / 100), and at
least that of y. In any fixed order of shingles, the first l common ones therefore lie in the first
|x| - ceil(percent * |x| / 100) + l of each set, its l-prefix. The order is by frequency, rare first.

Light sets (up to a boundary size) enumerate the fixed-size subsets, here pairs, of their 2-prefix:
linked light sets have a subset in common. Heavy sets scan inverted lists: the lists of the elements
of their 1-prefix hold the heavy sets and those light sets that are large enough to link with one.
The boundary minimises an estimated cost: subsets to enumerate on one side, list entries and the
pairs that lists of their mean length give on the other. Lists grow with the table and the number of a
set's subsets with the square of its size, so above COMMON_SHARE elements, up to which sets have about as many subsets
as elements, the subsets of all sets may be SUBSET_SHARE of the list keys at most: the keys of a text depend on
its size, and not on how many texts there are.

For long texts one common element is often chance, so heavy sets take l = 1 + size / COMMON_SHARE, lengthen
their prefixes by as many elements, and must share l of them. Short lists give their pairs, which are
counted; a long list, of more than LIST_MEMBERS sets, does not need to be expanded: as many edges as it
has members connect all of them. The same holds for members of any list for which l is 1. Linked sets that
share no long list have all l elements in short ones, so no link is lost.

Equal sets are one class from the start. Candidates join to clusters, and no link leads out of a
cluster. A cluster's texts travel once, in blocks of at most BLOCK_SETS or so. In each block all pairs are
verified on their whole sets, and what is linked becomes one group, named by its smallest id. Of
clusters of several blocks the groups' own texts then meet in blocks again, until they fit one block or
hardly merge any more. Only groups that are still apart, of one cluster, are compared member by member, by pairs
of blocks: by marks of a bit or two an element first, and by whole sets where the marks leave a link possible; pairs of one group are not needed. So a group of near copies costs as much as it has texts,
and still every pair of a cluster is verified or known to be connected. Sets are hashed by 64 bits;
one collision needs some 2**32 shingles.

Frequencies only order the shingles and may be rough: they are counted exactly over all texts for shingles
that repeat within a block of texts, into 2**SKETCH_BITS counters, whose logarithms are broadcast (1 MiB).

Defined results: null, empty and white-space texts have no shingles and link with nothing; repeated rows are
classes of equal sets; rows that share an id are one document whose texts all link for it; a null id is never
a component's name; a very long text is hashed whole, alone in its slice; other columns are left aside; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bloom import Bloom, bloom
from lexiloom.llm.vectext import SLICE_BYTES, U64, give_back, mix, shingle_hashes, slices, utf8
from lexiloom.operators.linking import connected_components
from lexiloom.storage import Scratch, small_batches

#: Logarithm of the frequency counters; hashes of a counted block; members of a list that are paired;
#: elements of a set for each further common one that is asked for; texts of a block of a cluster;
#: the most subset keys for each list key; blocks of a wide block, whose members' marks meet.
SKETCH_BITS, BLOCK_HASHES, LIST_MEMBERS, COMMON_SHARE, BLOCK_SETS, SUBSET_SHARE, WIDE_BLOCKS = 20, 2_000_000, 48, 64, 512, 1 / 4, 8


def _sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and hash."""
    hashes, rows, _ = shingle_hashes(raw, offsets, n)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def frequencies(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict[int, int]]:
    """Levels (log2 of the counts) of the shingle counters, and the number of sets by log2 of their size.

    At most 2**SKETCH_BITS sums come to the driver.
    """
    shift = U64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]):
        sizes = np.zeros(64, np.int64)
        held, number = [], 0
        total = np.zeros(1 << SKETCH_BITS, np.int64)

        def count():
            nonlocal held, number
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            np.add.at(total, (hashes[often] >> shift).astype(np.int64), counts[often])
            held, number = [], 0

        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets, SLICE_BYTES):
                rows, hashes = _sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                own = np.bincount(rows, minlength=hi - lo)
                sizes += np.bincount(np.log2(own[own > 0]).astype(int), minlength=64)
                held.append(hashes)
                number += len(hashes)
                if number >= BLOCK_HASHES:
                    count()
        if number:
            count()
        used = np.flatnonzero(total)
        place = np.concatenate([used, -1 - np.flatnonzero(sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.concatenate([total[used], sizes[sizes > 0]]), pa.int64())], names=["place", "n"])

    got = _texts(docs, id_col, text_col).select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, number = got["place"].to_numpy(), got["n"].to_numpy()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    real = place >= 0
    levels[place[real]] = np.log2(number[real]).astype(np.uint8) + 1
    return levels, {int(-1 - p): int(c) for p, c in zip(place[~real], number[~real], strict=True)}


def least_overlap(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * size // 100)


def common_elements(size):
    """How many elements of their prefixes linked heavy sets are asked to share; takes and gives numbers or columns."""
    return 1 + (F.floor(size / COMMON_SHARE) if isinstance(size, Column) else size // COMMON_SHARE)


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The light sets' largest size, among powers of two, with the least estimated cost.

    However long the lists are, no boundary above COMMON_SHARE gives more than SUBSET_SHARE subsets for each key that lists alone would have.
    """
    prefixes = {level: (size := int(1.5 * 2**level)) - least_overlap(size, percent) + 1 for level in sizes}
    listed = sum(number * (prefixes[level] - 1 + common_elements(int(1.5 * 2**level))) for level, number in sizes.items())
    best, chosen = float("inf"), 1
    for at in range(0, 16):
        cost = subsets = 0.0
        for level, number in sizes.items():
            prefix = prefixes[level]
            if int(1.5 * 2**level) <= 2**at:
                cost += number * (prefix + 1) * prefix / 2
                subsets += number * (prefix + 1) * prefix / 2
            else:
                cost += number * prefix * (1 + list_length)
        if cost < best and (2**at <= COMMON_SHARE or subsets <= SUBSET_SHARE * listed):
            best, chosen = cost, 2**at
    return chosen


def signatures(docs: DataFrame, n: int, percent: int, levels: np.ndarray, light: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, class_key (of the whole set; null for the empty set), keys array<long>.

    ``keys`` are subset keys (even) and list keys (odd).
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    shift = U64(64 - SKETCH_BITS)
    small = least_overlap(light + 1, percent)

    def keys_of(own: np.ndarray) -> np.ndarray:
        size = len(own)
        one = size - least_overlap(size, percent) + 1
        out = []
        if size > light or size >= small:
            out.append(own[: one - 1 + common_elements(size)] | U64(1))
        if 2 <= size <= light:
            first, second = np.triu_indices(min(one + 1, size), 1)
            out.append(mix(own[first] * U64(0x9E3779B97F4A7C15) + own[second]) & ~U64(1))
        return np.concatenate(out) if out else np.zeros(0, U64)

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                rows, hashes = _sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                sizes = np.bincount(rows, minlength=hi - lo)
                sums = np.zeros(hi - lo, U64)
                np.add.at(sums, rows, mix(hashes + U64(0x51ED270B)))
                own_key = mix(sums ^ sizes.astype(U64))
                order = np.lexsort((hashes, known[(hashes >> shift).astype(np.int64)], rows))
                hashes = hashes[order]
                edges = np.concatenate([[0], np.cumsum(sizes)])
                keys = [keys_of(hashes[edges[i] : edges[i + 1]]) if sizes[i] else np.zeros(0, U64) for i in range(hi - lo)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                        pa.array(own_key.view(np.int64), mask=sizes == 0),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64))),
                    ],
                    names=["id", "n_shingles", "class_key", "keys"],
                )
        give_back()

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n_shingles long, class_key long, keys array<long>")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows sorted by their first column, a list a key, and whether the first list goes on from before.

    A list of up to LIST_MEMBERS rows is never cut. Of a longer one that is, the first and the last row so far come
    again before the rest of it.
    """
    held: list[np.ndarray] | None = None
    going = False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        long = len(columns[0]) - cut > LIST_MEMBERS or (going and cut == 0)
        if long:
            yield columns, going
            held, going = [c[[cut, -1]] for c in columns], True
        else:
            if cut:
                yield [c[:cut] for c in columns], going
                going = False
            held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held, going


def _list_edges(percent: int, light: int):
    """Candidates of each list, as a < b with the smaller size.

    kind 0: a pair of an inverted list, which counts towards the pair's common elements.
    kind 1: edges enough to connect all members whose sizes allow links, from subsets of light sets,
    from lists of more than LIST_MEMBERS members, and from the members of other lists that need one
    common element. Members come by falling size; if two of them may link by size, so may all neighbours
    between them, so an edge to the first member or else to the one before keeps them connected.
    """

    def told(kind: int, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.stack([np.minimum(a, b), np.maximum(a, b), size], 1)
        if kind:
            rows = np.unique(rows, axis=0)  # most long lists of near copies have the same members
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], names=["kind", "a", "b", "size"])

    def run(batches: Iterator[pa.RecordBatch]):
        for (key, size, node), going in _lists(batches):
            every = np.arange(len(key))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(fresh)
            length = np.diff(np.append(starts, len(key)))
            first, before = np.repeat(starts, length), np.maximum(every - 1, 0)
            long = length > LIST_MEMBERS
            long[0] |= going
            listed = (key & 1) == 1
            whole = np.repeat(long, length) | ~listed
            fits = lambda larger: 100 * size >= percent * size[larger]
            # subsets and long lists: to the first member or the one before; a list without a heavy set has no use
            real = whole & ~fresh & ~(listed & (size[first] <= light))
            ends = [(first, real & fits(first)), (before, real & ~fits(first) & fits(before))]
            # other lists: the first member that needs one common element, which those before it and after it are tied to
            one = size < COMMON_SHARE
            lead = np.repeat(np.minimum.reduceat(np.where(one, every, len(key)), starts), length)
            some = ~whole & (lead < len(key)) & (size[first] > light)
            lead = np.minimum(lead, len(key) - 1)
            real = some & (every > lead)
            ends += [(lead, real & fits(lead)), (before, real & ~fits(lead) & fits(before)), (lead, some & (every < lead) & (100 * size[lead] >= percent * size))]
            smaller = lambda end, real: np.minimum(size[end][real], size[real])
            yield from told(1, *(np.concatenate(x) for x in zip(*((node[end][real], node[real], smaller(end, real)) for end, real in ends), strict=True)))
            at = np.flatnonzero(~whole & (size > light))
            for d in range(1, LIST_MEMBERS):
                at = at[at + d < len(key)]
                at = at[(key[at] == key[at + d]) & (100 * size[at + d] >= percent * size[at]) & ~one[at + d]]
                if not len(at):
                    break
                yield from told(0, node[at], node[at + d], size[at + d])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, by scanning the lists of their common elements."""
    sizes = [len(x) for x in (*left, *right)]
    elements, place = np.unique(np.concatenate([*left, *right]) if sizes else np.zeros(0, U64), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(place, minlength=len(elements)) > 1
    column = np.cumsum(common) - 1
    kept = common[place]
    row, place = row[kept], column[place[kept]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(common.sum()), 4_096):
        lo, hi = np.searchsorted(place, (at, at + 4_096))
        width = int(place[hi - 1]) - at + 1
        dense = np.zeros((len(sizes), width), np.float32)
        dense[row[lo:hi], place[lo:hi] - at] = 1
        total += dense[: len(left)] @ dense[len(left) :].T
    return total.astype(np.int64)


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(smallest, other) of all that the edges connect."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (u := find(x)) != (v := find(y)):
            top[max(u, v)] = min(u, v)
    return np.array([(find(x), x) for x in list(top) if find(x) != x], np.int64).reshape(-1, 2)


def _block_links(n: int, percent: int):
    """(a, b): of the labels that one pair of blocks links, the smallest of what is connected and each other one."""

    def pair(alone: bool, labels: list[int], sides: list[int], texts: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        sets = []
        for lo, hi in slices(offsets, SLICE_BYTES):
            rows, hashes = _sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
            sets += np.split(hashes, np.searchsorted(rows, np.arange(1, hi - lo)))
        at = np.array(labels)
        side = np.array(sides)
        one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        two = one if alone else two
        if not len(one) or not len(two):
            return np.zeros((0, 2), np.int64)
        size = np.array([len(x) for x in sets])
        both = overlaps([sets[i] for i in one], [sets[i] for i in two])
        linked = 100 * both >= percent * (size[one][:, None] + size[two][None, :] - both)
        linked &= at[one][:, None] != at[two][None, :]
        x, y = np.nonzero(linked)
        met = np.unique(np.stack([np.minimum(at[one[x]], at[two[y]]), np.maximum(at[one[x]], at[two[y]])], 1), axis=0)
        return _stars(met[:, 0], met[:, 1])

    def run(batches: Iterator[pa.RecordBatch]):
        key, labels, sides, texts, seen = None, [], [], [], set()
        out: list[np.ndarray] = []

        def flush():
            columns = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.T], names=["a", "b"])

        for batch in batches:
            for cluster, i, j, side, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (cluster, i, j):
                    if len(labels) > 1:
                        out.append(pair(key[1] == key[2], labels, sides, texts))
                        if len(out) > 200:
                            yield flush()
                    key, labels, sides, texts, seen = (cluster, i, j), [], [], [], set()
                text = text.encode()
                if (label, text) not in seen:
                    seen.add((label, text))
                    labels.append(label)
                    sides.append(side)
                    texts.append(text)
        if len(labels) > 1:
            out.append(pair(key[1] == key[2], labels, sides, texts))
        yield flush()

    return run


def _marks(n: int):
    """(id, size, mark) of texts: a mark has as many bits as the set has elements, or more up to the next power of two, and tells for each
    bit whether an odd number of elements falls on it. Two marks differ in no more bits than their sets do in elements, also when
    the longer is folded to the length of the shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                rows, hashes = _sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                sizes = np.bincount(rows, minlength=hi - lo)
                bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(bits)])
                place = ends[rows] + (mix(hashes) & (bits[rows] - 1).astype(U64)).astype(np.int64)
                odd = np.packbits((np.bincount(place, minlength=ends[-1]) & 1).astype(np.uint8))
                marks = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(odd)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), marks], names=["id", "size", "mark"])
        give_back()

    return run


def _possible_links(percent: int):
    """(component, i, j, side, node, label): of each pair of wide blocks the blocks i, j, and of these the members, that may link by sizes and marks.

    With an overlap that links, sets of x and y elements differ in (100 - percent) / (100 + percent) of x + y elements at most.
    """

    def folded(rows: np.ndarray, words: int) -> np.ndarray:
        while rows.shape[1] > words:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def met(alone: bool, side: np.ndarray, block: np.ndarray, label: np.ndarray, size: np.ndarray, marks: list[bytes]) -> np.ndarray:
        """i, j, side, member of the possible links."""
        names, own = np.unique(block, return_inverse=True)
        found = np.zeros((len(own), len(names)), bool)
        words = np.array([len(m) // 8 for m in marks])
        every = np.arange(len(own))
        order = np.argsort(size, kind="stable")
        groups = {w: (at := order[words[order] == w], np.frombuffer(b"".join(marks[k] for k in at), U64).reshape(len(at), w)) for w in np.unique(words).tolist()}
        for v, (left, first) in groups.items():
            for w, (right, second) in groups.items():
                left_on, right_on = (every[: len(left)], every[: len(right)]) if alone else (np.flatnonzero(side[left] == 0), np.flatnonzero(side[right] == 1))
                if not len(left_on) or not len(right_on):
                    continue
                a, b = folded(first[left_on], min(v, w)), folded(second[right_on], min(v, w))
                at, to = left[left_on], right[right_on]
                low = size[at] if alone else -(-percent * size[at] // 100)
                lows, highs = np.searchsorted(size[to], low, "left"), np.searchsorted(size[to], 100 * size[at] // percent, "right")
                for k in np.flatnonzero(lows < highs).tolist():
                    x, near = at[k], slice(lows[k], highs[k])
                    differ = np.bitwise_count(b[near] ^ a[k]).sum(1, dtype=np.int64)
                    hit = to[near][((100 + percent) * differ <= (100 - percent) * (size[to[near]] + size[x])) & (label[to[near]] != label[x])]
                    found[x, own[hit]] = True
                    found[hit, own[x]] = True
        member, other = np.nonzero(found)
        i, j = names[own[member]], names[other]
        later = i > j if alone else side[member] == 1
        return np.stack([np.where(later, j, i), np.where(later, i, j), later, member], 1)

    def run(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def told():
            side, block, node, label, size, marks = zip(*held, strict=True)
            component, wide, other = key
            rows = met(wide == other, np.array(side), np.array(block), np.array(label), np.array(size), marks)
            node, label = np.array(node), np.array(label)
            for at in range(0, len(rows), 50_000):
                i, j, later, member = rows[at : at + 50_000].T
                columns = (np.full(len(i), component), i, j, later.astype(np.int32), node[member], label[member])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["component", "i", "j", "side", "node", "label"])

        for batch in batches:
            for *place, side, block, node, label, size, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != tuple(place):
                    if len(held) > 1:
                        yield from told()
                    key, held = tuple(place), []
                held.append((side, block, node, label, size, mark))
        if len(held) > 1:
            yield from told()
        give_back()

    return run


def _passing(texts: DataFrame, wanted: Bloom) -> DataFrame:
    """The rows whose ids pass the filter."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(sent.value.passing(batch.column(0).to_numpy())))

    return texts.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, "id long, text string")


def candidates(classes: DataFrame, percent: int, light: int) -> DataFrame:
    """a, b: edges between classes (key arrays ``keys``) that connect all that may link."""
    listed = classes.select(F.explode("keys").alias("key"), "size", "node").repartition("key").sortWithinPartitions("key", F.desc("size"), "node")
    found = listed.mapInArrow(_list_edges(percent, light), "kind int, a long, b long, size long").groupBy("kind", "a", "b", "size").count()
    return found.where((F.col("kind") == 1) | (F.col("count") >= common_elements(F.col("size")))).select("a", "b").where("a <> b").distinct()


def verified(put: Scratch, texts: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b of ``_block_links`` for the texts of ``placed``: component, i, j, side, node, label; i, j names a pair of blocks."""
    met = _passing(texts, bloom(placed.select("node"))).join(placed, F.col("id") == F.col("node"))
    met = met.select("component", "i", "j", "side", "label", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "label")
    return put(met.mapInArrow(_block_links(n, percent), "a long, b long"), "jaccard-links")


def _relabelled(labels: DataFrame, stars: DataFrame) -> DataFrame:
    moved = stars.select(F.col("a").alias("to"), F.col("b").alias("label"))
    return labels.join(moved, "label", "left").select("component", "node", F.coalesce("to", "label").alias("label"))


def _apart(put: Scratch, texts: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame:
    """component, i, j, side, node, label: the pairs of blocks in which members of groups of one cluster that are still apart may link.

    Groups of BLOCK_SETS members have blocks of their own, which are not compared with one another; the
    others of a cluster share blocks. Marks of the sets meet in wide blocks, of WIDE_BLOCKS blocks, so a text is read once here,
    and its mark travels as often as its cluster has wide blocks; what the marks leave possible is all that meets with its text.
    """
    wide = labels.join(labels.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("component"), "component", "left_semi")
    sizes = wide.groupBy("component", "label").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= BLOCK_SETS)
    pooled = sizes.where("not own").groupBy("component").agg(F.sum("n").alias("pool"))
    sizes = sizes.join(pooled, "component", "left").withColumn("blocks", F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("pool")) / BLOCK_SETS))
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    group = F.when(F.col("own"), F.col("label"))
    named = wide.join(sizes.select("component", "label", "own", "blocks"), ["component", "label"]).select(
        "component", "node", "label", group.alias("group"), F.xxhash64("component", group, part).alias("block"), F.xxhash64("component", group, F.floor(part / WIDE_BLOCKS), F.lit(1)).alias("wide")
    )
    named = put(named, "jaccard-apart")
    if named.isEmpty():
        return named
    marked = _passing(texts, bloom(named.select("node"))).mapInArrow(_marks(n), "id long, size long, mark binary")
    marked = put(named.join(marked, F.col("id") == F.col("node")).where("size > 0").select(*named.columns, "size", "mark").distinct(), "jaccard-marks")
    blocks = named.select("component", "group", "wide").distinct()
    other = blocks.select("component", F.col("group").alias("other"), F.col("wide").alias("j"))
    pairs = blocks.withColumnRenamed("wide", "i").join(other, "component").where("i <= j and (group is null or other is null or group <> other)").select("component", "i", "j")
    met = pairs.select("component", "i", "j", F.lit(0).alias("side"), F.col("i").alias("wide")).unionByName(pairs.where("i <> j").select("component", "i", "j", F.lit(1).alias("side"), F.col("j").alias("wide")))
    met = marked.join(met, ["component", "wide"]).select("component", "i", "j", "side", "block", "node", "label", "size", "mark")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return put(met.mapInArrow(_possible_links(percent), "component long, i long, j long, side int, node long, label long"), "jaccard-pairs")


def linked_labels(put: Scratch, texts: DataFrame, clusters: DataFrame, n: int, percent: int) -> DataFrame:
    """component, node, label: the smallest node that a node of a cluster reaches by links; its tables are of ``put``."""
    labels = clusters.select("component", "node", F.col("node").alias("label"))
    groups, several, level = clusters, None, 0
    while True:
        counts = groups.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
        placed = groups.join(counts, "component").withColumn("i", F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("members") / BLOCK_SETS)))
        placed = put(placed, "jaccard-blocks")
        stars = verified(put, texts, placed.select("component", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("label")), n, percent)
        labels = put(_relabelled(labels, stars), "jaccard-labels")
        wide = placed.where(F.col("members") > BLOCK_SETS)
        before = wide.count()
        if several is None:
            if not before:
                return labels
            several = put(wide.select("component").distinct(), "jaccard-several")
        if not before:
            break
        groups = put(wide.join(stars, F.col("node") == F.col("b"), "left_anti").select("component", "node"), "jaccard-groups")
        level += 1
        if groups.count() * 2 > before:
            break
    pairs = _apart(put, texts, labels.join(several, "component", "left_semi"), n, percent)
    if pairs.isEmpty():
        return labels
    last = connected_components(verified(put, texts, pairs, n, percent), "a", "b", put)
    return put(_relabelled(labels, last.select(F.col("component").alias("a"), F.col("node").alias("b"))), "jaccard-labels")


def _shared_ids(every: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: edges between the classes of each id that has texts of several."""
    known = every.where("class_key is not null and id is not null").select("id", "class_key")
    several = known.groupBy("id").agg(F.min("class_key").alias("low"), F.max("class_key").alias("high")).where("low <> high").select("id")
    nodes = known.join(several, "id", "left_semi").join(classes.select("class_key", "node"), "class_key").select("id", "node").distinct()
    first = nodes.groupBy("id").agg(F.min("node").alias("a"))
    return nodes.join(first, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def similar_classes(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable by links).

    One row for each text.
    """
    small_batches(docs.sparkSession)
    levels, sizes = frequencies(docs, n, id_col, text_col)
    seen = levels[levels > 0].astype(float)
    light = boundary(sizes, float(np.exp2(seen - 1).mean()) if len(seen) else 1.0, percent)
    with Scratch(docs.sparkSession) as put:
        every = put(signatures(docs, n, percent, levels, light, id_col, text_col), "jaccard-sets")
        classes = put(
            every.where("class_key is not null and id is not null").groupBy("class_key")
            .agg(F.min("id").alias("node"), F.first("n_shingles").alias("size"), F.min_by("keys", "id").alias("keys")),
            "jaccard-classes",
        )
        clusters = connected_components(candidates(classes, percent, light), "a", "b", put)
        components = linked_labels(put, _texts(docs, id_col, text_col), clusters, n, percent).select("node", F.col("label").alias("component_id"))
        components = classes.select("node").distinct().join(components, "node", "left").select("node", F.coalesce("component_id", "node").alias("component_id"))
        shared = put(_shared_ids(every, classes), "jaccard-shared")
        if not shared.isEmpty():
            tied = components.select(F.col("component_id").alias("a"), F.col("node").alias("b")).unionByName(shared)
            components = connected_components(tied, "a", "b", put).withColumnRenamed("component", "component_id")
        told = classes.select("class_key", "node").join(components, "node", "left")
        told = put(told.select("class_key", F.col("node").alias("class_id"), F.coalesce("component_id", "node").alias("component_id")), "jaccard-told")
        told = every.select("id", "n_shingles", "class_key").join(told, "class_key", "left").select(
            F.col("id").alias(id_col), "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")
        )
        return put.keep(put(told, "jaccard-found"))
