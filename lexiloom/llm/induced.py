"""External suffix sorting by induction, with the lengths of common prefixes.

Suffixes are of type S if smaller than their successor, else of type L; the leftmost of each run of S
suffixes (LMS) seed the sort. From sorted seeds, one ascending pass induces all L suffixes and one
descending pass all S suffixes: whoever comes next in order sends its predecessor in the text to a
priority queue by (first character, order of arrival). The descending pass is the ascending one over
the complemented alphabet.

A queue's tuples are (character, place, common prefix with the tuple before it in its bucket). The last is
carried through both passes: two suffixes that are induced one after the other into a bucket share one
character more than their successors do, which is the least common prefix between those in order. It is counted
up to ``cap`` characters.

The seeds are sorted by recursion. The strings between seeds are sorted by their characters and named in order;
if names repeat, the string of names is sorted the same way, for any number of distinct names. The common
prefixes of its suffixes come back as characters of the text.

Memory. The queue is parted by ranges of characters that are chosen from a sample of the text; a pass holds one
range at a time, and the others' tuples, as all arrays of the sort (text, seeds, both lists, the result), are
in memory up to the budget of their ``Store`` and beyond it in files of a scratch folder, read and written in
blocks. Of a range, a batch of tuples is taken at once, with what they induce among themselves for up to DEPTH
generations, which is put into order by its parents; a batch ends before the first tuple that is not known by
then. So a pass is a row of array operations for alphabets of any size.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of arrays and queues that a sort holds in memory, and tuples of a block of an array that is worked on at once.
BUDGET, BLOCK = 128 << 20, 1 << 17
#: Tuples of a batch of a pass, and generations that are induced within it.
BATCH, DEPTH = 1 << 15, 128


class Store:
    """Arrays of a sort: in memory up to a budget of bytes, beyond it in files that go with the store."""

    def __init__(self, budget: int | None = None):
        self.left = BUDGET if budget is None else budget
        self.folder: tempfile.TemporaryDirectory | None = None
        self.number = 0
        self.held: dict[int, tuple[np.ndarray, int, str | None]] = {}

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.number += 1
        return os.path.join(self.folder.name, str(self.number))

    def empty(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            out, path = np.empty(n, kind), None
            self.left -= size
        else:
            path = self.path()
            out = np.memmap(path, kind, "w+", shape=(n,))
        self.held[id(out)] = (out, size, path)
        return out

    def free(self, *arrays: np.ndarray) -> None:
        for array in arrays:
            _, size, path = self.held.pop(id(array), (None, 0, None))
            if path is None:
                self.left += size
            else:
                os.unlink(path)

    def close(self) -> None:
        self.held.clear()
        if self.folder is not None:
            self.folder.cleanup()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def place_type(n: int) -> type:
    """The smaller integer type that holds places of a text of n characters."""
    return np.int32 if n < 2**31 - 1 else np.int64


def blocks(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = BLOCK if size is None else size
    for at in range(0, n, size):
        yield at, min(at + size, n)


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers from 0 on, by radix passes of 16 bits where two are enough."""
    top = int(values.max()) if len(values) else 0
    if top >= 1 << 32:
        return np.argsort(values, kind="stable")
    order = np.argsort(values.astype(np.uint16), kind="stable")
    return order if top < 1 << 16 else order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]


class Queue:
    """The priority queue of a pass: tuples in order of arrival for each range of characters.

    They are in memory while the store has room, else in one file, by parts.
    """

    def __init__(self, store: Store, edges: np.ndarray, kind: type, top: int):
        self.store, self.edges, self.kind = store, edges, kind
        # the range of each character, where a table of them is small
        self.range_of = np.repeat(np.arange(len(edges), dtype=np.int16), np.diff(np.append(edges, top + 1))) if top < 1 << 20 else None
        self.parts: list[list] = [[] for _ in edges]
        self.waiting: list[tuple] = []
        self.count, self.file, self.bytes = 0, None, 0

    def push(self, characters: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        if len(characters):
            self.waiting.append((characters, places, common))
            self.count += len(characters)
            if self.count > BLOCK:
                self.deal()

    def deal(self) -> None:
        if not self.count:
            return
        columns = [np.concatenate(c) for c in zip(*self.waiting, strict=True)]
        self.waiting, self.count = [], 0
        of = (np.searchsorted(self.edges, columns[0], side="right") - 1).astype(np.int16) if self.range_of is None else self.range_of[columns[0]]
        order = np.argsort(of, kind="stable")
        of, columns = of[order], [c[order] for c in columns]
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = [c[a:b].copy() for c in columns]
            size = sum(c.nbytes for c in own)
            if size > self.store.left:
                if self.file is None:
                    self.file = open(self.store.path(), "w+b")  # noqa: SIM115
                start = self.file.seek(0, 2)
                for c in own:
                    self.file.write(c)
                self.parts[of[a]].append((start, b - a))
            else:
                self.store.left -= size
                self.parts[of[a]].append(own)

    def pop(self, at: int) -> list[np.ndarray]:
        """All tuples of a range; it is empty then."""
        self.deal()
        found = []
        for part in self.parts[at]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                found.append([np.fromfile(self.file, kind, part[1]) for kind in (np.int64, self.kind, np.uint8)])
            else:
                self.store.left += sum(c.nbytes for c in part)
                found.append(part)
        self.parts[at] = []
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.uint8)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b of which ``known`` characters are, up to ``cap``; no suffix is a prefix of another."""
    out = np.minimum(known, cap).astype(np.int64)
    going = np.flatnonzero(out < cap)
    while len(going):
        same = text[a[going] + out[going]] == text[b[going] + out[going]]
        going = going[same]
        out[going] += 1
        going = going[out[going] < cap]
    return out


class _Least:
    """Least values of ranges of an array, of at most ``widest`` values: for each power of two, those of all ranges of that length."""

    def __init__(self, values: np.ndarray, widest: int):
        rows, width, starts = [values], 1, [0]
        while 2 * width <= widest:
            starts.append(starts[-1] + len(rows[-1]))
            rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        self.flat, self.starts = np.concatenate(rows), np.array(starts)

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low:high]) of each pair, low < high."""
        level = np.frexp(high - low)[1] - 1
        row = self.starts[level]
        return np.minimum(self.flat[row + low], self.flat[row + high - (1 << level)])


class _Carried:
    """Common prefixes of what is induced, over all batches of a pass.

    ``targets`` are the buckets that the suffixes of the character at hand have sent to so far, and
    ``least`` the least common prefix between sources since then.
    """

    def __init__(self, cap: int):
        self.cap = cap
        self.targets, self.least = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def batch(self, at: np.ndarray, target: np.ndarray) -> None:
        """Start a batch: the places of its sources and the buckets that they send to."""
        order = stable_order(target)
        self.at, self.own = at[order], target[order]
        first = np.ones(len(at), bool)
        first[1:] = self.own[1:] != self.own[:-1]
        # of each source, where the range since the one before it that sent to the bucket starts and stops
        low, self.stop = np.zeros(len(at), np.int64), at + 1
        low[1:] = self.at[:-1] + 1
        self.start = np.empty(len(at), np.int64)
        self.start[order] = low
        #: -1: in the batch; -2: nowhere that matters; else the place of the bucket in ``targets``
        known = np.full(len(at), -1)
        opening = np.flatnonzero(first)
        if len(self.targets):
            place = np.minimum(np.searchsorted(self.targets, self.own[opening]), len(self.targets) - 1)
            known[opening] = np.where(self.targets[place] == self.own[opening], place, -2)
        else:
            known[opening] = -2
        self.known = np.empty(len(at), np.int64)
        self.known[order] = known
        inside = self.known == -1
        self.widest = int((self.stop - self.start)[inside].max()) if inside.any() else 1

    def shared(self, between: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """For each source, or those named, the common prefix of what it sends with the tuple sent to that bucket before.

        ``between`` are the common prefixes of neighbouring sources, 0 where the first character changes.
        """
        start, stop, known = (self.start, self.stop, self.known) if which is None else (self.start[which], self.stop[which], self.known[which])
        shared = np.zeros(len(start), np.uint8)
        inside, opening = np.flatnonzero(known == -1), np.flatnonzero(known >= 0)
        if len(inside):
            shared[inside] = _Least(between, self.widest).between(start[inside], stop[inside])
        if len(opening):
            shared[opening] = np.minimum(self.least[known[opening]], np.minimum.accumulate(between)[stop[opening] - 1])
        return np.minimum(shared, self.cap - 1) + 1

    def end(self, between: np.ndarray) -> None:
        """End the batch."""
        zeros = np.flatnonzero(between == 0)
        last = np.ones(len(self.at), bool)
        last[:-1] = self.own[1:] != self.own[:-1]
        if len(zeros):
            last &= self.at >= zeros[-1]
        sent = self.own[last]
        after = np.append(np.minimum.accumulate(between[::-1])[::-1], np.uint8(self.cap))
        least = after[self.at[last] + 1]
        if not len(zeros) and len(self.targets):
            old = ~np.isin(self.targets, sent)
            targets = np.concatenate([self.targets[old], sent])
            least = np.concatenate([np.minimum(self.least[old], after[0]), least])
            order = np.argsort(targets)
            self.targets, self.least = targets[order], least[order]
        else:
            self.targets, self.least = sent, least


class _Batch:
    """Tuples that come next in a pass, with what they induce among themselves, in order.

    ``key`` is twice the character, and one more for seeds; ``parent`` of an induced tuple is the place of its
    source. The first ``take`` tuples are final.
    """

    def __init__(self, sent_of, key: np.ndarray, place: np.ndarray, common: np.ndarray, limit: int, depth: int):
        n = len(key)
        keys, places, parents = [key], [place], [np.full(n, -1)]
        sent = sent_of(place)
        goes = (sent >= (key >> 1) + (key & 1)) & (place > 0)
        sents, all_go = [sent], [goes]
        ahead = np.flatnonzero(goes & (2 * sent <= limit))
        ahead_sent, ahead_place = sent[ahead], place[ahead]
        total, generations = n, 0
        while len(ahead) and generations < depth:
            place, own = ahead_place - 1, ahead_sent
            sent = sent_of(place)
            goes = (sent >= own) & (place > 0)
            for to, x in ((keys, 2 * own), (places, place), (parents, ahead), (sents, sent), (all_go, goes)):
                to.append(x)
            inside = np.flatnonzero(goes & (2 * sent <= limit))
            ahead, ahead_sent, ahead_place = inside + total, sent[inside], place[inside]
            total += len(own)
            generations += 1
        self.whole = not len(ahead)
        end = int(2 * ahead_sent.min()) if len(ahead) else -1
        if generations:
            self.key, self.place, parent, self.sent, self.goes = (np.concatenate(x) for x in (keys, places, parents, sents, all_go))
            self._put_in_order(n, parent, generations)
        else:
            self.key, self.place, self.sent, self.goes = key, place, sents[0], all_go[0]
            self.parent, self.old = parents[0], np.ones(n, bool)
        self.take = total
        if not self.whole:
            upto = int(np.searchsorted(self.key, end, side="left"))
            stop = int(np.searchsorted(self.key, end, side="right"))
            self.take = upto + int(self.old[upto:stop].sum())
        self.common = np.zeros(total, np.uint8)
        self.common[self.old] = common

    def _put_in_order(self, n: int, parent: np.ndarray, generations: int) -> None:
        made = len(parent) - n
        key, parent = self.key[n:], parent[n:]
        after = (np.searchsorted(self.key[:n], key, side="right") - 1) * (made + 1) + 1
        place = np.concatenate([np.arange(n) * (made + 1), after])
        for _ in range(generations):
            order = np.lexsort((place[parent], key))
            rank = np.empty(made, np.int64)
            rank[order] = np.arange(made)
            if np.array_equal(place[n:], after + rank):
                break
            place[n:] = after + rank
        order = np.argsort(place)
        self.old = order < n
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        self.parent = np.full(len(order), -1)
        self.parent[at[n:]] = at[parent]
        for name in ("key", "place", "sent", "goes"):
            setattr(self, name, getattr(self, name)[order])


def _edges(text: np.ndarray, top: int, flipped: bool) -> np.ndarray:
    """The first characters of the ranges of a queue, from a sample of the text."""
    n = len(text)
    ranges = min(4_096, max(n >> 18, min(32, n >> 12))) + 1
    sample = np.sort(np.asarray(text[:: max(1, n >> 16)]).astype(np.int64))
    if flipped:
        sample = (top - sample)[::-1]
    return np.unique(np.concatenate([[0], sample[np.linspace(0, len(sample) - 1, ranges).astype(int)]]))


def induce(store: Store, text: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], count: int, top: int, flipped: bool, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places, common prefixes, characters of the ``count`` suffixes that one pass induces, in its order.

    ``seeds`` are the same of the seeds, whose characters ascend; after those induced in each bucket come its seeds.
    With ``flipped``, characters count as ``top`` less their value, which turns the pass around.
    """
    kind = place_type(len(text))
    seed_place, seed_common, seed_character = seeds
    out = store.empty(count, kind), store.empty(count, np.uint8), store.empty(count, np.int32 if top < 2**31 else np.int64)
    edges = _edges(text, top, flipped)
    queue, carried = Queue(store, edges, kind, top), _Carried(cap)
    written, last_key, last_place, depth = 0, -1, 0, DEPTH

    def sent_of(places: np.ndarray) -> np.ndarray:
        sent = text[np.maximum(places - 1, 0)].astype(np.int64)
        return top - sent if flipped else sent

    for r in range(len(edges)):
        high = int(edges[r + 1]) if r + 1 < len(edges) else top + 1
        character, place, common = queue.pop(r)
        lo, hi = np.searchsorted(seed_character, edges[r]), np.searchsorted(seed_character, high)
        key = np.concatenate([2 * character, 2 * seed_character[lo:hi].astype(np.int64) + 1])
        place, common = np.concatenate([place, seed_place[lo:hi]]), np.concatenate([common, seed_common[lo:hi]])
        order = stable_order(key - 2 * edges[r])
        key, place, common = key[order], place[order], common[order]
        del character, order
        late = [np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.uint8)]
        m = 0
        while m < len(key) or len(late[0]):
            e = min(m + BATCH, len(key))
            cut, limit = len(late[0]), 2 * high - 1
            if e < len(key):
                whole = key[e] != key[e - 1]
                limit = int(key[e - 1]) if whole else int(key[e - 1]) - 1
                cut = int(np.searchsorted(late[0], limit, side="right"))
            if cut > BATCH:
                cut = BATCH
                limit = int(late[0][cut - 1]) - 1
                e = min(e, max(m, int(np.searchsorted(key, limit + 1, side="right"))))
            first = [x[m:e] for x in (key, place, common)]
            mine = None
            if cut:
                first = [np.concatenate([x, y[:cut]]) for x, y in zip(first, late, strict=True)]
                mine = stable_order(first[0] - 2 * edges[r])
                first = [x[mine] for x in first]
            batch = _Batch(sent_of, *first, limit, depth)
            depth = min(DEPTH, 2 * depth + 1) if batch.whole else 0
            take = batch.take
            old = int(batch.old[:take].sum())
            own = old if mine is None else int((mine[:old] < e - m).sum())
            m += own
            late = [x[old - own :] for x in late]
            k, p, sent, goes, parent = batch.key[:take], batch.place[:take], batch.sent[:take], batch.goes[:take], batch.parent[:take]
            between = batch.common[:take].copy()
            same = np.empty(take, bool)
            same[0] = last_key >= 0 and k[0] >> 1 == last_key >> 1
            same[1:] = k[1:] >> 1 == k[:-1] >> 1
            turn = same.copy()
            turn[0] &= last_key != k[0]
            turn[1:] &= k[1:] != k[:-1]
            between[~same] = 0
            turn = np.flatnonzero(turn)
            if len(turn):
                left = np.where(turn > 0, p[turn - 1], last_place)
                between[turn] = extended(text, left, p[turn], np.ones(len(turn), np.int64), cap)
            at = np.flatnonzero(goes)
            kept = np.ones(len(at), bool)
            carried.batch(at, sent[at])
            made = np.flatnonzero(parent >= 0)
            if len(made):
                source = np.searchsorted(at, parent[made])
                kept[source] = False
                made, source = made[same[made]], source[same[made]]
                between[made] = cap
                # what is induced within the batch depends on what comes before it only, so this ends
                while not np.array_equal(shared := carried.shared(between, source), between[made]):
                    between[made] = shared
            shared = carried.shared(between)
            carried.end(between)
            last_key, last_place = int(k[-1]), int(p[-1])
            told = np.flatnonzero((k & 1) == 0)
            stop = written + len(told)
            out[0][written:stop], out[1][written:stop], out[2][written:stop] = p[told], between[told], k[told] >> 1
            written = stop
            at, shared = at[kept], shared[kept]
            sent, p = sent[at], (p[at] - 1).astype(kind)
            here = sent < high
            if here.any():
                late = [np.concatenate(x) for x in zip(late, (2 * sent[here], p[here], shared[here]), strict=True)]
                order = stable_order(late[0] - 2 * edges[r])
                late = [x[order] for x in late]
            queue.push(sent[~here], p[~here], shared[~here])
    queue.close()
    return out


def seeds_of(store: Store, text: np.ndarray) -> tuple[np.ndarray, int]:
    """The LMS places in ascending order, and the number of L suffixes; the text ends with a unique smallest character."""
    n = len(text)
    found: list[np.ndarray] = [np.array([n - 1])]
    larger, is_s = 0, True
    for a, b in reversed(list(blocks(n - 1))):
        own, following = text[a:b], text[a + 1 : b + 1]
        at = np.where(own != following, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        small = np.append(own < following, is_s)[at]
        larger += int((~small).sum())
        if b < n - 1 and is_s and not small[-1]:
            found.append(np.array([b]))
        found.append(np.flatnonzero(small[1:] & ~small[:-1]) + 1 + a)
        is_s = bool(small[0])
    total = sum(len(x) for x in found)
    out, at = store.empty(total, place_type(n)), 0
    for part in reversed(found):
        out[at : at + len(part)] = part
        at += len(part)
    return out, larger


def _packed(text: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int, per: int) -> np.ndarray:
    """``per`` characters from each start as one number; beyond its stop a character larger than all."""
    word = np.zeros(len(start), np.uint64)
    for k in range(per):
        at = start + k
        character = np.where(at <= stop, text[np.minimum(at, len(text) - 1)], (1 << bits) - 1)
        word = (word << np.uint64(bits)) | character.astype(np.uint64)
    return word


def _merged(words: np.ndarray, items: np.ndarray, runs: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the merged sorted runs of two arrays on disk or in memory."""
    heads, step = [a for a, _ in runs], max(1_024, BLOCK // max(1, len(runs)))
    while any(h < b for h, (_, b) in zip(heads, runs, strict=True)):
        ends = [min(h + step, b) for h, (_, b) in zip(heads, runs, strict=True)]
        bound = min(words[e - 1] for h, e in zip(heads, ends, strict=True) if h < e)
        cuts = [h + int(np.searchsorted(words[h:e], bound, side="right")) for h, e in zip(heads, ends, strict=True)]
        w = np.concatenate([words[h:c] for h, c in zip(heads, cuts, strict=True)])
        i = np.concatenate([items[h:c] for h, c in zip(heads, cuts, strict=True)])
        order = np.argsort(w)
        heads = cuts
        yield w[order], i[order]


def _refined(text: np.ndarray, start: np.ndarray, stop: np.ndarray, group: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and group numbers of strings that are in order, and grouped, by their first ``per`` characters."""
    order, depth = np.arange(len(start)), per
    while True:
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(edges, len(group)))
        longest = np.maximum.reduceat((stop - start)[order] + 1, edges)
        open_ = np.flatnonzero(np.repeat((sizes > 1) & (longest > depth), sizes))
        if not len(open_):
            return order, group
        own = order[open_]
        word = _packed(text, start[own] + depth, stop[own], bits, per)
        place = np.lexsort((word, group[open_]))
        order[open_] = own[place]
        word = word[place]
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        fresh[open_[1:]] |= (word[1:] != word[:-1]) & (open_[1:] == open_[:-1] + 1)
        group = np.cumsum(fresh)
        depth += per


def named(store: Store, text: np.ndarray, characters: int, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the strings from each seed to the next, the name of each by its place in the text, and the number of names."""
    bits = int(characters).bit_length()
    per = max(1, 63 // bits)
    total = len(lms)
    words, items = store.empty(total, np.uint64), store.empty(total, lms.dtype)
    runs = list(blocks(total, 4 * BLOCK))

    def string(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lms[i].astype(np.int64), lms[np.minimum(i + 1, total - 1)].astype(np.int64)

    for a, b in runs:
        word = _packed(text, *string(np.arange(a, b)), bits, per)
        order = np.argsort(word)
        words[a:b], items[a:b] = word[order], order + a
    order, names = store.empty(total, lms.dtype), store.empty(total, place_type(total))
    at, last, held_w, held_i = 0, -1, np.zeros(0, np.uint64), np.zeros(0, lms.dtype)

    def settle(w: np.ndarray, i: np.ndarray) -> None:
        nonlocal at, last
        start, stop = string(i)
        place, group = _refined(text, start, stop, np.concatenate([[0], np.cumsum(w[1:] != w[:-1])]), bits, per)
        rank = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) + last + 1
        order[at : at + len(i)], names[i[place]] = i[place], rank
        at, last = at + len(i), int(rank[-1])

    # a group of strings with equal first characters is never cut
    for w, i in _merged(words, items, runs):
        w, i = np.concatenate([held_w, w]), np.concatenate([held_i, i])
        cut = int(np.searchsorted(w, w[-1], side="left"))
        if cut:
            settle(w[:cut], i[:cut])
        held_w, held_i = w[cut:], i[cut:]
    if len(held_w):
        settle(held_w, held_i)
    store.free(words, items)
    return order, names, last + 1


def _sorted_seeds(store: Store, text: np.ndarray, characters: int, lms: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places, common prefixes and characters of the seeds in order."""
    order, names, number = named(store, text, characters, lms)
    common = None
    if number < len(lms):
        store.free(order)
        order, common = suffix_order(store, names, number, cap // 2 + 1)
    place, shared, character = store.empty(len(lms), lms.dtype), store.empty(len(lms), np.uint8), store.empty(len(lms), np.int64 if characters >= 2**31 else np.int32)
    for a, b in blocks(len(lms)):
        i = np.asarray(order[a:b]).astype(np.int64)
        at = lms[i].astype(np.int64)
        previous = np.append(place[a - 1] if a else at[0], at[:-1])
        known = np.zeros(len(i), np.int64) if common is None else lms[np.minimum(i + common[a:b], len(lms) - 1)] - at
        found = extended(text, previous[1:], at[1:], known[1:], cap)
        first = extended(text, previous[:1], at[:1], known[:1], cap) if a else np.zeros(1, np.int64)
        place[a:b], shared[a:b], character[a:b] = at, np.concatenate([first, found]), text[at]
    store.free(order, names)
    if common is not None:
        store.free(common)
    return place, shared, character


def _placed(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where ascending ``values`` exceed each of ``sought``, whose equal ones lie together."""
    edges = np.flatnonzero(np.concatenate([[True], sought[1:] != sought[:-1]]))
    return np.repeat(np.searchsorted(values, sought[edges], side="right"), np.diff(np.append(edges, len(sought))))


def suffix_order(store: Store, text: np.ndarray, characters: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``text`` in order, and the common prefix of each with the one before, up to ``cap`` (at most 254).

    The text is of integers below ``characters``, the last one a unique 0.
    """
    n = len(text)
    kind = place_type(n)
    lms, larger = seeds_of(store, text)
    if n == 1:
        store.free(lms)
        order, common = store.empty(n, kind), store.empty(n, np.uint8)
        order[:], common[:] = 0, 0
        return order, common
    seeds = _sorted_seeds(store, text, characters, lms, cap)
    store.free(lms)
    up = induce(store, text, seeds, larger, characters - 1, False, cap)
    store.free(*seeds)
    # the second pass goes down: its seeds are the L suffixes backwards
    back = tuple(store.empty(larger, x.dtype) for x in up)
    for a, b in blocks(larger):
        back[0][a:b], back[2][a:b] = up[0][larger - b : larger - a][::-1], characters - 1 - up[2][larger - b : larger - a][::-1]
        back[1][a:b] = np.append(up[1][larger - a : larger - a + 1] if a else np.zeros(1, np.uint8), up[1][larger - b + 1 : larger - a][::-1])
    smaller = n - 1 - larger
    down = induce(store, text, back, smaller, characters - 1, True, cap)
    store.free(*back)
    del back, seeds, lms
    order, common = store.empty(n, kind), store.empty(n, np.uint8)
    order[0], common[0] = n - 1, 0
    for a, b in blocks(larger):
        # of the S suffixes, which go down in their list, those of smaller characters come before
        before = smaller - _placed(down[2], characters - 1 - up[2][a:b].astype(np.int64))
        at = np.arange(a, b) + 1 + before
        order[at], common[at] = up[0][a:b], up[1][a:b]
    for a, b in blocks(smaller):
        character = characters - 1 - down[2][a:b].astype(np.int64)
        upto = _placed(up[2], character)
        at = smaller - np.arange(a, b) + upto
        shared = np.append(down[1][a + 1 : b], down[1][b] if b < smaller else 0).astype(np.int64)
        # the smallest S suffix of a character follows the largest L suffix of it
        least = np.append(character[1:] != character[:-1], b == smaller or characters - 1 - int(down[2][min(b, smaller - 1)]) != character[-1])
        met = np.flatnonzero(least & (upto > 0) & (up[2][np.maximum(upto - 1, 0)] == character)) if larger else np.zeros(0, np.int64)
        shared[least] = 0
        if len(met):
            shared[met] = extended(text, up[0][upto[met] - 1].astype(np.int64), down[0][a:b][met].astype(np.int64), np.ones(len(met), np.int64), cap)
        order[at], common[at] = down[0][a:b], shared
    store.free(*up, *down)
    return order, common


def repeats(strings: Iterator[tuple[np.ndarray, np.ndarray]], length: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place where ``length`` bytes of a string start, the smallest owner of a string that has these bytes.

    ``strings`` gives batches of (bytes with a separator -1 after each string, the string's owner for each); what
    is given back are, batch by batch, the owners found and the number of places of each string. The
    strings are sorted as one text; neighbours in order that share ``length`` bytes form groups.
    """
    parts, held = [], []
    for codes, owners in strings:
        part = store.empty(len(codes), np.int16)
        part[:] = codes
        parts.append(part)
        held.append(owners)
    n = sum(len(x) for x in parts) + 1
    if n == 1:
        return
    used = np.zeros(257, bool)
    for part in parts:
        used |= np.bincount(part + 1, minlength=257) > 0
    code = np.cumsum(used)
    owners = np.concatenate(held)
    names, owners = np.unique(owners, return_inverse=True)
    owners = owners.astype(place_type(len(owners)))
    text, string = store.empty(n, np.uint16), store.empty(n, place_type(n))
    at, number, stops = 0, 0, []
    for part in parts:
        stop, ends = at + len(part), np.flatnonzero(part < 0)
        text[at:stop] = code[part + 1]
        string[at:stop] = np.repeat(np.arange(number, number + len(ends)), np.diff(np.concatenate([[-1], ends])))
        stops.append(ends + at)
        number += len(ends)
        at = stop
    text[n - 1], string[n - 1] = 0, number
    stops = np.append(np.concatenate(stops), n - 1).astype(place_type(n))
    store.free(*parts)
    parts.clear()
    order, common = suffix_order(store, text, int(code[-1]) + 1, length)
    store.free(text)
    del text
    # the smallest owner for each place, by its rank among the names
    found = store.empty(n, owners.dtype)
    least, where = np.zeros(0, owners.dtype), np.zeros(0, np.int64)
    for a, b in blocks(n):
        # a group may go on from the block before: ``where`` are its places, ``least`` its owner so far
        place, fresh = np.asarray(order[a:b]).astype(np.int64), common[a:b] < length
        own = string[place]
        real = stops[own] - place >= length
        group = np.cumsum(fresh)
        place, own, group = place[real], own[real], group[real]
        if len(place):
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            best = np.minimum.reduceat(owners[own], cuts)
            if len(where) and group[0] == 0:
                best[0] = min(best[0], least[0])
                found[where] = best[0]
            found[place] = np.repeat(best, np.diff(np.append(cuts, len(place))))
            last = cuts[-1]
            keep = group[-1] == (int(fresh.sum()))
            joined = place[last:] if not (len(where) and group[-1] == 0) else np.concatenate([where, place[last:]])
            where, least = (joined, best[-1:]) if keep else (np.zeros(0, np.int64), np.zeros(0, owners.dtype))
        elif fresh.any():
            where, least = np.zeros(0, np.int64), np.zeros(0, owners.dtype)
    store.free(order, common)
    del order, common
    at, first = 0, 0
    for batch in held:
        ends = stops[first : first + len(batch)].astype(np.int64)
        first += len(batch)
        stop = int(ends[-1]) + 1 if len(ends) else at
        places = np.arange(at, stop)
        count = np.maximum(np.diff(np.concatenate([[at - 1], ends])) - length, 0)
        yield names[found[at:stop][np.repeat(ends, np.diff(np.concatenate([[at - 1], ends]))) - places >= length]], count
        at = stop
