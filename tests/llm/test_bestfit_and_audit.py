import os
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import bestfit, interactions

WORDS = P.path("word_bpe_49k.json")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    None, "", " \n\t ", "a", "It's  the DOG'S\tday, isn't it?", "<|endoftext|> x <|startoftext|>", "é É ß ẞ İ Σς ﬁ x\x1cy \x85z", "a\0b", "1234 ÷ × µ ª",
    "word " * 9_000, "x" * 20_000, "!!!" * 50, "日本語 テキスト", "…—‘q’", "é", "don''t 's 'S", "  ",
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids string, part int, piece int")


def test_words_are_encoded_as_by_the_library():
    rng, full, own = random.Random(4), Tokenizer.from_file(WORDS), bestfit.encoder(WORDS)
    alphabet = "abcdefghijklmnopqrstuvwxyz'ABCXYZ019 éüßñÀ.,!-–—“\n\t|<>$%_/\\ø÷×"
    texts = [x or "" for x in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3_000)]
    assert own.fast is not None
    for text, want in zip(texts, full.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(text) == want.ids, text


def test_files_of_another_kind_go_through_the_library():
    own, full = bestfit.WordEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert own.fast is None and own.ids("Plain text's words") == full.encode("Plain text's words", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Rooms of best-fit decreasing, a piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda i: (rooms[i], i))] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("capacity,most,size", [(1, 1, 5), (10, 10, 200), (10, 3, 60), (64, 64, 500), (64, 20, 999), (100, 100, 1), (50, 49, 0), (4_096, 4_095, 800)])
def test_runs_are_those_of_best_fit_decreasing(capacity, most, size):
    rng = random.Random(capacity * most)
    lengths = [rng.randint(1, most) if rng.random() < 0.7 else max(1, most // 3) for _ in range(size)]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs, used = bestfit.best_fit_runs(dict(counts), capacity)
    rooms, held, ranks = one_by_one(lengths, capacity), defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            held[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert used == len(rooms) == len(held)
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in held.values()) == sorted(rooms)


def test_the_tree_finds_the_tightest_room():
    rng, tree, there = random.Random(5), bestfit.Tightest(37), set()
    for _ in range(2_000):
        room = rng.randint(0, 37)
        (there.add if rng.random() < 0.3 else there.discard)(room)
        tree.put(room, room in there)
        least = rng.randint(0, 37)
        assert tree.find(least) == min((x for x in there if x >= least), default=None)


def test_the_plan_does_not_grow_with_the_documents():
    rng = random.Random(6)
    few = {n: rng.randint(1, 50) for n in range(1, 1_000)}
    runs, _ = bestfit.best_fit_runs(few, 1_000)
    many, used = bestfit.best_fit_runs({n: k * 10**9 for n, k in few.items()}, 1_000)
    assert len(many) < 20 * 1_000 and len(runs) < 20 * 1_000 and used > 10**9


@pytest.mark.parametrize("length", [4_096, 64])
def test_pieces_of_all_documents(spark, length):
    rng = random.Random(length)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(7, "same id"), (7, "same id"), (None, "no id at all")]
    rows += [(100 + i, " ".join(rng.choice(("one", "two", "Three,", "wörd")) for _ in range(rng.randrange(300)))) for i in range(120)] + [(500 + i, "a copy") for i in range(150)]
    got = [r.asDict() for r in bestfit.pack(documents(spark, rows).repartition(7), WORDS, length=length).collect()]
    full = Tokenizer.from_file(WORDS)
    want = sorted((k if k is not None else -1, tuple(full.encode(t or "", add_special_tokens=False).ids + [1])) for k, t in rows)
    told = []
    for r in sorted(got, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["sequence_id"])):
        assert r["start"] == r["piece"] * length and 0 < r["length"] <= length and len(r["ids"]) == 4 * r["length"]
        if r["length"] == length:
            assert r["offset"] == 0
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    starts = defaultdict(list)
    for r in got:
        starts[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
    for (doc, n), pieces in starts.items():
        copies = sum(start == 0 for start, _ in pieces)
        pieces.sort()
        if copies == 1:
            told.append((doc if doc is not None else -1, tuple(x for _, ids in pieces for x in ids)))
        else:  # equal rows only
            told += [(doc if doc is not None else -1, ids) for start, ids in pieces if start == 0 and len(ids) == n]
    assert sorted(told) == want
    assert len(by) == sum(len(ids) // length for _, ids in want) + len(one_by_one([len(ids) % length for _, ids in want if len(ids) % length], length))
    sums = {(r.doc_id, r.piece, r.ids_crc32) for r in bestfit.piece_digests(bestfit.pack(documents(spark, rows), WORDS, length=length)).collect()}
    assert sums == {(r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in got}


def test_packing_of_an_empty_table(spark):
    assert bestfit.pack(documents(spark, []), WORDS).count() == 0


def failing(rows):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))
        yield i, part or "", frozenset(x for x, no in zip("ABCDE", (a, b, c, d, i is not None and first[text] < i), strict=True) if no)


def plain_audit(rows, labels):
    told, out = list(failing(rows)), {}
    good, toxic = ({k for k, *v in labels if k is not None and v[n] == 1} for n in (0, 1))
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                out[part, "".join(order), step + 1] = [
                    len(kept), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), 0,
                ]
                left = kept
    totals = defaultdict(int)
    for (part, order, step), v in out.items():
        totals[part, order[step - 1]] += v[1]
    return {k: (*v[:-1], totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_a_plain_version(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice([f"w{k}" for k in range(rng.choice([30, 900]))]) for _ in range(rng.choice([5, 199, 200, 260]))) for _ in range(12)]
    base += [None, "", " \t\n", "A" * 50, "x y #", "Ünï | code", " ".join(f"t{k}" for k in range(4_000)) + " TAIL", "w " * 30_000]
    rows = [(rng.choice([None, *range(150)]), (t := rng.choice(base)) and t + rng.choice(["", "", " X$", "  "]), rng.choice(["en", "de", None, ""])) for _ in range(300)] + [(400, base[0], "fr")] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, lang string, n int, id int, sha string")
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in interactions.audit_documents(docs, told).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit_documents(docs, labels).count() == 0
    one = interactions.audit_documents(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.unique_fails for r in one) == 120


def test_zeta_of_three_filters(spark):
    rng = random.Random(1)
    rows = [(p, rng.randrange(8), rng.randrange(5)) for p in "xy" for _ in range(20)]
    got = interactions.audit(spark.createDataFrame(rows, "part string, mask int, n long"), list("PQR"), []).collect()
    assert len(got) == 2 * 6 * 3
    for r in got:
        before = sum(1 << "PQR".index(x) for x in r.filter_order[: r.step - 1])
        bit = 1 << "PQR".index(r.filter_order[r.step - 1])
        assert r.removed == sum(n for p, m, n in rows if p == r.part and not m & before and m & bit)
        assert r.kept == sum(n for p, m, n in rows if p == r.part and not m & (before | bit))
