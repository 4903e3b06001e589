import random

import pytest

from lexiloom.operators import corpus
from lexiloom.storage import Scratch


def made(rng, n, boiler=""):
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([9, 30, 80]))] for _ in range(8)]
    rows = [(1, "a", None), (2, "a", ""), (3, "b", "one two three")]
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(own) // 15)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((10 + i, rng.choice("ab"), f"{boiler} {' '.join(own)}"))
    return rows


def plain(rows):
    import hashlib
    import re

    sets = {}
    for i, _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        grams = {hashlib.sha256(" ".join(w[j : j + 5]).encode()).hexdigest()[:16] for j in range(max(0, len(w) - 4))}
        if grams:
            sets[i] = frozenset(grams)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    labels = {i: x for i, x, _ in rows}
    out = {(first[s], i, 1.0, labels[first[s]] != labels[i]) for i, s in sets.items() if first[s] != i}
    own = sorted(first.values())
    candidates = set()
    for a in own:
        for b in own:
            if a < b and set(sorted(sets[a])[:16]) & set(sorted(sets[b])[:16]):
                candidates.add((a, b))
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) / max(len(x), len(y)) >= 0.8 and len(x & y) / len(x | y) >= 0.8:
                    out.add((a, b, len(x & y) / len(x | y), labels[a] != labels[b]))
    return out, candidates


@pytest.mark.parametrize("hot", [100, 3, 1])
@pytest.mark.parametrize("boiler", ["", " ".join(f"notice{k}" for k in range(12))])
def test_near_pairs_with_hot_grams(spark, monkeypatch, hot, boiler):
    """One notice stands in all records, so some of its grams are in very many sketches."""
    monkeypatch.setattr(corpus, "HOT_GRAM", hot)
    rows = made(random.Random(hot), 150, boiler)
    df = spark.createDataFrame(rows, "i long, label string, text string")
    got = {tuple(r) for r in corpus.near_duplicates(df, "i", "label", "text").collect()}
    want, candidates = plain(rows)
    assert got == want and len(want) > 20
    for budget in (len(candidates) - 1, len(candidates)):
        (r,) = corpus.near_status(df, "i", "text", budget).collect()
        assert tuple(r) == ((budget, len(candidates), "complete") if budget == len(candidates) else (budget, None, "exceeded"))


def test_a_gram_of_all_records_gives_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(corpus, "HOT_GRAM", 20)
    rng = random.Random(4)
    notice = " ".join(f"notice{k}" for k in range(40))
    rows = [(i, "x", notice + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(25))) for i in range(600)]
    rows += [(1_000, "x", rows[0][2] + " more"), (1_001, "x", rows[1][2] + " again")]
    df = spark.createDataFrame(rows, "i long, label string, text string")
    with Scratch(spark) as put:
        sets, first = corpus._with_first(df, "i", "text", put)
        assert corpus.near_candidates(sets, first.where("id = first").select("id"), put).count() < 2_000  # of some 180,000 pairs
    got = {tuple(r)[:2] for r in corpus.near_duplicates(df, "i", "label", "text").collect()}
    assert got == {r[:2] for r in plain(rows)[0]} and {(0, 1_000), (1, 1_001)} <= got


def test_nothing_to_pair(spark):
    df = spark.createDataFrame([], "i long, label string, text string")
    assert corpus.near_duplicates(df, "i", "label", "text").count() == 0
    assert tuple(corpus.near_status(df, "i", "text").first()) == (200_000, 0, "complete")


def test_whole_sets_travel_only_for_pairs_that_may_be_similar(spark):
    """Records that share a few rare grams by chance make pairs, which the marks of their sets tell apart."""
    rng = random.Random(6)
    sizes = [5, 40, 200, 900]
    sets, n = [], 0
    for size in sizes:
        for _ in range(6):
            base = [rng.getrandbits(62) for _ in range(size)]
            for k in range(4):
                sets.append((n, sorted({*base[: size - k * size // 30], *(rng.getrandbits(62) for _ in range(k * size // 30))})))
                n += 1
    df = spark.createDataFrame(sets, "id long, grams array<long>")
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    known = dict(sets)
    similar = {(a, b) for a, b in pairs if len({*known[a]} & {*known[b]}) >= 0.8 * len({*known[a]} | {*known[b]})}
    with Scratch(spark) as put:
        got = {tuple(r) for r in corpus.possible_pairs(df, spark.createDataFrame(pairs, "left long, right long"), put).collect()}
    assert similar <= got and len(similar) > 90 and len(got) < len(similar) + 60  # of 4,560 pairs
