"""Near duplicates by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

from textloom.llm import shingle_links, simhash


def texts(seed: int = 4, most: int = 14) -> list[str]:
    """Random texts, up to 13 copies of each with a few words changed, and a line that half of them share."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("l", "m", "n", "r", "s", "t", "v", "z")]
    out = ["", "one", "One", "two words", "  two\twords ", "a b c d e", "A b c d e f"]
    for i in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        for copy in range(rng.randint(1, most)):
            changed = list(own)
            for _ in range(copy and rng.randint(1, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            out.append(" ".join(changed) + (" all rights reserved by the owners of this text" if i % 2 else ""))
    out += ["all rights reserved by the owners of this text", "all rights reserved by the owners of this text again"]
    return out


def jaccard(x: str, y: str) -> float:
    sets = []
    for text in (x, y):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def plain_groups(rows: list[str], most: int = 3, similarity: float = 0.8) -> list[int]:
    """The smallest index that each text is linked to, by all pairs."""
    prints, root = [simhash.fingerprint(text) for text in rows], list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most or jaccard(rows[i], rows[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def test_keep_one_against_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    expected = sorted(set(plain_groups(rows)))
    assert kept == expected and len(expected) < len(set(plain_groups(rows, similarity=2.0)))


def test_pairs_pruned_by_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: rng.integers(30, 60)], rng.integers(0, 2**64, rng.integers(0, 9), dtype=np.uint64)])) for s in sets for _ in range(3)]
    counts = np.stack([np.frombuffer(shingle_links.folded_counts(shingle_links.range_counts(s)), np.uint8) for s in sets])
    n = len(sets)
    table = {"key": np.zeros(n, np.int64), "th": np.arange(n), "size": np.array([len(s) for s in sets]), "pos": np.zeros(n, np.int64), "root": np.arange(n)}
    unpruned = {p for a, b in shingle_links.pairs_met(table, False, 0.8, chunk=70) for p in zip(a.tolist(), b.tolist(), strict=True)}
    found = {p for a, b in shingle_links.pairs_met(table | {"counts": counts}, False, 0.8, chunk=70) for p in zip(a.tolist(), b.tolist(), strict=True)}
    similar = {(i, j) for i, j in unpruned if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= found < unpruned and similar
    unknown = {p for a, b in shingle_links.pairs_met(table | {"counts": counts * 0}, False, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert unknown == unpruned
    assert shingle_links.range_counts(np.arange(300, dtype=np.uint64)) == b""


def test_planted_edits_are_found_and_clean_texts_stay(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    originals = [[rng.choice(words) for _ in range(rng.randint(80, 400))] for _ in range(80)]
    rows, copies = [(i, " ".join(w)) for i, w in enumerate(originals)], {}
    for k in range(120):
        i = rng.randrange(40)
        changed = list(originals[i])
        for _ in range(max(1, len(changed) // rng.randint(60, 200))):
            changed[rng.randrange(len(changed))] = "edited"
        copies[1000 + k] = jaccard(" ".join(changed), " ".join(originals[i])) >= 0.8
        rows.append((1000 + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    near = {i for i, is_near in copies.items() if is_near}
    assert len(near) > 80 and not near & kept and set(range(80)) <= kept


def test_pairs_met_in_chunks():
    rng = np.random.default_rng(1)
    n = 300
    table = {"key": rng.integers(0, 20, n), "th": np.arange(n), "size": rng.integers(20, 30, n), "pos": rng.integers(0, 4, n), "root": rng.integers(0, 9, n)}
    expected = set()
    for a in range(n):
        for b in range(a):
            sizes = table["size"][[a, b]]
            can = min(sizes) >= 0.8 * max(sizes) and min(sizes - table["pos"][[a, b]]) >= np.ceil(0.8 / 1.8 * sum(sizes) - 1e-9)
            if table["key"][a] == table["key"][b] and table["root"][a] != table["root"][b] and can:
                expected.add((b, a))
    found = [p for a, b in shingle_links.pairs_met(table, False, 0.8, chunk=50) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(found) == expected
    assert {p for a, b in shingle_links.pairs_met(table, True, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)} <= expected


def test_keep_one_of_repeated_and_missing_ids(spark):
    words = [f"w{i}" for i in range(400)]
    long, other, third = " ".join(words[:120]), " ".join(words[120:240]), " ".join(words[240:360])
    near_third = third.replace("w300", "x")
    rows = [(7, long, "a"), (7, other, "b"), (3, other, "c"), (None, third, "d"), (None, near_third, "e"), (None, long, "f"), (5, "twice the same", "z"), (5, "twice the same", "y"), (9, "", "g"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = simhash.keep_one(docs).collect()
    third_kept = [r for r in kept if r.text in (third, near_third)]
    assert sorted(r.source for r in kept if r not in third_kept) == ["a", "c", "g", "y"]
    assert len(third_kept) == 1 and sorted(r.source for r in simhash.keep_one(docs).collect()) == sorted(r.source for r in kept)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_pivot_pairs_are_few_and_of_the_largest_component():
    rng = np.random.default_rng(5)
    n, pivots = 400, 3
    table = {"key": rng.integers(0, 10, n), "th": rng.permutation(n), "size": rng.integers(20, 24, n), "pos": rng.integers(0, 3, n), "root": np.minimum(rng.integers(0, 30, n), 20)}
    table["counts"] = np.zeros((n, 64), np.uint8)
    every = {p for a, b in shingle_links.pairs_met(table, False, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for seed in (1, 2):
        found = {p for a, b in shingle_links.pivot_pairs(table, seed, pivots, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert found and found <= every and len(found) <= pivots * n
        root = dict(zip(table["th"].tolist(), table["root"].tolist(), strict=True))
        assert all(20 in (root[a], root[b]) for a, b in found)
    nothing = {c: table[c][:0] for c in table}
    assert not list(shingle_links.pivot_pairs(nothing, 1, pivots, 0.8))


def test_group_of_partly_similar_copies(spark):
    """Copies of one text whose pairs lie about the threshold, over passages that all share."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
        rows.append(" ".join(words))
    rows += [" ".join([f"o{k}x{i}" for i in range(40)] + base[:60]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(plain_groups(rows)))


@pytest.mark.parametrize("alike", [False, True])
def test_pairs_of_a_large_key_take_bounded_memory(alike):
    """3,000 texts of one key have 4.5 million pairs; none of them is lost."""
    import tracemalloc

    n = 3000
    one = {"key": np.zeros(n, np.int64), "th": np.arange(n, dtype=np.int64)[::-1], "size": np.full(n, 100, np.int32), "pos": np.zeros(n, np.int32), "root": np.arange(n, dtype=np.int64)}
    if not alike:
        one["pos"][: n // 2] = 50
    tracemalloc.start()
    found = sum(len(a) for a, b in shingle_links.pairs_met(one, False, 0.8) if (a < b).all())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    m = n if alike else n // 2
    assert found == m * (m - 1) // 2 and peak < 80e6
