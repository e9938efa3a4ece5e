"""SimHash groups against all pairs."""

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from textloom.llm import simhash


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, most):
    roots = list(range(len(fps)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                roots[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "a b c", "Été é ß\x0bx A a a a a", "x " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, spread))):
            out.add(base)
            base ^= sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 5))))
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread", "bucket"), [(1, 3, 20_000), (2, 60, 20_000), (3, 200, 5)])
def test_links_lose_nothing(spark, seed, spread, bucket):
    fps = clustered(400, seed, spread)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 3, bucket)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = plain_components(fps, 3)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("groups", [[(0, 8)], [(0, 4), (4, 8)], [(0, 2), (2, 5), (5, 8)], [(0, 2), (2, 4), (4, 6), (6, 8)]])
def test_thresholds_add_up(groups):
    near = np.random.default_rng(0).dirichlet([1] * 4, (8, 256))
    plan = simhash.Plan(list(range(64)), groups, near, 10**6, 3)
    thresholds, cost = plan.allocate(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))
    assert (thresholds.sum(1) == 3 - len(groups) + 1).all() and (thresholds >= -1).all() and (cost > 0).all()


def test_near_duplicates(spark):
    rows = [(5, "a b c d"), (3, "A B C  d"), (3, "A B C  d"), (9, None), (8, ""), (None, "a b c d"), (None, "lonely"), (1, "other words here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fp = {t: f"{plain_fingerprint(t):016x}" for _, t in rows}
    want = [("5", "a b c d", 3), ("3", "A B C  d", 3), ("3", "A B C  d", 3), ("9", None, 8), ("8", "", 8), ("None", "a b c d", 3), ("None", "lonely", None), ("1", "other words here", 1)]
    assert got == sorted(((i, fp[t], c) for i, t, c in want), key=lambda r: (r[0], r[1]))
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [("1", "other words here"), ("3", "A B C  d"), ("8", ""), ("None", "lonely")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).columns == docs.columns
