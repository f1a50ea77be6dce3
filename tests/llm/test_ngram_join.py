import random
import re

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD
from tracelink.llm.ngram_join import RTree, _candidates, ngram_components, point

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, k, tenths):
    def shingle_set(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())

    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in owners[x] if j > i}:
            e, t = sets[j]
            if d is not None and e is not None and 10 * len(s & t) >= tenths * len(s | t):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return sorted(((d, len(s), d if d is None else root(d)) for d, s in sets), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def copies(seed):
    """Chains and clouds of near copies around the threshold, of many sizes."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    rows = []
    for size in (1, 2, 3, 4, 9, 12, 13, 25, 40, 60, 120, 300):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(rng.choice([1, 4, 9])):
                now = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 1 + size // 40])):
                    now[rng.randrange(len(now))] = word()
                if rng.random() < 0.3:
                    now = now[: max(1, size - rng.randrange(0, 1 + size // 12))]
                rows.append((rng.randrange(10**9), " ".join(now)))
                if rng.random() < 0.5:
                    base = now
    shared = " ".join(word() for _ in range(60))
    rows += [(rng.randrange(10**9), shared + " " + " ".join(word() for _ in range(rng.randrange(0, 9)))) for _ in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "tenths"), [(3, 9), (5, 8)])
def test_near_copies_match_brute_force(spark, k, tenths):
    rows = copies(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(ngram_components(docs, k, tenths)) == brute(rows, k, tenths)


def test_long_documents_and_folded_points(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2060)]
    rows = [(i, " ".join(base[: rng.randrange(1950, 2060)] + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 20, 120]))])) for i in range(14)]
    rows += [(100 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(2000 + 20 * i))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {len(point(np.arange(n, dtype=np.uint64))) for n in (1, 600, 2040, 2060)} == {128, 256, 512, 1024}
    for tenths in (9, 8):
        assert rows_of(ngram_components(docs, 3, tenths)) == brute(rows, 3, tenths)


def test_awkward_rows(awkward):
    assert rows_of(ngram_components(awkward)) == brute([r[:2] for r in AWKWARD], 3, 9)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(ngram_components(docs)) == brute(rows, 3, 9)


def test_tree_search_is_exact():
    rng = np.random.default_rng(1)
    points = rng.poisson(4, (700, 16))
    tree = RTree(points)
    for q in points[:40]:
        least = 0.9 * q.sum()
        assert set(tree.search(q, least)) == set(np.flatnonzero(np.minimum(points, q).sum(1) >= least))


def test_empty_table(nothing):
    assert ngram_components(nothing).count() == 0


def test_a_pair_of_many_blocks_is_a_candidate_in_the_first_only():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.95], rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(90)]
    blocks = {sig: sorted(rng.choice(90, 70, replace=False).tolist()) for sig in (-5, 3, 11, 2**40)}
    sigs = {d: [s for s, members in blocks.items() if d in members] for d in range(90)}
    found = []
    for sig, members in blocks.items():
        a, b = _candidates(8, sig, [(2, d, len(sets[d]), d, point(sets[d]).tobytes(), sigs[d]) for d in members])
        found += list(zip(a, b, strict=True))
    bound = lambda d, e: (m := int(np.minimum(point(sets[d]), point(sets[e])).sum())) * 10 >= 8 * (len(sets[d]) + len(sets[e]) - m)
    want = {(d, e) for members in blocks.values() for d in members for e in members if d < e and bound(d, e)}
    assert len(found) == len(set(found)) and set(found) == want


def test_cloud_of_copies(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        now = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            now[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**9), " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(ngram_components(docs, 5, 8)) == brute(rows, 5, 8)
