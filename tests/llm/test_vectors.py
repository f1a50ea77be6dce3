import numpy as np

from tracelink.llm.vectors import ESTIMATES, bands_for, near_vectors, rotations, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, least=0.9):
    units = unit(vectors)
    links = units @ units.T >= least
    np.fill_diagonal(links, False)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(links), strict=True):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: (int(links[i].sum()), min(groups[root(i)])) for i in range(len(ids))}, links


def clouds(seed, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in [(1, 0)] * 150 + [(4, 0.02), (30, 0.03), (60, 0.05), (25, 0.058), (40, 0.0)] * 3:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out.append(centre + noise * rng.standard_normal((size, dim)))
    vectors = np.concatenate(out).astype(np.float32)
    ids = rng.permutation(10 * len(vectors))[: len(vectors)]
    return [int(i) for i in ids], vectors


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x, y = unit(rng.standard_normal((2, 64)))
    turns = rotations(64, 400, 3)
    tx, ty = x @ turns, y @ turns
    factor = np.abs(tx).sum(1) / 8
    estimates = (np.sign(tx) * ty).sum(1) / 8 / factor
    assert abs(estimates.mean() - x @ y) < 4 * estimates.std() / 20 and ESTIMATES >= 1


def test_recall_against_brute_force(spark):
    ids, vectors = clouds(1)
    want, links = brute(ids, vectors)
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert set(got) == set(ids)
    assert all(got[i].n_links <= want[i][0] and got[i].kept == (got[i].component_id == i) for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.95 * links.sum()
    assert sum(got[i].component_id == want[i][1] for i in ids) >= 0.95 * len(ids)


def test_parts_of_large_buckets_agree(spark, monkeypatch):
    import tracelink.llm.vectors as module

    ids, vectors = clouds(2)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    whole = sorted(map(tuple, near_vectors(rows).collect()))
    monkeypatch.setattr(module, "PART", 7)
    assert sorted(map(tuple, near_vectors(rows).collect())) == whole


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0),
        (9, [1.0, None], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [-1.0, 0.0], 0), (12, [0.0, 0.0], 0), (13, [nan, 1.0], 0), (1, [1.0, 0.0], 0), (14, [1e-30, 0.0], 0),
    ]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [g for g in got if g[0] == 1] == [(1, 4, 1, True)] * 2
    assert {g[0]: g[1:] for g in got if g[0] in (2, 3, 14)} == {2: (4, 1, False), 3: (4, 1, False), 14: (4, 1, False)}
    assert all(g[1:] == (0, g[0], True) for g in got if g[0] in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert [g for g in got if g[0] == 0] == [(0, 0, None, False)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reach_the_recall():
    for n in (1, 1000, 10**6, 10**9):
        bits, bands = bands_for(n, 0.9)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** bands >= 0.97
