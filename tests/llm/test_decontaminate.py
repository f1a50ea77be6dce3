import math
import random
import re

import numpy as np

from tests.llm.conftest import AWKWARD
from tracelink.llm.decontaminate import RADIUS, Windows, blocks, drop_leaks, find_leaks


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(docs, items):
    """Every window of every item's size, exact weighted similarity, no fingerprints."""
    sets = {i: set(grams(words(t))) for i, t in items if words(t)}
    held = {}
    for s in sets.values():
        for g in s:
            held[g] = held.get(g, 0) + 1
    weight = lambda g: 1 + math.log(len(sets) / held.get(g, 1))
    found = {}
    for d, t in docs:
        run = grams(words(t))
        for i, s in sets.items():
            if not s & set(run):
                continue
            size = max(1, len(words(dict(items)[i])) - 4)
            for a in range(max(1, len(run) - size + 1)):
                w = set(run[a : a + size])
                both = sum(map(weight, w & s))
                similar = both / (sum(map(weight, w | s)))
                if similar >= 0.8:
                    found[d, i] = max(similar, found.get((d, i), 0))
    return found


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 70)))) for i in range(40)] + [(90, "yes"), (91, None), (92, ""), (93, "one two three")]
    docs = [(0, "yes"), (1, "One, two... THREE!"), (2, "one two three four five six"), (3, None)]
    for d in range(4, 160):
        text = [word() for _ in range(rng.randrange(0, 150))]
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            item[rng.randrange(len(item))] = word()
        if rng.random() < 0.7:
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[: rng.choice([len(item), len(item), len(item) * 9 // 10, len(item) // 2])]
        docs.append((d, rng.choice([" ", ", ", " - "]).join(text).upper() if d % 2 else " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(frame, bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k] <= want[k] + 1e-9 for k in got)
    clean = {r.doc_id for r in drop_leaks(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    slabbed = {(r.doc_id, r.item_id) for r in find_leaks(frame, bench, 3000).collect()}
    assert slabbed == set(got)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    want = set(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert want and got <= want and len(got) >= 0.98 * len(want)


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "word " * 20), (None, "same id with other text 1 855 555 4208"), (2, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(awkward, items).collect()}
    assert got == {(5, 1), (4, None)}
    assert drop_leaks(awkward, items).count() == len(AWKWARD) - 2
    none = spark.createDataFrame([], items.schema)
    assert find_leaks(nothing, items).count() == 0 and find_leaks(awkward, none).count() == 0 and drop_leaks(awkward, none).count() == len(AWKWARD)


def test_slabs_change_nothing(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcd") + str(rng.randrange(40))
    common = [" ".join(word() for _ in range(12)) for _ in range(3)]
    items = [(i, " ".join([rng.choice(common), *(word() for _ in range(rng.randrange(8, 50)))])) for i in range(60)] + [(70, "yes"), (71, ""), (72, None)]
    docs = [(0, "yes"), (1, None), (2, "")]
    for d in range(3, 120):
        item = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4)):
            item[rng.randrange(len(item))] = word()
        docs.append((d, " ".join([word(), rng.choice(common), *item, rng.choice(common)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, find_leaks(frame, bench).collect()))
    assert len(want) > 40 and sorted(map(tuple, find_leaks(frame, bench, 2000).collect())) == want
    clean = drop_leaks(frame, bench, 2000)
    assert clean.columns == ["doc_id", "text"] and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {r[0] for r in want}


def test_window_sums_count_repeats_once():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (9, 2), (60, 7), (200, 500)):
        values, columns = rng.integers(0, kinds, n).astype(np.uint64), rng.integers(-5, 6, (n, 3))
        for size in {1, 2, (n + 1) // 2, n} - {k for k in range(9) if k > n}:
            got = Windows(values, columns).sums(size)
            for start in range(n - size + 1):
                first = np.unique(values[start : start + size], return_index=True)[1] + start
                assert (got[start] == columns[first].sum(0)).all()


def test_blocks_cover_all_bits_and_any_fingerprint_within_the_radius():
    parts = blocks()
    assert [a for a, _ in parts] + [64] == [0] + [a + w for a, w in parts] and len(parts) == RADIUS + 1
