import random
import re
from fractions import Fraction

from tests.llm.conftest import AWKWARD
from tracelink.llm.mixing import apportion, mix_sources, shard_quotas, share_out


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(3)
    for _ in range(60):
        targets = [rng.choice([0, rng.randrange(1, 40), rng.randrange(1, 9000)]) for _ in range(rng.randrange(1, 8))]
        blocks = rng.randrange(0, 300)
        seats = [0] * len(targets)
        for _ in range(blocks if sum(targets) else 0):
            best = max(range(len(targets)), key=lambda i: (Fraction(targets[i], 2 * seats[i] + 1), -i))
            seats[best] += 1
        assert apportion(targets, blocks) == seats
        assert all(x >= 0 for row in shard_quotas(targets, blocks, 7) for x in row)


def test_share_out_stops_at_twice_the_size():
    got = share_out([100, 100, 100], [3, 1, 2], 450, 2)
    assert abs(sum(got) - 450) < 1e-9 and got[0] == 200 and max(got) <= 200 and abs(got[2] - 2 * got[1]) < 1e-9
    assert share_out([0, 0], [3, 1], 0, 2) == [0, 0] and share_out([], [], 0, 2) == []


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, rows):
    first, again = (sorted(map(str, mix_sources(docs).collect())) for _ in range(2))
    assert first == again
    got = mix_sources(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((d is None, d, size(t)) for d, t, *_ in rows)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.shard is None) == (r.taken == 0)
        by_source.setdefault(r.source, []).append(r)
    names = sorted(by_source, key=lambda s: (s is None, s))
    sizes = [sum(r.size for r in by_source[s]) for s in names]
    want = share_out(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for s, n, t in zip(names, sizes, want, strict=True):
        assert {(r.source_size, r.target) for r in by_source[s]} == {(n, t)}
        assert abs(sum(r.taken for r in by_source[s]) - t) <= 64


def test_awkward_rows(awkward):
    check(awkward.drop("size"), AWKWARD)
    assert mix_sources(awkward).count() == len(AWKWARD)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(nothing):
    assert mix_sources(nothing).count() == 0
