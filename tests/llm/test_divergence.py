import random
import re
from collections import Counter, defaultdict

import pytest

from tracelink.llm import divergence as d


def brute(rows, min_docs=10):
    words = []
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        docs = Counter(t for _, _, ts in mine for t in set(ts))
        kept = {t for t, n in docs.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, ts in mine:
            counts[source].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source, own in counts.items():
            pairs = [(o, sum(f(share(own, t), share(c, t)) for t in kept)) for o, c in counts.items() if o != source]
            terms = [(t, f(share(own, t), share(whole, t))) for t in own if own[t] > 0 and share(own, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: 10 if part == "term" else None]
                out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made(n, seed=7):
    rnd = random.Random(seed)
    vocabulary = [a + b for a in ("Ab", "é", "zz", "ü", "Q", "don") for b in ("", "x", "Ñ", "yy", "𝔘")]
    text = lambda: rnd.choice([" ", "\n", "'", "7"]).join(rnd.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rnd.randrange(30)))
    rows = [(text(), rnd.choice(["en", "en", "fr", None, ""]), f"s{min(rnd.randrange(40), rnd.randrange(40))}") for _ in range(n)]
    few = [("rare words alone", "xx", s) for s in ("a", "b", "c")] + [(None, "en", "no text"), ("", "en", None), ("12 34", "lonely", "one"), ("only", "fr", "s1")]
    return rows + few + [("hot " * 50 + "words", "en", "big")] * 30


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "0 AS term", "'x' AS n", "1 AS total", "2 AS value")


@pytest.mark.parametrize("cut", [{}, {"block": 1, "chunk": 2, "slab": 1}, {"block": 3, "chunk": 5, "slab": 2}, {"block": 100, "chunk": 1, "slab": 3}], ids=str)
def test_against_brute_force(spark, cut):
    rows = made(300)
    got = d.audit_sources(frame(spark, rows), **cut).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_joined_groups_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_GROUPS", -1)
    monkeypatch.setattr(d, "HELD", 3)
    rows = made(60)
    assert sorted(map(tuple, d.audit_sources(frame(spark, rows), min_docs=3).collect())) == brute(rows, 3)


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    for least in (1, 2, 10):
        assert sorted(map(tuple, d.audit_sources(awkward, min_docs=least).collect())) == brute(rows, least)
    assert d.audit_sources(nothing).count() == 0


def test_pieces_of_long_texts():
    table = d._letters()
    text = "Ab cdé  " * 100 + "x" * 500 + " end" + "é" * 77
    whole = [t for p in d.term_pieces(text.encode(), table, 1 << 20) for t in p]
    for most in (1, 2, 7, 64, 499, 1000):
        assert [t for p in d.term_pieces(text.encode(), table, most) for t in p] == whole


def test_shares_beyond_64_bits(spark):
    for count, total in [(0, 2), (5 * 10**14, 8 * 10**15), (8 * 10**15 - 2, 8 * 10**15), (123456789012345, 987654321098765)]:
        want = 1 + 10**9 * (count + 2) // total
        import numpy as np
        from pyspark.sql import functions as F

        assert d.shares(np.array([count]), np.array([total])).tolist() == [want]
        assert spark.range(1).select(d.share(F.lit(count).cast("long"), F.lit(total).cast("long")).alias("p")).first().p == want
